"""Experts' actions as set operations: buttons and commands are read, guarded, applied to stored signals, and audited."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import urls
from tidewatch.operators.lifecycle import REASONED, judge
from tidewatch.operators.store import Store
from tidewatch.schemas import shaped
from tidewatch.session import kept

# What buttons and commands ask for, and the reasons behind the rejection buttons.
BUTTONS = {"work": "in_progress", "later": "postponed"}
COMMANDS = {"/reopen": "new", "/complete": "completed"}
REJECTIONS = {"r_not_target": "not_target_category", "r_dup": "duplicate", "r_not_npa": "not_npa", "r_other": "other"}

_PRESS = r"^(sig|rej):(\d{1,18}):([a-z_]+)$"
_COMMAND = r"^\s*(/[a-z]+)\s+(\d{1,18})\s*$"


def _meaning(names: dict[str, str], name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), name)


def read_requests(said: DataFrame) -> DataFrame:
    """said (request_id, user_id, at, data) with signal_id, to_status, rejection_reason, reason; error ``format`` where data is no button or command.

    A button is ``sig:<id>:<action>`` or ``rej:<id>:<code>``, a command ``/reopen <id>`` or ``/complete <id>``. What said holds as ``comment`` goes
    with a rejection.
    """
    press = lambda k: F.regexp_extract("data", _PRESS, k)
    command = lambda k: F.regexp_extract("data", _COMMAND, k)
    why = F.when(press(1) == "rej", _meaning(REJECTIONS, press(3)))
    to = F.when(press(1) == "sig", _meaning(BUTTONS, press(3))).when(why.isNotNull(), F.lit(REASONED)).otherwise(_meaning(COMMANDS, command(1)))
    read = said.withColumns({"signal_id": F.coalesce(press(2).try_cast("bigint"), command(2).try_cast("bigint")), "to_status": to, "rejection_reason": why, "reason": F.when(command(1) == "/reopen", "reopen")})
    comment = F.nullif(F.trim("comment"), F.lit("")) if "comment" in said.columns else F.lit(None).cast("string")
    read = read.withColumn("rejection_comment", F.when(F.col("to_status") == REASONED, comment))
    return read.withColumn("error", F.when(F.col("signal_id").isNull() | F.col("to_status").isNull(), "format"))


def with_links(requests: DataFrame, sent: DataFrame, pages: DataFrame, domains: DataFrame) -> DataFrame:
    """Requests to hand signals on, from sent (request_id, user_id, at, signal_id, text): the link is checked before anything moves.

    ``skip`` keeps the stored link; other texts must begin with http, lie in domains (domain) and be pages (url, ok) that could be read.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    link = F.when(F.lower(text) != "skip", text)
    known = sent.withColumn("npa_link", link)
    # links are checked, not requests: each distinct one once
    links = known.where("npa_link IS NOT NULL").select("npa_link").distinct()
    listed = urls.allowed(links, domains, "npa_link").select("npa_link").distinct().withColumn("listed", F.lit(True))
    reached = pages.where("ok").select(F.col("url").alias("npa_link")).distinct().withColumn("reached", F.lit(True))
    checked = links.join(listed, "npa_link", "left").join(reached, "npa_link", "left")
    known = known.join(checked, "npa_link", "left")
    wrong = F.when(~F.col("npa_link").startswith("http"), "link").when(F.col("npa_link").isNotNull() & F.col("listed").isNull(), "domain").when(F.col("npa_link").isNotNull() & F.col("reached").isNull(), "unreachable")
    made = known.select("request_id", "user_id", "at", "signal_id", F.lit("sent_to_agent").alias("to_status"), wrong.alias("error"), "npa_link")
    return requests.unionByName(made, allowMissingColumns=True)


def decide(requests: DataFrame, signals: DataFrame, users: list[int]) -> DataFrame:
    """requests with from_status, accepted and error: ``format``, ``link``, ``domain`` or ``unreachable`` as told, else ``access``, ``missing``, ``reason`` or ``transition``.

    Requests of a signal apply in order of at and request_id, each from the status that the one before left; a refused one changes nothing.
    They are judged in parts of bounded size, however many one signal has.
    """
    found = requests.join(signals.select(F.col("id").alias("signal_id"), F.col("status").alias("stored")), "signal_id", "left")
    barred = F.coalesce(
        F.when(~F.coalesce(F.col("user_id").isin(*users), F.lit(False)), "access"),
        "error",
        F.when(F.col("stored").isNull(), "missing"),
        F.when((F.col("to_status") == REASONED) & ~F.coalesce(F.col("rejection_reason").isin(*REJECTIONS.values()), F.lit(False)), "reason"),
    )
    found = found.withColumn("error", barred)
    judged = judge(found, ["signal_id"], ["at", "request_id"], start=F.col("stored"), able=F.col("error").isNull())
    told = judged.withColumn("error", F.when(~F.col("accepted"), F.coalesce("error", F.lit("transition"))))
    return told.withColumn("from_status", F.when(F.col("accepted") | (F.col("error") == "transition"), F.col("from_status"))).drop("stored")


def history(decided: DataFrame) -> DataFrame:
    """An audit row for each accepted request."""
    rows = decided.where("accepted").select(F.col("request_id").alias("id"), "signal_id", "from_status", "to_status", F.col("at").alias("changed_at"), F.col("user_id").cast("string").alias("changed_by"), "reason")
    return shaped("status_history", rows)


def applied(signals: DataFrame, decided: DataFrame) -> DataFrame:
    """signals after the accepted requests: status, time of change, link, reason and comment; reopening clears the latter two."""
    order, done = F.struct("at", "request_id"), decided.where("accepted")
    optional = {c: F.col(c) if c in decided.columns else F.lit(None).cast("string") for c in ("npa_link", "rejection_reason", "rejection_comment")}
    told = done.withColumns(optional).withColumn("weighs", F.col("to_status").isin(REASONED, "new"))
    last = told.groupBy(F.col("signal_id").alias("id")).agg(
        F.max_by("to_status", order).alias("status_"),
        F.max("at").alias("at_"),
        F.max_by("npa_link", F.when(F.col("npa_link").isNotNull(), order)).alias("link_"),
        F.max_by(F.struct("to_status", "rejection_reason", "rejection_comment"), F.when(F.col("weighs"), order)).alias("why_"),
    )
    joined = signals.join(last, "id", "left")
    why = lambda c: F.when(F.col("why_.to_status").isNull(), F.col(c)).when(F.col("why_.to_status") == REASONED, F.col(f"why_.{c}"))
    new = {"status": F.coalesce("status_", "status"), "updated_at": F.coalesce("at_", "updated_at"), "npa_link": F.coalesce("link_", "npa_link"), "rejection_reason": why("rejection_reason"), "rejection_comment": why("rejection_comment")}
    return joined.withColumns(new).select(*signals.columns)


def handed_on(signals: DataFrame, decided: DataFrame) -> DataFrame:
    """Outbox rows of the signals handed on in this run, from signals as they are after it."""
    sent = decided.where("accepted AND to_status = 'sent_to_agent'").select(F.col("signal_id").alias("id")).distinct()
    return shaped("outbox", signals.join(sent, "id", "left_semi").withColumnRenamed("id", "signal_id"))


def run(store: Store, batch: int, said: DataFrame, sent: DataFrame, pages: DataFrame, domains: DataFrame, users: list[int]) -> None:
    """One batch of experts' requests on the stored signals, stored with one commit: new versions of the changed signals, audit rows, what is handed on, verdicts.

    It reads the signals as the batches before left them, so a batch that is repeated replaces itself. said and sent are as in ``read_requests`` and ``with_links``.
    """
    requests = with_links(read_requests(said), sent, pages, domains)
    signals = store.read("signals", batch)
    decided = kept(decide(requests, signals, users), "decided")
    touched = signals.join(decided.where("accepted").select(F.col("signal_id").alias("id")).distinct(), "id", "left_semi")
    changed = kept(applied(touched, decided), "changed")
    store.write(batch, {"signals": changed, "status_history": history(decided), "outbox": handed_on(changed, decided), "verdicts": decided})


def asked_model(rows: DataFrame, text: str, ask: Callable[[str], str], into: str = "answer") -> DataFrame:
    """rows with a model client's answers about a text; where the client fails or there is no text, null."""
    schema = rows.withColumn(into, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for t in batch[text].tolist():
                try:
                    answers.append(ask(t) if t else None)
                except Exception:  # one answer less fails no row
                    answers.append(None)
            yield batch.assign(**{into: pd.Series(answers, index=batch.index, dtype=object)})

    return rows.mapInPandas(run, schema)
