"""The incremental jobs as Structured Streaming: ingest by micro-batch, dedup, the status machine."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState

from tidewatch.catalog import TRANSITIONS, Catalog
from tidewatch.operators.classify import classify
from tidewatch.operators.ingest import contiguous_pages, ingest, is_stale, window_start
from tidewatch.operators.lifecycle import REASONED
from tidewatch.operators.seen import bloom_rows, seen_with
from tidewatch.operators.store import Store


def new_publications(stream: DataFrame, catalog: Catalog, since: str | None = None, lateness: str = "0 seconds") -> DataFrame:
    """Unseen publications, classified. Rows dated before ``since`` less ``lateness`` are dropped, undated rows pass.

    The dedup has no watermark: an address is remembered for good, so its state grows with the addresses seen.
    """
    rows = stream
    if since:
        rows = rows.where(~is_stale(F.col("published_at"), F.lit(since).cast("timestamp") - F.expr(f"INTERVAL {lateness}")))
    return classify(rows.dropDuplicates(["url"]), catalog)


def run_available(stream: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """All input there is, in micro-batches; each batch overwrites its own partition, so a repeated one changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if then:
            then(batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(listed: DataFrame, store: Store, first: int, sources: DataFrame, catalog: Catalog, now: Column, checkpoint: str) -> StreamingQuery:
    """One run over a stream of publications that come page after page (in the shape of ``ingest``), as the batches ``first`` and on.

    What a run has to remember of each source is stored with each micro-batch: its last page, and whether it met its first stale row or a gap; later rows of an ended
    source are dropped. Windows are those before the run. A micro-batch reads what the batches before it stored and replaces its own,
    so a restart from the checkpoint repeats nothing. The first of equal addresses is the first to come.
    """
    spark = store.spark

    def step(rows: DataFrame, number: int) -> None:
        batch = first + number
        path = f"{store.root}/captured/batch={batch}"

        def keep(name: str, part: DataFrame) -> DataFrame:
            part.write.mode("overwrite").parquet(f"{path}/{name}")
            return spark.read.schema(part.schema).parquet(f"{path}/{name}")

        told = store.with_batch("progress", batch).where(F.col("batch") >= first)
        before = told.groupBy("source_key").agg(F.max("last_page").alias("last_page"), F.max("ended").alias("ended"))
        live = keep("listed", rows.join(before.where("ended"), "source_key", "left_anti"))
        taken = contiguous_pages(live, after=before)
        since = window_start(sources, store.state(first), now).select("source_key", "since")
        reached = taken.join(since, "source_key").groupBy("source_key").agg(F.max("page").alias("last_page"), F.max(is_stale(F.col("published_at"), F.col("since"))).alias("stale"))
        gaps = live.groupBy("source_key").agg(F.max("page").alias("seen_page"))
        progress = gaps.join(reached, "source_key", "left").select("source_key", "last_page", (F.coalesce("stale", F.lit(False)) | (F.col("seen_page") > F.coalesce("last_page", F.lit(0)))).alias("ended"))
        domains = spark.createDataFrame([(d,) for d in catalog.domains()], "domain string")
        made = ingest(live, sources, store.state(first), seen_with(store, live, "url", batch), domains, catalog, now, keep, before)
        store.save_run(batch, made | {"seen_filters": bloom_rows(made["seen"], "doc_url", made["seen"].count()), "progress": progress})

    return listed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_stream(requests: DataFrame) -> DataFrame:
    """signal_id, to_status, at, reason (in order per signal) to the accepted and refused requests with the status before each.

    As in ``lifecycle.fold``, a rejection needs a reason. A batch's requests of one signal come in parts, in order of time within the batch.
    """
    allowed = frozenset(TRANSITIONS)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else "new"
        rows = pd.concat(list(frames)).sort_values(["at", "to_status"])
        out = []
        for to, at, reason in zip(rows["to_status"], rows["at"], rows["reason"], strict=True):
            ok = (status, to) in allowed and (to != REASONED or bool(reason))
            out.append((key[0], status, to, at, reason, ok))
            status = to if ok else status
        state.update((status,))
        yield pd.DataFrame(out, columns=["signal_id", "from_status", "to_status", "at", "reason", "accepted"])

    return requests.groupBy("signal_id").applyInPandasWithState(step, "signal_id long, from_status string, to_status string, at timestamp, reason string, accepted boolean", "status string", "append", "NoTimeout")


class Overdue(StatefulProcessor):
    """For each signal its latest status, and a timer at which it has been in progress for too long."""

    def __init__(self, wait: dt.timedelta):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "status string, at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.latest.get() if self.latest.exists() else None
        newest = before
        for part in rows:
            row = part.sort_values(["at", "status"]).iloc[-1]
            if newest is None or (row["at"], row["status"]) >= (pd.Timestamp(newest[1]), newest[0]):
                newest = (row["status"], row["at"].to_pydatetime())
        if newest != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.latest.update(newest)
            if newest[0] == "in_progress":
                self.handle.registerTimer(_millis(newest[1] + self.wait))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, at = self.latest.get()
        if status == "in_progress":
            yield pd.DataFrame({"signal_id": [key[0]], "since": [pd.Timestamp(at)]})

    def close(self) -> None:
        pass


def _millis(moment: dt.datetime) -> int:
    return int((moment.replace(tzinfo=dt.timezone.utc) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(milliseconds=1))


def reminders(changes: DataFrame, wait: dt.timedelta = dt.timedelta(days=3), lateness: str = "0 seconds") -> DataFrame:
    """signal_id, since: one reminder for each stay in progress that lasts longer than ``wait`` by the stream's own time, from status changes (signal_id, status, at).

    Timers fire when the watermark passes them, so the result depends on the rows alone, not on when the job runs. State is one row for each signal; it
    needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    timed = changes.withWatermark("at", lateness)
    return timed.groupBy("signal_id").transformWithStateInPandas(Overdue(wait), "signal_id long, since timestamp", "append", "EventTime")
