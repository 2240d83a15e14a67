"""Ingest as set operations: prefix stop, first wins, seen documents, watermarks, counters, state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.catalog import Catalog
from tidewatch.functions.urls import allowed
from tidewatch.operators.classify import classify

FIRST_WINDOW = "INTERVAL 7 DAYS"
PAGE_CAP = 5


def is_stale(published_at: Column, since: Column) -> Column:
    """Strictly before the window; a row without a date never is."""
    return F.coalesce(published_at < since, F.lit(False))


def prefix_stop(rows: DataFrame, key: list[str], order: list, stale: Column) -> DataFrame:
    """Rows of each source before its first stale one; the first stale row ends the source."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("stopped__", F.max(stale.cast("int")).over(w)).where("stopped__ = 0").drop("stopped__")


def prefix_stop_by_bound(rows: DataFrame, key: str, order: Column, stale: Column) -> DataFrame:
    """The same for a unique order value: each source's first stale place by a partial aggregation, then a join.

    Nothing is sorted, and a hot source is not one task.
    """
    bound = rows.where(stale).groupBy(key).agg(F.min(order).alias("bound__"))
    return rows.join(bound, key, "left").where(F.col("bound__").isNull() | (order < F.col("bound__"))).drop("bound__")


def contiguous_pages(rows: DataFrame, cap: int = PAGE_CAP, after: DataFrame | None = None) -> DataFrame:
    """Pages 1 .. cap without a gap: an empty page ends the listing. after (source_key, last_page): pages that were taken before."""
    w = Window.partitionBy("source_key").orderBy("page")
    pages = rows.where(F.col("page").between(1, cap)).select("source_key", "page").distinct()
    pages = pages.withColumn("last_page", F.lit(0)) if after is None else pages.join(after.select("source_key", "last_page"), "source_key", "left").withColumn("last_page", F.coalesce("last_page", F.lit(0)))
    ranked = pages.where("page > last_page").withColumn("rank__", F.row_number().over(w))
    return rows.join(ranked.where("rank__ + last_page = page").select("source_key", "page"), ["source_key", "page"], "left_semi")


def first_wins(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row per key, the first by a unique order; an aggregation with partial results, no window."""
    picked = rows.groupBy(*key).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns if c not in key]), order).alias("row__"))
    return picked.select(*[F.col(c) if c in key else F.col(f"row__.{c}").alias(c) for c in rows.columns])


def unseen(rows: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(seen.select(*key), key, "left_anti")


def window_start(sources: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """sources with ``since``: the last success, however old, or a week ago."""
    return sources.join(state.select("source_key", "last_success_at"), "source_key", "left").withColumn("since", F.coalesce("last_success_at", now - F.expr(FIRST_WINDOW)))


def merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by source_key: the success time is replaced, the date only by a known one."""
    return old.alias("o").join(new.alias("n"), "source_key", "full").select(
        "source_key",
        F.coalesce("n.last_success_at", "o.last_success_at").alias("last_success_at"),
        F.coalesce("n.last_seen_publication_date", "o.last_seen_publication_date").alias("last_seen_publication_date"),
    )


def ingest(listed: DataFrame, sources: DataFrame, state: DataFrame, seen: DataFrame, domains: DataFrame, catalog: Catalog, now: Column, keep: Callable[[str, DataFrame], DataFrame] = lambda name, rows: rows, after: DataFrame | None = None) -> dict[str, DataFrame]:
    """One run over listed publications (source_key, source_ord, page, ord, title, url, published_at, summary).

    sources: source_key, ok (whether the listing could be read), and error if there is one. Returns signals, seen (new), counters and state.
    keep(name, rows) may store the two results that all of these are made of. after: as in ``contiguous_pages``, for listings that come in parts.
    """
    known = window_start(sources, state, now)
    rows = contiguous_pages(listed, after=after).join(known.select("source_key", "since", "ok"), "source_key")
    place = F.struct("page", "ord")
    live = prefix_stop_by_bound(rows, "source_key", place, is_stale(F.col("published_at"), F.col("since")))
    good = keep("allowed", allowed(live, domains).drop("host", "since", "ok"))
    order = F.struct("source_ord", "page", "ord")
    first = first_wins(good, ["url"], order)
    fresh = unseen(first, seen.withColumnRenamed("doc_url", "url"), ["url"])
    marked = keep("marked", classify(fresh, catalog))
    signals = marked.where("is_relevant").select("source_key", "title", F.col("url").alias("source_url"), "categories", "event_type", "region", "priority", F.lit("new").alias("status"), now.alias("created_at"))
    new_seen = marked.select("source_key", F.col("url").alias("doc_url"), now.alias("first_seen_at"))
    by_source = good.groupBy("source_key").agg(F.count(F.lit(1)).alias("rows"))
    told = marked.groupBy("source_key").agg(F.count_if("is_relevant").alias("new_signals"), F.count_if(~F.col("is_relevant")).alias("irrelevant"))
    counters = (
        sources.join(by_source, "source_key", "left")
        .join(told, "source_key", "left")
        .select("source_key", "ok", *[c for c in sources.columns if c == "error"], *[F.when(F.col("ok"), F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(n) for n, c in (("new_signals", F.col("new_signals")), ("duplicates", F.col("rows") - F.coalesce("new_signals", F.lit(0)) - F.coalesce("irrelevant", F.lit(0))), ("irrelevant", F.col("irrelevant")))])
    )
    new_state = sources.where("ok").select("source_key", now.alias("last_success_at"), F.lit(None).cast("date").alias("last_seen_publication_date"))
    return {"signals": signals, "seen": new_seen, "counters": counters, "state": merge_state(state, new_state)}
