"""A run from the sources to the store: listing pages are fetched until each source's first stale row, then ingested.

Each round takes the next page of every source that goes on. The executors fetch and read the pages; pages and publications
are stored before they are used, so nothing is fetched twice. The driver sees one row for each source and round, and
there are at most PAGE_CAP rounds.

A source ends at a page without publications, at its first stale one, or at a page that can't be fetched or is broken.
After such a failure the publications of its pages before stay, its window does not move, and the other sources go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.catalog import Catalog
from tidewatch.operators import seen
from tidewatch.operators.ingest import PAGE_CAP, ingest, is_stale, window_start
from tidewatch.operators.store import Store
from tidewatch.sources.fetching import fetched
from tidewatch.sources.listings import Listing

#: (session, [(url, access)], proxy) to url, ok, html, error.
Fetch = Callable[..., DataFrame]

PAGES = "source_key string, source_ord int, page int, url string, ok boolean, html string, error string"
LISTED = "source_key string, source_ord int, page int, ord int, title string, url string, published_at timestamp, summary string"
_READ = LISTED + ", error string"


def address(source: Listing, page: int) -> str:
    return source.first if page == 1 else source.pages.replace("{page}", str(page))


def one_round(store: Store, folder: str, page: int, live: list[tuple[int, Listing]], fetch: Fetch, proxy: str | None) -> tuple[DataFrame, DataFrame]:
    """One page of each live source: the pages as they were met, and their publications; both stored."""
    spark = store.spark
    asked = spark.createDataFrame([(s.key, k, page, address(s, page)) for k, s in live], "source_key string, source_ord int, page int, url string")
    got = asked.join(fetch(spark, [(address(s, page), s.access) for _, s in live], proxy), "url", "left")
    broken = F.coalesce(*[F.when(F.col("source_key") == s.key, s.broken(F.col("html"))) for _, s in live], F.lit(False))
    good = F.coalesce(F.col("ok"), F.lit(False))
    met = got.select("source_key", "source_ord", "page", "url", (good & ~broken).alias("ok"), "html", F.when(good & broken, "broken page").otherwise(F.col("error")).alias("error"))
    met.write.mode("overwrite").parquet(f"{folder}/pages/round={page}")
    pages = spark.read.schema(PAGES).parquet(f"{folder}/pages/round={page}")
    rows = None
    for k, s in live:
        part = s.read(pages.where((F.col("source_key") == s.key) & F.col("ok")).select("page", "html"))
        error = F.col("error") if "error" in part.columns else F.lit(None).cast("string").alias("error")
        # a reader may number its only page itself; it is this round's
        part = part.select("source_key", F.lit(k).alias("source_ord"), F.lit(page).alias("page"), "ord", "title", "url", "published_at", "summary", error)
        rows = part if rows is None else rows.unionByName(part)
    rows.write.mode("overwrite").parquet(f"{folder}/listed/round={page}")
    return pages, spark.read.schema(_READ).parquet(f"{folder}/listed/round={page}")


def crawl(store: Store, batch: int, sources: list[Listing], now: Column, fetch: Fetch = fetched, proxy: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The publications of all pages met, in the shape that ingest takes; and source_key, ok, error of the sources."""
    spark, folder = store.spark, f"{store.root}/captured/batch={batch}"
    keys = spark.createDataFrame([(s.key,) for s in sources], "source_key string")
    since = window_start(keys, store.state(batch), now).select("source_key", "since")
    live, rounds, errors = list(enumerate(sources)), [], {}
    for page in range(1, PAGE_CAP + 1):
        if not live:
            break
        pages, rows = one_round(store, folder, page, live, fetch, proxy)
        rounds.append(page)
        # one row for each source: bounded by the registry
        errors |= {r.source_key: r.error for r in pages.where(~F.col("ok")).select("source_key", F.coalesce("error", F.lit("not fetched")).alias("error")).collect()}
        errors |= {r.source_key: f"broken page: {r.error}" for r in rows.where("error IS NOT NULL").select("source_key", "error").collect()}
        rows = rows.where("error IS NULL")
        told = rows.join(since, "source_key").groupBy("source_key").agg(F.max(is_stale(F.col("published_at"), F.col("since"))).alias("stale"))
        on = {r.source_key for r in told.where(~F.col("stale")).collect()}
        live = [(k, s) for k, s in live if s.pages and s.key in on and s.key not in errors]
    listed = spark.read.schema(_READ).parquet(*[f"{folder}/listed/round={p}" for p in rounds]) if rounds else spark.createDataFrame([], _READ)
    listed = listed.where("error IS NULL").drop("error")
    met = spark.createDataFrame([(s.key, s.key not in errors, errors.get(s.key)) for s in sources], "source_key string, ok boolean, error string")
    return listed, met


def run(store: Store, batch: int, sources: list[Listing], catalog: Catalog, now: Column, fetch: Fetch = fetched, proxy: str | None = None) -> None:
    """One run over sources as one batch: crawled, ingested, saved with one commit. ``now`` is one moment, not a clock.

    The same address in several sources belongs to the first of them. A run that is repeated replaces its batch.
    """
    spark = store.spark
    listed, met = crawl(store, batch, sources, now, fetch, proxy)
    domains = spark.createDataFrame([(d,) for d in catalog.domains()], "domain string")

    def keep(name: str, rows: DataFrame) -> DataFrame:
        path = f"{store.root}/captured/batch={batch}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    # of what was ever seen, only the batches that may hold a listed address are read
    known = seen.seen_with(store, listed, "url", batch)
    made = ingest(listed, met, store.state(batch), known, domains, catalog, now, keep)
    store.save_run(batch, made | {"seen_filters": seen.bloom_rows(made["seen"], "doc_url", made["seen"].count())})


def run_each(store: Store, batch: int, sources: list[Listing], catalog: Catalog, now: Column, fetch: Fetch = fetched, proxy: str | None = None) -> None:
    """The same with a commit after each source, in batches from ``batch`` on: what is committed stays if the run ends early."""
    for k, source in enumerate(sources):
        run(store, batch + k, [source], catalog, now, fetch, proxy)
