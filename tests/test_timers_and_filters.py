"""Timers on streams, filters of seen addresses, readers as table functions, the delivering sink."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_pipeline_parts import GOOD, LISTED, RU
from tidewatch.operators import ingest, seen
from tidewatch.operators.store import Store
from tidewatch.sources import hooks, outbox
from tidewatch.streaming import jobs

NOW = dt.datetime(2026, 8, 20, 6, 0)


def test_reminders_come_once_for_each_long_stay(spark, tmp_path):
    day = lambda d: NOW + dt.timedelta(days=d)
    batches = [
        [(1, "in_progress", day(0)), (2, "in_progress", day(0)), (3, "postponed", day(0)), (5, "in_progress", day(0.5)), (5, "rejected", day(0.75))],
        [(2, "sent_to_agent", day(2)), (4, "in_progress", day(2.5))],
        [(9, "new", day(4))],  # time passes: 1 is overdue, 2 and 5 moved on
        [(1, "postponed", day(4.5)), (1, "in_progress", day(5)), (9, "new", day(5))],
        [(9, "new", day(9))],  # 4 is, and 1 again
    ]
    schema = "signal_id long, status string, at timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(len(batches)):  # each run goes on from the checkpoint of the one before
            spark.read.parquet(f"{tmp_path}/in/{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/stream")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/stream")
            jobs.reminders(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.unset(provider)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == [(1, day(0)), (1, day(5)), (4, day(2.5))]


def test_filters_spare_batches_and_never_miss(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert seen.unseen(store, spark.createDataFrame([("a",)], "doc_url string"), "doc_url").count() == 1
    for batch in range(1, 6):
        rows = spark.createDataFrame([(f"u{batch}/{k}",) for k in range(3000 * batch)], "doc_url string")
        filters = {"seen_filters": seen.bloom_rows(rows, "doc_url", rows.count())} if batch != 5 else {}
        store.write(batch, {"documents_seen": rows, **filters})
    asked = spark.createDataFrame([(f"u2/{k}",) for k in range(0, 6000, 7)] + [(f"new/{k}",) for k in range(50)] + [("u5/1",), (None,)], "doc_url string")
    assert 2 in seen.needed(store, asked, "doc_url") and 5 in seen.needed(store, asked, "doc_url")
    assert seen.needed(store, asked.where("doc_url LIKE 'u2/%'"), "doc_url") == [2, 5]  # the others' filters say no; 5 has none
    assert {r.doc_url for r in seen.unseen(store, asked, "doc_url").collect()} == {None, *(f"new/{k}" for k in range(50))}
    assert {r.doc_url for r in seen.unseen(store, asked, "doc_url", before=2).collect()} == {r.doc_url for r in asked.collect()}
    rate = spark.createDataFrame([(f"x{k}",) for k in range(4000)], "doc_url string")
    wrong = seen._hits(rate.withColumnRenamed("doc_url", "key"), [seen.bits_for(3000)], store.with_batch("seen_filters").where("batch = 1"), ["batch"]).count()
    assert wrong < 5  # false hits are rare


def test_readers_are_table_functions(spark):
    def read(text):
        if text == "bad":
            raise RuntimeError("no")
        return [(w, len(w)) for w in text.split()]

    pages = spark.createDataFrame([(1, "a bcd"), (2, "bad"), (3, None), (4, "")], "page_id long, html string")
    hooks.register_reader(spark, "words_of", read, "word string, n int")
    got = {(r.page_id, r.ord, r.word, r.n, r.error) for r in hooks.read_with(spark, "words_of", pages).collect()}
    assert got == {(1, 0, "a", 1, None), (1, 1, "bcd", 3, None), (2, None, None, None, "RuntimeError: no")}
    named = pages.withColumn("word", F.lit(1))
    with pytest.raises(Exception, match="columns that the reader makes"):
        hooks.read_with(spark, "words_of", named).collect()


def test_the_sink_delivers_each_batch_once(spark, tmp_path):
    folder, schema = f"{tmp_path}/out", "signal_id long, npa_link string"
    rows = spark.createDataFrame([(1, "http://é"), (2, None), (3, "x")], schema).repartition(3)
    for _ in range(2):
        outbox.deliver(rows, folder, 7)
    outbox.deliver(rows.where("signal_id = 1"), folder, 8)
    read = lambda: sorted(map(tuple, outbox.delivered(spark, folder, schema).collect()), key=str)
    want = sorted([(1, "http://é"), (1, "http://é"), (2, None), (3, "x")], key=str)
    assert read() == want
    listed = {n for b in (7, 8) for n in json.loads((tmp_path / "out" / "batches" / f"{b}.json").read_text())["files"]}
    assert listed <= {p.name for p in (tmp_path / "out" / "rows").iterdir()}

    broken = rows.withColumn("npa_link", F.when(F.col("signal_id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("npa_link")))
    with pytest.raises(Exception):
        outbox.deliver(broken, folder, 9)
    assert read() == want and not (tmp_path / "out" / "batches" / "9.json").exists()


def test_a_streamed_run_equals_a_run(spark, tmp_path):
    """Pages in micro-batches, with stale rows, gaps, copies across sources, and a restart in the middle."""
    rng = random.Random(4)
    names = ["tass.ru", "ria.ru", "rg.ru", "garant.ru"]
    files, rows = [], []
    for k, name in enumerate(names):
        for page in range(1, 8):
            if (name, page) == ("rg.ru", 3):
                continue  # an empty page: what comes after it counts no more
            age = lambda: rng.choice([None, 1, 2, 3] + ([30] if name == "ria.ru" and page == 2 else []))  # noqa: E731,B023
            part = [(name, k, page, o, rng.choice([GOOD, "О погоде"]), f"https://tass.ru/{rng.randint(0, 60)}", None if (a := age()) is None else NOW - dt.timedelta(days=a), None) for o in range(6)]
            files.append(part)
            rows += part
    sources = spark.createDataFrame([(n, n != "garant.ru") for n in names], "source_key string, ok boolean")
    old = spark.createDataFrame([("https://tass.ru/1",), ("https://tass.ru/2",)], "doc_url string")
    domains = spark.createDataFrame([(d,) for d in RU.domains()], "domain string")
    stores = [Store(spark, f"{tmp_path}/{n}") for n in "ab"]
    for store in stores:
        store.write(1, {"documents_seen": old})
    whole, streamed = stores
    whole.save_run(2, ingest.ingest(spark.createDataFrame(rows, LISTED), sources, whole.state(2), old, domains, RU, F.lit(NOW)))
    half = len(files) // 2
    for part in (files[:half], files[half:]):
        for f in part:
            spark.createDataFrame(f, LISTED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(LISTED).option("maxFilesPerTrigger", 9).parquet(f"{tmp_path}/in")
        query = jobs.ingest_stream(stream, streamed, 2, sources, RU, F.lit(NOW), f"{tmp_path}/check")
        query.awaitTermination(200)
        assert query.exception() is None
    told = lambda s: {r.source_key: (r.n, r.d, r.i) for r in s.read("run_counters").groupBy("source_key").agg(F.sum("new_signals").alias("n"), F.sum("duplicates").alias("d"), F.sum("irrelevant").alias("i")).collect()}
    urls = lambda s, t, c: sorted(r[0] for r in s.read(t).select(c).collect())
    assert told(streamed) == told(whole)
    assert urls(streamed, "signals", "source_url") == urls(whole, "signals", "source_url") and urls(streamed, "documents_seen", "doc_url") == urls(whole, "documents_seen", "doc_url")
    assert {r.source_key: r.last_success_at for r in streamed.state().collect()} == {n: NOW for n in names if n != "garant.ru"}
    ended = {r.source_key for r in streamed.read("progress").where("ended").collect()}
    assert {"ria.ru", "rg.ru"} <= ended
