"""Versions of stored rows, requests judged in parts, experts' actions that are there the next day, the keyword index."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tidewatch import catalog
from tidewatch.functions import dates, textmatch
from tidewatch.operators import actions, classify, lifecycle
from tidewatch.operators.store import Store

NOW = dt.datetime(2026, 8, 20, 6, 0)
SIGNALS = "id long, status string, measure_id string, npa_link string, created_at timestamp, updated_at timestamp"


def signals(spark, *rows):
    return spark.createDataFrame([(i, status, "m", None, NOW, NOW) for i, status in rows], SIGNALS)


def statuses(store, before=None):
    return {r.id: r.status for r in store.read("signals", before).collect()}


def test_the_latest_committed_version_counts(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("signals").count() == 0
    store.write(1, {"signals": signals(spark, *[(k, "new") for k in range(40)])})
    store.write(2, {"signals": signals(spark, (3, "in_progress"), (50, "new"))})
    store.write(4, {"signals": signals(spark, (3, "postponed"), (7, "rejected"))})
    want = {k: "new" for k in range(40)} | {3: "postponed", 7: "rejected", 50: "new"}
    assert statuses(store) == want and statuses(store, 4) == want | {3: "in_progress", 7: "new"}
    store.compact("signals", 2)
    assert statuses(store) == want and statuses(store, 3) == want | {3: "in_progress", 7: "new"} and statuses(store, 2) == {k: "new" for k in range(40)}
    store.write(5, {"signals": signals(spark, (8, "completed"))})
    (tmp_path / "commits" / "batch=5").rename(tmp_path / "gone")  # a batch without its commit is no batch
    assert statuses(store) == want
    store.compact("signals", 4)
    assert statuses(store) == want and len(store.batches("signals.base")) == 2
    store.write(4, {"signals": signals(spark, (9, "rejected"))})  # a base that holds the batch as it was counts no more
    assert store.batches("signals.base") == [2]
    assert statuses(store) == {k: "new" for k in range(40)} | {3: "in_progress", 50: "new", 9: "rejected"}


def test_look_ups_open_the_files_of_their_range(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write(1, {"signals": spark.range(0, 4000, 1, 1).select("id", F.lit("new").alias("status"))})
    store.compact("signals", 1)
    found = store.find("signals", [17, 3999, -1])
    assert sorted(r.id for r in found.collect()) == [17, 3999] and store.find("signals", []).count() == 0
    base = spark.read.parquet(store.path("signals.base", 1))
    span = base.groupBy(F.input_file_name().alias("f")).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("id").alias("n")).collect()
    assert len(span) > 1 and sum(x.a <= 17 <= x.b for x in span) == 1  # the files' ranges don't overlap
    plan = found._jdf.queryExecution().executedPlan()
    rows = [m.value() for m in [_scan(plan).metrics().apply("numOutputRows")]][0]
    assert rows < 4000  # row groups of other ranges were skipped


def _scan(plan):
    while plan.children().size():
        plan = plan.children().apply(0)
    return _scan(plan.executedPlan()) if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan


def loop(rows):
    """The verdicts of requests (key, at, to, able, start) one after the other."""
    state, out = {}, {}
    for key, at, to, able, start in sorted(rows):
        before = state.setdefault(key, start)
        ok = able and (before, to) in catalog.TRANSITIONS
        out[key, at] = (before, ok)
        state[key] = to if ok else before
    return out


def test_one_hot_key_is_judged_over_many_parts(spark):
    rng = random.Random(6)
    start = {k: rng.choice(catalog.STATUSES) for k in range(9)}
    keys = [0] * 1500 + [rng.randrange(1, 9) for _ in range(500)]
    rng.shuffle(keys)
    rows = [(k, n, rng.choice(catalog.STATUSES), rng.random() < 0.9, start[k]) for n, k in enumerate(keys)]
    d = spark.createDataFrame(rows, "key int, at int, to_status string, able boolean, start string").repartition(5)
    judged = lifecycle.judge(d, ["key"], ["at"], start=F.col("start"), able=F.col("able"))
    assert judged.columns == [*d.columns, "from_status", "accepted"]
    got = {(r.key, r.at): (r.from_status, r.accepted) for r in judged.collect()}
    assert got == loop(rows)
    assert lifecycle.judge(d.where("false"), ["key"], ["at"]).count() == 0


def test_judged_requests_are_computed_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(len(b))
            yield b

    d = spark.range(300).selectExpr("id % 7 AS key", "id AS at", "'in_progress' AS to_status").repartition(3)
    judged = lifecycle.judge(d.mapInPandas(seen, d.schema), ["key"], ["at"])
    assert judged.where("accepted").count() == 7 and made.value == 300


def test_links_are_checked_once_each(spark):
    said = spark.createDataFrame([(0, 1, NOW, 1, "in_progress", None)], "request_id long, user_id long, at timestamp, signal_id long, to_status string, error string")
    texts = ["skip", " http://w.a.ru/1 ", "http://w.a.ru/1", "http://w.a.ru/2", "http://b.ru/1", "ftp://a.ru/1", None, ""]
    sent = spark.createDataFrame([(k, 1, NOW, 1, texts[k % 8]) for k in range(1, 65)], "request_id long, user_id long, at timestamp, signal_id long, text string")
    pages = spark.createDataFrame([("http://w.a.ru/1", True), ("http://w.a.ru/1", True), ("http://w.a.ru/2", False), ("http://b.ru/1", True)], "url string, ok boolean")
    made = actions.with_links(said, sent, pages, spark.createDataFrame([("a.ru",), ("w.a.ru",)], "domain string"))
    want = [None, None, None, "unreachable", "domain", "link", "link", "link"]
    assert {r.request_id: r.error for r in made.collect()} == {0: None} | {k: want[k % 8] for k in range(1, 65)}


def test_folds_in_parts_equal_folds_of_arrays(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), n, rng.choice(catalog.STATUSES), rng.choice([None, "", "duplicate"])) for n in range(400)]
    d = spark.createDataFrame(rows, "signal_id int, k int, to_status string, why string")
    plain = lambda x: {r.signal_id: (r.status, r.reason, r.accepted, r.refused, [tuple(m) for m in r.log]) for r in x.collect()}
    want = plain(lifecycle.fold(d, ["signal_id"], ["k"], reason="why"))
    monkeypatch.setattr(lifecycle, "HEAVY", 50)
    assert lifecycle.heavy(d, ["signal_id"]) and plain(lifecycle.fold(d, ["signal_id"], ["k"], reason="why")) == want


def test_actions_are_stored_and_repeatable(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write(1, {"signals": signals(spark, (1, "new"), (2, "new"), (3, "sent_to_agent"))})
    moment = lambda k: NOW + dt.timedelta(seconds=k)
    pages, domains = spark.createDataFrame([("http://w.a.ru/y", True)], "url string, ok boolean"), spark.createDataFrame([("a.ru",)], "domain string")

    def act(batch, said, sent=()):
        actions.run(
            store, batch, spark.createDataFrame([(*x[:2], moment(x[0]), *x[2:]) for x in said], "request_id long, user_id long, at timestamp, data string, comment string"),
            spark.createDataFrame([(*x[:2], moment(x[0]), *x[2:]) for x in sent], "request_id long, user_id long, at timestamp, signal_id long, text string"), pages, domains, [5],
        )

    act(2, [(1, 5, "sig:1:work", None), (2, 5, "rej:2:r_dup", " see 7 "), (3, 6, "/complete 3", None), (4, 5, "sig:9:work", None), (5, 5, "hello", None)])
    act(3, [(6, 5, "/complete 3", None), (8, 5, "/reopen 2", "no comment")], [(7, 5, 1, "http://w.a.ru/y")])
    read = lambda: ({r.id: (r.status, r.npa_link, r.rejection_reason, r.rejection_comment, r.updated_at) for r in store.read("signals").collect()}, sorted((r.id, r.from_status, r.to_status) for r in store.read("status_history").collect()), sorted(map(tuple, store.read("outbox").collect())), {r.request_id: r.error for r in store.read("verdicts").collect()})
    first = read()
    assert first[0] == {1: ("sent_to_agent", "http://w.a.ru/y", None, None, moment(7)), 2: ("new", None, None, None, moment(8)), 3: ("completed", None, None, None, moment(6))}
    assert first[1] == [(1, "new", "in_progress"), (2, "new", "rejected"), (6, "sent_to_agent", "completed"), (7, "in_progress", "sent_to_agent"), (8, "rejected", "new")]
    assert first[2] == [(1, "m", "http://w.a.ru/y")] and first[3] == {1: None, 2: None, 3: "access", 4: "missing", 5: "format", 6: None, 7: None, 8: None}
    assert {r.id: (r.status, r.rejection_reason, r.rejection_comment) for r in store.read("signals", 3).collect()}[2] == ("rejected", "duplicate", "see 7")
    store.compact("signals", 2)
    act(3, [(6, 5, "/complete 3", None), (8, 5, "/reopen 2", "no comment")], [(7, 5, 1, "http://w.a.ru/y")])
    assert read() == first


KEYWORDS = [("a", "ветеран боевых действий"), ("a", "сво"), ("b", "доброволец"), ("b", "Указ"), ("c", "ветеран-афганец"), ("c", "новый"), ("c", "закон о выплатах"), ("d", "the"), ("d", "inval")]


def test_the_keyword_index_equals_the_patterns(spark, monkeypatch):
    rng = random.Random(9)
    pool = "ветеранам ветеран боевых действий действия сво своих доброволец добровольцы указан указ ветеран-афганцам афганец ветеран - новая новых закон законы о выплатах выплата the then inval инвалид _указ 2указ".split()
    texts = [rng.choice(["", " "]) + "".join(rng.choice(pool) + rng.choice([" ", "  ", " ", "\n", ", ", "-", "."]) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    words = spark.createDataFrame(KEYWORDS, "grp string, keyword string")
    pattern = lambda k: textmatch.keyword_pattern(k).replace(r"[^\p{L}\p{N}_]", r"[^\w]").replace(r"[\p{L}\p{N}_]*", r"\w*").replace(r"[\s\p{Z}]+", r"\s+")
    want = {(i, g, k) for i, t in enumerate(texts) if t for g, k in KEYWORDS if re.search(pattern(k), t.lower())}
    assert {tuple(r) for r in textmatch.keyword_hits(d, words, "id").collect()} == want and len(want) > 300
    monkeypatch.setattr(textmatch, "FEW_WORDS", 0)  # the other join
    assert {tuple(r) for r in textmatch.keyword_hits(d, words, "id").collect()} == want
    counts = {(g, k): sum((g, k) == x[1:] for x in want) for g, k in KEYWORDS}
    assert {(r.grp, r.keyword): r.n for r in classify.keyword_counts(d, words, "id").collect()} == counts


def test_parts_of_the_keyword_index_follow_the_scan(spark):
    words = spark.createDataFrame([("g", "рубли"), ("g", "новый закон")], "grp string, keyword string")
    rows = spark.createDataFrame([(k, "новым законом 5 рублей" if k % 2 else "закон новый") for k in range(60)], "doc_id long, text string").repartition(20)
    hits = textmatch.keyword_hits(rows, words, "doc_id")
    assert hits.rdd.getNumPartitions() == 20 * textmatch.PARTS_A_SCAN
    assert sorted((r.doc_id, r.keyword) for r in hits.collect()) == sorted((k, w) for k in range(1, 60, 2) for w in ("рубли", "новый закон"))


def test_tables_of_keywords_need_no_nested_loop(spark, monkeypatch):
    d = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "id long, text string")
    words = spark.createDataFrame([("g", "alpha"), ("g", "beta"), ("g", "gamma")], "grp string, keyword string")
    for folded in (256, 2):
        monkeypatch.setattr(classify, "FOLDED", folded)
        got = classify.keyword_counts(d, words, "id")
        assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
        assert {r.keyword: r.n for r in got.collect()} == {"alpha": 1, "beta": 2, "gamma": 0}
    assert classify.keyword_counts(d, words.where("false"), "id").count() == 0


def test_rare_forms_of_dates(spark):
    isos = {"20260820T100000": "2026-08-20 07:00:00", "2026-08-20T10:00:00.1234567Z": "2026-08-20 10:00:00.123456", "2026-W34-4": "2026-08-19 21:00:00", "2026W344T10": "2026-08-20 07:00:00", "2026-W34": "2026-08-16 21:00:00", "2026-W54-1": None, "2026-W34-8": None, "2021-W53-1": None, "20260230": None, "2026-08-20T": None, None: None}
    feeds = {"Thu, 20 Aug 2026 10:00:00 EST": "2026-08-20 15:00:00", "20 Aug 26 10:00 +0300": "2026-08-20 07:00:00", "2026-08-20T10:00:00Z": "2026-08-20 10:00:00", "Thu, 20 Aug 2026": "2026-08-20 00:00:00", "1 Sep 95 1:02:03 pdt": "1995-09-01 08:02:03", "20 Foo 2026 10:00:00 GMT": None, "20 Aug 2026 25:00 GMT": None, "20 Aug 2026 10:00 XYZ": None, "x": None, "": None, None: None}
    for forms, read in ((isos, dates.iso_moscow), (feeds, dates.feed_date)):
        d = spark.createDataFrame([(k, s) for k, s in enumerate(forms)], "k int, s string")
        got = [r.t for r in d.select("k", read(F.col("s")).cast("string").alias("t")).orderBy("k").collect()]
        assert dict(zip(forms, got, strict=True)) == forms
