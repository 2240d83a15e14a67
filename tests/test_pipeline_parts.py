import datetime as dt
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch import catalog
from tidewatch.operators import ingest, lifecycle
from tidewatch.sources import listings
from tidewatch.streaming import jobs

NOW = dt.datetime(2026, 8, 20, 6, 0)
RU = catalog.RUSSIAN


def test_prefix_stop_equals_the_loop(spark):
    rng = random.Random(1)
    rows = [(f"s{s}", k, rng.choice([None, rng.randint(0, 9)])) for s in range(30) for k in range(rng.randint(1, 40))]
    want = set()
    for s in {r[0] for r in rows}:
        for r in sorted(r for r in rows if r[0] == s):
            if r[2] is not None and r[2] < 2:
                break
            want.add(r[:2])
    d = spark.createDataFrame(rows, "source_key string, ord int, value int")
    stale = ingest.is_stale(F.col("value"), F.lit(2))
    assert {(r.source_key, r.ord) for r in ingest.prefix_stop(d, ["source_key"], ["ord"], stale).collect()} == want
    assert {(r.source_key, r.ord) for r in ingest.prefix_stop_by_bound(d, "source_key", F.col("ord"), stale).collect()} == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(catalog.STATUSES), st.sampled_from([None, "", "duplicate"])), max_size=40))
def test_fold_equals_the_loop(spark, asked):
    want = {}
    for who, to, why in asked:
        status, reason, ok, bad = want.get(who, ("new", None, 0, 0))
        if (status, to) in catalog.TRANSITIONS and (to != "rejected" or why):
            reason = why if to == "rejected" else None if to == "new" else reason
            want[who] = (to, reason, ok + 1, bad)
        else:
            want[who] = (status, reason, ok, bad + 1)
    d = spark.createDataFrame([(w, k, t, r) for k, (w, t, r) in enumerate(asked)], "signal_id int, k int, to_status string, why string")
    got = {r.signal_id: (r.status, r.reason, r.accepted, r.refused) for r in lifecycle.fold(d, ["signal_id"], ["k"], reason="why").collect()}
    assert got == want


def test_reopening_clears_the_reason(spark):
    asked = [(1, 1, "rejected", "duplicate"), (1, 2, "new", None), (2, 1, "rejected", "not_npa")]
    d = spark.createDataFrame(asked, "signal_id int, k int, to_status string, why string")
    got = {r.signal_id: (r.status, r.reason, [tuple(x) for x in r.log]) for r in lifecycle.fold(d, ["signal_id"], ["k"], reason="why").collect()}
    assert got == {1: ("new", None, [("new", "rejected"), ("rejected", "new")]), 2: ("rejected", "not_npa", [("new", "rejected")])}


LISTED = "source_key string, source_ord int, page int, ord int, title string, url string, published_at timestamp, summary string"


def run(spark, listed, sources=None, state=(), seen=()):
    keys = sorted({r[0] for r in listed})
    return ingest.ingest(
        spark.createDataFrame(listed, LISTED),
        spark.createDataFrame(sources or [(k, True) for k in keys], "source_key string, ok boolean"),
        spark.createDataFrame(list(state), "source_key string, last_success_at timestamp, last_seen_publication_date date"),
        spark.createDataFrame([(u,) for u in seen], "doc_url string"),
        spark.createDataFrame([(d,) for d in RU.domains()], "domain string"),
        RU,
        F.lit(NOW),
    )


def item(source, page, ord, title, url, days=0, summary=None):
    return (source, 0, page, ord, title, url, NOW - dt.timedelta(days=days) if days is not None else None, summary)


GOOD = "Закон о выплатах инвалидам"


def test_ingest(spark):
    a, b = "sfr.gov.ru/press_center/news", "tass.ru"
    listed = [
        item(a, 1, 0, GOOD, "https://sfr.gov.ru/1"),
        item(a, 1, 1, "О погоде", "https://sfr.gov.ru/2", None),
        item(a, 1, 2, GOOD, "https://sfr.gov.ru/1"),
        item(a, 1, 3, GOOD, "https://other.com/1"),
        item(a, 2, 0, GOOD, "https://sfr.gov.ru/old", 30),
        item(a, 2, 1, GOOD, "https://sfr.gov.ru/after", 0),
        item(a, 4, 0, GOOD, "https://sfr.gov.ru/gap", 0),
        item(b, 1, 0, GOOD, "https://tass.ru/1"),
        item(b, 1, 1, GOOD, "https://tass.ru/seen"),
    ]
    got = run(spark, listed, [(a, True), (b, True), ("ria.ru", False)], [("ria.ru", NOW - dt.timedelta(days=3), None)], ["https://tass.ru/seen"])
    assert {r.source_url for r in got["signals"].collect()} == {"https://sfr.gov.ru/1", "https://tass.ru/1"}
    assert {r.doc_url for r in got["seen"].collect()} == {"https://sfr.gov.ru/1", "https://sfr.gov.ru/2", "https://tass.ru/1"}
    counters = {r.source_key: (r.new_signals, r.duplicates, r.irrelevant, r.ok) for r in got["counters"].collect()}
    assert counters == {a: (1, 1, 1, True), b: (1, 1, 0, True), "ria.ru": (0, 0, 0, False)}
    state = {r.source_key: r.last_success_at for r in got["state"].collect()}
    assert state == {a: NOW, b: NOW, "ria.ru": NOW - dt.timedelta(days=3)}


def test_window_follows_the_last_success(spark):
    a = "tass.ru"
    rows = [item(a, 1, 0, GOOD, "https://tass.ru/1", 10)]
    assert run(spark, rows)["signals"].count() == 0
    assert run(spark, rows, state=[(a, NOW - dt.timedelta(days=20), None)])["signals"].count() == 1


def one(spark, key, html):
    return listings.read_listing(spark.createDataFrame([(1, html), (2, None)], "page int, html string"), listings.SITES[key]).orderBy("ord").collect()


def test_listings(spark):
    got = one(spark, "sfr.gov.ru/press_center/news", '<article class="re-news__article x"><a class="re-news__article-link" href="/n/1">z</a><h3 class="re-news__article-title"> Т&amp;а </h3><time class="re-news__article-time" datetime="2026-08-20T10:00:00+03:00">x</time><p class="re-news__article-description"> s </p></article><article class="re-news__article"><h3 class="re-news__article-title">no link</h3></article>')
    assert [(r.title, r.url, r.summary, r.published_at) for r in got] == [("Т&а", "https://sfr.gov.ru/n/1", "s", dt.datetime(2026, 8, 20, 7))]
    got = one(spark, "mintrud.gov.ru/docs", '<div class="post-list"><p class="page-date">24 июля 2026</p><a class="text-black" href="/docs/9"><p class="post-name">A</p><p class="post-name">B</p></a></div>')
    assert [(r.title, r.url, r.published_at) for r in got] == [("A", "https://mintrud.gov.ru/docs/9", dt.datetime(2026, 7, 24))]
    got = one(spark, "msupport.dszn.ru/news", '<a href="https://dszn.ru/press-center/news/5"><p><b>T</b></p><span class="date">1 Августа 2026 года</span></a>')
    assert [(r.title, r.url, r.published_at) for r in got] == [("T", "https://dszn.ru/press-center/news/5", dt.datetime(2026, 8, 1))]
    got = one(spark, "publication.pravo.gov.ru", '<div class="documents-table-row"><a class="documents-item-name" href="/d/1">Указ<br>о чём</a><div class="infoindocumentlist"><div><span class="info-name">Номер</span><span class="info-data">1</span></div><div><span class="info-name">Дата опубликования</span><span class="info-data">20.08.2026</span></div></div></div>')
    assert [(r.title, r.url, r.published_at) for r in got] == [("Указ о чём", "http://publication.pravo.gov.ru/d/1", dt.datetime(2026, 8, 19, 21))]
    got = one(spark, "kremlin.ru/acts/news", '<div itemtype="http://schema.org/NewsArticle"><a itemprop="url" href="/acts/1"><span itemprop="name">K</span></a><time itemprop="datePublished" datetime="2026-08-20"></time></div>')
    assert [(r.title, r.url, r.published_at) for r in got] == [("K", "http://www.kremlin.ru/acts/1", dt.datetime(2026, 8, 19, 21))]
    got = one(spark, "government.ru/docs", '<div class="headline"><a class="headline__link" href="/docs/1/"><span class="headline_title_link">G</span></a><span class="headline_date"><time datetime="2026-08-20T12:00:00+04:00"></time></span><span class="headline_lead">lead</span></div>')
    assert [(r.title, r.url, r.summary, r.published_at) for r in got] == [("G", "http://government.ru/docs/1/", "lead", dt.datetime(2026, 8, 20, 8))]


def test_register_and_feeds(spark):
    page = '<script type="text/x"></script><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"initialState":{"documentsList":{"data":[{"id":7,"title":" A ","date_published":"2026-08-20 10:00:00"},{"id":8,"title":"B","date_published":null},{"id":null,"title":"C"},{"id":9,"title":"  "}]}}}}}</script>'
    rows = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, '<script id="__NEXT_DATA__">{"props":{}}</script>')], "page int, html string")
    got = listings.read_register(rows).orderBy("ord").collect()
    assert [(r.title, r.url, r.published_at) for r in got] == [("A", listings.REGISTER_URL + "doc/7/", dt.datetime(2026, 8, 20, 7)), ("B", listings.REGISTER_URL + "doc/8/", None)]
    feed = "<rss><channel><item><title>T</title><link>http://x</link><pubDate>Thu, 20 Aug 2026 10:00:00 +0300</pubDate><description></description></item><item><title>U</title></item></channel></rss>"
    pages = spark.createDataFrame([("tass.ru", True, feed), ("ria.ru", False, None)], "domain string, ok boolean, xml string")
    got = listings.read_all_feeds(pages).collect()
    assert [(r.source_key, r.title, r.published_at, r.summary) for r in got] == [("tass.ru", "T", dt.datetime(2026, 8, 20, 7), None)]
    assert [bool(x.pages) for x in listings.registry()] == [True] * 7 + [False] * 5


def test_streams_equal_batches(spark, tmp_path):
    rows = [(GOOD if k % 2 else "О погоде", None, "tass.ru", f"https://tass.ru/{k % 9}", NOW) for k in range(20)]
    schema = "title string, summary string, source_key string, url string, published_at timestamp"
    for part in range(2):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.run_available(jobs.new_publications(stream, RU, "2026-08-19"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.url for r in got.collect()) == sorted({r[3] for r in rows})


def test_status_stream_equals_the_fold(spark, tmp_path):
    rng = random.Random(8)
    asked = [(rng.randint(1, 5), rng.choice(catalog.STATUSES), NOW + dt.timedelta(seconds=k), rng.choice(["old", "", None])) for k in range(60)]
    schema = "signal_id long, to_status string, at timestamp, reason string"
    for part in range(2):
        spark.createDataFrame(asked[part * 30 : part * 30 + 30], schema).coalesce(1).write.parquet(f"{tmp_path}/in/p={part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/p=*")
    jobs.run_available(jobs.status_stream(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(180)
    got = spark.read.parquet(f"{tmp_path}/out")
    counts = {r.signal_id: r.n for r in got.where("accepted").groupBy("signal_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = lifecycle.fold(spark.createDataFrame(asked, schema), ["signal_id"], ["at", "to_status"], reason="reason")
    assert counts == {r.signal_id: r.accepted for r in want.collect() if r.accepted}


def test_one_bad_page_fails_no_other(spark):
    """A loopback server that answers, cuts an answer short and refuses; and an address that is none."""
    import http.server
    import threading

    from tidewatch.sources import fetching

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/gone":
                return self.send_error(404)
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", "500" if self.path == "/short" else "4")
            self.end_headers()
            self.wfile.write("да".encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        spark.dataSource.register(fetching.PageSource)
        got = {r.url: r for r in spark.read.format("pages").option("urls", f"{at}/good {at}/short {at}/gone http://[bad unknown:x").load().collect()}
    finally:
        server.shutdown()
    assert (got[f"{at}/good"].ok, got[f"{at}/good"].status, got[f"{at}/good"].html) == (True, 200, "да")
    assert len(got) == 5 and all(not r.ok and r.html is None and r.error for u, r in got.items() if u != f"{at}/good")


def test_a_rejection_needs_a_reason_and_keeps_its_comment(spark):
    from tidewatch.operators import actions

    schema = "request_id long, user_id long, at timestamp, signal_id long, to_status string, rejection_reason string, rejection_comment string, reason string, error string"
    asked = [(1, 5, NOW, 1, "rejected", None, "c", None, None), (2, 5, NOW, 1, "rejected", "duplicate", "see 7", "note", None), (3, 5, NOW, 2, "rejected", "odd", None, None, None), (4, None, NOW, 2, "postponed", None, None, None, None)]
    signals = spark.createDataFrame([(1, "new", None, None, None, NOW), (2, "new", None, None, None, None)], "id long, status string, npa_link string, rejection_reason string, rejection_comment string, updated_at timestamp")
    decided = actions.decide(spark.createDataFrame(asked, schema), signals, [5])
    assert {r.request_id: r.error for r in decided.collect()} == {1: "reason", 2: None, 3: "reason", 4: "access"}
    assert {(r.id, r.status, r.rejection_reason, r.rejection_comment) for r in actions.applied(signals, decided).collect()} == {(1, "rejected", "duplicate", "see 7"), (2, "new", None, None)}
    assert [(r.signal_id, r.from_status, r.to_status, r.changed_by, r.reason) for r in actions.history(decided).collect()] == [(1, "new", "rejected", "5", "note")]
    assert actions.decide(spark.createDataFrame([], schema), signals, [5]).count() == 0


def test_a_failing_model_gives_null(spark):
    from tidewatch.operators import actions

    def ask(text):
        if text == "bad":
            raise RuntimeError("no answer")
        return text.upper()

    got = actions.asked_model(spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "")], "id long, t string"), "t", ask).collect()
    assert {r.id: r.answer for r in got} == {1: "A", 2: None, 3: None, 4: None}
