"""Runs from listing pages to stored signals: pages until the prefix stop, sources that fail, commits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch import catalog, schemas
from tidewatch.operators import crawl
from tidewatch.operators.store import Store
from tidewatch.sources import fetching, listings

NOW = dt.datetime(2026, 8, 20, 6, 0)
GOOD = "Закон о выплатах инвалидам"
SFR, MINTRUD, DSZN = "sfr.gov.ru/press_center/news", "mintrud.gov.ru/docs", "msupport.dszn.ru/news"
SOURCES = {x.key: x for x in listings.registry()}


def sfr(*rows):
    card = '<article class="re-news__article"><a class="re-news__article-link" href="{0}"></a><h3 class="re-news__article-title">{1}</h3><time class="re-news__article-time" datetime="{2}"></time></article>'
    return "".join(card.format(*r) for r in rows)


def mintrud(*rows):
    return "".join(f'<div class="post-list"><p class="page-date">{d}</p><a class="text-black" href="{u}"><p class="post-name">{t}</p></a></div>' for u, t, d in rows)


def rss(*rows):
    return "<rss><channel>" + "".join(f"<item><title>{t}</title><link>{u}</link></item>" for u, t in rows) + "</channel></rss>"


class Web:
    """Answers from a dictionary; an address that it lacks is unavailable. Keeps what was asked for."""

    def __init__(self, pages):
        self.pages, self.asked = pages, []

    def __call__(self, spark, wanted, proxy):
        self.asked += [u for u, _ in wanted]
        rows = [(u, u in self.pages, self.pages.get(u), None if u in self.pages else "down") for u, _ in wanted]
        return spark.createDataFrame(rows, "url string, ok boolean, html string, error string")


def at(key, page):
    return crawl.address(SOURCES[key], page)


def web():
    return Web(
        {
            at(SFR, 1): sfr(("/1", GOOD, "2026-08-19"), ("/2", "О погоде", "2026-08-18"), ("https://tass.ru/1", GOOD, "2026-08-18")),
            at(SFR, 2): sfr(("/1", GOOD, "2026-08-19"), ("/3", GOOD, "2026-08-01"), ("/4", GOOD, "2026-08-19")),
            at(SFR, 3): sfr(("/5", GOOD, "2026-08-19")),
            at(MINTRUD, 1): mintrud(("/docs/1", GOOD, "19 августа 2026")),
            at(DSZN, 1): "<p>nothing</p>",
            at("tass.ru", 1): rss(("https://tass.ru/1", GOOD), ("https://tass.ru/2", GOOD)),
            at(listings.REGISTER, 1): '<script id="__NEXT_DATA__" type="application/json">{"props": </script>',
        }
    )


KEYS = [SFR, MINTRUD, listings.REGISTER, DSZN, "tass.ru", "ria.ru"]


def results(store):
    signals = {r.source_url for r in store.read("signals").collect()}
    seen = {(r.source_key, r.doc_url) for r in store.read("documents_seen").collect()}
    counters = {r.source_key: (r.ok, r.new_signals, r.duplicates, r.irrelevant, r.error) for r in store.read("run_counters").collect()}
    return signals, seen, counters, {r.source_key: r.last_success_at for r in store.state().collect()}


def test_a_run_reads_pages_until_the_stop_and_isolates_failures(spark, tmp_path):
    store, pages = Store(spark, str(tmp_path)), web()
    crawl.run(store, 1, [SOURCES[k] for k in KEYS], catalog.RUSSIAN, F.lit(NOW), pages)
    signals, seen, counters, state = results(store)
    assert signals == {"https://sfr.gov.ru/1", "https://tass.ru/1", "https://mintrud.gov.ru/docs/1", "https://tass.ru/2"}
    assert seen == {(SFR, "https://sfr.gov.ru/1"), (SFR, "https://sfr.gov.ru/2"), (SFR, "https://tass.ru/1"), (MINTRUD, "https://mintrud.gov.ru/docs/1"), ("tass.ru", "https://tass.ru/2")}
    assert counters == {
        SFR: (True, 2, 1, 1, None),
        MINTRUD: (False, 0, 0, 0, "down"),  # its second page failed: the first one's rows stay, its window does not move
        listings.REGISTER: (False, 0, 0, 0, "broken page"),
        DSZN: (True, 0, 0, 0, None),
        "tass.ru": (True, 1, 1, 0, None),
        "ria.ru": (False, 0, 0, 0, "down"),
    }
    assert state == {SFR: NOW, DSZN: NOW, "tass.ru": NOW}
    assert sorted(pages.asked) == sorted([at(SFR, 1), at(SFR, 2), at(MINTRUD, 1), at(MINTRUD, 2), *[at(k, 1) for k in KEYS[2:]]])


def test_sources_are_committed_one_by_one(spark, tmp_path):
    store, pages = Store(spark, str(tmp_path)), Web({at("tass.ru", 1): rss(("https://tass.ru/1", GOOD)), at("ria.ru", 1): rss(("https://tass.ru/1", GOOD), ("https://ria.ru/1", GOOD))})
    crawl.run_each(store, 1, [SOURCES["tass.ru"], SOURCES["ria.ru"]], catalog.RUSSIAN, F.lit(NOW), pages)
    assert store.batches("signals") == [1, 2]
    assert results(store) == ({"https://tass.ru/1", "https://ria.ru/1"}, {("tass.ru", "https://tass.ru/1"), ("ria.ru", "https://ria.ru/1")}, {"tass.ru": (True, 1, 0, 0, None), "ria.ru": (True, 1, 1, 0, None)}, {"tass.ru": NOW, "ria.ru": NOW})


def test_a_second_run_adds_only_what_is_new(spark, tmp_path):
    store, sources = Store(spark, str(tmp_path)), [SOURCES["tass.ru"], SOURCES["ria.ru"]]
    crawl.run(store, 1, sources, catalog.RUSSIAN, F.lit(NOW), Web({at("tass.ru", 1): rss(("https://tass.ru/1", GOOD))}))
    later = NOW + dt.timedelta(days=1)
    both = Web({at("tass.ru", 1): rss(("https://tass.ru/1", GOOD), ("https://tass.ru/2", GOOD)), at("ria.ru", 1): rss(("https://ria.ru/1", "О погоде"))})
    crawl.run(store, 2, sources, catalog.RUSSIAN, F.lit(later), both)
    first = results(store)
    assert first[0] == {"https://tass.ru/1", "https://tass.ru/2"} and first[3] == {"tass.ru": later, "ria.ru": later}
    crawl.run(store, 2, sources, catalog.RUSSIAN, F.lit(later), both)  # a repeated run replaces its batch, with the same result
    assert results(store) == first and store.read("signals").count() == 2


def test_pages_end_at_the_cap(spark, tmp_path):
    pages = Web({at(SFR, p): sfr((f"/{p}", GOOD, "2026-08-19")) for p in range(1, 9)})
    listed, met = crawl.crawl(Store(spark, str(tmp_path)), 1, [SOURCES[SFR]], F.lit(NOW), pages)
    assert sorted(r.page for r in listed.collect()) == [1, 2, 3, 4, 5] and len(pages.asked) == 5
    assert [tuple(r) for r in met.collect()] == [(SFR, True, None)]
    listed, met = crawl.crawl(Store(spark, str(tmp_path)), 2, [], F.lit(NOW), pages)
    assert listed.count() == 0 and met.count() == 0


def test_access_that_cannot_be_used_is_a_failed_source(spark):
    got = fetching.fetched(spark, [("http://127.0.0.1:9/a", "ru_proxy"), ("http://127.0.0.1:9/b", "unsupported")]).collect()
    assert {r.url: (r.ok, r.error.split(":")[0]) for r in got} == {"http://127.0.0.1:9/a": (False, "ValueError"), "http://127.0.0.1:9/b": (False, "ValueError")}


def test_deeply_nested_pages_are_read(spark):
    html = "<div><p>" * 3000 + sfr(("/1", GOOD, "2026-08-19"))
    assert listings.cards(listings.SITES[SFR], html) == [(0, "/1", GOOD, "2026-08-19", None)]


def test_moments_without_a_zone_are_refused(spark):
    rows = spark.createDataFrame([("a", NOW)], "source_key string, last_success_at timestamp_ntz")
    with pytest.raises(ValueError):
        schemas.shaped("sources_state", rows)


@pytest.mark.parametrize("bad", ["<![foo[bar]]>", "<![\n"])
def test_a_page_that_the_parser_rejects_costs_its_source_only(spark, tmp_path, bad):
    store = Store(spark, str(tmp_path))
    pages = Web({at("tass.ru", 1): rss(("https://tass.ru/1", GOOD)), at(SFR, 1): bad, at(MINTRUD, 1): mintrud(("/docs/1", GOOD, "19 августа 2026")), at(MINTRUD, 2): mintrud(("/docs/2", GOOD, "18 августа 2026")) + bad})
    crawl.run(store, 1, [SOURCES[k] for k in ("tass.ru", SFR, MINTRUD)], catalog.RUSSIAN, F.lit(NOW), pages)
    signals, _, counters, state = results(store)
    assert signals == {"https://tass.ru/1", "https://mintrud.gov.ru/docs/1"}
    assert counters["tass.ru"] == (True, 1, 0, 0, None) and state == {"tass.ru": NOW}
    for key in (SFR, MINTRUD):
        ok, new, _, _, error = counters[key]
        assert not ok and new == 0 and error.startswith("broken page: ")


def test_feeds_that_are_not_well_formed_are_read_as_far_as_they_go(spark):
    item = "<item><title>A &amp; <![CDATA[b]]></title><link>https://tass.ru/1</link></item>"
    broken = ["<rss><channel><item><title>x", f"<rss><channel>{item}<item><title><![CDATA[<c> & d]]></title><link> https://tass.ru/2 </link><pubDate>20 Aug 2026 10:00:00 GMT</pubDate>", "no feed at all", None]
    rows = [listings.read_feed(spark.createDataFrame([(x,)], "xml string"), "tass.ru").collect() for x in broken]
    assert [[(r.ord, r.title, r.url) for r in x] for x in rows] == [[], [(0, "A & b", "https://tass.ru/1"), (1, "<c> & d", "https://tass.ru/2")], [], []]
    assert rows[1][1].published_at == dt.datetime(2026, 8, 20, 10)
