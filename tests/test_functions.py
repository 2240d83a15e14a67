import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tidewatch import catalog
from tidewatch.functions import dates, textmatch, urls
from tidewatch.operators import classify, reports
from tidewatch.sources import fetching

RU = catalog.RUSSIAN


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, s {kind}")
    return [r.x for r in rows.select("i", expression(F.col("s")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "keyword", "hit"),
    [
        ("новая выплата семьям", "выплата", True),
        ("о выплатах ветеранам", "выплата", True),
        ("ветеранам боевых действий", "ветеран боевых действий", True),
        ("ветеран боевых действий", "ветеран боевых действий", True),
        ("ветеран труда, боевых действий", "ветеран боевых действий", False),
        ("действий боевых ветеран", "ветеран боевых действий", False),
        ("невыплата", "выплата", False),
        ("доброволец пришёл", "доброволец", True),
        ("добровольцы пришли", "доброволец", False),
        ("ребёнка-инвалида", "ребёнок-инвалид", False),
        ("ребёнок-инвалиды", "ребёнок-инвалид", True),
        ("указан", "указ", True),
        ("новая", "новый", False),
    ],
)
def test_keywords(spark, text, keyword, hit):
    assert column(spark, [text], lambda s: textmatch.contains_any(F.lower(s), (keyword,))) == [hit]
    words = [rf"\b{re.escape(w)}\b" if w in textmatch.EXACT else rf"\b{re.escape(textmatch.stem(w))}\w*" for w in keyword.lower().split()]
    assert bool(re.search(r"\s+".join(words), text.lower())) is hit


def test_matches_keep_catalog_order(spark):
    assert column(spark, ["указ и закон", None], lambda s: textmatch.find_matches(F.lower(s), RU.markers)) == [["указ", "закон"], []]


def test_russian_dates(spark):
    said = ["24 июля 2026 года", "от 1 Августа 2026 г. в силе", "24 smarch 2026", "5 смарта 2026", "32 мая 2026", "нет", None]
    assert column(spark, said, dates.russian_date) == [dt.date(2026, 7, 24), dt.date(2026, 8, 1), None, None, None, None, None]


def test_effective_dates(spark):
    rows = [
        ("Закон вступает в силу с 1 сентября 2026 г.", None, dt.date(2026, 9, 1)),
        ("вступил в силу 3 марта 2025 года", None, dt.date(2025, 3, 3)),
        ("вступает в силу со дня его официального опубликования", "2026-08-20 06:00:00", dt.date(2026, 8, 20)),
        ("вступает в силу со дня официального опубликования", None, None),
        ("вступает в силу по истечении 10 дней", "2026-08-20 06:00:00", None),
        ("вступает в силу с 31 июня 2026 г. и вступает в силу со дня официального опубликования", "2026-08-20 06:00:00", dt.date(2026, 8, 20)),
    ]
    d = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(rows)], "i int, s string, p string")
    got = d.select("i", dates.effective_date(F.col("s"), F.col("p").cast("timestamp")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [w for _, _, w in rows]


def test_seconds_until(spark):
    assert column(spark, ["2026-08-20 07:59:30", "2026-08-20 08:00:00", "2026-08-20 09:00:00"], lambda s: dates.seconds_until(s.cast("timestamp"), 8)) == [30, 86400, 82800]


def test_hosts_and_allowed(spark):
    links = ["https://User@WWW.Mos.ru:443/a?b", "http://evilmos.ru/", "mos.ru/x", "ftp://a_b.sfr.gov.ru", None, "http://mos.ru.evil.com"]
    assert column(spark, links, urls.host) == ["www.mos.ru", "evilmos.ru", "", "a_b.sfr.gov.ru", "", "mos.ru.evil.com"]
    d = spark.createDataFrame([(x,) for x in links], "url string")
    allowed = {r.url for r in urls.allowed(d, spark.createDataFrame([(x,) for x in RU.domains()], "domain string")).collect()}
    assert allowed == {links[0], links[3]}
    assert column(spark, links, lambda s: urls.is_allowed(s, RU.domains())) == [True, False, False, True, False, False]


def test_links_are_resolved(spark):
    assert column(spark, ["http://a/b", "/docs/1", "docs/2", "//c.ru/x", "?page=2"], lambda s: urls.resolve("https://mintrud.gov.ru/docs/list", s)) == [
        "http://a/b", "https://mintrud.gov.ru/docs/1", "https://mintrud.gov.ru/docs/docs/2", "https://c.ru/x", "https://mintrud.gov.ru/docs/list?page=2",
    ]


@pytest.mark.parametrize(
    ("title", "source", "want"),
    [
        ("Указ об изменении выплат ветеранам боевых действий", "kremlin.ru/acts/news", (["veterans"], True, "amendment", "rf", "high")),
        ("Пособие инвалидам и участникам СВО", "mos.ru/authority/documents", (["disabled", "svo"], True, "review", "moscow", "low")),
        ("Закон о льготах утратил силу для инвалидов", "tass.ru", (["disabled"], True, "repeal", "undefined", "medium")),
        ("Приказ: выплаты вступают", "www.mos.ru/x", ([], False, "review", "undefined", "medium")),
        ("Инвалидам рассказали о погоде", "sfr.gov.ru", (["disabled"], False, "review", "rf", "low")),
    ],
)
def test_classification(spark, title, source, want):
    d = spark.createDataFrame([(title, None, source)], "title string, summary string, source_key string")
    r = classify.explain(d, RU).first()
    assert (r.categories, r.is_relevant, r.event_type, r.region, r.priority) == want
    assert ("РЕЛЕВАНТНО" in r.trace_line) is want[1]
    assert r.trace_line.endswith(f"тип события: {want[2]}; регион: {want[3]}; приоритет: {want[4]}")


def test_catalogs_load_and_are_checked(tmp_path):
    import yaml

    files = {
        "life_situations.yaml": [{"id": "svo", "name": "x", "keywords": ["a b"]}],
        "keywords.yaml": {"topic_block": ["t"], "event_type_markers": {"repeal": ["r"]}},
        "sources.yaml": {"federal": [{"domain": "b.ru", "access": "direct"}], "other": []},
        "regions.yaml": [{"code": "moscow", "name": "m", "sources": [{"domain": "a.ru", "access": "unsupported"}]}],
    }
    for name, content in files.items():
        (tmp_path / name).write_text(yaml.safe_dump(content), encoding="utf-8")
    loaded = catalog.load(tmp_path)
    assert loaded.situations == {"svo": ("a b",)} and loaded.domains() == ["a.ru", "b.ru"]
    (tmp_path / "regions.yaml").write_text("- {code: mars, name: x}", encoding="utf-8")
    with pytest.raises(catalog.CatalogError):
        catalog.load(tmp_path)
    (tmp_path / "regions.yaml").write_text("", encoding="utf-8")
    assert catalog.load(tmp_path).regions == ()
    (tmp_path / "keywords.yaml").unlink()
    with pytest.raises(catalog.CatalogError):
        catalog.load(tmp_path)


def test_fetching():
    assert fetching.decode("привет, это проверка кодировки".encode("cp1251"), "windows-1251") == "привет, это проверка кодировки"
    assert fetching.decode(b"abc", "no-such-charset") == "abc" and fetching.decode(None, None) is None
    assert fetching.routed("direct", None) == {}
    for access, proxy in (("ru_proxy", None), ("unsupported", "x"), ("odd", None)):
        with pytest.raises(ValueError):
            fetching.routed(access, proxy)
    calls, waits = [], []

    def fails():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(fetching.SourceUnavailable):
        fetching.with_retries(fails, sleep=waits.append)
    assert len(calls) == 3 and waits == [1, 2]


def test_unreachable_source_is_a_row(spark):
    spark.dataSource.register(fetching.PageSource)
    assert spark.read.format("pages").option("urls", "").load().count() == 0


def test_messages(spark):
    schema = "id long, status string, priority string, title string, categories array<string>, event_type string, region string, created_at timestamp, source_url string"
    at = dt.datetime(2026, 8, 20, 6, 0)
    d = spark.createDataFrame([(1, "new", "high", None, ["svo", "zz"], "review", "rf", at, "http://x"), (2, "new", "odd", "t", [], None, None, at, "")], schema)
    got = {(r.recipient, r.place): r.text for r in reports.messages(d, [7, 8]).collect()}
    assert len(got) == 6 and got[7, 0].endswith("2 сигналов")
    assert got[8, 1].split("\n")[:3] == ["🆔 <b>1</b> · 🔴 Высокий", "<b>(без названия)</b>", "ЖС: СВО, zz"]
    assert "🔗" not in got[7, 2] and "Тип: —" in got[7, 2]
    older = d.withColumn("id", -F.col("id")).withColumn("priority", F.lit("high")).withColumn("created_at", F.when(F.col("id") == -2, F.lit(at) - F.expr("INTERVAL 1 DAY")).otherwise(F.lit(at)))
    assert [r.text.split("\n")[0] for r in reports.messages(older, [7]).where("place > 0").orderBy("place").collect()] == ["🆔 <b>-2</b> · 🔴 Высокий", "🆔 <b>-1</b> · 🔴 Высокий"]
    assert [r.text for r in reports.messages(d.where("false"), [7]).collect()] == ["Новых сигналов нет."]
