"""The engine's registered queries over the driver's tables, and the SQL that each is checked against."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog import EVENT_ORDER, STATUS_LABELS, SYNTHETIC
from tidewatch.functions import dates, textmatch, urls
from tidewatch.operators import actions, classify, ingest, lifecycle, reports, seen
from tidewatch.operators.store import Store
from tidewatch.session import kept, new_folder, spread, table
from tidewatch.schemas import TABLES
from tidewatch.sources import hooks, listings, outbox

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

C = SYNTHETIC


def query(sql: str):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def big(column) -> F.Column:
    return column.cast("bigint")


# --- pieces of SQL ------------------------------------------------------------------------


def _stem_sql(word: str) -> str:
    """The rule of stems written out for RE2, apart from the engine's own patterns."""
    cut = 2 if len(word) > 5 else 1 if len(word) > 3 else 0
    return word[: len(word) - cut] + r"[\p{L}\p{N}_]*"


def _pattern_sql(keyword: str) -> str:
    return r"(^|[^\p{L}\p{N}_])" + r"[\s\p{Z}]+".join(map(_stem_sql, keyword.split()))


def sql_any(words, text: str = "low") -> str:
    """Whether a lower-cased text holds any keyword."""
    return "(" + " OR ".join(f"regexp_matches({text}, '{_pattern_sql(w)}')" for w in words) + ")" if words else "false"


def sql_found(words, text: str = "low") -> str:
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN regexp_matches({text}, '{_pattern_sql(w)}') THEN '{w}' END" for w in words) + ")"


_EVENT = "CASE " + " ".join(f"WHEN {sql_any(C.events[e])} THEN '{e}'" for e in EVENT_ORDER) + " ELSE 'review' END"
_REGION = "CASE WHEN source IN ('src0','src1') THEN 'moscow' WHEN source IN ('src2','src3','src4','src5','src6') THEN 'rf' ELSE 'undefined' END"
_PRIORITY = f"CASE WHEN NOT {sql_any(C.markers)} THEN 'low' WHEN region = 'undefined' THEN 'medium' WHEN {sql_any(C.high)} THEN 'high' ELSE 'medium' END"
_CLASSIFIED = f"""WITH d AS (SELECT doc_id, source, lower(text || ' ') AS low FROM documents), r AS (
  SELECT *, {_REGION} AS region, {_EVENT} AS event_type, {", ".join(f"{sql_any(w)} AS {k}" for k, w in C.situations.items())}, {sql_any(C.topic)} AS topic FROM d
), c AS (SELECT *, {_PRIORITY} AS priority, (cat_a OR cat_b OR cat_c) AND topic AS is_relevant FROM r)
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title"), F.col("source").alias("source_key")))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(_documents(spark, sf_dir), C, summary=None)


def _lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.lower(textmatch.publication_text(F.col("title"), F.lit(None).cast("string"))).alias("low"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance by priority."""
    return _classified(spark, sf_dir).groupBy("is_relevant", "priority").agg(F.count(F.lit(1)).alias("n"))


# --- classification -------------------------------------------------------------------------


@query(_CLASSIFIED + "SELECT doc_id, cat_a, cat_b, cat_c, topic, is_relevant FROM c")
def q01_relevance(spark, sf_dir):
    low = F.col("low")
    return _lower(spark, sf_dir).select("doc_id", *[textmatch.contains_any(low, w).alias(k) for k, w in C.situations.items()], textmatch.contains_any(low, C.topic).alias("topic"), classify.is_relevant(low, C).alias("is_relevant"))


_ALL_WORDS = tuple(dict.fromkeys(w for g in (*C.situations.values(), C.topic, C.markers, C.high) for w in g))


@query(f"WITH d AS (SELECT doc_id, lower(text || ' ') AS low FROM documents) SELECT doc_id, {sql_found(_ALL_WORDS)} AS found FROM d")
def q02_matched_keywords(spark, sf_dir):
    return _lower(spark, sf_dir).select("doc_id", F.array_join(textmatch.find_matches(F.col("low"), _ALL_WORDS), ", ").alias("found"))


@query(_CLASSIFIED + "SELECT category, count(*) AS n FROM (SELECT 'cat_a' AS category FROM c WHERE cat_a UNION ALL SELECT 'cat_b' FROM c WHERE cat_b UNION ALL SELECT 'cat_c' FROM c WHERE cat_c) GROUP BY category")
def q03_category_counts(spark, sf_dir):
    return _classified(spark, sf_dir).select(F.explode("categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(_CLASSIFIED + "SELECT doc_id, event_type FROM c")
def q04_event_type(spark, sf_dir):
    return _lower(spark, sf_dir).select("doc_id", classify.event_type(F.col("low"), C).alias("event_type"))


@query(_CLASSIFIED + "SELECT doc_id, region FROM c")
def q05_region(spark, sf_dir):
    regional = spark.createDataFrame([(s.domain, code, k) for k, (code, sources) in enumerate(C.regions) for s in sources], "domain string, code string, ord int")
    federal = spark.createDataFrame([(s.domain,) for s in C.federal], "domain string")
    return classify.region_by_join(_documents(spark, sf_dir).select("doc_id", "source_key"), regional, federal).select("doc_id", "region")


@query(_CLASSIFIED + "SELECT doc_id, priority FROM c")
def q06_priority(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "priority")


def _sql_trace() -> str:
    cats = "concat_ws(', ', " + ", ".join(f"CASE WHEN {k} THEN '{k} (по ''' || {sql_found(w)} || ''')' END" for k, w in C.situations.items()) + ")"
    part = lambda name, words: f"CASE WHEN {sql_any(words)} THEN '{name}: ''' || {sql_found(words)} || '''' END"
    return (
        _CLASSIFIED
        + f"""SELECT doc_id, concat_ws(' | ', 'ЖС: ' || CASE WHEN cat_a OR cat_b OR cat_c THEN {cats} ELSE 'нет совпадений' END,
  CASE WHEN topic THEN 'тематический блок: да (''' || {sql_found(C.topic)} || ''')' ELSE 'тематический блок: нет совпадений' END,
  CASE WHEN is_relevant THEN 'РЕЛЕВАНТНО' ELSE 'не релевантно' END, {part("маркер документа", C.markers)}, {part("слово приоритета", C.high)},
  'тип события: ' || event_type || '; регион: ' || region || '; приоритет: ' || priority) AS trace_line FROM c"""
    )


@query(_sql_trace())
def q07_trace(spark, sf_dir):
    return classify.explain(_documents(spark, sf_dir), C, summary=None).select("doc_id", "trace_line")


@query(_CLASSIFIED + "SELECT category, priority, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN cat_a THEN 'cat_a' END, CASE WHEN cat_b THEN 'cat_b' END, CASE WHEN cat_c THEN 'cat_c' END], lambda x: x IS NOT NULL)) AS category, priority FROM c) GROUP BY category, priority")
def q08_category_priority(spark, sf_dir):
    return _classified(spark, sf_dir).select(F.explode("categories").alias("category"), "priority").groupBy("category", "priority").agg(F.count(F.lit(1)).alias("n"))


_KEYWORDS = [(g, w) for g, words in (*C.situations.items(), ("topic", C.topic), ("markers", C.markers), ("high", C.high), *C.events.items()) for w in words]


_KEYWORDS_SQL = "(VALUES " + ", ".join(f"('{g}', '{w}', '{_pattern_sql(w)}')" for g, w in _KEYWORDS) + ") p(grp, keyword, pattern)"


@query(f"SELECT grp, keyword, count(low) AS n FROM {_KEYWORDS_SQL} LEFT JOIN (SELECT lower(text) AS low FROM documents) d ON regexp_matches(low, pattern) GROUP BY grp, keyword")
def q09_keyword_join(spark, sf_dir):
    return classify.keyword_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), spark.createDataFrame(_KEYWORDS, "grp string, keyword string"), "doc_id")


@query(f"SELECT doc_id, grp, keyword FROM {_KEYWORDS_SQL} JOIN (SELECT doc_id, lower(text) AS low FROM documents) d ON regexp_matches(low, pattern)")
def q59_keyword_index(spark, sf_dir):
    """The same by the join on stems, which takes tables of keywords of any size: the keywords of every document."""
    return textmatch.keyword_hits(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), spark.createDataFrame(_KEYWORDS, "grp string, keyword string"), "doc_id")


# --- links and pages --------------------------------------------------------------------------

_HOST = "lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1))"
_DOMAINS = ["example.com", "site1.example.org", "example.net"]


@query(f"SELECT page_id, {_HOST} AS host FROM pages")
def q10_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@query(f"SELECT page_id, h AS host FROM (SELECT page_id, {_HOST} AS h FROM pages) WHERE " + " OR ".join(f"h = '{d}' OR ends_with(h, '.{d}')" for d in _DOMAINS))
def q11_allowed_domains(spark, sf_dir):
    domains = spark.createDataFrame([(d,) for d in _DOMAINS], "domain string")
    return urls.allowed(table(spark, sf_dir, "pages").select("page_id", "url"), domains).select("page_id", "host")


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def q12_page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", listings.title_of(F.col("html")).alias("title"))


@query("SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY href")
def q13_hrefs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.explode(listings.hrefs(F.col("html"))).alias("href")).groupBy("href").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def q14_json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


_MONTH_NAMES = list(dates.MONTHS)
_MONTH_SQL = "['" + "', '".join(_MONTH_NAMES) + "'][month(o_orderdate)]"


@query(f"""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 4 AS form, {_MONTH_SQL} AS m FROM orders)
SELECT o_orderkey, CASE WHEN form < 2 THEN strftime(day, '%Y-%m-%d') WHEN form = 3 THEN strftime(TRY_CAST(year(day) || '-02-' || lpad(CAST(day(day) AS VARCHAR), 2, '0') AS DATE), '%Y-%m-%d') END AS found,
  CASE form WHEN 1 THEN strftime(day, '%Y-%m-%d') WHEN 2 THEN strftime(day + 1, '%Y-%m-%d') WHEN 3 THEN strftime(TRY_CAST(year(day) || '-02-' || lpad(CAST(day(day) AS VARCHAR), 2, '0') AS DATE), '%Y-%m-%d') END AS effective FROM d""")
def q15_dates(spark, sf_dir):
    """Dates in words and dates of entry into force, read from texts that are written from the orders' dates."""
    day = F.col("o_orderdate").cast("date")
    said = F.concat(F.day(day).cast("string"), F.lit(" "), F.element_at(F.array(*[F.lit(m) for m in _MONTH_NAMES]), F.month(day)), F.lit("  "), F.year(day).cast("string"))
    wrong = F.concat(F.day(day).cast("string"), F.lit(" Февраля "), F.year(day).cast("string"))
    form = F.col("o_orderkey") % 4
    text = (
        F.when(form == 0, F.concat(F.lit("Приказ от "), said, F.lit(" года")))
        .when(form == 1, F.concat(F.lit("Закон вступает в силу с "), said, F.lit(" г.")))
        .when(form == 2, F.lit("Вступил в силу со дня его официального опубликования"))
        .otherwise(F.concat(F.lit("вступила в силу "), wrong, F.lit("г.")))
    )
    published = F.to_utc_timestamp(day.cast("timestamp") + F.expr("INTERVAL 22 HOURS"), "UTC")  # in Moscow it is the next day
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("s"), published.alias("at"))
    return rows.select("o_orderkey", dates.russian_date(F.col("s")).cast("string").alias("found"), dates.effective_date(F.col("s"), F.col("at")).cast("string").alias("effective"))


def _moments(spark, sf_dir):
    """Events with their moment to the second (at), and a function that writes it."""
    at = F.date_trunc("second", F.to_utc_timestamp(F.col("ts").cast("timestamp_ntz").cast("timestamp"), "UTC"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", at.alias("at")), lambda form: F.date_format("at", form)


_T = "WITH e AS (SELECT event_id, event_type, date_trunc('second', ts) AS t, event_id % 4 AS form FROM events)"
_SAY = lambda x: f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


@query(f"""{_T} SELECT event_id, event_type IN ('view', 'click', 'error') AS is_text,
  CASE form WHEN 0 THEN {_SAY("t - INTERVAL 3 HOURS")} WHEN 1 THEN {_SAY("t - INTERVAL 4 HOURS")} WHEN 2 THEN {_SAY("date_trunc('day', t) - INTERVAL 3 HOURS")} END AS iso,
  CASE WHEN form < 3 THEN {_SAY("t - INTERVAL 3 HOURS")} END AS stamp, CASE WHEN form < 3 THEN {_SAY("date_trunc('day', t) - INTERVAL 3 HOURS")} END AS dotted,
  CASE form WHEN 0 THEN {_SAY("t - INTERVAL 3 HOURS")} WHEN 1 THEN {_SAY("t")} WHEN 2 THEN {_SAY("date_trunc('minute', t)")} END AS feed FROM e""")
def q16_formats(spark, sf_dir):
    """Content types and moments in the sources' written forms, from the events."""
    rows, say = _moments(spark, sf_dir)
    form = F.col("event_id") % 4
    kind = {"view": "text/html; charset=utf-8", "click": " Text/Plain ", "error": "application/pdf", "purchase": "video/mp4", "signup": ""}
    one_of = lambda *c: F.element_at(F.array(*c), form.cast("int") + 1)
    written = rows.select(
        "event_id",
        F.create_map(*[F.lit(x) for pair in kind.items() for x in pair])[F.col("event_type")].alias("kind"),
        one_of(say("yyyy-MM-dd'T'HH:mm:ss"), F.concat(say("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+04:00")), say("yyyy-MM-dd"), F.concat(say("yyyy"), F.lit("-13-01"))).alias("iso"),
        one_of(*[say("yyyy-MM-dd HH:mm:ss")] * 3, F.concat(say("yyyy"), F.lit("-02-30 00:00:00"))).alias("stamp"),
        one_of(say("dd.MM.yyyy"), F.concat(F.lit(" "), say("d.M.yyyy")), say("dd.MM.yyyy"), F.concat(F.lit("31.02."), say("yyyy"))).alias("dotted"),
        one_of(F.concat(F.lit("Thu, "), say("dd MMM yyyy HH:mm:ss"), F.lit(" +0300")), F.concat(say("d MMM yyyy HH:mm:ss"), F.lit(" GMT")), F.concat(say("d MMM yyyy H:mm"), F.lit(" UT")), F.lit("x")).alias("feed"),
    )
    said = lambda c, f: F.date_format(f(F.col(c)), "yyyy-MM-dd HH:mm:ss").alias(c)
    return written.select("event_id", urls.is_text(F.col("kind")).alias("is_text"), said("iso", dates.iso_moscow), said("stamp", dates.moscow_stamp), said("dotted", dates.dotted_moscow), said("feed", dates.feed_date))


@query(f"""{_T} SELECT event_id, CASE form WHEN 0 THEN strftime(t - INTERVAL 3 HOURS, '%Y-%m-%d %H:%M:%S.000') WHEN 1 THEN strftime(t + INTERVAL 210 MINUTES, '%Y-%m-%d %H:%M:%S.123') WHEN 2 THEN strftime(date_trunc('day', t) - INTERVAL 3 HOURS, '%Y-%m-%d %H:%M:%S.000') ELSE strftime(date_trunc('hour', t), '%Y-%m-%d %H:%M:%S.000') END AS iso,
  CASE form WHEN 0 THEN {_SAY("t + INTERVAL 5 HOURS")} WHEN 1 THEN {_SAY("t")} WHEN 2 THEN {_SAY("date_trunc('day', t)")} ELSE {_SAY("t - INTERVAL 3 HOURS")} END AS feed FROM e""")
def q17_odd_dates(spark, sf_dir):
    """Legal but rare forms of the same moments: compact, week dates, long fractions, zone names, years of two digits, feeds with ISO dates."""
    rows, say = _moments(spark, sf_dir)
    one_of = lambda *c: F.element_at(F.array(*c), (F.col("event_id") % 4).cast("int") + 1)
    monday = F.date_trunc("week", "at")
    week = F.concat(F.year(F.date_add(monday, 3)).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("at").cast("string"), 2, "0"), F.lit("-"), (F.weekday("at") + 1).cast("string"))
    written = rows.select(
        "event_id",
        one_of(say("yyyyMMdd'T'HHmmss"), F.concat(say("yyyy-MM-dd HH:mm:ss"), F.lit(".1234567-0330")), week, say("yyyyMMdd'T'HH'Z'")).alias("iso"),
        one_of(F.concat(F.lit("Thu, "), say("dd MMM yy HH:mm:ss"), F.lit(" EST")), say("yyyy-MM-dd'T'HH:mm:ss'Z'"), say("d MMM yyyy"), F.concat(say("dd-MMM-yyyy HH:mm:ss"), F.lit(" MSK"))).alias("feed"),
    )
    return written.select("event_id", F.date_format(dates.iso_moscow(F.col("iso")), "yyyy-MM-dd HH:mm:ss.SSS").alias("iso"), F.date_format(dates.feed_date(F.col("feed")), "yyyy-MM-dd HH:mm:ss").alias("feed"))


# --- ingest -------------------------------------------------------------------------------------


@query("""SELECT event_id, user_id FROM (SELECT event_id, user_id, max(CASE WHEN value < 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM events) WHERE stop = 0""")
def q20_prefix_stop(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    place = F.struct(-F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id"))
    return ingest.prefix_stop_by_bound(rows.select("event_id", "user_id", "ts", "value"), "user_id", place, F.coalesce(F.col("value") < 1, F.lit(False))).select("event_id", "user_id")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def q21_first_wins(spark, sf_dir):
    return ingest.first_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id")


@query("SELECT DISTINCT user_id, k FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts FROM events) e WHERE ts >= TIMESTAMP '2024-01-05' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.ts < TIMESTAMP '2024-01-05' AND s.user_id = e.user_id AND CAST(json_extract_string(s.props, '$.k') AS INTEGER) = e.k)")
def q22_unseen(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), "ts")
    cut = F.lit("2024-01-05").cast("timestamp_ntz")
    return ingest.unseen(rows.where(F.col("ts") >= cut).select("user_id", "k").distinct(), rows.where(F.col("ts") < cut), ["user_id", "k"])


_NOW = "2024-01-20 00:00:00"


@query(f"""SELECT t.event_type AS source_key, strftime(coalesce(s.moment, TIMESTAMP '{_NOW}' - INTERVAL 7 DAY), '%Y-%m-%d %H:%M:%S') AS since FROM (SELECT DISTINCT event_type FROM events) t
  LEFT JOIN (VALUES ('view', TIMESTAMP '2024-01-02 03:00:00'), ('click', NULL), ('other', TIMESTAMP '2024-01-01')) s(k, moment) ON s.k = t.event_type""")
def q23_window_start(spark, sf_dir):
    state = spark.createDataFrame([("view", "2024-01-02 03:00:00"), ("click", None), ("other", "2024-01-01 00:00:00")], "source_key string, at string").select("source_key", F.col("at").cast("timestamp").alias("last_success_at"))
    sources = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_key")).distinct()
    return ingest.window_start(sources, state, F.lit(_NOW).cast("timestamp")).select("source_key", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("SELECT event_type AS source_key, count(*) FILTER (value >= 50) AS fresh, count(*) FILTER (value < 50 AND value >= 10) AS duplicates, count(*) FILTER (value < 10) AS irrelevant, count(*) AS total FROM events GROUP BY event_type")
def q24_counters(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source_key")).agg(F.count_if(v >= 50).alias("fresh"), F.count_if((v < 50) & (v >= 10)).alias("duplicates"), F.count_if(v < 10).alias("irrelevant"), F.count(F.lit(1)).alias("total"))


@query("SELECT event_type, count(*) AS kept FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS moment FROM events) WHERE NOT coalesce(moment < TIMESTAMP '2024-01-15', false) GROUP BY event_type")
def q25_late_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("at"))
    return rows.where(~ingest.is_stale(F.col("at"), F.lit("2024-01-15").cast("timestamp_ntz"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@query("""WITH s AS (SELECT 'u' || user_id AS source_key, CASE WHEN ts < TIMESTAMP '2024-01-04' THEN 'old' WHEN ts < TIMESTAMP '2024-01-06' THEN 'new' END AS side, max(ts) FILTER (event_type <> 'error') AS at, CAST(max(ts) FILTER (event_type = 'view') AS DATE) AS day FROM events GROUP BY 1, 2),
o AS (SELECT * FROM s WHERE side = 'old'), n AS (SELECT * FROM s WHERE side = 'new')
SELECT coalesce(o.source_key, n.source_key) AS source_key, strftime(coalesce(n.at, o.at), '%Y-%m-%d %H:%M:%S') AS last_success_at, strftime(coalesce(n.day, o.day), '%Y-%m-%d') AS last_seen_publication_date FROM o FULL JOIN n ON o.source_key = n.source_key""")
def q26_state_upsert(spark, sf_dir):
    """The state of two runs over the events of some days: times and dates that the later one knows replace those before."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("source_key"), "event_type", F.to_utc_timestamp(F.col("ts").cast("timestamp_ntz").cast("timestamp"), "UTC").alias("at"))

    def state(begin: str, end: str):
        part = rows.where((F.col("at") >= F.lit(begin).cast("timestamp")) & (F.col("at") < F.lit(end).cast("timestamp")))
        return part.groupBy("source_key").agg(F.max(F.when(F.col("event_type") != "error", F.col("at"))).alias("last_success_at"), F.max(F.when(F.col("event_type") == "view", F.col("at"))).cast("date").alias("last_seen_publication_date"))

    merged = ingest.merge_state(state("2000-01-01", "2024-01-04"), state("2024-01-04", "2024-01-06"))
    return merged.withColumns({"last_success_at": F.date_format("last_success_at", "yyyy-MM-dd HH:mm:ss"), "last_seen_publication_date": F.date_format("last_seen_publication_date", "yyyy-MM-dd")})


@query(_CLASSIFIED + """, l AS (SELECT doc_id, source AS source_key, coalesce(is_relevant, false) AS relevant, doc_id % 9 AS h, 'https://src' || (doc_id % 9) || '/' || (doc_id // 27) AS url,
  CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 173 = 172 THEN 30 ELSE doc_id % 7 END AS age FROM c WHERE source IS NOT NULL),
p AS (SELECT *, max(CASE WHEN age > (CASE WHEN source_key = 'src1' THEN 60 ELSE 7 END) THEN 1 ELSE 0 END) OVER (PARTITION BY source_key ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM l),
g AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CAST(substr(source_key, 4) AS INTEGER), doc_id) AS k FROM p WHERE stop = 0 AND h < 7),
m AS (SELECT source_key, count(*) AS live, count(*) FILTER (k = 1 AND NOT known AND relevant) AS good, count(*) FILTER (k = 1 AND NOT known) AS fresh FROM (SELECT *, url IN ('https://src3/1', 'https://src4/2') AS known FROM g) GROUP BY 1),
z AS (SELECT s.source_key, s.source_key <> 'src6' AS ok, coalesce(live, 0) AS live, coalesce(good, 0) AS stored_signals, coalesce(fresh, 0) AS stored_seen FROM (SELECT DISTINCT source_key FROM l) s LEFT JOIN m ON m.source_key = s.source_key)
SELECT source_key, ok, stored_signals, stored_seen, CASE WHEN ok THEN stored_signals ELSE 0 END AS new_signals, CASE WHEN ok THEN live - stored_seen ELSE 0 END AS duplicates, CASE WHEN ok THEN stored_seen - stored_signals ELSE 0 END AS irrelevant,
  CASE WHEN ok THEN '2026-08-20' WHEN source_key = 'src1' THEN '2026-06-21' END AS last_success FROM z""")
def q27_ingest_run(spark, sf_dir):
    """A whole run over documents as publications: stop, allow-list, first wins, seen ones, classes, counters, state."""
    now, k = F.lit("2026-08-20 06:00:00").cast("timestamp"), F.col("doc_id")
    age = F.when(k % 10 == 0, F.lit(None)).when(k % 173 == 172, 30).otherwise(k % 7).cast("int")
    listed = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(
        F.col("source").alias("source_key"), F.substring("source", 4, 9).cast("int").alias("source_ord"), F.lit(1).alias("page"), k.alias("ord"), F.col("text").alias("title"),
        F.concat(F.lit("https://src"), (k % 9).cast("string"), F.lit("/"), F.floor(k / 27).cast("string")).alias("url"), (now - F.make_interval(days=age)).alias("published_at"), F.lit(None).cast("string").alias("summary"),
    )
    sources = listed.select("source_key").distinct().withColumn("ok", F.col("source_key") != "src6")
    state = spark.createDataFrame([("src1",)], "source_key string").select("source_key", (now - F.make_interval(days=F.lit(60))).alias("last_success_at"), F.lit(None).cast("date").alias("last_seen_publication_date"))
    seen = spark.createDataFrame([("https://src3/1",), ("https://src4/2",)], "doc_url string")
    got = ingest.ingest(listed, sources, state, seen, spark.createDataFrame([(d,) for d in C.domains()], "domain string"), C, now)
    stored = lambda name: got[name].groupBy("source_key").agg(F.count(F.lit(1)).alias(f"stored_{name}"))
    told = got["counters"].join(stored("signals"), "source_key", "left").join(stored("seen"), "source_key", "left").join(got["state"], "source_key", "left")
    return told.select("source_key", "ok", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("stored_signals", "stored_seen")], "new_signals", "duplicates", "irrelevant", F.date_format("last_success_at", "yyyy-MM-dd").alias("last_success"))


# --- lifecycle ------------------------------------------------------------------------------------

_REQUESTED = {"view": "in_progress", "click": "postponed", "error": "rejected", "purchase": "sent_to_agent", "signup": "completed"}
_TO = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _REQUESTED.items()) + " END"
_MOVES = "('new','in_progress'),('new','rejected'),('new','postponed'),('in_progress','postponed'),('in_progress','rejected'),('in_progress','sent_to_agent'),('postponed','in_progress'),('postponed','rejected'),('sent_to_agent','completed'),('rejected','new')"


@query(f"""WITH RECURSIVE r AS (SELECT user_id, {_TO} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
m(a, b) AS (VALUES {_MOVES}),
s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 'new' AS status, CAST(0 AS BIGINT) AS accepted FROM r
  UNION ALL SELECT s.user_id, r.k, CASE WHEN m.a IS NULL THEN s.status ELSE r.t END, s.accepted + CASE WHEN m.a IS NULL THEN 0 ELSE 1 END
  FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1 LEFT JOIN m ON m.a = s.status AND m.b = r.t)
SELECT user_id, status, accepted, k - accepted AS refused FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS z FROM s) WHERE z = 1""")
def q30_status_fold(spark, sf_dir):
    requested = F.create_map(*[F.lit(x) for pair in _REQUESTED.items() for x in pair])
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", requested[F.col("event_type")].alias("to_status"))
    return lifecycle.fold(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "status", "accepted", "refused")


@query("SELECT event_type AS from_status, nxt AS to_status, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY 1, 2")
def q31_status_pairs(spark, sf_dir):
    rows = lifecycle.steps(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.where("next_status IS NOT NULL").groupBy(F.col("event_type").alias("from_status"), F.col("next_status").alias("to_status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'orders without customer' AS rule, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'labels without document', count(*) FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'repeated page url', count(*) FROM (SELECT url FROM pages GROUP BY url HAVING count(*) > 1)
UNION ALL SELECT 'repeated event source', count(*) FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 1)""")
def q32_constraints(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    checks = {
        "orders without customer": lifecycle.orphans(t("orders").select("o_custkey"), t("customer"), "o_custkey", "c_custkey"),
        "labels without document": lifecycle.orphans(t("labels").select("doc_id"), t("documents"), "doc_id", "doc_id"),
        "repeated page url": lifecycle.repeated(t("pages"), ["url"]),
        "repeated event source": lifecycle.repeated(t("events"), ["user_id"]),
    }
    out = None
    for rule, bad in checks.items():
        one = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS history FROM events GROUP BY user_id")
def q33_history_string(spark, sf_dir):
    grouped = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("h"))
    return grouped.select("user_id", F.array_join(F.transform("h", lambda x: x["event_type"]), ">").alias("history"))


@query("SELECT o_orderkey AS id, coalesce(h, '') AS history FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_returnflag || '>' || l_linestatus, ',' ORDER BY l_shipdate, l_linenumber, l_returnflag, l_linestatus) AS h FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def q34_nested_history(spark, sf_dir):
    """Line items read as the audit rows of their orders."""
    audit = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("signal_id"), F.col("l_shipdate").alias("changed_at"), F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("from_status"), F.col("l_linestatus").alias("to_status"))
    told = reports.with_history(_signals(spark, sf_dir).select("id"), audit)
    return told.select("id", F.coalesce(F.array_join(F.transform("history", lambda x: F.concat(x["from_status"], F.lit(">"), x["to_status"])), ","), F.lit("")).alias("history"))


# --- reports ----------------------------------------------------------------------------------------


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as signals."""
    status = F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "F", "completed").otherwise("in_progress")
    level = F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2"), "medium").when(F.col("o_orderpriority").startswith("3"), "low").otherwise("none")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), status.alias("status"), level.alias("priority"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderpriority").alias("title"), "o_custkey"
    )


_SIGNALS = """WITH signals AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'completed' ELSE 'in_progress' END AS status,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' WHEN '3' THEN 'low' ELSE 'none' END AS priority, o_orderdate AS moment, o_orderpriority AS title, o_custkey FROM orders)
"""


@query(_SIGNALS + "SELECT id, status FROM signals WHERE status IN ('new', 'postponed') AND moment >= TIMESTAMP '1995-03-15' AND moment < TIMESTAMP '1995-03-16'")
def q40_today(spark, sf_dir):
    return reports.today(_signals(spark, sf_dir), F.lit("1995-03-15").cast("timestamp_ntz")).select("id", "status")


@query(_SIGNALS + "SELECT id, strftime(moment, '%Y-%m-%d') AS day FROM signals WHERE status IN ('in_progress', 'postponed')")
def q41_pending(spark, sf_dir):
    return reports.pending(_signals(spark, sf_dir)).select("id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query(_SIGNALS + "SELECT id, strftime(moment, '%Y-%m-%d') AS day FROM signals WHERE status IN ('sent_to_agent', 'completed', 'rejected') ORDER BY moment DESC, id LIMIT 10")
def q42_history(spark, sf_dir):
    return reports.history(_signals(spark, sf_dir)).select("id", F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


_LABEL = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_LABELS.items()) + " ELSE status END"


@query("SELECT event_type AS status, event_type AS label, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY GROUP BY event_type")
def q43_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), F.col("ts").alias("created_at"))
    return reports.stats(rows, F.lit("2024-01-30").cast("timestamp_ntz"))


@query(_SIGNALS + "SELECT id, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 9 END, moment, id) AS place FROM signals WHERE status IN ('new', 'postponed')")
def q44_digest(spark, sf_dir):
    rows = reports.digest(_signals(spark, sf_dir)).select("id", "priority", "created_at")
    return reports.numbered(rows, reports.rank(F.col("priority"))).select("id", "place")


@query(_SIGNALS + "SELECT id, recipient, '⏰ Сигнал ' || id || ' в работе больше 3 дней: ' || title AS message FROM signals, (VALUES (CAST(11 AS BIGINT)), (12)) r(recipient) WHERE status = 'in_progress' AND moment < TIMESTAMP '1995-06-20' - INTERVAL 3 DAY")
def q45_reminder(spark, sf_dir):
    rows = reports.stale(_signals(spark, sf_dir), F.lit("1995-06-20").cast("timestamp_ntz"))
    return reports.addressed(rows, [11, 12]).select("id", "recipient", reports.reminder(rows).alias("message"))


@query(_SIGNALS + f"""SELECT id, concat_ws(chr(10), '🆔 <b>' || id || '</b> · ' || CASE priority WHEN 'high' THEN '🔴 Высокий' WHEN 'medium' THEN '🟡 Средний' WHEN 'low' THEN '🟢 Низкий' ELSE priority END, '<b>' || title || '</b>',
  'ЖС: ' || CASE WHEN id % 3 = 0 THEN '—' WHEN id % 3 = 1 THEN 'ВБД' ELSE 'Инвалиды, x' END, 'Тип: ' || CASE WHEN id % 2 = 0 THEN 'Обзор' ELSE '—' END, 'Регион: ' || CASE WHEN id % 2 = 0 THEN 'РФ' ELSE 'zz' END,
  'Статус: ' || {_LABEL}, 'Дата: ' || strftime(moment, '%d.%m.%Y %H:%M'), CASE WHEN id % 5 = 0 THEN '🔗 http://x/' || id END) AS card FROM signals""")
def q46_cards(spark, sf_dir):
    i = F.col("id")
    cats = F.when(i % 3 == 0, F.array().cast("array<string>")).when(i % 3 == 1, F.array(F.lit("veterans"))).otherwise(F.array(F.lit("disabled"), F.lit("x")))
    rows = _signals(spark, sf_dir).withColumns({"categories": cats, "event_type": F.when(i % 2 == 0, "review"), "region": F.when(i % 2 == 0, "rf").otherwise("zz"), "source_url": F.when(i % 5 == 0, F.concat(F.lit("http://x/"), i.cast("string")))})
    return rows.select("id", reports.card().alias("card"))


_DAY = "1996-07-20"
_DAILY = _SIGNALS + f""", cats AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1), cards AS (
  SELECT id, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 9 END AS first, moment, concat_ws(chr(10), '🆔 <b>' || id || '</b> · ' || CASE priority WHEN 'high' THEN '🔴 Высокий' WHEN 'medium' THEN '🟡 Средний' WHEN 'low' THEN '🟢 Низкий' ELSE priority END,
  '<b>' || title || '</b>', 'ЖС: ' || coalesce(flags, '—'), 'Тип: —', 'Регион: —', 'Статус: Новый', 'Дата: ' || strftime(moment, '%d.%m.%Y %H:%M')) AS card
  FROM signals LEFT JOIN cats ON l_orderkey = id WHERE status = 'new' AND moment >= TIMESTAMP '{_DAY}' AND moment < TIMESTAMP '{_DAY}' + INTERVAL 1 DAY)
"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's signals with their categories, as a report renders them."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("signal_id"), F.col("l_returnflag").alias("category"))
    rows = reports.today(_signals(spark, sf_dir), F.lit(_DAY).cast("timestamp_ntz"))
    return reports.with_categories(rows, links).withColumns({c: F.lit(None).cast("string") for c in ("event_type", "region", "source_url")})


@query(_DAILY + "SELECT id, card FROM cards")
def q47_daily_cards(spark, sf_dir):
    return _daily(spark, sf_dir).select("id", reports.card().alias("card"))


@query(_DAILY + """, told AS (SELECT 0 AS place, CASE WHEN count(*) = 0 THEN 'Новых сигналов нет.' ELSE '📬 Утренняя сводка: ' || count(*) || ' сигналов' END AS text FROM cards
  UNION ALL SELECT row_number() OVER (ORDER BY first, moment, id), card FROM cards)
SELECT recipient, place, text FROM told, (VALUES (CAST(11 AS BIGINT)), (12)) r(recipient)""")
def q48_broadcast(spark, sf_dir):
    """The morning broadcast to two recipients: a header, then a card for each of the day's signals by priority and age."""
    return reports.messages(_daily(spark, sf_dir), [11, 12])


@query(f"SELECT host FROM (SELECT {_HOST} AS host FROM pages UNION SELECT 'example.com' UNION SELECT 'mos.ru')")
def q50_domain_union(spark, sf_dir):
    known = spark.createDataFrame([("example.com",), ("mos.ru",)], "host string")
    return table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host")).union(known).distinct()


@query(_SIGNALS + """, cats AS (SELECT l_orderkey AS id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey)
SELECT s.id, coalesce(flags, '') AS flags FROM signals s LEFT JOIN cats ON cats.id = s.id""")
def q51_nested_categories(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("signal_id"), F.col("l_returnflag").alias("category"))
    return reports.with_categories(_signals(spark, sf_dir).select("id"), links).select("id", F.array_join("categories", ",").alias("flags"))


@query("SELECT event_type AS source_key, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT source, count(*) FROM documents GROUP BY 1")
def q52_concat_sources(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source_key")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_key")).agg(F.count(F.lit(1)).alias("n")))


@query("SELECT event_id, CAST(date_diff('second', ts, CASE WHEN date_trunc('day', ts) + INTERVAL 8 HOUR <= ts THEN date_trunc('day', ts) + INTERVAL 32 HOUR ELSE date_trunc('day', ts) + INTERVAL 8 HOUR END) AS BIGINT) AS wait FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def q53_next_digest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    return rows.select("event_id", big(dates.seconds_until(F.col("ts"), 8)).alias("wait"))


@query("SELECT page_id, CASE WHEN length(trim(html)) < 20 THEN 'OCR ' || page_id ELSE trim(html) END AS body FROM pages")
def q54_text_layer(spark, sf_dir):
    i = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", urls.page_text(F.col("html"), F.concat(F.lit("OCR "), i.cast("string"))).alias("body"))


@query("""WITH s AS (SELECT page_id, 0 AS part, url AS s FROM pages UNION ALL SELECT page_id, 1, 'ftp' || substr(url, 5) FROM pages UNION ALL SELECT page_id, 2, CAST(page_id AS VARCHAR) FROM pages UNION ALL SELECT page_id, 3, CASE WHEN page_id % 2 = 0 THEN 'SkiP' ELSE page_id || 'x' END FROM pages)
SELECT page_id, part, part = 0 OR (part = 3 AND page_id % 2 = 0) AS link_ok, part = 2 AS id_ok, page_id || ',' || (page_id + 1) AS allowed FROM s""")
def q55_arguments(spark, sf_dir):
    """What experts may answer and name, over the pages' addresses and ids, changed in several ways."""
    n = F.col("page_id").cast("string")
    forms = F.array(F.col("url"), F.concat(F.lit("ftp"), F.substr("url", F.lit(5))), n, F.when(F.col("page_id") % 2 == 0, "SkiP").otherwise(F.concat(n, F.lit("x"))))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(forms).alias("part", "s"))
    ids = urls.allow_list(F.concat_ws(",", F.concat(F.lit(" "), n), F.lit(""), F.lit(" "), (F.col("page_id") + 1).cast("string")))
    return rows.select("page_id", "part", urls.link_ok(F.col("s")).alias("link_ok"), urls.id_ok(F.col("s")).alias("id_ok"), F.array_join(ids, ",").alias("allowed"))


# --- experts' actions -------------------------------------------------------------------------------

_EXPERTS = [10, 11, 12, 13, 14, 15]
_ACTED: dict[tuple[str, str], Store] = {}


def _acts(spark, sf_dir):
    """Orders as stored signals, and events as what experts said and sent about them, in three batches.

    The versions are compacted before the last batch, which changes nothing. The store is made once in a session.
    """
    known = (spark.sparkContext.applicationId, sf_dir)
    if known in _ACTED and _ACTED[known].batches("verdicts"):
        return _ACTED[known]
    stamp = lambda c: F.to_utc_timestamp(F.col(c).cast("timestamp_ntz").cast("timestamp"), "UTC")
    status = F.create_map(*[F.lit(x) for x in ("O", "new", "P", "in_progress", "F", "sent_to_agent")])[F.col("o_orderstatus")]
    signals = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderpriority").alias("measure_id"), stamp("o_orderdate").alias("created_at"), stamp("o_orderdate").alias("updated_at"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("http://old.a.ru/"), F.col("o_orderkey"))).alias("npa_link"),
    )
    k = F.get_json_object("props", "$.k").cast("int")
    about = F.when(k == 0, F.col("event_id") + 100_000_000).otherwise(F.col("user_id") * 8 + k % 8)
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 7 + 10).alias("user_id"), stamp("ts").alias("at"), "event_type", k.alias("k"), about.alias("signal_id"))
    events = kept(events, "events")  # read, with its JSON, once for all batches
    id_ = F.col("signal_id").cast("string")
    data = (
        F.when(F.col("event_type") == "view", F.format_string("sig:%s:work", id_))
        .when(F.col("event_type") == "click", F.format_string("sig:%s:later", id_))
        .when(F.col("event_type") == "error", F.format_string("rej:%s:%s", id_, F.element_at(F.array(F.lit("r_dup"), F.lit("r_other"), F.lit("r_bad")), F.col("k") % 3 + 1)))
        .when(F.col("k") % 2 == 0, F.format_string("/complete %s", id_))
        .otherwise(F.format_string("/reopen %s", id_))
    )
    link = F.element_at(F.array(F.lit("skip"), F.lit("ftp://a.ru/x"), F.lit("http://bad.ru/x"), F.lit("http://w.a.ru/gone"), F.format_string(" http://w.a.ru/%d ", F.col("k"))), F.col("k") % 5 + 1)
    said = events.where("event_type <> 'purchase'").select("request_id", "user_id", "at", data.alias("data"), F.when(F.col("k") % 3 == 1, F.format_string(" c%d ", F.col("k"))).alias("comment"))
    sent = events.where("event_type = 'purchase'").select("request_id", "user_id", "at", "signal_id", link.alias("text"))
    pages = events.select(F.format_string("http://w.a.ru/%d", F.col("k")).alias("url")).distinct().withColumn("ok", F.lit(True)).unionByName(spark.range(1).select(F.lit("http://w.a.ru/gone").alias("url"), F.lit(False).alias("ok")))
    pages = kept(pages, "pages")
    domains = spark.createDataFrame([("a.ru",)], "domain string")
    store = Store(spark, new_folder(spark, "acts"))
    store.write(1, {"signals": signals})
    days = ["2024-01-01", "2024-01-11", "2024-01-21", "2100-01-01"]
    for batch, (begin, end) in enumerate(zip(days, days[1:], strict=False), 2):
        part = (F.col("at") >= F.lit(begin).cast("timestamp")) & (F.col("at") < F.lit(end).cast("timestamp"))
        actions.run(store, batch, said.where(part), sent.where(part), pages, domains, _EXPERTS)
        if batch == 3:
            store.compact("signals", batch)
    _ACTED[known] = store
    return store


_ACTS = f"""WITH RECURSIVE e AS (SELECT event_id AS request_id, 10 + user_id % 7 AS who, ts, event_type AS t, k, CASE WHEN k = 0 THEN event_id + 100000000 ELSE user_id * 8 + k % 8 END AS sid FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
o AS (SELECT o_orderkey AS sid, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'P' THEN 'in_progress' WHEN 'F' THEN 'sent_to_agent' END AS status, o_orderpriority AS measure_id, o_orderdate AS moment, CASE WHEN o_orderkey % 3 = 0 THEN 'http://old.a.ru/' || o_orderkey END AS link FROM orders),
r AS (SELECT e.*, row_number() OVER (PARTITION BY e.sid ORDER BY ts, request_id) AS n,
  CASE t WHEN 'view' THEN 'in_progress' WHEN 'click' THEN 'postponed' WHEN 'purchase' THEN 'sent_to_agent' WHEN 'error' THEN CASE WHEN k % 3 < 2 THEN 'rejected' END ELSE CASE WHEN k % 2 = 0 THEN 'completed' ELSE 'new' END END AS wanted,
  CASE WHEN who = 16 THEN 'access' WHEN t = 'error' AND k % 3 = 2 THEN 'format' WHEN t = 'purchase' AND k % 5 = 1 THEN 'link' WHEN t = 'purchase' AND k % 5 = 2 THEN 'domain' WHEN t = 'purchase' AND k % 5 = 3 THEN 'unreachable' WHEN o.sid IS NULL THEN 'missing' END AS err
  FROM e LEFT JOIN o USING (sid)),
m(a, b) AS (VALUES {_MOVES}),
s AS (SELECT sid, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS wanted, CAST(NULL AS VARCHAR) AS err, CAST(NULL AS VARCHAR) AS before, false AS good, status, link, CAST(NULL AS VARCHAR) AS why, CAST(NULL AS VARCHAR) AS said, moment, 0 AS audited FROM o
  UNION ALL SELECT s.sid, r.n, r.request_id, r.wanted, r.err, s.status, m.a IS NOT NULL, CASE WHEN m.a IS NULL THEN s.status ELSE r.wanted END,
    CASE WHEN m.a IS NOT NULL AND r.t = 'purchase' AND r.k % 5 = 4 THEN 'http://w.a.ru/' || r.k ELSE s.link END,
    CASE WHEN m.a IS NULL OR r.wanted NOT IN ('rejected', 'new') THEN s.why WHEN r.wanted = 'rejected' THEN CASE WHEN r.k % 3 = 0 THEN 'duplicate' ELSE 'other' END END,
    CASE WHEN m.a IS NULL OR r.wanted NOT IN ('rejected', 'new') THEN s.said WHEN r.wanted = 'rejected' AND r.k % 3 = 1 THEN 'c' || r.k END,
    CASE WHEN m.a IS NULL THEN s.moment ELSE r.ts END, s.audited + CASE WHEN m.a IS NULL THEN 0 ELSE 1 END
  FROM s JOIN r ON r.sid = s.sid AND r.n = s.n + 1 LEFT JOIN m ON m.a = s.status AND m.b = r.wanted AND r.err IS NULL)
"""


@query(_ACTS + """SELECT request_id, good AS accepted, CASE WHEN err IS NULL THEN before END AS from_status, wanted AS to_status, coalesce(err, CASE WHEN NOT good THEN 'transition' END) AS error FROM s WHERE n > 0
UNION ALL SELECT request_id, false, NULL, wanted, err FROM r WHERE sid NOT IN (SELECT sid FROM o)""")
def q56_actions(spark, sf_dir):
    """Buttons, commands and links of experts about stored signals, each with its stored verdict."""
    return _acts(spark, sf_dir).read("verdicts").select("request_id", "accepted", "from_status", "to_status", "error")


@query(_ACTS + "SELECT sid AS id, status, link AS npa_link, why AS rejection_reason, said AS rejection_comment, strftime(moment, '%Y-%m-%d %H:%M:%S') AS updated_at, CAST(audited AS BIGINT) AS audited FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY n DESC) AS z FROM s) WHERE z = 1")
def q57_applied(spark, sf_dir):
    """The stored signals after all batches, with the number of their audit rows."""
    store = _acts(spark, sf_dir)
    audited = store.read("status_history").groupBy(F.col("signal_id").alias("id")).agg(F.count(F.lit(1)).alias("audited"))
    rows = store.read("signals").join(audited, "id", "left")
    return rows.select("id", "status", "npa_link", "rejection_reason", "rejection_comment", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), F.coalesce("audited", F.lit(0)).alias("audited"))


@query(_ACTS + "SELECT s.sid AS signal_id, measure_id, s.link AS npa_link FROM s JOIN o ON o.sid = s.sid WHERE good AND wanted = 'sent_to_agent'")
def q58_outbox(spark, sf_dir):
    """What the batches handed to the next agent."""
    return _acts(spark, sf_dir).read("outbox")


@query(_ACTS + "SELECT s.sid AS signal_id, measure_id, s.link AS npa_link FROM s JOIN o ON o.sid = s.sid WHERE good AND wanted = 'sent_to_agent'")
def q61_delivered(spark, sf_dir):
    """The outbox of all batches as the next agent finds it: delivered by the sink, one batch twice."""
    store, folder = _acts(spark, sf_dir), new_folder(spark, "delivered")
    for batch in (*store.batches("outbox"), 4):
        outbox.deliver(spark.read.schema(TABLES["outbox"]).parquet(store.path("outbox", batch)), folder, batch)
    return outbox.delivered(spark, folder, TABLES["outbox"])


def _anchors(html: str) -> list[tuple[str, str]]:
    return re.findall(r'<a href="([^"]*)">([^<]*)</a>', html)


@query("""SELECT page_id, CAST(k - 1 AS INTEGER) AS ord, l.href, l.said FROM (SELECT page_id, unnest(a) AS l, generate_subscripts(a, 1) AS k FROM
  (SELECT page_id, list_transform(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), lambda x: regexp_extract(x, '<a href="([^"]*)">([^<]*)</a>', ['href', 'said'])) AS a FROM pages))""")
def q60_page_links(spark, sf_dir):
    """The links of all pages, by a reader of one's own as a table function."""
    hooks.register_reader(spark, "page_links", _anchors, "href string, said string")
    return hooks.read_with(spark, "page_links", spread(table(spark, sf_dir, "pages").select("page_id", "html"))).select("page_id", "ord", "href", "said")


@query("""SELECT DISTINCT user_id || '/' || k AS doc_url FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts FROM events) e WHERE ts >= TIMESTAMP '2024-01-05'
  AND NOT EXISTS (SELECT 1 FROM events s WHERE s.ts < TIMESTAMP '2024-01-05' AND s.user_id = e.user_id AND CAST(json_extract_string(s.props, '$.k') AS INTEGER) = e.k)""")
def q62_unseen_by_filters(spark, sf_dir):
    """Addresses that none of the stored days before has, told by the days' filters first."""
    url = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.get_json_object("props", "$.k"))
    rows = table(spark, sf_dir, "events").select(url.alias("doc_url"), F.to_utc_timestamp(F.col("ts").cast("timestamp_ntz").cast("timestamp"), "UTC").alias("at"))
    store = Store(spark, new_folder(spark, "seen"))
    day = lambda k: F.lit(f"2024-01-{k:02}").cast("timestamp")
    for batch in range(1, 5):
        part = rows.where((F.col("at") < day(batch + 1)) & (F.col("at") >= day(batch) if batch > 1 else F.lit(True))).select("doc_url").distinct()
        store.write(batch, {"documents_seen": part, "seen_filters": seen.bloom_rows(part, "doc_url", part.count())})
    return seen.unseen(store, rows.where(F.col("at") >= day(5)).select("doc_url").distinct(), "doc_url")
