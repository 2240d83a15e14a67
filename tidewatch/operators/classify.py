"""Rule-based classification of publications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.catalog import EVENT_ORDER, Catalog
from tidewatch.functions.textmatch import contains_any, find_matches, first_match, keyword_hits, matches, publication_text
from tidewatch.functions.urls import source_domain


def categories(lower: Column, catalog: Catalog) -> Column:
    """The categories with a match, in catalog order."""
    return F.array_compact(F.array(*[F.when(contains_any(lower, words), F.lit(name)) for name, words in catalog.situations.items()]))


def is_relevant(lower: Column, catalog: Catalog) -> Column:
    every = tuple(w for words in catalog.situations.values() for w in words)
    return contains_any(lower, every) & contains_any(lower, catalog.topic)


def event_type(lower: Column, catalog: Catalog) -> Column:
    return first_match(lower, [(name, catalog.events.get(name, ())) for name in EVENT_ORDER], "review")


def region(source_key: Column, catalog: Catalog) -> Column:
    """The first region that lists the source's very domain, 'rf' for federal ones, else 'undefined'.

    The catalog is a bounded constant, so the lookup is a literal map instead of a join.
    """
    table: dict[str, str] = {}
    for code, sources in catalog.regions:
        for source in sources:
            table.setdefault(source.domain, code)
    for source in catalog.federal:
        table.setdefault(source.domain, "rf")
    if not table:
        return F.lit("undefined")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), source_domain(source_key)), F.lit("undefined"))


def region_by_join(rows: DataFrame, regional: DataFrame, federal: DataFrame) -> DataFrame:
    """The same from tables: regional (domain, code, ord), federal (domain); adds ``region``."""
    first = regional.groupBy("domain").agg(F.min_by("code", "ord").alias("code"))
    keyed = rows.withColumn("domain", source_domain(F.col("source_key")))
    return (
        keyed.join(first, "domain", "left")
        .join(federal.select("domain").distinct().withColumn("federal", F.lit(True)), "domain", "left")
        .withColumn("region", F.coalesce("code", F.when(F.col("federal"), F.lit("rf")), F.lit("undefined")))
        .drop("code", "federal", "domain")
    )


def priority(lower: Column, where: Column, catalog: Catalog) -> Column:
    return (
        F.when(~contains_any(lower, catalog.markers), "low")
        .when(where == "undefined", "medium")
        .when(contains_any(lower, catalog.high), "high")
        .otherwise("medium")
    )


def classify(rows: DataFrame, catalog: Catalog, title: str = "title", summary: str | None = "summary", source_key: str = "source_key") -> DataFrame:
    """rows with categories, is_relevant, event_type, region and priority."""
    text = publication_text(F.col(title), F.col(summary) if summary else F.lit(None).cast("string"))
    return (
        rows.withColumn("lower__", F.lower(text))
        .withColumn("categories", categories(F.col("lower__"), catalog))
        .withColumn("is_relevant", (F.size("categories") > 0) & contains_any(F.col("lower__"), catalog.topic))
        .withColumn("event_type", event_type(F.col("lower__"), catalog))
        .withColumn("region", region(F.col(source_key), catalog))
        .withColumn("priority", priority(F.col("lower__"), F.col("region"), catalog))
        .drop("lower__")
    )


def explain(rows: DataFrame, catalog: Catalog, title: str = "title", summary: str | None = "summary", source_key: str = "source_key") -> DataFrame:
    """classify() with a struct ``trace`` of the matched keywords and their line of text ``trace_line``."""
    text = publication_text(F.col(title), F.col(summary) if summary else F.lit(None).cast("string"))
    found = rows.withColumn("lower__", F.lower(text)).withColumn(
        "trace",
        F.struct(
            F.map_filter(
                F.map_from_arrays(F.array(*[F.lit(k) for k in catalog.situations]), F.array(*[find_matches(F.col("lower__"), v) for v in catalog.situations.values()])), lambda _, v: F.size(v) > 0
            ).alias("categories"),
            find_matches(F.col("lower__"), catalog.topic).alias("topic"),
            find_matches(F.col("lower__"), catalog.markers).alias("markers"),
            find_matches(F.col("lower__"), catalog.high).alias("high"),
            F.map_filter(
                F.map_from_arrays(F.array(*[F.lit(k) for k in EVENT_ORDER]), F.array(*[find_matches(F.col("lower__"), catalog.events.get(k, ())) for k in EVENT_ORDER])), lambda _, v: F.size(v) > 0
            ).alias("events"),
        ),
    )
    some = lambda words: F.size(words) > 0
    t = F.col("trace")
    first = reduce(lambda rest, name: F.when(F.map_contains_key(t["events"], F.lit(name)), F.lit(name)).otherwise(rest), reversed(EVENT_ORDER), F.lit("review"))
    done = (
        found.drop("lower__")
        .withColumn("categories", F.map_keys(t["categories"]))
        .withColumn("is_relevant", some(F.col("categories")) & some(t["topic"]))
        .withColumn("event_type", first)
        .withColumn("region", region(F.col(source_key), catalog))
        .withColumn("priority", F.when(~some(t["markers"]), "low").when(F.col("region") == "undefined", "medium").when(some(t["high"]), "high").otherwise("medium"))
    )
    return done.withColumn("trace_line", trace_line(F.col("trace"), F.col("is_relevant"), F.col("event_type"), F.col("region"), F.col("priority")))


def quoted(words: Column) -> Column:
    return F.concat(F.lit("'"), F.array_join(words, ", "), F.lit("'"))


def trace_line(trace: Column, relevant: Column, event: Column, where: Column, rank: Column) -> Column:
    """The decision in one line; segments without matches are left out."""
    cats = F.array_join(F.transform(F.map_entries(trace["categories"]), lambda e: F.concat(e["key"], F.lit(" (по "), quoted(e["value"]), F.lit(")"))), ", ")
    return F.concat_ws(
        " | ",
        F.concat(F.lit("ЖС: "), F.when(F.size(trace["categories"]) > 0, cats).otherwise("нет совпадений")),
        F.when(F.size(trace["topic"]) > 0, F.concat(F.lit("тематический блок: да ("), quoted(trace["topic"]), F.lit(")"))).otherwise("тематический блок: нет совпадений"),
        F.when(relevant, "РЕЛЕВАНТНО").otherwise("не релевантно"),
        F.when(F.size(trace["markers"]) > 0, F.concat(F.lit("маркер документа: "), quoted(trace["markers"]))),
        F.when(F.size(trace["high"]) > 0, F.concat(F.lit("слово приоритета: "), quoted(trace["high"]))),
        F.concat(F.lit("тип события: "), event, F.lit("; регион: "), where, F.lit("; приоритет: "), rank),
    )


#: Keywords up to which a table of them becomes part of the plan.
FOLDED = 256


def keyword_counts(rows: DataFrame, keywords: DataFrame, key: str, text: str = "text") -> DataFrame:
    """grp, keyword, n: the rows (with a unique key) whose text holds each keyword of a table (grp, keyword).

    A small table becomes conditions on the scan, a larger one is joined by its stems; neither compares every text with every keyword's pattern.
    """
    few = keywords.select("grp", "keyword").distinct().limit(FOLDED + 1).collect()
    if len(few) <= FOLDED:
        lower = rows.select(F.lower(text).alias("lower"))
        counts = lower.agg(F.array(*[F.count_if(matches(F.col("lower"), k.keyword)) for k in few] or [F.lit(0).cast("bigint")]).alias("all"))
        names = F.array(*[F.struct(F.lit(k.grp).alias("grp"), F.lit(k.keyword).alias("keyword")) for k in few]) if few else F.expr("cast(array() as array<struct<grp:string,keyword:string>>)")
        return counts.select(F.posexplode(names).alias("i", "k"), "all").select("k.grp", "k.keyword", F.col("all")[F.col("i")].alias("n"))
    counts = keyword_hits(rows, keywords, key, text).groupBy("grp", "keyword").agg(F.count(F.lit(1)).alias("n"))
    return keywords.select("grp", "keyword").distinct().join(counts, ["grp", "keyword"], "left").select("grp", "keyword", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
