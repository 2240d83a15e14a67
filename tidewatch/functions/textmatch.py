"""Keyword matching by word stems, as regular expressions that Java, RE2 and Python read alike."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import kept

LEFT = r"(?:^|[^\p{L}\p{N}_])"
TAIL = r"[\p{L}\p{N}_]*"
GAP = r"[\s\p{Z}]+"
END = r"(?:$|[^\p{L}\p{N}_])"
#: Words that match only as they stand.
EXACT = frozenset({"доброволец"})


def stem(word: str) -> str:
    """Words over five letters lose two, words of four or five lose one."""
    return word[: len(word) - (2 if len(word) > 5 else 1 if len(word) > 3 else 0)]


def keyword_pattern(keyword: str) -> str:
    """The words in order, next to each other, each with any ending; hyphens don't split words."""
    parts = keyword.lower().split()
    out = LEFT
    for k, word in enumerate(parts):
        out += (GAP if k else "") + (re.escape(word) if word in EXACT else re.escape(stem(word)) + TAIL)
    return out + (END if parts and parts[-1] in EXACT else "")


def matches(lower: Column, keyword: str) -> Column:
    """Whether a lower-cased text holds a keyword: its stems are looked for as plain text, and the pattern is tried only where all of them are there."""
    words = keyword.lower().split()
    stems = dict.fromkeys(w if w in EXACT else stem(w) for w in words)
    return reduce(lambda a, b: a & b, [lower.contains(s) for s in stems if s], F.lit(True)) & lower.rlike(keyword_pattern(keyword))


def contains_any(lower: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a lower-cased text holds any of the keywords; false for null and for an empty group."""
    return F.coalesce(reduce(lambda a, b: a | b, [matches(lower, k) for k in keywords]), F.lit(False)) if keywords else F.lit(False)


def find_matches(lower: Column, keywords: tuple[str, ...]) -> Column:
    """The keywords that a lower-cased text holds, in catalog order."""
    if not keywords:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(matches(lower, k), F.lit(k)) for k in keywords]))


def publication_text(title: Column, summary: Column) -> Column:
    """Title, a blank, and the summary if any; null only for a null title."""
    return F.concat(title, F.lit(" "), F.coalesce(summary, F.lit("")))


def first_match(lower: Column, groups: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The first group with a match."""
    return reduce(lambda rest, g: F.when(contains_any(lower, g[1]), F.lit(g[0])).otherwise(rest), reversed(groups), F.lit(default))


WORD = r"[\p{L}\p{N}_]+"
_PIECE = r"([^\p{L}\p{N}_]*)(" + WORD + ")"


def tokens(lower: Column) -> Column:
    """The words of a text with what stands before each: array of (before, token)."""
    return F.arrays_zip(F.regexp_extract_all(lower, F.lit(_PIECE), F.lit(1)).alias("before"), F.regexp_extract_all(lower, F.lit(_PIECE), F.lit(2)).alias("token"))


def keyword_steps(keywords: DataFrame) -> DataFrame:
    """keywords (grp, keyword) as steps: grp, keyword, step, steps, token, whole, before.

    A step wants a word that begins with token (is token where ``whole``), right after the step before, with ``before`` between them; null stands
    for white space. A hyphenated word is several steps. Keywords that are no such sequence, as stems that begin or end with
    other marks, have no steps.
    """
    word = lambda w: F.when(w.isin(*EXACT), w).when(F.length(w) > 5, F.left(w, F.length(w) - 2)).when(F.length(w) > 3, F.left(w, F.length(w) - 1)).otherwise(w)

    def parts(w: Column, i: Column) -> Column:
        found = tokens(word(w))
        return F.transform(found, lambda p, k: F.struct(p["token"].alias("token"), ((k < F.size(found) - 1) | w.isin(*EXACT)).alias("whole"), F.when(k > 0, p["before"]).when(i == 0, F.lit("")).alias("before")))

    words = F.filter(F.split(F.lower("keyword"), r"[\s\p{Z}]+"), lambda w: w != "")
    plain = F.forall(words, lambda w: word(w).rlike(rf"^{WORD}(?:[^\p{{L}}\p{{N}}_]+{WORD})*$")) & (F.size(words) > 0)
    steps = keywords.where(plain).select("grp", "keyword", F.flatten(F.transform(words, parts)).alias("all"))
    return steps.select("grp", "keyword", F.size("all").alias("steps"), F.posexplode("all").alias("step", "s")).select("grp", "keyword", "steps", "step", "s.token", "s.whole", "s.before")


#: Rows of wanted words (a word, a keyword and a step each) that are sent to all executors; some 100 bytes each.
FEW_WORDS = 200_000
#: Parts into which the hits of one of the scan's partitions are dealt.
PARTS_A_SCAN = 4


def keyword_hits(rows: DataFrame, keywords: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, grp, keyword of the keywords (grp, keyword) that each row's text holds, for a table of keywords of any size.

    The texts' words are exploded once. Distinct words meet the steps' stems by equality of prefixes (one key for each length of a stem that there is), and
    only words that some step wants are joined back to their places; the steps of a keyword that stand in order at one place are counted.
    Keywords without steps (see ``keyword_steps``) are not looked for.
    """
    lower = rows.select(F.col(key).alias("key"), F.lower(text).alias("lower"))
    placed = lower.select("key", F.posexplode(tokens(F.col("lower"))).alias("place", "t")).select("key", "place", "t.before", "t.token")
    steps = keyword_steps(keywords)
    lengths = [r.n for r in steps.select(F.length("token").alias("n")).distinct().collect()]  # at most the length of a word
    vocabulary = lower.select(F.explode(F.regexp_extract_all("lower", F.lit(WORD), F.lit(0))).alias("token")).distinct()
    prefixes = vocabulary.select("token", F.explode(F.array(*[F.when(F.length("token") >= n, F.left("token", F.lit(n))) for n in lengths] or [F.lit(None).cast("string")])).alias("prefix")).where("prefix IS NOT NULL")
    wanted = prefixes.join(steps.withColumnRenamed("token", "prefix"), "prefix").where("NOT whole OR token = prefix")
    wanted = kept(wanted.withColumnRenamed("before", "needs").drop("prefix", "whole"), "wanted")
    # few distinct words begin with the stems of a usual table: they go to the texts; else the words of the texts are shuffled to them
    met = placed.join(F.broadcast(wanted) if wanted.count() <= FEW_WORDS else wanted, "token")
    space = F.col("before").rlike(r"^[\s\p{Z}]+$")
    fits = met.where((F.col("step") == 0) | F.when(F.col("needs").isNull(), space).otherwise(F.col("before") == F.col("needs")))
    # parts follow the scan's, so that a task's share of the hits stays as it is in a larger table; both groupings below find a text's hits in one part
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), PARTS_A_SCAN * lower.rdd.getNumPartitions())
    fits = fits.select("key", "grp", "keyword", "steps", "place", "step").repartition(parts, "key")
    at_one = fits.groupBy("key", "grp", "keyword", "steps", (F.col("place") - F.col("step")).alias("start")).agg(F.count_distinct("step").alias("met"))
    return at_one.where("met = steps").select("key", "grp", "keyword").distinct().withColumnRenamed("key", key)
