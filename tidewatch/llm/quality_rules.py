"""Quality rules: per-document word rules and cross-document line frequency, DataFrame functions only.

Words are runs of anything but ASCII white space. The word rules fail a document with fewer than
``MIN_WORDS`` words, or whose words lie by more than half in three-word windows found twice or more in it.

Lines are normalised (lower case, runs of white space as one blank, digits as 0, ends trimmed) and hashed. For
each host (``source``) a line's documents are counted by distinct content, so exact copies count
once. A line in more than ``max(MIN_DOCS, MAX_SHARE * contents of the host)`` of them is removed, wherever it stands. A
document with less than ``MIN_LEFT`` of its words left is depleted and rejected. ``judge`` counts, ``keep`` selects
documents as they are, ``clean`` selects them and takes the removed lines out of their texts.

Edited copies count as documents of their own: a family of them that makes up more than the share of its host loses the lines it
has in common, as the pages of one template do. Near-duplicates of smaller families keep their lines; finding those is ``minhash``'s work.

Defined cases: a null text has no words (base fails); a null source is a host of its own; a null
doc_id is a document like any other; a line exactly at the limit stays, and so does a document with exactly ``MIN_LEFT`` left; repeated rows give
repeated results; empty tables give no rows; columns other than doc_id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACE_CLASS, SPACES, Scratch, unused

MIN_WORDS = 50
MAX_REPEATED = 50
SYMBOLS = "#*$%&|<>"
MIN_DOCS = 20
MAX_SHARE = 0.1
MIN_LEFT = 0.3


def count_words(text: Column) -> Column:
    """The number of words, without making them."""
    padded = F.concat(F.lit(" "), F.translate(text, SPACES, " " * len(SPACES)))
    return F.regexp_count(padded, F.lit(" [^ ]"))


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: the counts of the word rules, and its distinct normalised lines with their words."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        "doc_id",
        "source",
        F.xxhash64(text).alias("content"),
        F.filter(F.split(text, SPACE_CLASS), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "").alias("lines"),
        F.length(F.translate(text, SPACES, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
    )
    windows = split.select(
        "doc_id",
        "source",
        "content",
        F.size("words").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(
            F.size("words") > 3,
            F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")).alias("triples"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), count_words(x).alias("w"))).alias("lines"),
    )
    # windows found twice or more: sorted by hash, equal ones are neighbours; then back by place
    sorted_windows = windows.withColumn(
        "placed",
        F.when(
            F.size(F.array_distinct("triples")) < F.size("triples"),
            F.array_sort(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)")),
    )
    repeated = sorted_windows.withColumn(
        "places",
        F.array_sort(
            F.transform(
                F.filter("placed", lambda p, k: (p["h"] == F.get("placed", k - 1)["h"]).eqNullSafe(True) | (p["h"] == F.get("placed", k + 1)["h"]).eqNullSafe(True)),
                lambda p: p["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - p, F.lit(3)))), F.lit(0), lambda acc, x: acc + x
    )
    counted = repeated.select("doc_id", "source", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "lines")
    return counted.select(
        "doc_id",
        "source",
        "content",
        *[F.col(c).cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ((F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)).alias("base_failed"),
        "lines",
    )


def normal_line(line: Column) -> Column:
    """Lower case, white space runs as one blank, digits as 0, ends trimmed."""
    return F.translate(F.regexp_replace(F.lower(F.trim(F.translate(line, SPACES, " " * len(SPACES)))), " {2,}", " "), "123456789", "000000000")


def frequent_lines(measured: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Lines to remove: host, h, docs (the host's contents with the line)."""
    held = measured.select(F.col("source").alias("host"), "content", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).distinct()
    often = held.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > min_docs)
    hosts = measured.select(F.col("source").alias("of"), "content").distinct().groupBy("of").agg((F.count(F.lit(1)) * max_share).alias("limit"))
    return often.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("docs") > F.col("limit")).select("host", "h", "docs")


def judge_contents(docs: DataFrame, min_docs: int, max_share: float, min_left: float) -> DataFrame:
    """The rows of judge(), with the host and the hash of the text that the verdict belongs to, and the hashes of the lines to remove."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    measured = scratch.keep(measure(docs))
    remove = scratch.keep(frequent_lines(measured, min_docs, max_share))
    lost = (
        measured.select(F.col("source").alias("host"), "content", F.explode("lines").alias("l"))
        .alias("a")
        .join(remove.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("a.l.h") == F.col("b.h")), "left_semi")
        .select("host", "content", F.struct("l.h", "l.w").alias("l"))
    )
    # the same content comes once per row: divided by its rows, the sums are those of one row
    removed = lost.groupBy("host", "content").agg(F.count(F.lit(1)).alias("removed_rows"), F.sum("l.w").alias("removed_words"), F.sort_array(F.collect_set("l.h")).alias("gone"))
    rows = measured.groupBy("source", "content").agg(F.count(F.lit(1)).alias("copies"))
    removed = (
        removed.alias("a")
        .join(rows.alias("b"), F.col("a.host").eqNullSafe(F.col("b.source")) & (F.col("a.content") == F.col("b.content")))
        .select("a.host", "a.content", F.expr("removed_rows div copies").alias("n_removed_lines"), F.expr("removed_words div copies").alias("removed_words"), "gone")
    )
    return verdicts(measured, removed, min_left)


def verdicts(measured: DataFrame, removed: DataFrame, min_left: float) -> DataFrame:
    return (
        measured.drop("lines")
        .alias("a")
        .join(removed.alias("b"), F.col("a.source").eqNullSafe(F.col("b.host")) & (F.col("a.content") == F.col("b.content")), "left")
        .select(
            "doc_id",
            "a.source",
            "a.content",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            F.coalesce("n_removed_lines", F.lit(0)).cast("bigint").alias("n_removed_lines"),
            (F.col("n_words") - F.coalesce("removed_words", F.lit(0))).cast("bigint").alias("n_words_left"),
            "gone",
        )
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words_left") >= F.col("n_words") * min_left))
    )


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, the counts, base_failed, n_removed_lines, n_words_left, kept: a row for each row of docs."""
    return judge_contents(docs, min_docs, max_share, min_left).drop("source", "content", "gone")


def verdict_of(docs: DataFrame, judged: DataFrame, how: str) -> tuple[DataFrame, str, str]:
    """docs joined with the verdicts on their contents, and the names that kept and gone have there."""
    host, content, kept, gone = unused(docs, "host", "content", "kept", "gone")
    marks = judged.select(F.col("source").alias(host), F.col("content").alias(content), F.col("kept").alias(kept), F.col("gone").alias(gone)).distinct()
    return docs.join(marks, F.col("source").eqNullSafe(F.col(host)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(content)), how), kept, gone


def keep(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    return verdict_of(docs, judge_contents(docs, min_docs, max_share, min_left).where(~F.col("kept")), "left_anti")[0]


def without_lines(text: Column, gone: Column) -> Column:
    """text without the lines whose hashes are in gone; blank lines stay."""
    blank = lambda x: F.translate(x, SPACES, "") == ""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: blank(x) | ~F.array_contains(gone, F.xxhash64(normal_line(x)))), "\n")


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The rows that keep() gives, with the frequent lines taken out of their texts; the words left are n_words_left."""
    found, kept, gone = verdict_of(docs, judge_contents(docs, min_docs, max_share, min_left).where(~F.col("kept") | F.col("gone").isNotNull()), "left")
    text = F.when(F.col(gone).isNotNull(), without_lines(F.col("text"), F.col(gone))).otherwise(F.col("text"))
    return found.where(F.coalesce(kept, F.lit(True))).withColumn("text", text).select(*docs.columns)
