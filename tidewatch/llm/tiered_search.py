"""Ranked lexical search over a tiered index: high-impact postings first, lower tiers only where exactness isn't proven.

The documents are dealt over shards of about ``SHARD_TERMS`` terms. A shard's postings of a term are sorted by impact (the part of the score that depends on
the document) and cut into tiers: the ``TIERS[0]`` highest, those up to ``TIERS[1]``, ..., the rest. Each stored list knows the highest impact
below it (``rest``), so for a query the terms' weights times their rests bound what a document can gain from tiers that were not read.

A search reads tier 0 of all shards. Partial scores are lower bounds, and the 20th best of an item over all shards is a score that others have to reach.
A shard is settled for an item when every document that could still reach it has its exact score; the others, item by item and shard by shard,
fall through to the next tier. After the last one nothing is left out, so the result is exact for any data.

Items are searched in blocks of about ``BLOCK_TERMS`` weighted terms, which bounds what is sent to the tasks; the index is as large as the postings, and
each of its groups is as large as a shard. All terms of all documents are indexed.

Defined cases: a text without a term, or null, is no candidate and does not count in N; repeated rows are documents of their own; equal scores rank by doc_id, null ids last;
an item's rows with equal text count once, those with different texts are one item with the terms of all; items without terms
that any document holds have no rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on the bytes of lower-cased UTF-8.
_TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 20
TIERS = (64, 512)
SHARD_TERMS = 2_000_000
BLOCK_TERMS = 200_000

_INDEX = "shard bigint, tier int, term string, rest bigint, places array<int>, impacts array<int>, docs array<bigint>"
_FOUND = "item int, shard bigint, settled boolean, doc_id bigint, score bigint"


@dataclass(frozen=True)
class Index:
    """Where the lists lie (a folder for each tier; -1 has the shards' doc_ids), and the documents' statistics."""

    spark: SparkSession
    path: str
    n: int
    tiers: int

    def lists(self, tier: int) -> DataFrame:
        """The tiers up to this one."""
        return self.spark.read.schema(_INDEX).parquet(self.path).where(F.col("tier") <= tier)


def impact(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a term with tf occurrences brings a document of n terms, before its weight."""
    m = 100 - 25 + (25 * n * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and their terms."""
    n = terms = 0
    for b in batches:
        for text in b["text"].cast(pa.binary()).to_pylist():
            found = len(_TERM_BYTES.findall(text.lower())) if text else 0
            n, terms = n + (found > 0), terms + found
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([terms], pa.int64())], names=["n", "terms"])


def shard_lists(rows: pa.Table, docs: int, terms: int, tiers: tuple[int, ...]) -> pa.Table:
    """The lists of one shard from its rows (shard, doc_id, text)."""
    vocabulary: dict[bytes, int] = defaultdict(count().__next__)
    codes, sizes = [], np.zeros(rows.num_rows, np.int64)
    for k, text in enumerate(rows["text"].cast(pa.binary()).to_pylist()):
        found = _TERM_BYTES.findall(text.lower()) if text else ()
        sizes[k] = len(found)
        codes.append(np.fromiter((vocabulary[t] for t in found), np.int64, len(found)))
    width = max(1, rows.num_rows)
    pairs, tf = np.unique(np.concatenate([c * width + k for k, c in enumerate(codes)] or [np.zeros(0, np.int64)]), return_counts=True)
    term, place = pairs // width, pairs % width
    value = impact(tf.astype(np.int64), sizes[place], docs, max(1, terms))
    order = np.lexsort((place, -value, term))
    term, place, value = term[order], place[order], value[order]
    fresh = np.flatnonzero(np.diff(term, prepend=-1))
    rank = np.arange(len(term)) - np.repeat(fresh, np.diff(np.append(fresh, len(term))))
    tier = np.searchsorted(np.array(tiers), rank, side="right")
    starts = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(tier, prepend=-1) != 0))
    ends = np.append(starts[1:], len(term))[: len(starts)]
    goes_on = np.append(term[starts[1:]] == term[starts[:-1]], [False])[: len(starts)]
    rest = np.zeros(len(starts), np.int64)
    rest[goes_on] = value[ends[goes_on]]
    names = pa.array(list(vocabulary), pa.binary()).cast(pa.string())
    shard = rows["shard"][0].as_py()
    offsets = pa.array(np.append(np.append(starts, len(term)), len(term)).astype(np.int32))  # and an empty list for the row of doc_ids
    ids = rows["doc_id"].combine_chunks()
    n = len(starts)
    return pa.table(
        {
            "shard": pa.array(np.full(n + 1, shard), pa.int64()),
            "tier": pa.array(np.append(tier[starts], -1), pa.int32()),
            "term": pa.concat_arrays([names.take(pa.array(term[starts])), pa.array([""], pa.string())]),
            "rest": pa.array(np.append(rest, 0), pa.int64()),
            "places": pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32())),
            "impacts": pa.ListArray.from_arrays(offsets, pa.array(value, pa.int32())),
            "docs": pa.ListArray.from_arrays(pa.array(np.append(np.zeros(n + 1), len(ids)).astype(np.int32)), ids),
        }
    )


def build(docs: DataFrame, scratch: Scratch, tiers: tuple[int, ...] = TIERS, shard_terms: int = SHARD_TERMS) -> Index:
    """Index all documents (doc_id, text)."""
    spark = docs.sparkSession
    n, terms = docs.select("text").mapInArrow(term_counts, "n bigint, terms bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    shards = max(1, math.ceil(terms / shard_terms))
    # by row, not by id: no id can make a shard large; a scan's rows have the same numbers when a task is repeated
    dealt = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias("shard"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    made = dealt.groupBy("shard").applyInArrow(lambda rows: shard_lists(rows, n, terms, tiers), _INDEX)
    path = f"{scratch.root}/index"
    made.write.partitionBy("tier").mode("overwrite").parquet(path)
    return Index(spark, path, n, len(tiers) + 1)


def weighted(items: DataFrame, index: Index) -> DataFrame:
    """item_id, term, weight (that of the term, times its occurrences in the item) of terms that documents hold."""
    told = items.select("item_id", "text").distinct().select("item_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))).alias("term"))
    asked = told.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))
    df = index.lists(index.tiers).where("tier >= 0").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n + 2) / (2 * F.col("df") + 1))).cast("bigint")
    return asked.join(df, "term").select("item_id", "term", (weight * F.col("times")).alias("weight")).where("weight > 0")


class Shard:
    """A shard's lists for a search, read from the rows of its tiers."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        tier, term, rest = rows["tier"].to_pylist(), rows["term"].to_pylist(), rows["rest"].to_pylist()
        places, impacts, docs = (rows[c].combine_chunks() for c in ("places", "impacts", "docs"))
        at = [x.offsets.to_numpy() for x in (places, impacts, docs)]
        flat = [x.values.to_numpy(zero_copy_only=False) for x in (places, impacts)]
        self.lists: dict[str, list] = {}
        self.ids = np.zeros(0, np.int64)
        for k in sorted(range(len(tier)), key=lambda k: tier[k]):
            if tier[k] < 0:
                ids = docs.values[at[2][k] : at[2][k + 1]]
                self.ids, self.null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            else:
                self.lists.setdefault(term[k], []).append((flat[0][at[0][k] : at[0][k + 1]], flat[1][at[1][k] : at[1][k + 1]].astype(np.int64), rest[k]))

    def search(self, terms: list[tuple[str, int]], reach: int, top: int) -> tuple[bool, np.ndarray, np.ndarray]:
        """Whether the item is settled here, the places of its best documents and their scores (lower bounds if it isn't); reach: a score that ``top`` documents have."""
        score, credit, whole = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64), 0
        for term, weight in terms:
            lists = self.lists.get(term, ())
            rest = weight * lists[-1][2] if lists else 0
            whole += rest
            for place, value, _ in lists:  # a place comes once in the lists of a term
                score[place] += weight * value
                credit[place] += rest
        known = score[score > 0]
        if len(known) >= top:
            reach = max(reach, int(np.partition(known, -top)[-top]))
        reach = max(reach, 1)
        open_ = whole - credit
        settled = not ((open_ > 0) & (score + open_ >= reach)).any()
        good = np.flatnonzero((score >= reach) & (open_ == 0)) if settled else np.flatnonzero(score > 0)
        best = good[np.lexsort((self.ids[good], self.null[good], -score[good]))[:top]]
        return settled, best, score[best]


def searched(shard: int, rows: pa.Table, wanted: dict[int, int] | None, items: list[list[tuple[str, int]]], top: int) -> pa.Table:
    """Settled and open items of a shard; wanted: the items to search with the scores to reach, all if None."""
    here = Shard(rows)
    out: list[tuple] = []
    for item, reach in (wanted.items() if wanted is not None else ((k, 0) for k in range(len(items)))):
        if not len(here.ids):
            continue
        settled, best, score = here.search(items[item], reach, top)
        ids = [None if here.null[b] else int(here.ids[b]) for b in best]
        out += [(item, shard, settled, d, int(s)) for d, s in zip(ids, score, strict=True)]
        if not settled and not ids:
            out.append((item, shard, False, None, None))
    kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
    columns = list(zip(*out, strict=True)) or [()] * len(kinds)
    return pa.table({c.split(" ")[0]: pa.array(v, kind) for c, v, kind in zip(_FOUND.split(", "), columns, kinds, strict=True)})


def search_block(index: Index, items: list[list[tuple[str, int]]], scratch: Scratch, top: int = TOP) -> tuple[DataFrame, list[int]]:
    """The settled rows of all shards (item is the place in the list), and how many pairs of item and shard each tier left open."""
    terms = sorted({t for item in items for t, _ in item} | {""})
    named = F.broadcast(index.spark.createDataFrame([(t,) for t in terms], "term string"))  # at most a block's terms
    settled, left = [], []
    best = Window.partitionBy("item").orderBy(F.desc("score"))

    def first(key: tuple, rows: pa.Table) -> pa.Table:
        return searched(key[0].as_py(), rows, None, items, top)

    def again(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        return searched(key[0].as_py(), rows, dict(zip(asked["item"].to_pylist(), asked["reach"].to_pylist(), strict=True)), items, top)

    found = met = None
    for tier in range(index.tiers):
        lists = index.lists(tier).join(named, "term", "left_semi")
        if tier == 0:
            found = scratch.keep(lists.groupBy("shard").applyInArrow(first, _FOUND))
        else:
            reach = met.where("score IS NOT NULL").withColumn("k", F.row_number().over(best)).where(F.col("k") == top).select("item", F.col("score").alias("reach"))
            asked = scratch.keep(found.where("NOT settled").select("item", "shard").distinct().join(reach, "item", "left").select("item", "shard", F.coalesce("reach", F.lit(0).cast("bigint")).alias("reach")))
            left.append(asked.count())
            if not left[-1]:
                break
            some = lists.join(asked.select("shard").distinct(), "shard", "left_semi")
            found = scratch.keep(some.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(again, _FOUND))
        done = found.where("settled")
        settled.append(done)
        # open lower bounds count only for the pairs of the latest round
        met = done.unionByName(found.where("NOT settled")) if len(settled) == 1 else _union(settled).unionByName(found.where("NOT settled"))
    return _union(settled), left


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, tiers: tuple[int, ...] = TIERS, shard_terms: int = SHARD_TERMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tiered")
    index = build(docs, scratch, tiers, shard_terms)
    weights = scratch.keep(weighted(items, index))
    blocks = max(1, math.ceil(weights.count() / block_terms))
    key = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id bigint, score bigint")
    for block in range(blocks):
        by_item: dict = defaultdict(list)
        for r in weights.where(key == block).collect():  # a block's weighted terms
            by_item[r.item_id].append((r.term, r.weight))
        if not by_item:
            continue
        settled, _ = search_block(index, list(by_item.values()), scratch, top)
        names = spark.createDataFrame(list(enumerate(by_item)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        out = out.unionByName(settled.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))  # a block's items
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
