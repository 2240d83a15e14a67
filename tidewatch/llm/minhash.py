"""Near-duplicates by b-bit MinHash with banding, confirmed on full shingle sets.

A document's set is its distinct five-word shingles (words lower-cased in A-Z; a document with fewer words is
one shingle). ``PERMUTATIONS`` minima give ``BANDS`` band keys of ``ROWS`` minima each; of every minimum only ``BITS`` bits
are kept, packed in 64-bit words, and two documents' similarity is estimated from the bits they share,
corrected for chance agreement: ``(match - 2^-b) / (1 - 2^-b)``. Candidates are documents with a band key in
common; an estimate ``SLACK`` below the threshold (over five standard errors) drops them, any other pair is confirmed on both full
sets, ``100 * common >= percent * union``.

No bucket is expanded into pairs. Documents with equal sets are one class, by an exact hash of the set. Then:

1. In each bucket the member that meets most others over all its buckets (of edited copies, their origin) leads; every class is
   tested with its best-estimated leader, and confirmed links merge classes into components.
2. Buckets that still hold several components are settled exactly. Those of at most ``SMALL`` classes are compared pair by pair.
   The classes of a larger one are described by their differences ``D`` from one leader: shingles that only one of the two has. For two classes
   ``a`` and ``b``, ``|a ^ b| = |D_a| + |D_b| - 2 |D_a & D_b|``, so a link asks for a certain number of common differences. It is 0 or
   less only where both are linked with the leader, and those links are known. In all other pairs some difference must be shared:
   differences that nobody else has are put aside, a class that can't reach the number it needs with any partner is
   dropped, the others meet by the rarest of theirs (a prefix long enough that no link is missed).
3. A difference that more than ``HEAVY`` classes would meet by makes a group of its own, which gets its own leader and goes through step 2.

Edits of one origin differ from it by shingles of their own, so they hardly meet, however many there are. The estimate is asked before a pair is
confirmed; no link between different components is left out otherwise, and components are those of all links.

Sets are recomputed from the texts of the pairs at hand, so only signatures of all documents are stored.

Defined cases: null and empty texts, and texts of white space only, have empty sets, n_shingles 0, and
link with nothing; a null doc_id has a null component and is kept; repeated rows (equal doc_id and text) give
repeated results; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, released
from tidewatch.llm.components import components

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 26, 5
PERMUTATIONS = BANDS * ROWS
BITS = 2
SLACK = 0.2
#: Classes in a group that are compared pair by pair.
SMALL = 8
#: Classes that may meet by one difference; more make a group of their own.
HEAVY = 512
#: Pairs with one leader in a task, at most about.
SPLIT = 256
_LANES = 64 // BITS
WORDS = -(-PERMUTATIONS // _LANES)

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

_rng = np.random.default_rng(20240131)
_A = (_rng.integers(1, 1 << 32, PERMUTATIONS, dtype=np.uint64) | 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


_HASHES = WordHashes()


def forget_words() -> None:
    _HASHES.clear()


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    if not text:
        return np.zeros(0, np.uint64)
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    acc = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, np.uint64)
    for i in range(k):
        acc = (acc ^ h[i : i + n]) * _MIX
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def minima(hashes: np.ndarray) -> np.ndarray:
    """PERMUTATIONS minima of a non-empty set, in 32 bits."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    best = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        y = x[k : k + 512, None] * _A
        y ^= y >> np.uint32(15)
        y += _B
        y *= np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(13)
        np.minimum(best, y.min(axis=0), out=best)
    return best


def pack_bits(best: np.ndarray) -> np.ndarray:
    """The low bits of the minima as WORDS signed 64-bit numbers."""
    low = np.zeros(WORDS * _LANES, np.uint64)
    low[:PERMUTATIONS] = best & np.uint32((1 << BITS) - 1)
    return (low.reshape(WORDS, _LANES) << (np.uint64(BITS) * np.arange(_LANES, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_keys(best: np.ndarray) -> np.ndarray:
    acc = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for r in range(ROWS):
        acc = (acc ^ best.reshape(BANDS, ROWS)[:, r].astype(np.uint64)) * _MIX
        acc ^= acc >> np.uint64(31)
    return acc.view(np.int64)


def signatures(docs: DataFrame, text: str, key: str) -> DataFrame:
    """key, n_shingles, set_a and set_b (a 128-bit hash of the set), sig (packed bits), bands; null where the set is empty."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch[text].tolist():
                s = shingles(t)
                if len(s):
                    best = minima(s)
                    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    rows.append((len(s), digest[0], digest[1], pack_bits(best), band_keys(best)))
                else:
                    rows.append((0, 0, 0, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_a", "set_b", "sig", "bands"])
            out.insert(0, key, batch[key].values)
            yield out
        forget_words()

    return docs.select(key, text).mapInPandas(released(run), f"{key} {kind}, n_shingles long, set_a long, set_b long, sig array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures, corrected for chance agreement; bit counts only."""
    differ = F.lit(0)
    for w in range(WORDS):
        x = F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differ = differ + F.bit_count(x)
    match = F.lit(1.0) - differ / float(PERMUTATIONS)
    return (match - 2.0**-BITS) / (1 - 2.0**-BITS)


def compare(pairs: DataFrame, texts: DataFrame, percent: int, differences: bool = False) -> DataFrame:
    """pairs (a, b) with n_a, n_b, whether 100 * common >= percent * union on the full sets, and on demand their differences d.

    Pairs are sent to the texts of a, then, with a's set, to those of b; texts (id, text) travel only for rows that are in a pair. An id that is b in many
    pairs is dealt to several tasks.
    """
    schema = "a long, b long, n_a long, n_b long, linked boolean" + (", d array<long>" if differences else "")

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            last: tuple[object, bytes] = (None, b"")
            found = []
            for k, t in zip(batch["a"].tolist(), batch["text"].tolist(), strict=True):
                last = last if k == last[0] else (k, shingles(t).tobytes())
                found.append(last[1])
            yield batch[["a", "b", "parts"]].assign(hashes=found)

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[object, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            rows = []
            for a, b, h, t in zip(batch["a"].tolist(), batch["b"].tolist(), batch["hashes"].tolist(), batch["text"].tolist(), strict=True):
                if b != last[0]:
                    last = (b, shingles(t))
                x, y = np.frombuffer(h, np.uint64), last[1]
                if differences:
                    d = np.setxor1d(x, y, assume_unique=True)
                    common = (len(x) + len(y) - len(d)) // 2
                    more = (d.view(np.int64),)
                else:
                    common, more = len(np.intersect1d(x, y, assume_unique=True)), ()
                rows.append((a, b, len(x), len(y), 100 * common >= percent * (len(x) + len(y) - common), *more))
            yield pd.DataFrame(rows, columns=["a", "b", "n_a", "n_b", "linked", *["d"] * differences])

    spread = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts"))
    dealt = pairs.select("a", "b").join(spread, "b")
    left = dealt.join(texts.withColumnRenamed("id", "a"), "a").mapInPandas(released(own), "a long, b long, parts int, hashes binary")
    left = left.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    copies = spread.join(texts.withColumnRenamed("id", "b"), "b").select("b", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(copies, ["b", "part"]).select("a", "b", "hashes", "text").mapInPandas(released(met), schema)


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with a < b."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fitting(percent: int) -> Column:
    """Whether two sizes (n, m) allow a link at all."""
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * percent


def small_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components in small groups (gid, rep, n, sig, comp) that sizes and signatures allow."""
    other = groups.select("gid", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("sig").alias("b_sig"), F.col("comp").alias("b_comp"))
    met = groups.withColumnRenamed("rep", "a").join(other, "gid").where((F.col("a") < F.col("b")) & (F.col("comp") != F.col("b_comp")) & fitting(percent))
    return met.where(estimate(F.col("sig"), F.col("b_sig")) >= percent / 100 - SLACK).select("a", "b").distinct()


def meeting(described: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The classes that can be in a link by their differences from a leader, and the differences that they meet by.

    described: a, b (the leader), n_a, n_b, d, as ``compare`` gives them. Returns gid (a hash of leader and difference), rep, n, near, s, v, m, place
    and what members (a row for each rep) tells.
    With ``p = 100 + percent`` and ``q = 100 - percent``: a link is ``p |a ^ b| <= q (n_a + n_b)``, that is ``2 p |D_a & D_b| >= s_a + s_b``
    where ``s = p |D| - q n``; with m differences that others have as well, ``v = 2 p m - s`` bounds the s of partners.
    """
    p, q = 100 + percent, 100 - percent
    told = described.select("a", "b", F.col("n_a").alias("n"), (F.size("d") * p - F.col("n_a") * q).alias("s"), (F.size("d") * p <= (F.col("n_a") + F.col("n_b")) * q).alias("near"), "d")
    spread = told.select("a", "b", F.explode("d").alias("x"))
    common = spread.groupBy("b", "x").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = spread.join(common, ["b", "x"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("xs"))
    rows = told.drop("d").join(shared, ["a", "b"]).withColumn("m", F.size("xs")).withColumn("v", F.col("m") * (2 * p) - F.col("s"))
    # far classes that some partner's bound admits; then near ones that one of these admits
    most = rows.groupBy("b").agg(F.max("v").alias("most"), F.min("s").alias("least"))
    rows = rows.join(most, "b").where("near OR (s <= most AND v >= least)")
    far = rows.where("NOT near").groupBy("b").agg(F.min("s").alias("far"))
    rows = rows.join(far, "b").where("NOT near OR v >= far")
    need = F.greatest(F.lit(1), F.ceil((F.col("s") + F.when(F.col("near"), F.col("far")).otherwise(F.col("least"))) / F.lit(2 * p)))
    rows = rows.withColumn("length", (F.col("m") - need + 1).cast("int")).where("length > 0")
    met = rows.select("a", "b", "n", "s", "v", "m", "near", F.posexplode(F.slice("xs", F.lit(1), F.col("length"))).alias("place", "e"))
    met = met.select(F.xxhash64("b", "e.x").alias("gid"), F.col("a").alias("rep"), "n", "s", "v", "m", "near", "place")
    return met.join(members, "rep")


def difference_pairs(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the classes that meet by a difference, have different components and can reach the differences that they need."""
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("n", "s", "v", "m", "near", "place", "sig", "comp")]
    left, right = met.select("gid", F.col("rep").alias("a"), *side("a")), met.select("gid", F.col("rep").alias("b"), *side("b"))
    rest = F.least(F.col("a_m") - F.col("a_place"), F.col("b_m") - F.col("b_place"))
    fits = (
        (F.col("a") < F.col("b"))
        & (F.col("a_comp") != F.col("b_comp"))
        & ~(F.col("a_near") & F.col("b_near"))
        & (F.col("a_s") <= F.col("b_v"))
        & (F.col("b_s") <= F.col("a_v"))
        & (rest * (2 * (100 + percent)) >= F.col("a_s") + F.col("b_s"))
        & (estimate(F.col("a_sig"), F.col("b_sig")) >= percent / 100 - SLACK)
    )
    return left.join(right, "gid").where(fits).select("a", "b").distinct()


def led(groups: DataFrame) -> DataFrame:
    """gid and b, its leader: the member that meets most."""
    return groups.groupBy("gid").agg(F.min_by("rep", F.struct(-F.col("meets"), F.col("rep"))).alias("b"))


def homes(groups: DataFrame) -> DataFrame:
    """rep and home, the leader that meets most of those of its groups."""
    lead = groups.groupBy("gid").agg(F.min(F.struct((-F.col("meets")).alias("order"), F.col("rep").alias("home"))).alias("lead"))
    return groups.join(lead, "gid").groupBy("rep").agg(F.min("lead").alias("lead")).select("rep", "lead.home")


def several_homes(groups: DataFrame, home: DataFrame) -> DataFrame:
    """The groups whose members don't all have one home; the pairs of the others meet under it."""
    told = groups.select("gid", "rep").join(home, "rep", "left").groupBy("gid").agg(F.min("home").alias("x"), F.max("home").alias("y"), F.count("home").alias("k"), F.count(F.lit(1)).alias("size"))
    return groups.join(told.where("x IS NULL OR x <> y OR k < size").select("gid"), "gid", "left_semi")


def named(rows: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with comp, the component of rep."""
    comps = components(links, scratch).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    return rows.join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def still_open(groups: DataFrame) -> DataFrame:
    """Members of the groups with several components."""
    return groups.join(groups.groupBy("gid").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("gid"), "gid", "left_semi")


def settled(live: DataFrame, texts: DataFrame, tested: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """All links (a, b): those of tested (a, b, linked), and those between components of live, members (gid, rep, n, sig, meets, comp) of open groups.

    Each round leaves out the member that meets most of all, so rounds end; more than two are rare.
    """
    while True:
        sized = scratch.keep(live.join(live.groupBy("gid").agg(F.count(F.lit(1)).alias("size")), "gid"))
        small, large = sized.where(F.col("size") <= SMALL), sized.where(F.col("size") > SMALL)
        home = scratch.keep(homes(large))
        # a group's pairs meet under the home that most of its members have, but for pairs of the others
        told = large.drop("size").join(home, "rep")
        main = told.groupBy("gid", "home").agg(F.count(F.lit(1)).alias("k")).groupBy("gid").agg(F.max_by("home", F.struct("k", "home")).alias("main"))
        others = scratch.keep(told.join(main, "gid").where("home <> main"))
        crowd = others.groupBy("gid").agg(F.count(F.lit(1)).alias("size"), F.min_by("rep", F.struct(-F.col("meets"), F.col("rep"))).alias("b"))
        lead = others.join(crowd.where(F.col("size") > SMALL), "gid")
        asked = home.select(F.col("rep").alias("a"), F.col("home").alias("b")).unionByName(others.select(F.col("rep").alias("a"), F.col("main").alias("b"))).unionByName(lead.select(F.col("rep").alias("a"), "b"))
        rest = others.join(crowd.where((F.col("size") > 1) & (F.col("size") <= SMALL)).select("gid"), "gid", "left_semi")
        described = scratch.keep(compare(asked.where("a <> b").distinct(), texts, percent, differences=True))
        met = scratch.keep(meeting(described, live.select("rep", "sig", "comp", "meets").dropDuplicates(["rep"]), percent))
        crowds = scratch.keep(met.groupBy("gid").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("size > 1 AND x <> y"))
        few, many = (met.join(crowds.where(c).select("gid"), "gid", "left_semi") for c in (F.col("size") <= HEAVY, F.col("size") > HEAVY))
        pairs = ordered(small_pairs(several_homes(small, home).select("gid", "rep", "n", "sig", "comp").unionByName(rest.select("gid", "rep", "n", "sig", "comp")), percent).unionByName(difference_pairs(few, percent)))
        pairs = pairs.join(ordered(tested.unionByName(described.select("a", "b", "linked"))), ["a", "b"], "left_anti")
        checked = compare(scratch.keep(pairs), texts, percent).select("a", "b", "linked")
        tested = scratch.keep(tested.unionByName(described.select("a", "b", "linked")).unionByName(checked))
        links = tested.where("linked").select("a", "b")
        if many.isEmpty():
            return links
        live = scratch.keep(still_open(named(many.select("gid", "rep", "n", "sig", "meets"), links, scratch)))
        if live.isEmpty():
            return links


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id, kept for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    signed = scratch.keep(signatures(docs, text, key))
    whole = signed.where(F.col(key).isNotNull() & (F.col("n_shingles") > 0))
    # one class per set; its representative is the smallest key, its signature any (they are equal)
    classes = whole.groupBy("set_a", "set_b", "n_shingles").agg(F.min(key).cast("bigint").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = scratch.keep(classes)
    spread = classes.select("rep", F.explode("bands").alias("gid"))
    busy = spread.groupBy("gid").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = scratch.keep(spread.join(busy, "gid"))
    central = shared.groupBy("rep").agg(F.sum("size").alias("meets"))
    members = scratch.keep(shared.select("gid", "rep").join(central.join(classes.select("rep", F.col("n_shingles").alias("n"), "sig"), "rep"), "rep"))
    # texts of classes that share a bucket: one row per class, written once; joined alike at every size
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).join(central.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi")
    texts = scratch.keep(texts.dropDuplicates(["id"]) if has_repeats(signed, key) else texts)
    lead = members.groupBy("gid").agg(F.min_by(F.struct(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("sig").alias("b_sig")), F.struct(-F.col("meets"), F.col("rep"))).alias("l"))
    near = members.join(lead, "gid").select(F.col("rep").alias("a"), "n", "sig", "l.*").where(F.col("a") != F.col("b")).where(fitting(percent))
    near = near.withColumn("like", estimate(F.col("sig"), F.col("b_sig"))).where(F.col("like") >= percent / 100 - SLACK)
    best = scratch.keep(near.groupBy("a").agg(F.max_by("b", F.struct("like", "b")).alias("b")))
    tested = scratch.keep(compare(best, texts, percent).select("a", "b", "linked"))
    links = tested.where("linked").select("a", "b")
    live = scratch.keep(still_open(named(members, links, scratch)))
    if not live.isEmpty():
        links = settled(live, texts, tested, scratch, percent)
    scratch.drop(texts)
    known = classes.select("set_a", "set_b", "n_shingles", "rep")
    known = known.join(components(links, scratch).select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component"))
    found = signed.select(key, "n_shingles", "set_a", "set_b").join(known, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col(key)).otherwise(F.when(F.col(key).isNotNull(), F.col("component"))).cast("bigint")
    return found.select(key, "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def has_repeats(rows: DataFrame, key: str) -> bool:
    """Whether a key comes more than once."""
    return not rows.groupBy(key).count().where("count > 1").isEmpty()
