"""Homomorphic multiset hashes of documents: sums of wide vectors hashed from their paragraphs, modulo powers of two.

A text is the multiset of its paragraphs (its lines, empty ones too). A paragraph's vector is made of its units: the paragraph as a
whole, and its sentences (runs up to and with ``.``, ``!`` or ``?``). Each unit's SHA-256 gives 180 bits, and the vector counts for
each bit how many units have it set: 60 entries modulo 2^60, each holding three counters of 20 bits, and the number of units.

A document's fingerprint is the sum over its paragraphs, entry by entry. So it depends on the multiset of paragraphs only, not on
their order; equal texts have equal fingerprints; and paragraphs are inserted or deleted by adding or subtracting
their vectors, without the rest of the text (``add``, ``subtract``). The counters less half the number of units are sums of random
signs, so the cosine of two fingerprints' counters estimates the overlap of the documents' units
(standard error about 0.07): ``likeness``. Counters keep apart up to a million units a document; above that carries reach
the next counter, which is still the same for equal texts, but blurs the likeness.

Everything is DataFrame functions. The texts are dealt out once by (id, hash of the text); units, their sums and the joins keep that partitioning.

Defined cases: a null text is empty; an empty text is one empty paragraph without a sentence. A document's next one is the next in
descending doc_id, rows with the same doc_id in descending order of their text's hash, null ids last, and the first one
after the last; repeated rows (same id, same text) count once in this order and each gets the result; the only document
of a table has itself as the next; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch

WORDS = 60
#: Bits of an entry, and of one counter in it.
BITS, COUNTER = 60, 20
FULL = (1 << BITS) - 1
ONES = 1 | 1 << COUNTER | 1 << 2 * COUNTER
#: Times three bits, it has each of them at the foot of its counter.
SPREAD = 1 | 1 << (COUNTER - 1) | 1 << 2 * (COUNTER - 1)
SENTENCE = r"[^.!?\n]+[.!?]*|[.!?]+"
#: Units that are added before the next reduction modulo 2^60; as many can't overflow 63 bits.
CHUNK = 1 << 20

KEY = ["id", "hash"]


def units(text: Column) -> Column:
    """Sentences, and paragraphs marked by a line feed in front."""
    return F.concat(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), F.transform(F.split(text, "\n", -1), lambda p: F.concat(F.lit("\n"), p)))


def _with_sign(sign: int, unit: Column) -> Column:
    return F.struct(F.lit(sign).alias("sign"), unit.alias("unit"))


def vectors(texts: DataFrame, *signed: tuple[int, str], long: bool = True) -> DataFrame:
    """KEY, vector: the sum of the vectors of the text columns, each with a sign; texts has a row for each KEY. Tasks add up the units of their own rows first.

    long: whether a text may have CHUNK units or more; these are reduced modulo 2^60 by chunks.
    """
    parts = [F.transform(units(F.col(c)), partial(_with_sign, sign)) for sign, c in signed]
    each = texts.select(*KEY, F.posexplode(F.concat(*parts)).alias("at", "u"))
    key = [*KEY, "chunk"] if long else KEY
    hashed = each.select(*KEY, F.floor(F.col("at") / CHUNK).alias("chunk"), F.col("u.sign").cast("bigint").alias("sign"), F.sha2("u.unit", 256).alias("digest"))
    cut = hashed.select(*key, "sign", *[F.expr(f"cast(conv(substring(digest, {15 * k + 1}, 15), 16, 10) as bigint)").alias(f"d{k}") for k in range(3)])
    per = WORDS // 3
    names = ["n", *[f"w{w}" for w in range(WORDS)]]
    told = ["sign", *[f"sign * (((shiftright(d{w // per}, {3 * (w % per)}) & 7) * {SPREAD}L) & {ONES}L)" for w in range(WORDS)]]
    whole = cut.groupBy(*key).agg(*[F.expr(f"sum({x}) & {FULL}L").alias(n) for n, x in zip(names, told, strict=True)])
    if long:
        whole = whole.groupBy(*KEY).agg(*[F.expr(f"sum({n}) & {FULL}L").alias(n) for n in names])
    return whole.select(*KEY, F.array(*names).alias("vector"))


def add(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(FULL)))


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint without the paragraphs of b."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(FULL)))


def to_hex(v: Column) -> Column:
    """Fifteen lower-case digits for each entry."""
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def signs(v: Column) -> Column:
    """The counters as sums of signs: twice the count less the number of units."""
    one = lambda x, k: (F.shiftright(x, COUNTER * k).bitwiseAND(F.lit((1 << COUNTER) - 1)) * 2 - v[0]).cast("double")
    return F.flatten(F.transform(F.slice(v, 2, WORDS), lambda x: F.array(*[one(x, k) for k in range(3)])))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def likeness(a: Column, b: Column) -> Column:
    """The cosine of two fingerprints' signs, at least 0; 1 for equal fingerprints."""

    def cosine(pair: Column) -> Column:
        squares = _dot(pair["a"], pair["a"]) * _dot(pair["b"], pair["b"])
        return F.when(squares > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), _dot(pair["a"], pair["b"]) / F.sqrt(squares)))).otherwise(0.0)

    # an array of one binds the signs to a name, so that they are found once
    return F.when(a == b, F.lit(1.0)).otherwise(F.transform(F.array(F.struct(signs(a).alias("a"), signs(b).alias("b"))), cosine)[0])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null), and a key without nulls: id, hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("hash"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, vector of every document; repeated rows give one."""
    rows = keyed(docs).dropDuplicates(KEY)
    return rows.select("doc_id", *KEY).join(vectors(rows, (1, "text")), KEY).select("doc_id", "vector")


def following(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """keys (doc_id, id, hash, n, copies; unique) with next_id, next_hash: the key after each one in the order of the module's docstring, the first after the last.

    The keys are dealt over partitions by range; inside of a partition a window finds the next key. A partition's last key goes on with the first of the
    next partition: one row for each partition reaches the driver.
    """
    spark = keys.sparkSession
    order = [F.desc_nulls_last("doc_id"), F.desc("hash")]
    ranged = keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    dealt = scratch.keep(ranged.withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part").orderBy(*order)
    told = dealt.withColumns({"next_id": F.lead("id").over(w), "next_hash": F.lead("hash").over(w), "place": F.row_number().over(w)})
    firsts = told.where("place = 1").select("part", "id", "hash").orderBy("part").collect()
    after = [(a.part, b.id, b.hash) for a, b in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    follow = spark.createDataFrame(after, "part int, first_id bigint, first_hash bigint")
    last = F.col("next_hash").isNull()
    joined = told.join(F.broadcast(follow), "part", "left")  # one row for each partition
    return joined.select("doc_id", *KEY, "n", "copies", F.when(last, F.col("first_id")).otherwise(F.col("next_id")).alias("next_id"), F.when(last, F.col("first_hash")).otherwise(F.col("next_hash")).alias("next_hash"))


def edited(docs: DataFrame, share: int = 3) -> DataFrame:
    """doc_id, n_chars, edited (text), vector, edited_vector, next_vector.

    The last floor(n_chars / share) code points give way to the first as many (or all) of the next document. The edited text's fingerprint comes from
    the document's by deleting the paragraphs from the first changed one on, and inserting what stands in their place.
    """
    scratch = Scratch(docs.sparkSession, "multiset")
    rows = keyed(docs)
    keys = rows.groupBy("doc_id", *KEY, F.length("text").cast("bigint").alias("n")).agg(F.count(F.lit(1)).alias("copies"))
    links = following(keys, scratch)
    repeats, long = links.agg(F.coalesce(F.max("copies") > 1, F.lit(False)), F.coalesce(F.max("n") * 4 + 2 >= 4 * CHUNK, F.lit(False))).first()
    texts = rows.select(*KEY, "text")  # only these, so that both uses of the dealt texts are one shuffle
    texts = texts.dropDuplicates(KEY) if repeats else texts
    known = scratch.keep(vectors(texts, (1, "text"), long=long))
    dealt = texts.repartition(*KEY)
    gives = dealt.join(known, KEY).select(F.col("id").alias("next_id"), F.col("hash").alias("next_hash"), F.col("text").alias("from"), F.col("vector").alias("next_vector"))
    cut = F.floor(F.col("n") / share).cast("int")
    given = links.join(gives, ["next_id", "next_hash"]).select("doc_id", *KEY, "n", "copies", F.left("from", cut).alias("new"), "next_vector")
    both = dealt.join(given, KEY)
    kept = F.left("text", (F.col("n") - cut).cast("int"))
    line = F.substring_index(kept, "\n", -1)  # the unfinished paragraph before the cut
    changed = both.select(*KEY, F.concat(line, F.right("text", cut)).alias("old"), F.concat(line, F.col("new")).alias("new"))
    moved = vectors(changed, (1, "new"), (-1, "old"), long=long).withColumnRenamed("vector", "change")
    made = both.select("doc_id", *KEY, "n", "copies", F.concat(kept, "new").alias("edited"), "next_vector").join(known, KEY).join(moved, KEY)
    out = made.select("doc_id", F.col("n").alias("n_chars"), "edited", "vector", add(F.col("vector"), F.col("change")).alias("edited_vector"), "next_vector", "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy") if repeats else out.drop("copies")
