"""The set of seen addresses with a Bloom filter for each stored batch, so that only batches that may hold an address are read.

A filter is a power of two of bits, 32 or more for each address (a false hit in 170,000 or fewer), in rows of 32,768 bits: (bits, bucket, bitmap), made by partial aggregation. New addresses
are tried against the union of all filters of a size first, those that pass against each batch's own; the batches that remain are read and
joined, which settles false hits exactly. What is never forgotten thus costs files only where it matters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.store import Store
from tidewatch.session import kept

HASHES = 8
BITS_PER_KEY = 32
ROW_BITS = 32_768


def bits_for(n: int) -> int:
    """The size of a filter of n addresses."""
    return 1 << max(int(math.log2(ROW_BITS)), math.ceil(math.log2(max(1, n) * BITS_PER_KEY)))


def _place(key: Column, bits: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(k)), bits)


def bloom_rows(keys: DataFrame, column: str, n: int) -> DataFrame:
    """The filter of a batch of n addresses: bits, bucket, bitmap; buckets without an address have no row."""
    bits = F.lit(bits_for(n)).cast("bigint")
    places = keys.where(F.col(column).isNotNull()).select(F.explode(F.array(*[_place(F.col(column), bits, k) for k in range(HASHES)])).alias("p"))
    rows = places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    return rows.select(bits.alias("bits"), "bucket", "bitmap")


def _hits(keys: DataFrame, sizes: list[int], filters: DataFrame, by: list[str]) -> DataFrame:
    """key and by of the filters that have all bits of the key set."""
    probes = keys.select("key", F.explode(F.array(*[F.lit(s).cast("bigint") for s in sizes])).alias("bits")).select("key", "bits", F.explode(F.array(*[_place(F.col("key"), F.col("bits"), k) for k in range(HASHES)])).alias("p"))
    at = F.bitmap_bit_position("p")
    placed = probes.distinct().select("key", "bits", F.bitmap_bucket_number("p").alias("bucket"), F.floor(at / 8).cast("int").alias("byte"), F.pow(F.lit(2), at % 8).cast("int").alias("mask"))
    wanted = placed.groupBy("key", "bits").agg(F.count(F.lit(1)).alias("n"))
    byte = F.conv(F.hex(F.substring("bitmap", F.col("byte") + 1, F.lit(1))), 16, 10).cast("int")
    met = placed.join(filters, ["bits", "bucket"]).where(byte.bitwiseAND(F.col("mask")) > 0).groupBy("key", "bits", *by).agg(F.count(F.lit(1)).alias("n"))
    return met.join(wanted, ["key", "bits", "n"], "left_semi").select("key", *by).distinct()


def batches_with(store: Store, keys: DataFrame, column: str, before: int | None = None) -> list[int]:
    """The committed batches that may hold any of the addresses."""
    filters = store.with_batch("seen_filters", before)
    sizes = [r.bits for r in filters.select("bits").distinct().collect()]  # powers of two
    if not sizes:
        return []
    wanted = keys.select(F.col(column).alias("key")).where("key IS NOT NULL").distinct()
    union = filters.groupBy("bits", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    likely = kept(_hits(wanted, sizes, union, []), "likely")
    return sorted(r.batch for r in _hits(likely, sizes, filters, ["batch"]).select("batch").distinct().collect())


def needed(store: Store, keys: DataFrame, column: str, before: int | None = None) -> list[int]:
    """The batches that have to be read to tell which addresses were seen: those that may hold one, and those without a filter."""
    filtered = set(store.batches("seen_filters", before))
    return sorted({*batches_with(store, keys, column, before), *(b for b in store.batches("documents_seen", before) if b not in filtered)})


def seen_with(store: Store, keys: DataFrame, column: str, before: int | None = None) -> DataFrame:
    """doc_url of the seen addresses in these batches: all of the keys that were seen are among them."""
    return store.with_batch("documents_seen", before).where(F.col("batch").isin(needed(store, keys, column, before))).select("doc_url")


def unseen(store: Store, rows: DataFrame, column: str, before: int | None = None) -> DataFrame:
    """The rows whose address no committed batch holds."""
    return rows.join(seen_with(store, rows, column, before).withColumnRenamed("doc_url", column), column, "left_anti")
