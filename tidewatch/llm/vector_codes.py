"""Product codes of vectors: a codebook for each part, fitted by Lloyd rounds with Hamerly's bounds, in integers.

Components become floor(1024 x); vectors are cut into ``PARTS`` equal consecutive parts. For each part of each vector the state holds its entry,
an upper bound of the distance to it, and a lower bound of the distance to the second-nearest one. The state of all vectors is written
to the shared folder after each round and read by the next, so a lost executor costs one task. When entries have moved, the upper bound
grows by its entry's way and the lower one shrinks by the longest way of any other entry. A part keeps its entry unread where its upper bound is
strictly below its lower bound, or strictly below half the way from its entry to the closest other one; else the distance to its entry is found
exactly, and only where that is no proof either, all entries are compared. Comparisons are of integers, and the lower index wins ties; bounds are rounded
outwards, so they never decide a tie.

The driver holds the codebooks (``PARTS * ENTRIES`` entries) and, each round, a sum for each entry: tasks add up their own vectors first.

Defined cases: a vector that is null or has null or non-finite components is dropped; components beyond +-2^27 after scaling are set there. The first rows
in ascending order of vec_id (nulls last, then by components) give the initial codebooks; with fewer than ``ENTRIES`` rows there are fewer entries. The
width is that of the first row whose length is a positive multiple of ``PARTS``; vectors of another length have null codes and errors. Repeated rows
count each; empty tables give no rows; other columns are ignored; null labels are one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 27

_STATE = "vec_id bigint, label string, ints array<int>, entry array<int>, upper array<double>, lower array<double>"


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, position]; sha256 of their decimal numbers."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as text), ints of the vectors that are whole and finite."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * SCALE))).cast("int"))
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), scaled.alias("ints"))


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf), 0)


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to all entries."""
    largest = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    # doubles hold these integers without loss while they stay below 2^53, and multiply faster
    kind = np.float64 if 4 * largest * largest * max(1, x.shape[1]) < 1 << 53 else np.int64
    a, b = x.astype(kind), book.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]).astype(np.int64)


def own_squares(x: np.ndarray, book: np.ndarray, entry: np.ndarray) -> np.ndarray:
    gap = x - book[entry]
    return (gap * gap).sum(axis=1)


def moves(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry of a part moved, and the longest way of any other entry; rounded up."""
    way = up(np.sqrt(((old - new) ** 2).sum(axis=1).astype(np.float64)))
    way[(old == new).all(axis=1)] = 0
    others = np.zeros_like(way)
    if len(way) > 1:
        first = int(way.argmax())
        others[:] = way[first]
        others[first] = np.delete(way, first).max()
    return way, others


def clearances(book: np.ndarray) -> np.ndarray:
    """Half the way from each entry to the closest other one; rounded down."""
    if len(book) < 2:
        return np.full(len(book), np.inf)
    gaps = squares(book, book)
    np.fill_diagonal(gaps, np.iinfo(np.int64).max)
    return down(np.sqrt(gaps.min(axis=1).astype(np.float64)) / 2)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (lower index at ties) of each row, upper bound of its distance, lower bound of the second-nearest one's."""
    gaps = squares(x, book)
    entry = gaps.argmin(axis=1)
    rows = np.arange(len(x))
    nearest = gaps[rows, entry]
    if len(book) > 1:
        gaps[rows, entry] = np.iinfo(np.int64).max
        second = down(np.sqrt(gaps.min(axis=1).astype(np.float64)))
    else:
        second = np.full(len(x), np.inf)
    return entry, up(np.sqrt(nearest.astype(np.float64))), second


def assign_part(x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> int:
    """Bring one part's state, found for the old entries, to the new ones in place; returns how many rows needed a full scan."""
    way, others = moves(old, new)
    upper[:] = up(upper + way[entry])
    lower[:] = down(lower - others[entry])
    proof = np.maximum(lower, clearances(new)[entry])
    open_ = np.flatnonzero(~(upper < proof))
    upper[open_] = up(np.sqrt(own_squares(x[open_], new, entry[open_]).astype(np.float64)))
    open_ = open_[~(upper[open_] < proof[open_])]
    if len(open_):
        entry[open_], upper[open_], lower[open_] = scan(x[open_], new)
    return len(open_)


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.array(values.ravel(), kind))


def start_state(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """The state of the first round: all entries are compared."""
    parts, _, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["ints"], parts * wide, np.int64)
            found = [scan(x[:, p * wide : (p + 1) * wide], books[p]) for p in range(parts)]
            entry, upper, lower = (np.stack(c, axis=1) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["ints"], lists(entry, pa.int32()), lists(upper, pa.float64()), lists(lower, pa.float64())], names=_names(_STATE))

    return rows.mapInArrow(run, _STATE)


def next_state(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The state after the entries moved from old to new."""
    parts, _, wide = new.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["ints"], parts * wide, np.int64)
            entry, upper, lower = matrix(b["entry"], parts, np.int64), matrix(b["upper"], parts, np.float64), matrix(b["lower"], parts, np.float64)
            for p in range(parts):
                assign_part(x[:, p * wide : (p + 1) * wide], entry[:, p], upper[:, p], lower[:, p], old[p], new[p])
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["ints"], lists(entry, pa.int32()), lists(upper, pa.float64()), lists(lower, pa.float64())], names=_names(_STATE))

    return state.mapInArrow(run, _STATE)


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries moved to the floored means of their parts; unused ones stay."""
    parts, entries, wide = books.shape
    names = ["part", "entry", "n", *[f"s{k}" for k in range(wide)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + wide), np.int64)
        for b in batches:
            x, entry = matrix(b["ints"], parts * wide, np.int64), matrix(b["entry"], parts, np.int64)
            for p in range(parts):
                total[p, :, 0] += np.bincount(entry[:, p], minlength=entries)
                np.add.at(total[p, :, 1:], entry[:, p], x[:, p * wide : (p + 1) * wide])
        part, entry = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (part, entry, *total[part, entry].T)], names=names)

    sums = state.select("ints", "entry").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    out = books.copy()
    for r in sums.groupBy("part", "entry").agg(*[F.sum(n).alias(n) for n in names[2:]]).collect():  # a row for each entry
        out[r[0], r[1]] = np.array(r[3:], np.int64) // r[2]
    return out


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """The final state of the vectors (vec_id, label, ints, entry, ...; those of another width have a null entry) and the codebooks."""
    scratch = Scratch(vectors.sparkSession, "codes")
    rows = integers(vectors)
    fits = rows.where((F.size("ints") > 0) & (F.size("ints") % parts == 0))
    order = [F.asc_nulls_last("vec_id"), F.asc("ints")]
    first = fits.orderBy(*order).limit(1).collect()
    if not first:
        return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in (x.split(" ") for x in _STATE.split(", "))]), Codebooks(np.zeros((parts, 0, 0), np.int64))
    width = len(first[0].ints)
    same = F.size("ints") == width
    seeds = rows.where(same).orderBy(*order).limit(entries).collect()
    books = np.array([s.ints for s in seeds], np.int64).reshape(len(seeds), parts, width // parts).transpose(1, 0, 2)
    state = scratch.keep(start_state(rows.where(same), books))
    for _ in range(rounds):
        new = moved(state, books)
        later = scratch.keep(next_state(state, books, new))
        scratch.drop(state)
        state, books = later, new
    odd = rows.where(~same).select("vec_id", "label", "ints", *[F.lit(None).cast(kind).alias(c) for c, kind in (x.split(" ") for x in _STATE.split(", ")[3:])])
    return state.unionByName(odd), Codebooks(books)


def coded(state: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits for each part), error (squared distances summed over the parts)."""
    parts, _, wide = books.entries.shape
    schema = "vec_id bigint, label string, code string, error bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, entry = matrix(b["ints"], parts * wide, np.int64), matrix(b["entry"], parts, np.int64)
            error = sum(own_squares(x[:, p * wide : (p + 1) * wide], books.entries[p], entry[:, p]) for p in range(parts))
            code = [bytes(e).hex() for e in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array(code, pa.string()), pa.array(error, pa.int64())], names=_names(schema))

    plain = state.select("vec_id", "label", "ints", "entry")
    none = plain.where("entry IS NULL").select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    return plain.where("entry IS NOT NULL").mapInArrow(run, schema).unionByName(none)


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of vectors (vec_id, embedding, label)."""
    state, books = fit(vectors)
    rows = coded(state, books)
    by_label = rows.groupBy(F.col("label").alias("label_")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(by_label, rows["label"].eqNullSafe(by_label["label_"]), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
