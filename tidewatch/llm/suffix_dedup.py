"""Removal of long repeats across documents, with run-length indexes over the places that can repeat.

A byte goes if it is covered by a ``WINDOW``-byte string that also starts in a document with a smaller id.
Matches never cross documents, texts are UTF-8 bytes, and strings are judged on the input.

Indexing the whole corpus in one piece can't be dealt over executors, so places that can repeat are found
first, without loss: the leftmost smallest hash among the ``K``-byte strings of a window is its anchor, and
equal windows have equal anchors at equal places. Every window has exactly one anchor; the windows of one
anchor in a row, with their bytes, are its context (``WINDOW`` bytes plus some).

1. Anchors of all documents go, as packed hashes, to shards by hash, once for each bucket of documents; a bucket is told which of its anchors
   stand in several documents.
2. The distinct contexts of these anchors go to shards by anchor, each once for a bucket, with the smallest and largest id there. So a passage that
   every document has costs a shard one entry for each bucket, not for each document.
3. A shard takes the contexts that agree on an anchor and on what windows with about as many bytes before it have in common (``CLASSES``),
   by owner, the smallest id that has one, and halves them: run-length indexes (``run_index``) of about ``PIECE`` bytes hold the
   earlier halves of many anchors, the later halves are streamed through them, and where the matching statistics reach ``WINDOW`` bytes the window belongs to the
   smallest owner of the strings that hold the match. What matches all the way is done; the halves are halved again until single contexts are left. Halves of
   more than ``PIECE`` bytes are indexed in portions.
4. A bucket is told the smallest id of every window of its contexts that another document may have first, and cuts its documents.

Texts are dealt once, into a table bucketed by document, and join the lists of steps 2 and 4 in place. A task
holds the documents of one bucket, or the contexts of one shard; both numbers follow measured bytes. Contexts are told apart by 64-bit hashes within a shard.

Defined cases: a null text is empty; texts shorter than the window stay; a null doc_id neither loses nor
removes anything; rows that share an id don't remove each other; repeated rows give repeated results; empty
tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, released
from tidewatch.llm.run_index import RunIndex

WINDOW = 50
K = 16
#: Bytes of text in a bucket, about.
BUCKET = 24 << 20
#: Bytes of contexts in a shard, and of the strings of one index, about.
SHARD, PIECE = 8 << 20, 1 << 20
#: Most files of the table of texts; further buckets share them.
MOST_FILES = 50_000
#: How many bytes a window has before its anchor, in classes (least, most).
CLASSES = ((0, 8), (9, 16), (17, 25), (26, WINDOW - K))
#: Windows worked on at once in a long text; places stay below 2^20.
SLICE = 1 << 19

#: Stands for a null id inside this module.
NO_ID = -(1 << 63)

_SYMBOL = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_PLACE = np.uint64(0xFFFFF)
_BESIDE = np.random.default_rng(78).integers(0, 1 << 63, (WINDOW - K, 256), dtype=np.uint64)
#: No document holds the window.
NOBODY = np.iinfo(np.int64).max


def hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings, by doubling."""

    def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (a * _M1) ^ b
        x ^= x >> np.uint64(29)
        x *= _M2
        return x

    h, width = _SYMBOL[raw], 1
    while width * 2 <= k:
        h = both(h[:-width], h[width:])
        width *= 2
    return both(h[: -(k - width)], h[k - width :]) if width < k else h


def contexts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, number of windows and the anchor's place in it of each context of a text of at least WINDOW bytes."""
    found = []
    n = len(raw) - WINDOW + 1
    for at in range(0, n, SLICE):
        h = hashes(raw[at : min(len(raw), at + SLICE + WINDOW - 1)], K)
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        width, span = 1, WINDOW - K + 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: -(span - width)], low[span - width :])
        place = (low & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        found.append((h[place[first]], first + at, np.diff(first, append=len(place)), place[first] - first))
    a, b, c, d = (np.concatenate(v) for v in zip(*found, strict=True))
    return (a * _M1) ^ (a >> np.uint64(32)), b, c, d


def packed(**arrays: np.ndarray) -> bytes:
    """Arrays (or bytes) with their types and lengths, compressed."""
    head, body = [], []
    for name, v in arrays.items():
        raw = v if isinstance(v, bytes) else np.ascontiguousarray(v).tobytes()
        head.append(f"{name}:{'bytes' if isinstance(v, bytes) else v.dtype.str}:{len(raw)}")
        body.append(raw)
    return zstandard.ZstdCompressor(level=1).compress(";".join(head).encode() + b"\n" + b"".join(body))


def unpacked(blob: bytes) -> dict:
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31)
    head, _, body = raw.partition(b"\n")
    out, at = {}, 0
    for x in head.decode().split(";"):
        name, kind, size = x.split(":")
        part = body[at : at + int(size)]
        out[name] = part if kind == "bytes" else np.frombuffer(part, kind)
        at += int(size)
    return out


def dealt(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs, with the places of its entries."""
    order = np.argsort(shard, kind="stable")
    stops = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(stops)).tolist():
        yield s, order[stops[s] : stops[s + 1]]


def by_value(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value that occurs, with its places."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order], prepend=values[order[:1]] - 1))
    for at in np.split(order, cuts[1:]) if len(order) else []:
        yield int(values[at[0]]), at


def units(anchor: np.ndarray, place: np.ndarray, strings: list[bytes], owner: np.ndarray) -> list[np.ndarray]:
    """The contexts in groups such that two with a window in common are in one together, each by owner: those that agree on the anchor and on
    what all windows of one of ``CLASSES`` have beside it.

    These bytes are told apart by hashes; equal ones of different bytes only make a group larger. Contexts of one owner have nothing to learn from each other.
    """
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    raw, begin = np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size
    places, keys = [], []
    for number, (least, most) in enumerate(CLASSES):
        behind = WINDOW - K - most
        own = np.flatnonzero((place >= least) & (size >= place + K + behind))
        q = begin[own] + place[own]
        key = anchor[own] * _M1 + np.uint64(number)
        for k, shift in enumerate([*range(-least, 0), *range(K, K + behind)]):
            key ^= _BESIDE[k][raw[q + shift]]
        places.append(own)
        keys.append(key)
    at, key = np.concatenate(places), np.concatenate(keys)
    if not len(at):
        return []
    order = np.lexsort((owner[at], key))
    at, key = at[order], key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    stop = np.append(head[1:], len(at))
    several = owner[at[head]] < owner[at[stop - 1]]
    groups = (at[a:b] for a, b in zip(head[several].tolist(), stop[several].tolist(), strict=True))
    return list({g.tobytes(): g for g in groups}.values())  # classes often give the same


def in_portions(at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Contexts cut where another PIECE of their bytes begins."""
    total = np.cumsum(size[at])
    return np.split(at, np.flatnonzero(np.diff(total // PIECE)) + 1) if total[-1] > PIECE else [at]


def batches_of(halves: list[tuple[np.ndarray, np.ndarray]], size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What to index, about PIECE bytes, and what to stream through it: each earlier half, in portions, with its later half."""
    early, late, total = [], [], 0
    for first, second in halves:
        for portion in in_portions(first, size):
            early.append(portion)
            late.append(second)
            total += int(size[portion].sum())
            if total >= PIECE:
                yield np.unique(np.concatenate(early)), np.unique(np.concatenate(late))
                early, late, total = [], [], 0
    if early:
        yield np.unique(np.concatenate(early)), np.unique(np.concatenate(late))


def least_owners(groups: list[np.ndarray], strings: list[bytes], owner: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The smallest owner of each window of each context (those of context k are offset[k] .. offset[k + 1]).

    Of each unit the contexts of larger owners are streamed through an index of those of smaller owners. Where the matching statistics reach
    the window, the interval at hand has its smallest owner, which no later context can beat; a context that matches all the way is done
    and stands for nothing that the index doesn't hold. Both halves then are halved again.
    """
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.repeat(owner, np.diff(offset))  # its own copies hold it
    while groups:
        halves = [(u[: len(u) // 2], u[len(u) // 2 :]) for u in groups]
        hit = np.full(len(flat), NOBODY)
        for early, late in batches_of(halves, size):
            index = RunIndex([strings[i] for i in early.tolist()], owner[early], WINDOW)
            for portion in in_portions(late, size):
                found, start = index.earliest([strings[i] for i in portion.tolist()], NOBODY)
                to = np.arange(start[-1]) + np.repeat(offset[portion] - start[:-1], np.diff(start))
                hit[to] = np.minimum(hit[to], found)
        np.minimum(flat, hit, out=flat)
        worst = np.maximum.reduceat(hit, offset[:-1])
        groups = [g for first, second in halves for g in (first, second[worst[second] >= owner[second[0]]]) if len(g) > 1 and owner[g[0]] < owner[g[-1]]]
    return flat


def shard_of(anchor: np.ndarray, shards: int) -> np.ndarray:
    return ((anchor >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of a document; also computed by ``documents_by_part``."""
    x = (doc.astype(np.int64).view(np.uint64) * _M1) >> np.uint64(33)
    return (x % np.uint64(parts)).astype(np.int64)


def usable(docs: list, texts: list) -> Iterator[tuple[int, int, bytes]]:
    """Place, id and bytes of the rows that can repeat."""
    for k, (doc, text) in enumerate(zip(docs, texts, strict=True)):
        if text and doc != NO_ID:
            raw = text.encode("utf-8", "surrogatepass")
            if len(raw) >= WINDOW:
                yield k, int(doc), raw


def remove_repeats(rows: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay) for every row."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    docs = rows.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET), 1)
    files = min(parts, MOST_FILES)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # rows without an id are dealt by place: they take no part in the search
            doc = batch["doc"].to_numpy()
            yield batch.assign(part=part_of(np.where(doc == NO_ID, np.arange(len(doc)), doc), parts))

    name = f"tidewatch_texts_{uuid.uuid4().hex}"
    try:
        dealt_docs = docs.mapInPandas(place, "doc long, text string, part long").repartition(files, "part")
        dealt_docs.write.format("parquet").option("compression", "zstd").bucketBy(files, "part").option("path", f"{scratch.root}/texts").saveAsTable(name)
        done = repeats_removed(spark.table(name), scratch, parts, with_text)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.drop_path(f"{scratch.root}/texts")
    return done.select(F.nullif("doc", F.lit(NO_ID)).alias(key), *done.columns[1:])


def repeats_removed(texts: DataFrame, scratch: Scratch, parts: int, with_text: bool) -> DataFrame:
    """The four steps over the table of texts (doc, text, part)."""
    seen = texts.select("part", "doc", "text").mapInPandas(released(lambda batches: anchors_of(batches, parts)), "shard long, blob binary")
    lists = scratch.keep(seen.groupBy("shard").applyInPandas(shared_anchors, "part long, n long, blob binary"))
    # a context takes about 70 bytes
    shards = max(parts, -(-70 * (lists.agg(F.sum("n")).first()[0] or 0) // SHARD))
    held = texts.groupBy("part").cogroup(lists.groupBy("part")).applyInPandas(lambda own, told: contexts_of(own, told, shards), "at long, blob binary")
    told = scratch.keep(held.groupBy("at").applyInPandas(lambda pdf: earliest_of(pdf) if pdf["at"].iloc[0] < shards else pdf.assign(kind=1, at=pdf["at"] - shards)[["kind", "at", "blob"]], "kind int, at long, blob binary"))
    scratch.drop(lists)
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    done = scratch.keep(texts.groupBy("part").cogroup(told.groupBy("at")).applyInPandas(lambda own, news: documents_cut(own, news, with_text), schema))
    scratch.drop(told)
    return done


def anchors_of(batches: Iterator[pd.DataFrame], parts: int) -> Iterator[pd.DataFrame]:
    """1: the anchors of each bucket, one blob for each shard: which, in which document, and whether in several."""
    held: dict[int, list[tuple[np.ndarray, int]]] = {}
    size = 0

    def flushed() -> Iterator[pd.DataFrame]:
        for part, found in held.items():
            anchor = np.concatenate([a for a, _ in found])
            doc = np.repeat(np.array([d for _, d in found], np.int64), [len(a) for a, _ in found])
            order = np.argsort(anchor)
            anchor, doc = anchor[order], doc[order]
            head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            least, most = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)
            anchor = anchor[head]
            ids, number = np.unique(least, return_inverse=True)
            out = []
            for s, at in dealt(shard_of(anchor << np.uint64(16), parts), parts):
                short = anchor[at]
                own, which = np.unique(number[at], return_inverse=True)
                out.append((s, packed(part=np.array([part]), high=(short >> np.uint64(16)).astype(np.uint32), low=(short & np.uint64(0xFFFF)).astype(np.uint16), number=which.astype(np.uint16 if len(own) < 65536 else np.uint32), several=np.packbits(most[at] > least[at]), ids=np.diff(ids[own], prepend=0))))
            yield pd.DataFrame(out, columns=["shard", "blob"])
        held.clear()

    for batch in batches:
        for part, own in batch.groupby("part", sort=False):
            for _, doc, raw in usable(own["doc"].tolist(), own["text"].tolist()):
                a = np.unique(contexts(np.frombuffer(raw, np.uint8))[0] >> np.uint64(16))
                held.setdefault(int(part), []).append((a, doc))
                size += len(a)
        if size > 2_000_000:
            yield from flushed()
            size = 0
    yield from flushed()


def shared_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """1: for each bucket those of its anchors that stand in several documents, over all buckets."""
    anchor, doc, several, part = [], [], [], []
    for blob in pdf["blob"]:
        x = unpacked(blob)
        anchor.append((x["high"].astype(np.uint64) << np.uint64(16)) | x["low"])
        doc.append(np.cumsum(x["ids"])[x["number"]])
        several.append(np.unpackbits(x["several"], count=len(x["high"])).astype(bool))
        part.append(np.full(len(x["high"]), x["part"][0]))
    anchor, doc, several, part = (np.concatenate(v) for v in (anchor, doc, several, part))
    order = np.argsort(anchor)
    head = np.flatnonzero(np.diff(anchor[order], prepend=anchor[order[:1]] ^ np.uint64(1)))
    many = (np.maximum.reduceat(doc[order], head) > np.minimum.reduceat(doc[order], head)) | np.logical_or.reduceat(several[order], head)
    hit = order[np.repeat(many, np.diff(head, append=len(order)))]
    anchor, part = anchor[hit], part[hit]
    out = []
    for p, at in by_value(part):
        own = np.unique(anchor[at])
        out.append((p, len(own), packed(anchor=own)))
    return pd.DataFrame(out, columns=["part", "n", "blob"])


def contexts_of(own: pd.DataFrame, told: pd.DataFrame, shards: int) -> pd.DataFrame:
    """2: the distinct contexts of a bucket's shared anchors for the shards, and where they stand, for ``shards`` and the bucket."""
    columns = ["at", "blob"]
    if not len(told) or not len(own):
        return pd.DataFrame([], columns=columns)
    shared = np.unique(np.concatenate([unpacked(b)["anchor"] for b in told["blob"]]))
    rows, found, strings = [], [], []
    number: dict[bytes, int] = {}
    for _, d, raw in usable(own["doc"].tolist(), own["text"].tolist()):
        a, first, n, lead = contexts(np.frombuffer(raw, np.uint8))
        short = a >> np.uint64(16)
        hit = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, short), len(shared) - 1)] == short)
        if not len(hit):
            continue
        first, n = first[hit], n[hit]
        which = np.empty(len(hit), np.int64)
        for k, (f, m) in enumerate(zip(first.tolist(), (n + WINDOW - 1).tolist(), strict=True)):
            which[k] = number.setdefault(raw[f : f + m], len(number))
        rows.append((d, xxhash.xxh3_64_intdigest(raw), len(hit)))
        found.append((which, first, short[hit], n, lead[hit]))
    if not rows:
        return pd.DataFrame([], columns=columns)
    which, first, anchor, n, lead = (np.concatenate(v) for v in zip(*found, strict=True))
    strings = list(number)
    del number, found
    doc = np.array([d for d, _, _ in rows], np.int64)
    count = np.array([c for _, _, c in rows], np.int64)
    by = np.repeat(doc, count)
    least, most = np.full(len(strings), NOBODY), np.full(len(strings), NO_ID)
    np.minimum.at(least, which, by)
    np.maximum.at(most, which, by)
    key = np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings))
    of = np.empty(len(strings), np.int64)
    of[which] = np.arange(len(which))  # any place of each
    part = int(own["part"].iloc[0])
    out = [(shards + part, packed(row_doc=doc, row_hash=np.array([h for _, h, _ in rows], np.uint64), count=count, key=key, which=which.astype(np.uint32), start=first.astype(np.uint32)))]
    for shard, at in dealt(shard_of(anchor[of] << np.uint64(16), shards), shards):
        out.append((shard, packed(part=np.array([part]), key=key[at], least=least[at], most=most[at], anchor=anchor[of[at]], windows=n[of[at]].astype(np.uint8), lead=lead[of[at]].astype(np.uint8), raw=b"".join([strings[i] for i in at.tolist()]))))
    return pd.DataFrame(out, columns=columns)


def earliest_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """3: for each bucket the smallest id that holds each window of its contexts, where that may be another document's."""
    told = [unpacked(b) for b in pdf["blob"]]
    sizes = [len(x["key"]) for x in told]
    joined = lambda name: np.concatenate([x[name] for x in told])
    every, least, most, anchor, windows, lead = (joined(c) for c in ("key", "least", "most", "anchor", "windows", "lead"))
    part = np.repeat([int(x["part"][0]) for x in told], sizes)
    key, first, which = np.unique(every, return_index=True, return_inverse=True)
    owner = np.full(len(key), NOBODY)
    np.minimum.at(owner, which, least)
    strings: list[bytes] = [b""] * len(key)
    wanted, at = np.zeros(len(every), bool), 0
    wanted[first] = True
    for x, k in zip(told, sizes, strict=True):
        stop = np.cumsum(x["windows"].astype(np.int64) + WINDOW - 1)
        begin = np.concatenate([[0], stop[:-1]])
        raw = x.pop("raw")
        for i in np.flatnonzero(wanted[at : at + k]).tolist():
            strings[which[at + i]] = raw[begin[i] : stop[i]]
        at += k
    told.clear()
    n = windows[first].astype(np.int64)
    offset = np.concatenate([[0], np.cumsum(n)])
    flat = least_owners(units(anchor[first], lead[first], strings, owner), strings, owner, offset)
    low = np.minimum.reduceat(flat, offset[:-1])
    out = []
    news = np.flatnonzero(low[which] < most)
    for p, held in by_value(part[news]):
        mine = which[news[held]]
        at = np.arange(n[mine].sum()) + np.repeat(offset[mine] - np.concatenate([[0], np.cumsum(n[mine])[:-1]]), n[mine])
        out.append((0, p, packed(key=key[mine], windows=n[mine].astype(np.uint8), least=flat[at])))
    return pd.DataFrame(out, columns=["kind", "at", "blob"])


def documents_cut(own: pd.DataFrame, news: pd.DataFrame, with_text: bool) -> pd.DataFrame:
    """4: the documents of a bucket without the bytes that a smaller id has."""
    stretches: dict[tuple[int, int], np.ndarray] = {}
    places = [unpacked(b) for b in news["blob"][news["kind"] == 1]]
    told = [unpacked(b) for b in news["blob"][news["kind"] == 0]]
    if places and told:
        key, windows, least = (np.concatenate([x[c] for x in told]) for c in ("key", "windows", "least"))
        n = windows.astype(np.int64)
        offset = np.concatenate([[0], np.cumsum(n)])[:-1]
        order = np.argsort(key)
        for x in places:
            at = order[np.minimum(np.searchsorted(key[order], x["key"]), len(order) - 1)]
            hit = np.flatnonzero((key[at] == x["key"])[x["which"]])
            at, start = at[x["which"][hit]], x["start"][hit].astype(np.int64)
            row = np.repeat(np.arange(len(x["count"])), x["count"])[hit]
            many = n[at]
            step = np.arange(many.sum()) - np.repeat(np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64), many)
            gone = least[np.repeat(offset[at], many) + step] < np.repeat(x["row_doc"][row], many)
            where, row = (np.repeat(start, many) + step)[gone], np.repeat(row, many)[gone]
            cuts = np.searchsorted(row, np.arange(len(x["count"]) + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                stretches[int(x["row_doc"][k]), int(x["row_hash"][k])] = where[cuts[k] : cuts[k + 1]]
    out = []
    for d, t in zip(own["doc"].tolist(), own["text"].tolist(), strict=True):
        raw = (t or "").encode("utf-8", "surrogatepass")
        at = stretches.get((d, xxhash.xxh3_64_intdigest(raw))) if stretches and d != NO_ID else None
        spans, kept = 0, raw
        if at is not None:
            # windows that go: each opens a stretch of WINDOW bytes
            edge = np.bincount(at, minlength=len(raw) + 1) - np.bincount(at + WINDOW, minlength=len(raw) + 1)
            gone = np.cumsum(edge)[:-1] > 0
            spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((d, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
    made = pd.DataFrame(out, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    made["doc"] = own["doc"].values
    return made if with_text else made.drop(columns=["kept"])
