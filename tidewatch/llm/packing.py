"""Packing token streams into sequences by an order-preserving dynamic programme.

Each input partition is a stream of documents in table order. A window of the stream that becomes
one sequence may be cut at any document or sentence end; only where those are further apart than a whole
sequence are there cuts between, every ``CUT_EVERY`` tokens. With ``pad(n)`` = 0 where n is a power of
two (inside a stream: ``size`` or its half) and ``size - n`` else, the cuts minimise

    sum of pad(length) + sum of the penalty of each cut (0 document end, SENTENCE sentence end, INNER else).

``best[j] = penalty(j) + min(best[i] - (j - i) + size)`` over i in ``[j - size, j)`` is a sliding
minimum of ``best[i] + i``, so a monotone queue gives each transition in constant time; the
power-of-two lengths are a few more transitions. A buffer of about ``BUFFER`` tokens is solved at a time and
its last sequences are carried into the next, so memory is bounded and each partition ends with at most
one short sequence. No row is shuffled.

Defined cases: a null text is empty, a document then is only its end id; repeated rows are packed
each on its own; an empty table gives no rows; further columns are ignored; a null doc_id is kept.
A text longer than a buffer is held whole.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewatch.llm.common import released

SIZE = 2048
SENTENCE, INNER = 4, 48
CUT_EVERY = 128
BUFFER = 1 << 17
END_ID = 1
#: Chunks of text remembered by a worker; beyond it the memory starts anew.
REMEMBERED = 200_000

_PLAIN = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+\Z")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")
_GAP = re.compile("[ \n\t\r]+")


class WordTokens(dict):
    """Ids of a white-space-free chunk as little-endian bytes, remembered.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    chunks. A chunk of plain Latin letters, digits and marks is split here and merged by the
    same ranks with the byte-pair encoder; any other chunk goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model["end_of_word_suffix"]
        vocab = model["vocab"]
        symbols = _byte_symbols()

        def raw(token: str) -> bytes:
            last = token.endswith(end) and len(token) > len(end)
            body = token[: -len(end)] if last else token
            return bytes(symbols[c] for c in body) + (b"\xff" if last else b"")

        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        ids = np.zeros(600 + len(model["merges"]), np.uint32)
        for c, b in symbols.items():
            ids[b] = vocab[c]
            ranks[bytes([b, 255])] = 256 + b
            ids[256 + b] = vocab[c + end]
        for i, pair in enumerate(model["merges"]):
            token = "".join(pair.split(" ") if isinstance(pair, str) else pair)
            ranks.setdefault(raw(token), 512 + i)
            ids[512 + i] = vocab[token]
        self.ids = [i.tobytes() for i in ids.astype("<u4")]
        self.pieces: dict[str, bytes] = {}
        self.encoder = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
            self.pieces.clear()
        if len(chunk) <= 60 and _PLAIN.match(chunk) and "<|" not in chunk:
            known = self.pieces
            low = chunk.lower()
            out = b""
            for piece in (low,) if low.isalpha() else _PIECE.findall(low):
                ids = known.get(piece)
                if ids is None:
                    ids = known[piece] = b"".join([self.ids[i] for i in self.encoder._encode_single_piece(piece.encode() + b"\xff")])
                out += ids
        else:
            out = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= 60:
            self[chunk] = out
        return out

    def of(self, text: str | None) -> np.ndarray:
        """A document's ids with its end id."""
        if not text:
            chunks = []
        elif any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split, but not for the tokenizer
            chunks = [c for c in _GAP.split(text) if c]
        else:
            chunks = text.split()
        return np.frombuffer(b"".join(map(self.__getitem__, chunks)) + b"\x01\x00\x00\x00", "<u4")


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_WORKERS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per worker process."""
    if path not in _WORKERS:
        _WORKERS[path] = WordTokens(path)
    return _WORKERS[path]


def sentence_ends(tokens: WordTokens) -> np.ndarray:
    """By id: whether the token ends a sentence."""
    vocab = tokens.tokenizer.get_vocab()
    flags = np.zeros(max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        if re.fullmatch(r"[.!?]+(</w>)?", token):
            flags[i] = True
    return flags


def best_cuts(where: np.ndarray, penalty: np.ndarray, size: int = SIZE, least: int = SIZE // 2) -> list[int]:
    """Indexes into ``where`` (ascending positions, first 0, gaps at most ``size``) that the best packing cuts at.

    ``least``: the shortest power of two that counts as free of padding.
    """
    n = len(where)
    at = where.tolist()
    cost = penalty.tolist()
    total = at[-1] + 1
    index = np.full(total, -1, np.int64)
    index[where] = np.arange(n)
    even: dict[int, list[int]] = {}
    m = least
    while m < size:
        later = where[where >= m]
        source = index[later - m]
        for j, i in zip(index[later[source >= 0]].tolist(), source[source >= 0].tolist(), strict=True):
            even.setdefault(j, []).append(i)
        m *= 2
    best = [0.0] * n
    came = [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, n):
        here = at[j]
        while at[queue[0][1]] < here - size:
            queue.popleft()
        value, i = queue[0]
        value += size - here
        for other in even.get(j, ()):
            if best[other] < value:
                value, i = best[other], other
        value += cost[j]
        best[j] = value
        came[j] = i
        value += here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


def pack_stream(docs: Iterator[tuple[object, np.ndarray]], ends: np.ndarray, size: int = SIZE, buffer: int = BUFFER) -> Iterator[list[tuple]]:
    """Pieces (doc, start, length, crc, doc_tokens, sequence, offset) of documents in order, sequences from 0."""
    held: list[tuple[object, np.ndarray, int]] = []  # a document, its ids, how many are packed
    tokens = sequence = 0

    def solve(last: bool) -> list[tuple]:
        nonlocal held, tokens, sequence
        ids = np.concatenate([x[1][x[2] :] for x in held])
        lengths = np.array([len(x[1]) - x[2] for x in held])
        stops = np.cumsum(lengths)
        worth = np.full(len(ids) + 1, np.inf)
        worth[1:][ends[ids]] = SENTENCE
        worth[stops] = 0
        worth[0] = 0
        natural = np.flatnonzero(np.isfinite(worth))
        for k in np.flatnonzero(np.diff(natural) > size).tolist():
            worth[natural[k] + CUT_EVERY : natural[k + 1] : CUT_EVERY] = INNER
        where = np.flatnonzero(np.isfinite(worth))
        cuts = where[best_cuts(where, worth[where], size, 1 if last else size // 2)]
        if not last and len(cuts) > 3:
            cuts = cuts[:-2]
        pieces = []
        k, begin = 0, 0  # the document at hand, where in ids it begins
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = a
            while at < b:
                doc, all_ids, packed = held[k]
                stop = int(stops[k])
                to = min(stop, b)
                part = all_ids[packed + at - begin : packed + to - begin]
                pieces.append((doc, packed + at - begin, to - at, zlib.crc32(part.tobytes()), len(all_ids), sequence, at - a))
                at = to
                if to == stop:
                    k, begin = k + 1, stop
            sequence += 1
        rest = held[k:]
        if rest:
            doc, all_ids, packed = rest[0]
            rest[0] = (doc, all_ids, packed + int(cuts[-1]) - begin)
        held = rest
        tokens = len(ids) - int(cuts[-1])
        return pieces

    for doc, ids in docs:
        held.append((doc, ids, 0))
        tokens += len(ids)
        if tokens >= buffer:
            yield solve(False)
    if held:
        yield solve(True)


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tokens = word_tokens(tokenizer_path)
        ends = sentence_ends(tokens)
        base = TaskContext.get().partitionId() << 40

        def stream():
            for batch in batches:
                for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                    yield doc, tokens.of(text)

        for pieces in pack_stream(stream(), ends, size):
            out = pd.DataFrame(pieces, columns=names)
            out["sequence_id"] += base
            yield out
        tokens.clear()
        tokens.pieces.clear()

    return docs.select("doc_id", "text").mapInPandas(released(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
