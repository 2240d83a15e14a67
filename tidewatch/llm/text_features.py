"""Measures of a whole text as a short vector; the same at any length and for any language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

NAMES = (
    "log_bytes upper lower digit space other_ascii non_ascii bang symbols comma_stop pipe lines_per_word log_words "
    "word_length distinct_words top_word same_neighbour upper_words marked_words dup_lines one_word_lines stop_gap distinct_pairs"
).split()
WIDTH = len(NAMES)

_CLASS = np.full(256, 5, np.int64)
for _chars, _k in ((range(65, 91), 0), (range(97, 123), 1), (range(48, 58), 2), ((32, 9, 10, 11, 12, 13), 3), (range(128, 256), 4), (b"!?", 6), (b"#*$%&<>", 7), (b".,", 8), (b"|", 9)):
    _CLASS[list(_chars)] = _k


def measures(text: str | None) -> np.ndarray:
    """The vector of one text; null counts as empty, and an empty text is all zeros."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    by = np.bincount(_CLASS, weights=np.bincount(raw, minlength=256), minlength=10) / n
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    marked = sum(1 for w in counts if not w[-1].isalnum() and w[-1] not in ".,;:")
    out[:] = (
        np.log1p(n), by[0], by[1], by[2], by[3], by[5], by[4], by[6], by[7], by[8], by[9], len(lines) / m, np.log1p(len(words)),
        sum(map(len, words)) / m, len(counts) / m, max(counts.values(), default=0) / m, same / m,
        sum(counts[w] for w in counts if w.isupper()) / m, marked / max(1, len(counts)), 1 - len(set(lines)) / max(1, len(lines)),
        sum(1 for x in lines if " " not in x) / max(1, len(lines)), m / (1 + text.count(".")) / 100, (pairs + 1) / m,
    )
    return out


def with_measures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and its measures, for every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "measures": [measures(t) for t in batch[text].tolist()]})

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, measures array<float>")
