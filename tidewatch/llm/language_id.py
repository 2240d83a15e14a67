"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of character n-grams (n = 1 to ``ORDERS``) present in both, over the
root of the product of their own numbers (presence, not counts). ``LANDMARKS`` training texts span the
Nystroem approximation: with the landmarks' kernel matrix W, a text x has features
``k(x, landmarks) W^-1/2``; a one-versus-rest kernel ridge regression is fitted on these. A batch of
texts is a presence matrix over the n-grams of the landmarks, and its scores are two matrix products.

Presence is taken over the n-grams that some landmark holds, on lower-case texts in which white
space is one blank, digits are one symbol and characters unseen in the landmarks another.

Training rows: per label, the ``PER_LABEL`` rows first by a hash of their id (a bounded sample of the labelled rows).
Long training texts are whole, too. Landmarks are dealt evenly over the labels.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without training rows
every text is ``und``; repeated rows are scored each; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
ORDERS = 3
LANDMARKS = 192
PER_LABEL = 600
RIDGE = 1e-2
BATCH = 256
#: Cells of a presence matrix at once; wide spectra take fewer texts.
CELLS = 1 << 24

_SPACE = re.compile(r"\s+")
_DIGIT = re.compile(r"\d")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def clean(text: str) -> np.ndarray:
    """Code points of the normalised text, with a blank at either end."""
    text = _DIGIT.sub("0", _SPACE.sub(" ", f" {text.lower()} "))
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Spectrum:
    """Presence vectors over the n-grams of a set of texts."""

    def __init__(self, texts: list[str]):
        points = [clean(t) for t in texts]
        self.alphabet = np.unique(np.concatenate(points))
        self.base = len(self.alphabet) + 1
        self.known = []  # the landmarks' n-grams, sorted; columns follow in this order, 0: in no landmark
        grams = [self.grams(p) for p in points]
        for n in range(ORDERS):
            self.known.append(np.unique(np.concatenate([g[n] for g in grams])))
        self.width = 1 + sum(map(len, self.known))

    def grams(self, points: np.ndarray) -> list[np.ndarray]:
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        code = np.where(self.alphabet[at] == points, at + 1, 0)  # 0: unseen
        out = [code]
        for n in range(1, ORDERS):
            out.append(out[-1][:-1] * self.base + code[n:])
        return out

    def presence(self, texts: list[str]) -> np.ndarray:
        """A row of 0 and 1 for each text, over the root of its sum."""
        out = np.zeros((len(texts), self.width), np.float32)
        for row, text in zip(out, texts, strict=True):
            first = 1
            for known, grams in zip(self.known, self.grams(clean(text)), strict=True):
                at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                row[first + at[known[at] == grams]] = 1
                first += len(known)
        out /= np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))
        return out


class Model:
    """Nystroem features and one-versus-rest ridge weights, folded into one matrix per landmark set."""

    def __init__(self, texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.labels = sorted(set(labels))
        places = [[i for i, y in enumerate(labels) if y == label] for label in self.labels]
        chosen = [p[k] for k in range(landmarks) for p in places if k < len(p)][:landmarks]
        self.spectrum = Spectrum([texts[i] for i in chosen])
        self.landmarks = self.spectrum.presence([texts[i] for i in chosen]).astype(np.float64)
        value, vector = np.linalg.eigh(self.landmarks @ self.landmarks.T)
        keep = value > 1e-8 * value[-1]
        root = vector[:, keep] / np.sqrt(value[keep])
        kernel = self.kernel(texts)
        features = kernel @ root
        target = np.where(np.array(labels)[:, None] == np.array(self.labels)[None, :], 1.0, -1.0)
        weight = 1 / np.array([len(p) for p in places])[[self.labels.index(y) for y in labels]]
        scaled = features * weight[:, None]
        self.offset = (weight[:, None] * target).sum(0) / weight.sum()
        fitted = np.linalg.solve(features.T @ scaled + ridge * weight.sum() / len(texts) * np.eye(features.shape[1]), scaled.T @ (target - self.offset))
        self.weights = (root @ fitted).astype(np.float32)
        self.landmarks = self.landmarks.astype(np.float32)

    def kernel(self, texts: list[str]) -> np.ndarray:
        step = max(1, min(BATCH, CELLS // self.spectrum.width))
        return np.concatenate([self.spectrum.presence(texts[k : k + step]) @ self.landmarks.T for k in range(0, len(texts), step)])

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The best label and its share (softmax of the margins)."""
        margin = (self.kernel(texts) @ self.weights).astype(np.float64) + self.offset
        best = margin.argmax(1)
        share = np.exp(4 * (margin - margin.max(1, keepdims=True)))
        return [self.labels[i] for i in best], (share / share.sum(1, keepdims=True)).max(1)


def fit(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = PER_LABEL) -> Model | None:
    """A model from a bounded, evenly dealt sample of labelled rows; None if there is none.

    The smallest hashes of each label are found by a heap per task before anything is shuffled. Labels with
    few rows count as well; at most ``per_label`` rows of a label reach the driver.
    """
    usable = rows.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in usable.groupBy(label).count().collect()}
    if not counts:
        return None
    # a hash threshold per label that leaves about twice the wanted rows, then the exact cut
    mark = F.pmod(F.xxhash64(key, F.lit("language")), F.lit(1 << 40))
    limit = F.create_map(*[x for y, n in counts.items() for x in (F.lit(y), F.lit(int((1 << 40) * min(1.0, (2.0 * per_label + 100) / n))))])
    near = usable.where(mark < limit[F.col(label)]).select(F.col(label).alias("label"), F.col(text).alias("text"), mark.alias("mark"))
    few = near.groupBy("label").agg(F.expr(f"slice(array_sort(collect_list(struct(mark, text))), 1, {per_label}) AS rows"))
    got = sorted((r["label"], x["mark"], x["text"]) for r in few.collect() for x in r["rows"])
    return Model([t for _, _, t in got], [y for y, _, _ in got])


def predict(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = held.value
        for batch in batches:
            for k in range(0, len(batch), BATCH):
                part = batch.iloc[k : k + BATCH]
                texts = part[text].tolist()
                labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                real = [i for i, t in enumerate(texts) if fitted is not None and has_letter(t)]
                if real:
                    best, share = fitted.score([texts[i] for i in real])
                    scores[real] = share
                    for i, y in zip(real, best, strict=True):
                        labels[i] = y
                yield pd.DataFrame({key: part[key], "lang_pred": labels, "score": scores})

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, lang_pred string, score double")
