"""Mixing to target weights by soft membership.

A softmax classifier learned from the labels table gives every document its posterior over three domains: ``clean``,
``low`` (quality 0) and ``toxic``. With n the document's tokens (words), p its posterior and r >= 0 its
rate, the expected tokens of domain d are ``S_d = sum n p_d r``. Rates minimise

    1/2 (S - T)' W (S - T) / N^2 + lam/2 sum (n / N) (r - 1)^2,    r >= 0,

with targets T, N all tokens and ``W = (sum (n / N) p p' + 0.01)^-1``, which evens out the curvature of large and small domains.
The solver is accelerated projected gradient descent. A document's step needs only its p and the few numbers
of the residual, so the driver holds one residual per step and executors replay the steps since the rates
were last written; each step sums one short vector over all documents. Rates become whole copies
by ``floor(rate + u)`` with u a hash of id and text, so that expected totals are kept and a rate of one or more never loses
a document.

At most ``PER_DOMAIN`` labelled rows of each domain train the classifier (first by a hash of the id); its prior comes
from all labels. Posteriors, totals and rates cover all documents.

Defined cases: a null text has no tokens and rate 1 at first, moved like any other; without labels all is ``clean``; labels
that contradict count as toxic, then low; null labels count as 1 and 0; repeated rows are rated each;
empty tables give no rows; further columns are kept by ``mix``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, released, unused
from tidewatch.llm.text_features import WIDTH, measures

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.96, "low": 0.02, "toxic": 0.02}
PER_DOMAIN = 2000
WORDS = 256
STEPS, REPLAY = 40, 8
LAMBDA = 1e-3
CLOSE = 2e-4

#: Endings of tokens (marks behind the word) that the classifier reads a word with: the most frequent of its sample.
TAILS = 24

_CORE = re.compile(r"\w(?:.*\w)?", re.DOTALL)


def tokens(text: str | None) -> set[str]:
    return set(text.lower().split()) if text else set()


def core(token: str) -> tuple[str, str]:
    """The word of a token, without marks around it, and the marks behind it."""
    found = _CORE.search(token)
    return (found.group(), token[found.end() :]) if found else ("", token)


class Classifier:
    """Softmax regression on text measures and the words that tell the domains apart."""

    def __init__(self, texts: list[str | None], domains: list[int], prior: np.ndarray):
        y = np.eye(len(DOMAINS))[domains]
        seen = Counter()
        inside = [Counter() for _ in DOMAINS]
        tails = Counter()
        for t, d in zip(texts, domains, strict=True):
            parts = [core(w) for w in tokens(t)]
            tails.update(tail for word, tail in parts if word)
            bag = {word for word, _ in parts}
            seen.update(bag)
            inside[d].update(bag)
        size = y.sum(0)
        told = {}
        for w, n in seen.items():
            if w and n >= 5:
                share = n / len(texts)
                told[w] = max(abs(inside[d][w] - size[d] * share) / np.sqrt(size[d] * share * (1 - share) + 1e-9) for d in range(len(DOMAINS)) if size[d])
        chosen = sorted(told, key=lambda w: (-told[w], w))[:WORDS]
        self.column = {w + tail: WIDTH + k for k, w in enumerate(chosen) for tail in sorted(tails, key=lambda x: (-tails[x], x))[:TAILS]}
        self.width = WIDTH + WORDS + 1
        self.mean, self.dev = np.zeros(self.width), np.ones(self.width)
        x = self.features(texts)
        self.mean[:WIDTH] = x[:, :WIDTH].mean(0)
        self.dev[:WIDTH] = np.maximum(x[:, :WIDTH].std(0), 1e-6)
        x = self.scaled(x)
        self.weights = np.zeros((self.width, len(DOMAINS)))
        m, v = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for n in range(1, 301):
            g = x.T @ (softmax(x @ self.weights) - y) / len(x) + 1e-3 * self.weights
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.weights -= 0.05 * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            shift = np.log(prior) - np.log(size / size.sum())
        self.weights[-1] += np.where(size > 0, shift, -50.0)

    def features(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), self.width))
        for row, t in zip(x, texts, strict=True):
            row[:WIDTH] = measures(t)
            for w in tokens(t) & self.column.keys():
                row[self.column[w]] = 1
            row[-1] = 1
        return x

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.dev, -6, 6)

    def posterior(self, texts: list[str | None]) -> np.ndarray:
        return softmax(self.scaled(self.features(texts)) @ self.weights)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learn(docs: DataFrame, labels: DataFrame, per_domain: int = PER_DOMAIN) -> Classifier | None:
    """A classifier from labels (doc_id, quality, toxic); None where no labelled row has a document."""
    domain = F.when(F.max(F.coalesce("toxic", F.lit(0))) > 0, 2).when(F.min(F.coalesce("quality", F.lit(1))) < 1, 1).otherwise(0)
    told = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(domain.alias("domain"))
    counts = {r[0]: r[1] for r in told.groupBy("domain").count().collect()}
    if not counts:
        return None
    mark = F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 40))
    limit = F.create_map(*[x for d, n in counts.items() for x in (F.lit(d), F.lit(int((1 << 40) * min(1.0, 1.1 * per_domain / n))))])
    few = told.where(mark < limit[F.col("domain")])
    got = docs.select("doc_id", "text").join(few, "doc_id").select("doc_id", "domain", "text", mark.alias("mark")).dropDuplicates(["doc_id"]).orderBy("mark", "doc_id").collect()
    if not got:
        return None
    prior = np.array([counts.get(d, 0) for d in range(len(DOMAINS))], float)
    return Classifier([r["text"] for r in got], [r["domain"] for r in got], prior / prior.sum())


def with_posteriors(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """docs with n_tokens and posterior."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.iloc[k : k + 1024]
                texts = part["text"].tolist()
                p = held.value.posterior(texts) if held.value else np.tile([1.0, 0.0, 0.0], (len(texts), 1))
                yield pd.DataFrame({"doc_id": part["doc_id"], "mark": part["mark"], "n_tokens": [len(t.split()) if t else 0 for t in texts], "posterior": list(p)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("mark")).mapInPandas(released(run), f"doc_id {kind}, mark long, n_tokens long, posterior array<double>")


def momentum(steps: int) -> list[float]:
    t, out = 1.0, []
    for _ in range(steps):
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        out.append((t - 1) / after)
        t = after
    return out


def replay(p: np.ndarray, rate: np.ndarray, before: np.ndarray, slopes: list[np.ndarray], weights: list[float], pace: float, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rates after the given steps, those before, and the point of the next gradient."""
    point = rate + weights[0] * (rate - before)
    for k, slope in enumerate(slopes):
        before, rate = rate, np.maximum(0, point - pace * (p @ slope + lam * (point - 1)))
        point = rate + weights[k + 1] * (rate - before)
    return rate, before, point


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float | None = None, steps: int = STEPS) -> DataFrame:
    """doc_id, mark (hash of id and text), n_tokens, posterior, rate for every row of docs (doc_id, text).

    targets: the wanted shares by domain; total: wanted tokens (all there are if None).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    shares = np.array([(targets or TARGETS)[d] for d in DOMAINS], float)
    shares = shares / shares.sum()
    state = scratch.keep(with_posteriors(docs, learn(docs, labels)).withColumn("rate", F.lit(1.0)).withColumn("before", F.lit(1.0)))
    width = range(len(DOMAINS))
    n = F.col("n_tokens")
    first = state.agg(F.sum(n), *[F.sum(n * F.col("posterior")[i] * F.col("posterior")[j]) for i in width for j in width]).first()
    everything = float(first[0] or 0)
    if not everything:
        return state.drop("before")
    curve = np.array([x or 0.0 for x in first[1:]]).reshape(len(DOMAINS), -1) / everything
    metric = np.linalg.inv(curve + 0.01 * np.eye(len(DOMAINS)))
    goal = shares * (total or everything) / everything
    pace = 1 / (float(np.abs(np.linalg.eigvals(metric @ curve)).max()) + LAMBDA)
    kick = momentum(steps + 1)
    done, slopes = 0, []

    def moved(final: bool):
        past, coefficients = list(slopes), kick[done : done + len(slopes) + 1]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                p = np.array(batch["posterior"].tolist(), np.float64).reshape(-1, len(DOMAINS))
                rate, before, point = replay(p, batch["rate"].to_numpy(), batch["before"].to_numpy(), past, coefficients, pace, LAMBDA)
                if final:
                    yield batch.assign(rate=rate, before=before)
                else:
                    yield pd.DataFrame([np.concatenate([(batch["n_tokens"].to_numpy() * v) @ p for v in (point, rate)])], columns=[f"s{k}" for k in range(2 * len(DOMAINS))])

        return run

    names = [f"s{k}" for k in range(2 * len(DOMAINS))]
    for _ in range(steps):
        sums = state.select("n_tokens", "posterior", "rate", "before").mapInPandas(moved(False), ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c) for c in names]).first()
        at_point, at_rate = np.array(sums, float).reshape(2, -1) / everything
        if np.abs(at_rate - goal).max() < CLOSE:
            break
        slopes.append(metric @ (at_point - goal))
        if len(slopes) == REPLAY:
            made = scratch.keep(state.mapInPandas(moved(True), state.schema))
            scratch.drop(state)
            state, done, slopes = made, done + REPLAY, []
    return state.mapInPandas(moved(True), state.schema).drop("before")


def copies(rated: DataFrame) -> DataFrame:
    """rated with copies: whole numbers with the rate as their expectation."""
    u = F.pmod(F.xxhash64("mark", F.lit("copies")), F.lit(1 << 40)) / float(1 << 40)
    return rated.withColumn("copies", F.floor(F.col("rate") + u).cast("int"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """docs with each row as often as its copies say; the same columns."""
    chosen = copies(rates(docs.select("doc_id", "text"), labels, targets, total)).groupBy("doc_id", "mark").agg(F.max("copies").alias("copies"))
    of, mark, own, many, copy = unused(docs, "of", "mark", "own", "many", "copy")
    told = chosen.where("copies > 0").select(F.col("doc_id").alias(of), F.col("mark").alias(mark), F.col("copies").alias(many))
    joined = docs.withColumn(own, F.xxhash64("doc_id", "text")).join(told, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(own) == F.col(mark)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*docs.columns)
