"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are rows labelled 1; every other training row counts as unlabelled web text, whatever its
label. With g the classifier's margin, l the logistic loss and p the class prior, training minimises

    p E_pos l(g) + max(0, E_unl l(-g) - p E_pos l(-g)),

stepping back along the second term where it turns negative, as the non-negative estimator does. The
prior is estimated first: a positive-against-unlabelled classifier ranks both sets, and p is the smallest upper
bound on (share of unlabelled above a cut) / (share of positives above it) over all cuts that leave
enough positives above (the best-bin estimator).

The classifier is a small network over ``text_features``; means and deviations come from all rows. At most
``MAX_POSITIVE`` labelled and ``MAX_UNLABELLED`` unlabelled rows train it, those first by a hash of their id.

Defined cases: null and empty texts are scored as all-zero measures; without positives every score is
0.5; repeated rows are scored each, repeated labels count as the lowest; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch
from tidewatch.llm.text_features import WIDTH, with_measures

MAX_POSITIVE, MAX_UNLABELLED = 8000, 16000
HIDDEN = 24
#: Steps of either training, however few the rows.
STEPS = 600
RATE = 5e-3
BATCH = 512


class Net:
    """One hidden tanh layer; margins are log odds."""

    def __init__(self, width: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.parts = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.m = [np.zeros_like(p) for p in self.parts]
        self.v = [np.zeros_like(p) for p in self.parts]
        self.steps = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.parts[0] + self.parts[1]) @ self.parts[2] + self.parts[3]

    def step(self, x: np.ndarray, slope: np.ndarray, rate: float = RATE, decay: float = 2e-2) -> None:
        """One Adam step along the gradient that has d loss / d margin = slope."""
        h = np.tanh(x @ self.parts[0] + self.parts[1])
        back = slope[:, None] * self.parts[2] * (1 - h * h)
        grads = [x.T @ back, back.sum(0), h.T @ slope, slope.sum(keepdims=True)]
        self.steps += 1
        for p, g, m, v in zip(self.parts, grads, self.m, self.v, strict=True):
            g = g + decay * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def nn_risk(margin_pos: np.ndarray, margin_unl: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive part and the (perhaps negative) estimate of the negative part of the risk."""
    return prior * softplus(-margin_pos).mean(), softplus(margin_unl).mean() - prior * softplus(margin_pos).mean()


def batches(rng: np.random.Generator, n_pos: int, n_unl: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    steps = max(1, n_unl // BATCH)
    unl, pos = rng.permutation(n_unl), np.resize(rng.permutation(n_pos), max(n_pos, steps * min(BATCH, n_pos)))
    yield from zip(np.array_split(pos, steps), np.array_split(unl, steps), strict=True)


def epochs(n_unl: int) -> int:
    return -(-STEPS // max(1, n_unl // BATCH))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 1) -> float:
    """Share of positives among the unlabelled."""
    half_pos, half_unl = np.arange(len(pos)) % 2 == 0, np.arange(len(unl)) % 2 == 0
    net, rng = Net(pos.shape[1], seed), np.random.default_rng(seed)
    a, b = pos[half_pos], unl[half_unl]
    for _ in range(epochs(len(b))):
        for p, u in batches(rng, len(a), len(b)):
            x = np.concatenate([a[p], b[u]])
            net.step(x, np.concatenate([-sigmoid(-net.margin(a[p])) / len(p), sigmoid(net.margin(b[u])) / len(u)]))
    held_pos, held_unl = (pos[~half_pos], unl[~half_unl]) if len(pos) > 1 and len(unl) > 1 else (pos, unl)
    s_pos, s_unl = np.sort(net.margin(held_pos)), np.sort(net.margin(held_unl))
    above_pos = 1 - np.arange(len(s_pos)) / len(s_pos)
    above_unl = 1 - np.searchsorted(s_unl, s_pos) / len(s_unl)
    slack = np.sqrt(np.log(40) / (2 * len(s_pos))) + np.sqrt(np.log(40) / (2 * len(s_unl)))
    ok = above_pos >= 0.05
    bound = (above_unl + slack) / above_pos
    best = np.flatnonzero(ok)[bound[ok].argmin()]
    return float(np.clip(above_unl[best] / above_pos[best], 0.05, 0.99))


def train(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int = 2) -> Net:
    net, rng = Net(pos.shape[1], seed), np.random.default_rng(seed)
    total = epochs(len(unl))
    for epoch in range(total):
        rate = RATE * (1 - epoch / total) + 1e-4
        for p, u in batches(rng, len(pos), len(unl)):
            mp, mu = net.margin(pos[p]), net.margin(unl[u])
            x = np.concatenate([pos[p], unl[u]])
            negative = np.concatenate([-prior * sigmoid(mp) / len(p), sigmoid(mu) / len(u)])
            if nn_risk(mp, mu, prior)[1] >= 0:
                slope = negative
                slope[: len(p)] -= prior * sigmoid(-mp) / len(p)
            else:
                slope = -negative
            net.step(x, slope, rate)
    return net


def first_by_hash(rows: DataFrame, most: int, salt: str, key: str = "doc_id") -> np.ndarray:
    """The measures of at most ``most`` rows, those with the smallest hash of their key."""
    n = rows.count()
    mark = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 40))
    share = min(1.0, (1.3 * most + 200) / max(n, 1))
    got = rows.where(mark < int(share * (1 << 40))).select(mark.alias("mark"), "measures").toPandas()
    got["order"] = got["measures"].map(tuple)
    got = got.sort_values(["mark", "order"])
    return np.array(got["measures"].tolist()[:most], np.float64).reshape(-1, WIDTH)


def score(docs: DataFrame, labels: DataFrame, may_learn: DataFrame) -> DataFrame:
    """doc_id and score for every row of docs (doc_id, text).

    labels: doc_id, quality. may_learn: the doc_id values that training may use, one row each.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    made = scratch.keep(with_measures(docs))
    stats = made.select(F.posexplode("measures")).groupBy("pos").agg(F.avg("col").alias("mean"), F.stddev_pop("col").alias("dev")).orderBy("pos").collect()
    mean, dev = np.zeros(WIDTH), np.ones(WIDTH)
    for r in stats:
        mean[r["pos"]], dev[r["pos"]] = r["mean"], r["dev"] if r["dev"] > 1e-9 else 1.0
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    usable = made.join(may_learn, "doc_id", "left_semi")
    pos = first_by_hash(usable.join(trusted, "doc_id", "left_semi"), MAX_POSITIVE, "positive")
    unl = first_by_hash(usable, MAX_UNLABELLED, "unlabelled")
    shape = lambda x: np.clip((x - mean) / dev, -6, 6)
    net = None
    if len(pos) and len(unl):
        pos, unl = shape(pos), shape(unl)
        net = train(pos, unl, estimate_prior(pos, unl))
    held = spark.sparkContext.broadcast((net.parts if net else None, mean, dev))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, mean, dev = held.value
        for batch in it:
            if parts is None or not len(batch):
                yield pd.DataFrame({"doc_id": batch["doc_id"], "score": np.full(len(batch), 0.5)})
                continue
            x = np.clip((np.array(batch["measures"].tolist(), np.float64) - mean) / dev, -6, 6)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": sigmoid(np.tanh(x @ parts[0] + parts[1]) @ parts[2] + parts[3])})

    return made.mapInPandas(run, f"doc_id {kind}, score double")
