"""Exact pairs of vectors within a cosine threshold, by dual traversal of cover trees.

Unit vectors at cosine c lie ``sqrt(2 - 2c)`` apart. Vectors that are equal are one class. At most ``MAX_CELLS`` pivots,
a bounded sample of the classes, cut the classes into cells by nearest pivot; every class is in a cell, and a cell
above ``BLOCK`` classes is dealt over several blocks. Each block gets a cover tree, built once: nested nodes whose radii halve from
level to level, with the largest distance to a member as covering radius. Two cells are compared unless the
distance of their pivots less both radii is beyond the threshold. Trees are stored once, and a task reads a file of them
for either side (a Cartesian product, which shuffles nothing), so disk grows with the vectors, whatever the number of pairs. A pair of blocks
is compared by walking both trees together: child centres are compared by one matrix product, a node pair is pruned where the
distance less both radii is beyond the threshold, and taken whole, without visiting its members, where the distance
plus both radii is within it. Pruning runs in single precision with a margin; any pair that no bound decides is
decided by its cosine in double precision. A task returns sums of links and a spanning forest, never
all pairs, so a group of near-copies gives output in its own size.

Defined cases: a vector that is null, empty, zero, or has null or non-finite components links with
nothing and is its own component; vectors of different lengths never link; rows that repeat an id and its
vector are one vector; a null id links with nothing; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch
from tidewatch.llm.components import UnionFind, components

COSINE = 0.95
BLOCK = 4096
MAX_CELLS = 512
#: Trees in a file, about: a task holds one file of the right side.
AT_ONCE = 8
#: Added to every bound that is found in single precision.
MARGIN = 2e-3
#: The radius from which levels halve. Coarser levels prune nothing: their nodes reach further than vectors lie apart.
ROOT = 1.0
LEAF = 0.05


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def build(x: np.ndarray) -> dict:
    """The cover tree of unit vectors: per node its centre, radius, members order[start:end], children first:last."""
    single = x.astype(np.float32)
    centre, radius, start, end, first, last = [], [], [], [], [], []
    todo = [(0, np.arange(len(x)), ROOT)]
    made: list[tuple] = []  # centre, members, groups
    while todo:
        c, members, r = todo.pop()
        groups = None
        while len(members) > 1 and r > LEAF:
            r /= 2
            near = gaps(single[members], single[members])
            free = np.ones(len(members), bool)
            place = int(np.flatnonzero(members == c)[0])
            groups = []
            while True:
                take = free & (near[place] <= r)
                take[place] = True
                free &= ~take
                groups.append((int(members[place]), members[take]))
                rest = free.argmax()
                if not free[rest]:
                    break
                place = int(rest)
            if len(groups) > 1:
                break
            groups = None
        made.append((c, members, groups))
        todo += [(*g, r) for g in groups or ()]
    # place children next to each other: breadth first over the groups
    index = {(c, len(members)): k for k, (c, members, _) in enumerate(made)}  # a nested centre's node is smaller
    queue, ranges = [0], [(0, len(x))]
    order = np.empty(len(x), np.int64)
    at = 0
    while at < len(queue):
        c, members, groups = made[queue[at]]
        s, e = ranges[at]
        centre.append(c)
        radius.append(float(gaps(single[members], single[c][None]).max()) if len(members) > 1 else 0.0)
        start.append(s)
        end.append(e)
        first.append(len(queue))
        if groups:
            for g, m in groups:
                queue.append(index[g, len(m)])
                ranges.append((s, s + len(m)))
                s += len(m)
        else:
            order[s:e] = members
        last.append(len(queue))
        at += 1
    return {"x": x, "single": single, "order": order, **{k: np.array(v) for k, v in (("centre", centre), ("radius", np.array(radius, np.float32)), ("start", start), ("end", end), ("first", first), ("last", last))}}


class Links:
    """What a traversal finds: weighted link counts of either side, and a forest over both sides' members."""

    def __init__(self, a: dict, b: dict, same: bool):
        self.a, self.b, self.same = a, b, same
        self.count = (np.zeros(len(a["x"]), np.int64), np.zeros(len(b["x"]), np.int64))
        self.forest: list[tuple[int, int]] = []
        self.union = UnionFind(len(a["x"]) + (0 if same else len(b["x"])))
        self.shift = 0 if same else len(a["x"])

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        new = self.union.merge(i, j + self.shift)
        self.forest += list(zip(i[new].tolist(), j[new].tolist(), strict=True))

    def whole(self, i: np.ndarray, j: np.ndarray, own: bool) -> None:
        """All members i of one node with all members j of the other; own: the node with itself."""
        wa, wb = self.a["weight"], self.b["weight"]
        self.count[0][i] += wb[j].sum()
        if own:
            self.count[0][i] -= wa[i]
        else:
            (self.count[0] if self.same else self.count[1])[j] += wa[i].sum()
        self.join(np.full(len(j), i[0]), j)
        self.join(i, np.full(len(i), j[0]))

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        """Single pairs, each once, by their cosines."""
        for k in range(0, len(i), 200_000):
            p, q = i[k : k + 200_000], j[k : k + 200_000]
            linked = np.einsum("ij,ij->i", self.a["x"][p], self.b["x"][q]) >= COSINE
            p, q = p[linked], q[linked]
            np.add.at(self.count[0], p, self.b["weight"][q])
            np.add.at(self.count[0] if self.same else self.count[1], q, self.a["weight"][p])
            self.join(p, q)

    def square(self, i: np.ndarray, j: np.ndarray, own: bool) -> None:
        """Many members with many: one product; the forest by breadth-first search over its rows."""
        for k in range(0, len(i), 1024):
            p = i[k : k + 1024]
            linked = self.a["x"][p] @ self.b["x"][j].T >= COSINE
            if own:
                linked &= p[:, None] < j[None, :]
            self.count[0][p] += linked @ self.b["weight"][j]
            (self.count[0] if self.same else self.count[1])[j] += self.a["weight"][p] @ linked
            # columns of one part give the forest no more than one link from a row
            part = np.array([self.union.find(x) for x in (j + self.shift).tolist()])
            for row, node in zip(linked, p, strict=True):
                if row.any():
                    roots, place = np.unique(part[row], return_index=True)
                    to = j[np.flatnonzero(row)[place]]
                    self.join(np.full(len(to), node), to)
                    part[np.isin(part, roots)] = self.union.find(int(node))


def close(x: np.ndarray, y: np.ndarray, limit: np.ndarray | float, upper: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with |x_i - y_j| <= limit; upper: x is y, and only i < j. In slices that stay in cache."""
    least = 1 - np.minimum(limit, 2.0) ** 2 / 2
    rows, columns = [], []
    for k in range(0, len(x), 256):
        skip = k if upper else 0
        dots = x[k : k + 256] @ y[skip:].T
        flat = np.flatnonzero(dots >= (least if np.isscalar(least) or least.ndim == 0 else least[k : k + 256, skip:]))
        rows.append(flat // dots.shape[1] + k)
        columns.append(flat % dots.shape[1] + skip)
    i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, columns))
    return (i[i < j], j[i < j]) if upper else (i, j)


def dual(a: dict, b: dict, same: bool, cosine: float = COSINE) -> Links:
    """All links between the members of two trees (same: within one).

    A step compares a set of nodes with another set. What survives is taken as single pairs, taken whole, or opened: both nodes, or
    the larger one against all single-member partners it has at once.
    """
    reach = float(np.sqrt(2 - 2 * cosine))
    out = Links(a, b, same)
    size_a, size_b = a["end"] - a["start"], b["end"] - b["start"]
    kids = lambda t, u: np.arange(t["first"][u], t["last"][u])
    members = lambda t, u: t["order"][t["start"][u] : t["end"][u]]
    todo = [(np.array([0]), np.array([0]), same)]
    while todo:
        us, vs, own = todo.pop()
        ua, va = a["single"][a["centre"][us]], b["single"][b["centre"][vs]]
        small_u, small_v = np.flatnonzero(size_a[us] == 1), np.flatnonzero(size_b[vs] == 1)
        large_u, large_v = np.flatnonzero(size_a[us] > 1), np.flatnonzero(size_b[vs] > 1)
        i, j = close(ua[small_u], va[small_v], reach + MARGIN, own)
        out.pairs(a["centre"][us[small_u[i]]], b["centre"][vs[small_v[j]]])
        # a large node against all single members of the other set
        for large, small, left in ((large_u, small_v, True), (large_v, small_u, False)):
            if not len(large) or not len(small) or (own and not left):
                continue
            t, nodes, other = (a, us[large], vs[small]) if left else (b, vs[large], us[small])
            x, y = (ua[large], va[small]) if left else (va[large], ua[small])
            i, j = close(x, y, reach + MARGIN + np.repeat(t["radius"][nodes][:, None], len(small), axis=1))
            cut = np.flatnonzero(np.diff(i)) + 1
            for rows, columns in zip(np.split(i, cut), np.split(j, cut), strict=True):
                if not len(rows):
                    continue
                u, partners = nodes[rows[0]], other[columns]
                if t["first"][u] == t["last"][u]:
                    one, two = members(t, u), (b if left else a)["centre"][partners]
                    out.square(one, two, False) if left else out.square(two, one, False)
                else:
                    todo.append((kids(t, u), partners, False) if left else (partners, kids(t, u), False))
        if not len(large_u) or not len(large_v):
            continue
        near = gaps(ua[large_u], va[large_v])
        span = a["radius"][us[large_u]][:, None] + b["radius"][vs[large_v]][None, :]
        live = near - span <= reach + MARGIN
        if own:
            live &= large_u[:, None] <= large_v[None, :]
        for i, j in np.argwhere(live):
            u, v = us[large_u[i]], vs[large_v[j]]
            mine = own and u == v
            if near[i, j] + span[i, j] <= reach - MARGIN:
                out.whole(members(a, u), members(b, v), mine)
            elif a["first"][u] == a["last"][u] and b["first"][v] == b["last"][v]:
                out.square(members(a, u), members(b, v), mine)
            else:
                todo.append((kids(a, u) if a["first"][u] < a["last"][u] else np.array([u]), kids(b, v) if b["first"][v] < b["last"][v] else np.array([v]), mine))
    return out


def near_vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", cosine: float = COSINE) -> DataFrame:
    """key, n_links, component_id, kept for every row."""
    if cosine != COSINE:
        raise ValueError("the threshold is a constant of this module")
    spark = rows.sparkSession
    scratch = Scratch(spark, "cover-tree")
    # single precision stays as it is until a task compares: it is half of what tables and shuffles hold
    kind = "float" if rows.schema[vector].dataType.simpleString() == "array<float>" else "double"
    value = F.col(vector).cast(f"array<{kind}>")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    usable = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(key).cast("bigint").alias("id"), value.alias("v")).distinct()
    classes = scratch.keep(usable.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")).withColumn("width", F.size("v")))
    n = classes.count()
    if not n:
        return rows.select(key, F.lit(0).cast("bigint").alias("n_links"), F.col(key).cast("bigint").alias("component_id"), F.lit(True).alias("kept"))
    wanted = int(np.clip(-(-n // BLOCK), 1, MAX_CELLS))
    share = min(1.0, (3.0 * wanted + 50) / n)
    mark = F.pmod(F.xxhash64("rep", F.lit("pivot")), F.lit(1 << 40))
    sample = classes.where(mark < int(share * (1 << 40))).orderBy(mark, "rep").limit(wanted).select("v", "width").collect()
    widths = [r[0] for r in classes.select("width").distinct().collect()]
    pivots = {w: unit(np.array([r["v"] for r in sample if r["width"] == w])) if any(r["width"] == w for r in sample) else None for w in widths}
    held = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, gap = np.zeros(len(batch), np.int64), np.full(len(batch), 2.0)
            kinds = batch["width"].to_numpy()
            for w in np.unique(kinds):
                at = np.flatnonzero(kinds == w)
                if held.value.get(int(w)) is not None:
                    far = gaps(unit(np.array(batch["v"].iloc[at].tolist())), held.value[int(w)])
                    cell[at], gap[at] = far.argmin(1), far.min(1)
            yield pd.DataFrame({"rep": batch["rep"], "weight": batch["weight"], "v": batch["v"], "width": batch["width"], "cell": cell, "gap": gap})

    placed = scratch.keep(classes.select("rep", "weight", "v", "width").mapInPandas(assign, f"rep long, weight long, v array<{kind}>, width int, cell long, gap double"))
    # at most MAX_CELLS rows for each vector length
    cells = {(r["width"], r["cell"]): (r["n"], r["far"]) for r in placed.groupBy("width", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("far")).collect()}
    parts = {k: -(-n // BLOCK) for k, (n, _) in cells.items()}
    first = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist(), strict=False))  # the number of a cell's first block
    table = spark.createDataFrame([(w, c, s, first[w, c]) for (w, c), s in parts.items()], "width int, cell long, parts long, first long")
    blocks = placed.join(F.broadcast(table), ["width", "cell"]).withColumn("number", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts")))
    reach = float(np.sqrt(2 - 2 * cosine))
    plan = spark.sparkContext.broadcast(cells)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        raw = np.array(pdf["v"].tolist())
        tree = build(unit(raw))
        tree["rep"], tree["weight"], tree["raw"] = pdf["rep"].to_numpy(), pdf["weight"].to_numpy(), raw
        del tree["single"], tree["x"]
        w, c, k = (int(pdf[name].iloc[0]) for name in ("width", "cell", "number"))
        others = np.array(sorted(cell for width, cell in plan.value if width == w))
        piv = held.value[w]
        if piv is not None:
            far = gaps(piv[others], piv[[c]])[:, 0] - np.array([plan.value[w, o][1] for o in others]) - plan.value[w, c][1]
            others = others[far <= reach + MARGIN]
        return pd.DataFrame({"width": [w], "cell": [c], "number": [k], "near": [others], "tree": [pickle.dumps(tree)]})

    # files of about AT_ONCE trees, but enough of them that their pairs occupy all cores
    total = sum(parts.values())
    files = max(-(-total // AT_ONCE), min(total, int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism)))))
    trees = scratch.keep(blocks.repartition(files, "width", "cell", "number").groupBy("width", "cell", "number").applyInPandas(make, "width int, cell long, number long, near array<long>, tree binary"))
    scratch.drop(placed)
    # each task reads the files of either side from the shared folder, so trees are stored once and nothing is shuffled; a pair's sides alternate, which evens out the tasks
    one, two = (trees.select(*[F.col(c).alias(c + side) for c in trees.columns]) for side in "12")
    same, sides = F.col("number1") == F.col("number2"), (F.col("number1") < F.col("number2")) == ((F.col("number1") + F.col("number2")) % 2 == 0)
    meet = (F.col("width1") == F.col("width2")) & (same | sides) & F.array_contains("near1", F.col("cell2"))
    pairs = one.join(two.hint("shuffle_replicate_nl"), meet).select("number1", "number2", "tree1", "tree2")

    def opened(blob: bytes) -> dict:
        tree = pickle.loads(blob)
        tree["x"] = unit(tree.pop("raw"))
        tree["single"] = tree["x"].astype(np.float32)
        return tree

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, a = None, {}
        for batch in batches:
            for i, j, left, right in zip(batch["number1"], batch["number2"], batch["tree1"], batch["tree2"], strict=True):
                if at != i:
                    at, a = i, opened(left)
                b = a if i == j else opened(right)
                got = dual(a, b, i == j)
                for tree, count in ((a, got.count[0]), (b, got.count[1])):
                    hit = np.flatnonzero(count)
                    yield pd.DataFrame({"kind": 0, "a": tree["rep"][hit], "b": count[hit]})
                if got.forest:
                    p, q = np.array(got.forest).T
                    yield pd.DataFrame({"kind": 1, "a": a["rep"][p], "b": b["rep"][q]})

    found = scratch.keep(pairs.mapInPandas(compare, "kind int, a long, b long"))
    scratch.drop(trees)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    comps = components(found.where("kind = 1").select("a", "b"), scratch)
    done = (
        classes.select("v", "rep", "weight")
        .join(counts, "rep", "left")
        .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    out = rows.select(F.col(key), value.alias("own")).join(done, (F.col("own") == F.col("v")) & F.col(key).isNotNull(), "left")
    return out.select(
        key, F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce(F.col("component"), F.col(key)).cast("bigint").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
