"""Vector codes, multiset fingerprints and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, WORDS
from tidewatch.llm import multiset_hash, tiered_search, vector_codes
from tidewatch.llm.common import Scratch

# --- vector codes -------------------------------------------------------------------------


def plain_lloyd(x, parts, entries, rounds):
    """All entries compared in every round, in Python's integers."""
    wide = x.shape[1] // parts
    cut = x.reshape(len(x), parts, wide)
    books = cut[:entries].copy().transpose(1, 0, 2)

    def nearest(p):
        return ((cut[:, p, None, :] - books[p][None]) ** 2).sum(axis=2).argmin(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            a = nearest(p)
            for e in set(a.tolist()):
                books[p, e] = cut[a == e, p].sum(axis=0) // (a == e).sum()
    codes = np.stack([nearest(p) for p in range(parts)], axis=1)
    error = sum(((cut[:, p] - books[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(parts))
    return codes, error, books


VECTORS = "vec_id long, embedding array<float>, label int, code string"


def test_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 16))
    x = (centres[rng.integers(0, 9, 400)] + 0.2 * rng.normal(size=(400, 16))).astype(np.float32)
    x[50:90] = x[50]  # copies: equal entries and ties
    x[90:100] = np.round(x[90:100])
    rows = [(k, x[k].tolist(), None if k % 3 == 0 else k % 3, "clash") for k in range(400)]
    odd = [(900, None, 1, ""), (901, [float("nan")] * 16, 1, ""), (902, [None] * 16, 1, ""), (903, [float("inf")] + [0.0] * 15, 1, ""), (904, [0.5] * 5, 1, ""), (905, [], 2, "")]
    d = spark.createDataFrame(rows + odd, VECTORS).repartition(3)
    state, books = vector_codes.fit(d, entries=40, rounds=4)
    codes, error, want = plain_lloyd(np.floor(x.astype(np.float64) * 1024).astype(np.int64), 4, 40, 4)
    assert (books.entries == want).all()
    got = {r.vec_id: r for r in vector_codes.coded(state, books).collect()}
    assert set(got) == {*range(400), 904, 905} and got[904].code is None and got[905].error is None
    assert all(got[k].code == bytes(codes[k].tolist()).hex() and got[k].error == error[k] for k in range(400))
    out = {r.vec_id: r for r in vector_codes.compress(d).collect()}
    assert out[0].label_error == out[3].label_error == sum(out[k].error for k in range(0, 400, 3))
    assert out[1].codebooks_sha256 == out[904].codebooks_sha256


def test_bounds_spare_scans_and_keep_ties():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (12, 8))
    x = centres[rng.integers(0, 12, 3000)] + rng.integers(-40, 40, (3000, 8))
    old = centres.astype(np.int64)
    new = old + rng.integers(-15, 15, old.shape)
    new[5] = new[2]  # an equal entry: the lower index must win
    entry, upper, lower = vector_codes.scan(x, old)
    scans = vector_codes.assign_part(x, entry, upper, lower, old, new)
    gaps = ((x[:, None] - new[None]) ** 2).sum(axis=2)
    assert (entry == gaps.argmin(axis=1)).all() and 0 < scans < 1500
    true = np.sqrt(gaps[np.arange(len(x)), entry])
    gaps[np.arange(len(x)), entry] = np.iinfo(np.int64).max
    assert (upper >= true).all() and (lower <= np.sqrt(gaps.min(axis=1))).all()


def test_large_components_stay_exact():
    big = vector_codes.LARGEST
    x = np.array([[big, -big], [big - 1, -big], [0, 0]], np.int64)
    assert vector_codes.squares(x, x).tolist() == [[0, 1, 2 * big * big], [1, 0, (big - 1) ** 2 + big * big], [2 * big * big, (big - 1) ** 2 + big * big, 0]]


def test_codes_of_few_or_no_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(none).count() == 0
    one = spark.createDataFrame([(None, [1.0, 2.0, 3.0, 4.0], None, ""), (None, [1.0, 2.0, 3.0, 4.0], None, "")], VECTORS)
    assert [(r.code, r.error, r.label_error) for r in vector_codes.compress(one).collect()] == [("00000000", 0, 0)] * 2
    assert [r.code for r in vector_codes.compress(spark.createDataFrame([(1, [1.0, 2.0], 1, "")], VECTORS)).collect()] == [None]


# --- multiset fingerprints ----------------------------------------------------------------


def brute_vector(text):
    units = re.findall(multiset_hash.SENTENCE, text) + ["\n" + p for p in text.split("\n")]
    counts = [0] * 180
    for u in units:
        digest = hashlib.sha256(u.encode()).hexdigest()
        for k in range(3):
            h = int(digest[15 * k : 15 * k + 15], 16)
            for j in range(60):
                counts[60 * k + j] += h >> j & 1
    return [len(units)] + [sum(counts[3 * w + c] << 20 * c for c in range(3)) & multiset_hash.FULL for w in range(60)]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    signs = [[2 * (w >> 20 * c & 0xFFFFF) - v[0] for w in v[1:] for c in range(3)] for v in (a, b)]
    squares = sum(x * x for x in signs[0]) * sum(x * x for x in signs[1])
    return min(1.0, max(0.0, sum(x * y for x, y in zip(*signs, strict=True)) / math.sqrt(squares))) if squares else 0.0


def test_edited_fingerprints(spark, docs, rows):
    got = multiset_hash.edited(docs).select("*", multiset_hash.likeness(F.col("vector"), F.col("edited_vector")).alias("a"), multiset_hash.likeness(F.col("vector"), F.col("next_vector")).alias("b")).collect()
    assert len(got) == len(rows)
    keys = sorted({(r[0], r[1] or "") for r in rows}, key=lambda k: (k[0] is None, -(k[0] or 0)))
    want = {}
    for (i, text), (_, after) in zip(keys, keys[1:] + keys[:1], strict=True):
        n = len(text) // 3
        new = text[: len(text) - n] + after[:n]
        want[i] = (len(text), new, brute_vector(text), brute_vector(new), brute_vector(after))
    for r in got:
        w = want[r.doc_id]
        assert (r.n_chars, r.edited, r.vector, r.edited_vector, r.next_vector) == w
        assert r.a == pytest.approx(brute_likeness(w[2], w[3])) and r.b == pytest.approx(brute_likeness(w[2], w[4]))
    assert multiset_hash.edited(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = multiset_hash.edited(spark.createDataFrame([(1, "abc def", None, None, 0, None)], SCHEMA)).first()
    assert alone.edited == "abc d" + "ab" and alone.next_vector == alone.vector


def test_fingerprints_add_up(spark):
    parts = ["One. Two!", "", "Three? four", "é😀.", "One. Two!"]
    rng = random.Random(2)
    mixed = parts[:]
    rng.shuffle(mixed)
    texts = ["\n".join(parts), "\n".join(mixed), "\n".join(parts[:2]), "\n".join(parts[2:]), "\n".join(parts[:-1])]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    v = {r.doc_id: r.vector for r in multiset_hash.fingerprints(d).collect()}
    assert v[0] == v[1] and v[0] != v[4]
    both = spark.createDataFrame([(v[2], v[3], v[0])], "a array<bigint>, b array<bigint>, c array<bigint>")
    r = both.select(multiset_hash.add(F.col("a"), F.col("b")).alias("sum"), multiset_hash.subtract(F.col("c"), F.col("a")).alias("rest"), multiset_hash.to_hex(F.col("c")).alias("hex")).first()
    assert r.sum == v[0] and r.rest == v[3] and len(r.hex) == 15 * 61


def test_many_units(spark, monkeypatch):
    monkeypatch.setattr(multiset_hash, "CHUNK", 100)
    text = "".join(f"s{k}." for k in range(1000))
    assert multiset_hash.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().vector == brute_vector(text)


# --- ranked search ------------------------------------------------------------------------


def brute_rank(docs, items, top=20):
    terms = lambda t: re.findall(tiered_search.TERM, (t or "").translate(str.maketrans(tiered_search.UPPER, tiered_search.LOWER)))
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked = [t for text in {t for i, t in items if i == item} for t in terms(text)]
        scored = []
        for i, c in found:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def zipf_text(rng, n):
    vocabulary = WORDS + [f"rare{k}" for k in range(400)]
    return " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=n))


@pytest.fixture(scope="module")
def search_case(spark):
    rng = random.Random(8)
    docs = [(k, zipf_text(rng, rng.randint(1, 120))) for k in range(700)]
    docs += [(1000 + k, docs[3][1]) for k in range(60)]  # a group of equal scores
    docs += [(None, "rare7 ALPHA"), (None, None), (2000, ""), (2001, " ,.; "), (2002, "É rare9 é😀 x_y"), docs[5], docs[5]]
    items = [(k, zipf_text(rng, 25)) for k in range(30)] + [(40, "ALPHA alpha rare9"), (41, None), (42, ""), (43, "nowhere"), (44, docs[3][1]), (44, docs[3][1]), (45, "rare7"), (45, "x é😀"), (None, "beta")]
    return docs, items, spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, term string").repartition(4), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("tiers,shard_terms,block_terms", [((4, 40), 6000, 100), ((64, 512), 10**9, 10**9), ((20,), 2000, 10**9)])
def test_search_equals_brute_force(search_case, tiers, shard_terms, block_terms):
    docs, items, d, q = search_case
    got = sorted([tuple(r) for r in tiered_search.rank(d, q, tiers=tiers, shard_terms=shard_terms, block_terms=block_terms).collect()], key=str)
    assert got == brute_rank(docs, items)


def test_lower_tiers_are_read_only_without_proof(spark, search_case):
    docs, items, d, q = search_case
    index = tiered_search.build(d, Scratch(spark, "t"), (30, 200), 6000)
    asked = [[("rare9", 7)], [("alpha", 5), ("beta", 3), ("gamma", 2)]]
    settled, left = tiered_search.search_block(index, asked, Scratch(spark, "t"))
    shards = index.lists(-1).count()
    assert left[0] == shards  # the rare term is settled in tier 0 everywhere, the frequent ones nowhere
    assert settled.where("item = 0").count() > 0 and settled.where("item = 1").count() >= 20


def test_a_shard_is_settled_only_when_no_tie_is_left():
    """Document 5 ties with the last of the best and comes in the lower tier: it has the smaller id."""
    ids = pa.array([10, 11, 5], pa.int64())
    rows = pa.table(
        {
            "tier": pa.array([-1, 0, 1], pa.int32()), "term": ["", "a", "a"], "rest": pa.array([0, 7, 0], pa.int64()),
            "places": pa.array([[], [0, 1], [2]], pa.list_(pa.int32())), "impacts": pa.array([[], [9, 7], [7]], pa.list_(pa.int32())), "docs": pa.array([ids.to_pylist(), [], []], pa.list_(pa.int64())),
        }
    )
    assert not tiered_search.Shard(rows.slice(0, 2)).search([("a", 1)], 0, 2)[0]
    settled, best, score = tiered_search.Shard(rows).search([("a", 1)], 0, 2)
    assert settled and best.tolist() == [0, 2] and score.tolist() == [9, 7]
    assert tiered_search.Shard(rows.slice(0, 2)).search([("a", 1)], 8, 2)[0]  # others reached more: nothing below can come in


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert tiered_search.rank(none, items).count() == 0
    assert tiered_search.rank(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.where("false")).count() == 0
