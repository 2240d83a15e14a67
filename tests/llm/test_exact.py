import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SCHEMA
from tidewatch.llm import chat_format, cover_tree, packing
from tidewatch.llm.components import UnionFind, components
from tidewatch.llm.common import Scratch
from tidewatch.llm.queries import word_tokenizer_path


def test_chat_round_trip(spark):
    rng = random.Random(3)
    marks = ["\\", "#", "<", ":", "### ", "</turn>\n", "\\b", "\\l", "user: ", "é😀", " ", "a"]
    said = lambda: "".join(rng.choice(marks) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a:b#", None]), rng.choice([said(), said(), None])) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [rows[0], (None, None, "assistant", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.format_conversations(d)
    read = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in made.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns")).collect()}
    low = lambda x: (x is not None, x)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (low(r[1]), r[2] or "", r[3] or ""))
        assert read[c] == [(r[2] or "", r[3] or "") for r in own]
    for e in chat_format.examples(made).select("*", chat_format.unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("reply")).collect():
        own = [t for r, t in read[e.conv_id] if r == "assistant"]
        assert e.reply == own[e.number] and e.text.endswith("</turn>\n") and e.text.count("</turn>\n") >= e.number + 1
    assert chat_format.format_conversations(d.where("false")).count() == 0


def brute_best(where, penalty, size):
    best = [0.0] + [np.inf] * (len(where) - 1)
    for j in range(1, len(where)):
        for i in range(j):
            n = where[j] - where[i]
            if n <= size:
                pad = 0 if n & (n - 1) == 0 else size - n
                best[j] = min(best[j], best[i] + pad + penalty[j])
    return best[-1]


def test_best_cuts_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        where = np.concatenate([[0], np.cumsum(rng.integers(1, 16, rng.integers(1, 40)))])
        penalty = rng.choice([0, 1, 5], len(where)).astype(float)
        cuts = packing.best_cuts(where, penalty, 16, 1)
        cost = sum((0 if (n := where[b] - where[a]) & (n - 1) == 0 else 16 - n) + penalty[b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        assert cuts[0] == 0 and cuts[-1] == len(where) - 1 and cost == brute_best(where, penalty, 16)


def test_packing_is_complete(docs, rows, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer_path())
    got = packing.pack(docs, word_tokenizer_path()).collect()
    ids = {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows}
    by_doc = {}
    by_sequence = {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert zlib.crc32(part.tobytes()) == p.ids_crc32 and len(part) == p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
    copies = {}
    for r in rows:
        copies[r[0]] = copies.get(r[0], 0) + 1
    for doc, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == copies[doc] * len(ids[doc])
    assert set(by_doc) == set(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.pack(none, word_tokenizer_path()).count() == 0


def test_sentences_are_cut_only_where_nothing_else_fits():
    rng = np.random.default_rng(5)
    ends = np.array([False, True, False])
    docs = []
    for k in range(60):
        ids = np.zeros(int(rng.integers(1, 400)), np.uint32)
        ids[rng.random(len(ids)) < 0.05] = 1
        docs.append((k, ids))
    docs[30] = (30, np.zeros(700, np.uint32))  # a sentence of more than five sequences
    pieces = [p for part in packing.pack_stream(iter(docs), ends, size=128, buffer=2000) for p in part]
    for doc, start, length, *_ in pieces:
        ids = docs[doc][1]
        assert doc == 30 or start + length == len(ids) or ends[ids[start + length - 1]] or max(np.diff(np.flatnonzero(np.concatenate([[True], ends[ids], [True]])))) > 128
    assert [sum(p[2] for p in pieces if p[0] == k) for k in range(60)] == [len(x) for _, x in docs]


def test_word_tokens_equal_the_tokenizer():
    tokens = packing.word_tokens(word_tokenizer_path())
    rng = random.Random(7)
    odd = ["", "  ", "Á ﬁ ẞ Straße İstanbul don't I'LL x²½", "<|endoftext|>a <|startoftext|>", "中文 текст ΟΔΟΣ ς", "a\x1cb\x85c\xa0d e", "1234 ++ --''s 'sx", "\x00\x7f µª º × ÷", "w" * 200]
    odd += ["".join(rng.choice("abcE é'.,!0 9\n\tßœñ-<|>") for _ in range(60)) for _ in range(400)]
    for text in odd:
        assert tokens.of(text).tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids + [1], text


def part_of(n, links):
    u = UnionFind(n)
    for a, b in links:
        u.merge(np.array([a]), np.array([b]))
    return [u.find(i) for i in range(n)]


def test_dual_traversal_matches_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        d, k, n = int(rng.choice([2, 3, 8, 64])), rng.integers(1, 12), int(rng.integers(2, 250))
        centres = rng.normal(size=(k, d))
        x = cover_tree.unit(centres[rng.integers(0, k, n)] + rng.normal(size=(n, d)) * rng.choice([0.01, 0.1, 0.3]))
        w = rng.integers(1, 4, n)
        tree = cover_tree.build(x)
        tree["weight"] = w
        got = cover_tree.dual(tree, tree, True)
        near = x @ x.T >= 0.95
        np.fill_diagonal(near, False)
        assert (got.count[0] == near @ w).all() and len(got.forest) < n
        assert part_of(n, got.forest) == part_of(n, np.argwhere(near))
        h = n // 2
        a, b = cover_tree.build(x[:h]), cover_tree.build(x[h:])
        a["weight"], b["weight"] = w[:h], w[h:]
        got, near = cover_tree.dual(a, b, False), x[:h] @ x[h:].T >= 0.95
        assert (got.count[0] == near @ w[h:]).all() and (got.count[1] == w[:h] @ near).all()


def test_near_vectors_defined_cases(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0]), (None, [1.0, 0.0]), (11, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = cover_tree.near_vectors(d).collect()
    assert len(got) == len(rows)
    for r in got:
        linked = r.vec_id in (1, 2, 3, 11)
        assert r.n_links == (3 if linked else 0)
        assert r.component_id == (1 if linked else r.vec_id)
    assert cover_tree.near_vectors(d.where("false")).count() == 0


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 40)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(9, 8))[rng.integers(0, 9, 300)] + 0.15 * rng.normal(size=(300, 8))).astype(np.float32)
    x[200:230] = x[10]
    d = spark.createDataFrame([(k + 5, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = cover_tree.unit(x)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    comp = part_of(300, np.argwhere(near))
    for r in cover_tree.near_vectors(d).collect():
        assert (r.n_links, r.component_id) == (near[r.vec_id - 5].sum(), comp[r.vec_id - 5] + 5)


def test_blocks_are_compared_without_a_shuffle(spark, monkeypatch):
    plans, keep = {}, Scratch.keep

    def watched(self, df):
        plans[tuple(df.columns)] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df)

    monkeypatch.setattr(Scratch, "keep", watched)
    monkeypatch.setattr(cover_tree, "BLOCK", 20)
    monkeypatch.setattr(cover_tree, "AT_ONCE", 2)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 3))
    unit = cover_tree.unit(x)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    comp = part_of(150, np.argwhere(near))
    for kind in ("double", "decimal(20,17)"):
        d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").selectExpr("vec_id", f"cast(embedding AS array<{kind}>) AS embedding")
        for r in cover_tree.near_vectors(d).collect():
            assert (r.n_links, r.component_id) == (near[r.vec_id].sum(), comp[r.vec_id])
    plan = plans["kind", "a", "b"]
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(400, 480)]
    want = part_of(600, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got.get(k, k) == want[k] for k in range(600))


def test_pipeline_stages(spark, docs, none, tmp_path):
    spark.createDataFrame([(3, 1, 0), (13, 0, 0), (23, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, none):
        rows = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before = rows
            rows = spark.createDataFrame(stage(spark, rows, str(tmp_path)).collect(), SCHEMA)
            assert rows.columns == before.columns
        corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).collect()
    deduped = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert deduped.count() == deduped.select("doc_id").distinct().count()


def test_pipeline_links_copies_of_eighty_percent(spark, tmp_path):
    words = [f"w{k}" for k in range(304)]
    edit = lambda places: " ".join(f"e{k}" if k in places else w for k, w in enumerate(words))
    # six and eight edited words of 300 shingles: similarities 270 / 330 = 0.818 and 260 / 340 = 0.765
    rows = [(1, edit([])), (2, edit(range(20, 300, 50))), (3, edit(range(10, 300, 38)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, d, str(tmp_path)).collect()) == [1, 3]


def test_held_out_rows(spark):
    from tidewatch.llm.common import held_out

    for r in spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2)


def test_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
