import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA, prose
from tidewatch.llm import minhash, quality_rules, suffix_dedup
from tidewatch.llm.run_index import RunIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_word_rules_match_brute_force(docs):
    for r in quality_rules.judge(docs).join(docs.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(r.text), r.doc_id
        assert not (r.base_failed and r.kept)


def test_rules_keep_every_row_and_empty_tables(docs, none):
    assert quality_rules.judge(docs).count() == docs.count()
    assert quality_rules.judge(none).count() == 0
    assert quality_rules.keep(docs).columns == docs.columns


def brute_verdicts(rows, min_docs=20, max_share=0.1, min_left=0.3):
    """(doc_id, n_removed_lines, n_words_left, kept) by loops over (doc_id, text, source)."""
    normal = lambda x: re.sub(" +", " ", re.sub("[\x20\t-\r]", " ", x)).strip(" ").lower().translate(str.maketrans("123456789", "0" * 9))
    lines = lambda t: [x for x in (t or "").split("\n") if WORD.search(x)]
    holders, contents = {}, {}
    for _, text, host in rows:
        contents.setdefault(host, set()).add(text or "")
        for x in lines(text):
            holders.setdefault((host, normal(x)), set()).add(text)
    out = []
    for doc, text, host in rows:
        gone = [x for x in lines(text) if len(holders[host, normal(x)]) > max(min_docs, max_share * len(contents[host]))]
        n, *_, failed = brute_rules(text)
        left = n - sum(len(WORD.findall(x)) for x in gone)
        out.append((doc, len(gone), left, not failed and left >= min_left * n))
    return out


def template_rows():
    """A host of template pages, one with menus, a null host, lines at and over the limit, copies, a document with exactly 30 % left."""
    import random

    rng = random.Random(1)
    shared = [" ".join(f"t{chr(97 + k)}{chr(97 + i)}" for i in range(12)) for k in range(6)]
    rows = [(k, "\n".join([*shared, prose(rng, 4)]), "template") for k in range(300)] + [(300 + k, prose(rng, 90), "template") for k in range(20)]
    menu = ["Home  About 1", "home about\t2", "login"]
    rows += [(1000 + k, rng.choice(menu) + "\n" + prose(rng, 60) + "\n" + rng.choice(menu) + "\n \n" + prose(rng, 9), "menus") for k in range(100)]
    rows += [(2000 + k, prose(rng, 55) + "\nat the limit" * (k < 20) + "\nover the limit" * (k < 21), None) for k in range(60)]
    rows += [(3000 + k, prose(rng, 55) + "\nshare of the host" * (k < 30) + "\none more" * (k < 31), "share") for k in range(300)]
    copy = prose(rng, 70) + "\n" + prose(rng, 30)
    rows += [(4000 + k, copy, "copies") for k in range(60)] + [(4100 + k, prose(rng, 60) + "\n" + copy, "copies") for k in range(5)]
    # thirty words of a hundred left, and twenty-nine
    seventy = "\n".join(" ".join(f"s{chr(97 + k)}{chr(97 + i)}" for i in range(10)) for k in range(7))
    rows += [(5000 + k, seventy + "\n" + prose(rng, 30 if k % 2 else 29), "tie") for k in range(40)]
    return rows + [(6000, None, None), (6001, "", "menus"), (6002, None, "menus"), rows[0], (None, rows[1][1], "template")]


def test_verdicts_match_brute_force(spark):
    rows = template_rows()
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    order = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.n_removed_lines, r.n_words_left, r.kept) for r in got), key=order) == sorted(brute_verdicts(rows), key=order)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[k] for k in range(300)) and all(kept[300 + k] for k in range(20))
    assert all(kept[5000 + k] == bool(k % 2) for k in range(40)) and all(kept[4000 + k] for k in range(60))


def test_verdicts_match_the_sql_where_lines_are_frequent(spark):
    import duckdb
    import pandas as pd

    from tidewatch.llm import oracle

    rows = [r for r in template_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    want = con.execute(oracle.QUALITY_RULES).df()
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()[want.columns]
    assert got.sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist()


def test_columns_of_any_name(spark):
    names = ["host", "content", "kept", "gone", "h", "docs", "lines", "Content_"]
    rows = [(*r, *range(8)) for r in template_rows()[:320]]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in names))
    assert sorted(r.doc_id for r in quality_rules.keep(d).collect()) == list(range(300, 320))
    cleaned = quality_rules.clean(d)
    assert cleaned.columns == d.columns and sorted(r.doc_id for r in cleaned.collect()) == list(range(300, 320))


def test_frequent_lines_leave_the_texts(spark, tmp_path):
    import random

    import corpus_pipeline

    rng = random.Random(7)
    rows = [(k, f"Home  About\t{k}\n\n" + prose(rng, 80) + "\n home about 7\n" + prose(rng, 20), "h", 0) for k in range(60)]
    rows += [(100, prose(rng, 70) + "\nHome About 1", "other", 0), (101, prose(rng, 70), None, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    judged = {r.doc_id: (r.n_removed_lines, r.n_words_left) for r in quality_rules.judge(d).collect()}
    got = {r.doc_id: r for r in corpus_pipeline.quality(spark, d, str(tmp_path)).collect()}
    assert sorted(got) == sorted(judged)
    for k, text, _, _ in rows:
        lines = text.split("\n")
        assert got[k].text == ("\n".join([lines[1], lines[2], lines[4]]) if k < 100 else text)
        assert got[k].n_chars == len(got[k].text)
        assert judged[k] == (2 if k < 100 else 0, len(WORD.findall(got[k].text)))


def shingle_sets(rows):
    out = {}
    for r in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        out[r[0]] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    return out


def brute_components(sets, percent=85):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_near_duplicates_match_brute_force(docs, rows, none):
    sets = shingle_sets([r for r in rows if r[0] is not None])
    want = brute_components(sets)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
            continue
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(none).count() == 0


def test_estimate_is_close(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    words = prose(rng, 900).split()
    pairs = []
    for cut in (0, 20, 60, 200):
        a, b = " ".join(words), " ".join(words[cut:] + [f"n{k}" for k in range(cut)])
        s, t = minhash.shingles(a), minhash.shingles(b)
        true = len(np.intersect1d(s, t)) / len(np.union1d(s, t))
        pairs.append((minhash.pack_bits(minhash.minima(s)).tolist(), minhash.pack_bits(minhash.minima(t)).tolist(), true))
    for r in spark.createDataFrame(pairs, "a array<long>, b array<long>, t double").select(minhash.estimate(F.col("a"), F.col("b")).alias("e"), "t").collect():
        assert abs(r.e - r.t) < 0.16


def test_a_chain_of_links_is_one_component(spark):
    import random

    words = prose(random.Random(9), 400).split()
    rows = []
    for k in range(40):
        words = words[8:] + [f"w{k}x{i}" for i in range(8)]
        rows.append((100 - k, " ".join(words)))
    want = brute_components(shingle_sets(rows))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_a_large_family_is_settled_exactly(spark, monkeypatch):
    """2,000 edited copies of one text, some of them edited on: similarities on both sides of the threshold, hot buckets, heavy differences."""
    import random

    monkeypatch.setattr(minhash, "HEAVY", 24)
    rng = random.Random(21)
    origin = [f"w{rng.randrange(4000)}" for _ in range(120)]

    def edited(words, k):
        words = list(words)
        for at in rng.sample(range(len(words)), k):
            words[at] = f"e{rng.randrange(10**6)}"
        return words

    made = [edited(origin, rng.randint(0, 5)) for _ in range(1500)]
    far = [edited(origin, 6) for _ in range(4)]
    made += [edited(far[k % 4], rng.randint(0, 4)) for k in range(500)]
    rows = [(3 * k + 1, " ".join(w)) for k, w in enumerate(made)]
    sets = [minhash.shingles(t) for _, t in rows]
    size = np.array([len(s) for s in sets])
    words, at = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros((len(sets), len(words)), np.float32)
    has[np.repeat(np.arange(len(sets)), size), at] = 1
    common = (has @ has.T).astype(int)
    linked = 100 * common >= 85 * (size[:, None] + size[None, :] - common)
    least = np.arange(len(sets))
    while True:
        new = np.where(linked, least[None, :], len(sets)).min(1)
        if (new == least).all():
            break
        least = new
    counted = []
    compare = minhash.compare
    monkeypatch.setattr(minhash, "compare", lambda pairs, *a, **b: counted.append(pairs.count()) or compare(pairs, *a, **b))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[k][0]: rows[c][0] for k, c in enumerate(least.tolist())}
    # of 1,000 pairs a row; groups of so few classes take several rounds
    assert 100 < len(set(got.values())) < 1500 and sum(counted) < 30 * len(rows)


def brute_repeats(rows, window=50):
    seen, out = {}, {}
    data = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: r[0])
    for doc, text in data:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - window + 1):
            if seen.setdefault(raw[k : k + window], doc) < doc:
                gone[k : k + window] = b"\1" * window
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[doc] = (len(raw), len(raw) - len(kept), sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_match_brute_force(docs, rows, none):
    want = brute_repeats(rows)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert tuple(r)[1:] == want[r.doc_id], r.doc_id
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_repetitive_texts(spark):
    rows = [(5, "a" * 300), (1, "a" * 49), (2, "a" * 50), (9, "ab" * 80), (7, "b" + "ab" * 30), (8, "x" * 20 + "a" * 60 + "y" * 60), (3, "y" * 49 + "z"), (4, "é" * 40), (6, "é" * 25)]
    want = brute_repeats(rows)
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect():
        assert tuple(r)[1:5] == want[r.doc_id], r.doc_id
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_small_pieces_and_buckets(spark, monkeypatch):
    """Indexes of a few strings, anchors split by their sides, many buckets, one passage in every document, rows with one id and different texts."""
    import random

    for name, value in (("PIECE", 300), ("SHARD", 2000), ("BUCKET", 4000), ("MOST_FILES", 3)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(4)
    base = [prose(rng, 30) for _ in range(12)]
    rows = [(rng.randrange(400), " ".join([prose(rng, rng.randint(0, 9)), base[0], rng.choice(base)[rng.randint(0, 60) :], prose(rng, rng.randint(0, 4))])) for _ in range(150)]
    rows = list({r[0]: r for r in rows}.values())
    want = brute_repeats(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r[0]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(d).collect()} == want
    twice = [(7, base[1] + " x " + base[2]), (7, base[3]), (3, base[2]), (9, base[3] + base[1])]
    got = sorted(tuple(r)[1:3] for r in suffix_dedup.remove_repeats(spark.createDataFrame(twice, "doc_id long, text string")).collect())
    assert got == sorted([(len(twice[0][1]), len(base[2])), (len(base[3]), 0), (len(base[2]), 0), (len(twice[3][1]), len(twice[3][1]))])


def brute_owners(strings, owner):
    best = {}
    for x, o in zip(strings, owner, strict=True):
        for k in range(len(x) - 49):
            best[x[k : k + 50]] = min(o, best.get(x[k : k + 50], o))
    return [best[x[k : k + 50]] for x in strings for k in range(len(x) - 49)]


def shard_of_contexts(texts):
    """Distinct contexts of texts (owner, bytes) as a shard has them: string, smallest owner, anchor, its place."""
    held = {}
    for o, raw in texts:
        for a, f, n, lead in zip(*suffix_dedup.contexts(np.frombuffer(raw, np.uint8)), strict=True):
            x = raw[f : f + n + 49]
            held[x] = (min(o, held[x][0]) if x in held else o, a >> np.uint64(16), lead)
    strings = list(held)
    owner, anchor, lead = (np.array([held[x][k] for x in strings]) for k in range(3))
    offset = np.concatenate([[0], np.cumsum([len(x) - 49 for x in strings])])
    return strings, owner.astype(np.int64), anchor.astype(np.uint64), lead.astype(np.int64), offset


@pytest.mark.parametrize("seed,piece", [(1, 1 << 20), (2, 400), (3, 150), (4, 2000)])
def test_least_owners(seed, piece, monkeypatch):
    """Later contexts streamed through indexes of earlier ones, with ties of owners, split anchors and portions."""
    import random

    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = random.Random(seed)
    base = bytes(rng.choice(b"abcdef ") for _ in range(160))
    texts = []
    for _ in range(80):
        x = bytearray(base[rng.randint(0, 60) : rng.randint(115, 160)])
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = rng.choice(b"xyz")
        texts.append((rng.randint(0, 40), bytes(x)))
    strings, owner, anchor, lead, offset = shard_of_contexts(texts)
    flat = suffix_dedup.least_owners(suffix_dedup.units(anchor, lead, strings, owner), strings, owner, offset)
    assert flat.tolist() == brute_owners(strings, owner)


def test_only_contexts_that_can_share_a_window_meet():
    """Half a window and the anchor are no longer enough: every window has more beside its anchor."""
    rng = np.random.default_rng(9)
    noise = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    for shared, together in ((17, 0), (20, 0), (34, 40)):
        same = noise(16 + shared)
        strings = [noise(20) + same + noise(40 - shared) for _ in range(40)]
        groups = suffix_dedup.units(np.full(40, 7, np.uint64), np.full(40, 20), strings, np.arange(40))
        assert sum(map(len, groups)) == together


def test_statistics_decide(monkeypatch):
    """Streamed contexts aren't in the index: most windows fall short of a full match, and without the statistics the answer is another."""
    rng = np.random.default_rng(6)
    middle = bytes(rng.integers(97, 123, 45, dtype=np.uint8))
    texts = [(k, bytes(rng.integers(97, 123, 40, dtype=np.uint8)) + middle + bytes(rng.integers(97, 123, 40, dtype=np.uint8))) for k in range(60)]
    strings, owner, anchor, lead, offset = shard_of_contexts(texts + [(100, texts[7][1][5:]), (101, texts[9][1])])
    want = brute_owners(strings, owner)
    lengths = []
    statistics = RunIndex.statistics

    def told(self, patterns):
        out = statistics(self, patterns)
        lengths.extend(out[0].tolist())
        return out

    groups = suffix_dedup.units(anchor, lead, strings, owner)
    monkeypatch.setattr(RunIndex, "statistics", told)
    assert suffix_dedup.least_owners(groups, strings, owner, offset).tolist() == want
    assert min(lengths) < 16 and sum(n == 50 for n in lengths) < len(lengths) / 2

    def blind(self, patterns):
        length, *rest = statistics(self, patterns)
        return np.full_like(length, 50), *rest

    monkeypatch.setattr(RunIndex, "statistics", blind)
    assert suffix_dedup.least_owners(groups, strings, owner, offset).tolist() != want


def test_hot_anchor(monkeypatch):
    """One string of 16 bytes in 20,000 different contexts of as many documents: it is split, and no index outgrows its bound by much."""
    rng = np.random.default_rng(8)
    low = min((bytes(rng.integers(97, 123, 16, dtype=np.uint8)) for _ in range(50_000)), key=lambda x: int(suffix_dedup.hashes(np.frombuffer(x, np.uint8), 16)[0]))
    texts = [(k, bytes(rng.integers(97, 123, 34, dtype=np.uint8)) + low + bytes(rng.integers(97, 123, 34, dtype=np.uint8))) for k in range(19_000)]
    texts += [(30_000 + k, texts[k][1][: 60 + k % 20] + b"-" * 30) for k in range(1000)]
    strings, owner, anchor, lead, offset = shard_of_contexts(texts)
    sizes = []
    made = suffix_dedup.RunIndex
    monkeypatch.setattr(suffix_dedup, "RunIndex", lambda own, *a: sizes.append(sum(map(len, own))) or made(own, *a))
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 16)
    assert max(np.unique(anchor, return_counts=True)[1]) > 15_000
    flat = suffix_dedup.least_owners(suffix_dedup.units(anchor, lead, strings, owner), strings, owner, offset)
    assert flat.tolist() == brute_owners(strings, owner)
    assert max(sizes) < 2 << 16


@pytest.mark.parametrize("seed", range(20))
def test_run_index(seed):
    import random

    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab\x00\xff") for _ in range(30))
    strings = list(dict.fromkeys(base[(a := rng.randint(0, 25)) : a + rng.randint(0, 30)] + bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 6))) for _ in range(12)))
    window = rng.choice([1, 3, 5, 8, 12])
    owners = np.array([rng.randint(0, 9) for _ in strings])
    index = RunIndex(strings, owners, window)
    asked = [*strings, b"", base[::-1], *(bytes(rng.choice(b"ab\0\xffz") for _ in range(rng.randint(1, 40))) for _ in range(8)), base[3:20] + b"z" + base[5:30]]
    length, _, places, begin = index.statistics(asked)
    joined = b"\0".join(strings) + b"\0"
    for s, a in zip(asked, begin.tolist(), strict=False):
        for i in range(len(s)):
            longest = max(n for n in range(window + 1) if i + n <= len(s) and any(s[i : i + n] in x for x in strings))
            assert length[a + i] == longest
            # the samples locate a match, inside one string
            place = int(places[a + i])
            assert not longest or (joined[place : place + longest] == s[i : i + longest] and place + longest <= index.starts[np.searchsorted(index.starts, place, side="right") - 1] + len(strings[np.searchsorted(index.starts, place, side="right") - 1]))
    flat, start = index.earliest(asked, 99)
    for s, a, b in zip(asked, start[:-1].tolist(), start[1:].tolist(), strict=True):
        assert flat[a:b].tolist() == [min((o for o, x in zip(owners, strings, strict=True) if s[i : i + window] in x), default=99) for i in range(len(s) - window + 1)]
    for _ in range(5):
        p = bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 4)))
        assert index.count(p) == sum(sum(x[i : i + len(p)] == p for i in range(len(x) - len(p) + 1)) for x in strings)
    assert index.runs() <= index.n and len(index.sample_first) == len(index.sample_last) == index.runs()
    assert RunIndex([], np.zeros(0), window).earliest(asked, 7)[0].tolist() == [7] * len(flat)


assert SCHEMA
