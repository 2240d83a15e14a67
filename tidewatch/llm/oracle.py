"""DuckDB SQL for the training-data queries that SQL can express, written from their contracts."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, {_WORDS}) AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS lines FROM d),
tri AS (SELECT doc_id, i, words[i] || chr(1) || words[i + 1] || chr(1) || words[i + 2] AS g FROM w, unnest(range(1, len(words) - 1)) r(i)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
base AS (SELECT w.doc_id, source, t, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
line AS (SELECT doc_id, source, t, len(regexp_extract_all(x, {_WORDS})) AS k,
  translate(regexp_replace(lower(trim(regexp_replace(x, '[\x09-\x0D]', ' ', 'g'))), ' {{2,}}', ' ', 'g'), '123456789', '000000000') AS h FROM (SELECT doc_id, source, t, unnest(lines) AS x FROM w)),
host AS (SELECT source, greatest(20, count(DISTINCT t) * 0.1) AS most FROM d GROUP BY source),
gone AS (SELECT line.source, h FROM line JOIN host ON line.source IS NOT DISTINCT FROM host.source GROUP BY line.source, h, most HAVING count(DISTINCT t) > most),
lost AS (SELECT doc_id, count(*) AS n, sum(k) AS k FROM line JOIN gone ON line.h = gone.h AND line.source IS NOT DISTINCT FROM gone.source GROUP BY doc_id),
done AS (SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(lost.n, 0) AS n_removed_lines, n_words - coalesce(lost.k, 0) AS n_words_left FROM base LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, CAST(n_removed_lines AS BIGINT) AS n_removed_lines, CAST(n_words_left AS BIGINT) AS n_words_left, NOT base_failed AND n_words_left >= n_words * 0.3 AS kept FROM done"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
win AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS g FROM d, unnest(range(0, n - 49)) r(i)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM win) WHERE low < doc_id),
run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit)),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, k),
piece AS (SELECT doc_id, a, substr(x, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS part FROM span JOIN d USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
cut AS (SELECT doc_id, string_agg(part, '' ORDER BY a) AS kept FROM piece GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last FROM span GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN total USING (doc_id) LEFT JOIN cut USING (doc_id)"""

#: Bits 0, 20 and 40; times three bits, the factor has each of them at the foot of its counter.
_SPREAD_BITS = "(((d[1 + w // 20] >> (3 * (w % 20))) & 7) * 274878431233) & 1099512676353"
_FULL = "1152921504606846975"
_DIGITS = "array_to_string([lpad(lower(hex(x)), 15, '0') FOR x IN {}], '')"
_LIKE = "CASE WHEN {a} = {b} THEN 1.0 WHEN list_sum([x * x FOR x IN {s}]) * list_sum([x * x FOR x IN {t}]) > 0 THEN least(1.0, greatest(0.0, list_inner_product({s}, {t}) / sqrt(list_sum([x * x FOR x IN {s}]) * list_sum([x * x FOR x IN {t}])))) ELSE 0.0 END"

MULTISET = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC) AS k, count(*) OVER () AS rows_ FROM documents),
e AS (SELECT a.doc_id, a.k, a.t, a.t[1:length(a.t) - length(a.t) // 3] || b.t[1:length(a.t) // 3] AS x, b.k AS next_k FROM d a JOIN d b ON b.k = a.k % a.rows_ + 1),
both_ AS (SELECT k, 0 AS kind, t FROM e UNION ALL SELECT k, 1, x FROM e),
u AS (SELECT k, kind, unnest(regexp_extract_all(t, '[^.!?\n]+[.!?]*|[.!?]+') || [chr(10) || p FOR p IN string_split(t, chr(10))]) AS unit FROM both_),
h AS (SELECT k, kind, [CAST('0x' || substr(sha256(unit), 15 * i + 1, 15) AS BIGINT) FOR i IN range(3)] AS d FROM u),
s AS (SELECT k, kind, w, count(*) AS n, CAST(sum({_SPREAD_BITS}) % 1152921504606846976 AS BIGINT) AS c FROM h, range(60) r(w) GROUP BY k, kind, w),
v AS (SELECT k, kind, [any_value(n)] || list(c ORDER BY w) AS v, list_transform(flatten(list([c & 1048575, (c >> 20) & 1048575, (c >> 40) & 1048575] ORDER BY w)), lambda x: CAST(2 * x - any_value_n AS DOUBLE)) AS g
  FROM (SELECT *, n AS any_value_n FROM s) GROUP BY k, kind, any_value_n)
SELECT e.doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(x) AS edited_sha256, {_DIGITS.format("p.v")} AS fingerprint, {_DIGITS.format("q.v")} AS edited_fingerprint,
  {_LIKE.format(a="p.v", b="q.v", s="p.g", t="q.g")} AS near_edited, {_LIKE.format(a="p.v", b="r.v", s="p.g", t="r.g")} AS near_next
FROM e JOIN v p ON p.k = e.k AND p.kind = 0 JOIN v q ON q.k = e.k AND q.kind = 1 JOIN v r ON r.k = e.next_k AND r.kind = 0"""


def _codes() -> str:
    """Lloyd rounds in full: all entries are compared in each."""
    gap = "list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v)"
    steps = [
        """kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        "x AS MATERIALIZED (SELECT r, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS v FROM kept, range(4) t(p))",
        "b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= 256)",
    ]
    for k in range(5):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, x.p, min((d, e)) AS best FROM (SELECT x.r, x.p, b.e, {gap} AS d FROM x JOIN b{k} b ON b.p = x.p) x GROUP BY r, x.p)")
        if k < 4:
            steps.append(
                f"""b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS v FROM (
  SELECT x.p, a.best[2] AS e, i, floor(sum(x.v[i]) / count(*)) AS m FROM x JOIN a{k} a ON a.r = x.r AND a.p = x.p, unnest(range(1, len(x.v) + 1)) t(i) GROUP BY x.p, a.best[2], i) GROUP BY p, e) n USING (p, e))"""
            )
    return f"""WITH {", ".join(steps)},
code AS (SELECT r, string_agg(lpad(lower(hex(best[2])), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a4 GROUP BY r),
label AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM kept JOIN code USING (r) GROUP BY label),
book AS (SELECT sha256(string_agg(array_to_string([CAST(i AS BIGINT) FOR i IN v], ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM kept JOIN code USING (r) JOIN label ON label.label IS NOT DISTINCT FROM kept.label, book"""


CODES = _codes()

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
size_ AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size_),
m AS (SELECT doc_id, 100 - 25 + (25 * CAST(n AS BIGINT) * docs) // terms AS m FROM size_, total),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""
