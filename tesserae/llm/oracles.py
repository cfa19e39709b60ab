"""DuckDB SQL for the queries that SQL can express."""

from .licenses import LOWER, TEMPLATES, UPPER, positions, voting


def _op3() -> str:
    """Diagonal voting over the same templates, which become VALUES."""
    t = ", ".join(f"({i}, '{x.label}', {str(x.base).lower()}, {x.text.count(' ')}, {n})" for i, (x, n) in enumerate(zip(TEMPLATES, voting(TEMPLATES))))
    pos = ", ".join(f"({i}, {q}, '{a}', '{b}')" for i, q, a, b in positions(TEMPLATES))
    return rf"""
WITH t(t, label, base, length, voting) AS (VALUES {t}), pos(t, q, a, b) AS (VALUES {pos}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(len(w) - 1)) AS p FROM w WHERE len(w) > 1),
hits AS (SELECT doc_id, pos.t, p, q, p - q AS diagonal FROM g JOIN pos ON pos.a = w[p + 1] AND pos.b = w[p + 2]),
votes AS (SELECT doc_id, t, diagonal, min(p) AS lo, max(p) + 1 AS hi, list(DISTINCT q) AS q FROM hits GROUP BY ALL),
named AS (SELECT v.*, label, base, length, voting FROM votes v JOIN t USING (t)),
marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER b > 3 OR lo - lag(hi) OVER b > length THEN 1 ELSE 0 END AS new
  FROM named WHERE NOT base WINDOW b AS (PARTITION BY doc_id, t ORDER BY diagonal)
),
cut AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS span FROM marked),
spans AS (
  SELECT doc_id, label, false AS base, min(lo) AS lo, len(list_distinct(flatten(list(q)))) / any_value(voting)::DOUBLE AS coverage FROM cut GROUP BY doc_id, t, label, span
  UNION ALL SELECT doc_id, label, true, lo, 1.0 FROM named WHERE base AND len(q) = length
),
per AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(lo) FILTER (base) AS first_word, max(lo) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM spans WHERE coverage >= 0.75 GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN per USING (doc_id)
"""


OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] END)) AS s FROM w
), c AS (
  SELECT min(doc_id) AS class_id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s
), i AS (
  SELECT class_id, n, unnest(s) AS g FROM c
), p AS (
  SELECT x.class_id AS a, y.class_id AS b FROM i x JOIN i y ON x.g = y.g AND x.class_id < y.class_id GROUP BY x.class_id, y.class_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
  SELECT class_id AS a, class_id AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), m AS (
  SELECT a AS class_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, coalesce(m.component_id, s.doc_id) = s.doc_id AS kept, coalesce(c.class_id, s.doc_id) AS class_id
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN m ON m.class_id = c.class_id
"""

OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length('### ' || replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</', '<\/'), ' ', '\ ') || ': '
      || replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') || ' </turn>' || chr(10)) AS chars
  FROM t
), c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS so_far, role = 'assistant' OR i = n AS example FROM e
)
SELECT conv_id, any_value(n)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(so_far) FILTER (example))::BIGINT AS formatted_chars,
  (count(*) FILTER (example))::BIGINT AS n_examples
FROM c GROUP BY conv_id
"""

OP9 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), w AS (
  SELECT doc_id, h, unnest(range(n - 399)) AS i FROM d WHERE n >= 400
), k AS (
  SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS k FROM w
), t AS (
  SELECT doc_id, i FROM k SEMI JOIN (SELECT k FROM k GROUP BY k HAVING count(*) > 1) USING (k)
), m AS (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS new FROM t
), r AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m
), s AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM r GROUP BY doc_id, run
), g AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y, a, b FROM s
), p AS (
  SELECT doc_id, x, y FROM g UNION ALL SELECT doc_id, max(b), NULL FROM s GROUP BY doc_id UNION ALL SELECT doc_id, 0, NULL FROM d ANTI JOIN s USING (doc_id)
), q AS (
  SELECT p.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, n) - x)), '' ORDER BY x) AS kept FROM p JOIN d USING (doc_id) GROUP BY p.doc_id
), c AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN q USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1') AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), t AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE weight * (SELECT arg_min(level, ratio) FROM l WHERE ratio > level) END AS target FROM l
), o AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN 2 * before + size <= 2 * (target - whole * source_size) AND target - whole * source_size > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""

ORACLES = {"op3_license_scan": _op3(), "op4_near_dups": OP4, "op7_chat_format": OP7, "op9_repeats": OP9, "op10_mix_sources": OP10}
