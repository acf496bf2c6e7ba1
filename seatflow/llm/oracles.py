"""DuckDB text of the operators that SQL can express."""

from __future__ import annotations

from seatflow.llm.chat import LLAMA

EXACT = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST) AS place,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, length(coalesce(text, '')) AS chars,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS solid,
         length(regexp_replace(coalesce(text, ''), '[^\p{L}]+', '', 'g')) AS letters
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE)
             / 4503599627370496.0::DOUBLE)
         / greatest(0.05::DOUBLE, letters::DOUBLE / greatest(1, solid)) AS key
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM k GROUP BY source),
o AS (
  SELECT *, 3 * source_size / w AS ratio,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY 3 * source_size / w, source NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least(3.0::DOUBLE * source_size,
               coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), 3 * source_size / w) * w)::DOUBLE
         AS target
  FROM o),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
u AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, target - epochs * source_size AS budget,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id) AS upto,
         sum(size) OVER (PARTITION BY k.source, key, doc_id) AS unit
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN upto - unit / 2 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u
"""


def _length(col: str) -> str:
    """Code points of an escaped text: one more per backslash and control string."""
    parts = [f"length({col})", f"(length({col}) - length(replace({col}, '\\', '')))"]
    parts += [f"(length({col}) - length(replace({col}, '{c}', ''))) // {len(c)}" for c in LLAMA.controls]
    return " + ".join(parts)


def _marks(role: str) -> str:
    size = {r: len(LLAMA.before[r]) + len(LLAMA.after[r]) for r in LLAMA.before}
    return "CASE " + " ".join(f"WHEN {role} = '{r}' THEN {n}" for r, n in size.items() if r) + f" ELSE {size['']} END"


def _follows(prev: str, role: str) -> str:
    return "CASE " + " ".join(f"WHEN {prev} = '{p}' THEN {role} IN ({', '.join(repr(x) for x in nxt)})"
                              for p, nxt in LLAMA.follows.items()) + " ELSE false END"


CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), '') AS prev,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({_marks('role')} + {_length('text')})::BIGINT AS formatted_chars,
       bool_and(CASE WHEN place > 1 AND prev = '' THEN false ELSE {_follows('prev', 'role')} END)
         AND arg_max(role, place) IN ({', '.join(repr(x) for x in LLAMA.final)}) AS valid
FROM p GROUP BY conv_id
"""


AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
m AS (
  SELECT doc_id, part,
         (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
          + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
          + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
          + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
          + CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 16 ELSE 0 END) AS bits
  FROM d),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
c AS (
  SELECT part, bits, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, bits),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, bit)),
o AS (
  SELECT f1.name || f2.name || f3.name || f4.name || f5.name AS filter_order,
         [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS b
  FROM f f1 JOIN f f2 ON f2.bit <> f1.bit JOIN f f3 ON f3.bit NOT IN (f1.bit, f2.bit)
  JOIN f f4 ON f4.bit NOT IN (f1.bit, f2.bit, f3.bit) JOIN f f5 ON f5.bit NOT IN (f1.bit, f2.bit, f3.bit, f4.bit)),
s AS (
  SELECT filter_order, step::INTEGER AS step, b[step] AS bit, coalesce(list_sum(b[1:step - 1]), 0)::INTEGER AS before
  FROM o, unnest([1, 2, 3, 4, 5]) AS u(step)),
r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN (bits & (before | bit)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN (bits & bit) <> 0 AND (bits & before) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN (bits & bit) <> 0 AND (bits & before) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN bits = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN (bits & bit) <> 0 AND (bits & before) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN (bits & bit) <> 0 AND (bits & before) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
l AS (SELECT lang, term, count(*) AS lang_c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_c)::HUGEINT AS lang_size FROM l GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN l USING (lang, term) GROUP BY lang, source, term),
z AS (SELECT lang, source, sum(c)::HUGEINT AS size FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, l.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(z.size, 0) + v.v) AS p,
         1 + (1000000000::HUGEINT * (l.lang_c + 1)) // (v.lang_size + v.v) AS q
  FROM g JOIN l USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term
  LEFT JOIN z ON z.lang = g.lang AND z.source = g.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
  FROM p WHERE c > 0 AND p > q),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
