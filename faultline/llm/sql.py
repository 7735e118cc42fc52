"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from faultline.llm.quality_rules import BASE, RULES, STOP_WORDS


def _broken(rules) -> str:
    tests = []
    for r in rules:
        if r.low is not None:
            tests.append(f"{r.top} * 100 < {r.low} * {r.bottom} AND n_words >= {r.least}")
        if r.high is not None:
            tests.append(f"{r.top} * 100 > {r.high} * {r.bottom} AND n_words >= {r.least}")
    return "(" + " OR ".join(tests) + ")"


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i:i+4]) AS c FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM k WHERE c > 1) GROUP BY rid),
q AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(length(list_aggregate(w, 'string_agg', '')), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(regexp_extract_all(t, '!'))::BIGINT AS n_exclamations,
             len(list_intersect(list_distinct(w), [{_STOP}]))::BIGINT AS n_stop_words, len(lines)::BIGINT AS n_lines, 1 AS one
      FROM w LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_broken(BASE)} AS base_failed,
       NOT ({_broken(BASE)} OR {_broken(RULES)}) AS kept FROM q
"""



def _codes(dim: int = 64, parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Plain rounds over all parts and entries; ties go to the smaller entry."""
    width = dim // parts
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label,
         list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
cut AS MATERIALIZED (SELECT rid, p, x[p * {width} + 1: (p + 1) * {width}] AS v FROM kept, range({parts}) AS r(p)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v FROM cut WHERE rid <= {entries})"""]
    for k in range(rounds + 1):
        square = " + ".join(f"(c.v[{i}] - b.v[{i}]) * (c.v[{i}] - b.v[{i}])" for i in range(1, width + 1))
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT rid, p, min(d) AS d, arg_min(e, (d, e)) AS e
  FROM (SELECT c.rid, c.p, b.e, {square} AS d FROM cut c JOIN book{k} b ON c.p = b.p) GROUP BY rid, p)""")
        if k < rounds:
            floors = ", ".join(f"floor(sum(c.v[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, width + 1))
            steps.append(f"""
mean{k} AS MATERIALIZED (SELECT n.p, n.e, [{floors}] AS v FROM near{k} n JOIN cut c USING (rid, p) GROUP BY n.p, n.e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)""")
    return ",".join(steps) + f"""
, coded AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', n.e), '' ORDER BY n.p) AS code, sum(n.d)::BIGINT AS error
            FROM kept k JOIN near{rounds} n USING (rid) GROUP BY k.rid, k.vec_id, k.label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM coded
"""


ORACLE = {"op7_quality_rules": _RULES, "op12_adaptive_codes": _codes()}
