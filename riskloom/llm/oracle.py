"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .secret_scan import ACCESS, ALLOWED, ASSIGN, CLASSES, HEX, KINDS, MIN_ASSIGNED, PLACEHOLDERS, WINDOW, any_case, clog2, sum_limit

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secret_scan() -> str:
    """Windows are enumerated and counted from scratch here, one row per window and symbol."""
    def matches(kind: str, pattern: str, t: str = "t") -> str:
        return f"""
SELECT doc_id, {KINDS.index(kind)} AS k, unnest(range(len(m))) AS i, unnest(m) AS s,
       unnest(list_transform(range(len(m)), lambda i: list_sum(list_transform(g[1:i + 1], lambda x: length(x)))
              + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0)))::BIGINT AS a
FROM (SELECT doc_id, regexp_extract_all({t}, {_q(pattern)}, 0) AS m, string_split_regex({t}, {_q(pattern)}) AS g
      FROM docs WHERE regexp_matches({t}, {_q(pattern)}))"""

    base = "\nUNION ALL\n".join(matches(k, p) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)))
    cand = "\nUNION ALL\n".join(matches(k, c[1], "clean") for k, c in CLASSES.items())
    limit = "CASE k " + " ".join(f"WHEN {KINDS.index(k)} THEN {sum_limit(c[2])}" for k, c in CLASSES.items()) + " END"
    clean = "coalesce(text, '')"
    for word in PLACEHOLDERS:
        clean = f"regexp_replace({clean}, {_q(any_case(word))}, {_q(' ' * len(word))}, 'g')"
    names = "[" + ", ".join(_q(k) for k in KINDS) + "]"
    shown = f"({names})[k + 1] || ':' || a || ':' || e"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, {clean} AS clean FROM documents),
found AS ({base}),
base AS (SELECT doc_id, k, a, a + length(s) AS e FROM found
         WHERE k <> 0 OR length(regexp_extract(s, {_q("^" + ASSIGN + "$")}, 2)) >= {MIN_ASSIGNED}),
cand AS (SELECT row_number() OVER () AS c, * FROM ({cand}) WHERE NOT regexp_matches(s, {_q(ALLOWED)})),
win AS (SELECT c, k, s, a, doc_id, unnest(range(length(s) - {WINDOW} + 1)) AS w FROM cand),
sym AS (SELECT c, w, unnest(string_split(s[w + 1:w + {WINDOW}], '')) AS x FROM win),
cnt AS (SELECT c, w, x, count(*) AS n FROM sym GROUP BY ALL),
ent AS (SELECT c, w, sum(({clog2()})[n + 1]) AS total FROM cnt GROUP BY ALL),
hits AS (SELECT doc_id, k, any_value(a) + min(w) AS a, any_value(a) + max(w) + {WINDOW} AS e
         FROM win JOIN ent USING (c, w) WHERE total <= {limit} GROUP BY c, doc_id, k),
extra AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.a <= h.a AND h.e <= b.e)),
spans AS (SELECT *, true AS b FROM base UNION ALL SELECT doc_id, k, a, e, false FROM extra),
listed AS (SELECT doc_id, count(*) FILTER (b AND k = 0) AS n_assign, count(*) FILTER (b AND k = 1) AS n_access,
                  count(*) FILTER (b AND k = 2) AS n_hex,
                  coalesce(string_agg({shown}, ',' ORDER BY a, k, e) FILTER (b), '') AS base,
                  string_agg({shown}, ',' ORDER BY a, k, e) AS spans
           FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN listed l ON l.doc_id = d.doc_id"""


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""

JACCARD_JOIN = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)"""




def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Distances are expanded from inner products of the untransformed parts."""
    def dot(a: str, b: str) -> str:
        return f"coalesce(list_inner_product({a}, {b}), 0)"

    def nearest(book: str) -> str:
        return f"""(SELECT r, q, m % {entries} AS e, m // {entries} AS d FROM (
  SELECT x.r, x.q, min((x.aa - 2 * {dot("x.a", "c.b")} + c.bb)::HUGEINT * {entries} + c.e) AS m
  FROM x JOIN {book} c ON c.q = x.q GROUP BY x.r, x.q))"""

    steps = []
    for i in range(rounds):
        steps.append(f"""
n{i} AS MATERIALIZED {nearest(f"c{i}")},
s{i} AS (SELECT q, e, i, sum(v) AS s, count(*) AS n
       FROM (SELECT x.q, n.e, unnest(x.a)::HUGEINT AS v, generate_subscripts(x.a, 1) AS i FROM x JOIN n{i} n ON n.r = x.r AND n.q = x.q)
       GROUP BY q, e, i),
m{i} AS (SELECT q, e, list(((s - ((s % n + n) % n)) // n)::DOUBLE ORDER BY i) AS b FROM s{i} GROUP BY q, e),
c{i + 1} AS MATERIALIZED (SELECT q, e, b, {dot("b", "b")} AS bb
       FROM (SELECT c.q, c.e, coalesce(m.b, c.b) AS b FROM c{i} c LEFT JOIN m{i} m ON m.q = c.q AND m.e = c.e)),""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT r, q, w[q * (len(w) // {parts}) + 1:(q + 1) * (len(w) // {parts})] AS a FROM v, unnest(range({parts})) u(q)),
x AS MATERIALIZED (SELECT r, q, a, {dot("a", "a")} AS aa FROM cut),
c0 AS MATERIALIZED (SELECT q, r AS e, a AS b, aa AS bb FROM x WHERE r < {entries}),{"".join(steps)}
final AS MATERIALIZED {nearest(f"c{rounds}")},
codes AS (SELECT r, string_agg(printf('%02x', e::INTEGER), '' ORDER BY q) AS code, sum(d)::BIGINT AS error FROM final GROUP BY r),
book AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY q, e, i)) AS h
       FROM (SELECT q, e, unnest(b) AS v, generate_subscripts(b, 1) AS i FROM c{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM v JOIN codes USING (r), book"""


SOURCE_DIVERGENCE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT d, lang, source, t, count(*) AS n FROM (SELECT d, lang, source, unnest(w) AS t FROM docs) GROUP BY ALL),
kept AS (SELECT lang, t, sum(n) AS n FROM words GROUP BY lang, t HAVING count(*) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
used AS (SELECT w.lang, w.source, w.t, sum(w.n) AS n FROM words w JOIN kept USING (lang, t) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.t, coalesce(u.n, 0) AS n, k.n AS whole, count(*) OVER grp AS v, sum(coalesce(u.n, 0)) OVER grp AS total, sum(k.n) OVER grp AS lang_n
          FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.t = k.t
          WINDOW grp AS (PARTITION BY g.lang, g.source)),
p AS MATERIALIZED (SELECT lang, source, t, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p,
                 1 + (1000000000::HUGEINT * (whole + 5)) // (lang_n + 5 * v) AS q FROM dense),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
         FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value
                    FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY ALL) s
           ON s.lang = a.lang AND s.a = a.source AND s.b = b.source),
term AS (SELECT lang, source, 'term' AS part, t AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
           FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""


def oracle() -> dict[str, str]:
    return {"op1_secret_scan": secret_scan(), "op2_exact_top_k": TOP_K, "op7_ngram_jaccard_join": JACCARD_JOIN,
            "op11_vector_codes": vector_codes(), "op13_source_divergence": SOURCE_DIVERGENCE}
