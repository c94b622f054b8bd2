"""DuckDB SQL for the queries that SQL can express on whole tables."""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, w[i:i + 12] AS terms
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, i AS place, w[i:i + n - 1] AS terms
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM windows))
), hits AS (
  SELECT DISTINCT doc_id, item_id, place, n FROM places JOIN windows USING (n, terms)
), counted AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + n)) AS p FROM hits) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY 1
)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)
"""


NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), edges AS (
  SELECT x, y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
    FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN sizes m ON m.doc_id = x JOIN sizes o ON o.doc_id = y
  WHERE 100 * k >= 90 * (m.n + o.n - k)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION
  SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach.y) AS component_id,
  (SELECT count(*) FROM edges WHERE edges.x = d.doc_id) AS n_links
FROM d JOIN reach ON reach.x = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id
"""

LINE_DEDUP = rf"""
WITH cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM cut)
), compared AS (
  SELECT doc_id, i, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM numbered
), firsts AS (
  SELECT w, min((doc_id, i)) AS place FROM compared WHERE len(w) >= 5 GROUP BY w
), long AS (
  SELECT w, place FROM firsts WHERE len(w) >= 12
), variants AS (
  SELECT w, place, k, list_concat(w[1:k - 1], w[k + 1:]) AS v
  FROM (SELECT w, place, unnest(range(1, len(w) + 1)) AS k FROM long)
), near AS (
  SELECT x.w FROM variants x JOIN variants y ON x.v = y.v AND x.k = y.k WHERE y.place < x.place
  UNION SELECT x.w FROM variants x JOIN long y ON x.v = y.w WHERE y.place < x.place
  UNION SELECT x.w FROM long x JOIN variants y ON x.w = y.v WHERE y.place < x.place
), gone AS (
  SELECT c.doc_id, c.i FROM compared c JOIN firsts f ON f.w = c.w
  WHERE (c.doc_id, c.i) <> f.place OR c.w IN (SELECT w FROM near)
), kept AS (
  SELECT n.doc_id, string_agg(line, chr(10) ORDER BY n.i) AS left_over
  FROM numbered n ANTI JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY n.doc_id
)
SELECT cut.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
  (SELECT count(*) FROM gone WHERE gone.doc_id = cut.doc_id) AS n_dropped,
  sha256(coalesce(left_over, '')) AS text_sha256
FROM cut LEFT JOIN kept ON kept.doc_id = cut.doc_id
"""

SOURCE_DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM d GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM d SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), priced AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v)::HUGEINT AS q
  FROM totals JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, term)
), found AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN (
    SELECT a.lang, a.source AS s, b.source AS t, sum(abs(a.p - b.p)) AS value
    FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL
  ) z ON z.lang = x.lang AND z.s = x.source AND z.t = y.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM priced WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def vector_codes_sql(rounds: int = 4) -> str:
    """The rounds written out one after the other; ``p`` has a row per component."""
    steps = [
        """
WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (n // 4) AS part, (i - 1) % (n // 4) AS place, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, embedding, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256
), c0 AS MATERIALIZED (
  SELECT part, entry, place, x AS y FROM p JOIN first USING (vec_id)
)"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (
  SELECT vec_id, part, min((d, entry)) AS best FROM (
    SELECT vec_id, part, entry, sum((x - y) * (x - y)) AS d FROM p JOIN c{k} USING (part, place) GROUP BY ALL
  ) GROUP BY vec_id, part
)"""
        )
        if k < rounds:
            steps.append(
                f"""c{k + 1} AS MATERIALIZED (
  SELECT part, entry, place, CAST(coalesce((s - ((s % n) + n) % n) // n, y) AS BIGINT) AS y FROM c{k} LEFT JOIN (
    SELECT p.part, best[2] AS entry, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
    FROM p JOIN a{k} ON a{k}.vec_id = p.vec_id AND a{k}.part = p.part GROUP BY ALL
  ) USING (part, entry, place)
)"""
            )
    return (
        ", ".join(steps)
        + f""", coded AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(best[2] AS INT)), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, place)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
    )


NEAR_VECTORS = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), usable AS MATERIALIZED (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), edges AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v
  UNION
  SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y
)
SELECT x AS vec_id, (SELECT count(*) FROM edges WHERE edges.x = reach.x) AS n_links, min(y) AS component_id, x = min(y) AS kept
FROM reach GROUP BY x
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": DECONTAMINATE,
        "op2_ngram_join": NGRAM_JOIN,
        "op6_line_dedup": LINE_DEDUP,
        "op11_source_divergence": SOURCE_DIVERGENCE,
        "op12_vector_codes": vector_codes_sql(),
        "op13_near_vectors": NEAR_VECTORS,
    }
