"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from vigil.llm import secrets


def _spans(kind: str, rank: int, pattern: str, value: str, keep: str) -> str:
    """Matches of one pattern with their offsets: the text between the matches
    and the matches themselves, summed up."""
    p = pattern.replace("'", "''")
    return f"""{kind} AS (
  SELECT rid, {rank} AS rank, '{kind}' AS kind, start, start + length(hit) AS stop, {value} AS value FROM (
    SELECT rid, hits[i] AS hit, list_sum(list_transform(gaps[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT rid, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
          FROM (SELECT rid, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps FROM d)))
  WHERE {keep})"""


_A = secrets.ASSIGN.replace("'", "''")

OP5 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner,
                     coalesce(source, '') || '/' || coalesce(lang, '') AS repo FROM documents),
{_spans("assign", 0, secrets.ASSIGN, f"regexp_extract(hit, '{_A}', 2)", f"length(regexp_extract(hit, '{_A}', 2)) >= 6")},
{_spans("access", 1, secrets.ACCESS, "hit", "true")},
{_spans("hex", 2, secrets.HEX, "hit", "true")},
base AS (FROM assign UNION ALL FROM access UNION ALL FROM hex),
{_spans("bare", 3, "[A-Za-z0-9+/_=-]{16,}", "hit", "regexp_matches(hit, '[0-9]')")},
owned AS (SELECT value, count(DISTINCT owner) <= 1 AS live FROM base JOIN d USING (rid) GROUP BY value),
added AS (SELECT b.* FROM bare b JOIN owned o ON o.value = b.value AND o.live WHERE NOT EXISTS (
            SELECT 1 FROM base s WHERE s.rid = b.rid AND s.start < b.stop AND b.start < s.stop)),
s AS (SELECT base.*, live FROM base JOIN owned USING (value) UNION ALL SELECT *, true FROM added),
g AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
        count(*) FILTER (WHERE kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE kind <> 'bare') AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
        count(*) FILTER (WHERE kind <> 'bare' AND live) AS n_live, count(*) FILTER (WHERE kind <> 'bare' AND NOT live) AS n_example,
        count(*) FILTER (WHERE kind = 'bare') AS n_bare FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_example, 0) AS n_example, coalesce(n_bare, 0) AS n_bare
FROM d LEFT JOIN g USING (rid)"""

OP10 = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(words, i, i + 4) AS shingle FROM (
        SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

OP3 = """WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.95),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.c),
c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
d AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN d USING (vec_id)"""

OP12 = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, a.label AS la, b.vec_id AS b, b.label AS lb,
             CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT a, la, b, score FROM s WHERE la = lb
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank,
       s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND s.lb <> p.la AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 5"""

OP13 = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT part, doc_id, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
        100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t),
        regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails FROM w),
c AS (SELECT part, fails, count(*) AS n,
        count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
        count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM f GROUP BY part, fails),
o AS (SELECT '' AS filter_order UNION ALL
      SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, filter_order[step] AS here,
             list_transform(range(1, step), lambda i: instr('ABCDE', filter_order[i])) AS past, instr('ABCDE', filter_order[step]) AS k
      FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5)),
x AS (SELECT *, len(list_filter(past, lambda i: fails[i])) = 0 AS there FROM c, s),
r AS (SELECT part, filter_order, step, here, sum(n) FILTER (WHERE there AND NOT fails[k]) AS kept,
        sum(n) FILTER (WHERE there AND fails[k]) AS removed, sum(n) FILTER (WHERE NOT there AND fails[k]) AS redundant,
        sum(n) FILTER (WHERE fails[k] AND len(list_filter(fails, lambda b: b)) = 1) AS unique_fails,
        sum(good) FILTER (WHERE there AND fails[k]) AS good_lost, sum(toxic) FILTER (WHERE there AND fails[k]) AS toxic_lost
      FROM x GROUP BY part, filter_order, step, here)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
       CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, here) AS BIGINT) AS shapley FROM r"""

ORACLES = {"op3_embedding_near_dedup": OP3, "op5_secret_scan": OP5, "op10_ngram_jaccard_join": OP10,
           "op12_hard_negatives": OP12,
           "op13_filter_audit": OP13}
