"""SQL of the sequential selections: recursion, one step a round."""

from __future__ import annotations

from ..operators import scoring
from .text_queries import FIELDS

OPEN = "visibility_status = 'visible' AND searchable"


def mmr_sql(rows: str, budget: int = 1200) -> str:
    """``picked`` (query_id, fact_id, rank_position): the greedy selection from ``rows``, the best 80 of each query."""
    share = "(CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / CAST(len(list_distinct(list_concat({0}, {1}))) AS DOUBLE) END)"
    words, ents, eps = share.format("terms", "p_terms"), share.format("ents", "p_ents"), share.format("eps", "p_eps")
    firsts = ", ".join(f"first_value({c}) OVER w AS p_{c}" for c in ("ok", "tokens", "terms", "ents", "predicate", "eps", "st"))
    weighted = f"((0.45 * {words} + 0.20 * {ents} + 0.15 * (CASE WHEN predicate = p_predicate THEN 1.0 ELSE 0.0 END) + 0.10 * {eps}) / 0.90)"
    return f"""ct AS (SELECT from_id AS fact_id, list(DISTINCT to_id) AS eps FROM links WHERE link_type = 'EVIDENCED_BY' AND {OPEN} GROUP BY 1),
mb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS place FROM ({rows}) QUALIFY place <= 80),
mm AS (SELECT query_id, mb.fact_id, score, CAST(CASE WHEN length(content_summary) = 0 THEN 1 ELSE length(content_summary) // 2 + 8 END AS BIGINT) AS tokens, list_distinct({FIELDS.format('content_summary')}) AS terms,
  list_filter([subject_entity_id, object_entity_id], lambda x: x IS NOT NULL) AS ents, predicate, coalesce(eps, []) AS eps, validity_status || '/' || lifecycle_status AS st FROM mb LEFT JOIN ct USING (fact_id)),
mz AS (SELECT *, 0 AS step, CAST(0 AS DOUBLE) AS near, CAST(0 AS BIGINT) AS used, FALSE AS taken FROM mm UNION ALL
  SELECT query_id, fact_id, score, tokens, terms, ents, predicate, eps, st, step + 1,
    CASE WHEN me THEN near ELSE greatest(near, CASE WHEN {words} < 0.80 OR st <> p_st THEN least({weighted}, 0.80) ELSE {weighted} END) END, used + p_tokens, me
  FROM (SELECT *, row_number() OVER w = 1 AS me, {firsts} FROM (SELECT *, near <= 0.88 AND used + tokens <= {budget} AS ok FROM mz WHERE NOT taken AND step < 8)
    WINDOW w AS (PARTITION BY query_id ORDER BY ok DESC, CAST(0.72 AS DOUBLE) * score - CAST('{1 - scoring.MMR_LAMBDA!r}' AS DOUBLE) * near DESC, score DESC, fact_id)) WHERE p_ok),
picked AS (SELECT query_id, fact_id, CAST(step AS BIGINT) AS rank_position FROM mz WHERE taken)"""


def insert_sql(marked: str, targets: str, k: int = 8) -> str:
    """``done`` (query_id, fact_id, rank_position): the selection ``marked`` with the replaced facts ``targets``, in the order of the latter's ``n``."""
    return f"""li AS (SELECT query_id, CAST(0 AS BIGINT) AS n, list({{'f': fact_id, 'h': historical}} ORDER BY rank_position) AS acc FROM {marked} GROUP BY 1
  UNION ALL SELECT query_id, n, CASE WHEN held OR (full_ AND last IS NULL) THEN acc ELSE list_concat(rest[1:pos], [{{'f': fact_id, 'h': TRUE}}], rest[pos + 1:len(rest)]) END
  FROM (SELECT *, coalesce(nullif(list_position(list_transform(rest, lambda x: x.f), source_id), 0), len(rest)) AS pos
    FROM (SELECT *, CASE WHEN full_ THEN list_transform(list_filter(range(1, len(acc) + 1), lambda j: j <> last), lambda j: acc[j]) ELSE acc END AS rest
      FROM (SELECT li.query_id, o.n, acc, o.source_id, o.fact_id, list_contains(list_transform(acc, lambda x: x.f), o.fact_id) AS held, len(acc) >= {k} AS full_,
          list_max(list_filter(range(1, len(acc) + 1), lambda j: acc[j].f <> o.source_id AND NOT acc[j].h)) AS last
        FROM li JOIN {targets} o ON o.query_id = li.query_id AND o.n = li.n + 1)))),
le AS (SELECT query_id, acc FROM li QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC) = 1),
done AS (SELECT query_id, acc[i].f AS fact_id, CAST(i AS BIGINT) AS rank_position FROM (SELECT query_id, acc, unnest(range(1, len(acc) + 1)) AS i FROM le))"""
