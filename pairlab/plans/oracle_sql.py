"""DuckDB twins of the registered queries (correctness oracle).

Each builder returns one SQL string over the driver's pre-registered views.
The V1 fixture is rebuilt with ``v1_sql_ctes`` and randomness uses the SQL
rendering of ``hashrand``, so random draws match the Spark jobs exactly.
"""

from __future__ import annotations

from ..functions import hashrand as hr
from ..operators.calibrate import BETA_START, beta_ladder
from ..sources.fixtures import v1_sql_ctes

COS = "CASE WHEN list_dot_product({a},{a}) > 0 AND list_dot_product({b},{b}) > 0 " \
      "THEN list_cosine_similarity({a}, {b}) ELSE 0.0 END"


def cos_sql(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


def clamp_sql(x: str) -> str:
    return f"greatest(0.001::DOUBLE, least(1.0::DOUBLE, {x}))"


def with_v1(body: str) -> str:
    return f"WITH {v1_sql_ctes()},\n{body}"


# ------------------------------------------------------------------ J1 / E3
def topk_hits_cte(k: int = 5, threshold: float = 0.0) -> str:
    return f"""
v1_sims AS (SELECT t.query_id, c.corpus_id, c.text, {cos_sql('q.embedding', 'c.embedding')} AS score
            FROM v1_testing t JOIN v1_query q ON q.text = t.query CROSS JOIN v1_cand c),
v1_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank
              FROM v1_sims WHERE score > {float(threshold)!r}::DOUBLE),
v1_hits AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, corpus_id, text, score
            FROM v1_ranked WHERE rank <= {int(k)})"""


def ndcg_ctes(k: int = 5) -> str:
    """Per-query NDCG@k with tie averaging, same closed form as the Spark plan."""
    return f"""
v1_m AS (SELECT COUNT(*) AS m FROM v1_cand),
v1_first AS (SELECT text, MIN(corpus_id) AS pos FROM v1_cand GROUP BY text),
v1_hp0 AS (SELECT h.query_id, f.pos, h.score, h.rank FROM v1_hits h JOIN v1_first f ON f.text = h.text),
v1_hp1 AS (SELECT query_id, pos, arg_max(score, rank) AS score FROM v1_hp0 GROUP BY query_id, pos),
v1_gold AS (SELECT DISTINCT g.query_id, f.pos FROM
              (SELECT query_id, unnest(labels) AS text FROM v1_testing) g JOIN v1_first f ON f.text = g.text),
v1_hp AS (SELECT h.query_id, h.pos, h.score, CASE WHEN g.pos IS NULL THEN 0 ELSE 1 END AS rel
          FROM v1_hp1 h LEFT JOIN v1_gold g ON g.query_id = h.query_id AND g.pos = h.pos),
v1_grp AS (SELECT query_id, score, COUNT(*) AS c, SUM(rel) AS r FROM v1_hp GROUP BY query_id, score),
v1_grp2 AS (SELECT *, CAST(COALESCE(SUM(c) OVER (PARTITION BY query_id ORDER BY score DESC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS a FROM v1_grp),
v1_grp3 AS (SELECT *, CAST(a + c - 1 AS BIGINT) AS b FROM v1_grp2),
v1_pq AS (SELECT query_id,
                 SUM(CAST(r AS DOUBLE) / c * (SELECT COALESCE(SUM(1.0 / log2(p + 1.0)), 0.0)
                      FROM range(a, least(b, {k}) + 1) t(p))) AS dcg_hits,
                 SUM(c) AS h, SUM(r) AS tp FROM v1_grp3 GROUP BY query_id),
v1_gc AS (SELECT query_id, COUNT(*) AS g FROM v1_gold GROUP BY query_id),
nd_q AS (SELECT t.query_id, COALESCE(p.dcg_hits, 0.0) AS dcg_hits, CAST(COALESCE(p.h, 0) AS BIGINT) AS h,
                CAST(COALESCE(p.tp, 0) AS BIGINT) AS tp, CAST(COALESCE(gc.g, 0) AS BIGINT) AS g,
                CAST((SELECT m FROM v1_m) AS BIGINT) AS m
         FROM (SELECT DISTINCT query_id FROM v1_testing) t
         LEFT JOIN v1_pq p ON p.query_id = t.query_id LEFT JOIN v1_gc gc ON gc.query_id = t.query_id),
nd_q2 AS (SELECT query_id,
            dcg_hits + CASE WHEN m > h THEN CAST(g - tp AS DOUBLE) / CAST(m - h AS DOUBLE) ELSE 0.0 END
              * (SELECT COALESCE(SUM(1.0 / log2(p + 1.0)), 0.0) FROM range(h + 1, least({k}, m) + 1) t(p)) AS dcg,
            (SELECT COALESCE(SUM(1.0 / log2(p + 1.0)), 0.0) FROM range(1, least({k}, g) + 1) t(p)) AS idcg
          FROM nd_q),
v1_ndcg AS (SELECT query_id, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg FROM nd_q2)"""


def prf_cte() -> str:
    return """
v1_pred AS (SELECT DISTINCT query_id, text FROM v1_hits),
v1_goldt AS (SELECT DISTINCT query_id, unnest(labels) AS text FROM v1_testing),
v1_prf0 AS (SELECT
      SUM(CASE WHEN p.text IS NOT NULL AND g.text IS NOT NULL THEN 1 ELSE 0 END) AS tp,
      COUNT(p.text) AS n_pred, COUNT(g.text) AS n_gold
    FROM v1_pred p FULL OUTER JOIN v1_goldt g ON p.query_id = g.query_id AND p.text = g.text),
v1_prf AS (SELECT CAST(tp AS BIGINT) AS tp, CAST(n_pred AS BIGINT) AS n_pred, CAST(n_gold AS BIGINT) AS n_gold,
                  CAST(tp AS DOUBLE) / NULLIF(CAST(n_pred AS DOUBLE), 0) AS precision,
                  CAST(tp AS DOUBLE) / NULLIF(CAST(n_gold AS DOUBLE), 0) AS recall FROM v1_prf0),
v1_prf2 AS (SELECT *, 2 * precision * recall / NULLIF(precision + recall, 0) AS f1 FROM v1_prf)"""


# ------------------------------------------------------------------ A5
def ladder_values_sql() -> str:
    vals = ", ".join(f"({i}, {b!r}::DOUBLE)" for i, b in enumerate(beta_ladder()))
    return f"(VALUES {vals}) AS lad(i, b)"


def tune_beta_sql(scored_cte: str, alphas: list[float]) -> str:
    """CTE ``tb_res(alpha, beta, kept, positives, precision, reached)`` from
    ``scored_cte(s, y)``, one row per alpha."""
    al = ", ".join(f"({i}, {a!r}::DOUBLE)" for i, a in enumerate(alphas))
    return f"""
tb_lad AS (SELECT * FROM {ladder_values_sql()}),
tb_al AS (SELECT * FROM (VALUES {al}) AS al(ai, alpha)),
tb_sc AS (SELECT s, y FROM {scored_cte} WHERE s IS NOT NULL AND NOT isnan(s)),
tb_scan AS (SELECT al.ai, al.alpha, l.i, l.b,
                   (SELECT COUNT(*) FROM tb_sc WHERE tb_sc.s >= l.b) AS kept,
                   (SELECT COUNT(*) FROM tb_sc WHERE tb_sc.s >= l.b AND tb_sc.y = 1.0) AS positives
            FROM tb_al al CROSS JOIN tb_lad l),
tb_scan2 AS (SELECT *, lead(b) OVER (PARTITION BY ai ORDER BY i) AS b_next FROM tb_scan),
tb_hit AS (SELECT ai, arg_min(b, i) AS b, arg_min(kept, i) AS kept, arg_min(positives, i) AS positives
           FROM tb_scan2 WHERE kept > 0 AND CAST(positives AS DOUBLE) / kept >= alpha GROUP BY ai),
tb_miss AS (SELECT ai, arg_min(b_next, i) AS b_next FROM tb_scan2 WHERE kept = 0 GROUP BY ai),
tb_n AS (SELECT COUNT(*) AS n FROM tb_sc),
tb_res AS (SELECT al.ai, al.alpha,
                  CASE WHEN (SELECT n FROM tb_n) = 0 THEN {BETA_START!r}::DOUBLE
                       WHEN h.ai IS NOT NULL THEN h.b ELSE m.b_next END AS beta,
                  CAST(COALESCE(h.kept, 0) AS BIGINT) AS kept, CAST(COALESCE(h.positives, 0) AS BIGINT) AS positives,
                  CAST(COALESCE(h.positives, 0) AS DOUBLE) / NULLIF(CAST(COALESCE(h.kept, 0) AS DOUBLE), 0) AS precision,
                  h.ai IS NOT NULL AS reached
           FROM tb_al al LEFT JOIN tb_hit h ON h.ai = al.ai LEFT JOIN tb_miss m ON m.ai = al.ai)"""


# ------------------------------------------------------------------ mining
def mining_ctes(anchor: str, method: str, n: int, pt: float, beta: float, seed: int,
                epoch: int, fill: str = "faithful", prefix: str = "",
                pairs: str = "v1_training", known: str | None = None) -> str:
    """CTEs ending in ``{prefix}mres(row_id, slot, target_id, text, score, raw, is_fill)``."""
    from ..operators import mining as mn
    if anchor == "query":
        a_col, x_col, a_dict, t_dict = "text1", "text2", "v1_query", "v1_cand"
    else:
        a_col, x_col, a_dict, t_dict = "text2", "text1", "v1_cand", "v1_query"
    o_dict = "v1_cand" if x_col == "text2" else "v1_query"
    code = hr.ANCHOR_CODE[anchor]
    conds = [f"score >= {float(pt)!r}::DOUBLE"]
    if method in mn.CAPPED:
        cap = beta if isinstance(beta, str) else f"{float(beta)!r}::DOUBLE"
        conds.append(f"score <= {cap}")
    if method in mn.ABOVE_TRUE:
        conds.append("score >= lo")
    weighted = method in mn.WEIGHTED
    ranked = method in mn.RANKED
    filled = method in mn.FILLED
    pu = hr.pair_unit_sql((seed, epoch, code + hr.STREAM_PICK, "r.row_id"), "c.corpus_id")
    if weighted:
        val = f"ln({pu}) / {clamp_sql('raw0')}"
    elif ranked:
        val = "raw0"
    else:
        val = f"-({pu})"
    fill_n = f"{n} + 1 - l" if fill == "faithful" else f"{n} - l"
    fill_cond = f"l <= {n}" if fill == "faithful" else f"l < {n}"
    u_pos = hr.wide_sql(seed, epoch, code + hr.STREAM_FILL, "row_id", "slot")
    u_key = hr.uniform_sql(seed, epoch, code + hr.STREAM_FILL_KEY, "d.row_id", "d.slot")
    if weighted:
        order = "val DESC, is_fill ASC, pos ASC, target_id ASC"
    elif ranked:
        order = "score DESC, is_fill ASC, CASE WHEN is_fill THEN NULL ELSE raw END DESC NULLS LAST, pos ASC, target_id ASC"
    else:
        order = "val DESC, target_id ASC"
    if known:
        kp_mp = f" AND c.text NOT IN (SELECT k.{x_col} FROM {known} k WHERE k.{a_col} = r.{a_col})"
    else:
        kp_mp = ""
    val_e = val.replace("r.row_id", f"{prefix}mp2.row_id").replace("c.corpus_id", f"{prefix}mp2.target_id")
    body = f"""
{prefix}mr AS (SELECT t.row_id, t.text1, t.text2, a.embedding AS vec, {cos_sql('a.embedding', 'o.embedding')} AS lo
       FROM {pairs} t JOIN {a_dict} a ON a.text = t.{a_col} JOIN {o_dict} o ON o.text = t.{x_col}),
{prefix}mp AS (SELECT r.row_id, c.corpus_id AS target_id, c.text, r.lo, {cos_sql('r.vec', 'c.embedding')} AS raw0,
              r.{x_col} AS xt
       FROM {prefix}mr r CROSS JOIN {t_dict} c WHERE c.text <> r.{x_col}{kp_mp}),
{prefix}mp2 AS (SELECT {prefix}mp.*, {clamp_sql('raw0')} AS score FROM {prefix}mp),
{prefix}me0 AS (SELECT {prefix}mp2.row_id, {prefix}mp2.target_id, {prefix}mp2.text, {prefix}mp2.raw0 AS raw, {prefix}mp2.score,
               {val_e} AS val
        FROM {prefix}mp2 WHERE {' AND '.join(conds)}),
{prefix}ml AS (SELECT r.row_id, COUNT(e.row_id) AS l FROM {prefix}mr r LEFT JOIN {prefix}me0 e ON e.row_id = r.row_id GROUP BY r.row_id),
{prefix}me AS (SELECT e.*, row_number() OVER (PARTITION BY row_id ORDER BY val DESC, target_id ASC) - 1 AS pos,
              FALSE AS is_fill FROM {prefix}me0 e),
{prefix}mneed AS (SELECT {prefix}ml.row_id, {fill_n} AS f, r.{x_col} AS xt, r.vec FROM {prefix}ml JOIN {prefix}mr r ON r.row_id = {prefix}ml.row_id
          WHERE {('TRUE' if filled else 'FALSE')} AND {fill_cond}),
{prefix}mslot AS (SELECT row_id, vec, unnest(range(1, f + 1)) AS slot FROM {prefix}mneed),
{prefix}mplace AS (SELECT mp.row_id, mp.target_id, mp.text, c.embedding,
                     row_number() OVER (PARTITION BY mp.row_id ORDER BY mp.text, mp.target_id) - 1 AS place,
                     COUNT(*) OVER (PARTITION BY mp.row_id) AS pool
              FROM {prefix}mp mp JOIN {t_dict} c ON c.corpus_id = mp.target_id),
{prefix}mpool AS (SELECT DISTINCT row_id, pool FROM {prefix}mplace),
{prefix}mtry AS (SELECT row_id, vec, slot, {u_pos} AS h FROM {prefix}mslot),
{prefix}mdraw AS (SELECT t.row_id, t.slot, t.vec, p.target_id, p.text, p.embedding
          FROM {prefix}mtry t JOIN {prefix}mpool o ON o.row_id = t.row_id
          JOIN {prefix}mplace p ON p.row_id = t.row_id AND p.place = t.h % o.pool),
{prefix}mfill AS (SELECT d.row_id, d.target_id, d.text, {cos_sql('d.vec', 'd.embedding')} AS raw, d.slot AS pos, TRUE AS is_fill, d.slot
          FROM {prefix}mdraw d),
{prefix}mfill2 AS (SELECT row_id, target_id, text, raw, {clamp_sql('raw')} AS score,
                  {('ln(' + u_key.replace('d.row_id', 'row_id').replace('d.slot', 'slot') + ') / ' + clamp_sql('raw')) if weighted else 'NULL::DOUBLE'} AS val,
                  pos, is_fill FROM {prefix}mfill),
{prefix}mall AS (SELECT row_id, target_id, text, raw, score, val, pos, is_fill FROM {prefix}me
         UNION ALL SELECT row_id, target_id, text, raw, score, val, pos, is_fill FROM {prefix}mfill2),
{prefix}mpick AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY {order}) AS slot FROM {prefix}mall),
{prefix}mres AS (SELECT row_id, CAST(slot AS INTEGER) AS slot, target_id, text, score, raw, is_fill
         FROM {prefix}mpick WHERE slot <= {n})"""
    return body


def mining_sql(anchor: str, method: str, n: int, pt: float, beta: float, seed: int,
               epoch: int, fill: str = "faithful") -> str:
    ctes = mining_ctes(anchor, method, n, pt, beta, seed, epoch, fill)
    return with_v1(ctes + """
SELECT row_id, slot, target_id, text, round(score, 6) AS score, round(raw, 6) AS raw, is_fill FROM mres""")
