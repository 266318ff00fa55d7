"""Registered queries (one per operator of SURVEY section 2) and their
DuckDB oracle SQL. Every query reads the driver tables under ``sf_dir`` and
runs over all of their rows.

Names follow the operator ids. Computed columns carry the same alias on both
sides; scores are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..operators import mining as mn
from ..operators.calibrate import EpochConfig, tune_beta
from ..operators.metrics import gold_rows, micro_prf, ndcg_per_query, prediction_rows, similarity_correlation
from ..operators.similarity import (by_anchor, first_position, first_row_cosine, pair_cosine, similarity_edges,
                                    top_k_join, vector_lookup, with_vectors)
from ..operators.encode import TRI_A, TRI_B, TRI_C, encode_distinct, mean_pool, token_table, trigram_encoder
from ..sources.fixtures import text_fixture, vector_fixture
from ..sources.readers import read_dictionary, read_pairs, read_testset
from ..streaming.search import (quality_stream, rolling_quality, run_to_completion, search_stream, stream_root,
                                windowed_quality, windowed_quality_stream)
from . import oracle_sql as osql
from ..functions import hashrand as hr
from ..operators.instances import assign_batches, build_instances
from ..operators.losses import (bidirectional_loss, contrastive_loss, cosine_mse_loss, dot_matrix,
                                in_batch_row_losses, one_way_loss, triplet_loss)
from .epoch import compare_samplers, prepare_epoch, prepare_epochs, testing_pairs
from .evaluate import append_results, evaluate, search_test_set

R6 = 6
EPOCHS = list(range(9))
ALPHAS = [EpochConfig.for_epoch(e).alpha for e in EPOCHS]

# mining parameters of the registered checks (smoke values of the reference: threshold 0.5, beta 0.9, n 3)
MINE = dict(pt=0.5, beta=0.9, n=3, seed=7, epoch=1)


def _r(c):
    return F.round(F.col(c) if isinstance(c, str) else c, R6)


# ------------------------------------------------------------------ sources
def _through_files(spark: SparkSession, df: DataFrame, name: str, fmt: str, **options) -> str:
    """Write ``df`` in order as several files under the shared folder: input of the readers."""
    path = f"{stream_root(spark, name)}-{uuid.uuid4().hex[:12]}"
    df.write.format(fmt).options(**options).save(path)
    return path


def q_s1_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """A text dictionary: entries are numbered by file and line."""
    fx = vector_fixture(spark, sf)
    path = _through_files(spark, fx.candidates.orderBy("corpus_id").select("text"), "s1", "text")
    vectors = fx.candidates.select("corpus_id", F.size("embedding").alias("dim"), _r(norm(F.col("embedding"))).alias("norm"))
    return read_dictionary(spark, path, "text").join(vectors, "corpus_id").select("corpus_id", "text", "dim", "norm")


def q_s2_queries(spark, sf):
    """A Parquet dictionary with its own ids."""
    fx = vector_fixture(spark, sf)
    path = _through_files(spark, fx.queries.select(F.col("corpus_id").alias("id"), F.col("text").alias("entry")),
                          "s2", "parquet")
    rest = fx.queries.select("corpus_id", "vec_id", F.size("embedding").alias("dim"),
                             _r(norm(F.col("embedding"))).alias("norm"))
    return read_dictionary(spark, path, "parquet", "entry", "id").join(rest, "corpus_id") \
        .select("corpus_id", "text", "vec_id", "dim", "norm")


def _pairs_back(spark, pairs, name, fmt, columns, **options):
    path = _through_files(spark, pairs.orderBy("row_id").select(*columns), name, fmt, **options)
    return read_pairs(spark, path, "tsv" if fmt == "csv" else fmt)


def q_s3_training(spark, sf):
    """Tab-separated pairs with quoted fields and columns in another order."""
    return _pairs_back(spark, vector_fixture(spark, sf).training, "s3", "csv", ("label", "text2", "text1"),
                       sep="\t", header=True, quoteAll=True)


def q_s4_validation(spark, sf):
    return _pairs_back(spark, vector_fixture(spark, sf).validation, "s4", "parquet", ("text1", "text2", "label"))


def q_s5_testing(spark, sf):
    t = vector_fixture(spark, sf).testing.orderBy("query_id")
    long = t.select("query", F.explode("labels").alias("label"))
    back = read_testset(spark, _through_files(spark, long, "s5", "parquet"), "long")
    return back.select("query_id", "query", F.size("labels").alias("n_labels"),
                       F.array_join(F.array_sort("labels"), "|").alias("labels"))


def q_s6_result_log(spark, sf):
    """Two runs appended to one log, read back."""
    row = q_e3_evaluate(spark, sf)
    path = f"{stream_root(spark, 's6')}-{uuid.uuid4().hex[:12]}"
    for epoch in (0, 1):
        append_results(row, path, "run", "trigram", epoch)
    return spark.read.parquet(path).select("run_id", "model", "epoch", "ndcg", "precision", "recall", "f1")


def q_s7_epoch_table(spark, sf):
    """The written instance table, read back."""
    fx = vector_fixture(spark, sf)
    path = f"{stream_root(spark, 's7')}-{uuid.uuid4().hex[:12]}"
    prepare_epoch(fx.training, fx.validation, fx.queries, fx.candidates,
                  EpochConfig.for_epoch(INST["epoch"], seed=INST["seed"]), output_path=path)
    back = spark.read.parquet(f"{path}/instances")
    return back.select("epoch", "instance_id", "batch_id", "pos", F.array_join("texts", "|").alias("texts"), "label")


def q_c7_batch_plan(spark, sf):
    """Trainer metadata from the number of batches."""
    fx = vector_fixture(spark, sf)
    d = prepare_epoch(fx.training, fx.validation, fx.queries, fx.candidates,
                      EpochConfig.for_epoch(INST["epoch"], seed=INST["seed"]))
    count = d.instances.agg(F.coalesce(F.max("batch_id") + 1, F.lit(0)).cast("long").alias("n_batches"))
    return count.select("n_batches", *EpochConfig.batch_plan_columns(F.col("n_batches")))


def q_s8_corpus_size(spark, sf):
    fx = vector_fixture(spark, sf)
    n_q = fx.queries.agg(F.count(F.lit(1))).scalar()
    return fx.candidates.agg(F.count(F.lit(1)).alias("n_candidates")).select(
        "n_candidates", n_q.alias("n_queries"))


def q_p12_first_position(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("corpus_id"), "text")
    fp = first_position(docs)
    cnt = docs.groupBy("text").agg(F.count(F.lit(1)).alias("n_copies"))
    return fp.join(cnt, "text").select(F.col("corpus_id").alias("first_doc_id"), "n_copies")


# ------------------------------------------------------------------ joins
def q_j1_topk(spark, sf):
    fx = vector_fixture(spark, sf)
    qv = fx.testing.join(vector_lookup(fx.queries).withColumnRenamed("text", "query"), "query") \
                   .select("query_id", "embedding")
    hits = top_k_join(qv, fx.candidates, k=5, threshold=0.0)
    return hits.select("query_id", "rank", "corpus_id", "text", _r("score").alias("score"))


def q_j1_topk_grid(spark, sf):
    """The same search laid on the block grid instead of a broadcast."""
    fx = vector_fixture(spark, sf)
    qv = with_vectors(fx.testing, "query", fx.queries, "embedding").select("query_id", "embedding")
    hits = top_k_join(qv, fx.candidates, k=5, threshold=0.0, broadcast_limit=0, target_block=32, left_block=64)
    return hits.select("query_id", "rank", "corpus_id", "text", _r("score").alias("score"))


def q_p11_plain_hits(spark, sf):
    """Hits without their scores."""
    fx = vector_fixture(spark, sf)
    qv = with_vectors(fx.testing, "query", fx.queries, "embedding").select("query_id", "embedding")
    return top_k_join(qv, fx.candidates, k=5, threshold=0.0, return_scores=False)


def _edges(spark, sf, anchor):
    fx = vector_fixture(spark, sf)
    if anchor == "query":
        a_col, x_col, a_d, t_d = "text1", "text2", fx.queries, fx.candidates
    else:
        a_col, x_col, a_d, t_d = "text2", "text1", fx.candidates, fx.queries
    lk = vector_lookup(a_d).select(F.col("text").alias(a_col), F.col("embedding").alias("vec"))
    rows = by_anchor(fx.training.join(lk, a_col), a_col, "row_id", spark.sparkContext.defaultParallelism)
    left = rows.select(F.col("row_id").alias("key"), "anchor", "vec", F.xxhash64(x_col).alias("xh"),
                       F.col(x_col).alias("xt"))
    e = similarity_edges(left, t_d, min_score=0.5, clamp=True, left_spread=True)
    return e.select(F.col("key").alias("row_id"), "target_id", "text", _r("raw").alias("score"),
                    _r(F.greatest(F.lit(0.001), F.least(F.lit(1.0), F.col("raw")))).alias("clamped"))


def q_j2_query_edges(spark, sf):
    return _edges(spark, sf, "query")


def q_j3_candidate_edges(spark, sf):
    return _edges(spark, sf, "candidate")


def q_j4_pair_cosine(spark, sf):
    fx = vector_fixture(spark, sf)
    s = pair_cosine(fx.validation, fx.queries, fx.candidates)
    return s.select("row_id", "text1", "text2", "label", _r("score").alias("score"))


def q_j5_first_row_cosine(spark, sf):
    fx = vector_fixture(spark, sf)
    s = first_row_cosine(fx.validation, fx.queries, fx.candidates)
    return s.select("row_id", "text1", "text2", "label", _r("score").alias("score"))


def _hits(spark, sf):
    fx = vector_fixture(spark, sf)
    return fx, search_test_set(fx.testing, fx.queries, fx.candidates, k=5)


def q_j6_true_positives(spark, sf):
    fx, hits = _hits(spark, sf)
    p = prediction_rows(hits)
    g = gold_rows(fx.testing)
    tp = p.join(g, ["query_id", "text"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("tp"))
    return fx.testing.select("query_id").join(tp, "query_id", "left") \
                     .select("query_id", F.coalesce("tp", F.lit(0)).cast("long").alias("tp"))


def q_j7_gold_in_dictionary(spark, sf):
    fx = vector_fixture(spark, sf)
    g = gold_rows(fx.testing)
    known = g.join(fx.candidates.select("text"), "text", "left_semi") \
             .groupBy("query_id").agg(F.count(F.lit(1)).alias("n_known"))
    allg = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    return allg.join(known, "query_id", "left").select(
        "query_id", "n_gold", F.coalesce("n_known", F.lit(0)).cast("long").alias("n_known"))


# ------------------------------------------------------------------ metrics
def q_a3_micro_prf(spark, sf):
    fx, hits = _hits(spark, sf)
    r = micro_prf(prediction_rows(hits), gold_rows(fx.testing))
    return r.select("tp", "n_pred", "n_gold", _r("precision").alias("precision"),
                    _r("recall").alias("recall"), _r("f1").alias("f1"))


def q_a4_ndcg(spark, sf):
    fx, hits = _hits(spark, sf)
    return ndcg_per_query(hits, fx.testing, fx.candidates, fx.n_candidates, 5) \
        .select("query_id", F.round("ndcg", 9).alias("ndcg"))


def q_e3_evaluate(spark, sf):
    fx = vector_fixture(spark, sf)
    r = evaluate(fx.testing, fx.queries, fx.candidates, fx.n_candidates, k=5)
    return r.select(F.round("ndcg", 9).alias("ndcg"), F.round("ndcg_x100", 6).alias("ndcg_x100"),
                    _r("precision").alias("precision"), _r("recall").alias("recall"), _r("f1").alias("f1"),
                    "tp", "n_pred", "n_gold")


def q_e3_evaluate_text(spark, sf):
    """Whole texts against the benchmark's texts. The query dictionary holds every second document only: the other
    texts are encoded on the way. Gold: item number doc_id modulo the number of items."""
    tf = text_fixture(spark, sf)
    enc = trigram_encoder(TEXT["dim"])
    items = mn.materialize_dictionary(encode_distinct(tf.candidates, "text", enc))
    n = items.count()
    gold = items.select(F.col("corpus_id").alias("gold"), F.array("text").alias("labels"))
    docs = tf.queries.withColumn("gold", F.col("doc_id") % n)
    testing = docs.join(gold, "gold", "left").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"),
                                                     F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))
    known = encode_distinct(tf.queries.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("corpus_id"), "text"),
                            "text", enc)
    r = evaluate(testing, known, items, n, k=TEXT["k"], encoder=enc)
    return r.select(_r("ndcg").alias("ndcg"), _r("precision").alias("precision"), _r("recall").alias("recall"),
                    "tp", "n_pred", "n_gold")


def _e3_text_sql() -> str:
    hits = _p1_topk_sql().rsplit("SELECT doc_id, CAST(rank", 1)[0]
    return hits.rstrip() + f""",
v1_cand AS (SELECT item_id AS corpus_id, text FROM benchmark),
v1_testing AS (SELECT d.doc_id AS query_id,
                 CASE WHEN b.text IS NULL THEN []::VARCHAR[] ELSE [b.text] END AS labels
               FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT COUNT(*) FROM benchmark)),
v1_hits AS (SELECT rk.doc_id AS query_id, rk.rank, rk.item_id AS corpus_id, b.text, rk.score
            FROM rk JOIN benchmark b ON b.item_id = rk.item_id WHERE rk.rank <= {TEXT["k"]}),""" + osql.ndcg_ctes(TEXT["k"]) + "," + osql.prf_cte() + """,
nd AS (SELECT AVG(ndcg) AS ndcg FROM v1_ndcg)
SELECT round(nd.ndcg, 6) AS ndcg, round(p.precision, 6) AS precision, round(p.recall, 6) AS recall,
       p.tp, p.n_pred, p.n_gold FROM nd, v1_prf2 p"""


def _validation_scores(spark, sf):
    fx = vector_fixture(spark, sf)
    return fx, pair_cosine(fx.validation, fx.queries, fx.candidates)


def q_a5_tune_beta(spark, sf):
    _, s = _validation_scores(spark, sf)
    r = tune_beta(s, ALPHAS)
    return r.select(_r("alpha").alias("alpha"), "beta", "kept", "positives",
                    _r("precision").alias("precision"), "reached")


def q_a5_tune_beta_first_row(spark, sf):
    fx = vector_fixture(spark, sf)
    s = first_row_cosine(fx.validation, fx.queries, fx.candidates)
    r = tune_beta(s, ALPHAS)
    return r.select(_r("alpha").alias("alpha"), "beta", "kept", "positives",
                    _r("precision").alias("precision"), "reached")


def q_a5_tune_beta_labels(spark, sf):
    """Every validation pair; a positive pair counts only if its query's label of quality, where there is one, is 1."""
    fx = vector_fixture(spark, sf)
    s = pair_cosine(fx.validation, fx.queries, fx.candidates)
    q = fx.queries.groupBy(F.col("text").alias("text1")).agg(F.min("vec_id").alias("vec_id"))
    lab = spark.read.parquet(f"{sf}/labels.parquet").groupBy(F.col("doc_id").alias("vec_id")).agg(
        F.min("quality").cast("double").alias("quality"))
    scored = s.join(q, "text1", "left").join(lab, "vec_id", "left").select(
        "score", (F.col("label") * F.coalesce("quality", F.lit(1.0))).alias("label"))
    r = tune_beta(scored, ALPHAS)
    return r.select(_r("alpha").alias("alpha"), "beta", "kept", "positives",
                    _r("precision").alias("precision"), "reached")


def q_a11_correlation(spark, sf):
    _, s = _validation_scores(spark, sf)
    r = similarity_correlation(s, "score", "label")
    return r.select(_r("pearson").alias("pearson"), _r("spearman").alias("spearman"))


# ------------------------------------------------------------------ mining
def _mine(anchor, method, n=None, pt=None, seed=None, epoch=None, beta=None):
    p = dict(MINE)
    p.update({k: v for k, v in dict(n=n, pt=pt, seed=seed, epoch=epoch, beta=beta).items() if v is not None})

    def run(spark, sf):
        fx = vector_fixture(spark, sf)
        res = mn.mine_negatives(fx.training, fx.queries, fx.candidates, anchor=anchor, method=method,
                                positive_threshold=p["pt"], beta=p["beta"], num_negatives=p["n"],
                                seed=p["seed"], epoch=p["epoch"])
        return res.negatives.select("row_id", "slot", "target_id", "text", _r("score").alias("score"),
                                    _r("raw").alias("raw"), "is_fill")

    sql = osql.mining_sql(anchor, method, p["n"], p["pt"], p["beta"], p["seed"], p["epoch"])
    return run, sql


MINING = {
    "m1_topk_query": ("query", mn.TOPK, {}),
    "m1_topk_candidate": ("candidate", mn.TOPK, {}),
    "m2_topk_efn_query": ("query", mn.TOPK_EFN, {}),
    "m2_topk_efn_candidate": ("candidate", mn.TOPK_EFN, {}),
    "m3_larger_than_true_query": ("query", mn.LARGER, {}),
    "m3_larger_than_true_candidate": ("candidate", mn.LARGER, {}),
    "m4_larger_than_true_efn_query": ("query", mn.LARGER_EFN, {}),
    "m4_larger_than_true_efn_candidate": ("candidate", mn.LARGER_EFN, {}),
    "m5_multinomial_query": ("query", mn.MULTI, {}),
    "m5_multinomial_candidate": ("candidate", mn.MULTI, {"n": 10}),
    "m5_multinomial_epoch0": ("query", mn.MULTI, {"pt": 0.0, "beta": 1.0, "epoch": 0}),
    "m6_multinomial_efn_query": ("query", mn.MULTI_EFN, {}),
    "m6_multinomial_efn_candidate": ("candidate", mn.MULTI_EFN, {}),
    "m7_uniform_query": ("query", "uniform", {}),
    "m7_uniform_candidate": ("candidate", "uniform", {}),
}


def q_m8_easy_negative(spark, sf):
    fx = vector_fixture(spark, sf)
    d = mn.easy_negatives(fx.training, fx.candidates, seed=MINE["seed"], epoch=MINE["epoch"])
    return d.select("row_id", "target_id", "text")


def sql_m8_easy_negative() -> str:
    h = hr.wide_sql(MINE["seed"], MINE["epoch"], hr.STREAM_EASY, "row_id", 1)
    return osql.with_v1(f"""
e0 AS (SELECT t.row_id, c.corpus_id AS target_id, c.text,
              row_number() OVER (PARTITION BY t.row_id ORDER BY c.text, c.corpus_id) - 1 AS place,
              COUNT(*) OVER (PARTITION BY t.row_id) AS pool
       FROM v1_training t JOIN v1_cand c ON c.text <> t.text2)
SELECT row_id, target_id, text FROM e0 WHERE place = {h} % pool""")


# ------------------------------------------------------------------ instances
INST = dict(pt=0.5, beta=0.9, seed=7, epoch=1, nq=10, nc=3, batch=32)


def _inst_out(df):
    return df.select("instance_id", "row_id", F.size("texts").alias("n_texts"),
                     F.array_join("texts", "|").alias("texts"), "label")


def _build(kind, method, **kw):
    def run(spark, sf):
        fx = vector_fixture(spark, sf)
        r = build_instances(kind, fx.training if kind != "validation" else fx.validation,
                            fx.queries, fx.candidates, method=method,
                            num_hard_negative_queries=INST["nq"], num_hard_negative_candidates=INST["nc"],
                            positive_threshold=INST["pt"], beta=INST["beta"], seed=INST["seed"],
                            epoch=INST["epoch"], **kw)
        return _inst_out(r.instances)
    return run


def q_w5_batches(spark, sf):
    fx = vector_fixture(spark, sf)
    inst = build_instances("validation", fx.validation, fx.queries, fx.candidates).instances
    b = assign_batches(inst, INST["batch"], INST["seed"], INST["epoch"])
    return b.select("instance_id", "batch_id", "pos")


def q_e1_prepare_epoch(spark, sf):
    fx = vector_fixture(spark, sf)
    cfg = EpochConfig.for_epoch(INST["epoch"], seed=INST["seed"])
    d = prepare_epoch(fx.training, fx.validation, fx.queries, fx.candidates, cfg)
    return d.instances.select("instance_id", "batch_id", "pos", F.size("texts").alias("n_texts"),
                              F.array_join("texts", "|").alias("texts"), "label")


def q_e2_epochs(spark, sf):
    """The schedule 0 ... 8 with one scoring pass for each direction."""
    fx = vector_fixture(spark, sf)
    configs = [EpochConfig.for_epoch(e, seed=INST["seed"]) for e in EPOCHS]
    out = None
    for d in prepare_epochs(fx.training, fx.validation, fx.queries, fx.candidates, configs):
        part = d.instances.select(F.lit(d.config.epoch).alias("epoch"), "instance_id", "batch_id", "pos",
                                  F.size("texts").alias("n_texts"), F.array_join("texts", "|").alias("texts"), "label")
        out = part if out is None else out.unionByName(part)
    return out


def _recipe(recipe: str, hard: bool = True):
    def run(spark, sf):
        fx = vector_fixture(spark, sf)
        cfg = EpochConfig.for_recipe(recipe, INST["epoch"], hard, seed=INST["seed"])
        d = prepare_epoch(fx.training, fx.validation, fx.queries, fx.candidates, cfg)
        return d.instances.select("instance_id", "batch_id", "pos", F.size("texts").alias("n_texts"),
                                  F.array_join("texts", "|").alias("texts"), "label")
    return run


def q_e4_compare_samplers(spark, sf):
    fx = vector_fixture(spark, sf)
    r = compare_samplers(testing_pairs(fx.testing), fx.queries, fx.candidates,
                         positive_threshold=MINE["pt"], beta=MINE["beta"], num_negatives=MINE["n"],
                         seed=MINE["seed"], epoch=MINE["epoch"])
    return r.select("method", "anchor", "row_id", "slot", "text", _r("score").alias("score"), "is_fill")


def _inst_sql(kind: str, beta=None, pt=None, ep=None) -> str:
    seed = INST["seed"]
    pt, ep = INST["pt"] if pt is None else pt, INST["epoch"] if ep is None else ep
    beta = INST["beta"] if beta is None else beta
    out = """SELECT instance_id, row_id, len(texts) AS n_texts, array_to_string(texts, '|') AS texts, label
             FROM inst"""
    if kind == "validation":
        return osql.with_v1("inst AS (SELECT row_id AS instance_id, row_id, [text1, text2] AS texts, label "
                            "FROM v1_validation)\n" + out)
    if kind == "bidirectional":
        ctes = (osql.mining_ctes("candidate", mn.MULTI, INST["nq"], pt, beta, seed, ep, prefix="hq_") + "," +
                osql.mining_ctes("query", mn.MULTI, INST["nc"], pt, beta, seed, ep, prefix="hc_"))
        return osql.with_v1(ctes + f""",
hqa AS (SELECT row_id, list(text ORDER BY slot) AS hq FROM hq_mres GROUP BY row_id),
hca AS (SELECT row_id, list(text ORDER BY slot) AS hc FROM hc_mres GROUP BY row_id),
inst AS (SELECT t.row_id AS instance_id, t.row_id,
                list_concat([t.text1], COALESCE(hqa.hq, []::VARCHAR[]), [t.text2], COALESCE(hca.hc, []::VARCHAR[])) AS texts,
                t.label
         FROM v1_training t LEFT JOIN hqa ON hqa.row_id = t.row_id LEFT JOIN hca ON hca.row_id = t.row_id
         WHERE len(COALESCE(hqa.hq, []::VARCHAR[])) = {INST["nq"]} AND len(COALESCE(hca.hc, []::VARCHAR[])) = {INST["nc"]})
""" + out)
    if kind == "one_way":
        ctes = osql.mining_ctes("query", mn.MULTI_EFN, INST["nc"], pt, beta, seed, ep, prefix="hc_")
        return osql.with_v1(ctes + f""",
hca AS (SELECT row_id, list(text ORDER BY slot) AS hc FROM hc_mres GROUP BY row_id),
inst AS (SELECT t.row_id AS instance_id, t.row_id,
                list_concat([t.text1, t.text2], COALESCE(hca.hc, []::VARCHAR[])) AS texts, t.label
         FROM v1_training t LEFT JOIN hca ON hca.row_id = t.row_id
         WHERE len(COALESCE(hca.hc, []::VARCHAR[])) = {INST["nc"]})
""" + out)
    ctes = osql.mining_ctes("query", mn.TOPK, 1, pt, beta, seed, ep, prefix="h1_")
    neg = "ng AS (SELECT row_id, text AS neg FROM h1_mres WHERE slot = 1)"
    return osql.with_v1(ctes + ",\n" + neg) + _pairs_with_negatives(kind)


def _pairs_with_negatives(kind: str) -> str:
    """CTE ``inst`` from ``ng(row_id, neg)`` and the final select."""
    out = """SELECT instance_id, row_id, len(texts) AS n_texts, array_to_string(texts, '|') AS texts, label
             FROM inst"""
    if kind == "triplet":
        return """,
inst AS (SELECT t.row_id AS instance_id, t.row_id, [t.text1, t.text2, ng.neg] AS texts, t.label
         FROM v1_training t JOIN ng ON ng.row_id = t.row_id)
""" + out
    return """,
inst AS (SELECT t.row_id * 2 AS instance_id, t.row_id, [t.text1, t.text2] AS texts, t.label
         FROM v1_training t
         UNION ALL
         SELECT t.row_id * 2 + 1, t.row_id, [t.text1, ng.neg], 0.0::DOUBLE
         FROM v1_training t JOIN ng ON ng.row_id = t.row_id)
""" + out


def _batch_sql(inst_select: str, id_col: str = "instance_id", ep=None) -> str:
    key = hr.wide_sql(INST["seed"], INST["epoch"] if ep is None else ep, hr.STREAM_BATCH, id_col)
    return f"""bk AS (SELECT *, {key} AS _bk FROM ({inst_select})),
bi AS (SELECT *, row_number() OVER (ORDER BY _bk, {id_col}) - 1 AS _idx FROM bk)"""


def _w5_sql() -> str:
    return osql.with_v1(_batch_sql("SELECT row_id AS instance_id FROM v1_validation") + f"""
SELECT instance_id, CAST(_idx // {INST["batch"]} AS BIGINT) AS batch_id, CAST(_idx % {INST["batch"]} AS INTEGER) AS pos
FROM bi""")


def _e1_sql(pt=None, ep=None) -> str:
    src = _inst_sql("bidirectional", pt=pt, ep=ep)
    head, tail = src.rsplit("SELECT instance_id, row_id, len(texts)", 1)
    return head.rstrip() + ",\n" + _batch_sql("SELECT * FROM inst", ep=ep) + f"""
SELECT instance_id, CAST(_idx // {INST["batch"]} AS BIGINT) AS batch_id, CAST(_idx % {INST["batch"]} AS INTEGER) AS pos,
       len(texts) AS n_texts, array_to_string(texts, '|') AS texts, label FROM bi"""


def _e2_sql() -> str:
    """Nine single epochs, each by its own mining."""
    parts = [f"SELECT {e} AS epoch, * FROM ({_e1_sql(EpochConfig.for_epoch(e).positive_threshold, e)})" for e in EPOCHS]
    return "\nUNION ALL\n".join(parts)


def _recipe_sql(recipe: str, hard: bool = True) -> str:
    cfg = EpochConfig.for_recipe(recipe, INST["epoch"], hard)
    if recipe == "one_way":      # its cap is the tuned beta
        pc = f"""pc AS (SELECT v.label AS y, {osql.cos_sql('q.embedding', 'c.embedding')} AS s
              FROM v1_validation v JOIN v1_query q ON q.text = v.text1 JOIN v1_cand c ON c.text = v.text2),"""
        src = _inst_sql("one_way", "(SELECT beta FROM tb_res)")
        head = src.index("hc_mr AS")
        src = src[:head] + pc + osql.tune_beta_sql("pc", [cfg.alpha]) + ",\n" + src[head:]
    elif hard:
        src = _inst_sql("triplet" if recipe == "triplet" else "contrastive")
    else:
        easy = sql_m8_easy_negative()
        cut = easy.index("SELECT row_id, target_id, text FROM e0")
        src = easy[:cut].rstrip() + ",\nng AS (" + easy[cut:].replace("target_id, text", "text AS neg") + ")" + \
            _pairs_with_negatives("triplet" if recipe == "triplet" else "contrastive")
    head = src.rsplit("SELECT instance_id, row_id, len(texts)", 1)[0]
    return head.rstrip() + ",\n" + _batch_sql("SELECT * FROM inst") + f"""
SELECT instance_id, CAST(_idx // {cfg.train_batch_size} AS BIGINT) AS batch_id,
       CAST(_idx % {cfg.train_batch_size} AS INTEGER) AS pos, len(texts) AS n_texts,
       array_to_string(texts, '|') AS texts, label FROM bi"""


def _e4_sql() -> str:
    parts, sels = [], []
    i = 0
    for method in mn.METHODS:
        for anchor in ("query", "candidate"):
            pre = f"c{i}_"
            parts.append(osql.mining_ctes(anchor, method, MINE["n"], MINE["pt"], MINE["beta"], MINE["seed"],
                                          MINE["epoch"], prefix=pre, pairs="tp"))
            sels.append(f"SELECT '{method}' AS method, '{anchor}' AS anchor, row_id, slot, text, "
                        f"round(score, 6) AS score, is_fill FROM {pre}mres")
            i += 1
    tp = "tp AS (SELECT query_id AS row_id, query AS text1, labels[1] AS text2, 1.0::DOUBLE AS label FROM v1_testing)"
    return osql.with_v1(tp + "," + ",".join(parts) + "\n" + "\nUNION ALL\n".join(sels))


# ------------------------------------------------------------------ losses
LOSS = dict(scale=20.0, contrastive_margin=0.5, triplet_margin=5.0)


def _epoch_batches(spark, sf):
    fx = vector_fixture(spark, sf)
    cfg = EpochConfig.for_epoch(INST["epoch"], seed=INST["seed"])
    d = prepare_epoch(fx.training, fx.validation, fx.queries, fx.candidates, cfg)
    return fx, d.instances


def q_a6_bidirectional_loss(spark, sf):
    fx, b = _epoch_batches(spark, sf)
    r = in_batch_row_losses(b, fx.queries, fx.candidates, INST["nq"], LOSS["scale"])
    return r.select("batch_id", "pos", _r("forward").alias("forward"), _r("backward").alias("backward"))


def q_a6_batch_loss(spark, sf):
    fx, b = _epoch_batches(spark, sf)
    r = bidirectional_loss(b, fx.queries, fx.candidates, INST["nq"], LOSS["scale"])
    return r.select("batch_id", "n", _r("loss").alias("loss"))


def q_a6_dot_loss(spark, sf):
    fx, b = _epoch_batches(spark, sf)
    r = in_batch_row_losses(b, fx.queries, fx.candidates, INST["nq"], LOSS["scale"], similarity=dot_matrix)
    return r.select("batch_id", "pos", _r("forward").alias("forward"), _r("backward").alias("backward"))


def q_a7_one_way_loss(spark, sf):
    fx, b = _epoch_batches(spark, sf)
    nq = INST["nq"]
    one = b.select("batch_id", "pos", F.concat(F.slice("texts", 1, 1),
                                               F.slice("texts", nq + 2, INST["nc"] + 1)).alias("texts"))
    r = one_way_loss(one, fx.queries, fx.candidates, LOSS["scale"])
    return r.select("batch_id", "n", _r("loss").alias("loss"))


def _pair_loss(kind, fn, *args):
    def run(spark, sf):
        fx = vector_fixture(spark, sf)
        inst = build_instances(kind, fx.training, fx.queries, fx.candidates, method=mn.TOPK,
                               positive_threshold=INST["pt"], beta=INST["beta"], seed=INST["seed"],
                               epoch=INST["epoch"]).instances
        return fn(inst, fx.queries, fx.candidates, *args).select("n", _r("loss").alias("loss"))
    return run


def _loss_sql_base() -> tuple[str, str]:
    """(CTEs up to batched rows ``bt(batch_id, pos, texts)``, nothing)."""
    src = _e1_sql()
    head = src.rsplit("SELECT instance_id, CAST(_idx //", 1)[0]
    return head.rstrip() + f""",
bt AS (SELECT CAST(_idx // {INST["batch"]} AS BIGINT) AS batch_id, CAST(_idx % {INST["batch"]} AS INTEGER) AS pos,
              texts FROM bi)""", ""


def _inbatch_sql(texts_expr: str, nq: int, score: str | None = None) -> str:
    score = score or osql.cos_sql("a.vec", "c.vec")
    base, _ = _loss_sql_base()
    sc = float(LOSS["scale"])
    return base + f""",
bt2 AS (SELECT batch_id, pos, {texts_expr} AS texts FROM bt),
ex0 AS (SELECT batch_id, pos, texts, unnest(generate_series(1, len(texts))) AS i FROM bt2),
ex AS (SELECT batch_id, pos, texts[i] AS text, i - 1 AS idx FROM ex0),
exs AS (SELECT batch_id, pos, text, CASE WHEN idx <= {nq} THEN 0 ELSE 1 END AS side,
               CASE WHEN idx <= {nq} THEN idx ELSE idx - {nq} - 1 END AS blk FROM ex),
ev AS (SELECT e.*, COALESCE(q.embedding, c.embedding) AS vec FROM exs e
       LEFT JOIN v1_query q ON e.side = 0 AND q.text = e.text
       LEFT JOIN v1_cand c ON e.side = 1 AND c.text = e.text),
anc AS (SELECT * FROM ev WHERE side = 0),
cnd AS (SELECT * FROM ev WHERE side = 1),
fs AS (SELECT a.batch_id, a.pos, c.blk AS cblk, c.pos AS cpos,
              {sc!r}::DOUBLE * {score} AS s
       FROM anc a JOIN cnd c ON a.batch_id = c.batch_id WHERE a.blk = 0),
fm AS (SELECT batch_id, pos, max(s) AS m FROM fs GROUP BY batch_id, pos),
fl AS (SELECT fs.batch_id, fs.pos, fm.m + ln(sum(exp(fs.s - fm.m))) AS lse,
              max(CASE WHEN fs.cblk = 0 AND fs.cpos = fs.pos THEN fs.s END) AS d
       FROM fs JOIN fm ON fm.batch_id = fs.batch_id AND fm.pos = fs.pos GROUP BY fs.batch_id, fs.pos, fm.m),
bs AS (SELECT c.batch_id, c.pos, a.blk AS ablk, a.pos AS apos,
              {sc!r}::DOUBLE * {score} AS s
       FROM anc a JOIN cnd c ON a.batch_id = c.batch_id WHERE c.blk = 0),
bm AS (SELECT batch_id, pos, max(s) AS m FROM bs GROUP BY batch_id, pos),
bl AS (SELECT bs.batch_id, bs.pos, bm.m + ln(sum(exp(bs.s - bm.m))) AS lse,
              max(CASE WHEN bs.ablk = 0 AND bs.apos = bs.pos THEN bs.s END) AS d
       FROM bs JOIN bm ON bm.batch_id = bs.batch_id AND bm.pos = bs.pos GROUP BY bs.batch_id, bs.pos, bm.m),
rl AS (SELECT fl.batch_id, fl.pos, fl.lse - fl.d AS forward, bl.lse - bl.d AS backward
       FROM fl JOIN bl ON bl.batch_id = fl.batch_id AND bl.pos = fl.pos)"""


def _a6_sql(score: str | None = None) -> str:
    return _inbatch_sql("texts", INST["nq"], score) + """
SELECT batch_id, pos, round(forward, 6) AS forward, round(backward, 6) AS backward FROM rl"""


def _a6_batch_sql() -> str:
    return _inbatch_sql("texts", INST["nq"]) + """
SELECT batch_id, COUNT(*) AS n, round((avg(forward) + avg(backward)) / 2.0, 6) AS loss FROM rl GROUP BY batch_id"""


def _a7_sql() -> str:
    nq, nc = INST["nq"], INST["nc"]
    return _inbatch_sql(f"list_concat(texts[1:1], texts[{nq + 2}:{nq + 2 + nc}])", 0) + """
SELECT batch_id, COUNT(*) AS n, round(avg(forward), 6) AS loss FROM rl GROUP BY batch_id"""


def _pair_loss_sql(kind: str, loss: str) -> str:
    src = _inst_sql(kind)
    head = src.rsplit("SELECT instance_id, row_id, len(texts)", 1)[0]
    cos = osql.cos_sql("q.embedding", "c.embedding")
    if loss == "contrastive":
        m = float(LOSS["contrastive_margin"])
        row = (f"0.5 * (label * (1.0 - {cos}) * (1.0 - {cos}) + (1.0 - label) * "
               f"pow(greatest(0.0, {m!r}::DOUBLE - (1.0 - {cos})), 2))")
    elif loss == "mse":
        row = f"({cos} - label) * ({cos} - label)"
    else:
        m = float(LOSS["triplet_margin"])
        d1 = "sqrt(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"
        d2 = "sqrt(list_sum(list_transform(list_zip(q.embedding, n.embedding), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"
        return head.rstrip() + f"""
SELECT COUNT(*) AS n, round(avg(greatest(0.0, {d1} - {d2} + {m!r}::DOUBLE)), 6) AS loss
FROM inst i JOIN v1_query q ON q.text = i.texts[1] JOIN v1_cand c ON c.text = i.texts[2]
JOIN v1_cand n ON n.text = i.texts[3]"""
    return head.rstrip() + f"""
SELECT COUNT(*) AS n, round(avg({row}), 6) AS loss
FROM inst i JOIN v1_query q ON q.text = i.texts[1] JOIN v1_cand c ON c.text = i.texts[2]"""


# ------------------------------------------------------------------ text path
TEXT = dict(dim=256, token_dim=64, k=5)


def _checksum(v):
    return F.aggregate(F.transform(v, lambda x, i: x * (i + 1).cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def q_p1_text_encode(spark, sf):
    tf = text_fixture(spark, sf)
    e = encode_distinct(tf.queries, "text", trigram_encoder(TEXT["dim"]))
    return e.select("doc_id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nnz"),
                    _r(_checksum(F.col("embedding"))).alias("checksum"))


def q_p1_text_topk(spark, sf):
    tf = text_fixture(spark, sf)
    enc = trigram_encoder(TEXT["dim"])
    items = encode_distinct(tf.candidates, "text", enc)
    docs = encode_distinct(tf.queries, "text", enc).select("doc_id", "embedding")
    hits = top_k_join(docs, items, k=TEXT["k"], threshold=0.0, key="doc_id")
    return hits.select("doc_id", "rank", F.col("corpus_id").alias("item_id"), _r("score").alias("score"))


def q_p2_mean_pool(spark, sf):
    tf = text_fixture(spark, sf)
    tv = token_table(tf.queries, "text", trigram_encoder(TEXT["token_dim"]))
    pooled = mean_pool(tf.queries, "doc_id", "text", tv)
    return pooled.select("doc_id", "n_tokens", _r(_checksum(F.col("embedding"))).alias("checksum"))


P3_TOKENS = 32


def q_p3_truncated_pool(spark, sf):
    """P2 over the first tokens only (P3 is this cut)."""
    tf = text_fixture(spark, sf)
    tv = token_table(tf.queries, "text", trigram_encoder(TEXT["token_dim"]))
    pooled = mean_pool(tf.queries, "doc_id", "text", tv, max_tokens=P3_TOKENS)
    return pooled.select("doc_id", "n_tokens", _r(_checksum(F.col("embedding"))).alias("checksum"))


def _tri_sql(src: str, key: str, text: str, dim: int, name: str) -> str:
    """CTEs ``{name}(key, idx, w)``: sparse unit trigram vectors of ``src``."""
    return f"""
{name}_cp AS (SELECT {key} AS k, list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS cp
              FROM {src}),
{name}_h AS (SELECT k, unnest(list_transform(range(1, len(cp) - 1),
                 lambda i: cp[i] * {TRI_A} + cp[i + 1] * {TRI_B} + cp[i + 2] * {TRI_C})) AS h
             FROM {name}_cp WHERE len(cp) >= 3),
{name}_c AS (SELECT k, h % {dim} AS idx, SUM(1 - 2 * ((h // {dim}) % 2)) AS val FROM {name}_h GROUP BY k, idx),
{name}_n AS (SELECT k, sqrt(SUM(CAST(val AS DOUBLE) * val)) AS n FROM {name}_c GROUP BY k),
{name} AS (SELECT c.k AS {key}, c.idx, CAST(c.val AS DOUBLE) / n.n AS w FROM {name}_c c JOIN {name}_n n ON n.k = c.k
           WHERE c.val <> 0)"""


def _p1_encode_sql() -> str:
    return "WITH " + _tri_sql("documents", "doc_id", "text", TEXT["dim"], "dv").lstrip() + """
SELECT d.doc_id, CAST(COUNT(v.idx) AS BIGINT) AS nnz, round(COALESCE(SUM(v.w * (v.idx + 1)), 0.0), 6) AS checksum
FROM documents d LEFT JOIN dv v ON v.doc_id = d.doc_id GROUP BY d.doc_id"""


def _p1_topk_sql() -> str:
    return ("WITH " + _tri_sql("documents", "doc_id", "text", TEXT["dim"], "dv").lstrip() + "," +
            _tri_sql("benchmark", "item_id", "text", TEXT["dim"], "iv") + f""",
dots AS (SELECT d.doc_id, i.item_id, SUM(d.w * i.w) AS score FROM dv d JOIN iv i ON i.idx = d.idx
         GROUP BY d.doc_id, i.item_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM dots
       WHERE score > 0.0)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM rk WHERE rank <= {TEXT["k"]}""")


def _p2_sql(max_tokens: int | None = None) -> str:
    cut = f"[:{max_tokens}]" if max_tokens else ""
    return f"""WITH
tk AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> ''){cut}) AS token FROM documents),
tc AS (SELECT doc_id, token, COUNT(*) AS cnt FROM tk GROUP BY doc_id, token),
toks AS (SELECT DISTINCT token FROM tc),""" + _tri_sql("toks", "token", "token", TEXT["token_dim"], "tv") + """,
tot AS (SELECT doc_id, SUM(cnt) AS n FROM tc GROUP BY doc_id),
pooled AS (SELECT c.doc_id, v.idx, SUM(c.cnt * v.w) AS s FROM tc c JOIN tv v ON v.token = c.token GROUP BY c.doc_id, v.idx)
SELECT d.doc_id, CAST(COALESCE(t.n, 0) AS BIGINT) AS n_tokens,
       round(COALESCE((SELECT SUM(p.s / t.n * (p.idx + 1)) FROM pooled p WHERE p.doc_id = d.doc_id), 0.0), 6) AS checksum
FROM documents d LEFT JOIN tot t ON t.doc_id = d.doc_id"""


# ------------------------------------------------------------------ J10
def _known(anchor, method):
    def run(spark, sf):
        fx = vector_fixture(spark, sf)
        pairs = testing_pairs(fx.testing)
        known = fx.testing.select(F.col("query").alias("text1"), F.explode("labels").alias("text2"))
        r = mn.mine_negatives(pairs, fx.queries, fx.candidates, anchor=anchor, method=method,
                              positive_threshold=MINE["pt"], beta=MINE["beta"], num_negatives=MINE["n"],
                              seed=MINE["seed"], epoch=MINE["epoch"], known_positives=known)
        return r.negatives.select("row_id", "slot", "target_id", "text", _r("score").alias("score"),
                                  _r("raw").alias("raw"), "is_fill")
    return run


def _known_sql(anchor, method) -> str:
    tp = "tp AS (SELECT query_id AS row_id, query AS text1, labels[1] AS text2, 1.0::DOUBLE AS label FROM v1_testing)"
    kn = "kn AS (SELECT DISTINCT query AS text1, unnest(labels) AS text2 FROM v1_testing)"
    ctes = osql.mining_ctes(anchor, method, MINE["n"], MINE["pt"], MINE["beta"], MINE["seed"], MINE["epoch"],
                            pairs="tp", known="kn")
    return osql.with_v1(tp + ",\n" + kn + "," + ctes + """
SELECT row_id, slot, target_id, text, round(score, 6) AS score, round(raw, 6) AS raw, is_fill FROM mres""")


# ------------------------------------------------------------------ streaming
def _fresh_dir(spark, name):
    import uuid
    return stream_root(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def q_t1_stream_search(spark, sf):
    tf = text_fixture(spark, sf)
    enc = trigram_encoder(TEXT["dim"])
    items = encode_distinct(tf.candidates, "text", enc)
    root = _fresh_dir(spark, "t1")
    msgs = (spark.read.parquet(f"{sf}/conversations.parquet")
            .select((F.col("conv_id") * 100000 + F.col("turn")).alias("msg_id"), "text"))
    msgs.repartition(4, "msg_id").write.mode("overwrite").parquet(f"{root}/source")
    q = search_stream(spark, f"{root}/source", "msg_id long, text string", items, f"{root}/sink",
                      f"{root}/checkpoint", key="msg_id", k=TEXT["k"],
                      encode=lambda b: encode_distinct(b, "text", enc))
    run_to_completion(q)
    hits = spark.read.parquet(f"{root}/sink")
    return hits.select((F.col("msg_id") / 100000).cast("long").alias("conv_id"),
                       (F.col("msg_id") % 100000).alias("turn"), "rank",
                       F.col("corpus_id").alias("item_id"), _r("score").alias("score"))


def q_t2_rolling_quality(spark, sf):
    fx = vector_fixture(spark, sf)
    root = _fresh_dir(spark, "t2")
    src = fx.testing.join(vector_lookup(fx.queries).withColumnRenamed("text", "query"), "query") \
                    .select("query_id", "labels", "embedding")
    src.repartition(4, "query_id").write.mode("overwrite").parquet(f"{root}/source")
    q = quality_stream(spark, f"{root}/source", "query_id long, labels array<string>, embedding array<double>",
                       fx.candidates, f"{root}/sink", f"{root}/checkpoint", key="query_id", k=5)
    run_to_completion(q)
    r = rolling_quality(spark, f"{root}/sink")
    return r.select("tp", "n_pred", "n_gold", _r("precision").alias("precision"),
                    _r("recall").alias("recall"), _r("f1").alias("f1"))


def q_t2_windowed_quality(spark, sf):
    fx = vector_fixture(spark, sf)
    root = _fresh_dir(spark, "t2w")
    # every event is one asked query: number event_id modulo the test set's size
    n = fx.testing.count()
    asked = fx.testing.select(F.col("query_id").alias("q"), "query", "labels")
    asked = with_vectors(asked, "query", fx.queries, "embedding").select("q", "labels", "embedding")
    ev = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("query_id"),
                                                           F.col("ts").cast("timestamp").alias("ts"))
    # events of one query lie next to each other, in as many files as the session has partitions; four batches of files
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ev_q = ev.withColumn("q", F.col("query_id") % n).repartition(parts, "q").sortWithinPartitions("q")
    src = ev_q.join(asked.repartition(parts, "q"), "q").select("query_id", "labels", "embedding", "ts")
    src.write.mode("overwrite").parquet(f"{root}/source")
    q = quality_stream(spark, f"{root}/source",
                       "query_id long, labels array<string>, embedding array<double>, ts timestamp",
                       fx.candidates, f"{root}/counts", f"{root}/checkpoint1", key="query_id", k=5, ts_col="ts",
                       max_files_per_trigger=-(-parts // 4))
    run_to_completion(q)
    # the files hold events of any time in any order: a watermark as long as the table's span drops none
    at = F.unix_timestamp("ts")
    span = ev.agg((F.max(at) - F.min(at)).alias("s")).first()["s"] or 0
    q2 = windowed_quality_stream(spark, f"{root}/counts",
                                 "query_id long, tp long, n_pred long, n_gold long, ts timestamp",
                                 f"{root}/windows", f"{root}/checkpoint2", window="1 day", watermark=f"{span + 1} seconds",
                                 max_files_per_trigger=parts)
    run_to_completion(q2)
    w = windowed_quality(spark, f"{root}/windows")
    return w.select(F.unix_timestamp("window_start").alias("window_start"), "tp", "n_pred", "n_gold",
                    _r("precision").alias("precision"), _r("recall").alias("recall"), _r("f1").alias("f1"))


def _t2w_sql() -> str:
    return osql.with_v1(osql.topk_hits_cte().lstrip() + """,
pred AS (SELECT DISTINCT query_id, text FROM v1_hits),
gold AS (SELECT DISTINCT query_id, unnest(labels) AS text FROM v1_testing),
j AS (SELECT COALESCE(p.query_id, g.query_id) AS query_id,
             CASE WHEN p.text IS NOT NULL AND g.text IS NOT NULL THEN 1 ELSE 0 END AS tp,
             CASE WHEN p.text IS NOT NULL THEN 1 ELSE 0 END AS np, CASE WHEN g.text IS NOT NULL THEN 1 ELSE 0 END AS ng
      FROM pred p FULL OUTER JOIN gold g ON p.query_id = g.query_id AND p.text = g.text),
pq AS (SELECT query_id, SUM(tp) AS tp, SUM(np) AS n_pred, SUM(ng) AS n_gold FROM j GROUP BY query_id),
tq AS (SELECT pq.*, e.ts FROM events e JOIN pq ON pq.query_id = e.event_id % (SELECT COUNT(*) FROM v1_testing)),
w AS (SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, CAST(SUM(tp) AS BIGINT) AS tp,
             CAST(SUM(n_pred) AS BIGINT) AS n_pred, CAST(SUM(n_gold) AS BIGINT) AS n_gold FROM tq GROUP BY 1)
SELECT window_start, tp, n_pred, n_gold, round(CAST(tp AS DOUBLE) / NULLIF(n_pred, 0), 6) AS precision,
       round(CAST(tp AS DOUBLE) / NULLIF(n_gold, 0), 6) AS recall,
       round(2.0 * (CAST(tp AS DOUBLE) / NULLIF(n_pred, 0)) * (CAST(tp AS DOUBLE) / NULLIF(n_gold, 0))
             / NULLIF(CAST(tp AS DOUBLE) / NULLIF(n_pred, 0) + CAST(tp AS DOUBLE) / NULLIF(n_gold, 0), 0), 6) AS f1
FROM w""")


def _t1_sql() -> str:
    return ("WITH msgs AS (SELECT conv_id * 100000 + turn AS msg_id, text FROM conversations),"
            + _tri_sql("msgs", "msg_id", "text", TEXT["dim"], "dv") + "," +
            _tri_sql("benchmark", "item_id", "text", TEXT["dim"], "iv") + f""",
dots AS (SELECT d.msg_id, i.item_id, SUM(d.w * i.w) AS score FROM dv d JOIN iv i ON i.idx = d.idx
         GROUP BY d.msg_id, i.item_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY score DESC, item_id) AS rank FROM dots
       WHERE score > 0.0)
SELECT CAST(msg_id // 100000 AS BIGINT) AS conv_id, CAST(msg_id % 100000 AS BIGINT) AS turn,
       CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM rk WHERE rank <= {TEXT["k"]}""")


# ------------------------------------------------------------------ tables
def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = {
        "s1_candidates": q_s1_candidates,
        "s2_queries": q_s2_queries,
        "s3_training": q_s3_training,
        "s4_validation": q_s4_validation,
        "s5_testing": q_s5_testing,
        "s6_result_log": q_s6_result_log,
        "s7_epoch_table": q_s7_epoch_table,
        "c7_batch_plan": q_c7_batch_plan,
        "s8_corpus_size": q_s8_corpus_size,
        "j1_topk_grid": q_j1_topk_grid,
        "p11_plain_hits": q_p11_plain_hits,
        "p3_truncated_pool": q_p3_truncated_pool,
        "e3_evaluate_text": q_e3_evaluate_text,
        "e1_one_way": _recipe("one_way"),
        "e1_contrastive": _recipe("contrastive"),
        "e1_sentence": _recipe("sentence"),
        "e1_triplet": _recipe("triplet"),
        "e1_contrastive_easy": _recipe("contrastive", False),
        "p12_first_position": q_p12_first_position,
        "j1_topk": q_j1_topk,
        "j2_query_edges": q_j2_query_edges,
        "j3_candidate_edges": q_j3_candidate_edges,
        "j4_pair_cosine": q_j4_pair_cosine,
        "j5_first_row_cosine": q_j5_first_row_cosine,
        "j6_true_positives": q_j6_true_positives,
        "j7_gold_in_dictionary": q_j7_gold_in_dictionary,
        "a3_micro_prf": q_a3_micro_prf,
        "a4_ndcg": q_a4_ndcg,
        "a5_tune_beta": q_a5_tune_beta,
        "a5_tune_beta_first_row": q_a5_tune_beta_first_row,
        "a5_tune_beta_labels": q_a5_tune_beta_labels,
        "a11_correlation": q_a11_correlation,
        "e3_evaluate": q_e3_evaluate,
        "m8_easy_negative": q_m8_easy_negative,
        "i1_bidirectional": _build("bidirectional", mn.MULTI),
        "i2_one_way": _build("one_way", mn.MULTI_EFN),
        "i3_contrastive": _build("contrastive", mn.TOPK),
        "i4_sentence_pairs": _build("sentence", mn.TOPK),
        "i5_triplet": _build("triplet", mn.TOPK),
        "i6_validation": _build("validation", mn.TOPK),
        "w5_batches": q_w5_batches,
        "e1_prepare_epoch": q_e1_prepare_epoch,
        "e2_epochs": q_e2_epochs,
        "e4_compare_samplers": q_e4_compare_samplers,
        "a6_bidirectional_loss": q_a6_bidirectional_loss,
        "a6_batch_loss": q_a6_batch_loss,
        "a6_dot_loss": q_a6_dot_loss,
        "a7_one_way_loss": q_a7_one_way_loss,
        "a8_contrastive_loss": _pair_loss("contrastive", contrastive_loss, LOSS["contrastive_margin"]),
        "a9_cosine_mse_loss": _pair_loss("contrastive", cosine_mse_loss),
        "a10_triplet_loss": _pair_loss("triplet", triplet_loss, LOSS["triplet_margin"]),
        "p1_text_encode": q_p1_text_encode,
        "p1_text_topk": q_p1_text_topk,
        "p2_mean_pool": q_p2_mean_pool,
        "t1_stream_search": q_t1_stream_search,
        "j10_known_positive_topk_query": _known("query", mn.TOPK),
        "j10_known_positive_efn_candidate": _known("candidate", mn.TOPK_EFN),
        "t2_rolling_quality": q_t2_rolling_quality,
        "t2_windowed_quality": q_t2_windowed_quality,
    }
    for name, (anchor, method, kw) in MINING.items():
        q[name] = _mine(anchor, method, **kw)[0]
    return q


def oracle_sql() -> dict[str, str]:
    w = osql.with_v1
    r6 = "round({0}, 6) AS {1}"
    s = {
        "s1_candidates": w("""SELECT corpus_id, text, len(embedding) AS dim,
            round(sqrt(list_dot_product(embedding, embedding)), 6) AS norm FROM v1_cand"""),
        "s2_queries": w("""SELECT corpus_id, text, vec_id, len(embedding) AS dim,
            round(sqrt(list_dot_product(embedding, embedding)), 6) AS norm FROM v1_query"""),
        "s3_training": w("SELECT row_id, text1, text2, label FROM v1_training"),
        "s4_validation": w("SELECT row_id, text1, text2, label FROM v1_validation"),
        "s5_testing": w("""SELECT query_id, query, len(labels) AS n_labels,
            array_to_string(list_sort(labels), '|') AS labels FROM v1_testing"""),
        "s8_corpus_size": w("""SELECT (SELECT COUNT(*) FROM v1_cand) AS n_candidates,
            (SELECT COUNT(*) FROM v1_query) AS n_queries"""),
        "p12_first_position": """SELECT MIN(doc_id) AS first_doc_id, COUNT(*) AS n_copies
            FROM documents GROUP BY text""",
        "j1_topk": w(osql.topk_hits_cte().lstrip() + """
            SELECT query_id, rank, corpus_id, text, round(score, 6) AS score FROM v1_hits"""),
        "j2_query_edges": w(f"""e AS (SELECT t.row_id, c.corpus_id AS target_id, c.text,
              {osql.cos_sql('q.embedding', 'c.embedding')} AS raw
            FROM v1_training t JOIN v1_query q ON q.text = t.text1 CROSS JOIN v1_cand c WHERE c.text <> t.text2)
            SELECT row_id, target_id, text, round(raw, 6) AS score, round({osql.clamp_sql('raw')}, 6) AS clamped
            FROM e WHERE {osql.clamp_sql('raw')} >= 0.5::DOUBLE"""),
        "j3_candidate_edges": w(f"""e AS (SELECT t.row_id, q.corpus_id AS target_id, q.text,
              {osql.cos_sql('c.embedding', 'q.embedding')} AS raw
            FROM v1_training t JOIN v1_cand c ON c.text = t.text2 CROSS JOIN v1_query q WHERE q.text <> t.text1)
            SELECT row_id, target_id, text, round(raw, 6) AS score, round({osql.clamp_sql('raw')}, 6) AS clamped
            FROM e WHERE {osql.clamp_sql('raw')} >= 0.5::DOUBLE"""),
        "j4_pair_cosine": w(f"""pc AS (SELECT v.row_id, v.text1, v.text2, v.label,
              {osql.cos_sql('q.embedding', 'c.embedding')} AS score
            FROM v1_validation v JOIN v1_query q ON q.text = v.text1 JOIN v1_cand c ON c.text = v.text2)
            SELECT row_id, text1, text2, label, round(score, 6) AS score FROM pc"""),
        "j5_first_row_cosine": w(f"""fr AS (SELECT q.embedding AS fv FROM v1_validation v JOIN v1_query q ON q.text = v.text1
              WHERE v.row_id = (SELECT MIN(row_id) FROM v1_validation)),
            pc AS (SELECT v.row_id, v.text1, v.text2, v.label, {osql.cos_sql('fr.fv', 'c.embedding')} AS score
              FROM v1_validation v JOIN v1_cand c ON c.text = v.text2 CROSS JOIN fr)
            SELECT row_id, text1, text2, label, round(score, 6) AS score FROM pc"""),
        "j6_true_positives": w(osql.topk_hits_cte().lstrip() + """,
            tp AS (SELECT h.query_id, COUNT(*) AS tp FROM (SELECT DISTINCT query_id, text FROM v1_hits) h
                   JOIN (SELECT DISTINCT query_id, unnest(labels) AS text FROM v1_testing) g
                   ON g.query_id = h.query_id AND g.text = h.text GROUP BY h.query_id)
            SELECT t.query_id, CAST(COALESCE(tp.tp, 0) AS BIGINT) AS tp FROM v1_testing t
            LEFT JOIN tp ON tp.query_id = t.query_id"""),
        "j7_gold_in_dictionary": w("""g AS (SELECT DISTINCT query_id, unnest(labels) AS text FROM v1_testing)
            SELECT query_id, COUNT(*) AS n_gold,
                   CAST(SUM(CASE WHEN text IN (SELECT text FROM v1_cand) THEN 1 ELSE 0 END) AS BIGINT) AS n_known
            FROM g GROUP BY query_id"""),
        "a3_micro_prf": w(osql.topk_hits_cte().lstrip() + "," + osql.prf_cte() + """
            SELECT tp, n_pred, n_gold, round(precision, 6) AS precision, round(recall, 6) AS recall,
                   round(f1, 6) AS f1 FROM v1_prf2"""),
        "a4_ndcg": w(osql.topk_hits_cte().lstrip() + "," + osql.ndcg_ctes(5) + """
            SELECT query_id, round(ndcg, 9) AS ndcg FROM v1_ndcg"""),
        "e3_evaluate": w(osql.topk_hits_cte().lstrip() + "," + osql.ndcg_ctes(5) + "," + osql.prf_cte() + """,
            nd AS (SELECT AVG(ndcg) AS ndcg FROM v1_ndcg)
            SELECT round(nd.ndcg, 9) AS ndcg, round(round(nd.ndcg, 4) * 100.0, 6) AS ndcg_x100,
                   round(p.precision, 6) AS precision, round(p.recall, 6) AS recall, round(p.f1, 6) AS f1,
                   p.tp, p.n_pred, p.n_gold FROM nd, v1_prf2 p"""),
        "m8_easy_negative": sql_m8_easy_negative(),
        "i1_bidirectional": _inst_sql("bidirectional"),
        "i2_one_way": _inst_sql("one_way"),
        "i3_contrastive": _inst_sql("contrastive"),
        "i4_sentence_pairs": _inst_sql("contrastive"),
        "i5_triplet": _inst_sql("triplet"),
        "i6_validation": _inst_sql("validation"),
        "w5_batches": _w5_sql(),
        "e1_prepare_epoch": _e1_sql(),
        "e2_epochs": _e2_sql(),
        "e4_compare_samplers": _e4_sql(),
        "a6_bidirectional_loss": _a6_sql(),
        "a6_batch_loss": _a6_batch_sql(),
        "a6_dot_loss": _a6_sql("list_dot_product(a.vec, c.vec)"),
        "a7_one_way_loss": _a7_sql(),
        "a8_contrastive_loss": _pair_loss_sql("contrastive", "contrastive"),
        "a9_cosine_mse_loss": _pair_loss_sql("contrastive", "mse"),
        "a10_triplet_loss": _pair_loss_sql("triplet", "triplet"),
        "p1_text_encode": _p1_encode_sql(),
        "p1_text_topk": _p1_topk_sql(),
        "p2_mean_pool": _p2_sql(),
        "t1_stream_search": _t1_sql(),
        "j10_known_positive_topk_query": _known_sql("query", mn.TOPK),
        "j10_known_positive_efn_candidate": _known_sql("candidate", mn.TOPK_EFN),
    }
    s["t2_rolling_quality"] = s["a3_micro_prf"]
    s["j1_topk_grid"] = s["j1_topk"]
    s["p11_plain_hits"] = w(osql.topk_hits_cte().lstrip() + "\nSELECT query_id, rank, corpus_id, text FROM v1_hits")
    s["s6_result_log"] = ("WITH one AS (" + s["e3_evaluate"] + """)
        SELECT 'run' AS run_id, 'trigram' AS model, CAST(e AS INTEGER) AS epoch, ndcg, precision, recall, f1
        FROM one, range(2) t(e)""")
    s["s7_epoch_table"] = ("WITH one AS (" + s["e1_prepare_epoch"] + f""")
        SELECT CAST({INST["epoch"]} AS INTEGER) AS epoch, instance_id, batch_id, pos, texts, label FROM one""")
    s["c7_batch_plan"] = ("WITH one AS (" + s["e1_prepare_epoch"] + """), n AS (SELECT max(batch_id) + 1 AS n FROM one)
        SELECT n AS n_batches, CAST(ceil(n * 0.25) AS BIGINT) AS evaluation_steps,
               CAST(ceil(n * 0.1) AS BIGINT) AS warmup_steps FROM n""")
    s["p3_truncated_pool"] = _p2_sql(P3_TOKENS)
    s["e3_evaluate_text"] = _e3_text_sql()
    for recipe in ("one_way", "contrastive", "sentence", "triplet"):
        s[f"e1_{recipe}"] = _recipe_sql(recipe)
    s["e1_contrastive_easy"] = _recipe_sql("contrastive", False)
    s["t2_windowed_quality"] = _t2w_sql()
    pc = f"""pc AS (SELECT v.row_id, v.label AS y, {osql.cos_sql('q.embedding', 'c.embedding')} AS s
              FROM v1_validation v JOIN v1_query q ON q.text = v.text1 JOIN v1_cand c ON c.text = v.text2)"""
    tb_out = """SELECT round(alpha, 6) AS alpha, beta, kept, positives, round(precision, 6) AS precision, reached
                FROM tb_res"""
    s["a5_tune_beta"] = w(pc + "," + osql.tune_beta_sql("pc", ALPHAS) + "\n" + tb_out)
    pcf = f"""fr AS (SELECT q.embedding AS fv FROM v1_validation v JOIN v1_query q ON q.text = v.text1
                  WHERE v.row_id = (SELECT MIN(row_id) FROM v1_validation)),
              pc AS (SELECT v.row_id, v.label AS y, {osql.cos_sql('fr.fv', 'c.embedding')} AS s
                  FROM v1_validation v JOIN v1_cand c ON c.text = v.text2 CROSS JOIN fr)"""
    s["a5_tune_beta_first_row"] = w(pcf + "," + osql.tune_beta_sql("pc", ALPHAS) + "\n" + tb_out)
    pcl = f"""pc AS (SELECT v.label * COALESCE(CAST(l.quality AS DOUBLE), 1.0) AS y,
              {osql.cos_sql('q.embedding', 'c.embedding')} AS s
              FROM v1_validation v JOIN v1_query q ON q.text = v.text1 JOIN v1_cand c ON c.text = v.text2
              LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = q.vec_id)"""
    s["a5_tune_beta_labels"] = w(pcl + "," + osql.tune_beta_sql("pc", ALPHAS) + "\n" + tb_out)
    s["a11_correlation"] = w(pc + """,
        rx AS (SELECT s, (SELECT COUNT(*) FROM pc p2 WHERE p2.s < p1.s) + (COUNT(*) + 1) / 2.0 AS xr
               FROM pc p1 GROUP BY s),
        ry AS (SELECT y, (SELECT COUNT(*) FROM pc p2 WHERE p2.y < p1.y) + (COUNT(*) + 1) / 2.0 AS yr
               FROM pc p1 GROUP BY y)
        SELECT round(corr(pc.s, pc.y), 6) AS pearson, round(corr(rx.xr, ry.yr), 6) AS spearman
        FROM pc JOIN rx ON rx.s = pc.s JOIN ry ON ry.y = pc.y""")
    for name, (anchor, method, kw) in MINING.items():
        s[name] = _mine(anchor, method, **kw)[1]
    _ = r6
    return s
