"""Hard-negative mining.

For every training row (query ``text1``, true candidate ``text2``) pick
``num_negatives`` texts from the other side:

* anchor ``query``: anchor vector = text1, targets = candidate dictionary,
  excluded target text = text2;
* anchor ``candidate``: anchor vector = text2, targets = query dictionary,
  excluded target text = text1.

Pool = targets whose text differs from the excluded one (by text equality,
duplicates included), scores clamped to [0.001, 1]. Eligible = pool entries
with clamped score >= positive_threshold, plus per method ``<= beta`` (E-FN)
and ``>= score_true`` (larger_than_true; score_true = raw cosine of the
row's own pair). Picks:

  topK                         top-n by score, no fill
  topK_with_E-FN               fill, top-n
  larger_than_true(_with_E-FN) fill, top-n
  multinomial(_with_E-FN)      fill, weighted draw of n without replacement
  any other name               uniform draw of min(n, L), no fill

Fill (F1): with L eligible entries and L <= n, add n + 1 - L uniform draws
(with replacement) from the pool (``fill='exact'`` adds n - L). Ties between
an eligible and a fill entry with equal clamped score keep the eligible one
first, as a stable sort over the appended list would.

Execution: one block-kernel pass per direction yields, per row, L, the pool
size and the best n eligible entries under the method's key -- the N x M
scores are never shuffled, even at threshold 0. For fills the targets are
numbered in order of (text, id), so a text is one span of numbers; a draw is
a keyed 62-bit hash of (seed, epoch, stream, row, slot) modulo the pool's
size M - d, moved past the excluded spans it has reached: a uniform draw in
one step, for any ids and any number of copies. Only drawn pairs are scored,
by an equi-join and a cosine expression. Re-ranking touches only rows that
needed a fill.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashrand as hr
from ..functions.vectors import clamp, cosine_rows
from ..session import materialize
from .blocks import KernelSpec, similarity_kernel, target_stats
from .ordering import with_global_index
from .similarity import by_anchor, with_vectors

# The method names of the reference.
TOPK = "topK"
TOPK_EFN = "topK_with_E-FN"
LARGER = "larger_than_true"
LARGER_EFN = "larger_than_true_with_E-FN"
MULTI = "multinomial"
MULTI_EFN = "multinomial_with_E-FN"
METHODS = (TOPK, TOPK_EFN, LARGER, LARGER_EFN, MULTI, MULTI_EFN)

FILLED = {TOPK_EFN, LARGER, LARGER_EFN, MULTI, MULTI_EFN}
CAPPED = {TOPK_EFN, LARGER_EFN, MULTI_EFN}
ABOVE_TRUE = {LARGER, LARGER_EFN}
WEIGHTED = {MULTI, MULTI_EFN}
RANKED = {TOPK, TOPK_EFN, LARGER, LARGER_EFN}

NEG_SCHEMA_COLS = ["row_id", "slot", "target_id", "text", "score", "raw", "is_fill"]


@dataclass
class MiningResult:
    negatives: DataFrame   # row_id, slot, target_id, text, score, raw, is_fill
    short: DataFrame       # row_id, reason, n_found


@dataclass(frozen=True)
class Draw:
    """What one kernel pass is asked for, once or several times: method, bounds and the epoch's random stream."""
    method: str = TOPK
    positive_threshold: float = 0.5
    beta: float = 1.0
    epoch: int = 0


def fill_draws(n_eligible, n: int, fill: str = "faithful"):
    """number of random fills for a row with ``n_eligible`` entries:
    faithful max(0, n + 1 - L) (draws while the list has <= n entries),
    exact max(0, n - L)."""
    extra = (F.lit(n + 1) if fill == "faithful" else F.lit(n)) - n_eligible
    return F.when(extra > 0, extra).otherwise(F.lit(0)).cast("int")


def materialize_dictionary(d: DataFrame) -> DataFrame:
    """A dictionary is read many times (stats, packing, lookups, fills): cut
    its lineage once."""
    if getattr(d, "_pairlab_materialized", False):
        return d
    return materialize(d.select("corpus_id", "text", "embedding"))


def _sides(anchor: str, query_vectors: DataFrame, candidate_vectors: DataFrame):
    if anchor == "query":
        return "text1", "text2", query_vectors, candidate_vectors
    if anchor == "candidate":
        return "text2", "text1", candidate_vectors, query_vectors
    raise ValueError(f"unknown anchor {anchor!r}: expected 'query' or 'candidate'")


def numbered_targets(targets: DataFrame) -> DataFrame:
    """``target_id, text, place``: dense numbers 0 .. M-1 in order of (text, id)."""
    t = targets.select(F.col("corpus_id").alias("target_id"), "text")
    return with_global_index(t, ["text", "target_id"], out="place")


def draw_from_pool(rows: DataFrame, numbered: DataFrame, count: int, seed: int, epoch: int | str, stream: int,
                   by: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Uniform draws with replacement from the targets whose text is not excluded.

    ``rows``: the key columns ``by`` (``row_id`` among them, and ``epoch`` if that is a column's name), ``f`` (number of
    draws) and ``out array<string>``, the excluded texts. Rows with an empty pool get none. Returns the key columns,
    ``slot, target_id, text``."""
    spans = numbered.groupBy("text").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    asked = rows.select(*by, F.explode(F.array_distinct("out")).alias("text"))
    held = asked.join(spans, "text").groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"))
    none = F.array().cast("array<struct<start: bigint, n: bigint>>")
    known = rows.select(*by, "f").join(held, list(by), "left").withColumn("spans", F.coalesce("spans", none))
    left = F.lit(int(count)).cast("long") - F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    slots = known.withColumn("_left", left).filter("_left > 0 and f > 0").select(
        *by, "spans", "_left", F.explode(F.sequence(F.lit(1), F.col("f"))).alias("slot"))
    at = hr.wide_expr(seed, epoch, stream, "row_id", "slot") % F.col("_left")
    place = F.aggregate("spans", at, lambda p, s: F.when(s["start"] <= p, p + s["n"]).otherwise(p))
    return slots.select(*by, "slot", place.alias("place")).join(numbered, "place") \
                .select(*by, "slot", "target_id", "text")


def mine_negatives(pairs: DataFrame, query_vectors: DataFrame, candidate_vectors: DataFrame, *,
                   anchor: str = "query", method: str = TOPK, **opts) -> MiningResult:
    """M1-M7 for every row of ``pairs`` (``row_id, text1, text2``); options as in ``mine_draws``."""
    return mine_methods(pairs, query_vectors, candidate_vectors, [method], anchor=anchor, **opts)[method]


def _spec(draw: Draw, n: int, stream: int) -> KernelSpec:
    method = draw.method
    mode = "weighted" if method in WEIGHTED else "rank" if method in RANKED else "uniform"
    return KernelSpec(mode=mode, n=n, clamp=True, min_score=float(draw.positive_threshold),
                      max_score=float(draw.beta) if method in CAPPED else float("inf"),
                      use_row_lo=method in ABOVE_TRUE, hash=stream)


def mine_methods(pairs: DataFrame, query_vectors: DataFrame, candidate_vectors: DataFrame, methods: list[str], *,
                 positive_threshold: float = 0.5, beta: float = 1.0, epoch: int = 0, **opts) -> dict[str, MiningResult]:
    """Several methods over the same rows with one kernel pass; options as in ``mine_draws``."""
    draws = [Draw(m, positive_threshold, beta, epoch) for m in methods]
    return dict(zip(methods, mine_draws(pairs, query_vectors, candidate_vectors, draws, **opts)))


def mine_draws(pairs: DataFrame, query_vectors: DataFrame, candidate_vectors: DataFrame, draws: list[Draw], *,
               anchor: str = "query", num_negatives: int = 1, seed: int = 0, fill: str = "faithful",
               known_positives: DataFrame | None = None, encoder=None, **kernel_opts) -> list[MiningResult]:
    """Several draws (methods, bounds, epochs) over the same rows with one kernel pass: every pair of an anchor
    and a target is scored once, and each draw has a random stream, a threshold and a cap of its own.

    J10 (option, off by default): ``known_positives`` (``text1, text2``, e.g.
    all gold pairs) removes from the pool, besides the row's own text, every
    target known to be positive for the row's anchor text. ``encoder`` (column -> array<double>) encodes
    anchors that the dictionary lacks; without one their rows come back in ``short``."""
    if fill not in ("faithful", "exact"):
        raise ValueError("fill must be 'faithful' or 'exact'")
    query_vectors = materialize_dictionary(query_vectors)
    candidate_vectors = materialize_dictionary(candidate_vectors)
    a_col, x_col, a_vecs, targets = _sides(anchor, query_vectors, candidate_vectors)
    n = int(num_negatives)
    code = hr.ANCHOR_CODE[anchor]
    t_stats = target_stats(targets)
    above = any(d.method in ABOVE_TRUE for d in draws)
    epochs = sorted({d.epoch for d in draws})

    base = pairs.select("row_id", "text1", "text2")
    rows = with_vectors(base, a_col, a_vecs, "vec", encoder)
    if above:
        other = query_vectors if x_col == "text1" else candidate_vectors
        rows = with_vectors(rows, x_col, other, "_ov", encoder)
        rows = rows.withColumn("lo", cosine_rows(F.col("vec"), F.col("_ov"))).drop("_ov")
    if known_positives is not None:
        kp = known_positives.select("text1", "text2").distinct()
        excl = kp.groupBy(a_col).agg(F.collect_set(x_col).alias("xs"))
        rows = rows.join(excl, a_col, "left")
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    every = materialize(by_anchor(rows, a_col, "row_id", parts))
    rows = every.filter(F.col("vec").isNotNull())

    left = rows.select(
        F.col("row_id").alias("key"), "anchor", "vec", F.xxhash64(x_col).alias("xh"),
        F.col(x_col).alias("xt"),
        (F.col("lo") if above else F.lit(None).cast("double")).alias("lo"),
        (F.col("xs") if known_positives is not None else F.lit(None).cast("array<string>")).alias("xs"),
        F.array(*[hr.wide_expr(seed, e, code + hr.STREAM_PICK, "row_id") for e in epochs]).alias("rh"))
    res = similarity_kernel(left, targets, [_spec(d, n, epochs.index(d.epoch)) for d in draws],
                            stats=t_stats, left_spread=True, **kernel_opts)
    res = materialize(res.select(F.col("key").alias("row_id"), "spec", "n_eligible", "n_pool", "ids", "texts", "raw",
                                 "val"))
    own = F.array(F.col(x_col))
    out = F.concat(own, F.coalesce("xs", F.array().cast("array<string>"))) if known_positives is not None else own
    texts = rows.select("row_id", out.alias("out"))
    numbered = numbered_targets(targets) if any(d.method in FILLED for d in draws) else None
    done: list[MiningResult | None] = [None] * len(draws)
    for method in dict.fromkeys(d.method for d in draws):
        # no vector for the anchor or, where the bound is the true pair's score, for the true text
        lost = F.col("lo").isNull() if method in ABOVE_TRUE else F.col("vec").isNull()
        missing = every.filter(lost).select(
            "row_id", F.lit("no_vector").alias("reason"), F.lit(0).cast("long").alias("n_found"))
        mine = [i for i, d in enumerate(draws) if d.method == method]
        own_res = res.filter(F.col("spec").isin(mine)).withColumn(
            "epoch", F.get(F.array(*[F.lit(d.epoch) for d in draws]), F.col("spec")))
        if method in ABOVE_TRUE:
            own_res = own_res.join(missing.select("row_id"), "row_id", "left_anti")

        def draw(need: DataFrame) -> DataFrame:
            need = need.join(texts, "row_id").select(*_BY, "out", "f")
            return materialize(draw_from_pool(need, numbered, t_stats.count, seed, "epoch", code + hr.STREAM_FILL, _BY))
        keys = hr.uniform_expr(seed, "epoch", code + hr.STREAM_FILL_KEY, "row_id", "slot")
        # all draws of a method are filled and ordered together
        negatives, short = _pick(method, own_res, rows, targets, n, fill, draw, keys)
        if len(mine) > 1:
            negatives, short = materialize(negatives), materialize(short)
        for i in mine:
            done[i] = MiningResult(
                negatives.filter(F.col("spec") == i).select(*NEG_SCHEMA_COLS),
                missing.unionByName(short.filter(F.col("spec") == i).select(*missing.columns)))
    return done


_BY = ("spec", "epoch", "row_id")


def _entries(df: DataFrame) -> DataFrame:
    e = df.select(*_BY, F.posexplode(F.arrays_zip("ids", "texts", "raw", "val")).alias("pos", "e"))
    return e.select(*_BY, "pos", F.col("e.ids").alias("target_id"), F.col("e.texts").alias("text"),
                    F.col("e.raw").alias("raw"), F.col("e.val").alias("val"), F.lit(False).alias("is_fill"))


def _pick(method: str, res: DataFrame, rows: DataFrame, targets: DataFrame, n: int, fill: str,
          draw, keys: Column) -> tuple[DataFrame, DataFrame]:
    """Negatives and short rows of a method's draws (column ``spec``) from its kernel result: fills, order, the
    first n."""
    filled = method in FILLED
    cols = ["spec", *NEG_SCHEMA_COLS]
    res = res.withColumn("f", fill_draws(F.col("n_eligible"), n, fill) if filled else F.lit(0))
    negatives = _entries(res.filter(F.col("f") == 0)).filter(F.col("pos") < n).select(
        "spec", "row_id", (F.col("pos") + 1).alias("slot"), "target_id", "text",
        clamp(F.col("raw")).alias("score"), "raw", "is_fill")
    if not filled:
        # unfilled methods return min(L, n) entries
        few = res.filter(F.col("n_eligible") < n).select(
            "spec", "row_id", F.lit("too_few").alias("reason"), F.col("n_eligible").alias("n_found"))
        return negatives.select(*cols), few

    fill_rows = res.filter((F.col("f") > 0) & (F.col("n_pool") > 0))
    draws = draw(fill_rows.select(*_BY, "f"))
    tv = targets.select(F.col("corpus_id").alias("target_id"), "text", F.col("embedding").alias("_tv"))
    scored = (draws.join(tv, ["target_id", "text"]).join(rows.select("row_id", "vec"), "row_id")
              .withColumn("raw", cosine_rows(F.col("vec"), F.col("_tv"))).drop("_tv", "vec"))
    weighted = method in WEIGHTED
    fval = F.log(keys) / clamp(F.col("raw")) if weighted else F.lit(None).cast("double")
    elig = _entries(fill_rows)
    # a fill that repeats an eligible target carries that entry's kernel score, so
    # equal entries tie exactly (the reference appends copies of pool entries)
    same = elig.select(*_BY, "target_id", "text", F.col("raw").alias("_kraw"))
    scored = (scored.join(same, [*_BY, "target_id", "text"], "left")
              .withColumn("raw", F.coalesce("_kraw", "raw")).drop("_kraw"))
    fills = scored.select(*_BY, F.col("slot").alias("pos"), "target_id", "text", "raw",
                          fval.alias("val"), F.lit(True).alias("is_fill"))
    cand = elig.unionByName(fills).withColumn("score", clamp(F.col("raw")))
    if weighted:
        order = [F.desc("val"), F.asc("is_fill"), F.asc("pos"), F.asc("target_id")]
    else:
        # stable top-n over [eligible..., fills...] by clamped score
        order = [F.desc("score"), F.asc("is_fill"),
                 F.desc(F.when(~F.col("is_fill"), F.col("raw"))), F.asc("pos"), F.asc("target_id")]
    w = Window.partitionBy("spec", "row_id").orderBy(*order)
    picked = cand.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= n).select(*cols)
    # filled methods always reach n unless the pool is empty
    empty_pool = res.filter((F.col("f") > 0) & (F.col("n_pool") == 0)).select(
        "spec", "row_id", F.lit("empty_pool").alias("reason"), F.col("n_eligible").alias("n_found"))
    return negatives.select(*cols).unionByName(picked), empty_pool


def easy_negatives(pairs: DataFrame, candidates: DataFrame, seed: int = 0, epoch: int = 0,
                   stream: int = hr.STREAM_EASY) -> DataFrame:
    """One uniform candidate per row from the whole dictionary, different from the row's ``text2``.
    Rows without another candidate get none. Returns ``row_id, target_id, text``."""
    rows = pairs.select("row_id", F.array("text2").alias("out"), F.lit(1).alias("f"))
    numbered = numbered_targets(candidates)
    return draw_from_pool(rows, numbered, numbered.count(), seed, epoch, stream).select("row_id", "target_id", "text")


def negatives_as_arrays(neg: DataFrame) -> DataFrame:
    """long negatives -> ``row_id, negatives array<string>`` in slot order."""
    return neg.groupBy("row_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("slot", "text"))), lambda s: s["text"]).alias("negatives"))
