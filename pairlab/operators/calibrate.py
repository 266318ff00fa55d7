"""Threshold calibration (A5, W4) and the epoch schedule.

``tune_beta``: the score cut-off ``beta`` is the first value of the ladder
0.5, 0.5+0.015, ... (accumulated in double precision) at which the
validation rows with ``sim >= beta`` are non-empty and have a positive share
``>= alpha``. If no step reaches alpha, beta is the first step that leaves
no row, plus one more step; empty input gives 0.5. Precision is not monotone
in beta, so the *first* step is taken, never a bisection.

Plan: every row is bucketed to the last ladder step it survives with one
array expression (no join), ``groupBy(bucket)`` reduces the data to at most
~40 rows, and a suffix-sum window over those rows scans the ladder. The only
data-sized work is one partial aggregation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Fixed values of the schedule.
BETA_START = 0.5
BETA_STEP = 0.015
ALPHA_BASE = 0.8
ALPHA_STEP = 0.015
LADDER_CEILING = 1.0 + 1e-9      # cosines cannot exceed this by rounding
EVAL_FRACTION = 0.25
WARMUP_FRACTION = 0.1


def beta_ladder(start: float = BETA_START, step: float = BETA_STEP,
                ceiling: float = LADDER_CEILING) -> list[float]:
    """Accumulated ladder, up to and including the first value above ``ceiling``
    plus one more (the value reported when the last non-empty step fails)."""
    vals, b = [], start
    while True:
        vals.append(b)
        if b > ceiling:
            break
        b = b + step
    vals.append(vals[-1] + step)
    return vals


def tune_beta(scored: DataFrame, alpha, sim: str = "score", label: str = "label",
              start: float = BETA_START, step: float = BETA_STEP) -> DataFrame:
    """A5: one row ``alpha, beta, kept, positives, precision, reached`` per
    alpha (``alpha`` may be a float or a list of floats). The data is reduced
    once; every alpha scans the same bucket counts. The ladder goes past the
    largest score (cosines need about 40 steps; scores above 1 more).

    Rows without a score are left out; ``prepare_epoch`` refuses them."""
    alphas = [float(alpha)] if isinstance(alpha, (int, float)) else [float(a) for a in alpha]
    counts, ladder = _ladder_counts(scored, sim, label, start, step, LADDER_CEILING)
    top = counts.agg(F.max("most")).first()[0]
    if top is not None and top > LADDER_CEILING:
        counts, ladder = _ladder_counts(scored, sim, label, start, step, top)
    return _scan_ladder(counts, ladder, alphas, start)


def _ladder_counts(scored: DataFrame, sim: str, label: str, start: float, step: float, ceiling: float):
    """(rows ``i, cnt, pos, most`` by the last ladder step a score survives, ladder up to ``ceiling``)."""
    ladder = beta_ladder(start, step, ceiling)
    # literal arrays as one SQL expression (one call; repr() round-trips doubles exactly)
    lad = F.expr("array(" + ", ".join(f"{float(b)!r}D" for b in ladder) + ")")
    base = scored.select(F.col(sim).cast("double").alias("s"), F.col(label).cast("double").alias("y")) \
                 .filter(F.col("s").isNotNull() & ~F.isnan("s"))
    # bucket = index of the last ladder value <= s (-1: below the first). The
    # arithmetic guess is off by at most one step from the accumulated ladder;
    # two exact comparisons against the ladder literals correct it.
    top = len(ladder) - 1
    g = F.least(F.greatest(F.floor((F.col("s") - F.lit(start)) / F.lit(step)), F.lit(-1)), F.lit(top))
    g = g.cast("int")
    at = lambda j: F.try_element_at(lad, (j + 1).cast("int"))  # noqa: E731  (0-based ladder index)
    g = F.when((g < top) & (at(g + 1) <= F.col("s")), g + 1).otherwise(g)
    g = F.when((g >= 0) & (at(F.greatest(g, F.lit(0))) > F.col("s")), g - 1).otherwise(g)
    bucket = g
    counts = base.groupBy(bucket.alias("i")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(F.when(F.col("y") == 1.0, 1).otherwise(0)).alias("pos"),
        F.max("s").alias("most"))
    return materialize(counts), ladder


def _scan_ladder(counts: DataFrame, ladder: list[float], alphas: list[float], start: float) -> DataFrame:
    spark = counts.sparkSession
    lad = F.expr("array(" + ", ".join(f"{float(b)!r}D" for b in ladder) + ")")
    # the (alpha, step) grid is generated JVM-side: range over steps x posexplode(alphas)
    steps = spark.range(-1, len(ladder)).select(
        F.col("id").cast("int").alias("i"),
        F.when(F.col("id") >= 0, F.element_at(lad, (F.col("id") + 1).cast("int"))).alias("b"),
        F.posexplode(F.expr("array(" + ", ".join(f"{a!r}D" for a in alphas) + ")")).alias("ai", "alpha"))
    # kept_i = rows with bucket >= i: suffix sums over the <= len(ladder) steps
    w = Window.partitionBy("ai").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    scan = (steps.join(counts, "i", "left")
            .select("ai", "alpha", "i", "b", F.coalesce("cnt", F.lit(0)).alias("cnt"),
                    F.coalesce("pos", F.lit(0)).alias("pos"))
            .withColumn("kept", F.sum("cnt").over(w).cast("long"))
            .withColumn("positives", F.sum("pos").over(w).cast("long"))
            .withColumn("b_next", F.lead("b").over(Window.partitionBy("ai").orderBy("i"))))
    ok = (F.col("i") >= 0) & (F.col("kept") > 0) & \
        (F.col("positives").cast("double") / F.col("kept").cast("double") >= F.col("alpha"))
    empty = (F.col("i") >= 0) & (F.col("kept") == 0)
    res = scan.groupBy("ai", "alpha").agg(
        F.sum("cnt").alias("n"),
        F.min(F.when(ok, F.struct("i", "b", "kept", "positives"))).alias("hit"),
        F.min(F.when(empty, F.struct("i", "b_next"))).alias("miss"))
    beta = (F.when(F.col("n") == 0, F.lit(float(start)))
            .when(F.col("hit").isNotNull(), F.col("hit.b"))
            .otherwise(F.col("miss.b_next")))
    kept = F.when(F.col("hit").isNotNull(), F.col("hit.kept")).otherwise(F.lit(0).cast("long"))
    posv = F.when(F.col("hit").isNotNull(), F.col("hit.positives")).otherwise(F.lit(0).cast("long"))
    return res.select("ai", "alpha", beta.alias("beta"), kept.alias("kept"), posv.alias("positives"),
                      F.try_divide(posv.cast("double"), kept.cast("double")).alias("precision"),
                      F.col("hit").isNotNull().alias("reached")).drop("ai")


# Defaults of the five recipes: sampling method, hard queries, hard candidates.
RECIPES = {
    "bidirectional": ("multinomial", 10, 3),
    "one_way": ("multinomial_with_E-FN", 0, 3),
    "contrastive": ("topK", 0, 1),
    "sentence": ("topK", 0, 1),
    "triplet": ("topK", 0, 1),
}
BATCH_HARD, BATCH_EASY = 32, 64


@dataclass(frozen=True)
class EpochConfig:
    """Hyper-parameters of one epoch of a recipe (a key of ``RECIPES``)."""
    epoch: int = 0
    num_hard_negative_queries: int = 10
    num_hard_negative_candidates: int = 3
    train_batch_size: int = 32
    max_seq_length: int = 32
    sampling_method: str = "multinomial"
    seed: int = 0
    recipe: str = "bidirectional"
    use_hard_negative: bool = True
    extra: dict = field(default_factory=dict)

    @property
    def alpha(self) -> float:
        """0.8 + 0.015 * epoch in double precision (epoch 1 -> 0.8150000000000001)."""
        return ALPHA_BASE + ALPHA_STEP * self.epoch

    @property
    def positive_threshold(self) -> float:
        return 0.0 if self.epoch == 0 else 0.5

    def effective_beta(self, tuned: float) -> float:
        """Epoch 0 mines with beta = 1 whatever was tuned (the log keeps the tuned value); so do easy negatives."""
        return tuned if self.epoch > 0 and self.use_hard_negative else 1.0

    @classmethod
    def for_epoch(cls, epoch: int, **kw) -> "EpochConfig":
        """The bidirectional recipe's defaults."""
        return cls(epoch=epoch, **kw)

    @classmethod
    def for_recipe(cls, recipe: str, epoch: int, use_hard_negative: bool = True, **kw) -> "EpochConfig":
        """A recipe's defaults; without hard negatives the batch is 64 and the one-way recipe has none at all."""
        method, queries, candidates = RECIPES[recipe]
        if recipe == "one_way" and not use_hard_negative:
            candidates = 0
        defaults = dict(recipe=recipe, use_hard_negative=use_hard_negative, sampling_method=method,
                        num_hard_negative_queries=queries, num_hard_negative_candidates=candidates,
                        train_batch_size=BATCH_HARD if use_hard_negative else BATCH_EASY)
        return cls(epoch=epoch, **(defaults | kw))

    @staticmethod
    def batch_plan(n_batches: int) -> dict:
        """Trainer metadata -- evaluate every ceil(25 %) of the batches,
        warm up over ceil(10 %) of them."""
        return {"evaluation_steps": math.ceil(n_batches * EVAL_FRACTION),
                "warmup_steps": math.ceil(n_batches * WARMUP_FRACTION)}

    @staticmethod
    def batch_plan_columns(n_batches: Column) -> list[Column]:
        """``batch_plan`` of a column of batch counts."""
        return [F.ceil(n_batches * F.lit(part)).cast("long").alias(name)
                for name, part in (("evaluation_steps", EVAL_FRACTION), ("warmup_steps", WARMUP_FRACTION))]
