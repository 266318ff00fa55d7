"""The epoch data job, the schedule of epochs, and the sampler comparison report.

``prepare_epoch`` is the data half of one training epoch: score the
validation pairs, calibrate beta, mine hard negatives in both directions,
assemble the instances, batch them and (optionally) write them as Parquet
partitioned by epoch -- the hand-off point to an external trainer (S7).
The only value that travels to the driver is the tuned beta (one row).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calibrate import EpochConfig, tune_beta
from ..operators.encode import encode_distinct
from ..operators.instances import assign_batches, build_instances
from ..operators.mining import METHODS, Draw, materialize_dictionary, mine_draws, mine_methods
from ..operators.similarity import first_row_cosine, pair_cosine
from ..session import materialize
from ..sources.readers import read_dictionary, read_pairs


@dataclass
class EpochData:
    config: EpochConfig
    tuned_beta: float
    beta: float
    calibration: DataFrame   # alpha, beta, kept, positives, precision, reached
    instances: DataFrame     # instance_id, row_id, texts, label, batch_id, pos
    dropped: DataFrame       # row_id, reason
    validation: DataFrame    # I6 instances


def prepare_epoch(training: DataFrame, validation: DataFrame, query_vectors: DataFrame,
                  candidate_vectors: DataFrame, cfg: EpochConfig, *, compat_first_row: bool = False,
                  on_short: str = "drop", output_path: str | None = None, encoder=None, **kernel_opts) -> EpochData:
    """E1 for any recipe. ``encoder`` (column -> array<double>) encodes texts that the dictionaries lack; without
    one a validation pair with an unknown text is an error, and a training row with one is reported as short."""
    query_vectors = materialize_dictionary(query_vectors)
    candidate_vectors = materialize_dictionary(candidate_vectors)
    training = materialize(training)
    calib = tune_beta(_scored(validation, query_vectors, candidate_vectors, compat_first_row, encoder), cfg.alpha)
    tuned = float(calib.select("beta").first()["beta"])
    beta = cfg.effective_beta(tuned)
    res = build_instances(cfg.recipe, training, query_vectors, candidate_vectors,
                          method=cfg.sampling_method,
                          num_hard_negative_queries=cfg.num_hard_negative_queries,
                          num_hard_negative_candidates=cfg.num_hard_negative_candidates,
                          positive_threshold=cfg.positive_threshold, beta=beta, seed=cfg.seed,
                          epoch=cfg.epoch, use_hard_negative=cfg.use_hard_negative, on_short=on_short,
                          encoder=encoder, **kernel_opts)
    # numbered twice (order, counts) and written: assemble the instances once
    batched = assign_batches(materialize(res.instances), cfg.train_batch_size, cfg.seed, cfg.epoch)
    val_inst = build_instances("validation", validation, query_vectors, candidate_vectors).instances
    data = EpochData(cfg, tuned, beta, calib, batched, res.dropped, val_inst)
    if output_path:
        write_epoch(data, output_path)
    return data


def _scored(validation: DataFrame, query_vectors: DataFrame, candidate_vectors: DataFrame, compat_first_row: bool,
            encoder) -> DataFrame:
    cosine = first_row_cosine if compat_first_row else pair_cosine
    scored = materialize(cosine(validation, query_vectors, candidate_vectors, encoder=encoder))
    lost = scored.filter(F.col("score").isNull()).count()
    if lost:
        raise ValueError(f"{lost} validation pairs have a text without a vector; pass an encoder")
    return scored


def prepare_epochs(training: DataFrame, validation: DataFrame, query_vectors: DataFrame,
                   candidate_vectors: DataFrame, configs: list[EpochConfig], *, compat_first_row: bool = False,
                   on_short: str = "drop", output_path: str | None = None, encoder=None,
                   **kernel_opts) -> list[EpochData]:
    """The bidirectional recipe for a whole schedule of epochs, the same as ``prepare_epoch`` for each. The
    validation pairs are scored and bucketed once, and each direction is mined with one kernel pass: every epoch
    has a random stream, a threshold and a cap of its own on scores that all share. (The vectors of one schedule
    are the same; a trainer that encodes anew after an epoch prepares epoch by epoch.)"""
    first = configs[0]
    same = ("recipe", "seed", "num_hard_negative_queries", "num_hard_negative_candidates", "use_hard_negative")
    if first.recipe != "bidirectional" or any(getattr(c, k) != getattr(first, k) for c in configs for k in same):
        raise ValueError("a schedule is bidirectional, and its epochs differ neither in seed nor in numbers of negatives")
    query_vectors = materialize_dictionary(query_vectors)
    candidate_vectors = materialize_dictionary(candidate_vectors)
    training = materialize(training)
    calib = tune_beta(_scored(validation, query_vectors, candidate_vectors, compat_first_row, encoder),
                      [c.alpha for c in configs])
    calib = materialize(calib)
    by_alpha = {r["alpha"]: r["beta"] for r in calib.select("alpha", "beta").collect()}  # a row for each epoch
    tuned = [float(by_alpha[c.alpha]) for c in configs]
    draws = [Draw(c.sampling_method, c.positive_threshold, c.effective_beta(t), c.epoch) for c, t in zip(configs, tuned)]

    def mine(anchor: str, n: int):
        return mine_draws(training, query_vectors, candidate_vectors, draws, anchor=anchor, num_negatives=n,
                          seed=first.seed, encoder=encoder, **kernel_opts)
    val_inst = build_instances("validation", validation, query_vectors, candidate_vectors).instances

    def assemble(cfg: EpochConfig, tuned_beta: float, beta: float, mined) -> EpochData:
        res = build_instances(cfg.recipe, training, query_vectors, candidate_vectors, mined=mined, on_short=on_short)
        batched = assign_batches(materialize(res.instances), cfg.train_batch_size, cfg.seed, cfg.epoch)
        data = EpochData(cfg, tuned_beta, beta, calib.filter(F.col("alpha") == F.lit(cfg.alpha)), batched, res.dropped,
                         val_inst)
        if output_path:
            write_epoch(data, output_path)
        return data
    with ThreadPoolExecutor(max_workers=4) as pool:  # independent small jobs of one session
        hq = pool.submit(mine, "candidate", first.num_hard_negative_queries)
        hc = pool.submit(mine, "query", first.num_hard_negative_candidates)
        mined = list(zip(hq.result(), hc.result()))
        return list(pool.map(assemble, configs, tuned, [d.beta for d in draws], mined))


def prepare_epoch_from_files(spark, training: str, validation: str, candidates: str, queries: str, encoder,
                             cfg: EpochConfig, fmt: str = "tsv", dictionary_fmt: str = "text", **opts) -> EpochData:
    """E1 as one job from user files: read both dictionaries and the labelled pairs, encode the entries, then
    ``prepare_epoch``."""
    dictionaries = [encode_distinct(read_dictionary(spark, path, dictionary_fmt), "text", encoder)
                    for path in (queries, candidates)]
    return prepare_epoch(read_pairs(spark, training, fmt), read_pairs(spark, validation, fmt), *dictionaries, cfg,
                         encoder=encoder, **opts)


def write_epoch(data: EpochData, path: str) -> None:
    """Instances sorted by batch, a partition for each epoch. Writing an epoch again replaces it; other
    epochs stay."""
    (data.instances.withColumn("epoch", F.lit(data.config.epoch))
     .repartitionByRange("batch_id").sortWithinPartitions("batch_id", "pos")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch")
     .parquet(f"{path}/instances"))


def compare_samplers(pairs: DataFrame, query_vectors: DataFrame, candidate_vectors: DataFrame, *,
                     positive_threshold: float = 0.5, beta: float = 0.9, num_negatives: int = 3,
                     seed: int = 0, epoch: int = 0, **kernel_opts) -> DataFrame:
    """Every method x both anchors over all rows of ``pairs``, with one kernel pass per anchor.
    Returns ``method, anchor, row_id, slot, text, score, is_fill``."""
    query_vectors = materialize_dictionary(query_vectors)
    candidate_vectors = materialize_dictionary(candidate_vectors)
    pairs = materialize(pairs)
    out = None
    for anchor in ("query", "candidate"):
        found = mine_methods(pairs, query_vectors, candidate_vectors, list(METHODS), anchor=anchor,
                             positive_threshold=positive_threshold, beta=beta,
                             num_negatives=num_negatives, seed=seed, epoch=epoch, **kernel_opts)
        for method, r in found.items():
            part = r.negatives.select(F.lit(method).alias("method"), F.lit(anchor).alias("anchor"),
                                      "row_id", "slot", "text", "score", "is_fill")
            out = part if out is None else out.unionByName(part)
    return out


def testing_pairs(testing: DataFrame) -> DataFrame:
    """Test set -> mining pairs with the first label as the true candidate."""
    return testing.select(F.col("query_id").alias("row_id"), F.col("query").alias("text1"),
                          F.element_at("labels", 1).alias("text2"), F.lit(1.0).alias("label"))
