"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, so that added columns never clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back: cuts the lineage,
    survives lost executors, and its columns are pruned on each later read. All tables of an application lie in
    one folder named by its id, which can go when the application has ended."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/pairlab-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    # no later plan reuses the shuffles of a write: their files go when it ends, not with the JVM's next collection
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)
    for paths in _scopes[-1:]:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(table: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    _delete(table.sparkSession, table._written_at)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_scopes: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` made inside go at the end, so that a job of several steps holds the tables of one step only.
    The step's result must have been written by then with ``keep``."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)
        spark._jvm.System.gc()  # Spark deletes the shuffle files of plans that nothing refers to any more


def keep(df: DataFrame) -> DataFrame:
    """``written``, to outlast the step that it ends: it belongs to the step around that, if there is one."""
    out = written(df)
    for paths in _scopes[-1:]:
        paths.remove(out._written_at)
    for paths in _scopes[-2:-1]:
        paths.append(out._written_at)
    return out


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; has {df.columns}")
