"""Session helpers: a sensible local session for tests/bench and the shared
checkpoint folder (read from the session, set only where it is unset)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Arrow batches carry packed vector blocks; bound them by bytes, not rows.
ARROW_MAX_BYTES = str(64 * 1024 * 1024)


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app: str = "pairlab", extra_conf: dict | None = None) -> SparkSession:
    """A local[cores] session configured the way the engine expects."""
    parts = shuffle_partitions or cores
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_MAX_BYTES)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``pairlab`` importable in the Python workers (like ``--py-files``):
    zip the package once per application and ``addPyFile`` it. Pandas UDFs
    and ``mapInPandas`` functions are pickled by reference to this package."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    import pairlab
    root = os.path.dirname(os.path.abspath(pairlab.__file__))
    fd, path = tempfile.mkstemp(prefix="pairlab-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when it is unset in local mode (tests) a fresh scratch folder is
    made; on a cluster that is an error, as executors share no local folder.
    Checkpoints of frames that are no longer referenced are removed by Spark's
    cleaner (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    ship_package(spark)
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if not current:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="pairlab-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def materialize(df):
    """Cut lineage: write ``df`` to the checkpoint folder once (reliable
    checkpoint, survives executor loss) and return the re-read frame.
    Idempotent: a frame this function returned is passed through."""
    if getattr(df, "_pairlab_materialized", False):
        return df
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    out._pairlab_materialized = True
    return out
