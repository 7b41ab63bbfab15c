"""Session building, lineage cuts and skew-safe joins shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build(app: str = "millrace", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume: UTC, ANSI and AQE with skew handling.

    Cluster settings (memory, cores, shuffle partitions) are left to the caller's ``conf``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # else every Column call looks up where it was made
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset
    and the master is a single local process (tests) a temporary folder is set instead.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="millrace-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """The rows over all cores, where a small input (at most ``most`` bytes by its statistics) lies in fewer files than there are cores.

    For work that is slow for its bytes. Larger inputs, and those of many files, stay as they are, so no large text is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= most and 0 < len(df.inputFiles()) < cores else df


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = 32, hot: int = 20_000) -> DataFrame:
    """Equi-join on the column ``key``, with the rows of hot keys of ``left`` spread over ``salts`` tasks.

    Keys with more than ``hot`` rows on the left (counted with a map-side combine) get a salt on the
    left and as many copies of their rows on the right; all other keys join as usual. ``right`` must be
    bounded for each key (a dimension), ``how`` one of inner, left, left_semi, left_anti. Null keys
    match nothing. The row set equals that of a plain join. The salt is a hash of the whole left row, so
    a task that runs again after a lost executor places its rows as before.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot).select(key, F.lit(True).alias("__hot"))
    # at most rows/hot keys come out of this filter, so the flag table stays small beside the input
    r = right.join(counts, key, "left").withColumn(
        "__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("__hot")
    l = left.join(counts, key, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    ).drop("__hot")
    return l.join(r, [key, "__salt"], how).drop("__salt")


def stable_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A 64-bit hash that is the same on every run and every cluster layout."""
    return F.xxhash64(F.lit(seed), *cols)
