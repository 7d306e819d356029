"""Session helpers: configuration reads and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether the shuffle files of an action go when it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cutgrain")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where that is unset and everything runs on this machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if configured is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="cutgrain-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Actions within drop their shuffle files when they end, instead of when the driver happens to collect its garbage."""
    had = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, had)


@contextmanager
def narrow(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Actions within join small shuffle partitions up to so many bytes only, where rows of a few numbers shrink when shuffled
    and grow many times in hash tables; a smaller size that was set before stays."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    had = spark.conf.get(key, None)
    if had is None or had == "67108864b":  # the default
        spark.conf.set(key, size)
    try:
        yield
    finally:
        if had is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, had)


def bounded(df: DataFrame, size: str = "8m") -> DataFrame:
    """df, in whose session batches for Python workers get at most so many bytes, unless that was set before."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) == "67108864b":  # the default, which is much for texts
        conf.set(key, size)
    return df


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, into reliable shared storage, and cut its lineage there; its own shuffle files go."""
    ensure_checkpoint_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint(eager=True)


def unused(df: DataFrame, *names: str) -> str | list[str]:
    """Names that df has no column of, each as near to the wish as can be; one as itself, several as a list."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out[0] if len(out) == 1 else out


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, which has been cut and has rows of bounded width, marked for a broadcast if it has few of them."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where it comes in fewer partitions than there are cores, as a few small files do; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
