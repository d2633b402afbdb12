"""Session settings and the two ways this library makes a result durable.

Nothing here builds a plan; intermediate tables are settled in the shared folder
the cluster names.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SPLIT = "spark.sql.files.maxPartitionBytes"
# Most bytes of a file that one task of :func:`short_scans` reads.
SHORT_SPLIT = 16 << 20

# Range slices of an ordered table, for each shuffle partition of the session.
SLICES_PER_PARTITION = 2

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Folders listed by tasks of many folders each, not one by one.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("driftline")
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators rely on to a given session."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def short_scans(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside read files in short splits.

    Spark's splits grow with the input up to 128 MB, and with them what a map-side
    combination of mostly distinct values holds in memory.
    """
    before = spark.conf.get(SPLIT)
    spark.conf.set(SPLIT, f"{SHORT_SPLIT}b")
    try:
        yield
    finally:
        spark.conf.set(SPLIT, before)


def slice_count(spark: SparkSession) -> int:
    return SLICES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a local one only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
            configured = tempfile.mkdtemp(prefix="driftline-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
