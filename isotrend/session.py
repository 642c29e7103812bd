"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution is what sizes shuffles at run time; the advisory size keeps
# every reduce task near 128 MB however large the table is.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the Python call site of every expression doubles the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # A checkpoint goes when nothing refers to it any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
# Beyond one machine: scan splits that keep the number of tasks on a 100 TB table in the hundreds of
# thousands, and reduce partitions of about half a gigabyte before adaptive execution merges small ones.
CLUSTER_SETTINGS = {"spark.sql.files.maxPartitionBytes": "512m"}
REDUCE_BYTES = 512 << 20


def build_session(app: str = "isotrend", master: str | None = None, input_bytes: int = 8 << 40, **conf: str) -> SparkSession:
    """A session with the settings the plans expect; ``conf`` overrides by underscore name.

    ``input_bytes`` is about what the largest shuffle moves; on a cluster it sets the number of
    reduce partitions to begin with, 200,000 for 100 TB.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    local = (master or "").startswith("local")
    partitions = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(max(200, input_bytes // REDUCE_BYTES))}
    for key, value in (SETTINGS if local else {**SETTINGS, **CLUSTER_SETTINGS, **partitions}).items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="isotrend-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session may fall back to a temporary folder of this machine, one per process, which
    goes when the process ends. In the shared folder a job's files stay for the job that reads them;
    the folder belongs to the cluster, which empties it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the checkpoint folder the cluster names; set one only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or scratch_path(spark, "checkpoints"))


def settle(df: DataFrame) -> DataFrame:
    """Compute a reduced table once, in the shared folder, and go on from there.

    For tables that later steps use several times: without it every use repeats the scan
    behind it. A lost executor costs nothing, since the files outlive it.
    """
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a reduced table to the shared folder once and go on from its files, whose size the planner then knows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
