"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession

#: What the engine expects of a session it makes itself; a given session is left as it is.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tarmacade")
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions)} | extra
    session = builder.config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's `spark.checkpoint.dir`, else one of our own.

    Only a session on a single machine (tests, benchmarks) that names no folder gets a temporary
    one; on a cluster the executors would write to disks of their own, so a folder is asked for.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="tarmacade-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(frame: DataFrame) -> DataFrame:
    """The frame's rows, computed once and kept in the shared checkpoint folder.

    Survives the loss of executors, unlike a local checkpoint or a cache.
    """
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def spread(frame: DataFrame) -> DataFrame:
    """The frame in as many parts as a shuffle has, however few its bytes: kernels work on them.

    Meant for narrow rows (ids of pairs) ahead of joins with small tables.
    """
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def merged(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """The join of two frames that both grow with the data, by sort and merge.

    Compressed, either may look small enough to broadcast, but it is collected and hashed on the
    driver in full, several at once.
    """
    return left.hint("merge").join(right.hint("merge"), on, how)
