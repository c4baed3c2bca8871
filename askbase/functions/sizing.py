"""Checked sizes and the shared working folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def broadcast_if(df: DataFrame, row_bound: int | None, limit: int = 200_000) -> DataFrame:
    """Broadcast a side of ids and numbers whose row count is at most ``row_bound``.

    Rows must be narrow: a side with texts is never hinted, whatever its count.

    Without a known bound, or above the limit, the choice stays with the
    optimizer, which checks the measured size at run time.
    """
    return F.broadcast(df) if row_bound is not None and row_bound <= limit else df


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        base = context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="askbase-")
            context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the file.

    For small results of costly work that several later steps read: the work
    runs once, and losing an executor does not repeat it. The shuffles that made it are given back.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    give_back(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of finished jobs now: it does so when the driver collects its garbage, else every half hour."""
    spark._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Delete the folders of ``stored`` frames that no later step reads."""
    for frame in frames:
        spark = frame.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
