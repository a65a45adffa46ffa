"""Session helpers: the shared work folder and tables written in between."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"

# A table with at most this many rows, by count or by construction, may be
# broadcast. The rows concerned are narrow (ids, offsets, scores).
BROADCAST_ROWS = 200_000

# Folders of local sessions that name none, by application.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local session (tests) may fall back on a folder of its own.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_KEY
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="stockweave-")
    return _local_folders[app]


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def written(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage and survives the loss of executors, and columns from
    nondeterministic expressions keep the values they had when written. Files have at
    most ``file_rows`` rows (0: any number); Spark reads thousands of rows at a time, so
    rows of many megabytes need files of their own.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, label)
    df.write.mode("errorifexists").option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_and_counted(
    df: DataFrame, label: str, n: Column | None = None
) -> tuple[DataFrame, int]:
    """Like :func:`written`, with the number of rows (where ``n`` holds).

    The count is observed while writing and costs no job of its own.
    """
    seen = Observation()
    counted = F.count(F.lit(1)) if n is None else F.count_if(n)
    table = written(df.observe(seen, counted.alias("n")), label)
    return table, seen.get["n"] or 0


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan with fewer splits than cores to all cores.

    For plain scans in front of costly per-row work, such as an encoder. A
    large table has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
