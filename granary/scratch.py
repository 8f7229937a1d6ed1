"""Tables written between jobs, in the folder that all executors share.

A written table cuts the lineage: when an executor is lost, later jobs read
the files instead of recomputing the work above them.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder for scratch tables: ``spark.checkpoint.dir`` of the session.

    A plain ``local[...]`` session without the setting gets a temporary
    folder; any other master without it is an error, because executors would
    not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL_ROOTS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="granary-"))


def scratch_folder(spark: SparkSession) -> str:
    """The folder of this application's scratch tables and indexes, which ``release`` deletes."""
    return f"{shared_root(spark)}/granary-{spark.sparkContext.applicationId}"


def index_folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/indexes"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to a scratch table and return a frame that reads it."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables and indexes of this application; results that still read them become unusable."""
    delete(spark, scratch_folder(spark))


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more, as soon as what was made of them is written."""
    for df in frames:
        delete(df.sparkSession, df._scratch_path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps.

    It does so when the driver's collector finds that no plan refers to them,
    which an idle driver may not do for half an hour; until then they fill the
    executors' disks. Called after a step whose result is a scratch table.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores in front until no column has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def with_row_id(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df as a scratch table with a unique long per row, and that column's name.

    The ids are fixed because they are written before anyone joins on them.
    """
    rid = free_name(df, "row_id")
    return materialize(df.withColumn(rid, F.monotonically_increasing_id()), label), rid
