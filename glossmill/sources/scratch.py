"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only a local session that names none (tests, a laptop) gets a temporary one; on a
    cluster a folder of the driver's own would be lost to the executors, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="glossmill-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_CLEANED: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, one subfolder per application; it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _CLEANED:
        _CLEANED.add(app)
        atexit.register(_drop_at_exit, spark)
    return f"{shared_dir(spark)}/glossmill-{app}/{name}-{uuid.uuid4().hex[:12]}"


def _drop_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has been stopped
        with contextlib.suppress(Exception):
            drop_scratch(spark)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what is written,
    and every later reader sees the same rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; results that still read them die with them."""
    path = f"{shared_dir(spark)}/glossmill-{spark.sparkContext.applicationId}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
