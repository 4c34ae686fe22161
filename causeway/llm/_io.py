"""Reading tables and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from causeway.session import shuffles_freed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of an input directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set, a temporary one in local mode, an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    Later reads come from files that outlive any executor, the work above is done once, and
    the plan starts anew. The schema is given, so that no footer has to be read on the driver.
    The shuffles that made it are freed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def require(df: DataFrame, *names: str) -> None:
    """Fails early, with the columns that are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; got {df.columns}")
