"""Writers. Each returns the written table as it reads back, from files in the shared folder.

A table is replaced by writing a fresh path, so that a job that dies leaves the old one whole.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.session import shuffles_freed

def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set, a temporary one in local mode, an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Parquet at a path, replaced if given, fresh otherwise; the shuffles that made it are freed."""
    path = path or fresh_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_tsv(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Tab-separated text with a header."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").csv(path, sep="\t", header=True)
    return df.sparkSession.read.csv(path, schema=df.schema, sep="\t", header=True)


def publish(df: DataFrame, path: str) -> DataFrame:
    """df as the new version of the table at a path; readers of current() see the old or the new one, whole.

    Rows go to a fresh folder first; then one row that names it is appended to the table of
    versions, which Spark commits by renaming a file. A driver that is lost in between leaves a
    folder that no version names. Of two writers at once the larger name wins.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{name}")
    _switch(spark, path, name)
    return current(spark, path)


def _switch(spark: SparkSession, path: str, name: str) -> None:
    known = _versions(spark, path)
    seq = known[0] + 1 if known else 1
    spark.createDataFrame([(seq, name)], _VERSION).coalesce(1).write.mode("append").parquet(f"{path}/versions")


_VERSION = "seq long, name string"


def _versions(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """seq and name of the newest version; None before the first."""
    try:
        rows = spark.read.schema(_VERSION).parquet(f"{path}/versions")
        return rows.agg(F.max(F.struct("seq", "name")).alias("v")).select("v.*").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a table that publish() wrote."""
    known = _versions(spark, path)
    if known is None or known[1] is None:
        raise FileNotFoundError(f"no version of {path}")
    return spark.read.parquet(f"{path}/data/{known[1]}")


def upsert(base: DataFrame, updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of updates, and rows of base whose key isn't among theirs, written anew."""
    return write_table(base.join(updates, list(key), "left_anti").select(*base.columns).unionByName(updates), "upsert")


def upsert_into(path: str, updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """upsert() into a published table: the merged rows become its next version."""
    base = current(updates.sparkSession, path)
    return publish(base.join(updates, list(key), "left_anti").select(*base.columns).unionByName(updates), path)


def write_variable_list(df: DataFrame, name: str, column: str = "variable") -> DataFrame:
    """Distinct names, one on each line."""
    path = fresh_path(df.sparkSession, name)
    df.select(column).distinct().write.text(path)
    return df.sparkSession.read.text(path)


def edges_json(edges: DataFrame, key: Sequence[str], fields: Sequence[str], size: int = 4096) -> DataFrame:
    """For each model its edges as JSON arrays of up to `size` edges in order: key, n (all its edges), part and edges.

    A large model's document is its parts one after another; none is built as a whole.
    """
    from causeway.operators import scan  # which writes its tables with this module

    return scan.chunked(edges, key, fields, fields, size, "edges").withColumn("edges", F.to_json("edges"))


def nodes_without_indicator(nodes: DataFrame, indicators: DataFrame) -> DataFrame:
    """What must be empty before a model is written: concepts that no indicator is attached to."""
    return nodes.select("concept").join(indicators, "concept", "left_anti")


def export_state(tables: Mapping[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """Each long table of a model as its own Parquet table."""
    return {k: write_table(df, f"{name}-{k}") for k, df in tables.items()}
