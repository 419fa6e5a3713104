"""Query registry of this subpackage, loading, and tables written to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.operators.scans import shared_folder

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

WORD_SPLIT = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)` under `name`, with its DuckDB twin where there is one."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new place for a table in the shared folder."""
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, with a cut lineage, and lost executors don't matter.

    It goes when the driver's JVM ends, or with `dropped` if its place is given.
    """
    spark = df.sparkSession
    path = path or folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    store, target = _located(spark, path)
    store.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete the table `written` at `path`, which no later plan may read."""
    store, target = _located(spark, path)
    store.delete(target, True)


def lowest(df: DataFrame, by: str, n: int) -> DataFrame:
    """The rows of `df` up to the `n`-th smallest value of the column `by`, ties included.

    Only these values pass one task; the rows stay where they are, whatever they hold.
    """
    edge = df.select(by).orderBy(by).limit(n).agg(F.max(by)).first()[0]
    return df.limit(0) if edge is None else df.where(F.col(by) <= F.lit(edge))


def word_count(text: str) -> F.Column:
    """Number of words as a native expression; null counts as empty."""
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text), WORD_SPLIT), "")), F.lit(0)).cast("long")
