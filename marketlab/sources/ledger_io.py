"""Ledger tables as day-partitioned parquet: appends, inserts once, labels once, retention and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlab import schemas
from marketlab.operators.scans import seconds


def with_day(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("day", F.to_date(ts))


def time_column(table: str) -> str:
    return {"pm_forecasts": "forecast_ts", "paper_portfolio": "created_ts"}.get(table, "ts")


def read_ledger(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One ledger table; columns added later read as null in old files."""
    return spark.read.schema(schemas.LEDGER[table] + ", day date").option("mergeSchema", True).parquet(f"{root}/{table}")


def append(df: DataFrame, root: str, table: str) -> None:
    """Append-only write; missing columns become null, unknown ones are refused."""
    want = T.StructType.fromDDL(schemas.LEDGER[table])
    extra = set(df.columns) - set(want.names)
    if extra:
        raise ValueError(f"unknown columns for {table}: {sorted(extra)}")
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields]
    with_day(df.select(*cols), time_column(table)).write.mode("append").partitionBy("day").parquet(f"{root}/{table}")


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys, order) -> DataFrame:
    """The new rows to append: one per key, none for keys already present."""
    row = F.struct(*new.columns)
    first = new.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")
    return first.join(existing.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def label_once(table: DataFrame, updates: DataFrame, key: str, cols, flag: str = "scored") -> DataFrame:
    """Fill `cols` only where still unlabelled; rows in `updates` count as scored even with a null label."""
    cols = list(cols)
    u = updates.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_u_{c}") for c in cols])
    u = u.groupBy("_k").agg(*[F.min(f"_u_{c}").alias(f"_u_{c}") for c in cols])
    x = table.join(u, F.col(key) == F.col("_k"), "left")
    open_ = F.col(flag) == 0
    new = {c: F.when(open_, F.coalesce(F.col(c), F.col(f"_u_{c}"))).otherwise(F.col(c)) for c in cols}
    return x.withColumns({**new, flag: F.when(F.col("_k").isNotNull(), 1).otherwise(F.col(flag))}).select(*table.columns)


def prune(df: DataFrame, ts: str, now: Column, keep_sec: int) -> DataFrame:
    """Rows inside the retention; on a day-partitioned table the day filter prunes whole folders."""
    kept = df.where(seconds(ts) >= seconds(now) - keep_sec)
    if "day" in df.columns:
        kept = kept.where(F.col("day") >= F.to_date(F.timestamp_seconds(F.unix_seconds(now) - keep_sec)))
    return kept


def recent(df: DataFrame, order, n: int) -> DataFrame:
    """K1: newest n rows with a total tie-break."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def page(df: DataFrame, key: str, after: int, n: int) -> DataFrame:
    """K8: the next page of ids."""
    return df.where(F.col(key) > after).orderBy(key).limit(n)


def recent_decisions(df: DataFrame, n: int, product: str | None = None, action: str | None = None, order=("ts", "event_id")) -> DataFrame:
    """Newest decisions, optionally of one product or action."""
    if product:
        df = df.where(F.col("product") == product)
    if action:
        df = df.where(F.col("action") == action)
    return recent(df, order, n)


def matured_unscored(df: DataFrame, cutoff: Column) -> DataFrame:
    """P5: unscored rows old enough to be labelled."""
    return df.where((F.col("scored") == 0) & (F.col("ts") <= cutoff))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table in one plan."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def write_dataset(events: DataFrame, labels: DataFrame, path: str, fmt: str = "parquet", version: str = "ml_dataset.v1") -> None:
    """Events, labels and a one-row description side by side."""
    events.write.mode("overwrite").format(fmt).save(f"{path}/events")
    labels.write.mode("overwrite").format(fmt).save(f"{path}/labels")
    meta = labels.agg(F.count(F.lit(1)).alias("n_labels")).select(F.lit(version).alias("version"), "n_labels", F.current_timestamp().alias("written"))
    meta.write.mode("overwrite").format("json").save(f"{path}/meta")


def write_report(sections: dict[str, DataFrame], path: str, fmt: str = "json") -> None:
    """One folder per report section."""
    for name, df in sections.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def newest_per_key(df: DataFrame, key: str, order) -> DataFrame:
    w = W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
