"""Bar building: ticks to OHLCV, folding, paging union and granularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRANULARITIES = (60, 300, 900, 3600, 21600, 86400)


def ohlcv(order):
    at = F.struct(*order)
    return [F.min_by("price", at).alias("open"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.max_by("price", at).alias("close"),
            F.sum("size").cast("double").alias("volume")]


def ticks_to_bars(ticks: DataFrame, width: str = "5 minutes", key: str = "product",
                  order=("ts",)) -> DataFrame:
    """A1: tumbling OHLCV bars. Combines map-side, so a hot product shuffles one row per bar and task."""
    return (ticks.groupBy(key, F.window("ts", width).alias("w")).agg(*ohlcv(order))
            .select(key, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume"))


def fold_bars(bars: DataFrame, n: int, key: str = "product") -> DataFrame:
    """A1: fold n bars into one, groups aligned to the newest bar, whole groups only."""
    back = F.row_number().over(W.partitionBy(key).orderBy(F.col("ts").desc()))
    g = bars.withColumn("_g", F.floor((back - 1) / n))
    return (g.groupBy(key, "_g").agg(
        F.max("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == n).drop("_g", "_n"))


def dedupe_bars(pages: DataFrame, arrival: str = "page", key: str = "product") -> DataFrame:
    """One bar per (key, ts); the earliest page wins, older pages never overwrite."""
    cols = [c for c in pages.columns if c not in (key, "ts", arrival)]
    row = F.struct(*cols)
    return (pages.groupBy(key, "ts").agg(F.min_by(row, F.struct(F.col(arrival), row)).alias("_b"))
            .select(key, "ts", "_b.*"))


def backfill_bars(*pages: DataFrame, key: str = "product") -> DataFrame:
    """Union of page fetches, newest page first."""
    out = None
    for i, p in enumerate(pages):
        p = p.withColumn("page", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return dedupe_bars(out, "page", key)


def snap_granularity(sec):
    """The allowed granularity nearest to `sec` (the smaller one on a tie)."""
    cands = F.array(*[F.struct(F.abs(sec - g).alias("d"), F.lit(g).alias("g")) for g in GRANULARITIES])
    return F.array_min(cands)["g"]
