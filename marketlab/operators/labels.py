"""Label maturation and counterfactual credit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.functions.mathx import clip
from marketlab.operators.joins import nearest
from marketlab.operators.scans import seconds

TOLERANCE = 600


def mature(signals: DataFrame, prices: DataFrame, now: DataFrame, horizon_sec=1800, give_up_sec=10800,
           key="product", price="price", tie=("event_id",)) -> DataFrame:
    """Gross directional return from the price at the signal to the price a horizon later.

    Prices are the nearest within 600 s, the later one falling back to the product's newest.
    `now` is one row with column `now`. States: scored, retry, abandon; younger rows are dropped.
    Both the raw and the direction-aligned return are kept. Both prices come from one pass over the prices.
    """
    newest = prices.groupBy(key).agg(F.max_by(price, F.struct("ts", *tie)).alias("_newest"))
    x = signals.crossJoin(F.broadcast(now)).where(seconds("now") - seconds("ts") >= horizon_sec)
    x = nearest(x, prices, TOLERANCE, key, "ts", [price], tie, {"_p0": 0, "_p1": horizon_sec})
    x = x.join(newest, key, "left")
    p0, p1 = F.col(f"_p0.{price}"), F.coalesce(F.col(f"_p1.{price}"), F.col("_newest"))
    fwd = F.when((p0 != 0) & (p1 != 0), p1 / p0 - 1)
    state = (F.when(fwd.isNotNull(), "scored")
             .when(seconds("now") - seconds("ts") > give_up_sec, "abandon").otherwise("retry"))
    return (x.withColumns({"p0": p0, "p1": p1, "fwd_return_raw": fwd, "fwd_return_aligned": fwd * F.col("direction"),
                           "state": state}).drop("_p0", "_p1", "_newest"))


def split_votes(df: DataFrame, votes="votes") -> DataFrame:
    """One row per vote with its share of the absolute vote total."""
    tot = F.aggregate(F.map_values(votes), F.lit(0.0), lambda a, v: a + F.abs(v))
    return (df.withColumn("_tot", F.when(tot != 0, tot).otherwise(1e-9))
            .select("*", F.explode(votes).alias("strategy", "vote")).withColumn("share", F.abs("vote") / F.col("_tot"))
            .drop("_tot", votes))


def credit(net: Column, base: float = 1.0, loss_mult: float = 5.0) -> Column:
    """Return credited to a vote: its own sign's return by share, losses weighted up."""
    aligned = F.when(F.col("vote") > 0, net).otherwise(-net)
    return aligned * F.col("share") * base * F.when(aligned < 0, loss_mult).otherwise(1.0)


def skip_counterfactual(skips: DataFrame, prices: DataFrame, horizon_sec=1800, cost=0.012, weight=0.5, loss_mult=5.0,
                        key="product", price="price", tie=("event_id",)) -> DataFrame:
    """What gated entries would have returned net of cost, credited per vote."""
    x = nearest(skips, prices, TOLERANCE, key, "ts", [price], tie, {"_p0": 0, "_p1": horizon_sec})
    net = (F.col(f"_p1.{price}") / F.col(f"_p0.{price}") - 1) * F.col("direction") - cost
    x = split_votes(x.withColumn("net", net).where(net.isNotNull()).drop("_p0", "_p1"))
    return x.withColumn("credit", credit(F.col("net"), weight, loss_mult))


def exit_counterfactual(decisions: DataFrame, prices: DataFrame, horizon_sec=1800, key="product", price="price",
                        tie=("event_id",)) -> DataFrame:
    """Position-frame return after an exit or hold decision taken at `price`; the throttle's edge is its negative."""
    x = nearest(decisions, prices.withColumnRenamed(price, "_fp"), TOLERANCE, key, "ts", ["_fp"], tie, {"_p1": horizon_sec})
    r = F.when(F.col(price) > 0, F.col("side") * (F.col("_p1._fp") / F.col(price) - 1))
    return x.withColumns({"hold_return": r, "exit_edge": -r}).drop("_p1")


def vote_attribution(trades: DataFrame, trade_weight=2.0, loss_mult=5.0) -> DataFrame:
    """Net return of each closed trade split over its votes."""
    x = trades.withColumn("_n", F.col("qty") * F.col("entry")).where("_n > 0")
    x = split_votes(x.withColumn("net_return", F.col("pnl") / F.col("_n")).drop("_n"))
    return x.withColumn("credit", credit(F.col("net_return"), trade_weight, loss_mult))


def clipped_lesson(labels: DataFrame, weight=0.1, limit=0.004) -> DataFrame:
    """Discounted, clipped, confidence-weighted lesson of a scored signal."""
    return labels.withColumn("lesson", clip(F.col("fwd_return_aligned"), -limit, limit) * F.col("confidence") * weight)
