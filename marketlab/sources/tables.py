"""Loading the given tables and the adapter views that give them market-data shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.operators import bars
from marketlab.operators.scans import pick_levels


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; naive timestamps become instants in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def k_of(props="props"):
    return F.get_json_object(props, "$.k").cast("bigint")


def ticks(spark, d) -> DataFrame:
    return load(spark, d, "events").select(
        F.col("event_type").alias("product"), "ts", (100 + F.col("value")).alias("price"),
        (1 + k_of()).alias("size"), "event_id", "user_id")


def candles(spark, d) -> DataFrame:
    return bars.ticks_to_bars(ticks(spark, d), "1 hour", order=("ts", "event_id"))


TRADE_ORDER = ["closed", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
               "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def trades(spark, d) -> DataFrame:
    """Closed trades, pnl exact to four decimals; `day` / `hour` / `piece` are chunk columns that follow TRADE_ORDER."""
    li = load(spark, d, "lineitem")
    o = load(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    closed = F.timestamp_micros(F.unix_micros("o_orderdate")
                                + (1 + F.col("l_partkey") % 72) * 3_600_000_000)
    return (li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("P"), F.col("l_suppkey") % 20).alias("product"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("side"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("entry"),
        (F.col("l_extendedprice") * F.col("l_tax") * 0.1).alias("fees"),
        (F.col("l_extendedprice").cast("decimal(14,2)") * (F.col("l_discount") - F.col("l_tax")).cast("decimal(6,2)"))
        .cast("double").alias("pnl"),
        F.col("o_orderdate").alias("opened"), closed.alias("closed"),
        F.col("o_orderpriority").alias("regime_at_entry"),
        F.when(F.col("l_linestatus") == "O", "take-profit").otherwise("stop-loss/trail")
        .alias("exit_reason"),
        (F.col("l_linenumber") == 7).alias("hedge"),
        *[c for c in li.columns if c in TRADE_ORDER])
        .withColumns({"day": F.floor(F.unix_seconds("closed") / 86400),
                      "hour": F.floor(F.unix_seconds("closed") / 3600),
                      "piece": F.floor(F.col("l_orderkey") / 1_000_000)}))


TRADE_LEVELS = ["day", "hour", "piece"]


def trade_chunks(spark, d) -> list[str]:
    """Chunk columns for scans along TRADE_ORDER, by the size of the table."""
    return pick_levels(load(spark, d, "lineitem"), TRADE_LEVELS)


def signal_scores(spark, d) -> DataFrame:
    """Every event as a strategy's signal."""
    e = load(spark, d, "events").withColumn("k", k_of())
    return e.select(
        "event_id", "ts", F.concat(F.lit("S"), F.col("user_id") % 13).alias("strategy"),
        F.col("event_type").alias("product"),
        F.when(F.col("k") % 2 == 0, 1).otherwise(-1).alias("direction"),
        (F.col("k") / 100).alias("confidence"))


def decisions(spark, d) -> DataFrame:
    """Every event as a decision, taken 60 + k seconds after it."""
    e = load(spark, d, "events").withColumn("k", k_of())
    return e.select(
        "event_id", F.timestamp_micros(F.unix_micros("ts") + (60 + F.col("k")) * 1_000_000).alias("ts"), F.col("event_type").alias("product"),
        (F.col("k") / 50 - 1).alias("composite"), (F.col("k") / 100).alias("confidence"),
        F.when(F.col("event_id") % 5 == 1, "enter").otherwise("skip").alias("action"))


def docs(spark, d) -> DataFrame:
    """Documents with their whole text as the body; the title is its first line."""
    return load(spark, d, "documents").select(
        "doc_id", "source", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("ts"),
        F.col("lang").alias("kind"))


def fills(spark, d) -> DataFrame:
    """Order fills; exec_id is a content hash, so an exact repeat of a fill carries the same id."""
    li = load(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("intent_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("exec_id"),
        F.concat(F.lit("P"), F.col("l_suppkey") % 20).alias("product"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_tax").alias("fee"), "l_linenumber", F.col("l_shipdate").alias("ts"))


def positions(spark, d) -> DataFrame:
    o = load(spark, d, "orders")
    return o.select(
        F.date_trunc("day", "o_orderdate").alias("ts"), F.col("o_custkey").alias("trader"),
        (1 + F.col("o_custkey") % 10).alias("rank"), (F.col("o_custkey") % 100 / 100).alias("score"),
        F.concat(F.lit("A"), F.col("o_orderkey") % 8).alias("asset"),
        F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("direction"),
        F.col("o_totalprice").alias("notional"))


def forecasts(spark, d) -> DataFrame:
    """Forecast ledger: one row per event, with strategy leans as a map."""
    k = k_of()
    e = load(spark, d, "events").withColumn("k", k)
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), (F.col("k") + 1) / 101))
    lean = F.map_from_arrays(
        F.array(F.lit("momentum"), F.lit("mean_revert"), F.lit("research")),
        F.array(F.col("k") / 50 - 1, (F.col("user_id") % 21 - 10) / 10.0,
                (F.col("event_id") % 5 - 2) / 2.0))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("condition_id"),
        F.col("ts").alias("forecast_ts"), p.alias("market_p0"),
        F.least(F.lit(0.99), F.greatest(F.lit(0.01), p + (F.col("value") - 50) / 500))
        .alias("predicted_p0"),
        F.when(F.col("event_id") % 4 != 0, F.when(F.col("value") > 70, 1).otherwise(0))
        .alias("resolved_outcome0"),
        (F.col("user_id") % 97 * 9.0).alias("ttl_hours"), lean.alias("votes"), "k", "value")


def features_long(spark, d) -> DataFrame:
    """Embedding vectors as (vec_id, dim, value, label) rows."""
    e = load(spark, d, "embeddings")
    return e.select("vec_id", "label", F.posexplode("embedding").alias("dim", "value")) \
        .withColumn("value", F.col("value").cast("double"))
