"""Readers: files or text columns in the feeds' own formats to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlab import schemas
from marketlab.functions import text as X
from marketlab.functions.mathx import finite
from marketlab.operators.bars import dedupe_bars


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", arrival: str | None = None) -> DataFrame:
    """OHLCV pages, one bar per (product, ts), the earliest page winning."""
    reader = spark.read.schema(schemas.BARS + (f", {arrival} bigint" if arrival else ""))
    df = reader.option("header", True).format(fmt).load(path)
    if arrival:
        return dedupe_bars(df, arrival)
    # without a page number the first in value order stands in for the first fetched
    return dedupe_bars(df.withColumn("_page", F.lit(0)), "_page")


def parse_ticks(messages: DataFrame, body: str = "value") -> DataFrame:
    """Ticker messages; other types and blank prices are ignored. Works on batches and streams."""
    m = messages.withColumn("_m", F.from_json(F.col(body).cast("string"), schemas.TICK_MESSAGE))
    price = F.col("_m.price").try_cast("double")
    x = m.where((F.col("_m.type") == "ticker") & price.isNotNull())
    return x.select(*[c for c in messages.columns if c != body], F.col("_m.product_id").alias("product"), price.alias("price"),
                    F.col("_m.best_bid").try_cast("double").alias("bid"), F.col("_m.best_ask").try_cast("double").alias("ask"),
                    X.parse_time(F.col("_m.time")).alias("ts"))


def book_stats(books: DataFrame, bids="bids", asks="asks", depth: int = 25) -> DataFrame:
    """S3: depth, imbalance, mid and spread of the top levels, arrays of (price, size)."""
    def level_sum(c):
        return F.aggregate(F.slice(c, 1, depth), F.lit(0.0), lambda a, v: a + v["price"] * v["size"])

    x = books.withColumns({"bid_depth": level_sum(bids), "ask_depth": level_sum(asks), "_b": F.get(bids, F.lit(0))["price"], "_a": F.get(asks, F.lit(0))["price"]})
    tot, mid = F.col("bid_depth") + F.col("ask_depth"), (F.col("_b") + F.col("_a")) / 2
    return x.withColumns({"imbalance": F.when(tot != 0, (F.col("bid_depth") - F.col("ask_depth")) / tot).otherwise(0.0), "mid": F.coalesce(mid, F.lit(0.0)),
                          "spread_bps": F.when(mid != 0, (F.col("_a") - F.col("_b")) / mid * 1e4).otherwise(0.0)}).drop("_b", "_a")


def derivatives(hourly: DataFrame, key="product", ts="ts") -> DataFrame:
    """Open interest now and against 24 rows back, long/short ratio, taker buy share of the last four rows.

    Columns oi, long_short, buy, sell; Spark keeps only the newest 25 rows per key of each task.
    """
    w = W.partitionBy(key).orderBy(F.col(ts).desc())
    x = hourly.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 25)
    g = x.groupBy(key).agg(F.max_by("oi", -F.col("_r")).alias("oi_usd"), F.max_by("oi", "_r").alias("_then"), F.max_by("long_short", -F.col("_r")).alias("long_short_ratio"),
                           F.sum(F.when(F.col("_r") <= 4, F.col("buy"))).alias("_b"), F.sum(F.when(F.col("_r") <= 4, F.col("sell"))).alias("_s"))
    tot = F.col("_b") + F.col("_s")
    return g.select(key, "oi_usd", F.when(F.col("_then") != 0, F.col("oi_usd") / F.col("_then") - 1).otherwise(0.0).alias("oi_change_24h"), "long_short_ratio",
                    F.when(tot != 0, F.col("_b") / tot).otherwise(0.5).alias("taker_buy_ratio"))


def read_signal_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of external signals, corrupt lines skipped."""
    return spark.read.schema(schemas.SIGNAL_ROW).option("mode", "DROPMALFORMED").json(path)


def parse_json_lines(df: DataFrame, col: str, schema: str, must: str) -> DataFrame:
    """S6 on a text column: rows whose text is not such an object (field `must` absent) are dropped."""
    x = df.withColumn("_j", F.from_json(F.col(col), schema))
    return x.where(F.col(f"_j.{must}").isNotNull()).select(*[c for c in df.columns if c != col], "_j.*")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Positioning snapshots from files holding a list or {"snapshots": [...]}."""
    raw = spark.read.text(path, wholetext=True)
    return explode_snapshots(raw, "value")


def explode_snapshots(df: DataFrame, col: str) -> DataFrame:
    """One row per position; upper-case assets, rank 9999 and direction 0 by default."""
    inner = F.coalesce(F.get_json_object(col, "$.snapshots"), F.col(col))
    listed = F.when(F.substring(F.ltrim(inner), 1, 1) == "[", inner).otherwise(F.concat(F.lit("["), inner, F.lit("]")))
    s = df.select(F.explode(F.from_json(listed, f"array<struct<{_struct(schemas.SNAPSHOT)}>>")).alias("s"))
    t = s.select(F.col("s.ts").alias("ts"), F.explode_outer("s.traders").alias("t"))
    p = t.select("ts", F.coalesce("t.id", F.lit("")).alias("trader"), F.coalesce("t.rank", F.lit(9999)).alias("rank"), F.coalesce("t.score", F.lit(0.0)).alias("score"),
                 F.explode_outer("t.positions").alias("p"))
    return p.select("ts", "trader", "rank", "score", F.upper("p.asset").alias("asset"), F.coalesce("p.direction", F.lit(0)).alias("direction"),
                    F.coalesce("p.notional", F.lit(0.0)).alias("notional"), F.coalesce("p.leverage", F.lit(1.0)).alias("leverage"))


def _struct(ddl: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl).fields)


def normalize_markets(raw: DataFrame) -> DataFrame:
    """Binary markets only; arrays arrive as JSON text, unreadable prices become 0.5."""
    def num(c, default):
        return F.coalesce(finite(F.col(c).try_cast("double")), default if isinstance(default, Column) else F.lit(default))

    x = raw.withColumns({"outcomes": F.from_json("outcomes", "array<string>"), "token_ids": F.from_json("clobTokenIds", "array<string>"),
                         "_p": F.from_json("outcomePrices", "array<string>")})
    x = x.where((F.size("outcomes") == 2) & (F.size("token_ids") == 2))
    price = F.transform("_p", lambda v: F.coalesce(finite(v.try_cast("double")), F.lit(0.5)))
    x = x.withColumn("prices", F.when(F.size("_p") == 2, price).otherwise(F.array(F.lit(0.5), F.lit(0.5))))
    p0 = F.col("prices")[0]
    tick, least = num("orderPriceMinTickSize", 0.01), num("orderMinSize", 5.0)
    return x.select(
        F.coalesce("conditionId", F.lit("")).alias("condition_id"), "question", F.coalesce("slug", F.lit("")).alias("slug"), X.first_slug(F.col("slug")).alias("category"),
        "outcomes", "token_ids", "prices", num("bestBid", p0).alias("best_bid"), num("bestAsk", p0).alias("best_ask"), num("spread", 0.0).alias("spread"),
        num("lastTradePrice", p0).alias("last_trade_price"), num("liquidity", 0.0).alias("liquidity"), num("volume24hr", 0.0).alias("volume_24h"),
        F.when(tick != 0, tick).otherwise(0.01).alias("tick_size"), F.when(least != 0, least).otherwise(5.0).alias("min_order_size"),
        num("oneHourPriceChange", 0.0).alias("mom_1h"), num("oneDayPriceChange", 0.0).alias("mom_1d"), X.parse_time(F.col("endDate")).alias("end_ts"),
        *[F.coalesce(c, F.lit(False)).alias(n) for c, n in (("active", "active"), ("closed", "closed"), ("acceptingOrders", "accepting_orders"))])


FOMC = "fomc|federal funds rate|fed chair|fed press"


def read_calendar(rows: DataFrame) -> DataFrame:
    """High-impact USD events with parsed time, once per (title, time), FOMC titles flagged."""
    x = rows.where("country = 'USD' AND impact = 'High'").select("title", X.parse_time(F.col("date")).alias("ts"), "impact")
    return x.where("ts is not null").dropDuplicates(["title", "ts"]).withColumn("is_fomc", F.lower("title").rlike(FOMC))


def map_fields(raw: DataFrame, col: str, paths: dict[str, str], long_value: str = "long") -> DataFrame:
    """Trader positions from JSON of unknown shape by dotted paths (asset, side, size, leverage, score).

    The side may be text or a boolean; positions without an asset or with no size are dropped.
    """
    g = {k: F.get_json_object(col, "$." + p) for k, p in paths.items()}
    side = F.lower(F.coalesce(g["side"], F.lit("")))
    x = raw.select(*[c for c in raw.columns if c != col], F.upper(g["asset"]).alias("asset"), F.when(side == long_value.lower(), 1).otherwise(-1).alias("direction"),
                   F.coalesce(g["size"].try_cast("double"), F.lit(0.0)).alias("notional"), F.coalesce(g["leverage"].try_cast("double"), F.lit(1.0)).alias("leverage"),
                   F.coalesce(g["score"].try_cast("double"), F.lit(0.0)).alias("score"))
    return x.where(F.col("asset").isNotNull() & (F.col("asset") != "") & (F.col("notional") > 0))
