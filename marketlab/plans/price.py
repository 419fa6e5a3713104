"""Bars, indicators and regime queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlab.functions.mathx import r6
from marketlab.operators import bars as B
from marketlab.operators import indicators as I
from marketlab.operators import scans as S
from marketlab.plans.registry import query
from marketlab.plans.views import with_views
from marketlab.sources import tables as T

EPOCH = "CAST(epoch(ts) AS BIGINT) AS ts"


def out(df, *cols, keys=("product",)):
    """Key columns, epoch seconds and rounded values: the output shape of most queries."""
    return df.select(*keys, F.unix_seconds("ts").alias("ts"), *[r6(F.col(c)).alias(c) for c in cols])


def rd(*cols, t=""):
    return ", ".join(f"round({t}{c}, 6) AS {c}" for c in cols)


def fr(n, to=0, part="product"):
    """DuckDB window of n trailing rows ending `-to` rows before the current one."""
    end = "CURRENT ROW" if to == 0 else f"{-to} PRECEDING"
    return f"(PARTITION BY {part} ORDER BY ts ROWS BETWEEN {n - 1 - to} PRECEDING AND {end})"


PW = "(PARTITION BY product ORDER BY ts)"


def ema_sql(n, c="close"):
    k = 2 / (n + 1)
    terms = [f"{c} * {k!r}"]
    for j in range(1, n):
        wt = (1 - k) ** j * (k if j < n - 1 else 1.0)
        terms.append(f"lag({c}, {j}) OVER {PW} * {wt!r}")
    return " + ".join(terms)


FEATURES = f""", b0 AS (SELECT *, lag(close) OVER {PW} AS pc, row_number() OVER {PW} AS rn FROM candles),
b1 AS (SELECT *, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS down,
  greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, ln(close / pc) AS lr FROM b0),
b2 AS (SELECT product, ts, rn, open, high, low, close, volume, close AS price,
  avg(up) OVER {fr(14)} AS u14, avg(down) OVER {fr(14)} AS d14, avg(tr) OVER {fr(14)} AS atr,
  avg(close) OVER {fr(20)} AS sma20, avg(close) OVER {fr(50)} AS sma50,
  {ema_sql(12)} AS ema12, {ema_sql(26)} AS ema26,
  stddev_samp(lr) OVER {fr(60)} AS volatility, max(high) OVER {fr(20)} AS hi20,
  min(low) OVER {fr(20)} AS lo20,
  CASE WHEN sum(volume) OVER {fr(20)} <> 0 THEN volume / (sum(volume) OVER {fr(20)} / 20) ELSE 1 END AS vol_ratio,
  coalesce(close / lag(close, 12) OVER {PW} - 1, 0) AS mom_1h,
  coalesce(close / lag(close, 48) OVER {PW} - 1, 0) AS mom_4h FROM b1),
b3 AS (SELECT *, CASE WHEN d14 = 0 THEN 100 ELSE 100 - 100 / (1 + u14 / d14) END AS rsi,
  ema12 - ema26 AS macd FROM b2),
b4 AS (SELECT *, macd - lag(macd) OVER {PW} AS macd_delta,
  CASE WHEN sma20 > sma50 * 1.002 THEN 'bull' WHEN sma20 < sma50 * 0.998 THEN 'bear' ELSE 'sideways' END AS trend,
  CASE WHEN volatility > 0.004 THEN 'high-vol' ELSE 'normal' END AS vol_state FROM b3),
features AS (SELECT *, trend || '/' || vol_state AS regime FROM b4 WHERE rn >= 60)
"""
CANDLES = with_views("candles")
FEAT = CANDLES + FEATURES
FEATURE_COLS = ("price", "rsi", "atr", "sma20", "sma50", "ema12", "ema26", "macd", "macd_delta",
                "volatility", "hi20", "lo20", "vol_ratio", "mom_1h", "mom_4h")


def feats(spark, d):
    return I.regime_label(I.features(T.candles(spark, d)))


@query("S1 S2 A1 W1 W5 W7 W9 W14 (minimum slice)", FEAT + f""", nxt AS (SELECT product, ts,
  lead(close) OVER {PW} / close - 1 AS r FROM candles)
SELECT regime, count(*) AS n_bars, round(avg(r), 6) AS mean_next_return, round(avg(rsi), 6) AS mean_rsi,
  round(avg(atr), 6) AS mean_atr FROM features JOIN nxt USING (product, ts) GROUP BY regime""")
def regime_returns(spark, d):
    s = I.Series()
    bars = T.candles(spark, d).withColumn("next_ret", F.lead("close").over(s.w) / F.col("close") - 1)
    return (I.regime_label(I.features(bars)).groupBy("regime").agg(
        F.count(F.lit(1)).alias("n_bars"), r6(F.avg("next_ret")).alias("mean_next_return"),
        r6(F.avg("rsi")).alias("mean_rsi"), r6(F.avg("atr")).alias("mean_atr")))


@query("A1 S2", CANDLES + f"SELECT product, {EPOCH}, {rd('open', 'high', 'low', 'close', 'volume')} FROM candles")
def ticks_to_bars(spark, d):
    return out(T.candles(spark, d), "open", "high", "low", "close", "volume")


@query("A1", CANDLES + f""", r AS (SELECT *, (row_number() OVER (PARTITION BY product ORDER BY ts DESC) - 1) // 4 AS g
  FROM candles), f AS (SELECT product, max(ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high,
  min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM r GROUP BY product, g
  HAVING count(*) = 4) SELECT product, {EPOCH}, {rd('open', 'high', 'low', 'close', 'volume')} FROM f""")
def fold_bars(spark, d):
    return out(B.fold_bars(T.candles(spark, d), 4), "open", "high", "low", "close", "volume")


@query("S1", f"""SELECT part_key AS product, snapped, count(*) AS n, round(sum(close), 6) AS total FROM (
  SELECT part_key, ts, (SELECT g FROM (VALUES (60), (300), (900), (3600), (21600), (86400)) v(g)
    ORDER BY abs(part_key * 997 - g), g LIMIT 1) AS snapped, first(close ORDER BY page, close) AS close FROM (
    SELECT l_partkey % 40 AS part_key, l_shipdate AS ts, l_linenumber AS page, l_extendedprice AS close FROM lineitem)
  GROUP BY part_key, ts) GROUP BY 1, 2""")
def read_bars(spark, d):
    li = T.load(spark, d, "lineitem")
    pages = li.select((F.col("l_partkey") % 40).alias("product"), F.col("l_shipdate").alias("ts"),
                      F.col("l_linenumber").alias("page"), F.col("l_extendedprice").alias("close"))
    x = B.dedupe_bars(pages)
    return (x.withColumn("snapped", B.snap_granularity(F.col("product") * 997))
            .groupBy("product", "snapped").agg(F.count(F.lit(1)).alias("n"),
                                               r6(F.sum("close")).alias("total")))


@query("S17", CANDLES + f""", pages AS (SELECT 0 AS page, * FROM candles WHERE hour(ts) >= 12 UNION ALL
  SELECT 1, product, ts, open * 2, high * 2, low * 2, close * 2, volume FROM candles),
u AS (SELECT *, row_number() OVER (PARTITION BY product, ts ORDER BY page) AS r FROM pages)
SELECT product, {EPOCH}, {rd('open', 'close', 'volume')} FROM u WHERE r = 1""")
def backfill_bars(spark, d):
    c = T.candles(spark, d)
    older = c.withColumns({x: F.col(x) * 2 for x in ("open", "high", "low", "close")})
    return out(B.backfill_bars(c.where(F.hour("ts") >= 12), older), "open", "close", "volume")


@query("W1 W2 W4 W5 W7 W9 W10", FEAT + f"SELECT product, {EPOCH}, {rd(*FEATURE_COLS)} FROM features")
def ohlcv_features(spark, d):
    return out(I.features(T.candles(spark, d)), *FEATURE_COLS)


@query("W1 W5 W7 (chunked series)", FEAT + f"SELECT product, {EPOCH}, {rd('rsi', 'atr', 'sma50', 'volatility')} FROM features")
def ohlcv_features_chunked(spark, d):
    c = S.trailing_chunks(T.candles(spark, d), ["product"], "ts", lookback=120, size=500)
    f = I.features(c, ["product", "_piece"], warm=False)
    return out(f.where(~F.col("_warm") & (F.col("_rn") >= I.MIN_BARS)), "rsi", "atr", "sma50", "volatility")


@query("W14", FEAT + f"SELECT product, {EPOCH}, regime, trend, vol_state FROM features")
def regime_labels(spark, d):
    return feats(spark, d).select("product", F.unix_seconds("ts").alias("ts"), "regime", "trend", "vol_state")


@query("W11", CANDLES + f"""SELECT product, {EPOCH}, round(CASE WHEN row_number() OVER {PW} > 20 THEN
  max(high) OVER {fr(20, -1)} END, 6) AS brk_up, round(CASE WHEN row_number() OVER {PW} > 20 THEN
  min(low) OVER {fr(20, -1)} END, 6) AS brk_dn FROM candles""")
def breakout_levels(spark, d):
    return out(I.breakout_levels(T.candles(spark, d), 20), "brk_up", "brk_dn")


ER = f""", e0 AS (SELECT *, abs(close - lag(close) OVER {PW}) AS step, row_number() OVER {PW} AS rn FROM candles),
e1 AS (SELECT *, coalesce(CASE WHEN rn > 48 AND sum(step) OVER {fr(48)} > 0 THEN
  abs(close - lag(close, 48) OVER {PW}) / sum(step) OVER {fr(48)} END, 0) AS er FROM e0)
"""


@query("W12", CANDLES + ER + f"""SELECT product, {EPOCH}, round(er, 6) AS er,
  CASE WHEN rn > 48 AND er >= 0.2 THEN 'TREND' ELSE 'RANGE' END AS er_regime FROM e1""")
def efficiency_ratio(spark, d):
    x = I.efficiency_ratio(T.candles(spark, d), 48, 0.2)
    return x.select("product", F.unix_seconds("ts").alias("ts"), r6(F.col("er")).alias("er"), "er_regime")


ATRS = f""", a0 AS (SELECT *, coalesce(lag(close) OVER {PW}, close) AS pc, row_number() OVER {PW} AS rn FROM candles),
a1 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, close - pc AS dd FROM a0),
a2 AS (SELECT *, avg(greatest(dd, 0)) OVER {fr(14)} AS u, avg(greatest(-dd, 0)) OVER {fr(14)} AS dn,
  avg(tr) OVER {fr(14)} AS t FROM a1),
a3 AS (SELECT *, CASE WHEN rn > 14 THEN t ELSE 0 END AS atr, CASE WHEN rn > 14 THEN
  CASE WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + u / dn) END ELSE 0 END AS rsi FROM a2)
"""


@query("W37 W7", CANDLES + ATRS + f"SELECT product, {EPOCH}, {rd('atr', 'rsi')} FROM a3")
def atr_rsi_series(spark, d):
    return out(I.atr_series(T.candles(spark, d)), "atr", "rsi")


@query("W13", CANDLES + ATRS + f""", m AS (SELECT *, quantile_cont(atr, 0.5) OVER {fr(72, -1)} AS med FROM a3)
SELECT product, {EPOCH}, round(CASE WHEN rn > 72 AND med > 0 THEN atr / med ELSE 1 END, 6) AS vol_norm FROM m""")
def vol_norm(spark, d):
    return out(I.vol_norm(I.atr_series(T.candles(spark, d))), "vol_norm")


def mtf_fold(n):
    return f""", g{n} AS (SELECT product, max(ts) AS ts, max(high) AS high, min(low) AS low,
  last(close ORDER BY ts) AS close FROM (SELECT *, (row_number() OVER (PARTITION BY product ORDER BY ts DESC) - 1)
  // {n} AS g FROM candles) GROUP BY product, g HAVING count(*) = {n}),
h{n} AS (SELECT *, lag(close) OVER {PW} AS pc, row_number() OVER {PW} AS rn, {ema_sql(5)} AS f, {ema_sql(12)} AS s FROM g{n}),
i{n} AS (SELECT *, avg(greatest(close - pc, 0)) OVER {fr(14)} AS u, avg(greatest(pc - close, 0)) OVER {fr(14)} AS dn FROM h{n}),
t{n} AS (SELECT product, CASE WHEN rn < 12 THEN 0 WHEN f > s * 1.001 THEN 1 WHEN f < s * 0.999 THEN -1 ELSE 0 END AS t{n},
  CASE WHEN rn < 15 THEN 50 WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + u / dn) END AS r{n}
  FROM i{n} QUALIFY row_number() OVER (PARTITION BY product ORDER BY ts DESC) = 1)"""


MTF = mtf_fold(3) + mtf_fold(12) + mtf_fold(48) + """, mtf AS (SELECT c.product, c.ts,
  coalesce(t3, 0) AS t3, coalesce(t12, 0) AS t12, coalesce(t48, 0) AS t48,
  (coalesce(t3, 0) + coalesce(t12, 0) + coalesce(t48, 0)) / 3 AS align, coalesce(r12, 50) AS rsi_mid
  FROM (SELECT product, max(ts) AS ts FROM candles GROUP BY product) c
  LEFT JOIN t3 USING (product) LEFT JOIN t12 USING (product) LEFT JOIN t48 USING (product))
"""


@query("W15", CANDLES + MTF + f"SELECT product, {EPOCH}, {rd('t3', 't12', 't48', 'align', 'rsi_mid')} FROM mtf")
def mtf_trend(spark, d):
    return out(I.mtf_trend(T.candles(spark, d)), "t3", "t12", "t48", "align", "rsi_mid")


def atr_last(src, name):
    return f""", {name} AS (SELECT product, CASE WHEN rn > 14 THEN a END AS {name}_atr FROM (SELECT product, ts, rn,
  avg(greatest(high - low, abs(high - pc), abs(low - pc))) OVER {fr(14)} AS a FROM (SELECT *,
  lag(close) OVER {PW} AS pc, row_number() OVER {PW} AS rn FROM {src}))
  QUALIFY row_number() OVER (PARTITION BY product ORDER BY ts DESC) = 1)"""


@query("W8", CANDLES + mtf_fold(12) + atr_last("g12", "sw") + atr_last("candles", "nat") + """
SELECT c.product, CAST(epoch(max(ts)) AS BIGINT) AS ts, round(coalesce(any_value(sw_atr), any_value(nat_atr)), 6) AS atr_swing
FROM candles c LEFT JOIN sw USING (product) LEFT JOIN nat USING (product) GROUP BY c.product""")
def swing_atr(spark, d):
    return out(I.swing_atr(T.candles(spark, d)), "atr_swing")


@query("W28", CANDLES + f""", l0 AS (SELECT *, row_number() OVER {PW} AS rn, lag(close, 12) OVER {PW} AS c12,
  lag(close, 24) OVER {PW} AS c24, avg(volume) OVER {fr(6)} AS rec, avg(volume) OVER {fr(42, -6)} AS base FROM candles),
l1 AS (SELECT *, close / c12 - 1 AS mom, close / c12 - c12 / c24 AS accel,
  CASE WHEN base > 1e-9 THEN rec / base ELSE 1 END AS vol_exp FROM l0),
l2 AS (SELECT *, CASE WHEN rn < 26 THEN 'dormant' WHEN mom > 0.10 AND accel > 0.04 AND vol_exp > 2.5 THEN 'blowoff'
  WHEN mom > 0.03 AND vol_exp > 1.3 THEN 'markup' WHEN accel < -0.02 AND mom > 0 AND vol_exp > 1.3 THEN 'distribution'
  WHEN mom < -0.03 AND vol_exp < 1 THEN 'decay' ELSE 'dormant' END AS phase FROM l1)
SELECT product, {EPOCH}, phase, round(CASE phase WHEN 'blowoff' THEN -0.85
  WHEN 'markup' THEN greatest(-1, least(1, 0.35 + mom * 4)) WHEN 'distribution' THEN -0.55 WHEN 'decay' THEN -0.5
  ELSE 0 END, 6) AS lean, {rd('mom', 'accel', 'vol_exp')} FROM l2""")
def meme_lifecycle(spark, d):
    x = I.lifecycle(T.candles(spark, d))
    return x.select("product", F.unix_seconds("ts").alias("ts"), "phase",
                    *[r6(F.col(c)).alias(c) for c in ("lean", "mom", "accel", "vol_exp")])


@query("A59", CANDLES + f""", h AS (SELECT product, ts, volume, first_value(volume) OVER {fr(30)} AS old FROM candles)
SELECT product, {EPOCH}, round((volume - old) / CASE WHEN old > 1e-6 THEN old ELSE 1 END, 6) AS hype_vel FROM h""")
def hype_velocity(spark, d):
    return out(I.hype_velocity(T.candles(spark, d), "product", "ts", "volume"), "hype_vel")


@query("A64", FEAT + f""", z AS (SELECT product, ts, rsi, atr, row_number() OVER {PW} AS n,
  avg(rsi) OVER p AS mr, stddev_samp(rsi) OVER p AS sr, avg(atr) OVER p AS ma, stddev_samp(atr) OVER p AS sa FROM features
  WINDOW p AS (PARTITION BY product ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT product, {EPOCH}, round(CASE WHEN n < 30 THEN rsi ELSE greatest(-3, least(3, (rsi - mr) /
  CASE WHEN sr > 1e-6 THEN sr ELSE 1 END)) END, 6) AS rsi_z, round(CASE WHEN n < 30 THEN atr ELSE
  greatest(-3, least(3, (atr - ma) / CASE WHEN sa > 1e-6 THEN sa ELSE 1 END)) END, 6) AS atr_z FROM z""")
def running_standardise(spark, d):
    return out(I.rolling_standardise(I.features(T.candles(spark, d)), ["rsi", "atr"]), "rsi_z", "atr_z")


@query("P8", CANDLES + f""", m AS (SELECT *, CASE WHEN row_number() OVER {PW} >= 20 THEN
  quantile_cont(close, 0.5) OVER {fr(60)} END AS med FROM candles)
SELECT product, {EPOCH}, round(med, 6) AS median60, CASE WHEN close <= 0 OR close IS NULL THEN 'no price'
  WHEN close < 101 THEN 'below minimum' WHEN med > 0 AND close > med * 1.2 THEN 'spiked'
  WHEN med > 0 AND close < med / 1.2 THEN 'collapsed' ELSE 'ok' END AS sanity FROM m""")
def price_sane(spark, d):
    x = I.price_sane(T.candles(spark, d), min_price=101, mult=1.2)
    return x.select("product", F.unix_seconds("ts").alias("ts"), r6(F.col("median60")).alias("median60"), "sanity")
