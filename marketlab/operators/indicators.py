"""Technical indicators as window expressions over `partitionBy(key).orderBy(ts)`.

A key's bars are bounded by time span over bar width (a decade of minutes is 5 million rows), so
one window task per key holds; for finer data wrap an operator with `scans.trailing_chunks`.
Frames only look back, so later bars never change an earlier row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlab.functions.mathx import clip
from marketlab.operators import bars as B

MIN_BARS = 60


def by_time(keys="product", ts="ts"):
    keys = [keys] if isinstance(keys, str) else list(keys)
    return W.partitionBy(*keys).orderBy(ts)


class Series:
    """Window expressions of one ordered series."""

    def __init__(self, keys="product", ts="ts"):
        self.w = by_time(keys, ts)

    def tail(self, n: int, to: int = 0):
        return self.w.rowsBetween(-(n - 1) + to, to)

    def lag(self, c, n=1) -> Column:
        return F.lag(c, n).over(self.w)

    def sma(self, c, n) -> Column:
        return F.avg(c).over(self.tail(n))

    def ema(self, c, n) -> Column:
        """EMA reseeded at the window start, i.e. a fixed set of n weights."""
        k = 2 / (n + 1)
        acc = F.col(c) * k
        for j in range(1, n):
            weight = (1 - k) ** j * (k if j < n - 1 else 1.0)
            acc = acc + self.lag(c, j) * weight
        return acc

    def rownum(self) -> Column:
        return F.row_number().over(self.w)


def rsi_value(up, down) -> Column:
    return F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))


def true_range(prev_close="_pc") -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col(prev_close)),
                      F.abs(F.col("low") - F.col(prev_close)))


def features(bars: DataFrame, keys="product", warm: bool = True) -> DataFrame:
    """The shared feature core, all in two passes over one sort.

    With `warm` the bars before the 60th are dropped.
    """
    s = Series(keys)
    base = bars.withColumns({"_pc": s.lag("close"), "rn": s.rownum()})
    base = base.withColumns({
        "_up": F.greatest(F.col("close") - F.col("_pc"), F.lit(0.0)),
        "_down": F.greatest(F.col("_pc") - F.col("close"), F.lit(0.0)),
        "_tr": true_range(), "_lr": F.ln(F.col("close") / F.col("_pc"))})
    vsum = F.sum("volume").over(s.tail(20))
    out = base.withColumns({
        "price": F.col("close"),
        "rsi": rsi_value(F.avg("_up").over(s.tail(14)), F.avg("_down").over(s.tail(14))),
        "atr": F.avg("_tr").over(s.tail(14)),
        "sma20": s.sma("close", 20), "sma50": s.sma("close", 50),
        "ema12": s.ema("close", 12), "ema26": s.ema("close", 26),
        "volatility": F.stddev_samp("_lr").over(s.tail(60)),
        "hi20": F.max("high").over(s.tail(20)), "lo20": F.min("low").over(s.tail(20)),
        "vol_ratio": F.when(vsum != 0, F.col("volume") / (vsum / 20)).otherwise(1.0),
        "mom_1h": F.coalesce(F.col("close") / s.lag("close", 12) - 1, F.lit(0.0)),
        "mom_4h": F.coalesce(F.col("close") / s.lag("close", 48) - 1, F.lit(0.0))})
    out = out.withColumn("macd", F.col("ema12") - F.col("ema26"))
    out = out.withColumn("macd_delta", F.col("macd") - s.lag("macd"))
    out = out.drop("_pc", "_up", "_down", "_tr", "_lr")
    return out.where(F.col("rn") >= MIN_BARS) if warm else out


def regime_label(f: DataFrame) -> DataFrame:
    """Trend from SMA20 against SMA50 with a 0.2 % band, volatility state above 0.004."""
    trend = (F.when(F.col("sma20") > F.col("sma50") * 1.002, "bull")
             .when(F.col("sma20") < F.col("sma50") * 0.998, "bear").otherwise("sideways"))
    vol = F.when(F.col("volatility") > 0.004, "high-vol").otherwise("normal")
    return (f.withColumns({"trend": trend, "vol_state": vol})
            .withColumn("regime", F.concat_ws("/", "trend", "vol_state")))


def breakout_levels(bars: DataFrame, n: int, keys="product") -> DataFrame:
    """Highest high and lowest low of the n bars before this one."""
    s = Series(keys)
    full = F.when(s.rownum() > n, True)
    return bars.withColumns({
        "brk_up": F.when(full, F.max("high").over(s.tail(n, -1))),
        "brk_dn": F.when(full, F.min("low").over(s.tail(n, -1)))})


def efficiency_ratio(bars: DataFrame, n: int = 48, thresh: float = 0.35, keys="product") -> DataFrame:
    """Net move over path length of the last n steps, 0 while warming up; TREND / RANGE."""
    s = Series(keys)
    x = bars.withColumns({"_step": F.abs(F.col("close") - s.lag("close")), "_rn": s.rownum()})
    path = F.sum("_step").over(s.tail(n))
    er = F.when((F.col("_rn") > n) & (path > 0), F.abs(F.col("close") - s.lag("close", n)) / path)
    return (x.withColumn("er", F.coalesce(er, F.lit(0.0)))
            .withColumn("er_regime", F.when((F.col("_rn") > n) & (F.col("er") >= thresh), "TREND")
                        .otherwise("RANGE")).drop("_step", "_rn"))


def atr_series(bars: DataFrame, n: int = 14, keys="product") -> DataFrame:
    """ATR and RSI by trailing means, zero until n earlier bars exist."""
    s = Series(keys)
    x = bars.withColumns({"_pc": F.coalesce(s.lag("close"), F.col("close")), "_rn": s.rownum()})
    x = x.withColumns({"_tr": true_range(), "_d": F.col("close") - F.col("_pc")})
    ok = F.col("_rn") > n
    up = F.avg(F.greatest(F.col("_d"), F.lit(0.0))).over(s.tail(n))
    down = F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(s.tail(n))
    return x.withColumns({"atr": F.when(ok, F.avg("_tr").over(s.tail(n))).otherwise(0.0),
                          "rsi": F.when(ok, rsi_value(up, down)).otherwise(0.0)}
                         ).drop("_pc", "_tr", "_d", "_rn")


def vol_norm(bars_atr: DataFrame, window: int = 72, keys="product") -> DataFrame:
    """ATR over the median ATR of the `window` bars before; 1 where undefined."""
    s = Series(keys)
    med = F.percentile("atr", F.lit(0.5)).over(s.tail(window, -1))
    return bars_atr.withColumn("vol_norm", F.when((s.rownum() > window) & (med > 0),
                                                  F.col("atr") / med).otherwise(1.0))


def mtf_trend(bars: DataFrame, folds=(3, 12, 48), key: str = "product") -> DataFrame:
    """Trend sign of EMA5 against EMA12 (0.1 % band) on folded bars at the newest bar, their
    mean as alignment, and the RSI of the middle fold."""
    out = bars.groupBy(key).agg(F.max("ts").alias("ts"))
    for n in folds:
        s = Series(key)
        f = B.fold_bars(bars, n, key).withColumns({"_pc": s.lag("close"), "_rn": s.rownum()})
        f = f.withColumns({"_f": s.ema("close", 5), "_s": s.ema("close", 12),
                           "_up": F.greatest(F.col("close") - F.col("_pc"), F.lit(0.0)),
                           "_down": F.greatest(F.col("_pc") - F.col("close"), F.lit(0.0))})
        sign = (F.when(F.col("_rn") < 12, 0.0).when(F.col("_f") > F.col("_s") * 1.001, 1.0)
                .when(F.col("_f") < F.col("_s") * 0.999, -1.0).otherwise(0.0))
        up, down = F.avg("_up").over(s.tail(14)), F.avg("_down").over(s.tail(14))
        rsi = F.when(F.col("_rn") < 15, 50.0).otherwise(rsi_value(up, down))
        last = f.select(key, "ts", sign.alias("_t"), rsi.alias("_r")).groupBy(key).agg(
            F.max_by("_t", "ts").alias(f"t{n}"), F.max_by("_r", "ts").alias(f"_r{n}"))
        out = out.join(last, key, "left")
    signs = [F.coalesce(F.col(f"t{n}"), F.lit(0.0)) for n in folds]
    return out.select(key, "ts", *[c.alias(f"t{n}") for c, n in zip(signs, folds)],
                      (sum(signs[1:], signs[0]) / len(folds)).alias("align"),
                      F.coalesce(F.col(f"_r{folds[1]}"), F.lit(50.0)).alias("rsi_mid"))


def swing_atr(bars: DataFrame, n: int = 12, period: int = 14, key: str = "product") -> DataFrame:
    """ATR on bars folded n to one at the newest bar; the native ATR when history is short."""
    def atr(df):
        s = Series(key)
        x = df.withColumns({"_pc": s.lag("close"), "_rn": s.rownum()}).withColumn("_tr", true_range())
        x = x.withColumn("_a", F.when(F.col("_rn") > period, F.avg("_tr").over(s.tail(period))))
        return x.groupBy(key).agg(F.max_by("_a", "ts").alias("_a"))

    return (bars.groupBy(key).agg(F.max("ts").alias("ts"))
            .join(atr(B.fold_bars(bars, n, key)).withColumnRenamed("_a", "_swing"), key, "left")
            .join(atr(bars), key, "left")
            .select(key, "ts", F.coalesce("_swing", "_a").alias("atr_swing")))


def lifecycle(bars: DataFrame, hype_vel=None, keys="product") -> DataFrame:
    """Hype phase per bar from 12-bar momentum, its change and volume expansion."""
    s = Series(keys)
    hv = F.lit(0.0) if hype_vel is None else hype_vel
    n = s.rownum()
    c12, c24 = s.lag("close", 12), s.lag("close", 24)
    base = F.avg("volume").over(s.w.rowsBetween(-47, -6))
    x = bars.withColumns({
        "_n": n, "_mom": F.col("close") / c12 - 1, "_prev": c12 / c24 - 1,
        "_rec": F.avg("volume").over(s.tail(6)), "_base": base, "hype_vel": hv})
    x = x.withColumns({"mom": F.col("_mom"), "accel": F.col("_mom") - F.col("_prev"),
                       "vol_exp": F.when(F.col("_base") > 1e-9, F.col("_rec") / F.col("_base"))
                       .otherwise(1.0)})
    m, a, v, h = F.col("mom"), F.col("accel"), F.col("vol_exp"), F.col("hype_vel")
    phase = (F.when(F.col("_n") < 26, "dormant")
             .when((m > 0.10) & (a > 0.04) & (v > 2.5), "blowoff")
             .when((m > 0.03) & (v > 1.3) & ((h >= 0) | (a > 0)), "markup")
             .when((a < -0.02) & (m > 0) & (v > 1.3), "distribution")
             .when((m < -0.03) & ((v < 1.0) | (h < 0)), "decay")
             .when((F.abs(m) < 0.015) & (v > 1.3) & (h > 0), "accumulation").otherwise("dormant"))
    x = x.withColumn("phase", phase)
    p = F.col("phase")
    lean = (F.when(p == "blowoff", -0.85)
            .when(p == "markup", clip(0.35 + m * 4 + F.greatest(F.lit(0.0), h) * 0.3))
            .when(p == "distribution", -0.55).when(p == "decay", -0.5)
            .when(p == "accumulation", 0.2).otherwise(0.0))
    return x.withColumn("lean", lean).drop("_n", "_mom", "_prev", "_rec", "_base")


def hype_velocity(samples: DataFrame, key="sym", ts="ts", heat="heat", n: int = 30) -> DataFrame:
    """Change of heat over the last n samples relative to the oldest of them."""
    w = W.partitionBy(key).orderBy(ts).rowsBetween(-(n - 1), 0)
    old = F.first(heat).over(w)
    return samples.withColumn("hype_vel", (F.col(heat) - old) / F.when(old > 1e-6, old).otherwise(1.0))


def rolling_standardise(df: DataFrame, cols, keys="product", ts="ts", guard: int = 30) -> DataFrame:
    """Z-score against all rows so far, clipped to 3; the raw value for the first `guard` rows."""
    w = W.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(ts)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    n = F.row_number().over(w)
    def z(c):
        sd = F.stddev_samp(c).over(run)
        return clip((F.col(c) - F.avg(c).over(run)) / F.when(sd > 1e-6, sd).otherwise(1.0), -3, 3)

    return df.withColumns({f"{c}_z": F.when(n < guard, F.col(c)).otherwise(z(c)) for c in cols})


def price_sane(bars: DataFrame, min_price=0.01, mult=3.0, keys="product") -> DataFrame:
    """Price floor and band around the median of the last 60 closes (once 20 exist)."""
    s = Series(keys)
    med = F.when(s.rownum() >= 20, F.percentile("close", F.lit(0.5)).over(s.tail(60)))
    x = bars.withColumn("median60", med)
    c, m = F.col("close"), F.col("median60")
    reason = (F.when(c.isNull() | (c <= 0), "no price").when(c < min_price, "below minimum")
              .when((m > 0) & (c > m * mult), "spiked").when((m > 0) & (c < m / mult), "collapsed")
              .otherwise("ok"))
    return x.withColumn("sanity", reason)
