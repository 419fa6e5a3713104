"""Chart patterns per bar over the last 300 bars.

A swing pivot is an extreme of the three bars on each side, so it is used from three bars later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlab.functions.mathx import clip
from marketlab.operators.folds import wilder_rsi

K = 3
SPAN = 300
TOL = 0.02
MIN_BARS = 40
FLAT = 3e-4

# Weights of the detector scores in the overall lean, and in an exit threat.
LEAN_WEIGHTS = {"pat_structure": 0.30, "pat_sr": 0.15, "pat_reversal": 0.25,
                "pat_continuation": 0.15, "pat_candle": 0.10, "pat_divergence": 0.20}
THREAT_WEIGHTS = {"pat_reversal": 0.45, "pat_divergence": 0.30, "pat_candle": 0.25}
BACKDROP = ("Testing support", "Testing resistance", "Range / no clear structure")


def pivots(bars: DataFrame, keys="product", ts="ts") -> DataFrame:
    """Arrays `ph` / `pl` of the swing highs and lows known at each bar."""
    part = [keys] if isinstance(keys, str) else list(keys)
    w = W.partitionBy(*part).orderBy(ts)
    near = w.rowsBetween(-2 * K, 0)
    x = bars.withColumn("rn", F.row_number().over(w))
    x = x.withColumns({"_h": F.lag("high", K).over(w), "_l": F.lag("low", K).over(w),
                       "_r": F.lag("rsi_wilder", K).over(w),
                       "_mh": F.max("high").over(near), "_ml": F.min("low").over(near)})
    known = F.col("rn") > 2 * K

    def point(p):
        return F.struct((F.col("rn") - K).alias("i"), F.col(p).alias("p"), F.col("_r").alias("r"))

    x = x.withColumns({"new_ph": F.when(known & (F.col("_h") >= F.col("_mh")), point("_h")),
                       "new_pl": F.when(known & (F.col("_l") <= F.col("_ml")), point("_l"))})
    frame = w.rowsBetween(-(SPAN - 1 - 2 * K), 0)
    return x.withColumns({"ph": F.collect_list("new_ph").over(frame),
                          "pl": F.collect_list("new_pl").over(frame),
                          "po": F.lag("open").over(w), "pc": F.lag("close").over(w)}
                         ).drop("_h", "_l", "_r", "_mh", "_ml")


def back(arr: str, k: int, field: str) -> Column:
    return F.try_element_at(F.col(arr), F.lit(-k))[field]


def same_level(a, b, tol=TOL) -> Column:
    return F.abs(a - b) / ((F.abs(a) + F.abs(b)) / 2) <= tol


def slope(arr: str) -> Column:
    """Least-squares slope through the last three (or two) pivots."""
    x = [back(arr, k, "i") for k in (3, 2, 1)]
    y = [back(arr, k, "p") for k in (3, 2, 1)]
    mx = (x[0] + x[1] + x[2]) / 3
    three = (sum(((a - mx) * b for a, b in zip(x[1:], y[1:])), (x[0] - mx) * y[0])
             / sum(((a - mx) * (a - mx) for a in x[1:]), (x[0] - mx) * (x[0] - mx)))
    return F.when(F.size(arr) >= 3, three).when(F.size(arr) == 2, (y[2] - y[1]) / (x[2] - x[1]))


def level_sum(arr: str) -> Column:
    s = back(arr, 2, "p") + back(arr, 1, "p")
    return F.when(F.size(arr) >= 3, s + back(arr, 3, "p")).otherwise(s)


def detect(bars: DataFrame, keys="product", ts="ts") -> DataFrame:
    """Scores, detected list, lean, structure and exit threats for every bar."""
    x = pivots(wilder_rsi(bars, keys=keys, ts=ts), keys, ts)
    h1, h2, l1, l2 = back("ph", 2, "p"), back("ph", 1, "p"), back("pl", 2, "p"), back("pl", 1, "p")
    price = F.col("close")
    two = (F.size("ph") >= 2) & (F.size("pl") >= 2)
    up, down = two & (h2 > h1) & (l2 > l1), two & (h2 < h1) & (l2 < l1)
    x = x.withColumn("pat_structure", F.when(up, 1.0).when(down, -1.0).otherwise(0.0))

    res = F.array_min(F.filter(F.transform("ph", lambda s: s["p"]), lambda p: p > F.col("close")))
    sup = F.array_max(F.filter(F.transform("pl", lambda s: s["p"]), lambda p: p < F.col("close")))
    x = x.withColumns({"_res": res, "_sup": sup})
    band = F.col("_res") - F.col("_sup")
    x = x.withColumn("_pos", F.when(band > 1e-9, (price - F.col("_sup")) / band))
    x = x.withColumn("pat_sr", F.when(F.col("_pos").isNotNull(), clip(1 - 2 * F.col("_pos"))).otherwise(0.0))

    def apart(arr):
        return back(arr, 1, "i") - back(arr, 2, "i") >= K

    h0, l0 = back("ph", 3, "p"), back("pl", 3, "p")
    x = x.withColumns({
        "_dt": F.coalesce(same_level(h1, h2) & apart("ph") & (price < F.least(h1, h2)), F.lit(False)),
        "_db": F.coalesce(same_level(l1, l2) & apart("pl") & (price > F.greatest(l1, l2)), F.lit(False)),
        "_hs": F.coalesce((h1 > h0) & (h1 > h2) & same_level(h0, h2, TOL * 1.5), F.lit(False)),
        "_ih": F.coalesce((l1 < l0) & (l1 < l2) & same_level(l0, l2, TOL * 1.5), F.lit(False)),
        "_top": slope("ph"), "_bot": slope("pl"),
        "_avg": (level_sum("ph") + level_sum("pl")) / (F.least(F.size("ph"), F.lit(3)) + F.least(F.size("pl"), F.lit(3)))})

    def val(c, v):
        return F.when(F.col(c), F.lit(v)).otherwise(0.0)

    x = x.withColumn("pat_reversal", clip(clip(val("_db", 0.9) - val("_dt", 0.9))
                                          + clip(val("_ih", 0.85) - val("_hs", 0.85))))
    t, b = F.col("_top") / F.col("_avg"), F.col("_bot") / F.col("_avg")
    x = x.withColumn("_tri", F.when(~two, None).when((F.abs(t) < FLAT) & (b > FLAT), "Ascending triangle")
                     .when((F.abs(b) < FLAT) & (t < -FLAT), "Descending triangle")
                     .when((t > FLAT) & (b > FLAT) & (b > t), "Rising wedge")
                     .when((t < -FLAT) & (b < -FLAT) & (b > t), "Falling wedge"))
    tri = F.col("_tri")
    x = x.withColumn("pat_continuation", F.when(tri == "Ascending triangle", 0.6)
                     .when(tri == "Descending triangle", -0.6).when(tri == "Rising wedge", -0.5)
                     .when(tri == "Falling wedge", 0.5).otherwise(0.0))

    o, c, po, pc, st = F.col("open"), price, F.col("po"), F.col("pc"), F.col("pat_structure")
    rng = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1e-9)
    body, upper, lower = F.abs(c - o), F.col("high") - F.greatest(o, c), F.least(o, c) - F.col("low")
    x = x.withColumns({
        "_be": F.coalesce((pc < po) & (c > o) & (c >= po) & (o <= pc), F.lit(False)),
        "_se": F.coalesce((pc > po) & (c < o) & (c <= po) & (o >= pc), F.lit(False)),
        "_hm": (body < 0.35 * rng) & (lower > 2 * body) & (upper < body) & (st <= 0),
        "_ss": (body < 0.35 * rng) & (upper > 2 * body) & (lower < body) & (st >= 0),
        "_dj": body < 0.1 * rng,
        "_bd": F.coalesce((l2 < l1) & (back("pl", 1, "r") > back("pl", 2, "r") + 2), F.lit(False)),
        "_sd": F.coalesce((h2 > h1) & (back("ph", 1, "r") < back("ph", 2, "r") - 2), F.lit(False))})
    x = x.withColumns({
        "pat_candle": clip(val("_be", 0.7) - val("_se", 0.7) + val("_hm", 0.5) - val("_ss", 0.5)),
        "pat_divergence": clip(val("_bd", 0.7) - val("_sd", 0.7))})
    lean = sum((F.col(k) * w for k, w in LEAN_WEIGHTS.items()), F.lit(0.0))
    x = x.withColumns({
        "pat_lean": clip(lean),
        "structure": F.when(st > 0.5, "uptrend").when(st < -0.5, "downtrend").otherwise("range"),
        "detected": detected(two, up, down)})
    x = threats(x)
    warm = F.col("rn") >= MIN_BARS
    zero = [*LEAN_WEIGHTS, "pat_lean", "threat_long", "threat_short"]
    x = x.withColumns({n: F.when(warm, F.col(n)).otherwise(0.0) for n in zero})
    x = x.withColumns({"structure": F.when(warm, F.col("structure")).otherwise("unknown"),
                       "detected": F.when(warm, F.col("detected")).otherwise(F.slice("detected", 1, 0)),
                       "threat_long_name": F.when(warm, F.col("threat_long_name")).otherwise(""),
                       "threat_short_name": F.when(warm, F.col("threat_short_name")).otherwise("")})
    return x.drop(*[n for n in x.columns if n.startswith("_") and n not in ("_piece", "_warm", "_rn")])


def detected(two, up, down) -> Column:
    """Detected patterns, strongest first, ties in detector order."""
    tri, pos = F.col("_tri"), F.col("_pos")
    found = [(up, "Uptrend structure (HH/HL)", "bullish", 0.7), (down, "Downtrend structure (LH/LL)", "bearish", 0.7),
             (two & ~up & ~down, "Range / no clear structure", "neutral", 0.3),
             (pos <= 0.15, "Testing support", "bullish", 0.5), (pos >= 0.85, "Testing resistance", "bearish", 0.5),
             (F.col("_dt"), "Double top", "bearish", 0.8), (F.col("_db"), "Double bottom", "bullish", 0.8),
             (F.col("_hs"), "Head & shoulders", "bearish", 0.75),
             (F.col("_ih"), "Inverse head & shoulders", "bullish", 0.75),
             (tri == "Ascending triangle", "Ascending triangle", "bullish", 0.6),
             (tri == "Descending triangle", "Descending triangle", "bearish", 0.6),
             (tri == "Rising wedge", "Rising wedge", "bearish", 0.5),
             (tri == "Falling wedge", "Falling wedge", "bullish", 0.5),
             (F.col("_be"), "Bullish engulfing", "bullish", 0.6), (F.col("_se"), "Bearish engulfing", "bearish", 0.6),
             (F.col("_hm"), "Hammer", "bullish", 0.5), (F.col("_ss"), "Shooting star", "bearish", 0.5),
             (F.col("_dj"), "Doji", "neutral", 0.3), (F.col("_bd"), "Bullish RSI divergence", "bullish", 0.6),
             (F.col("_sd"), "Bearish RSI divergence", "bearish", 0.6)]
    items = [F.when(cond, F.struct(F.lit(-strength).alias("neg"), F.lit(i).alias("ord"),
                                   F.lit(name).alias("name"), F.lit(way).alias("direction"),
                                   F.lit(strength).alias("strength")))
             for i, (cond, name, way, strength) in enumerate(found)]
    ranked = F.array_sort(F.array_compact(F.array(*items)))
    return F.transform(ranked, lambda s: F.struct(s["name"].alias("name"), s["direction"].alias("direction"),
                                                  s["strength"].alias("strength")))


def threats(x: DataFrame) -> DataFrame:
    """Evidence against an open long / short, and the strongest contrary pattern."""
    for side, name, contrary in ((1, "long", "bearish"), (-1, "short", "bullish")):
        total = sum((w * F.greatest(F.lit(0.0), -side * F.col(k)) for k, w in THREAT_WEIGHTS.items()), F.lit(0.0))
        hits = F.filter("detected", lambda s: (s["direction"] == contrary) & ~s["name"].isin(*BACKDROP))
        x = x.withColumns({f"threat_{name}": clip(total, 0.0, 1.0),
                           f"threat_{name}_name": F.coalesce(F.try_element_at(hits, F.lit(1))["name"], F.lit(""))})
    return x
