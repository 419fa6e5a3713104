"""Strategy scores, vote blending, entry gates, sizing and model inputs, all as projections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.functions.mathx import clip
from marketlab.operators.scans import pin, row_index


def total(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def ema_side() -> Column:
    return F.when(F.col("ema12") > F.col("ema26"), 1.0).otherwise(-1.0)


def range_pos() -> Column:
    span = F.col("hi20") - F.col("lo20")
    return (F.col("price") - F.col("lo20")) / F.when(span != 0, span).otherwise(1e-9)


# ---- strategies (W30, X1): name -> score in [-1, 1] ----

def trend() -> Column:
    base = ema_side() * 0.45
    score = (base + clip(F.col("macd_delta") / (F.col("atr") * 0.25 + 1e-9)) * 0.3
             + clip(F.col("mom_4h") / 0.02) * 0.25 + clip(F.col("align")) * 0.2)
    return F.when(base * F.col("align") < 0, score * 0.6).otherwise(score)


def meanrev() -> Column:
    r = F.col("rsi")
    s = F.when(r < 30, (30 - r) / 30).when(r > 70, -(r - 70) / 30).otherwise(0.0)
    return clip(F.when(F.col("trend").isin("bull", "bear"), s * 0.5).otherwise(s) * 1.4)


def breakout() -> Column:
    extra = F.least(F.lit(0.4), (F.col("vol_ratio") - 1.2) * 0.4)
    hot = F.col("vol_ratio") > 1.2
    return clip(F.when((range_pos() > 0.985) & hot, 0.6 + extra)
                .when((range_pos() < 0.015) & hot, -0.6 - extra).otherwise(0.0))


def sentiment() -> Column:
    s = clip(F.col("sent") * 1.6) * 0.7 + clip(F.col("mom_1h") / 0.01) * 0.3
    return clip(F.when(F.col("n_docs") == 0, s * 0.5).otherwise(s))


def microstructure() -> Column:
    s = clip(F.col("imbalance") * 2.2)
    return F.when(F.col("spread_bps") > 8, s * 0.4).otherwise(s)


def derivatives() -> Column:
    s = (F.col("funding_norm") * -0.35 + ema_side() * F.greatest(F.lit(0.0), F.col("oi_change_norm")) * 0.30
         - F.col("ls_crowding") * 0.15 + F.col("taker_aggression") * 0.20)
    return F.coalesce(clip(s), F.lit(0.0))


STRATEGIES = {"trend": trend, "meanrev": meanrev, "breakout": breakout, "sentiment": sentiment,
              "microstructure": microstructure, "derivatives": derivatives}


def score_strategies(f: DataFrame, strategies=None) -> DataFrame:
    """One `s_<name>` column per registered strategy, clipped."""
    reg = strategies or STRATEGIES
    return f.withColumns({f"s_{n}": clip(fn()) for n, fn in reg.items()})


def derivative_features(df: DataFrame, age=None, max_age: float = 900) -> DataFrame:
    """Funding, open-interest change, crowding and taker aggression on a [-1, 1] scale."""
    cols = {"funding_norm": F.col("funding_rate") / 0.0005, "oi_change_norm": F.col("oi_change_24h") / 0.10,
            "ls_crowding": (F.col("long_short_ratio") - 1.0) / 1.2,
            "taker_aggression": (F.col("taker_buy_ratio") - 0.5) * 8}
    fresh = F.lit(True) if age is None else age <= max_age
    return df.withColumns({n: F.when(fresh, clip(c)) for n, c in cols.items()})


def composite_vote(df: DataFrame, names, weights: dict[str, float], boost: dict[str, float] | None = None,
                   floor: tuple[str, float] | None = None, prefix="s_") -> DataFrame:
    """Weighted mean of the votes with |s| > 0.05, their agreement, breadth and confidence.

    `boost` multiplies arms' weights; `floor` = (arm, share) lifts one arm to a minimum share.
    """
    boost = boost or {}
    act = {n: F.abs(F.col(prefix + n)) > 0.05 for n in names}
    eff = {n: F.when(act[n], F.lit(weights.get(n, 0.0) * boost.get(n, 1.0))).otherwise(0.0) for n in names}
    if floor:
        arm, share = floor
        wtmp = total(eff.values())
        others = wtmp - eff[arm]
        eff[arm] = F.when(act[arm] & (eff[arm] < share * wtmp), share * others / max(1e-9, 1 - share)).otherwise(eff[arm])
    x = df.withColumns({f"_w_{n}": eff[n] for n in names})
    wsum = total([F.col(f"_w_{n}") for n in names])
    n_act = total([act[n].cast("int") for n in names])
    x = x.withColumns({
        "n_active": n_act,
        "composite": F.when(n_act > 0, total([F.col(f"_w_{n}") * F.col(prefix + n) for n in names])
                            / F.when(wsum != 0, wsum).otherwise(1e-9)).otherwise(0.0)})
    agree = total([(act[n] & (F.col(prefix + n) * F.col("composite") > 0)).cast("int") for n in names])
    x = x.withColumn("agreement", F.when(F.col("n_active") > 0, agree / F.col("n_active")).otherwise(0.0))
    breadth = F.least(F.lit(1.0), F.col("n_active") / 3)
    conf = F.least(F.lit(1.0), F.abs("composite") * (0.4 + 0.6 * F.col("agreement")) * (0.6 + 0.4 * breadth))
    return x.withColumn("confidence", conf).drop(*[f"_w_{n}" for n in names])


def decide(df: DataFrame, gate: float = 0.35, explore: float = 0.2, shorts: bool = True, atr="atr") -> DataFrame:
    """Direction, edge, whether to act or explore, and the stop two ATRs away."""
    way = F.when(F.col("composite") > 0, 1).otherwise(-1)
    ok = F.lit(True) if shorts else F.col("direction") > 0
    return (df.withColumn("direction", way).withColumns({
        "edge_bps": F.round(F.col("composite") * 25, 1),
        "actionable": (F.col("confidence") >= gate) & ok,
        "explorable": (F.col("confidence") >= explore) & (F.col("confidence") < gate) & ok,
        "stop": F.round(F.col("price") - F.col("direction") * 2 * F.col(atr), 6)}))


def evolved_vote(df: DataFrame, p: dict) -> DataFrame:
    """Live score of one parameter set."""
    up = (F.col("ema12") > F.col("ema26")) if p["ema_fast"] < p["ema_slow"] else F.lit(True)
    pos, rsi, mom = range_pos(), F.col("rsi"), F.col("mom_1h")
    long = (F.lit(0.35) + F.when(pos > 0.97, 0.4).otherwise(0.0) + F.when(rsi < p["rsi_buy"], 0.35).otherwise(0.0))
    if p.get("short_w", 0) > 0.5:
        short = (F.when(pos < 0.03, -0.4).otherwise(0.0) + F.when(rsi > p.get("rsi_sell", 70), -0.35).otherwise(0.0)
                 + F.when(F.col("ema12") < F.col("ema26"), -0.35).otherwise(0.0))
    else:
        short = F.when(rsi > 70, -0.3).otherwise(0.0)
    if p.get("mom_w", 0) > 0.5:
        long = F.when(mom <= 0, long * 0.4).otherwise(long)
        if p.get("short_w", 0) > 0.5:
            short = F.when(mom >= 0, short * 0.4).otherwise(short)
    return df.withColumn("vote", clip(F.when(up, long).otherwise(short)))


def derive_rule_features(df: DataFrame) -> DataFrame:
    """The bounded features the rule language may refer to."""
    return df.withColumns({
        "pos20": clip(range_pos(), 0.0, 1.0),
        "macd_norm": clip(F.col("macd_delta") / F.when(F.col("atr") != 0, F.col("atr")).otherwise(1e-9), -5.0, 5.0),
        "ema_cross": ema_side()})


PATTERN_COLS = ("pat_structure", "pat_sr", "pat_reversal", "pat_continuation", "pat_candle", "pat_divergence")


def ml_vector(df: DataFrame, name="x") -> DataFrame:
    """The 26 model inputs in fixed order, clipped and pre-scaled; absent inputs are zero."""
    def col(n):
        return F.coalesce(F.col(n), F.lit(0.0)) if n in df.columns else F.lit(0.0)

    atr = F.when(F.col("atr") != 0, F.col("atr")).otherwise(1e-9)
    xs = [F.col("rsi") / 100 - 0.5, clip(F.col("macd") / atr, -3, 3),
          clip(F.col("macd_delta") / (0.25 * atr + 1e-9), -3, 3), clip(F.col("mom_1h") * 100, -3, 3),
          clip(F.col("mom_4h") * 50, -3, 3), clip(F.col("vol_ratio") - 1, -2, 2), clip(col("imbalance")),
          F.least(F.lit(2.0), col("spread_bps") / 10), clip(col("sent")), clip(col("market_sent")),
          clip((F.col("price") / F.col("sma20") - 1) * 100, -3, 3),
          clip((F.col("sma20") / F.col("sma50") - 1) * 100, -3, 3), F.least(F.lit(3.0), F.col("volatility") * 300),
          col("funding_norm"), col("oi_change_norm"), col("ls_crowding"), col("taker_aggression"), clip(col("align")),
          *[clip(col(p)) for p in PATTERN_COLS], clip(col("llm_lean")), clip(col("model_lean"))]
    return df.withColumn(name, F.array(*[c.cast("double") for c in xs]))


# ---- gates and sizing ----

def entry_gates(df: DataFrame, max_spread=0.0, funding_extreme=0.0008) -> DataFrame:
    """Spread and funding gates; a missing reading never blocks."""
    wide = (F.col("spread_bps") > max_spread) if max_spread > 0 else F.lit(False)
    fr = F.col("funding_rate")
    crowded = ((F.col("direction") > 0) & (fr > funding_extreme)) | ((F.col("direction") < 0) & (fr < -funding_extreme))
    return df.withColumns({"spread_ok": ~F.coalesce(wide, F.lit(False)), "funding_ok": ~F.coalesce(crowded, F.lit(False))})


def cost_viability(df: DataFrame, take_mult=3.0, fee=0.005, slip_bps=10, multiple=2.5) -> DataFrame:
    """P10: does the take-profit distance clear the round-trip cost by `multiple`?"""
    need = (2 * fee + 2 * slip_bps / 1e4) * multiple * F.col("price")
    dist = take_mult * F.col("atr")
    return df.withColumns({"take_dist": dist, "min_take_dist": need,
                           "cost_reason": F.when(dist <= 0, "no volatility").when(dist < need, "below cost").otherwise("ok")})


def size_positions(df: DataFrame, equity: float, p: dict) -> DataFrame:
    """Notional risking a fixed share of equity to the stop, capped by position and liquidity.

    `liq_volume` is the volume of the last 288 bars and `liq_bars` their number (no cap below 12).
    """
    d = {"risk_per_trade": 0.0075, "stop_atr_mult": 2.0, "take_profit_atr_mult": 3.0, "fee_rate": 0.005,
         "slippage_bps": 10.0, "cost_multiple": 2.5, "max_position_pct": 0.20, "liq_cap_pct": 0.01,
         "risk_scale": 1.0, "risk_mult": 1.0, **p}
    price, conf = F.col("price"), F.col("confidence")
    ml = 0.4 + 0.6 * clip(F.col("ml_confidence"), 0.0, 1.0) if "ml_confidence" in df.columns else F.lit(1.0)
    risk = equity * d["risk_per_trade"] * d["risk_scale"] * d["risk_mult"] * (0.5 + conf / 2) * ml
    stop_dist, take_dist = d["stop_atr_mult"] * F.col("atr"), d["take_profit_atr_mult"] * F.col("atr")
    need = (2 * d["fee_rate"] + 2 * d["slippage_bps"] / 1e4) * d["cost_multiple"] * price
    cap = equity * d["max_position_pct"] * min(1.5, d["risk_mult"])
    liq = F.when(F.col("liq_bars") >= 12, F.col("liq_volume") * price * d["liq_cap_pct"])
    x = df.withColumns({"_sd": stop_dist, "_td": take_dist})
    ok = (F.col("_sd") > 0) & (F.col("_td") >= need)
    return x.withColumns({
        "notional": F.when(ok, F.least(risk / (F.col("_sd") / price), F.lit(cap), liq)).otherwise(0.0),
        "stop": F.when(ok, price - F.col("direction") * F.col("_sd")).otherwise(0.0),
        "take": F.when(ok, price + F.col("direction") * F.col("_td")).otherwise(0.0)}).drop("_sd", "_td")


def kelly_size(df: DataFrame, equity: float, cash: float, p: dict) -> DataFrame:
    """Fractional Kelly stake in a binary share, or 0 with the first reason to skip."""
    d = {"min_edge": 0.03, "confidence_gate": 0.15, "slippage": 0.005, "cost_multiple": 1.5, "kelly_fraction": 0.25,
         "max_position_pct": 0.05, "min_notional": 5.0, **p}
    edge, conf = F.col("edge"), F.col("confidence")
    need = (F.greatest(F.lit(0.0), F.col("spread")) + 2 * d["slippage"]) * d["cost_multiple"]
    pr, q = clip(F.col("price"), 0.001, 0.999), clip(F.col("price") + edge, 0.001, 0.999)
    k = (q - pr) / (1 - pr)
    stake = F.least(equity * d["kelly_fraction"] * k * (0.5 + conf / 2), F.lit(equity * d["max_position_pct"]), F.lit(cash))
    low = F.greatest(F.coalesce(F.col("min_order_size"), F.lit(5.0)), F.lit(d["min_notional"]))
    x = df.withColumns({"_k": k, "_stake": stake, "_low": low})
    reason = (F.when(edge <= 0, "no edge").when(edge < d["min_edge"], "edge below min")
              .when(conf < d["confidence_gate"], "confidence below gate").when(edge < need, "edge below cost")
              .when(F.col("_k") <= 0, "kelly <= 0").when(F.col("_stake") < F.col("_low"), "stake below min").otherwise("ok"))
    x = x.withColumn("reason", reason)
    return x.withColumn("stake", F.when(F.col("reason") == "ok", F.round("_stake", 2)).otherwise(0.0)).drop("_k", "_stake", "_low")


def exit_levels(price, take=0.15, stop=0.20):
    """P25: early exit levels of a probability price."""
    return F.greatest(F.lit(0.001), price - stop), F.least(F.lit(0.999), price + take)


def round_to_venue(df: DataFrame, specs: dict[str, tuple[str, str, str]], default=("0.01", "0.00000001", "1")) -> DataFrame:
    """Price to the tick half-up, quantity down to the lot, minimum notional check.

    `specs` maps product -> (tick, step, min notional); it is folded into the projection.
    """
    def pick(i):
        c = None
        for prod, s in specs.items():
            hit = F.col("product") == prod
            v = F.lit(s[i]).cast("decimal(20,10)")
            c = F.when(hit, v) if c is None else c.when(hit, v)
        dflt = F.lit(default[i]).cast("decimal(20,10)")
        return dflt if c is None else c.otherwise(dflt)

    x = df.withColumns({"_tick": pick(0), "_step": pick(1), "_min": pick(2),
                        "_p": F.col("price").cast("decimal(20,8)"), "_q": F.col("qty").cast("decimal(20,8)")})
    price = (F.floor(F.col("_p") / F.col("_tick") + F.lit(0.5).cast("decimal(2,1)")) * F.col("_tick"))
    qty = F.floor(F.col("_q") / F.col("_step")) * F.col("_step")
    return x.withColumns({"venue_price": price.cast("double"), "venue_qty": qty.cast("double"),
                          "min_notional_ok": (F.col("_q") * F.col("_p")) >= F.col("_min")}
                         ).drop("_tick", "_step", "_min", "_p", "_q")


def position_state(side, pnl_pct, ml_pos, trend_c, vol_state, atr_pct) -> Column:
    """State key of an open position."""
    st = side * F.when(trend_c == "bull", 1).when(trend_c == "bear", -1).otherwise(0)
    unit = F.greatest(atr_pct, F.lit(0.002))
    return F.struct(
        F.when(st > 0, "with").when(st < 0, "against").otherwise("neutral").alias("side_trend"),
        F.when(pnl_pct >= 0, "win").when(pnl_pct > -unit, "small_loss").otherwise("big_loss").alias("pnl_bucket"),
        F.when(ml_pos > 0.05, "fav").when(ml_pos < -0.05, "adv").otherwise("flat").alias("model_view"),
        vol_state.alias("vol"))


def ranked(rows: DataFrame, by: str, tie: Sequence[str], where: str = "true", top: int | None = None, name: str = "place") -> DataFrame:
    """K4: place of every row that meets `where` by `by`, largest first, ties in order of `tie`; only the first `top` where given.

    The rows are written once, before the condition, and numbered in slices of the value, so no task holds them all.
    """
    x = pin(rows).where(where).withColumn("_down", -F.col(by)).withColumn("_band", F.floor(F.col("_down") * 1024))
    x = row_index(x, ["_down", *tie], chunks=["_band"], name=name).drop("_down", "_band")
    return x if top is None else x.where(F.col(name) <= top)
