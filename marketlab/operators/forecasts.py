"""Prediction-market votes, sizing inputs, forecast ledger and settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.functions.mathx import clip, log_loss

ARMS = ("momentum", "mean_revert", "longshot_fade", "microstructure", "llm", "research")


def ttl_bucket(hours) -> Column:
    """Time-to-resolution bucket of the ledger."""
    return (F.when(hours.isNull(), "unknown").when(hours <= 1, "0-1h").when(hours <= 24, "1-24h").when(hours <= 168, "1-7d")
            .when(hours <= 720, "1-4w").otherwise(">1mo"))


def ttl_regime(hours) -> Column:
    """Regime bucket of the learner."""
    return F.when(hours.isNull(), "unknown").when(hours <= 24, "<1d").when(hours <= 168, "1-7d").when(hours <= 720, "1-4w").otherwise(">1mo")


def retry_delay(attempts) -> Column:
    """Seconds until the next poll."""
    return F.when(attempts >= 4, 3600).when(attempts == 3, 960).when(attempts == 2, 480).when(attempts == 1, 240).otherwise(120)


def pending(df: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Due unresolved forecasts, undated last; the first `limit` where given."""
    x = df.where(F.col("resolved_outcome0").isNull() & (F.col("next_poll") <= now) & (F.col("due").isNull() | (F.col("due") <= now + 6 * 3600)))
    x = x.orderBy(F.asc_nulls_last("due"), "forecast_ts", "id")
    return x if limit is None else x.limit(max(1, limit))


def market_leans(df: DataFrame, gain=6.0, revert=8.0, revert_at=0.05, longshot=2.0, longshot_at=0.15, micro=10.0) -> DataFrame:
    """Leans in [-1, 1] toward outcome 0 from price p0, its 1-hour and 1-day moves, the last trade and advisors."""
    p0, h1, d1 = F.col("p0"), F.col("mom_1h"), F.col("mom_1d")
    dist = p0 - 0.5
    return df.withColumns({
        "momentum": clip((0.5 * h1 + 0.5 * d1) * gain),
        "mean_revert": F.when(F.abs(h1) > revert_at, clip(-h1 * revert)).otherwise(0.0),
        "longshot_fade": F.when(F.abs(dist) > longshot_at, clip(F.signum(dist) * F.least(F.abs(dist) * longshot, F.lit(1.0)))).otherwise(0.0),
        "microstructure": clip((F.col("last_trade") - p0) * micro),
        "llm": clip(F.coalesce("llm_lean", F.lit(0.0))), "research": clip(F.coalesce("research_lean", F.lit(0.0)))})


def market_vote(df: DataFrame, weights: dict[str, float] | None = None, edge_scale=0.06, boost: dict[str, float] | None = None) -> DataFrame:
    """Net lean, agreement, confidence, chosen outcome, fair price and edge. A silent research arm has no weight."""
    w = {a: abs((weights or {}).get(a, 1.0)) * max(1.0, (boost or {}).get(a, 1.0)) for a in ARMS}
    on = {a: (F.abs(F.col(a)) > 1e-6) if a == "research" else F.lit(True) for a in ARMS}
    num = den = None
    for a in ARMS:
        n, d = F.when(on[a], w[a] * F.col(a)).otherwise(0.0), F.when(on[a], w[a]).otherwise(0.0)
        num, den = (n, d) if num is None else (num + n, den + d)
    x = df.withColumn("net_lean", clip(num / F.when(den != 0, den).otherwise(1.0)))
    net, act, same = F.col("net_lean"), None, None
    for a in ARMS:
        v = F.abs(F.col(a)) > 1e-6
        s = (v & ((F.col(a) > 0) == (net > 0))).cast("int")
        act, same = (v.cast("int"), s) if act is None else (act + v.cast("int"), same + s)
    x = x.withColumn("agreement", F.when((act > 0) & (F.abs(net) > 1e-6), same / act).otherwise(0.0))
    fair0 = clip(F.col("p0") + net * edge_scale, 0.001, 0.999)
    x = x.withColumns({"confidence": clip(F.abs(net) * F.col("agreement"), 0.0, 1.0), "fair_p0": fair0})
    zero = net >= 0
    x = x.withColumns({"outcome_index": F.when(F.abs(net) > 1e-6, F.when(zero, 0).otherwise(1)),
                       "price": F.when(zero, F.col("p0")).otherwise(F.col("p1")),
                       "fair": F.when(zero, F.col("fair_p0")).otherwise(clip(1 - F.col("fair_p0"), 0.001, 0.999))})
    return x.withColumn("edge", F.col("fair") - F.col("price"))


def forecast_metrics(f: DataFrame) -> DataFrame:
    """Brier score and log loss of the forecasts and of the market, counts and differences."""
    y, res = F.col("resolved_outcome0"), F.col("resolved_outcome0").isNotNull()
    b, m = clip(F.col("predicted_p0"), 0, 1), clip(F.col("market_p0"), 0, 1)

    def mean(c):
        return F.avg(F.when(res, c))

    x = f.agg(F.count(F.lit(1)).alias("forecast_count"), F.sum(res.cast("int")).alias("scored"), mean(F.pow(b - y, 2)).alias("bot_brier"),
              mean(F.pow(m - y, 2)).alias("market_brier"), mean(log_loss(b, y)).alias("bot_log_loss"), mean(log_loss(m, y)).alias("market_log_loss"))
    return x.withColumns({"brier_delta": F.col("bot_brier") - F.col("market_brier"), "log_loss_delta": F.col("bot_log_loss") - F.col("market_log_loss")})


def strategy_forecasts(f: DataFrame, edge_scale=0.06) -> DataFrame:
    """Brier and log loss per strategy over the forecasts it had a lean on."""
    x = f.where(F.col("resolved_outcome0").isNotNull()).select("resolved_outcome0", "market_p0", F.explode("votes").alias("strategy", "lean"))
    x = x.where(F.abs("lean") >= 1e-6).withColumn("p", clip(F.col("market_p0") + F.col("lean") * edge_scale, 0, 1))
    y = F.col("resolved_outcome0")
    return x.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("p") - y, 2)).alias("brier"), F.avg(log_loss(F.col("p"), y)).alias("log_loss"),
                                     (F.avg(F.pow(F.col("p") - y, 2)) - F.avg(F.pow(F.col("market_p0") - y, 2))).alias("brier_delta_vs_market"))


def settle(positions: DataFrame, resolutions: DataFrame, key="condition_id") -> DataFrame:
    """Payoff 1 or 0 per share of positions in resolved markets (closed, price at an extreme)."""
    done = F.col("closed") & ((F.greatest("r0", "r1") >= 0.99) | (F.least("r0", "r1") <= 0.01))
    win = F.when(F.col("r0") >= F.col("r1"), 0).otherwise(1)
    r = resolutions.where(done).select(key, win.alias("winning_index"))
    pay = F.when(F.col("winning_index") == F.col("outcome_index"), F.col("shares")).otherwise(0.0)
    x = positions.join(r, key).withColumn("payoff", pay).withColumn("pnl", F.col("payoff") - F.col("cost"))
    return x.withColumn("return_pct", F.when(F.col("cost") != 0, F.col("pnl") / F.col("cost")).otherwise(0.0))
