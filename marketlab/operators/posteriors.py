"""Regime x strategy posteriors, allocation weights and learned edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlab.operators.scans import row_index

from marketlab.functions.mathx import clip
from marketlab.operators.folds import fold_scalar

PRIOR_STD = 0.0015
MIN_OBS_STD = 0.0015
POOL_K = 6
POOL_MAX_OBS = 30
NET_EDGE_N = 25


def arms(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mergeable moments per arm: n, mean and sum of squared deviations m2."""
    return df.groupBy(*keys).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("mean"),
                                 (F.var_pop(value) * F.count(value)).alias("m2"))


def obs_var(n: Column, m2: Column, prior_std: float = PRIOR_STD, floor: float = MIN_OBS_STD) -> Column:
    """Observation variance, floored; the prior's with fewer than two observations."""
    return F.when(n >= 2, F.greatest(m2 / (n - 1), F.lit(floor ** 2))).otherwise(prior_std ** 2)


def conjugate(n, mean, m2, prior_mean=None, prior_var=None, prior_std: float = PRIOR_STD,
              floor: float = MIN_OBS_STD) -> tuple[Column, Column]:
    """Normal-Normal posterior mean and variance; the prior itself at n = 0."""
    pm = F.lit(0.0) if prior_mean is None else prior_mean
    pv = F.lit(prior_std ** 2) if prior_var is None else prior_var
    like = n / obs_var(n, m2, prior_std, floor)
    prec = 1 / pv + like
    return F.when(n > 0, (pm / pv + like * mean) / prec).otherwise(pm), F.when(n > 0, 1 / prec).otherwise(pv)


def pool_others(df: DataFrame, group: Sequence[str], prefix: str, own: bool = False) -> DataFrame:
    """Moments of a group of arms without (or, with `own`, including) the arm itself, from three window sums."""
    w = W.partitionBy(*group)
    minus = (lambda c: F.lit(0.0)) if own else (lambda c: c)
    q = F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")
    s = F.col("n") * F.col("mean")
    x = df.withColumns({"_n": F.sum("n").over(w) - minus(F.col("n")), "_s": F.sum(s).over(w) - minus(s), "_q": F.sum(q).over(w) - minus(q)})
    mean = F.when(F.col("_n") > 1e-9, F.col("_s") / F.col("_n"))
    x = x.withColumn(f"{prefix}_mean", mean)
    return x.withColumns({f"{prefix}_n": F.when(F.col("_n") > 1e-9, F.col("_n")).otherwise(0.0),
                          f"{prefix}_m2": F.greatest(F.lit(0.0), F.col("_q") - F.col("_n") * F.col(f"{prefix}_mean") * F.col(f"{prefix}_mean"))}
                         ).drop("_n", "_s", "_q")


def pooled_prior(prefix: str, prior_std: float = PRIOR_STD, floor: float = MIN_OBS_STD) -> tuple[Column, Column]:
    """A pool as cold-start prior: at most 30 observations' worth, widened by the between-group variance."""
    n = F.least(F.col(f"{prefix}_n"), F.lit(float(POOL_MAX_OBS)))
    mu, var = conjugate(n, F.coalesce(F.col(f"{prefix}_mean"), F.lit(0.0)), F.coalesce(F.col(f"{prefix}_m2"), F.lit(0.0)),
                        prior_std=prior_std, floor=floor)
    some = F.col(f"{prefix}_n") > 0
    return F.when(some, mu).otherwise(0.0), F.when(some, var + prior_std ** 2 * POOL_K / n).otherwise(prior_std ** 2)


def posteriors(a: DataFrame) -> DataFrame:
    """Posterior per (regime, strategy) with the other regimes as prior, and the net-edge flag."""
    x = pool_others(a, ["strategy"], "pool")
    pm, pv = pooled_prior("pool")
    x = x.withColumns({"_pm": pm, "_pv": pv})
    mu, var = conjugate(F.col("n"), F.col("mean"), F.col("m2"), F.col("_pm"), F.col("_pv"))
    se = F.sqrt(obs_var(F.col("n"), F.col("m2")) / F.col("n"))
    bad = (F.col("n") >= NET_EDGE_N) & (F.col("mean") < 0) & (F.col("mean") + se < 0)
    return x.withColumns({"post_mean": mu, "post_sd": F.sqrt(var), "net_edge_ok": ~F.coalesce(bad, F.lit(False)),
                          "mean_bps": F.round(mu * 1e4, 2), "std_bps": F.round(F.sqrt(var) * 1e4, 2)}).drop("_pm", "_pv")


def decayed_arms(df: DataFrame, keys: Sequence[str], cycle: str, value: str, last_cycle: Column, gamma=0.995, prune=0.05) -> DataFrame:
    """Arms whose n, mean and m2 shrink by gamma at every cycle, dropped below `prune`.

    Observations are merged to one moment triple per arm and cycle, so the folded list is bounded by time.
    """
    per = df.groupBy(*keys, cycle).agg(F.count(value).cast("double").alias("bn"), F.avg(value).alias("bm"),
                                       (F.var_pop(value) * F.count(value)).alias("b2"))
    names = ("c", "n", "mean", "m2")
    zero = F.struct(F.lit(0).cast("bigint").alias("c"), *[F.lit(0.0).alias(k) for k in names[1:]])

    def aged(s, to):
        f = F.pow(F.lit(gamma), to - s["c"])
        alive = s["n"] * f >= prune
        return [F.when(alive, s[k] * f).otherwise(0.0) for k in names[1:]]

    def merge(s, b):
        n, mean, m2 = aged(s, b[cycle])
        tot, delta = n + b["bn"], b["bm"] - mean
        return F.struct(b[cycle].cast("bigint").alias("c"), tot.alias("n"), (mean + delta * b["bn"] / tot).alias("mean"),
                        (m2 + b["b2"] + delta * delta * n * b["bn"] / tot).alias("m2"))

    def finish(s):
        n, mean, m2 = aged(s, last_cycle + 1)
        return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))

    out = fold_scalar(per, keys, [cycle], ["bn", "bm", "b2"], zero, merge, finish, "_s")
    return out.select(*keys, "_s.*").where("n > 0")


def allocate(post: DataFrame, prev: Column, silent: Column, temperature=4.0, smooth=0.35, floor=0.04, seed: int | None = None) -> DataFrame:
    """Softmax of posterior draws (of the means without a seed), smoothed, floored, silent arms at zero."""
    draw = F.col("post_mean") if seed is None else F.col("post_mean") + F.col("post_sd") * F.randn(seed)
    draw = F.when(F.col("net_edge_ok"), draw).otherwise(F.least(draw, -F.abs("post_sd")))
    w = W.partitionBy("regime")
    x = post.withColumns({"_silent": silent, "_d": F.when(~silent, draw)})
    x = x.withColumn("_e", F.when(~F.col("_silent"), F.exp(temperature * 100 * (F.col("_d") - F.max("_d").over(w)))))
    mix = smooth * F.col("_e") / F.sum("_e").over(w) + (1 - smooth) * prev
    low = F.when(F.col("net_edge_ok"), floor).otherwise(0.0)
    x = x.withColumn("_m", F.when(F.col("_silent"), 0.0).otherwise(F.greatest(low, mix)))
    return x.withColumn("weight", F.round(F.col("_m") / F.sum("_m").over(w), 4)).drop("_silent", "_d", "_e", "_m")


def recent_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float = 0.2, warm: int = 10,
                chunks: Sequence[str] = ()) -> DataFrame:
    """Plain mean of the first `warm` values, then an exponential mean with weight alpha over all later ones.

    Every row is weighted by its position, counted in slices of `chunks` (see `scans.running`), so any alpha is exact.
    """
    keys = list(keys)
    x = df.where(F.col(value).isNotNull())
    n = x.groupBy(*keys).agg(F.count(value).alias("n"))
    at = row_index(x.select(*dict.fromkeys([*keys, *order, value, *chunks])), list(order), keys, list(chunks), "_i").join(n, keys)
    weight = F.when(F.col("_i") > warm, alpha * F.pow(F.lit(1 - alpha), F.col("n") - F.col("_i"))).otherwise(F.lit(0.0))
    y = at.groupBy(*keys, "n").agg(F.avg(F.when(F.col("_i") <= warm, F.col(value))).alias("_head"), F.sum(weight * F.col(value)).alias("_tail"))
    kept = F.pow(F.lit(1 - alpha), F.greatest(F.col("n") - warm, F.lit(0)))
    return y.select(*keys, "n", (F.col("_tail") + kept * F.col("_head")).alias("mean"))


def direction_bias(edges: DataFrame, gain=8.0, cap=0.25) -> DataFrame:
    """Additive bias per regime from the long and short edges (columns regime, side, n, mean)."""
    g = edges.groupBy("regime").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"_{c}{i}")
                                      for i, s in enumerate((1, -1)) for c in ("n", "mean")])
    conf = [F.least(F.lit(1.0), F.coalesce(F.col(f"_n{i}"), F.lit(0)) / 15.0) for i in (0, 1)]
    m = [F.coalesce(F.col(f"_mean{i}"), F.lit(0.0)) for i in (0, 1)]
    low = F.least(*conf)
    return g.select("regime", m[0].alias("long_edge"), m[1].alias("short_edge"),
                    F.when(low > 0, clip((m[0] - m[1]) * gain * low, -cap, cap)).otherwise(0.0).alias("bias"))


def adjusted(df: DataFrame, edges: DataFrame, regime="regime", composite="composite", confidence="confidence") -> DataFrame:
    """Composites moved by their regime's bias (`edges` as `direction_bias` gives them), with `flipped` and `direction`.

    A flip is a change of sign of a composite that isn't flat. A flat one without confidence that a bias gave a lean gets half the lean as
    confidence, 1 at most. Regimes without a bias, and null ones, leave their rows as they are; a null composite has no direction.
    """
    x = df.join(edges.select(F.col(regime).alias("_r"), F.col("bias").alias("_b")), F.col(regime) == F.col("_r"), "left")
    old, moved = F.col(composite), F.coalesce(F.col("_b"), F.lit(0.0)) != 0
    x = x.withColumn("_new", F.when(moved, old + F.col("_b")).otherwise(old))
    new = F.col("_new")
    return x.withColumns({
        "flipped": F.coalesce(moved & ((new > 0) != (old > 0)) & (F.abs(old) > 1e-9), F.lit(False)),
        "direction": F.when(new > 0, 1).when(new.isNotNull(), -1),
        confidence: F.when((F.col(confidence) == 0) & (new != 0), F.least(F.lit(1.0), F.abs(new) * 0.5)).otherwise(F.col(confidence)),
        composite: new}).drop("_r", "_b", "_new")


def throttle(a: DataFrame, max_factor=1.5, prior_std=0.01, floor=0.01) -> DataFrame:
    """Exit factor per (mechanism, regime, bucket): siblings in the regime as prior, else the whole mechanism."""
    x = pool_others(a, ["mechanism", "regime"], "near")
    x = pool_others(x, ["mechanism"], "far", own=True)
    (m1, v1), (m2, v2) = pooled_prior("near", prior_std, floor), pooled_prior("far", prior_std, floor)
    x = x.withColumns({"_pm": F.when(F.col("near_n") > 0, m1).otherwise(m2), "_pv": F.when(F.col("near_n") > 0, v1).otherwise(v2)})
    mu, var = conjugate(F.col("n"), F.col("mean"), F.col("m2"), F.col("_pm"), F.col("_pv"), prior_std, floor)
    z = clip(mu / F.sqrt(var), -3, 3)
    return x.withColumns({"post_mean": mu, "factor": F.exp(F.ln(F.lit(max_factor)) * z / 3)}).drop("_pm", "_pv")
