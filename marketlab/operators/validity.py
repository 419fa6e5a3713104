"""Anti-overfitting statistics: deflated Sharpe, CSCV, bootstrap, walk-forward summaries, promotion gates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlab.functions.mathx import EULER_GAMMA, norm_cdf, norm_ppf
from marketlab.operators.ledger import moments


def probabilistic_sharpe(df: DataFrame, name: str = "psr", benchmark=0.0) -> DataFrame:
    """Probability that the true Sharpe ratio exceeds the benchmark; 0 below three observations.

    Needs n, sharpe, skew and kurt. The z-score is a column of its own because the distribution
    function mentions its argument many times.
    """
    n, sr, skew, kurt = (F.col(c) for c in ("n", "sharpe", "skew", "kurt"))
    den = F.sqrt(F.greatest(F.lit(1e-12), 1 - skew * sr + (kurt - 1) / 4 * sr * sr))
    b = F.lit(benchmark) if isinstance(benchmark, float) else benchmark
    x = df.withColumn("_z", (sr - b) * F.sqrt(n - 1) / den)
    return x.withColumn(name, F.when(n >= 3, norm_cdf(F.col("_z"))).otherwise(0.0)).drop("_z")


def expected_max_sharpe(n_trials, trial_sd) -> Column:
    """Expected best Sharpe of n skill-less trials."""
    n = F.greatest(F.lit(2.0), n_trials)
    return trial_sd * ((1 - EULER_GAMMA) * norm_ppf(1 - 1 / n) + EULER_GAMMA * norm_ppf(1 - 1 / (n * math.e)))


def deflated_sharpe(df: DataFrame, keys: Sequence[str], ret: str, n_trials, trial_sd=0.5) -> DataFrame:
    """PSR against zero and against the expected maximum under the null."""
    m = df.groupBy(*keys).agg(*[c.alias(k) for k, c in moments(F.col(ret)).items()])
    sr = F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).otherwise(0.0)
    n = F.lit(float(n_trials)) if isinstance(n_trials, (int, float)) else n_trials
    m = m.withColumns({"sharpe": sr, "_b": expected_max_sharpe(n, F.lit(float(trial_sd)))})
    return probabilistic_sharpe(probabilistic_sharpe(m, "psr"), "dsr", F.col("_b")).drop("_b")


def pbo(df: DataFrame, strategy: str, t: str, ret: str, n_splits: int = 10) -> DataFrame:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation.

    `t` is the 0-based position in each strategy's series. Rows are reduced to moments per (strategy,
    block) first; only those meet the C(S, S/2) splits.
    """
    span = df.groupBy(strategy).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("_T"))
    x = df.crossJoin(F.broadcast(span)).withColumn("_b", F.floor(F.col(t) / F.floor(F.col("_T") / n_splits)))
    blocks = x.where((F.col("_b") < n_splits) & (F.col("_T") >= 2 * n_splits)).groupBy(strategy, "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(ret).alias("_s"), F.sum(F.col(ret) * F.col(ret)).alias("_q"))
    splits = [sum(1 << b for b in c) for c in combinations(range(n_splits), n_splits // 2)]
    e = blocks.withColumn("_split", F.explode(F.array(*[F.lit(m) for m in splits])))
    inside = F.expr("(_split & shiftleft(1, cast(_b as int))) != 0")

    def perf(cond):
        n, s, q = (F.sum(F.when(cond, F.col(c))) for c in ("_n", "_s", "_q"))
        var = q / n - (s / n) * (s / n)
        return F.when((n >= 2) & (var > 1e-18), s / n / F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0)

    p = e.groupBy("_split", strategy).agg(perf(inside).alias("_is"), perf(~inside).alias("_oos"))
    best = p.groupBy("_split").agg(F.min_by("_oos", F.struct(-F.col("_is"), F.col(strategy))).alias("_best"))
    r = p.join(best, "_split").groupBy("_split").agg(
        F.avg((F.col("_oos") <= F.col("_best")).cast("double")).alias("_rank"))
    rank = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("_rank")))
    return r.select(F.ln(rank / (1 - rank)).alias("_w")).agg(
        F.count(F.lit(1)).alias("n_splits"), F.avg((F.col("_w") <= 0).cast("double")).alias("pbo"), F.avg("_w").alias("mean_logit"))


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap_ci(df: DataFrame, keys: Sequence[str], value: str, row_id: Column, n_boot: int = 2000, ci: float = 0.95,
                 method: str = "bca") -> DataFrame:
    """Bootstrap interval of the mean per group, percentile or bias-corrected and accelerated.

    Every row draws a Poisson(1) weight per replicate from a hash of its id, so rows are never moved or
    paired: tasks emit replicate sums per group, and only those are shuffled. Results do not depend on
    partitioning; they equal resampling with replacement in distribution, not draw by draw.
    """
    keys = list(keys)
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    salts = _splitmix(np.arange(n_boot, dtype=np.uint64))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    x = df.select(*keys, F.col(value).cast("double").alias("_v"), F.xxhash64(row_id).alias("_h")).where("_v is not null")

    def draws(batches):
        for pdf in batches:
            for key, g in pdf.groupby(keys, sort=False) if keys else [((), pdf)]:
                wsum, vsum = np.zeros(n_boot), np.zeros(n_boot)
                h, v = g["_h"].to_numpy().astype(np.int64).view(np.uint64), g["_v"].to_numpy()
                for i in range(0, len(v), 512):
                    u = _splitmix(h[i:i + 512, None] ^ salts[None, :]) / 2.0 ** 64
                    w = np.searchsorted(cdf, u)
                    wsum += w.sum(axis=0)
                    vsum += v[i:i + 512] @ w
                out = pd.DataFrame({"b": np.arange(n_boot), "_ws": wsum, "_vs": vsum})
                for k, val in zip(keys, key if isinstance(key, tuple) else (key,)):
                    out[k] = val
                yield out[[*keys, "b", "_ws", "_vs"]]

    # the work per row is n_boot draws, so spread few bytes over all cores
    reps = x.repartition(x.sparkSession.sparkContext.defaultParallelism).mapInPandas(draws, (schema + ", " if keys else "") + "b int, _ws double, _vs double")
    reps = reps.groupBy(*keys, "b").agg((F.sum("_vs") / F.sum("_ws")).alias("_m"))
    m = F.avg("_v")
    stats = x.groupBy(*keys).agg(F.count("_v").alias("n"), m.alias("point"), F.skewness("_v").alias("_sk"))
    boot = reps.join(stats, keys) if keys else reps.crossJoin(F.broadcast(stats))
    g = boot.groupBy(*keys).agg(F.first("n").alias("n"), F.first("point").alias("point"), F.first("_sk").alias("_sk"),
                                F.array_sort(F.collect_list("_m")).alias("_boot"), F.avg((F.col("_m") < F.col("point")).cast("double")).alias("_prop"))
    alpha = 1 - ci
    # jackknife acceleration in closed form: sum d^3 / (6 (sum d^2)^1.5) = skewness / (6 sqrt(n))
    g = g.withColumns({"_a": F.col("_sk") / (6 * F.sqrt("n")), "_z0": norm_ppf(F.col("_prop"))})
    for side, p in (("lo", alpha / 2), ("hi", 1 - alpha / 2)):
        z = F.col("_z0") + norm_ppf(F.lit(p))
        g = g.withColumn("_z", F.col("_z0") + z / (1 - F.col("_a") * z))
        q = F.coalesce(norm_cdf(F.col("_z")), F.lit(p)) if method == "bca" else F.lit(p)
        g = g.withColumn("_i", F.greatest(F.lit(0.0), F.least(F.lit(n_boot - 1.0), F.rint(q * (n_boot - 1)))))
        g = g.withColumn(f"ci_{side}", F.element_at("_boot", (F.col("_i") + 1).cast("int")))
    return g.select(*keys, "n", "point", "ci_lo", "ci_hi")


def fold_results(folds: DataFrame, keys: Sequence[str], ret="ret", ts="ts") -> DataFrame:
    """Compounded return and worst drawdown of every (key, fold) test segment; segments are bounded by bars.

    A bar losing everything leaves a millionth of the stake."""
    w = W.partitionBy(*keys, "fold").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    x = folds.withColumn("_eq", F.exp(F.sum(F.ln(F.greatest(1 + F.col(ret), F.lit(1e-6)))).over(w)))
    x = x.withColumn("_pk", F.greatest(F.lit(1.0), F.max("_eq").over(w)))
    return x.groupBy(*keys, "fold").agg((F.max_by("_eq", ts) - 1).alias("total_return"), F.max(1 - F.col("_eq") / F.col("_pk")).alias("max_drawdown"),
                                        F.count(F.lit(1)).alias("n"), F.sum("entry").alias("trades"))


def walk_forward_summary(res: DataFrame, keys: Sequence[str]) -> DataFrame:
    """True and upper median fold return, worst drawdown, share of positive folds."""
    r = F.col("total_return")
    srt = F.array_sort(F.collect_list(r))
    return res.groupBy(*keys).agg(
        F.percentile(r, F.lit(0.5)).alias("median_return"), F.get(srt, F.floor(F.count(r) / 2).cast("int")).alias("upper_median"),
        F.avg(r).alias("mean_return"), F.max("max_drawdown").alias("worst_drawdown"), F.avg((r > 0).cast("double")).alias("frac_positive"),
        F.count(r).alias("n_folds"), F.sum("trades").alias("total_trades"))


def promotion_gate(df: DataFrame, min_trades=20, min_frac=0.6, dsr_min=0.9) -> DataFrame:
    """First failing gate in order, or promoted."""
    g = (F.when(F.col("total_trades") < min_trades, "too_few_trades").when(F.col("frac_positive") < min_frac, "not_robust")
         .when(~((F.col("upper_median") > 0) & (F.col("mean_return") > 0)), "oos_negative")
         .when(F.col("dsr") <= dsr_min, "weak_sharpe").otherwise("promoted"))
    return df.withColumn("gate", g)


def buy_hold(bars: DataFrame, fee=0.005, warm=60, key="product", ts="ts") -> DataFrame:
    """Buy at the first bar after the warm-up, hold to the last, fees on both sides."""
    w = W.partitionBy(key).orderBy(ts)
    x = bars.withColumns({"_rn": F.row_number().over(w), "_r": F.col("close") / F.lag("close").over(w) - 1}).where(F.col("_rn") > warm)
    sd = F.stddev_samp(F.when(F.col("_rn") > warm + 1, F.col("_r")))
    mean = F.avg(F.when(F.col("_rn") > warm + 1, F.col("_r")))
    return x.groupBy(key).agg((F.max_by("close", ts) / F.min_by("close", ts) * (1 - fee) ** 2 - 1).alias("total_return"),
                              F.when(sd > 0, mean / sd * math.sqrt(8760)).otherwise(0.0).alias("sharpe_annualized"), F.count(F.lit(1)).alias("n"))


def crowding(df: DataFrame, ids: str, objs: Sequence[str], front="front") -> DataFrame:
    """Crowding distance inside each front; NULL (infinite) at the ends of any objective."""
    x = df.withColumns({f"_d{i}": (F.lead(o).over(w) - F.lag(o).over(w)) / F.when(hi > lo, hi - lo).otherwise(1e-9)
                        for i, o in enumerate(objs)
                        for w, p in [(W.partitionBy(front).orderBy(o, ids), W.partitionBy(front))]
                        for hi, lo in [(F.max(o).over(p), F.min(o).over(p))]})
    total = F.col("_d0")
    for i in range(1, len(objs)):
        total = total + F.col(f"_d{i}")
    return x.withColumn("crowding", total).drop(*[f"_d{i}" for i in range(len(objs))])
