"""Signal studies, drift and calibration."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlab.functions.mathx import psi_term
from marketlab.operators.folds import fold_rows
from marketlab.operators.joins import _same, _slice_of, time_slices
from marketlab.operators.scans import Run, pin, row_index, running, trailing_chunks
from marketlab.operators.slices import FOLD_ROWS, page_hinkley_jump, page_hinkley_replay, sliced_fold


def net_lean(positions: DataFrame, rank_decay: float = 1.0, use_score: bool = False, keys=("ts", "asset")) -> DataFrame:
    """Notional-weighted direction per snapshot and asset, traders weighted by rank (and score)."""
    w = 1 / F.pow(F.greatest(F.lit(1), F.col("rank")), F.lit(rank_decay))
    if use_score:
        w = w * F.greatest(F.lit(0.0), F.col("score"))
    c = w * F.col("notional")
    g = positions.groupBy(*keys).agg(F.sum(c * F.signum("direction")).alias("_n"), F.sum(F.abs(c)).alias("_d"))
    return g.where(F.col("_d") > 0).select(*keys, (F.col("_n") / F.col("_d")).alias("lean"))


SLICE_VALUES = 200_000


def value_slices(counts: DataFrame, col: str, keys: Sequence[str], rows: int = SLICE_VALUES) -> DataFrame:
    """Adds `_s`, a slice number that never decreases with the value, with about `rows` distinct values in each however skewed they are.

    Bounds come from a mergeable quantile sketch of the keys with more values than that, their number from the count;
    exactness does not depend on them.
    """
    bounds = time_slices(counts.select(*keys, F.col(col).alias("_at")), keys, rows)
    x = counts.join(F.broadcast(bounds), _same(keys), "left").withColumn("_s", _slice_of(F.col(col)))
    return x.drop("_bounds", *[f"_h{i}" for i in range(len(keys))])


def average_ranks(df: DataFrame, col: str, keys: Sequence[str], name: str) -> DataFrame:
    """Ranks with ties averaged, per key.

    Values are counted first; ranks are a running sum over the distinct values in value slices, so
    neither a hot key nor a hot value is sorted row by row.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))
    r = running(value_slices(counts, col, keys), [col], [Run("_before", "sum", "_c", strict=True)], keys, ["_s"])
    r = r.select(*keys, F.col(col).alias("_v"), (F.coalesce("_before", F.lit(0)) + (F.col("_c") - 1) / 2).alias(name))
    on = F.col(col) == F.col("_v")
    x = df
    if keys:
        r = r.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return x.join(r, on).drop("_v", *[f"_k_{k}" for k in keys])


def correlation(x: Column, y: Column) -> Column:
    """Pearson; 0 below three rows or without variance."""
    ok = (F.count(x) >= 3) & (F.stddev_pop(x) > 1e-15) & (F.stddev_pop(y) > 1e-15)
    return F.when(ok, F.corr(x, y)).otherwise(0.0)


def rank_ic(pairs: DataFrame, sig: str, ret: str, keys: Sequence[str] = ()) -> DataFrame:
    """Spearman and Pearson correlation of signal and forward return per key (or pooled).

    The pairs are pinned, since ranking reads them several times.
    """
    pairs = pin(pairs.select(*keys, sig, ret))
    x = average_ranks(average_ranks(pairs, sig, keys, "_rs"), ret, keys, "_rr")
    aggs = [F.count(F.lit(1)).alias("n"), correlation(F.col("_rs"), F.col("_rr")).alias("ic"), correlation(F.col(sig), F.col(ret)).alias("pearson")]
    return x.groupBy(*keys).agg(*aggs) if keys else x.agg(*aggs)


def mutual_info(pairs: DataFrame, x: str, y: str, bins: int = 6) -> DataFrame:
    """Mutual information over an equal-width joint histogram; the maximum belongs to the last bin."""
    lim = pairs.agg(*[f(c).alias(f"_{n}{c}") for c in (x, y) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    p = pairs.crossJoin(F.broadcast(lim))

    def cell(c):
        lo, hi = F.col(f"_lo{c}"), F.col(f"_hi{c}")
        return F.when(hi > lo, F.least(F.lit(bins - 1), F.floor((F.col(c) - lo) / (hi - lo) * bins))).otherwise(0)

    joint = p.groupBy(cell(x).alias("i"), cell(y).alias("j")).agg(F.count(F.lit(1)).alias("c"))
    # at most bins x bins rows from here on
    all_, wi, wj = W.partitionBy(F.lit(0)), W.partitionBy("i"), W.partitionBy("j")
    h = joint.withColumns({"_n": F.sum("c").over(all_), "_r": F.sum("c").over(wi), "_q": F.sum("c").over(wj)})
    term = F.col("c") / F.col("_n") * F.ln(F.col("c") * F.col("_n") / (F.col("_r") * F.col("_q")) + 1e-12)
    return h.agg(F.first("_n").alias("n"), F.greatest(F.lit(0.0), F.sum(term)).alias("mutual_info")).withColumn(
        "mutual_info", F.when(F.col("n") >= 8, F.col("mutual_info")).otherwise(0.0))


#: Rounds and modulus (2^31 - 1) of the shuffle below; 12 rounds mix well enough for a p-value.
SHUFFLE_ROUNDS, SHUFFLE_MOD = 12, 2147483647


def shuffled_place(i: np.ndarray, n: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the rows `i` of `n` in the shuffles `b`: a bijection of 0 .. n - 1 by swap-or-not rounds.

    Each round pairs a place with its mirror image about a round key and swaps both or neither, by the parity of a square
    modulo a prime taken at the larger of the two: integer arithmetic that any engine repeats.
    """
    x = i.astype(np.int64)
    for r in range(1, SHUFFLE_ROUNDS + 1):
        key = ((b * 7919 + r * 104729 + 12345) * 48271) % SHUFFLE_MOD
        mate = (key - x) % n
        h = (np.maximum(x, mate) + (b * 15485863 + r * 32452843) % SHUFFLE_MOD) % SHUFFLE_MOD
        x = np.where((h * h) % SHUFFLE_MOD % 2 == 1, mate, x)
    return x


def permutation_pvalue(pairs: DataFrame, sig: str, ret: str, row_id: str, n_perm: int = 2000) -> DataFrame:
    """Share of random shuffles whose |rank IC| reaches the observed one.

    Rows are numbered once, by a hash of their id; replicate b pairs row i with row `shuffled_place(i, n, b)`. Ranks keep their mean and variance
    under a shuffle, so a replicate needs only the sum of products, which tasks combine before the exchange: nothing is sorted
    a replicate.
    """
    pairs = pin(pairs.select(row_id, sig, ret))
    x = average_ranks(average_ranks(pairs, sig, (), "_rs"), ret, (), "_rr").withColumn("_h", F.md5(F.col(row_id).cast("string")))
    x = x.withColumn("_s", F.substring("_h", 1, 3))
    rows = pin(row_index(x, ["_h", row_id], (), ["_s"], "_i").select((F.col("_i") - 1).alias("_i"), "_rs", "_rr"))
    obs = rows.agg(F.abs(correlation(F.col("_rs"), F.col("_rr"))).alias("ic"), F.count(F.lit(1)).alias("n"), F.avg("_rs").alias("_ms"), F.avg("_rr").alias("_mr"),
                   F.stddev_pop("_rs").alias("_ds"), F.stddev_pop("_rr").alias("_dr"))
    one = rows.crossJoin(F.broadcast(obs)).select("_i", "n", (F.col("_rs") - F.col("_ms")).alias("_x"))
    # eight replicates at a time, so the work of few rows is many tasks
    reps = one.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit((n_perm - 1) // 8)))).repartition("_g")
    reps = reps.withColumn("b", F.explode(F.sequence(8 * F.col("_g") + 1, F.least(8 * F.col("_g") + 8, F.lit(n_perm)))))
    place = F.pandas_udf(lambda i, n, b: pd.Series(shuffled_place(i.to_numpy(), n.to_numpy(), b.to_numpy().astype(np.int64))), "long")
    reps = reps.select("b", "_x", place("_i", "n", "b").alias("_j"))
    mates = rows.select(F.col("_i").alias("_j"), F.col("_rr").alias("_y"))
    sums = reps.join(mates.hint("shuffle_hash"), "_j").groupBy("b").agg(F.sum(F.col("_x") * F.col("_y")).alias("_xy"))
    ic = F.when((F.col("_ds") > 1e-15) & (F.col("_dr") > 1e-15), F.abs(F.col("_xy") / F.col("n") / (F.col("_ds") * F.col("_dr")))).otherwise(0.0)
    hits = obs.join(sums, F.lit(True), "left").groupBy("ic", "n").agg(F.sum((ic >= F.col("ic") - 1e-9).cast("int")).alias("_hits"))
    p = F.when((F.col("ic") == 0) | (F.col("n") < 4), 1.0).otherwise((F.col("_hits") + 1) / (n_perm + 1))
    return hits.select("ic", p.alias("p_value"), "n")


def residuals(df: DataFrame, ys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """OLS residuals of each y on the same regressors plus intercept; adds `<y>_res`.

    The normal equations are one aggregate of k(k+1)/2 products; the small system is solved on the driver.
    """
    cols = ["_one", *xs]
    df = pin(df)
    x = df.withColumn("_one", F.lit(1.0))
    prods = {(i, j): F.sum(F.col(cols[i]) * F.col(cols[j])) for i in range(len(cols)) for j in range(i, len(cols))}
    rhs = {(y, i): F.sum(F.col(y) * F.col(cols[i])) for y in ys for i in range(len(cols))}
    row = x.agg(*[c.alias(f"p_{i}_{j}") for (i, j), c in prods.items()], *[c.alias(f"r_{y}_{i}") for (y, i), c in rhs.items()]).first()
    a = np.array([[row[f"p_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(cols))] for i in range(len(cols))])
    out = df
    for y in ys:
        beta = np.linalg.lstsq(a, np.array([row[f"r_{y}_{i}"] or 0.0 for i in range(len(cols))]), rcond=None)[0]
        fit = F.lit(float(beta[0]))
        for b, c in zip(beta[1:], xs):
            fit = fit + F.col(c) * float(b)
        out = out.withColumn(f"{y}_res", F.col(y) - fit)
    return out


def partial_ic(df: DataFrame, sig: str, ret: str, baseline: Sequence[str]) -> DataFrame:
    """Rank IC after removing what the baseline explains in both."""
    return rank_ic(residuals(df, [sig, ret], baseline), f"{sig}_res", f"{ret}_res")


def verdict(n: Column, ic: Column, p: Column) -> Column:
    """Reading of a pooled study."""
    return (F.when(n == 0, "NO DATA").when(n < 30, "INCONCLUSIVE").when(p > 0.05, "NO EDGE")
            .when(F.abs(ic) < 0.03, "NEGLIGIBLE").otherwise("PROMISING"))


def psi_reference(ref: DataFrame, feature: str, value: str, bins: int = 8) -> DataFrame:
    """Range and bin counts of each reference feature: (feature, `_lo`, `_hi`, `_nr`, `_b`, `_r`), `bins` rows a feature."""
    lim = ref.groupBy(feature).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_nr"))
    h = ref.join(lim, feature).groupBy(feature, _psi_bin(value, bins).alias("_b")).agg(F.count(value).alias("_r"))
    grid = lim.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(h, [feature, "_b"], "left").withColumn("_r", F.coalesce("_r", F.lit(0)))


def _psi_bin(value: str, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / F.greatest((F.col("_hi") - F.col("_lo")) / bins, F.lit(1e-300)))).cast("int")


def psi_against(counted: DataFrame, cur: DataFrame, feature: str, value: str, bins: int = 8, threshold: float = 0.25) -> DataFrame:
    """Population stability index of the features of `cur` against `psi_reference` counts; features without current rows have none."""
    lim = counted.where("_b = 0").select(feature, "_lo", "_hi")
    nc = cur.groupBy(feature).agg(F.count(value).alias("_nc"))
    c = cur.join(lim, feature).where(F.col(value) >= F.col("_lo")).groupBy(feature, _psi_bin(value, bins).alias("_b")).agg(F.count(value).alias("_c"))
    g = counted.join(nc, feature).join(c, [feature, "_b"], "left")
    t = psi_term(F.col("_r") / F.col("_nr"), F.coalesce("_c", F.lit(0)) / F.col("_nc"))
    out = g.groupBy(feature).agg(F.when(F.max(F.col("_hi") - F.col("_lo")) < 1e-12, 0.0).otherwise(F.sum(t)).alias("psi"))
    return out.withColumn("drifting", F.col("psi") > threshold)


def psi(ref: DataFrame, cur: DataFrame, feature: str, value: str, bins: int = 8, threshold: float = 0.25) -> DataFrame:
    """Population stability index per feature over the reference range; the last bin is open-ended,
    values below the range are dropped."""
    lim = ref.groupBy(feature).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_nr"))
    nc = cur.groupBy(feature).agg(F.count(F.lit(1)).alias("_nc"))
    both = ref.select(feature, value, F.lit(1).alias("_ref")).unionByName(cur.select(feature, value, F.lit(0).alias("_ref")))
    x = both.join(lim, feature).where(F.col(value) >= F.col("_lo"))
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / F.greatest((F.col("_hi") - F.col("_lo")) / bins, F.lit(1e-300))))
    h = x.groupBy(feature, b.alias("_b")).agg(F.sum("_ref").alias("_r"), F.sum(1 - F.col("_ref")).alias("_c"))
    grid = lim.join(nc, feature).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    g = grid.join(h, [feature, "_b"], "left")
    t = psi_term(F.coalesce("_r", F.lit(0)) / F.col("_nr"), F.coalesce("_c", F.lit(0)) / F.col("_nc"))
    out = g.groupBy(feature).agg(F.when(F.max(F.col("_hi") - F.col("_lo")) < 1e-12, 0.0).otherwise(F.sum(t)).alias("psi"))
    return out.withColumn("drifting", F.col("psi") > threshold)


def drift_check(ref: DataFrame, cur: DataFrame, feature: str, value: str, bins: int = 8, threshold: float = 0.25,
                least_ref: int = 120, least_cur: int = 80) -> DataFrame:
    """One row with `ready`, `drifting`, `worst_feature` and `worst_psi`.

    Not ready, so without a finding, while any feature has fewer than `least_ref` reference or `least_cur` current rows; no feature is the worst
    where every index is 0. Of equal indices the smallest name counts.
    """
    counts = [x.groupBy(feature).agg(F.count(F.lit(1)).alias(n)) for x, n in ((ref, "_nr"), (cur, "_nc"))]
    size = counts[0].join(counts[1], feature, "full_outer").agg(
        F.coalesce(F.min(F.coalesce("_nr", F.lit(0))), F.lit(0)).alias("_nr"), F.coalesce(F.min(F.coalesce("_nc", F.lit(0))), F.lit(0)).alias("_nc"))
    found = psi(ref, cur, feature, value, bins, threshold).where("psi > 0").agg(F.min(F.struct(-F.col("psi"), F.col(feature).alias("f"))).alias("_w"))
    x = size.crossJoin(F.broadcast(found))
    ready = (F.col("_nr") >= least_ref) & (F.col("_nc") >= least_cur)
    worst = F.when(ready, -F.col("_w")["col1"])
    return x.select(ready.alias("ready"), F.coalesce(worst > threshold, F.lit(False)).alias("drifting"), F.when(ready, F.col("_w.f")).alias("worst_feature"),
                    F.coalesce(worst, F.lit(0.0)).alias("worst_psi"))


def rank_quantile(df: DataFrame, keys: Sequence[str], value: str, q: Column, name: str = "q") -> DataFrame:
    """Linearly interpolated quantile at a fraction that may depend on the group (n is column `n`).

    Only the counted distinct values are scanned, in value slices.
    """
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count(value).alias("n"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).join(n, keys)
    r = running(value_slices(counts, value, keys), [value], [Run("_upto", "sum", "_c")], keys, ["_s"])
    pos = F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)) * (F.col("n") - 1)
    r = r.withColumn("_p", pos)
    first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
    at = lambda i: F.max(F.when((first <= i) & (last >= i), F.col(value)))
    lo, hi = F.floor("_p"), F.ceil("_p")
    g = r.groupBy(*keys).agg(F.first("n").alias("n"), F.first("_p").alias("_p"), at(lo).alias("_a"), at(hi).alias("_b"))
    frac = F.col("_p") - F.floor("_p")
    return g.select(*keys, "n", (F.col("_a") * (1 - frac) + F.col("_b") * frac).alias(name))


def conformal_quantile(df: DataFrame, keys, score: str, alpha: float = 0.1, name="qhat") -> DataFrame:
    """(1 - alpha)(n + 1)/n quantile of calibration scores."""
    return rank_quantile(df, keys, score, (1 - alpha) * (F.col("n") + 1) / F.col("n"), name)


def stop_calibration(trades: DataFrame, keys, alpha=0.1, least: int = 30, default=2.0, lo=0.5, hi=6.0) -> DataFrame:
    """Stop multiple from the uncensored adverse excursions (`mae_atr`, `stopped`) and the realised stop rate."""
    keys = list(keys)
    q = conformal_quantile(trades.where(~F.col("stopped")).withColumn("_m", F.greatest(F.lit(0.0), F.col("mae_atr"))), keys, "_m", alpha)
    rate = trades.groupBy(*keys).agg(F.avg(F.col("stopped").cast("double")).alias("stop_rate"), F.count(F.lit(1)).alias("n_total"))
    x = rate.join(q.withColumnRenamed("n", "n_scores"), keys, "left")
    mult = F.when(F.col("n_scores") >= least, F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("qhat")))).otherwise(default)
    return x.withColumn("stop_mult", mult)


def _clamped(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c).cast("double"))))


def direction_conformal(points: DataFrame, query: DataFrame, key: str, align="align", favored="favored", h: float = 0.30,
                        alpha: float = 0.1, window: int = 400, order=("ts",), least: int = 40) -> DataFrame:
    """Kernel estimate of P(long), conformal prediction set and veto for proposed directions.

    Calibration uses the newest `window` labelled points per key (a rolling set), trimmed per task before the shuffle, so the kernel meets at most
    window rows per point. Alignments are clamped to [-1, 1]; points without one, or with another label than 1 and -1, are left out. Below
    `least` points, or without an alignment, the gate abstains: both sides are in the set and nothing is vetoed.
    """
    points = points.where(F.col(align).isNotNull() & F.col(favored).isin(1, -1)).withColumn(align, _clamped(align))
    w = W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    cal = points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= window).drop("_r")
    cal = cal.groupBy(key).agg(F.collect_list(F.struct(F.col(align).cast("double").alias("a"), F.col(favored).alias("f"))).alias("_cal"))

    def p_long(a):
        num = F.aggregate("_cal", F.lit(0.5), lambda s, c: s + F.when(c["f"] == 1, F.exp(-F.pow((a - c["a"]) / h, 2))).otherwise(0.0))
        den = F.aggregate("_cal", F.lit(1.0), lambda s, c: s + F.exp(-F.pow((a - c["a"]) / h, 2)))
        return num / den

    pts = cal.select(key, "_cal", F.explode("_cal").alias("_c")).withColumn("_p", p_long(F.col("_c.a")))
    sc = pts.select(key, F.when(F.col("_c.f") == 1, 1 - F.col("_p")).otherwise(F.col("_p")).alias("_score"))
    q = conformal_quantile(sc, [key], "_score", alpha)
    x = query.join(cal, key, "left").join(q, key, "left").withColumn("p_long", p_long(_clamped(align))).drop("_cal")
    thr = 1 - F.col("qhat")
    x = x.withColumn("ready", F.coalesce(F.col("n") >= least, F.lit(False))).drop("n")
    x = x.withColumns({"_l": F.coalesce(F.col("p_long") >= thr, F.lit(False)), "_s": F.coalesce((1 - F.col("p_long")) >= thr, F.lit(False))})
    both = ~F.col("ready") | (~F.col("_l") & ~F.col("_s"))
    x = x.withColumns({"in_long": F.col("_l") | both, "in_short": F.col("_s") | both})
    d = F.col("direction") > 0
    return x.withColumn("veto", F.when(d, ~F.col("in_long") & F.col("in_short")).otherwise(F.col("in_long") & ~F.col("in_short"))).drop("_l", "_s")


def cqr_fixed(df: DataFrame, keys, order: str, window: int, alpha: float) -> DataFrame:
    """CQR scores, rolling qhat over the last `window` full rows and coverage, fixed alpha."""
    w = W.partitionBy(*keys).orderBy(order)
    x = df.withColumns({"score": F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi")), "_rn": F.row_number().over(w)})
    rank = min(1.0, (1 - alpha) * (window + 1) / window)
    x = x.withColumn("qhat", F.when(F.col("_rn") > window, F.percentile("score", F.lit(rank)).over(w.rowsBetween(-window, -1))))
    ok = (F.col("y") >= F.col("lo") - F.col("qhat")) & (F.col("y") <= F.col("hi") + F.col("qhat"))
    return x.withColumn("covered", ok).drop("_rn")


def cqr_adaptive(df: DataFrame, keys, order, window: int = 500, alpha: float = 0.2, gamma: float = 0.01) -> DataFrame:
    """Adaptive conformal inference, one pass in order per key with the last `window` scores as state."""
    from bisect import bisect_left, insort
    from collections import deque

    def start():
        return [alpha, deque(), []]

    def step(st, lo, hi, y):
        a, recent, srt = st
        q, n = 0.0, len(srt)
        if n >= 20:
            pos = min(1.0, max(0.0, (1 - a) * (n + 1) / n)) * (n - 1)
            i = int(pos)
            q = srt[i] if i + 1 >= n else srt[i] * (1 - (pos - i)) + srt[i + 1] * (pos - i)
        hit = lo - q <= y <= hi + q
        a = min(0.60, max(0.01, a + gamma * (alpha - (0.0 if hit else 1.0))))
        s = max(lo - y, y - hi)
        recent.append(s)
        insort(srt, s)
        if len(recent) > window:
            del srt[bisect_left(srt, recent.popleft())]
        return [a, recent, srt], (q, float(hit), a)

    return fold_rows(df, keys, order, start, step, ["lo", "hi", "y"], ["qhat", "covered", "alpha_t"])


def page_hinkley(df: DataFrame, keys, order, error: str, delta=0.005, lam=0.5, alpha=0.999, rows: int = FOLD_ROWS) -> DataFrame:
    """Page-Hinkley statistic and detections of an error stream, resetting after each, in slices of about `rows` rows.

    Rows without an error have null results and leave the state as it is.
    """
    return page_hinkley_states(df, keys, order, error, delta, lam, alpha, rows).drop(*PH_STATE)


PH_STATE = ["_seen", "_mean", "_cum", "_low"]


def page_hinkley_states(df: DataFrame, keys, order, error: str, delta=0.005, lam=0.5, alpha=0.999, rows: int = FOLD_ROWS, starts: DataFrame | None = None) -> DataFrame:
    """W36 with the state after each row (`PH_STATE`), from the states in `starts` (keys, `state`)."""
    return sliced_fold(df, keys, order, [error], ["ph_stat", "drift", *PH_STATE], (0.0, 0.0, 0.0, 0.0), page_hinkley_replay(delta, lam, alpha), page_hinkley_jump,
                       rows, starts)


def rolling_accuracy(preds: DataFrame, order: Sequence[str], width: int = 21, least: float = 0.05, size: int = 100_000) -> DataFrame:
    """Directional accuracy and loss of the last `width` scored predictions, at each of them.

    `order` begins with a time. The series is cut into pieces of `size` rows, each led by the rows its first frames reach back to.
    """
    x = trailing_chunks(preds.where(F.abs("pred") >= least), [], order[0], width - 1, size, tie=order[1:])
    f = W.partitionBy("_piece").orderBy("_rn").rowsBetween(-(width - 1), 0)
    x = x.withColumns({"accuracy": F.avg((F.col("pred") * F.col("actual") > 0).cast("double")).over(f), "loss": F.avg(F.pow(F.col("pred") - F.col("actual"), 2)).over(f)})
    return x.where(~F.col("_warm")).drop("_warm", "_piece", "_rn")
