"""Numeric operators against independent Python computations."""

import datetime as dt
import math
import random
import statistics as st

import pytest
from pyspark.sql import functions as F

from marketlab.functions import mathx as M
from marketlab.operators import folds, indicators as I
from marketlab.operators import ledger as G
from marketlab.operators import posteriors as P
from marketlab.operators import rules as R
from marketlab.operators import study as Y
from marketlab.operators import validity as V

T0 = dt.datetime(2024, 1, 1)


def walk(n, seed=1, product="a"):
    r = random.Random(seed)
    p, out = 100.0, []
    for i in range(n):
        o = p
        p *= 1 + r.gauss(0, 0.01)
        out.append((product, T0 + dt.timedelta(hours=i), o, max(o, p) * 1.002, min(o, p) * 0.998, p, r.uniform(0, 10)))
    return out


BARS = "product string, ts timestamp, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(260), BARS)


def test_normal_distribution(spark):
    xs = [-40.0, -8.0, -3.3, -0.5, 0.0, 1e-9, 0.7, 2.5, 7.2, 39.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", M.norm_cdf(F.col("x")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), abs=1e-14)
    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6]
    q = spark.createDataFrame([(p,) for p in ps], "p double").select("p", M.norm_ppf(F.col("p")).alias("z")).collect()
    for r in q:
        assert r["z"] == pytest.approx(st.NormalDist().inv_cdf(r["p"]), rel=2e-9, abs=2e-9)
    assert spark.range(1).select(M.norm_ppf(F.lit(1.0)).alias("z")).first()["z"] is None


@pytest.mark.parametrize("span", [2, 12, 200])
def test_full_history_ema(spark, bars, span):
    got = [r["e"] for r in folds.ema_series(bars, "close", {"e": span}).orderBy("ts").collect()]
    k, e = 2 / (span + 1), None
    for g, row in zip(got, walk(260)):
        e = row[5] if e is None else row[5] * k + e * (1 - k)
        assert g == pytest.approx(e, rel=1e-12)


def test_wilder_rsi(bars):
    got = [r["rsi_wilder"] for r in folds.wilder_rsi(bars).orderBy("ts").collect()]
    c = [r[5] for r in walk(260)]
    up = [max(b - a, 0) for a, b in zip(c, c[1:])]
    dn = [max(a - b, 0) for a, b in zip(c, c[1:])]
    assert got[:14] == [50.0] * 14
    g, l = sum(up[:14]) / 14, sum(dn[:14]) / 14
    for i in range(14, 260):
        if i > 14:
            g, l = (g * 13 + up[i - 1]) / 14, (l * 13 + dn[i - 1]) / 14
        assert got[i] == pytest.approx(100 - 100 / (1 + g / l), rel=1e-10)


def test_features_never_look_ahead(spark, bars):
    full = {r["ts"]: r for r in I.features(bars).collect()}
    cut = {r["ts"]: r for r in I.features(bars.where(F.col("ts") < F.lit(T0 + dt.timedelta(hours=150)))).collect()}
    assert len(full) == 201 and len(cut) == 91
    for t, r in cut.items():
        for c in ("rsi", "atr", "ema26", "macd_delta", "volatility"):
            assert r[c] == full[t][c]


def test_constant_and_short_series(spark):
    flat = spark.createDataFrame([("a", T0 + dt.timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(70)], BARS)
    r = I.features(flat).orderBy(F.desc("ts")).first()
    assert (r["rsi"], r["atr"], r["volatility"], r["vol_ratio"]) == (100.0, 0.0, 0.0, 1.0)
    assert I.features(flat.limit(20)).count() == 0
    assert I.efficiency_ratio(flat).agg(F.max("er")).first()[0] == 0.0


def test_moments_of_constant_and_single(spark):
    df = spark.createDataFrame([("c", 2.0), ("c", 2.0), ("s", 1.0)], "k string, r double")
    m = {r["k"]: r for r in df.groupBy("k").agg(*[c.alias(n) for n, c in G.moments(F.col("r")).items()]).collect()}
    assert (m["c"]["mean"], m["c"]["sd"], m["c"]["skew"], m["c"]["kurt"]) == (2.0, 0.0, 0.0, 3.0)
    assert (m["s"]["mean"], m["s"]["kurt"]) == (0.0, 0.0)


def test_page_hinkley_and_adaptive_conformal(spark):
    r = random.Random(2)
    rows = [(k, i, r.random() * (1 if i < 100 else 3), r.uniform(-1, 0), r.uniform(0, 1), r.gauss(0, 1)) for k in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, e double, lo double, hi double, y double").repartition(3)
    got = {(x["k"], x["i"]): x for x in Y.page_hinkley(df, ["k"], ["i"], "e", 0.005, 2.0).collect()}
    acp = {(x["k"], x["i"]): x for x in Y.cqr_adaptive(df, ["k"], ["i"], 50, 0.2, 0.01).collect()}
    for key in "ab":
        n = mean = cum = low = 0
        a, scores = 0.2, []
        for k, i, e, lo, hi, y in rows:
            if k != key:
                continue
            n += 1
            mean = 0.999 * mean + 0.001 * e if n > 1 else e
            cum = 0.999 * cum + e - mean - 0.005
            low = min(low, cum)
            assert got[k, i]["ph_stat"] == pytest.approx(cum - low)
            if cum - low > 2.0:
                cum = low = 0
            s = sorted(scores)
            q = 0.0
            if len(s) >= 20:
                pos = min(1, (1 - a) * (len(s) + 1) / len(s)) * (len(s) - 1)
                j = int(pos)
                q = s[j] if j + 1 >= len(s) else s[j] * (1 - pos + j) + s[j + 1] * (pos - j)
            hit = lo - q <= y <= hi + q
            a = min(0.6, max(0.01, a + 0.01 * (0.2 - (0 if hit else 1))))
            assert acp[k, i]["qhat"] == pytest.approx(q) and acp[k, i]["alpha_t"] == pytest.approx(a)
            scores = (scores + [max(lo - y, y - hi)])[-50:]


def test_recent_mean_equals_the_sequential_fold(spark):
    r = random.Random(4)
    vals = {k: [r.gauss(0, 1) for _ in range(n)] for k, n in (("a", 600), ("b", 40), ("c", 7))}
    df = spark.createDataFrame([(k, i, v) for k, vs in vals.items() for i, v in enumerate(vs)], "k string, i int, v double")
    got = {x["k"]: x["mean"] for x in P.recent_mean(df, ["k"], ["i"], "v", 0.2).collect()}
    for k, vs in vals.items():
        m = 0.0
        for n, v in enumerate(vs, 1):
            m += (0.2 if n > 10 else 1 / n) * (v - m)
        assert got[k] == pytest.approx(m, abs=1e-12)


def test_decayed_arms(spark):
    r = random.Random(6)
    obs = [("x", c, r.gauss(0, 1)) for c in (0, 0, 1, 4, 4, 90, 91)]
    df = spark.createDataFrame(obs, "k string, cycle bigint, v double")
    got = P.decayed_arms(df, ["k"], "cycle", "v", F.lit(92), 0.9, 0.05).first()
    n = mean = m2 = 0.0
    for c in range(93):
        for _, cc, v in obs:
            if cc == c:
                n += 1
                d = v - mean
                mean += d / n
                m2 += d * (v - mean)
        n, mean, m2 = (n * 0.9, mean * 0.9, m2 * 0.9) if n * 0.9 >= 0.05 else (0.0, 0.0, 0.0)
    assert (got["n"], got["mean"], got["m2"]) == pytest.approx((n, mean, m2))


def test_bootstrap_brackets_the_mean_and_ignores_partitioning(spark):
    r = random.Random(8)
    df = spark.createDataFrame([("g", i, r.gauss(0.5, 1)) for i in range(800)], "g string, i bigint, v double")
    a = V.bootstrap_ci(df.repartition(5), ["g"], "v", F.col("i"), 400).first()
    b = V.bootstrap_ci(df.coalesce(1), ["g"], "v", F.col("i"), 400).first()
    assert a["ci_lo"] < a["point"] < a["ci_hi"]
    assert a["ci_hi"] - a["ci_lo"] == pytest.approx(2 * 1.96 / math.sqrt(800), rel=0.25)
    assert (a["ci_lo"], a["ci_hi"]) == pytest.approx((b["ci_lo"], b["ci_hi"]))
    p = V.bootstrap_ci(df, ["g"], "v", F.col("i"), 400, method="percentile").first()
    assert p["ci_lo"] < p["point"] < p["ci_hi"]


def test_permutation_separates_edge_from_noise(spark):
    r = random.Random(9)
    xs = [(i, x, x + r.gauss(0, 1), r.gauss(0, 1)) for i, x in enumerate(r.gauss(0, 1) for _ in range(120))]
    df = spark.createDataFrame(xs, "i bigint, x double, y double, z double")
    assert Y.permutation_pvalue(df, "x", "y", "i", 60).first()["p_value"] < 0.05
    assert Y.permutation_pvalue(df, "x", "z", "i", 60).first()["p_value"] > 0.02


def test_average_ranks_and_quantile(spark):
    vals = [3.0, 1.0, 3.0, 2.0, 3.0, 1.0, 9.0]
    df = spark.createDataFrame(list(enumerate(vals)), "i int, v double")
    got = {r["i"]: r["r"] for r in Y.average_ranks(df, "v", [], "r").collect()}
    for i, v in enumerate(vals):
        same = [j for j, u in enumerate(sorted(vals)) if u == v]
        assert got[i] == sum(same) / len(same)
    q = Y.rank_quantile(df.withColumn("k", F.lit(1)), ["k"], "v", F.lit(0.35)).first()["q"]
    s = sorted(vals)
    assert q == pytest.approx(s[2] + 0.1 * (s[3] - s[2]))


def test_fold_geometry(spark):
    df = spark.createDataFrame([("a", i) for i in range(103)], "product string, ts int")
    x = R.fold_roles(df, 4, 5).groupBy("fold", "role").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    got = {(r["fold"], r["role"]): (r["a"], r["b"]) for r in x}
    step = 103 // 5
    for k in range(1, 5):
        assert got[k, "train"] == (0, step * k - 1)
        assert got[k, "test"] == (step * k + 5, (step * (k + 1) if k < 4 else 103) - 1)
    assert R.fold_roles(df.limit(3), 4, 0).count() == 0


def test_recent_mean_weighs_every_row(spark):
    from marketlab.operators.posteriors import recent_mean

    rows = spark.range(2000).selectExpr("'k' as k", "id", "cast(id % 7 as double) as v", "id div 300 as piece")
    mean = 0.0
    for i in range(2000):
        mean = (mean * i + i % 7) / (i + 1) if i < 10 else mean + 0.01 * (i % 7 - mean)
    got = recent_mean(rows, ["k"], ["id"], "v", 0.01, chunks=["piece"]).first()
    assert got["n"] == 2000 and abs(got["mean"] - mean) < 1e-9
    assert abs(recent_mean(rows.withColumn("v", rows.v * 0 + 1), ["k"], ["id"], "v", 0.01).first()["mean"] - 1) < 1e-9


def test_shuffles_are_bijections_and_differ():
    import numpy as np
    for n in (1, 2, 3, 10, 997):
        seen = set()
        for b in range(1, 30):
            p = Y.shuffled_place(np.arange(n), np.full(n, n), np.full(n, b))
            assert sorted(p.tolist()) == list(range(n))
            seen.add(tuple(p.tolist()))
        assert len(seen) > (25 if n > 9 else 0)
    sums = [int((np.arange(500) * Y.shuffled_place(np.arange(500), np.full(500, 500), np.full(500, b))).sum()) for b in range(300)]
    want, sd = 500 * 249.5 ** 2, 500 * (500 ** 2 - 1) / 12 / 499 ** 0.5
    assert abs(np.mean(sums) - want) < sd / 4 and 0.85 < np.std(sums) / sd < 1.15


def test_window_drops_equal_a_walk():
    import numpy as np
    rng = np.random.default_rng(3)
    for n, frac in ((0, 0.5), (1, 0.5), (300, 0.1), (300, 0.9), (300, 1.0), (300, 1.5), (64, 0.0)):
        v = np.round(rng.normal(0.2, 3, n), 1) * (rng.random(n) < 0.8)
        start = rng.integers(0, n + 1, 200)
        stop = np.minimum(n, start + rng.integers(0, 80, 200))
        want = []
        for a, b in zip(start, stop):
            cum = peak = worst = 0.0
            near = False
            for x in v[a:b]:
                cum += x
                peak = max(peak, cum)
                ratio = (peak - cum) / max(abs(peak), 1e-9)
                worst, near = max(worst, ratio), near or abs(ratio - frac) < 1e-6
            want.append(None if near else worst >= frac)
        got = G.window_drops(v, start, stop, frac)
        assert all(w is None or w == g for w, g in zip(want, got)) and (frac <= 0 or want.count(None) < 50)


def test_protection_locks_without_drawdowns(spark):
    t = [("a", T0 + dt.timedelta(minutes=i), 1.0, 100.0, p, "target") for i, p in enumerate([5.0, -4.8, 0.0, 1.0] * 5)]
    df = spark.createDataFrame(t, "product string, closed timestamp, qty double, entry double, pnl double, exit_reason string")
    rows = {r["closed"]: r for r in G.protection_locks(df, dd_limit=2, dd_frac=0.9, low_limit=0).collect()}
    assert rows[T0]["reason"] is None and len(rows) == 20
    assert all(r["reason"] == "MaxDrawdown" for c, r in rows.items() if c > T0)
    assert G.protection_locks(df.limit(0)).count() == 0


def test_loss_scale(spark):
    pnl = [1.0, -1.0, 0.0, -2.0, -1.0, -1.0, 3.0, -1.0]
    df = spark.createDataFrame([(i, i // 3, p) for i, p in enumerate(pnl)], "i int, c int, pnl double")
    got = [(r["consecutive_losses"], round(r["risk_scale"], 9)) for r in G.loss_scale(df, ["i"], ["c"]).orderBy("i").collect()]
    assert got == [(0, 1.0), (1, 0.8), (2, 0.6), (3, 0.4), (4, 0.25), (5, 0.25), (0, 1.0), (1, 0.8)]


def test_drift_check(spark):
    def rows(n, shift):
        return spark.createDataFrame([(f, float(i % 10) + shift * (f == "b")) for i in range(n) for f in "ab"], "f string, v double")
    r = Y.drift_check(rows(200, 0), rows(100, 5), "f", "v").first()
    assert (r["ready"], r["drifting"], r["worst_feature"]) == (True, True, "b") and r["worst_psi"] > 0.25
    r = Y.drift_check(rows(200, 0), rows(70, 5), "f", "v").first()
    assert (r["ready"], r["drifting"], r["worst_feature"], r["worst_psi"]) == (False, False, None, 0.0)
    r = Y.drift_check(rows(200, 0).limit(0), rows(70, 5).limit(0), "f", "v").first()
    assert (r["ready"], r["drifting"], r["worst_feature"], r["worst_psi"]) == (False, False, None, 0.0)


def test_direction_gate_abstains(spark):
    pts = spark.createDataFrame([("a", i, 1.5 if i % 2 else -1.0, 1 if i % 2 else -1) for i in range(60)] + [("b", i, 0.5, 1) for i in range(39)] + [("b", 99, None, 1)],
                                "product string, ts int, align double, favored int")
    q = spark.createDataFrame([("a", 1, 7.0, -1), ("a", 2, 1.0, 1), ("a", 3, None, -1), ("b", 4, 0.5, -1), ("c", 5, 0.9, -1)], "product string, id int, align double, direction int")
    got = {r["id"]: (r["in_long"], r["in_short"], r["veto"]) for r in Y.direction_conformal(pts, q, "product").collect()}
    assert got == {1: (True, False, True), 2: (True, False, False), 3: (True, True, False), 4: (True, True, False), 5: (True, True, False)}


def test_composites_move_by_their_regimes_bias(spark):
    edges = spark.createDataFrame([("up", 0.05), ("none", 0.0)], "regime string, bias double")
    calls = spark.createDataFrame([(1, "up", -0.02, 0.3), (2, "up", 0.0, 0.0), (3, "up", -0.2, 0.4), (4, "none", -0.01, 0.2), (5, "new", 0.1, 0.0), (6, None, 0.0, 0.0), (7, "up", None, 0.1)],
                                  "id int, regime string, composite double, confidence double")
    got = {r["id"]: (None if r["composite"] is None else round(r["composite"], 6), r["flipped"], r["direction"], round(r["confidence"], 6)) for r in P.adjusted(calls, edges).collect()}
    assert got == {1: (0.03, True, 1, 0.3), 2: (0.05, False, 1, 0.025), 3: (-0.15, False, -1, 0.4), 4: (-0.01, False, -1, 0.2), 5: (0.1, False, 1, 0.05),
                   6: (0.0, False, -1, 0.0), 7: (None, False, None, 0.1)}
