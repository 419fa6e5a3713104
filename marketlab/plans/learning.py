"""Scoring, posteriors, validity and promotion queries."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlab.functions import mathx as M
from marketlab.functions.mathx import r6
from marketlab.operators import joins as J
from marketlab.operators import labels as L
from marketlab.operators import ledger as G
from marketlab.operators import posteriors as P
from marketlab.operators import rules as R
from marketlab.operators import validity as V
from marketlab.plans.decision import FOLDS, backtest
from marketlab.plans.price import CANDLES, FEAT, PW
from marketlab.plans.registry import query
from marketlab.plans.timejoins import JV, LABELS, OBJ, labels, near_sql, objectives
from marketlab.plans.trades import RET, TR
from marketlab.plans.views import with_views
from marketlab.sources import tables as T

LAB = LABELS + """, sc AS (SELECT *, product AS regime, greatest(-0.05, least(0.05, aligned)) * confidence AS lesson FROM lab WHERE state = 'scored')
"""


def scored(spark, d):
    x = labels(spark, d).where("state = 'scored'")
    return L.clipped_lesson(x, 1.0, 0.05).withColumn("regime", F.col("product"))


@query("A6", LAB + """,
t AS (SELECT * FROM sc)
SELECT strategy, count(*) AS n, sum(CAST(aligned > 0 AS INT)) AS hits, round(avg(CAST(aligned > 0 AS INT)), 6) AS hit_rate, round(avg(aligned), 6) AS mean_fwd_return FROM t GROUP BY 1""")
def strategy_scoring(spark, d):
    t = scored(spark, d)
    hit = (F.col("fwd_return_aligned") > 0).cast("int")
    return t.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), r6(F.avg(hit)).alias("hit_rate"),
                                     r6(F.avg("fwd_return_aligned")).alias("mean_fwd_return"))


@query("A7", LAB + """, dim AS (SELECT DISTINCT 'S' || CAST(user_id % 17 AS VARCHAR) AS strategy FROM events), g AS (SELECT strategy, count(*) AS n, avg(aligned * confidence) * 1e4 AS bps, avg(CAST(aligned > 0 AS INT)) AS hit FROM sc GROUP BY 1)
SELECT strategy, coalesce(n, 0) AS n, round(bps, 4) AS avg_aligned_return_bps, round(hit, 6) AS hit_rate FROM dim LEFT JOIN g USING (strategy)""")
def strategy_stats(spark, d):
    dim = T.load(spark, d, "events").select(F.concat(F.lit("S"), F.col("user_id") % 17).alias("strategy")).distinct()
    a = F.col("fwd_return_aligned")
    g = scored(spark, d).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), (F.avg(a * F.col("confidence")) * 1e4).alias("b"), F.avg((a > 0).cast("int")).alias("h"))
    return g.join(dim, "strategy", "right").select("strategy", F.coalesce("n", F.lit(0)).alias("n"), r6(F.col("b"), 4).alias("avg_aligned_return_bps"), r6(F.col("h")).alias("hit_rate"))


OV = "CASE WHEN {n} >= 2 THEN greatest({m2} / ({n} - 1), 2.25e-6) ELSE 2.25e-6 END"
OV2 = OV.replace("2.25e-6", "1e-4")
ARMS = LAB + f""", arm AS (SELECT regime, strategy, count(*) * 1.0 AS n, avg(lesson) AS mean, var_pop(lesson) * count(*) AS m2 FROM sc GROUP BY 1, 2),
pl AS (SELECT *, sum(n) OVER s - n AS pn, (sum(n * mean) OVER s - n * mean) AS ps, (sum(m2 + n * mean * mean) OVER s - m2 - n * mean * mean) AS pq FROM arm WINDOW s AS (PARTITION BY strategy)),
p2 AS (SELECT *, CASE WHEN pn > 1e-9 THEN ps / pn ELSE 0 END AS pmean, least(pn, 30) AS ne FROM pl), p3 AS (SELECT *, greatest(0, pq - pn * pmean * pmean) AS pm2 FROM p2),
p4 AS (SELECT *, CASE WHEN pn > 1e-9 THEN ne / {OV.format(n='ne', m2='pm2')} ELSE 0 END AS pl FROM p3),
p5 AS (SELECT *, CASE WHEN pn > 1e-9 THEN pl * pmean / (1 / 2.25e-6 + pl) ELSE 0 END AS prm, CASE WHEN pn > 1e-9 THEN 1 / (1 / 2.25e-6 + pl) + 2.25e-6 * 6 / ne ELSE 2.25e-6 END AS prv FROM p4),
p6 AS (SELECT *, n / {OV.format(n='n', m2='m2')} AS lk FROM p5),
post AS (SELECT *, (prm / prv + lk * mean) / (1 / prv + lk) AS pmu, sqrt(1 / (1 / prv + lk)) AS psd, NOT (n >= 25 AND mean < 0 AND mean + sqrt({OV.format(n='n', m2='m2')} / n) < 0) AS ok FROM p6)
"""


def arms(spark, d):
    return P.arms(scored(spark, d), ["regime", "strategy"], "lesson")


@query("A16 X4", ARMS + "SELECT regime, strategy, CAST(n AS BIGINT) AS n, round(mean, 8) AS mean, round(m2, 8) AS m2, round(pmu, 8) AS post_mean, round(psd, 8) AS post_sd, ok AS net_edge_ok FROM post")
def arm_posteriors(spark, d):
    x = P.posteriors(arms(spark, d))
    return x.select("regime", "strategy", F.col("n").cast("bigint").alias("n"), *[r6(F.col(c), 8).alias(c) for c in ("mean", "m2", "post_mean", "post_sd")], "net_edge_ok")


ALLOC = ARMS + """, al AS (SELECT *, strategy IN ('S3', 'S7') AS silent, CASE WHEN ok THEN pmu ELSE least(pmu, -psd) END AS dr FROM post),
a1 AS (SELECT *, CASE WHEN NOT silent THEN exp(400 * (dr - max(CASE WHEN NOT silent THEN dr END) OVER (PARTITION BY regime))) END AS e FROM al),
a2 AS (SELECT *, CASE WHEN silent THEN 0 ELSE greatest(CASE WHEN ok THEN 0.04 ELSE 0 END, 0.35 * e / sum(e) OVER (PARTITION BY regime) + 0.65 / 13) END AS m FROM a1),
alloc AS (SELECT *, m / sum(m) OVER (PARTITION BY regime) AS weight FROM a2)
"""


def weights(spark, d):
    return P.allocate(P.posteriors(arms(spark, d)), F.lit(1 / 13), F.col("strategy").isin("S3", "S7"))


@query("A18 F9", ALLOC + "SELECT regime, strategy, round(weight, 4) AS weight FROM alloc")
def allocation_weights(spark, d):
    return weights(spark, d).select("regime", "strategy", r6(F.col("weight"), 4).alias("weight"))


@query("K10", ALLOC + "SELECT regime, strategy, place, round(mw, 6) AS mean_weight FROM (SELECT *, rank() OVER (PARTITION BY regime ORDER BY round(weight, 4) DESC) AS place, avg(round(weight, 4)) OVER (PARTITION BY regime) AS mw FROM alloc) WHERE strategy = 'S1'")
def arm_rank(spark, d):
    w = W.partitionBy("regime")
    x = weights(spark, d).withColumns({"place": F.rank().over(w.orderBy(F.desc("weight"))).cast("bigint"), "mw": F.avg("weight").over(w)})
    return x.where("strategy = 'S1'").select("regime", "strategy", "place", r6(F.col("mw")).alias("mean_weight"))


@query("A65", ALLOC + """, q AS (SELECT regime, avg(CASE WHEN NOT silent THEN abs(round(pmu * 1e4, 2)) END) AS mb, max(CASE WHEN NOT silent THEN abs(round(pmu * 1e4, 2)) END) AS xb, sum(CASE WHEN silent THEN round(weight, 4) ELSE 0 END) AS gw FROM alloc GROUP BY 1)
SELECT regime, round(mb, 4) AS mean_abs_bps, round(mb - lag(mb) OVER (ORDER BY regime), 4) AS mean_abs_bps_delta, round(xb, 4) AS max_abs_bps, round(gw, 4) AS ghost_weight FROM q""")
def cycle_quality(spark, d):
    live = ~F.col("strategy").isin("S3", "S7")
    q = weights(spark, d).groupBy("regime").agg(F.avg(F.when(live, F.abs("mean_bps"))).alias("mb"), F.max(F.when(live, F.abs("mean_bps"))).alias("xb"),
                                                F.sum(F.when(~live, F.col("weight")).otherwise(0.0)).alias("gw"))
    # one row per cycle: the cycle table is bounded by time, so a window over it is small
    prev = F.lag("mb").over(W.partitionBy(F.lit(0)).orderBy("regime"))
    return q.select("regime", r6(F.col("mb"), 4).alias("mean_abs_bps"), r6(F.col("mb") - prev, 4).alias("mean_abs_bps_delta"), r6(F.col("xb"), 4).alias("max_abs_bps"), r6(F.col("gw"), 4).alias("ghost_weight"))


@query("A17 X5", LAB.replace("WITH ", "WITH RECURSIVE ", 1) + """, per AS (SELECT regime, strategy, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS c, CAST(count(*) AS DOUBLE) AS bn, avg(lesson) AS bm, var_pop(lesson) * count(*) AS b2 FROM sc GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY regime, strategy ORDER BY c) AS i, max(c) OVER () AS last FROM per),
f(regime, strategy, i, c, n, mean, m2, last) AS (SELECT regime, strategy, i, c, bn, bm, b2, last FROM o WHERE i = 1 UNION ALL
  SELECT o.regime, o.strategy, o.i, o.c, a.n * a.g + bn, a.mean * a.g + (bm - a.mean * a.g) * bn / (a.n * a.g + bn), a.m2 * a.g + b2 + (bm - a.mean * a.g) * (bm - a.mean * a.g) * a.n * a.g * bn / (a.n * a.g + bn), o.last
  FROM o JOIN (SELECT f.*, nx.c AS nc, CASE WHEN f.n * power(0.9, nx.c - f.c) >= 0.05 THEN power(0.9, nx.c - f.c) ELSE 0 END AS g FROM f JOIN o nx ON nx.regime = f.regime AND nx.strategy = f.strategy AND nx.i = f.i + 1) a
  ON o.regime = a.regime AND o.strategy = a.strategy AND o.i = a.i + 1),
z AS (SELECT *, power(0.9, last + 1 - c) AS g FROM f QUALIFY row_number() OVER (PARTITION BY regime, strategy ORDER BY i DESC) = 1)
SELECT regime, strategy, round(n * g, 6) AS n, round(mean * g, 8) AS mean, round(m2 * g, 8) AS m2 FROM z WHERE n * g >= 0.05""")
def arm_decay(spark, d):
    x = scored(spark, d).withColumn("cycle", F.floor(F.unix_seconds("ts") / 86400))
    last = x.agg(F.max("cycle").alias("_last"))
    y = x.crossJoin(F.broadcast(last))
    out = P.decayed_arms(y, ["regime", "strategy", "_last"], "cycle", "lesson", F.col("_last"), 0.9)
    return out.select("regime", "strategy", r6(F.col("n")).alias("n"), r6(F.col("mean"), 8).alias("mean"), r6(F.col("m2"), 8).alias("m2"))


FOLD_MEAN = """, o AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS i FROM {src} WHERE x IS NOT NULL),
f({k}, i, m) AS (SELECT {k}, i, x FROM o WHERE i = 1 UNION ALL SELECT {ok}, o.i, f.m + (CASE WHEN o.i > 10 THEN {a} ELSE 1.0 / o.i END) * (o.x - f.m) FROM f JOIN o ON {on} AND o.i = f.i + 1),
fm AS (SELECT {k}, i AS n, m FROM f QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY i DESC) = 1)
"""


EDGE = (TR.replace("WITH ", "WITH RECURSIVE ", 1) + f""", dx AS (SELECT regime_at_entry AS regime, product, side, {RET} AS x, * EXCLUDE (product, side) FROM trades)"""
        + FOLD_MEAN.format(k="regime, side", ok="o.regime, o.side", on="o.regime = f.regime AND o.side = f.side", a="0.2", src="dx", o=", ".join(T.TRADE_ORDER)) + """
, p AS (SELECT regime, max(CASE WHEN side = 1 THEN m END) AS le, max(CASE WHEN side = -1 THEN m END) AS se, least(1, min(n) / 15.0) AS cf FROM fm GROUP BY 1),
bs AS (SELECT regime, le, se, greatest(-0.25, least(0.25, (le - se) * 8 * cf)) AS bias FROM p)
""")


def direction_edges(spark, d):
    x = T.trades(spark, d).withColumn("x", G.trade_return()).withColumn("regime", F.col("regime_at_entry"))
    return P.direction_bias(P.recent_mean(x, ["regime", "side"], T.TRADE_ORDER, "x", 0.2, chunks=T.TRADE_LEVELS))


@query("A19", EDGE + "SELECT regime, round(le, 8) AS long_edge, round(se, 8) AS short_edge, round(bias, 8) AS bias FROM bs")
def direction_edge(spark, d):
    return direction_edges(spark, d).select("regime", *[r6(F.col(c), 8).alias(c) for c in ("long_edge", "short_edge", "bias")])


@query("A19 (adjust)", EDGE + """, c AS (SELECT regime, (o_custkey % 101 - 50) / 1000.0 AS old, bias FROM orders JOIN bs ON o_orderpriority = regime),
a AS (SELECT *, old + bias AS new, CASE WHEN old = 0 THEN 0 ELSE 0.3 END AS conf FROM c)
SELECT regime, CASE WHEN new > 0 THEN 1 ELSE -1 END AS direction, count(*) AS n, sum(CAST(bias <> 0 AND (new > 0) <> (old > 0) AND abs(old) > 1e-9 AS INT)) AS n_flipped,
  round(avg(new), 8) AS composite, round(avg(CASE WHEN conf = 0 AND new <> 0 THEN least(1, abs(new) * 0.5) ELSE conf END), 8) AS confidence FROM a GROUP BY 1, 2""")
def direction_adjust(spark, d):
    old = (F.col("o_custkey") % 101 - 50) / 1000.0
    calls = T.load(spark, d, "orders").select(F.col("o_orderpriority").alias("regime"), old.alias("composite"), F.when(old == 0, 0.0).otherwise(0.3).alias("confidence"))
    x = P.adjusted(calls, direction_edges(spark, d))
    return x.groupBy("regime", "direction").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("flipped").cast("int")).alias("n_flipped"),
                                                *[r6(F.avg(c), 8).alias(c) for c in ("composite", "confidence")])


STATES = JV.replace("WITH ", "WITH RECURSIVE ", 1) + """, ex AS (SELECT event_id, event_type AS product, ts, 100 + value AS price, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS side, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
""" + near_sql("ex", 1800, "q1") + """, sx AS (SELECT ex.*, CASE WHEN side > 0 THEN 'with' ELSE 'against' END || '/' || CASE WHEN k >= 50 THEN 'win' ELSE 'big_loss' END AS state, side * (px / price - 1) AS x FROM ex JOIN q1 USING (event_id))
"""


def exits(spark, d):
    t = T.ticks(spark, d)
    ex = t.withColumn("side", F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1))
    ex = ex.withColumn("state", F.concat_ws("/", F.when(F.col("side") > 0, "with").otherwise("against"), F.when(F.col("size") >= 51, "win").otherwise("big_loss"))).drop("size")
    return L.exit_counterfactual(ex, t)


@query("A20 K7", STATES + FOLD_MEAN.format(k="state", ok="o.state", on="o.state = f.state", a="0.15", src="sx", o="ts, event_id") + " SELECT state, n, round(m, 8) AS mean_next_return FROM fm WHERE n >= 5 ORDER BY m LIMIT 6")
def worst_hold_states(spark, d):
    x = P.recent_mean(exits(spark, d).withColumn("day", F.to_date("ts")), ["state"], ["ts", "event_id"], "hold_return", 0.15, chunks=["day"])
    return x.where("n >= 5").orderBy("mean", "state").limit(6).select("state", "n", r6(F.col("mean"), 8).alias("mean_next_return"))


@query("A21", STATES + f""", arm AS (SELECT product AS mechanism, CASE WHEN side > 0 THEN 'with' ELSE 'against' END AS regime, CASE WHEN k >= 66 THEN 'hi' WHEN k >= 33 THEN 'mid' ELSE 'lo' END AS bucket, count(x) * 1.0 AS n, avg(-x) AS mean, var_pop(-x) * count(x) AS m2 FROM sx GROUP BY 1, 2, 3),
pl AS (SELECT *, sum(n) OVER s - n AS pn, sum(n * mean) OVER s - n * mean AS ps, sum(m2 + n * mean * mean) OVER s - m2 - n * mean * mean AS pq FROM arm WINDOW s AS (PARTITION BY mechanism, regime)),
p2 AS (SELECT *, ps / pn AS pmean, least(pn, 30) AS ne FROM pl), p3 AS (SELECT *, greatest(0, pq - pn * pmean * pmean) AS pm2 FROM p2), p4 AS (SELECT *, ne / {OV2.format(n='ne', m2='pm2')} AS pl FROM p3),
p5 AS (SELECT *, pl * pmean / (1 / 1e-4 + pl) AS prm, 1 / (1 / 1e-4 + pl) + 1e-4 * 6 / ne AS prv, n / {OV2.format(n='n', m2='m2')} AS lk FROM p4),
z AS (SELECT *, (prm / prv + lk * mean) / (1 / prv + lk) AS mu, sqrt(1 / (1 / prv + lk)) AS sd FROM p5)
SELECT mechanism, regime, bucket, CAST(n AS BIGINT) AS n, round(mu, 8) AS post_mean, round(exp(ln(1.5) * greatest(-3, least(3, mu / sd)) / 3), 6) AS factor FROM z""")
def exit_throttle_factor(spark, d):
    x = exits(spark, d).withColumns({"k": F.col("price") * 0})
    e = T.load(spark, d, "events").select("event_id", T.k_of().alias("k"))
    x = x.drop("k").join(e, "event_id").select(F.col("product").alias("mechanism"), F.when(F.col("side") > 0, "with").otherwise("against").alias("regime"),
                                               F.when(F.col("k") >= 66, "hi").when(F.col("k") >= 33, "mid").otherwise("lo").alias("bucket"), "exit_edge")
    y = P.throttle(P.arms(x, ["mechanism", "regime", "bucket"], "exit_edge"))
    return y.select("mechanism", "regime", "bucket", F.col("n").cast("bigint").alias("n"), r6(F.col("post_mean"), 8).alias("post_mean"), r6(F.col("factor")).alias("factor"))


@query("A22 F16", TR + """, v AS (SELECT *, unnest([{'s': 'trend', 'v': l_discount * 10 - 0.5}, {'s': 'meanrev', 'v': l_tax * 10 - 0.4}, {'s': 'breakout', 'v': l_quantity / 50}]) AS u FROM trades),
c AS (SELECT u.s AS strategy, abs(u.v) / (abs(l_discount * 10 - 0.5) + abs(l_tax * 10 - 0.4) + abs(l_quantity / 50)) AS share, CASE WHEN u.v > 0 THEN 1 ELSE -1 END * pnl / (qty * entry) AS al FROM v WHERE abs(u.v) > 0.05)
SELECT strategy, count(*) AS n, round(sum(al * share * 2 * CASE WHEN al < 0 THEN 5 ELSE 1 END), 4) AS credit FROM c GROUP BY 1""".replace(
    "(abs(l_discount * 10 - 0.5) + abs(l_tax * 10 - 0.4) + abs(l_quantity / 50))",
    "(CASE WHEN abs(l_discount * 10 - 0.5) > 0.05 THEN abs(l_discount * 10 - 0.5) ELSE 0 END + CASE WHEN abs(l_tax * 10 - 0.4) > 0.05 THEN abs(l_tax * 10 - 0.4) ELSE 0 END + CASE WHEN abs(l_quantity / 50) > 0.05 THEN abs(l_quantity / 50) ELSE 0 END)"))
def vote_attribution(spark, d):
    votes = F.create_map(F.lit("trend"), F.col("l_discount") * 10 - 0.5, F.lit("meanrev"), F.col("l_tax") * 10 - 0.4, F.lit("breakout"), F.col("l_quantity") / 50)
    t = T.trades(spark, d).withColumn("votes", F.map_filter(votes, lambda k, v: F.abs(v) > 0.05))
    return L.vote_attribution(t).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("credit"), 4).alias("credit"))


def cdf_sql(x):
    def horner(cs, v):
        e = repr(cs[0])
        for c in cs[1:]:
            e = f"({e} * {v} + {c!r})"
        return e
    z = f"abs({x})"
    near = f"exp(-{z} * {z} / 2) * {horner(M.HART_NUM, z)} / {horner(M.HART_DEN, z)}"
    frac = f"({z} + 0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        frac = f"({z} + {k} / {frac})"
    tail = f"CASE WHEN {z} > 37 THEN 0 WHEN {z} < 7.07106781186547 THEN {near} ELSE exp(-{z} * {z} / 2) / {frac} / 2.506628274631 END"
    return f"CASE WHEN {x} > 0 THEN 1 - ({tail}) ELSE {tail} END"


def ppf(p):
    """Acklam's quantile in Python, for constants in oracle text."""
    if p > 1 - M.ACKLAM_LOW:
        q = math.sqrt(-2 * math.log(1 - p))
        num = den = 0.0
        for c in M.ACKLAM_C:
            num = num * q + c
        for c in M.ACKLAM_D + [1.0]:
            den = den * q + c
        return -num / den
    q = p - 0.5
    r, num, den = q * q, 0.0, 0.0
    for c in M.ACKLAM_A:
        num = num * r + c
    for c in M.ACKLAM_B + [1.0]:
        den = den * r + c
    return num * q / den


SR0 = 0.05 * ((1 - M.EULER_GAMMA) * ppf(1 - 1 / 100) + M.EULER_GAMMA * ppf(1 - 1 / (100 * math.e)))


@query("A11 F8", TR + f""", x AS (SELECT product, date_trunc('month', closed) AS mon, {RET} AS r FROM trades), y AS (SELECT product, mon, avg(r) AS r FROM x GROUP BY 1, 2), m AS (SELECT product, avg(r) AS m, stddev_pop(r) AS s FROM y GROUP BY 1),
k AS (SELECT product, count(*) AS n, any_value(m / s) AS sr, avg(power((r - m) / s, 3)) AS sk, avg(power((r - m) / s, 4)) AS ku FROM y JOIN m USING (product) GROUP BY 1),
z AS (SELECT *, (sr - 0.9) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) AS z1, (sr - {SR0!r}) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) AS z2 FROM k)
SELECT product, n, round(sr, 6) AS sharpe, round({cdf_sql('z1')}, 6) AS psr, round({cdf_sql('z2')}, 6) AS dsr FROM z""")
def deflated_sharpe(spark, d):
    x = T.trades(spark, d).groupBy("product", F.date_trunc("month", "closed").alias("mon")).agg(F.avg(G.trade_return()).alias("r"))
    y = V.deflated_sharpe(x, ["product"], "r", 100, 0.05)
    y = V.probabilistic_sharpe(y, "psr", 0.9)
    return y.select("product", "n", *[r6(F.col(c)).alias(c) for c in ("sharpe", "psr", "dsr")])


@query("A12", TR + f""", y AS (SELECT product, date_trunc('week', closed) AS wk, avg({RET}) AS r FROM trades GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY wk) - 1 AS t FROM y),
mn AS (SELECT min(n) AS tt FROM (SELECT count(*) AS n FROM t GROUP BY product)), b AS (SELECT product, t // (tt // 6) AS b, count(*) AS n, sum(r) AS s, sum(r * r) AS q FROM t, mn WHERE t // (tt // 6) < 6 GROUP BY 1, 2),
sp AS (SELECT m FROM range(64) r(m) WHERE bit_count(CAST(m AS INT)) = 3),
p AS (SELECT m, product, sum(n) FILTER (WHERE (m >> b) & 1 = 1) AS n1, sum(s) FILTER (WHERE (m >> b) & 1 = 1) AS s1, sum(q) FILTER (WHERE (m >> b) & 1 = 1) AS q1,
  sum(n) FILTER (WHERE (m >> b) & 1 = 0) AS n0, sum(s) FILTER (WHERE (m >> b) & 1 = 0) AS s0, sum(q) FILTER (WHERE (m >> b) & 1 = 0) AS q0 FROM b, sp GROUP BY 1, 2),
f AS (SELECT m, product, s1 / n1 / sqrt(q1 / n1 - (s1 / n1) * (s1 / n1)) AS isp, s0 / n0 / sqrt(q0 / n0 - (s0 / n0) * (s0 / n0)) AS oos FROM p),
g AS (SELECT *, first_value(oos) OVER (PARTITION BY m ORDER BY isp DESC, product) AS best FROM f), k AS (SELECT m, greatest(1e-6, least(1 - 1e-6, avg(CAST(oos <= best AS INT)))) AS rk FROM g GROUP BY 1)
SELECT count(*) AS n_splits, round(avg(CAST(ln(rk / (1 - rk)) <= 0 AS INT)), 6) AS pbo, round(avg(ln(rk / (1 - rk))), 6) AS mean_logit FROM k""")
def pbo_cscv(spark, d):
    x = T.trades(spark, d).groupBy("product", F.date_trunc("week", "closed").alias("wk")).agg(F.avg(G.trade_return()).alias("r"))
    x = x.withColumn("t", F.row_number().over(W.partitionBy("product").orderBy("wk")) - 1)
    y = V.pbo(x, "product", "t", "r", 6)
    return y.select("n_splits", r6(F.col("pbo")).alias("pbo"), r6(F.col("mean_logit")).alias("mean_logit"))


@query("A15")
def bootstrap_ci(spark, d):
    x = T.trades(spark, d).withColumn("r", G.trade_return())
    y = V.bootstrap_ci(x, ["regime_at_entry"], "r", F.concat_ws("-", *[F.col(c).cast("string") for c in T.TRADE_ORDER]), 500)
    return y.select("regime_at_entry", "n", r6(F.col("point"), 8).alias("point"), r6(F.col("ci_lo"), 8).alias("ci_lo"), r6(F.col("ci_hi"), 8).alias("ci_hi"))


WF = FEAT + FOLDS + """, te AS (SELECT *, exp(sum(ln(greatest(1 + ret, 1e-6))) OVER (PARTITION BY rule_id, product, fold ORDER BY ts)) AS eq FROM folds WHERE role = 'test'),
tp AS (SELECT *, greatest(1, max(eq) OVER (PARTITION BY rule_id, product, fold ORDER BY ts)) AS pk FROM te),
res AS (SELECT rule_id, product, fold, last(eq ORDER BY ts) - 1 AS total_return, max(1 - eq / pk) AS max_drawdown, sum(entry) AS trades FROM tp GROUP BY 1, 2, 3),
wf AS (SELECT rule_id, product, quantile_cont(total_return, 0.5) AS median_return, list_sort(list(total_return))[count(*) // 2 + 1] AS upper_median, avg(total_return) AS mean_return, max(max_drawdown) AS worst_drawdown,
  avg(CAST(total_return > 0 AS INT)) AS frac_positive, count(*) AS n_folds, sum(trades) AS total_trades FROM res GROUP BY 1, 2)
"""
WFC = ("median_return", "upper_median", "mean_return", "worst_drawdown", "frac_positive")


def walk(spark, d):
    return R.fold_roles(backtest(spark, d), 4, 24, ("rule_id", "product"), train=False)


def summary(spark, d):
    k = ["rule_id", "product"]
    return V.walk_forward_summary(V.fold_results(walk(spark, d), k), k)


@query("A49 A14", WF + f"SELECT rule_id, product, n_folds, total_trades, {', '.join(f'round({c}, 6) AS {c}' for c in WFC)} FROM wf")
def walk_forward_summary(spark, d):
    return summary(spark, d).select("rule_id", "product", "n_folds", "total_trades", *[r6(F.col(c)).alias(c) for c in WFC])


GATES = WF + f""", mm AS (SELECT rule_id, product, avg(ret) AS m, stddev_pop(ret) AS s FROM folds WHERE role = 'test' GROUP BY 1, 2),
mk AS (SELECT f.rule_id, f.product, count(*) AS n, any_value(CASE WHEN s > 0 THEN m / s ELSE 0 END) AS sr, avg(power((ret - m) / s, 3)) AS sk, avg(power((ret - m) / s, 4)) AS ku FROM folds f JOIN mm USING (rule_id, product) WHERE role = 'test' GROUP BY 1, 2),
mz AS (SELECT *, (sr - {SR0!r}) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - sk * sr + (ku - 1) / 4 * sr * sr)) AS z FROM mk),
gt AS (SELECT wf.*, {cdf_sql('z')} AS dsr, sr FROM wf JOIN mz USING (rule_id, product)),
gg AS (SELECT *, CASE WHEN total_trades < 20 THEN 'too_few_trades' WHEN frac_positive < 0.3 THEN 'not_robust' WHEN NOT (upper_median > -0.5 AND mean_return > -0.5) THEN 'oos_negative' WHEN dsr <= 0.001 THEN 'weak_sharpe' ELSE 'promoted' END AS gate FROM gt)
"""


def gated(spark, d):
    k = ["rule_id", "product"]
    dsr = V.deflated_sharpe(walk(spark, d), k, "ret", 100, 0.05).select(*k, "sharpe", "dsr")
    x = summary(spark, d).join(dsr, k).withColumns({"upper_median": F.col("upper_median") + 0.5, "mean_return": F.col("mean_return") + 0.5})
    return V.promotion_gate(x, 20, 0.3, 0.001)


@query("A50", GATES + "SELECT gate, count(*) AS n FROM gg GROUP BY 1")
def promotion_gates(spark, d):
    return gated(spark, d).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


@query("K6", GATES + "SELECT product, rule_id, round(dsr, 6) AS dsr, round(sr, 6) AS sharpe FROM gg QUALIFY row_number() OVER (PARTITION BY product ORDER BY dsr DESC, sr DESC, rule_id) <= 2")
def top_rules(spark, d):
    w = W.partitionBy("product").orderBy(F.desc("dsr"), F.desc("sharpe"), "rule_id")
    x = gated(spark, d).withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    return x.select("product", "rule_id", r6(F.col("dsr")).alias("dsr"), r6(F.col("sharpe")).alias("sharpe"))


@query("A51", CANDLES + f""", r AS (SELECT *, row_number() OVER {PW} AS rn, close / lag(close) OVER {PW} - 1 AS r FROM candles)
SELECT product, round(last(close ORDER BY ts) / first(close ORDER BY ts) * 0.995 * 0.995 - 1, 6) AS total_return, round(avg(CASE WHEN rn > 61 THEN r END) / stddev_samp(CASE WHEN rn > 61 THEN r END) * sqrt(8760), 6) AS sharpe_annualized, count(*) AS n
FROM r WHERE rn > 60 GROUP BY 1""")
def benchmark_buy_hold(spark, d):
    x = V.buy_hold(T.candles(spark, d))
    return x.select("product", r6(F.col("total_return")).alias("total_return"), r6(F.col("sharpe_annualized")).alias("sharpe_annualized"), "n")


@query("W34", OBJ + """, f AS (SELECT *, CAST(-safety * 100 AS INT) % 3 AS front FROM c), w AS (SELECT *, (lead(profit) OVER (PARTITION BY front ORDER BY profit, sid) - lag(profit) OVER (PARTITION BY front ORDER BY profit, sid)) / (max(profit) OVER p - min(profit) OVER p) AS d0,
  (lead(size) OVER (PARTITION BY front ORDER BY size, sid) - lag(size) OVER (PARTITION BY front ORDER BY size, sid)) / (max(size) OVER p - min(size) OVER p) AS d1 FROM f WINDOW p AS (PARTITION BY front))
SELECT sid, front, round(d0 + d1, 6) AS crowding FROM w""")
def crowding_distance(spark, d):
    x = objectives(spark, d).withColumn("front", (-F.col("safety") * 100).cast("int") % 3)
    return V.crowding(x, "sid", ["profit", "size"]).select("sid", "front", r6(F.col("crowding")).alias("crowding"))


DOMS = "b.profit >= a.profit AND b.safety >= a.safety AND b.size >= a.size AND (b.profit > a.profit OR b.safety > a.safety OR b.size > a.size)"


@query("J13 (ranks)", OBJ + f"""{''.join(f", f{k} AS (SELECT * FROM r{k - 1} a WHERE NOT EXISTS (SELECT 1 FROM r{k - 1} b WHERE {DOMS})), r{k} AS (SELECT * FROM r{k - 1} WHERE sid NOT IN (SELECT sid FROM f{k}))" for k in (1, 2, 3)).replace('r0', 'c')}
SELECT front, count(*) AS n FROM (SELECT 1 AS front FROM f1 UNION ALL SELECT 2 FROM f2 UNION ALL SELECT 3 FROM f3 UNION ALL SELECT NULL FROM r3) GROUP BY 1""")
def pareto_ranks(spark, d):
    return J.pareto_ranks(objectives(spark, d), "sid", ["profit", "safety", "size"], 3).groupBy("front").agg(F.count(F.lit(1)).alias("n"))


FC = with_views("votes")


@query("A63", FC + """, s AS (SELECT CASE WHEN ttl_hours <= 24 THEN '<1d' WHEN ttl_hours <= 168 THEN '1-7d' WHEN ttl_hours <= 720 THEN '1-4w' ELSE '>1mo' END AS regime, strategy, lean * (2 * resolved_outcome0 - 1) * 0.002 AS credit FROM forecasts JOIN votes USING (id) WHERE resolved_outcome0 IS NOT NULL AND abs(lean) >= 1e-6)
SELECT regime, strategy, count(*) AS n, round(sum(credit), 6) AS credit FROM s GROUP BY 1, 2""")
def binary_attribution(spark, d):
    f = T.forecasts(spark, d).where("resolved_outcome0 is not null").dropDuplicates(["id"])
    h = F.col("ttl_hours")
    regime = F.when(h.isNull(), "unknown").when(h <= 24, "<1d").when(h <= 168, "1-7d").when(h <= 720, "1-4w").otherwise(">1mo")
    x = f.select(regime.alias("regime"), "resolved_outcome0", F.explode("votes").alias("strategy", "lean")).where(F.abs("lean") >= 1e-6)
    return x.groupBy("regime", "strategy").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("lean") * (2 * F.col("resolved_outcome0") - 1) * 0.002)).alias("credit"))
