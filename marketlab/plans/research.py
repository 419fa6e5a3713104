"""Signal studies, drift, calibration and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlab.functions.mathx import clip, r6
from marketlab.operators import forecasts as FC
from marketlab.operators import indicators as I
from marketlab.operators import joins as J
from marketlab.operators import models as M
from marketlab.operators import rules as R
from marketlab.operators import scans as S
from marketlab.operators import signals as G
from marketlab.operators import study as Y
from marketlab.plans.price import EPOCH
from marketlab.plans.registry import query
from marketlab.plans.views import K, with_views
from marketlab.sources import tables as T

PV = with_views("positions") + """, ln AS (SELECT ts, asset, sum(notional / rank * sign(direction)) / sum(notional / rank) AS lean FROM positions GROUP BY 1, 2),
px AS (SELECT asset, ts, avg(notional) AS close FROM positions GROUP BY 1, 2)
"""


def leans(spark, d):
    return Y.net_lean(T.positions(spark, d))


@query("A30 S7", PV + f"SELECT {EPOCH}, asset, round(lean, 6) AS lean FROM ln")
def net_lean(spark, d):
    return leans(spark, d).select(F.unix_seconds("ts").alias("ts"), "asset", r6(F.col("lean")).alias("lean"))


PAIRS = PV + """, pairs AS (SELECT l.asset, l.ts, round(l.lean, 9) AS lean, round(b.close / a.close - 1, 9) AS ret FROM ln l ASOF JOIN px a ON l.asset = a.asset AND l.ts >= a.ts
  ASOF JOIN px b ON l.asset = b.asset AND l.ts + INTERVAL 1 DAY <= b.ts)
"""


def aligned(spark, d):
    px = T.positions(spark, d).groupBy("asset", "ts").agg(F.avg("notional").alias("close"))
    x = J.horizon_return(leans(spark, d), px, 86400, "asset")
    # nine digits, so that ties do not depend on the order of summation
    return x.where("ret is not null").select("asset", "ts", F.round("lean", 9).alias("lean"), F.round("ret", 9).alias("ret"))


def ranks_sql(part):
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, " if part else "PARTITION BY "
    return f""", rk AS (SELECT *, rank() OVER ({p}ORDER BY lean) + (count(*) OVER ({q}lean) - 1) / 2 AS rs, rank() OVER ({p}ORDER BY ret) + (count(*) OVER ({q}ret) - 1) / 2 AS rr FROM pairs)
"""


@query("A31", PAIRS + ranks_sql("asset") + "SELECT asset, count(*) AS n, round(corr(rs, rr), 6) AS ic, round(corr(lean, ret), 6) AS pearson FROM rk GROUP BY 1")
def rank_ic(spark, d):
    x = Y.rank_ic(aligned(spark, d), "lean", "ret", ["asset"])
    return x.select("asset", "n", r6(F.col("ic")).alias("ic"), r6(F.col("pearson")).alias("pearson"))


@query("A31 (pooled)", PAIRS + ranks_sql("") + "SELECT count(*) AS n, round(corr(rs, rr), 6) AS ic, round(corr(lean, ret), 6) AS pearson FROM rk")
def rank_ic_pooled(spark, d):
    return Y.rank_ic(aligned(spark, d), "lean", "ret").select("n", r6(F.col("ic")).alias("ic"), r6(F.col("pearson")).alias("pearson"))


@query("A32", PAIRS + """, lm AS (SELECT min(lean) AS la, max(lean) AS lb, min(ret) AS ra, max(ret) AS rb FROM pairs), c AS (SELECT least(5, floor((lean - la) / (lb - la) * 6)) AS i, least(5, floor((ret - ra) / (rb - ra) * 6)) AS j, count(*) AS c FROM pairs, lm GROUP BY 1, 2),
h AS (SELECT *, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY i) AS r, sum(c) OVER (PARTITION BY j) AS q FROM c) SELECT CAST(any_value(n) AS BIGINT) AS n, round(sum(c / n * ln(c * n / (r * q) + 1e-12)), 6) AS mutual_info FROM h""")
def mutual_info(spark, d):
    return Y.mutual_info(aligned(spark, d), "lean", "ret").select("n", r6(F.col("mutual_info")).alias("mutual_info"))


def shuffle_sql(src, reps):
    """DuckDB: observed |ic| and share of shuffles of `src` (asset, ts, rs, rr) that reach it, as `study.permutation_pvalue` has them."""
    m = Y.SHUFFLE_MOD
    key = f"((b * 7919 + r * 104729 + 12345) * 48271) % {m}"
    mate = f"((({key} - x) % n) + n) % n"
    h = f"((greatest(x, {mate}) + (b * 15485863 + r * 32452843) % {m}) % {m})"
    return f""", pi AS (SELECT row_number() OVER (ORDER BY md5(asset || '|' || CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR)), asset || '|' || CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR)) - 1 AS i, count(*) OVER () AS n, rs, rr FROM {src}),
po AS (SELECT abs(corr(rs, rr)) AS ic, count(*) AS n, avg(rs) AS ms, stddev_pop(rs) * stddev_pop(rr) AS dd FROM pi),
pj AS (SELECT b, rs, list_reduce(list_prepend(i, range(1, {Y.SHUFFLE_ROUNDS + 1})), lambda x, r: CASE WHEN (({h} * {h}) % {m}) % 2 = 1 THEN {mate} ELSE x END) AS j FROM pi, (SELECT unnest(range(1, {reps + 1})) AS b)),
pb AS (SELECT b, sum((pj.rs - ms) * pi.rr) AS xy FROM pj JOIN pi ON j = i, po GROUP BY 1),
pv AS (SELECT any_value(ic) AS ic, any_value(n) AS n, (sum(CAST(abs(xy / n / dd) >= ic - 1e-9 AS INT)) + 1) / ({reps} + 1) AS p FROM pb, po)
"""


@query("A33", PAIRS + ranks_sql("") + shuffle_sql("rk", 100) + "SELECT round(ic, 6) AS abs_ic, round(p, 6) AS p_value, n FROM pv")
def permutation_pvalue(spark, d):
    p = aligned(spark, d).withColumn("row_id", F.concat_ws("|", "asset", F.unix_seconds("ts")))
    return Y.permutation_pvalue(p, "lean", "ret", "row_id", 100).select(r6(F.col("ic")).alias("abs_ic"), r6(F.col("p_value")).alias("p_value"), "n")


@query("A34", PAIRS + """, b AS (SELECT *, epoch(ts) / 1e8 AS z FROM pairs), o AS (SELECT regr_slope(lean, z) AS s1, regr_intercept(lean, z) AS i1, regr_slope(ret, z) AS s2, regr_intercept(ret, z) AS i2 FROM b),
e AS (SELECT lean - i1 - s1 * z AS lean, ret - i2 - s2 * z AS ret FROM b, o), rk AS (SELECT *, rank() OVER (ORDER BY lean) AS rs, rank() OVER (ORDER BY ret) AS rr FROM e) SELECT count(*) AS n, round(corr(rs, rr), 4) AS ic FROM rk""")
def partial_ic(spark, d):
    x = aligned(spark, d).withColumn("z", F.unix_seconds("ts") / 1e8)
    return Y.partial_ic(x, "lean", "ret", ["z"]).select("n", r6(F.col("ic"), 4).alias("ic"))


@query("A36", PAIRS + ranks_sql("") + """, k AS (SELECT count(*) AS n, corr(rs, rr) AS ic FROM rk), f AS (SELECT (SELECT count(*) FROM positions) AS positions_total, (SELECT count(*) FROM ln) AS signal_points, (SELECT count(DISTINCT asset) FROM ln) AS assets_in_signal FROM k)
SELECT positions_total, signal_points, assets_in_signal, n AS aligned_pairs, signal_points - n AS dropped, CASE WHEN n = 0 THEN 'NO DATA' WHEN n < 30 THEN 'INCONCLUSIVE' WHEN abs(ic) < 0.03 THEN 'NEGLIGIBLE' ELSE 'PROMISING' END AS verdict FROM k, f""")
def study_verdict(spark, d):
    p = T.positions(spark, d).agg(F.count(F.lit(1)).alias("positions_total"))
    ln = leans(spark, d).agg(F.count(F.lit(1)).alias("signal_points"), F.count_distinct("asset").alias("assets_in_signal"))
    k = Y.rank_ic(aligned(spark, d), "lean", "ret")
    x = p.crossJoin(ln).crossJoin(k)
    return x.select("positions_total", "signal_points", "assets_in_signal", F.col("n").alias("aligned_pairs"), (F.col("signal_points") - F.col("n")).alias("dropped"),
                    Y.verdict(F.col("n"), F.col("ic"), F.lit(0.0)).alias("verdict"))


def study_rows(spark, d):
    f = G.derive_rule_features(I.features(T.candles(spark, d)))
    s = I.Series()
    return f.withColumns({"fwd": F.lead("close").over(s.w) / F.col("close") - 1, "sig": clip(F.col("macd_norm"))}).where("fwd is not null")


@query("A35 W32")
def walk_forward_ablation(spark, d):
    x = R.fold_roles(study_rows(spark, d), 3, 0, ("product",))
    y = M.ablation(x, ["rsi", "pos20", "vol_ratio"], "sig", "fwd", 3)
    return y.select(*[r6(F.col(c), 4).alias(c) for c in y.columns])


@query("X8 X6")
def outcome_model(spark, d):
    x = R.fold_roles(study_rows(spark, d), 1, 24, ("product",))
    m = M.outcome_model(x.where("role = 'train'"), ["rsi", "pos20", "macd_norm", "vol_ratio"], "fwd", 0.5)
    sc = M.model_lean(m.transform(x.where("role = 'test'")))
    return sc.groupBy("product").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("pred") * F.col("fwd") > 0).cast("int")), 4).alias("accuracy"), r6(F.avg(F.abs("lean")), 4).alias("mean_abs_lean"))


FV = with_views("features_long")


PSI = FV + """, rf AS (SELECT * FROM features_long WHERE label < 5), cu AS (SELECT * FROM features_long WHERE label >= 5), lm AS (SELECT dim, min(value) AS lo, max(value) AS hi, count(*) AS n FROM rf GROUP BY 1), cn AS (SELECT dim, count(*) AS n FROM cu GROUP BY 1),
b AS (SELECT dim, least(7, floor((value - lo) / ((hi - lo) / 8))) AS b, label < 5 AS isref FROM features_long JOIN lm USING (dim) WHERE value >= lo), h AS (SELECT dim, b, sum(CAST(isref AS INT)) AS r, sum(1 - CAST(isref AS INT)) AS c FROM b GROUP BY 1, 2),
g AS (SELECT lm.dim, i AS b, lm.n AS nr, cn.n AS nc FROM lm JOIN cn USING (dim), range(8) t(i)), t AS (SELECT g.dim, greatest(1e-4, coalesce(r, 0) / nr) AS a, greatest(1e-4, coalesce(c, 0) / nc) AS q FROM g LEFT JOIN h ON g.dim = h.dim AND g.b = h.b)
"""


@query("A38 F14", PSI + """SELECT dim, round(sum((q - a) * ln(q / a)), 6) AS psi, sum((q - a) * ln(q / a)) > 0.25 AS drifting FROM t GROUP BY 1""")
def psi_drift(spark, d):
    x = T.features_long(spark, d)
    return Y.psi(x.where("label < 5"), x.where("label >= 5"), "dim", "value").select("dim", r6(F.col("psi")).alias("psi"), "drifting")


@query("A38 (worst feature)", PSI + """, p AS (SELECT dim, sum((q - a) * ln(q / a)) AS psi FROM t GROUP BY 1), sz AS (SELECT min(nr) >= 120 AND min(nc) >= 80 AS ready FROM (SELECT lm.n AS nr, cn.n AS nc FROM lm FULL JOIN cn USING (dim))),
b1 AS (SELECT dim, psi FROM p WHERE psi > 0 ORDER BY psi DESC, dim LIMIT 1)
SELECT ready, ready AND coalesce(psi, 0) > 0.25 AS drifting, CASE WHEN ready THEN dim END AS worst_feature, round(CASE WHEN ready THEN coalesce(psi, 0) ELSE 0 END, 6) AS worst_psi FROM sz LEFT JOIN b1 ON true""")
def drift_check(spark, d):
    x = T.features_long(spark, d)
    y = Y.drift_check(x.where("label < 5"), x.where("label >= 5"), "dim", "value")
    return y.select("ready", "drifting", "worst_feature", r6(F.col("worst_psi")).alias("worst_psi"))


@query("A39", FV + """, s AS (SELECT label, abs(value) AS v, row_number() OVER (PARTITION BY label ORDER BY abs(value)) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM features_long), p AS (SELECT *, least(1, 0.9 * (n + 1) / n) * (n - 1) AS p FROM s)
SELECT label, any_value(n) AS n, round(max(CASE WHEN i = floor(p) THEN v END) * (1 - (any_value(p) - floor(any_value(p)))) + max(CASE WHEN i = ceil(p) THEN v END) * (any_value(p) - floor(any_value(p))), 6) AS qhat FROM p GROUP BY 1""")
def conformal_quantile(spark, d):
    x = T.features_long(spark, d).withColumn("v", F.abs("value"))
    return Y.conformal_quantile(x, ["label"], "v", 0.1).select("label", "n", r6(F.col("qhat")).alias("qhat"))


TV = with_views("trades")


@query("A39 (stop multiple)", TV + """, m AS (SELECT product, greatest(0, l_discount * 40) AS v, exit_reason LIKE '%stop%' AS st FROM trades), u AS (SELECT product, v, row_number() OVER (PARTITION BY product ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY product) AS n FROM m WHERE NOT st),
p AS (SELECT *, least(1, 0.9 * (n + 1) / n) * (n - 1) AS p FROM u), q AS (SELECT product, any_value(n) AS n, max(CASE WHEN i = floor(p) THEN v END) * (1 - (any_value(p) - floor(any_value(p)))) + max(CASE WHEN i = ceil(p) THEN v END) * (any_value(p) - floor(any_value(p))) AS q FROM p GROUP BY 1),
r AS (SELECT product, avg(CAST(st AS INT)) AS rate, count(*) AS nt FROM m GROUP BY 1) SELECT product, nt AS n_total, n AS n_scores, round(rate, 6) AS stop_rate, round(CASE WHEN n >= 30 THEN greatest(0.5, least(6, q)) ELSE 2 END, 6) AS stop_mult FROM r LEFT JOIN q USING (product)""")
def stop_calibration(spark, d):
    t = T.trades(spark, d).select("product", (F.col("l_discount") * 40).alias("mae_atr"), F.col("exit_reason").contains("stop").alias("stopped"))
    return Y.stop_calibration(t, ["product"]).select("product", "n_total", "n_scores", r6(F.col("stop_rate")).alias("stop_rate"), r6(F.col("stop_mult")).alias("stop_mult"))


DQ = with_views("decisions")
PL = """(0.5 + sum(CASE WHEN c.f = 1 THEN exp(-power(({a} - c.a) / 0.3, 2)) ELSE 0 END)) / (1 + sum(exp(-power(({a} - c.a) / 0.3, 2))))"""


@query("A40", DQ + f""", pt AS (SELECT product, ts, event_id, greatest(-1, least(1, composite)) AS a, CASE WHEN confidence > 0.4 THEN 1 ELSE -1 END AS f, CASE WHEN action = 'enter' THEN 1 ELSE -1 END AS direction FROM decisions),
c AS (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY product ORDER BY ts DESC, event_id DESC) <= 400),
cp AS (SELECT x.product, x.event_id, x.f, {PL.format(a='x.a')} AS p FROM c x JOIN c ON c.product = x.product GROUP BY ALL), sc AS (SELECT product, CASE WHEN f = 1 THEN 1 - p ELSE p END AS s FROM cp),
sr AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY product) AS n FROM sc), sp AS (SELECT *, least(1, 0.9 * (n + 1) / n) * (n - 1) AS p FROM sr),
q AS (SELECT product, max(CASE WHEN i = floor(p) THEN s END) * (1 - (any_value(p) - floor(any_value(p)))) + max(CASE WHEN i = ceil(p) THEN s END) * (any_value(p) - floor(any_value(p))) AS qh FROM sp GROUP BY 1),
z AS (SELECT x.product, x.event_id, x.direction, {PL.format(a='x.a')} AS p FROM pt x JOIN c ON c.product = x.product GROUP BY ALL),
y AS (SELECT z.*, p >= 1 - qh AS l, 1 - p >= 1 - qh AS s FROM z JOIN q USING (product)), w AS (SELECT *, l OR (NOT l AND NOT s) AS il, s OR (NOT l AND NOT s) AS isx FROM y)
SELECT event_id, round(p, 6) AS p_long, il AS in_long, isx AS in_short, CASE WHEN direction > 0 THEN NOT il AND isx ELSE il AND NOT isx END AS veto FROM w""")
def direction_conformal(spark, d):
    p = T.decisions(spark, d).withColumns({"align": F.col("composite"), "favored": F.when(F.col("confidence") > 0.4, 1).otherwise(-1),
                                           "direction": F.when(F.col("action") == "enter", 1).otherwise(-1)})
    x = Y.direction_conformal(p, p, "product", order=("ts", "event_id"))
    return x.select("event_id", r6(F.col("p_long")).alias("p_long"), "in_long", "in_short", "veto")


BAND = ", bd AS (SELECT event_id, product, composite - 0.3 AS lo, composite + 0.3 AS hi, confidence AS y FROM decisions)"


def band(spark, d):
    return T.decisions(spark, d).select("event_id", "product", (F.col("composite") - 0.3).alias("lo"), (F.col("composite") + 0.3).alias("hi"), F.col("confidence").alias("y"))


@query("A41", DQ + BAND + """, s AS (SELECT *, greatest(lo - y, y - hi) AS sc, row_number() OVER (PARTITION BY product ORDER BY event_id) AS rn FROM bd), q AS (SELECT *, CASE WHEN rn > 50 THEN quantile_cont(sc, 0.816) OVER (PARTITION BY product ORDER BY event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) END AS qh FROM s)
SELECT event_id, round(qh, 6) AS qhat FROM q""")
def cqr_fixed(spark, d):
    return Y.cqr_fixed(band(spark, d), ["product"], "event_id", 50, 0.2).select("event_id", r6(F.col("qhat")).alias("qhat"))


@query("A41 X5 (adaptive)")
def cqr_adaptive(spark, d):
    x = Y.cqr_adaptive(band(spark, d), ["product"], ["event_id"], 200)
    return x.groupBy("product").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("covered")).alias("coverage"), r6(F.max_by("alpha_t", "event_id")).alias("alpha_t"))


@query("W36 X5", DQ.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT product, row_number() OVER (PARTITION BY product ORDER BY ts, event_id) AS i, abs(composite - confidence) AS e FROM decisions),
f(product, i, mean, cum, low, stat, hit) AS (SELECT product, i, e, CAST(-0.005 AS DOUBLE), CAST(-0.005 AS DOUBLE), CAST(0 AS DOUBLE), 0 FROM o WHERE i = 1 UNION ALL
  SELECT product, i, m, CASE WHEN c - lo > 5 THEN 0 ELSE c END, CASE WHEN c - lo > 5 THEN 0 ELSE lo END, c - lo, CASE WHEN c - lo > 5 THEN 1 ELSE 0 END FROM (
    SELECT product, i, m, c, least(low, c) AS lo FROM (SELECT product, i, low, m, 0.999 * cum + e - m - 0.005 AS c FROM (
      SELECT o.product, o.i, o.e, f.cum, f.low, 0.999 * f.mean + 0.001 * o.e AS m FROM f JOIN o ON o.product = f.product AND o.i = f.i + 1))))
SELECT product, count(*) AS n, sum(hit) AS n_events, round(max(stat), 6) AS max_stat FROM f GROUP BY 1""")
def page_hinkley(spark, d):
    x = T.decisions(spark, d).withColumn("err", F.abs(F.col("composite") - F.col("confidence")))
    y = Y.page_hinkley(x, ["product"], ["ts", "event_id"], "err", lam=5.0)
    return y.groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.sum("drift").cast("bigint").alias("n_events"), r6(F.max("ph_stat")).alias("max_stat"))


@query("W39", DQ + """, x AS (SELECT * FROM decisions WHERE abs(composite) >= 0.05), y AS (SELECT event_id, ts, avg(CAST(composite * (confidence - 0.5) > 0 AS INT)) OVER f AS acc, avg(power(composite - (confidence - 0.5), 2)) OVER f AS loss FROM x WINDOW f AS (ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) SELECT event_id, round(acc, 6) AS accuracy, round(loss, 6) AS loss FROM y""")
def rolling_accuracy(spark, d):
    x = T.decisions(spark, d).select("event_id", "ts", F.col("composite").alias("pred"), (F.col("confidence") - 0.5).alias("actual"))
    return Y.rolling_accuracy(x, ["ts", "event_id"]).select("event_id", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("loss")).alias("loss"))


# ---- forecasts ----

MK = f"""WITH e AS (SELECT *, {K} AS k FROM events), m AS (SELECT event_id, user_id, k, least(0.99, greatest(0.01, (k + 1) / 101)) AS p0, (value - 50) / 400 AS mom_1h, (k - 50) / 300 AS mom_1d, least(0.99, greatest(0.01, (k + 1) / 101)) + (user_id % 9 - 4) / 100 AS lt,
  (event_id % 5 - 2) / 2.0 AS research, (user_id % 7 - 3) / 3.0 AS llm FROM e),
l AS (SELECT *, greatest(-1, least(1, (0.5 * mom_1h + 0.5 * mom_1d) * 6)) AS momentum, CASE WHEN abs(mom_1h) > 0.05 THEN greatest(-1, least(1, -mom_1h * 8)) ELSE 0 END AS mean_revert,
  CASE WHEN abs(p0 - 0.5) > 0.15 THEN sign(p0 - 0.5) * least(abs(p0 - 0.5) * 2, 1) ELSE 0 END AS longshot_fade, greatest(-1, least(1, (lt - p0) * 10)) AS microstructure FROM m),
n AS (SELECT *, greatest(-1, least(1, (momentum + mean_revert + longshot_fade + microstructure + 2.3 * llm + CASE WHEN abs(research) > 1e-6 THEN 1.5 * research ELSE 0 END) / (6.3 + CASE WHEN abs(research) > 1e-6 THEN 1.5 ELSE 0 END))) AS net FROM l),
a AS (SELECT *, {' + '.join(f'CAST(abs({c}) > 1e-6 AS INT)' for c in FC.ARMS)} AS act, {' + '.join(f'CAST(abs({c}) > 1e-6 AND ({c} > 0) = (net > 0) AS INT)' for c in FC.ARMS)} AS same, greatest(0.001, least(0.999, p0 + net * 0.06)) AS fair0 FROM n),
mv AS (SELECT *, CASE WHEN act > 0 AND abs(net) > 1e-6 THEN same / act ELSE 0 END AS agreement, abs(net) * CASE WHEN act > 0 AND abs(net) > 1e-6 THEN same / act ELSE 0 END AS confidence, CASE WHEN net >= 0 THEN p0 ELSE 1 - p0 END AS price,
  CASE WHEN net >= 0 THEN fair0 ELSE greatest(0.001, least(0.999, 1 - fair0)) END AS fair, CASE WHEN abs(net) > 1e-6 THEN CASE WHEN net >= 0 THEN 0 ELSE 1 END END AS oi FROM a)
"""


def market_votes(spark, d):
    e = T.load(spark, d, "events").withColumn("k", T.k_of())
    p0 = F.least(F.lit(0.99), F.greatest(F.lit(0.01), (F.col("k") + 1) / 101))
    m = e.select("event_id", "user_id", p0.alias("p0"), (1 - p0).alias("p1"), ((F.col("value") - 50) / 400).alias("mom_1h"), ((F.col("k") - 50) / 300).alias("mom_1d"),
                 (p0 + (F.col("user_id") % 9 - 4) / 100).alias("last_trade"), ((F.col("event_id") % 5 - 2) / 2.0).alias("research_lean"), ((F.col("user_id") % 7 - 3) / 3.0).alias("llm_lean"))
    return FC.market_vote(FC.market_leans(m), boost={"llm": 2.3, "research": 1.5})


@query("A47", MK + "SELECT event_id, oi AS outcome_index, round(net, 6) AS net_lean, round(agreement, 6) AS agreement, round(confidence, 6) AS confidence, round(fair, 6) AS fair, round(fair - price, 6) AS edge FROM mv")
def market_vote(spark, d):
    x = market_votes(spark, d)
    return x.select("event_id", "outcome_index", *[r6(F.col(c)).alias(c) for c in ("net_lean", "agreement", "confidence", "fair", "edge")])


KELLY = MK + """, z AS (SELECT *, fair - price AS edge, 10000 * 0.25 * ((greatest(0.001, least(0.999, fair)) - greatest(0.001, least(0.999, price))) / (1 - greatest(0.001, least(0.999, price)))) * (0.5 + confidence / 2) AS st FROM mv),
kz AS (SELECT *, least(st, 500, 8000) AS stake, CASE WHEN edge <= 0 THEN 'no edge' WHEN edge < 0.01 THEN 'edge below min' WHEN confidence < 0.1 THEN 'confidence below gate' WHEN edge < (0.001 + 0.01) * 1.5 THEN 'edge below cost'
  WHEN least(st, 500, 8000) < 5 THEN 'stake below min' ELSE 'ok' END AS reason FROM z)
"""


def kelly(spark, d):
    x = market_votes(spark, d).withColumns({"spread": F.lit(0.001), "min_order_size": F.lit(5.0)})
    return G.kelly_size(x, 10000.0, 8000.0, {"min_edge": 0.01, "confidence_gate": 0.1})


@query("P12 P25 F14", KELLY + "SELECT event_id, reason, round(CASE WHEN reason = 'ok' THEN stake ELSE 0 END, 2) AS stake, round(greatest(0.001, price - 0.2), 6) AS stop, round(least(0.999, price + 0.15), 6) AS take FROM kz")
def kelly_size(spark, d):
    x = kelly(spark, d)
    lo, hi = G.exit_levels(F.col("price"))
    return x.select("event_id", "reason", r6(F.col("stake"), 2).alias("stake"), r6(lo).alias("stop"), r6(hi).alias("take"))


@query("K9", KELLY + "SELECT event_id, round(edge * confidence, 6) AS score FROM kz WHERE reason = 'ok' ORDER BY round(edge * confidence, 9) DESC, event_id LIMIT 8")
def ranked_markets(spark, d):
    x = kelly(spark, d).where("reason = 'ok'").withColumn("s", F.round(F.col("edge") * F.col("confidence"), 9))
    return x.orderBy(F.desc("s"), "event_id").limit(8).select("event_id", r6(F.col("edge") * F.col("confidence")).alias("score"))


FQ = with_views("votes")
LL = "-(y * ln(greatest(1e-6, least(1 - 1e-6, {p}))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, {p}))))"


@query("A37 F14", FQ + f""", r AS (SELECT *, resolved_outcome0 AS y FROM forecasts), g AS (SELECT count(*) AS forecast_count, count(y) AS scored, avg(power(predicted_p0 - y, 2)) AS bb, avg(power(market_p0 - y, 2)) AS mb, avg({LL.format(p='predicted_p0')}) AS bl, avg({LL.format(p='market_p0')}) AS ml FROM r)
SELECT forecast_count, scored, round(bb, 6) AS bot_brier, round(mb, 6) AS market_brier, round(bl, 6) AS bot_log_loss, round(ml, 6) AS market_log_loss, round(bb - mb, 6) AS brier_delta, round(bl - ml, 6) AS log_loss_delta FROM g""")
def forecast_metrics(spark, d):
    x = FC.forecast_metrics(T.forecasts(spark, d))
    return x.select("forecast_count", "scored", *[r6(F.col(c)).alias(c) for c in x.columns[2:]])


@query("A37", FQ + f""", x AS (SELECT strategy, resolved_outcome0 AS y, market_p0, greatest(0, least(1, market_p0 + lean * 0.06)) AS p FROM forecasts JOIN votes USING (id) WHERE resolved_outcome0 IS NOT NULL AND abs(lean) >= 1e-6)
SELECT strategy, count(*) AS n, round(avg(power(p - y, 2)), 6) AS brier, round(avg({LL.format(p='p')}), 6) AS log_loss, round(avg(power(p - y, 2)) - avg(power(market_p0 - y, 2)), 6) AS brier_delta_vs_market FROM x GROUP BY 1""")
def strategy_forecasts(spark, d):
    x = FC.strategy_forecasts(T.forecasts(spark, d))
    return x.select("strategy", "n", *[r6(F.col(c)).alias(c) for c in ("brier", "log_loss", "brier_delta_vs_market")])


@query("P26", FQ + """SELECT CASE WHEN ttl_hours <= 1 THEN '0-1h' WHEN ttl_hours <= 24 THEN '1-24h' WHEN ttl_hours <= 168 THEN '1-7d' WHEN ttl_hours <= 720 THEN '1-4w' ELSE '>1mo' END AS bucket,
  CASE WHEN ttl_hours <= 24 THEN '<1d' WHEN ttl_hours <= 168 THEN '1-7d' WHEN ttl_hours <= 720 THEN '1-4w' ELSE '>1mo' END AS regime, count(*) AS n FROM forecasts GROUP BY 1, 2""")
def ttl_buckets(spark, d):
    h = F.col("ttl_hours")
    return T.forecasts(spark, d).groupBy(FC.ttl_bucket(h).alias("bucket"), FC.ttl_regime(h).alias("regime")).agg(F.count(F.lit(1)).alias("n"))


@query("P6 P7", FQ + """, nw AS (SELECT max(epoch(forecast_ts)) AS now FROM forecasts), x AS (SELECT id, resolved_outcome0, forecast_ts, id % 6 AS attempts, CASE WHEN k % 3 <> 0 THEN epoch(forecast_ts) + ttl_hours * 3600 END AS due, epoch(forecast_ts) + 60 * k AS next_poll FROM forecasts),
p AS (SELECT * FROM x, nw WHERE resolved_outcome0 IS NULL AND next_poll <= now AND (due IS NULL OR due <= now + 21600))
SELECT id, round(due, 4) AS due, CASE WHEN attempts >= 4 THEN 3600 WHEN attempts = 3 THEN 960 WHEN attempts = 2 THEN 480 WHEN attempts = 1 THEN 240 ELSE 120 END AS retry_sec FROM p""")
def pending_forecasts(spark, d):
    f = T.forecasts(spark, d)
    now = f.agg(F.max(S.seconds("forecast_ts")).alias("now"))
    x = f.withColumns({"attempts": F.col("id") % 6, "due": F.when(F.col("k") % 3 != 0, S.seconds("forecast_ts") + F.col("ttl_hours") * 3600),
                       "next_poll": S.seconds("forecast_ts") + 60 * F.col("k")}).crossJoin(F.broadcast(now))
    return FC.pending(x, F.col("now")).select("id", r6(F.col("due"), 4).alias("due"), FC.retry_delay(F.col("attempts")).alias("retry_sec"))


@query("J22", FQ + """, h AS (SELECT id, condition_id, id % 2 AS oi, 10 + k AS shares, (10 + k) * market_p0 AS cost FROM forecasts), r AS (SELECT condition_id, max(value) > 95 AS closed, CASE WHEN avg(value) > 50 THEN 0.995 ELSE 0.005 END AS r0 FROM forecasts GROUP BY 1),
s AS (SELECT h.*, CASE WHEN CASE WHEN r0 >= 1 - r0 THEN 0 ELSE 1 END = oi THEN shares ELSE 0 END AS payoff FROM h JOIN r USING (condition_id) WHERE closed)
SELECT id, round(payoff, 6) AS payoff, round(payoff - cost, 6) AS pnl, round((payoff - cost) / cost, 6) AS return_pct FROM s""")
def settle_binary(spark, d):
    f = T.forecasts(spark, d)
    h = f.select("id", "condition_id", (F.col("id") % 2).alias("outcome_index"), (10 + F.col("k")).alias("shares"), ((10 + F.col("k")) * F.col("market_p0")).alias("cost"))
    r = f.groupBy("condition_id").agg((F.max("value") > 95).alias("closed"), F.when(F.avg("value") > 50, 0.995).otherwise(0.005).alias("r0")).withColumn("r1", 1 - F.col("r0"))
    return FC.settle(h, r).select("id", *[r6(F.col(c)).alias(c) for c in ("payoff", "pnl", "return_pct")])
