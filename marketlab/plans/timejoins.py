"""As-of, nearest, interval, first-touch and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlab.functions.mathx import r6
from marketlab.operators import indicators as I
from marketlab.operators import joins as J
from marketlab.operators import labels as L
from marketlab.operators import scans as S
from marketlab.plans.price import CANDLES, EPOCH, FEAT, PW, fr
from marketlab.plans.registry import query
from marketlab.plans.views import with_views
from marketlab.sources import tables as T

JV = with_views("signal_scores", "decisions", "ticks", "candles")


@query("J1", JV + """SELECT s.event_id, d.event_id AS decision_id, round(d.composite, 6) AS composite, d.action,
  round((epoch_us(s.ts) - epoch_us(d.ts)) / 1e6, 6) AS ctx_lag_sec
FROM signal_scores s ASOF LEFT JOIN decisions d ON s.product = d.product AND s.ts >= d.ts""")
def asof_decision(spark, d):
    x = J.asof(T.signal_scores(spark, d), T.decisions(spark, d).withColumnRenamed("event_id", "decision_id"),
               payload=["decision_id", "composite", "action"], tie=["decision_id"])
    return x.select("event_id", "match.decision_id", r6(F.col("match.composite")).alias("composite"), "match.action",
                    r6(S.seconds("ts") - S.seconds("match.ts")).alias("ctx_lag_sec"))


@query("J2", JV + """, b AS (SELECT s.event_id, s.ts, d.event_id AS did, d.ts AS dts FROM signal_scores s ASOF LEFT JOIN decisions d
  ON s.product = d.product AND s.ts >= d.ts),
f AS (SELECT s.event_id, d.event_id AS did, d.ts AS dts FROM signal_scores s ASOF LEFT JOIN decisions d ON s.product = d.product AND s.ts < d.ts),
x AS (SELECT b.event_id, b.did AS bd, f.did AS fd, epoch_us(b.ts) - epoch_us(b.dts) AS db, epoch_us(f.dts) - epoch_us(b.ts) AS df FROM b JOIN f USING (event_id))
SELECT event_id, CASE WHEN least(db, df) < 1801000000 THEN CASE WHEN df IS NULL OR db <= df THEN bd ELSE fd END END AS decision_id FROM x""")
def nearest_decision(spark, d):
    x = J.nearest(T.signal_scores(spark, d), T.decisions(spark, d).withColumnRenamed("event_id", "decision_id"), 1801,
                  payload=["decision_id"], tie=["decision_id"])
    return x.select("event_id", "match.decision_id")


@query("J3", JV + """SELECT s.event_id, round(a.close, 6) AS p0, round(b.close, 6) AS p1, round(b.close / a.close - 1, 6) AS ret
FROM signal_scores s ASOF LEFT JOIN candles a ON s.product = a.product AND s.ts >= a.ts
ASOF LEFT JOIN candles b ON s.product = b.product AND s.ts + INTERVAL 4 HOUR <= b.ts""")
def horizon_return(spark, d):
    x = J.horizon_return(T.signal_scores(spark, d), T.candles(spark, d), 4 * 3600)
    return x.select("event_id", *[r6(F.col(c)).alias(c) for c in ("p0", "p1", "ret")])


@query("J4", JV + FEAT[len(CANDLES):] + """SELECT s.event_id, round(coalesce(f.rsi, 0), 6) AS rsi, round(coalesce(f.mom_4h, 0), 6) AS mom_4h
FROM signal_scores s ASOF LEFT JOIN features f ON s.product = f.product AND s.ts >= f.ts""")
def baseline_asof(spark, d):
    x = J.asof(T.signal_scores(spark, d), I.features(T.candles(spark, d)), payload=["rsi", "mom_4h"])
    return x.select("event_id", *[r6(F.coalesce(F.col(f"match.{c}"), F.lit(0.0))).alias(c) for c in ("rsi", "mom_4h")])


MACRO = "SELECT ts, value > 97 AS is_fomc FROM events WHERE event_type = 'error' AND value > 90"


@query("J5 S9", f"""WITH m AS ({MACRO}), w AS (SELECT ts, ts - CASE WHEN is_fomc THEN INTERVAL 45 MINUTE ELSE INTERVAL 30 MINUTE END AS lo,
  ts + CASE WHEN is_fomc THEN INTERVAL 90 MINUTE ELSE INTERVAL 45 MINUTE END AS hi FROM m)
SELECT e.event_id, EXISTS (SELECT 1 FROM w WHERE e.ts BETWEEN lo AND hi) AS blackout,
  CAST((SELECT min(epoch_us(w.ts)) FROM w WHERE w.ts > e.ts) AS BIGINT) AS next_event FROM events e""")
def macro_blackout(spark, d):
    e = T.load(spark, d, "events")
    m = e.where("event_type = 'error' AND value > 90").select("ts", (F.col("value") > 97).alias("is_fomc"))
    x = J.in_windows(e.select("event_id", "ts"), m, F.when(F.col("is_fomc"), 45 * 60).otherwise(30 * 60),
                     F.when(F.col("is_fomc"), 90 * 60).otherwise(45 * 60))
    return x.select("event_id", "blackout", S.micros("next_event").alias("next_event"))


ENTRY = """, ent AS (SELECT product, ts, close AS price, CASE WHEN rsi > 50 THEN 1 ELSE -1 END AS side, atr FROM features),
en AS (SELECT *, price - side * 1.0 * atr AS stop, price + side * 1.5 * atr AS take FROM ent)
"""


@query("J12", FEAT + ENTRY + f""", tch AS (SELECT e.product, e.ts, min(b.ts) AS exit_ts, first(CASE WHEN CASE WHEN side > 0 THEN low <= stop ELSE high >= stop END
   THEN 'stop' ELSE 'take' END ORDER BY b.ts) AS exit_kind FROM en e JOIN candles b ON e.product = b.product AND b.ts > e.ts
   AND b.ts <= e.ts + INTERVAL 12 HOUR AND CASE WHEN side > 0 THEN low <= stop OR high >= take ELSE high >= stop OR low <= take END GROUP BY ALL),
r AS (SELECT en.*, coalesce(exit_kind, 'open') AS exit_kind, exit_ts FROM en LEFT JOIN tch USING (product, ts)),
z AS (SELECT r.*, c.close AS lc, c.ts AS lts FROM r ASOF LEFT JOIN candles c ON r.product = c.product AND r.ts + INTERVAL 12 HOUR >= c.ts)
SELECT product, {EPOCH}, exit_kind, CAST(epoch(coalesce(exit_ts, lts)) AS BIGINT) AS exit_ts,
  round(side * (CASE exit_kind WHEN 'stop' THEN stop * (1 - side * 0.001) WHEN 'take' THEN take * (1 - side * 0.001) ELSE lc END / price - 1), 6) AS ret FROM z""")
def first_touch_exits(spark, d):
    c = T.candles(spark, d)
    e = I.features(c).select("product", "ts", F.col("close").alias("price"), F.when(F.col("rsi") > 50, 1).otherwise(-1).alias("side"), "atr")
    e = e.withColumns({"stop": F.col("price") - F.col("side") * F.col("atr"), "take": F.col("price") + F.col("side") * 1.5 * F.col("atr"),
                       "entry_id": F.concat_ws("|", "product", F.unix_seconds("ts"))})
    x = J.first_touch(e, c, 12 * 3600, slip=0.001)
    return x.select("product", F.unix_seconds("ts").alias("ts"), "exit_kind", F.unix_seconds("exit_ts").alias("exit_ts"), r6(F.col("ret")).alias("ret"))


OBJ = """WITH c AS (SELECT l_suppkey AS sid, round(sum(l_extendedprice * (l_discount - l_tax)), 2) AS profit,
  -round(max(l_discount), 2) AS safety, round(avg(l_quantity), 4) AS size FROM lineitem GROUP BY 1)
"""


def objectives(spark, d):
    li = T.load(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("sid")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))), 2).alias("profit"),
        (-F.round(F.max("l_discount"), 2)).alias("safety"), F.round(F.avg("l_quantity"), 4).alias("size"))


DOM = "b.profit >= a.profit AND b.safety >= a.safety AND b.size >= a.size AND (b.profit > a.profit OR b.safety > a.safety OR b.size > a.size)"


@query("J13", OBJ + f"""SELECT sid, round(profit, 2) AS profit, round(safety, 2) AS safety, round(size, 4) AS size FROM c a
WHERE NOT EXISTS (SELECT 1 FROM c b WHERE {DOM})""")
def pareto_front(spark, d):
    return J.skyline(objectives(spark, d), "sid", ["profit", "safety", "size"])


TRADES = with_views("trades")
TBARS = """, tbars AS (SELECT product, opened AS ts, min(entry) AS low, max(entry) AS high, median(entry) AS close FROM trades GROUP BY 1, 2)
"""


def trade_bars(t):
    return t.groupBy("product", F.col("opened").alias("ts")).agg(
        F.min("entry").alias("low"), F.max("entry").alias("high"))


@query("J19", TRADES + TBARS + """, sp AS (SELECT product, opened, closed, count(*) AS n FROM trades GROUP BY ALL)
SELECT product, CAST(epoch(opened) AS BIGINT) AS opened, CAST(epoch(closed) AS BIGINT) AS closed, any_value(n) AS n, round(min(low), 8) AS lowest, round(max(high), 8) AS highest
FROM sp LEFT JOIN tbars USING (product) WHERE tbars.ts BETWEEN opened AND closed GROUP BY product, opened, closed""")
def mae_join(spark, d):
    t = T.trades(spark, d)
    x = J.range_extremes(t.groupBy("product", "opened", "closed").agg(F.count(F.lit(1)).alias("n")), trade_bars(t), S.DAY, per_slice=8)
    return x.select("product", F.unix_seconds("opened").alias("opened"), F.unix_seconds("closed").alias("closed"), "n",
                    r6(F.col("lowest"), 8).alias("lowest"), r6(F.col("highest"), 8).alias("highest"))


@query("J20", CANDLES + f"""SELECT product, {EPOCH}, round(close, 6) AS close, CASE WHEN ts = max(ts) OVER (PARTITION BY product) THEN round(n_docs * 1.0, 6) END AS context
FROM candles JOIN (SELECT event_type AS product, count(*) AS n_docs FROM events GROUP BY 1) USING (product)""")
def feature_context_join(spark, d):
    ctx = T.ticks(spark, d).groupBy("product").agg(F.count(F.lit(1)).cast("double").alias("context"))
    x = J.newest_only(T.candles(spark, d).join(ctx, "product", "left"), ["context"])
    return x.select("product", F.unix_seconds("ts").alias("ts"), r6(F.col("close")).alias("close"), r6(F.col("context")).alias("context"))


PAIRS = CANDLES + """, pr AS (SELECT a.ts, a.product AS a, b.product AS b, a.close AS ca, b.close AS cb FROM candles a JOIN candles b ON a.ts = b.ts AND a.product < b.product),
p1 AS (SELECT *, ln(ca / cb) AS lr, ca / lag(ca) OVER w - 1 AS ra, cb / lag(cb) OVER w - 1 AS rb, row_number() OVER w AS rn FROM pr
  WINDOW w AS (PARTITION BY a, b ORDER BY ts)),
p2 AS (SELECT *, avg(lr) OVER f AS mu, stddev_pop(lr) OVER f AS sd, corr(ra, rb) OVER f AS rho FROM p1
  WINDOW f AS (PARTITION BY a, b ORDER BY ts ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)),
pz AS (SELECT *, CASE WHEN rn >= 40 AND sd >= 1e-9 THEN (lr - mu) / sd END AS z, CASE WHEN rn >= 40 THEN rho END AS corr FROM p2)
"""


def spread(bars, n=96, least=40):
    """Z-score of the log price ratio over n bars (population sd) and rolling correlation of returns."""
    w = I.W.partitionBy("a", "b").orderBy("ts")
    f = w.rowsBetween(-(n - 1), 0)
    x = J.pair_bars(bars).withColumns({"lr": F.ln(F.col("ca") / F.col("cb")), "rn": F.row_number().over(w),
                                       "ra": F.col("ca") / F.lag("ca").over(w) - 1, "rb": F.col("cb") / F.lag("cb").over(w) - 1})
    sd = F.stddev_pop("lr").over(f)
    return x.withColumns({"sd": sd, "z": F.when((F.col("rn") >= least) & (sd >= 1e-9), (F.col("lr") - F.avg("lr").over(f)) / sd),
                          "corr": F.when(F.col("rn") >= least, F.corr("ra", "rb").over(f))})


@query("J6 W29", PAIRS + f"SELECT a, b, {EPOCH}, round(z, 6) AS z, round(corr, 6) AS corr FROM pz")
def pair_spread(spark, d):
    return spread(T.candles(spark, d)).select("a", "b", F.unix_seconds("ts").alias("ts"), r6(F.col("z")).alias("z"), r6(F.col("corr")).alias("corr"))


@query("A52 J6", PAIRS + f""", lst AS (SELECT * FROM pz QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY ts DESC) = 1)
SELECT a, b, round(z, 6) AS z, round(corr, 6) AS corr, (abs(z) - 0.1) > 0 AND (abs(z) - 0.1) * sd > 1.5 * 4 * 0.0001 AS cost_ok
FROM lst WHERE corr >= -0.5 AND abs(z) >= 0.2""")
def pairs_table(spark, d):
    x = spread(T.candles(spark, d))
    last = x.groupBy("a", "b").agg(F.max_by(F.struct("z", "corr", "sd"), "ts").alias("l")).select("a", "b", "l.*")
    gap = F.abs("z") - 0.1
    return (last.where((F.col("corr") >= -0.5) & (F.abs("z") >= 0.2))
            .select("a", "b", r6(F.col("z")).alias("z"), r6(F.col("corr")).alias("corr"),
                    ((gap > 0) & (gap * F.col("sd") > 1.5 * 4 * 0.0001)).alias("cost_ok")))


def near_sql(src, shift, out):
    """DuckDB: nearest tick price within 600 s of ts + shift, the earlier one on ties."""
    at = f"(s.ts + INTERVAL {shift} SECOND)"
    return f""", {out}b AS (SELECT s.event_id, t.price, epoch_us({at}) - epoch_us(t.ts) AS dd FROM {src} s ASOF LEFT JOIN ticks t ON s.product = t.product AND {at} >= t.ts),
{out}f AS (SELECT s.event_id, t.price, epoch_us(t.ts) - epoch_us({at}) AS dd FROM {src} s ASOF LEFT JOIN ticks t ON s.product = t.product AND {at} < t.ts),
{out} AS (SELECT b.event_id, CASE WHEN least(b.dd, f.dd) < 600000000 THEN CASE WHEN f.dd IS NULL OR b.dd <= f.dd THEN b.price ELSE f.price END END AS px
  FROM {out}b b JOIN {out}f f USING (event_id))"""


LABELS = JV + near_sql("signal_scores", 0, "q0") + near_sql("signal_scores", 1800, "q1") + """, nw AS (SELECT max(ts) AS now FROM events),
lt AS (SELECT product, last(price ORDER BY ts, event_id) AS newest FROM ticks GROUP BY 1),
l0 AS (SELECT s.*, q0.px AS p0, coalesce(q1.px, newest) AS p1, epoch(now) - epoch(s.ts) AS age FROM signal_scores s JOIN q0 USING (event_id)
  JOIN q1 USING (event_id) JOIN lt USING (product) CROSS JOIN nw),
lab AS (SELECT *, p1 / p0 - 1 AS raw, (p1 / p0 - 1) * direction AS aligned, CASE WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN 'scored'
  WHEN age > 10800 THEN 'abandon' ELSE 'retry' END AS state FROM l0 WHERE age >= 1800)
"""


def labels(spark, d):
    now = T.load(spark, d, "events").agg(F.max("ts").alias("now"))
    return L.mature(T.signal_scores(spark, d), T.ticks(spark, d), now)


@query("J15 P5", LABELS + "SELECT event_id, state, round(raw, 6) AS fwd_return_raw, round(aligned, 6) AS fwd_return_aligned FROM lab")
def label_maturation(spark, d):
    return labels(spark, d).select("event_id", "state", r6(F.col("fwd_return_raw")).alias("fwd_return_raw"),
                                   r6(F.col("fwd_return_aligned")).alias("fwd_return_aligned"))


VOTES_D = """, dv AS (SELECT *, CASE WHEN composite >= 0 THEN 1 ELSE -1 END AS direction FROM decisions WHERE action = 'skip'),
v AS (SELECT event_id, 'trend' AS strategy, composite AS vote FROM dv UNION ALL SELECT event_id, 'meanrev', confidence - 0.5 FROM dv UNION ALL SELECT event_id, 'breakout', 0.25 FROM dv)
"""


def with_votes(x):
    return x.withColumn("votes", F.create_map(F.lit("trend"), F.col("composite"), F.lit("meanrev"), F.col("confidence") - 0.5,
                                              F.lit("breakout"), F.lit(0.25)))


@query("J16", JV + VOTES_D + near_sql("dv", 0, "q0") + near_sql("dv", 1800, "q1") + """, sk AS (SELECT dv.event_id, (q1.px / q0.px - 1) * direction - 0.012 AS net FROM dv JOIN q0 USING (event_id) JOIN q1 USING (event_id)),
cr AS (SELECT strategy, CASE WHEN vote > 0 THEN net ELSE -net END AS al, abs(vote) / sum(abs(vote)) OVER (PARTITION BY event_id) AS share FROM v JOIN sk USING (event_id) WHERE net IS NOT NULL)
SELECT strategy, count(*) AS n, round(sum(al * share * 0.5 * CASE WHEN al < 0 THEN 5 ELSE 1 END), 6) AS credit FROM cr GROUP BY 1""")
def skip_counterfactual(spark, d):
    sk = with_votes(T.decisions(spark, d).where("action = 'skip'")).withColumn("direction", F.when(F.col("composite") >= 0, 1).otherwise(-1))
    x = L.skip_counterfactual(sk, T.ticks(spark, d))
    return x.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("credit")).alias("credit"))


@query("J17", JV + """, ex AS (SELECT event_id, event_type AS product, ts, 100 + value AS price, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS side FROM events)
""" + near_sql("ex", 1800, "q1") + """SELECT ex.event_id, round(side * (px / price - 1), 6) AS hold_return, round(-side * (px / price - 1), 6) AS exit_edge FROM ex JOIN q1 USING (event_id)""")
def exit_counterfactual(spark, d):
    t = T.ticks(spark, d)
    ex = t.withColumn("side", F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)).drop("size")
    x = L.exit_counterfactual(ex, t)
    return x.select("event_id", r6(F.col("hold_return")).alias("hold_return"), r6(F.col("exit_edge")).alias("exit_edge"))
