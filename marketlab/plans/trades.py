"""Trade-ledger queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlab.functions.mathx import finite, r6, wilson
from marketlab.operators import indicators as I
from marketlab.operators import joins as J
from marketlab.operators import ledger as G
from marketlab.operators import scans as S
from marketlab.plans.price import EPOCH, FEAT, PW, fr
from marketlab.plans.registry import query
from marketlab.plans.views import with_views
from marketlab.sources import tables as T

TR = with_views("trades")
ORD = T.TRADE_ORDER
OS = ", ".join(ORD)
RET = "CASE WHEN abs(qty * entry) > 0 THEN pnl / abs(qty * entry) END"
PATH = TR + f""", e0 AS (SELECT *, {RET} AS r, 10000000 + sum(pnl) OVER (ORDER BY {OS} ROWS UNBOUNDED PRECEDING) AS equity,
  row_number() OVER (ORDER BY {OS}) AS rn FROM trades),
e1 AS (SELECT *, greatest(10000000, max(equity) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS peak FROM e0),
e2 AS (SELECT *, 1 - equity / peak AS dd, equity >= peak - 1e-10 * abs(peak) AS atp FROM e1)
"""


def run_sql(src, cond, name):
    """Longest run of rows of `src` (ordered by rn) satisfying `cond`."""
    return f""", {name}g AS (SELECT rn, {cond} AS f, sum(CASE WHEN {cond} THEN 0 ELSE 1 END) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS g FROM {src}),
{name} AS (SELECT coalesce(max(n), 0) AS {name} FROM (SELECT g, count(*) AS n FROM {name}g WHERE f GROUP BY g))"""


def cols(df, floats, keep=(), digits=6):
    return df.select(*keep, *[r6(F.col(c), digits).alias(c) for c in floats])


SHEET = ["net_pnl", "win_rate", "ci_lo", "ci_hi", "avg_win", "avg_loss", "win_loss_ratio", "expectancy", "profit_factor", "sharpe_per_trade",
         "sortino_per_trade", "ann_sharpe", "max_drawdown", "calmar", "annualized_return", "best_trade_pnl", "worst_trade_pnl",
         "gross_entry_fees", "span_days"]


@query("A2 A9 A13 A14 W16 W17", PATH + run_sql("e2", "NOT atp", "uw") + """, g AS (SELECT count(*) AS n, sum(pnl) AS net_pnl,
  sum(CAST(pnl > 0 AS INT)) AS wins, avg(CASE WHEN r > 0 THEN r END) AS avg_win, -avg(CASE WHEN r < 0 THEN r END) AS avg_loss, avg(r) AS expectancy,
  -sum(CASE WHEN r > 0 THEN r END) / sum(CASE WHEN r < 0 THEN r END) AS profit_factor, avg(r) / stddev_pop(r) AS sharpe,
  avg(r) / sqrt(avg(power(least(0, r), 2))) AS sortino, max(dd) AS mdd, max(pnl) AS best, min(pnl) AS worst, sum(fees) AS fees,
  (epoch(max(closed)) - epoch(min(closed))) AS span, count(*) * 1.0 AS nn, sum(CAST(pnl > 0 AS INT)) / count(*) AS p FROM e2),
h AS (SELECT *, span / (365.25 * 86400) AS years, power((10000000 + net_pnl) / 10000000, 1 / (span / (365.25 * 86400))) - 1 AS ann FROM g)
SELECT n, uw AS max_dd_duration_trades, round(net_pnl, 4) AS net_pnl, round(p, 4) AS win_rate,
  round(((p + 1.96 * 1.96 / (2 * nn)) - 1.96 * sqrt(p * (1 - p) / nn + 1.96 * 1.96 / (4 * nn * nn))) / (1 + 1.96 * 1.96 / nn), 4) AS ci_lo,
  round(((p + 1.96 * 1.96 / (2 * nn)) + 1.96 * sqrt(p * (1 - p) / nn + 1.96 * 1.96 / (4 * nn * nn))) / (1 + 1.96 * 1.96 / nn), 4) AS ci_hi,
  round(avg_win, 6) AS avg_win, round(avg_loss, 6) AS avg_loss, round(avg_win / avg_loss, 6) AS win_loss_ratio, round(expectancy, 6) AS expectancy,
  round(profit_factor, 6) AS profit_factor, round(sharpe, 6) AS sharpe_per_trade, round(sortino, 6) AS sortino_per_trade,
  round(sharpe * sqrt(n / years), 6) AS ann_sharpe, round(mdd, 6) AS max_drawdown, round(ann / mdd, 6) AS calmar, round(ann, 6) AS annualized_return,
  round(best, 4) AS best_trade_pnl, round(worst, 4) AS worst_trade_pnl, round(fees, 5) AS gross_entry_fees, round(span / 86400, 1) AS span_days
FROM h CROSS JOIN uw""")
def tearsheet_overall(spark, d):
    x = G.tearsheet(T.trades(spark, d), ORD, T.trade_chunks(spark, d), 10_000_000.0)
    dig = {"net_pnl": 4, "best_trade_pnl": 4, "worst_trade_pnl": 4, "gross_entry_fees": 5}
    return x.select("n", "max_dd_duration_trades", *[r6(F.col(c), dig.get(c, 6)).alias(c) for c in SHEET])


@query("A3", TR + f""", x AS (SELECT *, {RET} AS r FROM trades), g AS (SELECT regime_at_entry AS regime, exit_reason AS reason, GROUPING(regime_at_entry, exit_reason) AS gid,
  count(*) AS n, sum(pnl) AS net_pnl, avg(CAST(pnl > 0 AS INT)) AS win_rate, avg(r) AS expectancy_pct,
  -sum(CASE WHEN r > 0 THEN r END) / sum(CASE WHEN r < 0 THEN r END) AS profit_factor, avg(r) / stddev_pop(r) AS sharpe_per_trade, avg(pnl) AS avg_pnl
  FROM x GROUP BY GROUPING SETS ((), (regime_at_entry), (exit_reason)))
SELECT CASE gid WHEN 3 THEN 'overall' WHEN 1 THEN 'regime' ELSE 'exit_reason' END AS slice, coalesce(regime, reason, 'all') AS key, n, round(net_pnl, 4) AS net_pnl,
  round(win_rate, 6) AS win_rate, round(expectancy_pct, 6) AS expectancy_pct, round(profit_factor, 6) AS profit_factor, round(sharpe_per_trade, 6) AS sharpe_per_trade, round(avg_pnl, 4) AS avg_pnl FROM g""")
def tearsheet_slices(spark, d):
    x = G.tearsheet_slices(T.trades(spark, d)).orderBy("net_pnl", "key")
    return x.select("slice", "key", "n", r6(F.col("net_pnl"), 4).alias("net_pnl"), *[r6(F.col(c)).alias(c) for c in
                    ("win_rate", "expectancy_pct", "profit_factor", "sharpe_per_trade")], r6(F.col("avg_pnl"), 4).alias("avg_pnl"))


@query("A4 W16 F10", TR + f""", e0 AS (SELECT *, sum(pnl) OVER (ORDER BY {OS} ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (ORDER BY {OS}) AS rn FROM trades),
e1 AS (SELECT *, greatest(0, max(cum) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING)) - cum AS dd FROM e0)""" + run_sql("e1", "pnl > 0", "ws") + run_sql("e1", "pnl <= 0", "ls") + """,
g AS (SELECT count(*) AS trades, sum(CAST(pnl > 0 AS INT)) AS wins, sum(CAST(pnl <= 0 AS INT)) AS losses, sum(pnl) AS tot, sum(CASE WHEN pnl > 0 THEN pnl END) AS gp,
  sum(CASE WHEN pnl <= 0 THEN pnl END) AS gl, max(pnl) AS lw, min(pnl) AS ll, stddev_samp(pnl) AS sd, stddev_samp(least(0, pnl)) AS dsd, max(dd) AS mdd, avg(epoch(closed) - epoch(opened)) AS hold FROM e1)
SELECT trades, wins, losses, ws AS best_win_streak, ls AS worst_loss_streak, round(tot, 4) AS total_pnl, round(gp, 4) AS gross_profit, round(gl, 4) AS gross_loss, round(-gp / gl, 6) AS profit_factor,
  round(tot / trades, 6) AS expectancy, round(lw, 4) AS largest_win, round(ll, 4) AS largest_loss, round((gp / wins) / (-gl / losses), 6) AS payoff_ratio, round(sd, 4) AS pnl_stdev,
  round(tot / trades / sd, 6) AS sharpe_per_trade, round(tot / trades / dsd, 6) AS sortino_per_trade, round(mdd, 4) AS max_drawdown_realized, round(hold, 3) AS avg_hold_sec,
  printf('%.1fd', hold / 86400) AS avg_hold_human FROM g CROSS JOIN ws CROSS JOIN ls""")
def trade_analytics(spark, d):
    x = G.trade_analytics(T.trades(spark, d), ORD, T.trade_chunks(spark, d))
    dig = {"pnl_stdev": 4, "avg_hold_sec": 3, **{c: 4 for c in ("total_pnl", "gross_profit", "gross_loss", "largest_win", "largest_loss", "max_drawdown_realized")}}
    return x.select("trades", "wins", "losses", "best_win_streak", "worst_loss_streak", G.human_duration(F.col("avg_hold_sec")).alias("avg_hold_human"),
                    *[r6(F.col(c), dig.get(c, 6)).alias(c) for c in x.columns if c not in ("trades", "wins", "losses", "best_win_streak", "worst_loss_streak")])


@query("A5", TR + """SELECT product, count(*) AS trades, sum(CAST(pnl > 0 AS INT)) AS wins, round(sum(pnl), 4) AS pnl, sum(CAST(side >= 0 AS INT)) AS n_long,
  sum(CAST(side < 0 AS INT)) AS n_short, round(avg(CAST(pnl > 0 AS INT)), 6) AS win_rate FROM trades GROUP BY product""")
def per_product_trades(spark, d):
    return T.trades(spark, d).groupBy("product").agg(
        F.count(F.lit(1)).alias("trades"), F.sum((F.col("pnl") > 0).cast("int")).alias("wins"), r6(F.sum("pnl"), 4).alias("pnl"),
        F.sum((F.col("side") >= 0).cast("int")).alias("n_long"), F.sum((F.col("side") < 0).cast("int")).alias("n_short"),
        r6(F.avg((F.col("pnl") > 0).cast("int"))).alias("win_rate"))


@query("A5", TR + "SELECT exit_reason, count(*) AS n, round(sum(pnl), 4) AS pnl FROM trades GROUP BY 1")
def per_exit_reason(spark, d):
    return T.trades(spark, d).groupBy("exit_reason").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("pnl"), 4).alias("pnl")).orderBy(F.desc("n"))


@query("A8 P2", TR + """, nw AS (SELECT max(closed) AS now FROM trades), g AS (SELECT upper(trim(split_part(product || '-USD', '-', 1))) AS sym, count(*) AS n, round(sum(pnl), 4) AS net,
  round(sum(pnl) / sum(abs(qty) * entry), 6) AS net_ratio FROM trades, nw WHERE closed >= now - INTERVAL 60 DAY GROUP BY 1)
SELECT sym, n, round(net, 4) AS net, net_ratio, round(CASE WHEN n < 30 THEN 1 WHEN net_ratio >= 0 THEN 1 + 0.5 * least(1, net_ratio / 0.05) ELSE 1 + 0.7 * greatest(-1, net_ratio / 0.05) END, 6) AS mult,
  CASE WHEN n < 30 THEN 'untested' WHEN net_ratio >= 0 THEN 'winner' ELSE 'loser' END AS tier FROM g""")
def performance_scores(spark, d):
    t = T.trades(spark, d).withColumn("sym", F.upper(F.trim(F.split_part(F.concat("product", F.lit("-USD")), F.lit("-"), F.lit(1)))))
    x = G.performance_scores(t, t.agg(F.max("closed").alias("now")), 60 * 86400, min_trades=30)
    return x.select("sym", "n", r6(F.col("net"), 4).alias("net"), r6(F.col("net_ratio")).alias("net_ratio"), r6(F.col("mult")).alias("mult"), "tier")


@query("A10 A9", TR + f""", x AS (SELECT product, {RET} AS r, pnl FROM trades), m AS (SELECT product, avg(r) AS m, stddev_pop(r) AS s FROM x GROUP BY 1)
SELECT product, count(*) AS n, round(any_value(m), 8) AS mean, round(any_value(s), 8) AS sd, round(avg(power((r - m) / s, 3)), 6) AS skew, round(avg(power((r - m) / s, 4)), 6) AS kurt,
  round(any_value(m) / any_value(s), 6) AS sharpe, round(any_value(m) / any_value(s) * sqrt(8760), 6) AS annualized_sharpe FROM x JOIN m USING (product) GROUP BY product""")
def moments_by_product(spark, d):
    r = G.trade_return()
    x = T.trades(spark, d).select("product", r.alias("r")).groupBy("product").agg(*[c.alias(n) for n, c in G.moments(F.col("r")).items()],
                                                                                     G.sharpe(F.col("r")).alias("sharpe"))
    return x.select("product", "n", r6(F.col("mean"), 8).alias("mean"), r6(F.col("sd"), 8).alias("sd"), r6(F.col("skew")).alias("skew"),
                    r6(F.col("kurt")).alias("kurt"), r6(F.col("sharpe")).alias("sharpe"), r6(F.col("sharpe") * F.sqrt(F.lit(8760.0))).alias("annualized_sharpe"))


@query("A13", TR + f""", x AS (SELECT product, {RET} AS r FROM trades) SELECT product, round(avg(CASE WHEN r > 0 THEN r END), 8) AS avg_win, round(-avg(CASE WHEN r < 0 THEN r END), 8) AS avg_loss,
  round(-avg(CASE WHEN r > 0 THEN r END) / avg(CASE WHEN r < 0 THEN r END), 6) AS win_loss_ratio, round(avg(r), 8) AS expectancy, round(-sum(CASE WHEN r > 0 THEN r END) / sum(CASE WHEN r < 0 THEN r END), 6) AS profit_factor,
  round((avg(r) - 0.01) / sqrt(avg(power(least(0, r - 0.01), 2))), 6) AS sortino FROM x GROUP BY 1""")
def trade_quality(spark, d):
    x = T.trades(spark, d).select("product", G.trade_return().alias("r")).groupBy("product").agg(
        *[c.alias(n) for n, c in G.win_loss(F.col("r")).items()], G.sortino(F.col("r"), 0.01).alias("sortino"))
    return x.select("product", *[r6(F.col(c), 8 if c in ("avg_win", "avg_loss", "expectancy") else 6).alias(c) for c in x.columns if c != "product"])


EQ = TR + """, per AS (SELECT closed AS ts, sum(pnl) AS pnl, count(*) AS n, sum(CAST(pnl > 0 AS INT)) AS wins FROM trades GROUP BY 1),
q0 AS (SELECT *, 10000000 + sum(pnl) OVER (ORDER BY ts) AS equity FROM per),
q1 AS (SELECT *, greatest(10000000, max(equity) OVER (ORDER BY ts)) AS peak FROM q0), eq AS (SELECT *, 1 - equity / peak AS drawdown FROM q1)
"""


def marks(spark, d):
    return G.equity_marks(T.trades(spark, d), 10_000_000.0)


@query("W17 A14", EQ + f"SELECT {EPOCH}, round(equity, 4) AS equity, round(peak, 4) AS peak, round(drawdown, 6) AS drawdown FROM eq")
def drawdown_series(spark, d):
    return marks(spark, d).select(F.unix_seconds("ts").alias("ts"), r6(F.col("equity"), 4).alias("equity"), r6(F.col("peak"), 4).alias("peak"), r6(F.col("drawdown")).alias("drawdown"))


@query("A54", EQ + f""", r0 AS (SELECT *, 1 - equity / first_value(equity) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts) AS day_loss FROM eq),
r1 AS (SELECT *, max(CAST(day_loss >= 0.001 AS INT)) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts) = 1 AS halted_today,
  drawdown >= 0.05 AND coalesce(max(CAST(drawdown >= 0.05 AS INT)) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS kill_tripped FROM r0)
SELECT {EPOCH}, round(drawdown, 6) AS drawdown, round(day_loss, 6) AS day_loss, halted_today, kill_tripped FROM r1""")
def risk_status(spark, d):
    x = G.risk_status(marks(spark, d), 0.05, 0.001)
    return x.select(F.unix_seconds("ts").alias("ts"), r6(F.col("drawdown")).alias("drawdown"), r6(F.col("day_loss")).alias("day_loss"), "halted_today", "kill_tripped")


@query("A54 (loss streak)", TR + f""", s AS (SELECT row_number() OVER (ORDER BY {OS}) AS rn, pnl FROM trades),
t AS (SELECT rn, rn - coalesce(max(CASE WHEN pnl > 0 THEN rn END) OVER (ORDER BY rn), 0) AS consecutive_losses FROM s)
SELECT rn, consecutive_losses, round(greatest(0.25, 1 - 0.2 * consecutive_losses), 6) AS risk_scale FROM t""")
def loss_scale(spark, d):
    x = G.loss_scale(T.trades(spark, d), ORD, T.TRADE_LEVELS)
    return x.select("rn", "consecutive_losses", r6(F.col("risk_scale")).alias("risk_scale"))


@query("A58 P28", EQ + """, s AS (SELECT *, CASE WHEN pnl > 0 THEN 'bull' ELSE 'bear' END || '/' || CASE WHEN n > 1 THEN 'high-vol' ELSE 'normal' END || '/' ||
  CASE WHEN drawdown < 0.03 THEN 0 WHEN drawdown < 0.08 THEN 1 ELSE 2 END || '/' || CASE WHEN n - wins = 0 THEN 0 WHEN n - wins <= 2 THEN 1 ELSE 2 END AS state, (n % 3) / 2 AS action FROM eq),
l AS (SELECT *, lag(equity) OVER (ORDER BY ts) AS pe, lag(state) OVER (ORDER BY ts) AS ps, lag(action) OVER (ORDER BY ts) AS pa FROM s)
SELECT ps AS state, round(pa, 6) AS action, count(*) AS n, round(avg(ln(equity / pe) * (0.15 + 0.85 * pa) - 0.5 * greatest(0, drawdown - 0.05) * pa), 9) AS mean_reward FROM l WHERE pe > 0 GROUP BY 1, 2""")
def reward_table(spark, d):
    m = marks(spark, d).withColumn("_day", S.time_chunk("ts", S.DAY))
    st = G.risk_state(F.when(F.col("pnl") > 0, "bull").otherwise("bear"), F.when(F.col("n") > 1, "high-vol").otherwise("normal"), F.col("drawdown"), F.col("n") - F.col("wins"))
    x = G.reward_table(m, st, F.col("n") % 3 / 2, ["_day"])
    return x.select("state", r6(F.col("action")).alias("action"), "n", r6(F.col("mean_reward"), 9).alias("mean_reward"))


DEC = ", i AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS r, count(*) OVER () AS n FROM eq), k AS (SELECT *, (r * 799 + greatest(n - 1, 1) - 1) // greatest(n - 1, 1) AS j FROM i)"


@query("W33", EQ.replace("count(*) AS n, ", "") + DEC + f" SELECT {EPOCH}, round(equity, 4) AS equity FROM k WHERE n <= 800 OR (j < 800 AND j * (n - 1) // 799 = r)")
def equity_decimation(spark, d):
    m = marks(spark, d).withColumn("_day", S.time_chunk("ts", S.DAY))
    return G.decimate(m, ["ts"], 800, ["_day"]).select(F.unix_seconds("ts").alias("ts"), r6(F.col("equity"), 4).alias("equity"))


WINDOWS = {"1h": 3600, "1d": 86400, "7d": 7 * 86400, "30d": 30 * 86400}


@query("A66", EQ + f""", nw AS (SELECT max(ts) AS now FROM eq), lb(lookback, sec) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in WINDOWS.items())}),
ew AS (SELECT lookback, ts, equity, epoch(ts) >= epoch(now) - sec AS inside FROM eq, nw, lb),
ea AS (SELECT lookback, count(*) FILTER (inside) AS n, first(equity ORDER BY ts) FILTER (inside) AS fe, last(equity ORDER BY ts) FILTER (inside) AS le, last(equity ORDER BY ts) FILTER (NOT inside) AS pe FROM ew GROUP BY 1)
SELECT lookback, n + CAST(n < 2 AND pe IS NOT NULL AS INT) AS points, round(CASE WHEN n < 2 AND pe IS NOT NULL THEN pe ELSE fe END, 4) AS first_equity, round(le, 4) AS last_equity FROM ea""")
def equity_windows(spark, d):
    return G.equity_windows(marks(spark, d), WINDOWS).select("lookback", "points", *[r6(F.col(c), 4).alias(c) for c in ("first_equity", "last_equity")])


LOCKS = TR + """, per AS (SELECT product, closed AS ts, count(*) AS n, sum(pnl) AS pnl, sum(abs(qty) * entry) AS stake, sum(CAST(exit_reason LIKE '%stop%' AND pnl < 0 AS INT)) AS stops FROM trades GROUP BY 1, 2),
pr AS (SELECT *, sum(n) OVER f AS pair_n, sum(pnl) OVER f / sum(stake) OVER f AS pair_ratio FROM per WINDOW f AS (PARTITION BY product ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)),
al AS (SELECT ts, sum(n) AS n, sum(pnl) AS pnl, sum(stops) AS stops FROM per GROUP BY 1),
a1 AS (SELECT ts, sum(stops) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND CURRENT ROW) AS stop_n, sum(n) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS dd_n FROM al),
w AS (SELECT a.ts, b.ts AS bt, sum(b.pnl) OVER (PARTITION BY a.ts ORDER BY b.ts) AS cum FROM al a JOIN al b ON b.ts BETWEEN a.ts - INTERVAL 12 HOUR AND a.ts),
w2 AS (SELECT ts, cum, greatest(0, max(cum) OVER (PARTITION BY ts ORDER BY bt)) AS peak FROM w),
dd AS (SELECT ts, greatest(0, max((peak - cum) / greatest(abs(peak), 1e-9))) AS dd_worst FROM w2 GROUP BY 1),
lk AS (SELECT product, ts, pair_n >= 3 AND pair_ratio < 0 AS low, stop_n >= 12 AS st, dd_n >= 10 AND dd_worst >= 0.9 AS md, epoch(ts) AS t, pair_n, pair_ratio, stop_n FROM pr JOIN a1 USING (ts) JOIN dd USING (ts))
"""


@query("A42 P19", LOCKS + f"""SELECT product, {EPOCH}, pair_n, round(pair_ratio, 6) AS pair_ratio, stop_n, CAST(greatest(CASE WHEN st THEN t + 3600 END, CASE WHEN md THEN t + 7200 END) AS BIGINT) AS global_until,
  CAST(CASE WHEN low THEN t + 21600 END AS BIGINT) AS pair_until, CASE WHEN md THEN 'MaxDrawdown' WHEN st THEN 'StoplossGuard' WHEN low THEN 'LowProfitPairs' END AS reason FROM lk""")
def protection_locks(spark, d):
    x = G.protection_locks(T.trades(spark, d), stop_limit=12, stop_look=10800, dd_frac=0.9)
    return x.select("product", F.unix_seconds("closed").alias("ts"), "pair_n", r6(F.col("pair_ratio")).alias("pair_ratio"), "stop_n", "global_until", "pair_until", "reason")


@query("W38 (cooldown)", TR + """, x AS (SELECT DISTINCT product, closed FROM trades)
SELECT t.product, count(*) AS n, count(x.closed) AS n_after_exit, sum(CAST(coalesce(epoch(t.opened) - epoch(x.closed) < 14400, false) AS INT)) AS n_cooling
FROM trades t ASOF LEFT JOIN x ON t.product = x.product AND t.opened >= x.closed GROUP BY 1""")
def entry_cooldown(spark, d):
    t = T.trades(spark, d)
    x = J.cooldown(t.select("product", F.col("opened").alias("ts")), t.select("product", F.col("closed").alias("ts")), 14400)
    return x.groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.count("last_exit").alias("n_after_exit"), F.sum(F.col("cooling").cast("int")).alias("n_cooling"))


@query("A57", """SELECT CAST(epoch_us(ts) AS BIGINT) AS ts, n_trailing, n_trailing > 15 AS over_cap FROM (SELECT DISTINCT ts, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_trailing FROM events)""")
def entry_rate(spark, d):
    x = G.trailing_count(T.load(spark, d, "events"), "ts", 3600)
    return x.select(F.unix_micros("ts").alias("ts"), "n_trailing", (F.col("n_trailing") > 15).alias("over_cap"))


FL = with_views("fills")


@query("A45 T5", FL + """, once AS (SELECT * FROM fills QUALIFY row_number() OVER (PARTITION BY intent_id, exec_id ORDER BY ts, l_linenumber, product, qty, price, fee) = 1),
b AS (SELECT *, coalesce(sum(qty) OVER (PARTITION BY intent_id ORDER BY ts, l_linenumber, exec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM once),
c AS (SELECT * FROM b WHERE bef + 1e-12 < 40 + intent_id % 80)
SELECT intent_id, round(sum(qty), 4) AS filled_qty, round(sum(qty * price) / sum(qty), 6) AS vwap, round(sum(fee), 6) AS fees, count(*) AS n_fills,
  CASE WHEN sum(qty) + 1e-12 >= 40 + intent_id % 80 THEN 'FILLED' ELSE 'PARTIAL' END AS status FROM c GROUP BY intent_id""")
def order_vwap(spark, d):
    f = T.fills(spark, d)
    orders = T.load(spark, d, "orders").select(F.col("o_orderkey").alias("intent_id"), (40 + F.col("o_orderkey") % 80).cast("double").alias("order_qty"))
    x = G.order_vwap(f, orders, ["ts", "l_linenumber"])
    return x.select("intent_id", r6(F.col("filled_qty"), 4).alias("filled_qty"), r6(F.col("vwap")).alias("vwap"), r6(F.col("fees")).alias("fees"), "n_fills", "status")


@query("J9", """WITH l AS (SELECT o_orderkey AS order_id, CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'P' THEN 'UNKNOWN' ELSE 'OPEN' END AS status, 60.0 AS qty FROM orders WHERE o_orderkey % 10 <> 0),
v AS (SELECT o_orderkey AS order_id, true AS op FROM orders WHERE o_custkey % 3 <> 0), f AS (SELECT l_orderkey AS order_id, sum(l_quantity) AS fq FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
j AS (SELECT order_id, status, qty, coalesce(op, false) AS op, coalesce(fq, 0) AS fq FROM l FULL JOIN v USING (order_id) LEFT JOIN f USING (order_id)),
r AS (SELECT *, CASE WHEN status IS NULL THEN 'VENUE_ONLY' WHEN status = 'FILLED' THEN status WHEN fq > 0 THEN CASE WHEN fq >= qty THEN 'FILLED' ELSE 'PARTIAL' END
  WHEN status = 'UNKNOWN' THEN CASE WHEN op THEN 'OPEN' ELSE 'CANCELED' END ELSE status END AS resolved FROM j)
SELECT order_id, status, resolved, coalesce(status IS NOT NULL AND status <> 'FILLED' AND resolved IN ('OPEN', 'PARTIAL') AND NOT op AND fq < qty, false) AS drift FROM r""")
def reconcile_orders(spark, d):
    o = T.load(spark, d, "orders")
    local = o.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "P", "UNKNOWN")
                                                   .otherwise("OPEN").alias("status"), F.lit(60.0).alias("qty"))
    filled = T.load(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sum("l_quantity").alias("filled_qty"))
    x = G.reconcile(local, o.where("o_custkey % 3 <> 0").select(F.col("o_orderkey").alias("order_id")), filled)
    return x.withColumn("drift", F.coalesce("drift", F.lit(False)))


@query("J10", FL + """, p AS (SELECT intent_id, avg(price) AS paper, max(ts) AS ts FROM fills WHERE l_linenumber <= 4 GROUP BY 1), s AS (SELECT intent_id, avg(price) AS shadow FROM fills WHERE l_linenumber > 3 GROUP BY 1),
j AS (SELECT intent_id, abs(shadow - paper) / paper * 1e4 AS bps, ts FROM p JOIN s USING (intent_id))
SELECT count(*) AS n, round(avg(bps), 4) AS avg_bps, round(max(bps), 4) AS max_bps FROM j""")
def fill_divergence(spark, d):
    f = T.fills(spark, d)
    p = f.where("l_linenumber <= 4").groupBy("intent_id").agg(F.avg("price").alias("paper"), F.max("ts").alias("ts"))
    s = f.where("l_linenumber > 3").groupBy("intent_id").agg(F.avg("price").alias("shadow"))
    x = p.join(s, "intent_id").withColumn("bps", F.abs(F.col("shadow") - F.col("paper")) / F.col("paper") * 1e4)
    return x.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("bps"), 4).alias("avg_bps"), r6(F.max("bps"), 4).alias("max_bps"))


@query("A43", """WITH e AS (SELECT user_id || '-' || (event_id // 3) AS event_id, ts, event_type AS sleeve, value - 50 AS amount, event_id AS seq FROM events),
o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts, seq) = 1)
SELECT event_id, round(1000 + sum(amount) OVER (PARTITION BY sleeve ORDER BY ts, seq, event_id ROWS UNBOUNDED PRECEDING), 4) AS balance FROM o""")
def ledger_balance(spark, d):
    e = T.load(spark, d, "events").select(F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 3)).alias("event_id"), "ts", F.col("event_type").alias("sleeve"),
                                          (F.col("value") - 50).alias("amount"), F.col("event_id").alias("seq"))
    x = G.ledger_balance(e.withColumn("_day", S.time_chunk("ts", S.DAY)), ["ts", "seq"], 1000.0, ["sleeve"], ["_day"])
    return x.select("event_id", r6(F.col("balance"), 4).alias("balance"))


@query("A43 X5 (conditional reservations)", """WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value - 60 AS a FROM events),
f(user_id, i, cash, ok) AS (SELECT user_id, CAST(0 AS BIGINT), CAST(50 AS DOUBLE), 0 FROM (SELECT DISTINCT user_id FROM events) UNION ALL
  SELECT o.user_id, o.i, CASE WHEN o.a < 0 AND f.cash + 1e-9 < -o.a THEN f.cash ELSE f.cash + o.a END, CASE WHEN o.a < 0 AND f.cash + 1e-9 < -o.a THEN 0 ELSE 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, sum(ok) AS applied, max(i) AS n, round(last(cash ORDER BY i), 4) AS balance FROM f GROUP BY 1""")
def reserve_cash(spark, d):
    e = T.load(spark, d, "events").select("event_id", "user_id", "ts", (F.col("value") - 60).alias("amount"))
    x = G.reserve_cash(e, 50.0, ["user_id"], ["ts", "event_id"])
    return x.groupBy("user_id").agg(F.sum("applied").cast("bigint").alias("applied"), F.count(F.lit(1)).alias("n"), r6(F.max_by("balance", F.struct("ts", "event_id")), 4).alias("balance"))


TK = with_views("ticks")


@query("A62 A44", TK + """, lp AS (SELECT product, last(price ORDER BY ts, event_id) AS mark FROM ticks WHERE product <> 'error' GROUP BY 1), ps AS (SELECT event_id, product, price AS entry, size AS qty, CASE WHEN size % 2 = 0 THEN 1 ELSE -1 END AS side, user_id % 3 AS sleeve FROM ticks),
m AS (SELECT *, coalesce(mark, entry) AS mk FROM ps LEFT JOIN lp USING (product))
SELECT sleeve, count(*) AS n, round(sum(qty * mk), 4) AS value, round(sum(side * (mk - entry) * qty), 4) AS unrealized, round(avg(side * (mk / entry - 1)), 8) AS unrealized_pct,
  round(10000 + sum(qty * mk), 4) AS equity FROM m GROUP BY 1""")
def position_marks(spark, d):
    t = T.ticks(spark, d)
    pos = t.select("event_id", "product", F.col("price").alias("entry"), F.col("size").alias("qty"), F.when(F.col("size") % 2 == 0, 1).otherwise(-1).alias("side"), (F.col("user_id") % 3).alias("sleeve"))
    px = t.where("product <> 'error'").groupBy("product").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"))
    x = G.position_marks(pos, px)
    return x.groupBy("sleeve").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 4).alias("value"), r6(F.sum("unrealized"), 4).alias("unrealized"),
                                   r6(F.avg("unrealized_pct"), 8).alias("unrealized_pct"), r6(10000 + F.sum("value"), 4).alias("equity"))


@query("A56", TK + with_views("decisions").replace("WITH ", ", ") + """, m AS (SELECT *, lag(ts) OVER (PARTITION BY product ORDER BY ts, event_id) AS pt FROM ticks), j AS (SELECT m.product, m.price * m.size * (d.composite / 1000) * ((epoch_us(m.ts) - epoch_us(m.pt)) / 1e6 / 28800) AS f
  FROM m ASOF LEFT JOIN decisions d ON m.product = d.product AND m.ts >= d.ts)
SELECT product, count(f) AS n, round(sum(f), 6) AS funding FROM j GROUP BY 1""")
def funding_cost(spark, d):
    t = T.ticks(spark, d).select("product", "ts", "event_id", (F.col("price") * F.col("size")).alias("notional")).withColumn("_day", S.time_chunk("ts", S.DAY))
    r = T.decisions(spark, d).select("product", "ts", F.col("event_id").alias("rate_id"), (F.col("composite") / 1000).alias("funding_rate"))
    return G.funding_cost(t, r, "product", ["_day"]).groupBy("product").agg(F.count("funding").alias("n"), r6(F.sum("funding")).alias("funding"))


@query("A55", PATH + f""", l20 AS (SELECT count(*) AS recent, avg(CAST(pnl > 0 AS INT)) AS wr, sum(pnl) AS p FROM (SELECT pnl FROM trades ORDER BY {', '.join(c + ' DESC' for c in ORD)} LIMIT 20)),
cx AS (SELECT last(dd ORDER BY rn) AS dd FROM e2), s AS (SELECT *, greatest(0, least(1, 0.5 + CASE WHEN recent < 8 THEN 0 WHEN wr >= 0.55 AND p > 0 THEN 0.2 WHEN wr <= 0.35 OR p < 0 THEN -0.15 ELSE 0 END
  + CASE WHEN dd > 0.05 THEN -0.25 WHEN dd > 0.02 THEN -0.1 ELSE 0 END - 0.1)) AS score FROM l20, cx)
SELECT recent, round(wr, 6) AS recent_win_rate, round(p, 4) AS recent_pnl, round(score, 6) AS score, CASE WHEN score < 0.35 THEN 'passive' WHEN score > 0.65 THEN 'aggressive' ELSE 'neutral' END AS label FROM s""")
def stance_score(spark, d):
    t = T.trades(spark, d)
    ctx = marks(spark, d).agg(F.max_by("drawdown", "ts").alias("drawdown")).select("drawdown", F.lit(0).alias("consecutive_losses"), F.lit(False).alias("drifting"),
                                                                                   F.lit("high-vol").alias("vol_state"), F.lit(False).alias("blackout"))
    x = G.stance(t, ORD, ctx)
    return x.select("recent", r6(F.col("recent_win_rate")).alias("recent_win_rate"), r6(F.col("recent_pnl"), 4).alias("recent_pnl"), r6(F.col("score")).alias("score"), "label")


@query("A48", FL + """SELECT product, count(*) AS n, round(sum(qty * price * 0.005), 4) AS fees_paid, round(sum(qty * price * 0.001), 4) AS slippage_paid, round(sum(qty * price) / 1e6, 6) AS turnover,
  round(sum(qty * price * 0.006) / 1e6, 6) AS total_cost_pct, round(sum(qty * price * 0.006) / 1e6 / count(*), 8) AS cost_per_trade_pct FROM fills GROUP BY 1""")
def cost_decomposition(spark, d):
    n = F.col("qty") * F.col("price")
    return T.fills(spark, d).groupBy("product").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum(n * 0.005), 4).alias("fees_paid"), r6(F.sum(n * 0.001), 4).alias("slippage_paid"), r6(F.sum(n) / 1e6).alias("turnover"),
        r6(F.sum(n * 0.006) / 1e6).alias("total_cost_pct"), r6(F.sum(n * 0.006) / 1e6 / F.count(F.lit(1)), 8).alias("cost_per_trade_pct"))


@query("A60", TR + """, p AS (SELECT product, closed, avg(pnl / (qty * entry)) AS b, avg(CASE WHEN side > 0 THEN 1.1 ELSE 0.7 END * pnl / (qty * entry)) AS s FROM trades GROUP BY 1, 2)
SELECT product, count(*) AS n, round(avg(b), 8) AS base_mean, round(avg(s), 8) AS scale_mean, round(quantile_cont(b, 0.5), 8) AS base_median, round(quantile_cont(s, 0.5), 8) AS scale_median, round(avg(CAST(s > b + 1e-12 AS INT)), 6) AS win_share FROM p GROUP BY 1""")
def scale_out_compare(spark, d):
    r = F.col("pnl") / (F.col("qty") * F.col("entry"))
    p = T.trades(spark, d).groupBy("product", "closed").agg(F.avg(r).alias("b"), F.avg(F.when(F.col("side") > 0, 1.1).otherwise(0.7) * r).alias("s"))
    return p.groupBy("product").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("b"), 8).alias("base_mean"), r6(F.avg("s"), 8).alias("scale_mean"), r6(F.percentile("b", F.lit(0.5)), 8).alias("base_median"),
                                    r6(F.percentile("s", F.lit(0.5)), 8).alias("scale_median"), r6(F.avg((F.col("s") > F.col("b") + 1e-12).cast("int"))).alias("win_share"))


@query("A67", TR + """SELECT hedge AS book, count(*) AS trades, round(avg(CAST(pnl > 0 AS INT)), 6) AS win_rate, round(sum(pnl), 4) AS realized_pnl, round(avg(CASE WHEN pnl > 0 THEN pnl END), 4) AS avg_win,
  round(sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END) / greatest(1, sum(CAST(pnl <= 0 AS INT))), 4) AS avg_loss FROM trades GROUP BY 1""")
def trade_stats(spark, d):
    p = F.col("pnl")
    return T.trades(spark, d).groupBy(F.col("hedge").alias("book")).agg(
        F.count(F.lit(1)).alias("trades"), r6(F.avg((p > 0).cast("int"))).alias("win_rate"), r6(F.sum(p), 4).alias("realized_pnl"), r6(F.avg(F.when(p > 0, p)), 4).alias("avg_win"),
        r6(F.sum(F.when(p <= 0, p).otherwise(0.0)) / F.greatest(F.lit(1), F.sum((p <= 0).cast("int"))), 4).alias("avg_loss"))


def open_spans(f, c, horizon_sec):
    """Bars seen while each entry is open."""
    h = horizon_sec
    e = f.select("product", F.col("ts").alias("t0"), F.col("close").alias("entry"), F.when(F.col("rsi") > 50, 1).otherwise(-1).alias("side"))
    e = e.withColumn("_b", F.explode(F.array(S.time_chunk("t0", h), S.time_chunk("t0", h) + 1)))
    b = c.select("product", "ts", "close", "high", "low", S.time_chunk("ts", h).alias("_b"))
    lag = F.unix_seconds("ts") - F.unix_seconds("t0")
    return e.join(b, ["product", "_b"]).where((lag > 0) & (lag <= h)).drop("_b")


@query("W35 W38", FEAT + f""", sp AS (SELECT f.product, f.ts AS t0, f.close AS entry, CASE WHEN f.rsi > 50 THEN 1 ELSE -1 END AS side, c.ts, c.close, c.high, c.low FROM features f JOIN candles c ON f.product = c.product AND c.ts > f.ts AND c.ts <= f.ts + INTERVAL 6 HOUR),
w AS (SELECT *, max(side * close) OVER (PARTITION BY product, t0 ORDER BY ts) * side AS water FROM sp),
g AS (SELECT *, side * (water - entry) AS pk, side * (close - entry) AS cur FROM w)
SELECT product, CAST(epoch(t0) AS BIGINT) AS t0, {EPOCH}, round(water, 6) AS water, round(water * (1 - side * 0.02), 6) AS trail,
  epoch(ts) - epoch(t0) >= 7200 AND pk > 0 AND pk / entry >= 0.01 AND cur > 0 AND pk - cur >= 0.35 * pk AS giveback FROM g""")
def trailing_marks(spark, d):
    c = T.candles(spark, d)
    x = open_spans(I.features(c), c, 6 * 3600)
    w = W.partitionBy("product", "t0").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("water", F.max(F.col("side") * F.col("close")).over(w) * F.col("side"))
    peak, cur = F.col("side") * (F.col("water") - F.col("entry")), F.col("side") * (F.col("close") - F.col("entry"))
    gb = ((F.unix_seconds("ts") - F.unix_seconds("t0") >= 7200) & (peak > 0) & (peak / F.col("entry") >= 0.01) & (cur > 0) & (peak - cur >= 0.35 * peak))
    return x.select("product", F.unix_seconds("t0").alias("t0"), F.unix_seconds("ts").alias("ts"), r6(F.col("water")).alias("water"),
                    r6(F.col("water") * (1 - F.col("side") * 0.02)).alias("trail"), gb.alias("giveback"))


@query("P20 F15", """SELECT event_id, round(CASE WHEN value > 50 THEN value END, 6) AS a, round(CASE WHEN value <> 0 AND value <= 90 THEN 100 / value END, 6) AS b FROM events""")
def json_safe(spark, d):
    v = F.col("value")
    a = F.when(v > 50, v).otherwise(F.lit(float("nan")))
    b = F.when(v > 90, F.lit(float("-inf"))).when(v == 0, F.lit(float("inf"))).otherwise(100 / v)
    return T.load(spark, d, "events").select("event_id", r6(finite(a)).alias("a"), r6(finite(b)).alias("b"))


@query("A9", TR + """, g AS (SELECT regime_at_entry AS regime, sum(CAST(pnl > 0 AS INT)) AS w, count(*) * 1.0 AS n FROM trades GROUP BY 1), p AS (SELECT *, w / n AS p FROM g)
SELECT regime, round(p, 4) AS win_rate, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 4) AS ci_lo,
  round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 4) AS ci_hi FROM p""")
def wilson_interval(spark, d):
    g = T.trades(spark, d).groupBy(F.col("regime_at_entry").alias("regime")).agg(F.sum((F.col("pnl") > 0).cast("int")).alias("w"), F.count(F.lit(1)).alias("n"))
    return g.select("regime", *[c.alias(n) for n, c in wilson(F.col("w"), F.col("n")).items()])
