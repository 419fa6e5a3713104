"""Recurrence and chart-pattern queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlab.functions.mathx import r6
from marketlab.operators import folds, patterns
from marketlab.plans.price import EPOCH, PW, fr, out, rd
from marketlab.plans.registry import query
from marketlab.plans.views import with_views
from marketlab.sources import tables as T

CANDLES = "WITH RECURSIVE " + with_views("candles")[5:]


def ema_rec(n):
    k = 2 / (n + 1)
    return f""", q{n} AS (SELECT product, ts, close, row_number() OVER {PW} AS rn FROM candles),
s{n}(product, rn, v) AS (SELECT product, rn, close FROM q{n} WHERE rn = 1 UNION ALL
  SELECT q.product, q.rn, q.close * {k!r} + s.v * {1 - k!r} FROM s{n} s JOIN q{n} q ON q.product = s.product AND q.rn = s.rn + 1)
"""


@query("W3", CANDLES + ema_rec(12) + ema_rec(200) + f"""SELECT product, {EPOCH}, round(a.v, 6) AS ema_fast, round(b.v, 6) AS ema_slow
FROM q12 JOIN s12 a USING (product, rn) JOIN s200 b USING (product, rn)""")
def ema_series(spark, d):
    return out(folds.ema_series(T.candles(spark, d), "close", {"ema_fast": 12, "ema_slow": 200}), "ema_fast", "ema_slow")


WILDER = f""", w0 AS (SELECT *, row_number() OVER {PW} AS rn, close - lag(close) OVER {PW} AS dd FROM candles),
w1 AS (SELECT *, avg(greatest(dd, 0)) OVER {fr(14)} AS sg, avg(greatest(-dd, 0)) OVER {fr(14)} AS sl FROM w0),
w2(product, rn, ag, al) AS (SELECT product, rn, sg, sl FROM w1 WHERE rn = 15 UNION ALL
  SELECT q.product, q.rn, (s.ag * 13 + greatest(q.dd, 0)) / 14, (s.al * 13 + greatest(-q.dd, 0)) / 14
  FROM w2 s JOIN w1 q ON q.product = s.product AND q.rn = s.rn + 1),
wr AS (SELECT w1.*, CASE WHEN w2.rn IS NULL THEN 50 ELSE 100 - 100 / (1 + CASE WHEN al > 1e-12 THEN ag / al ELSE 999 END)
  END AS rsi_wilder FROM w1 LEFT JOIN w2 USING (product, rn))
"""


@query("W6", CANDLES + WILDER + f"SELECT product, {EPOCH}, round(rsi_wilder, 6) AS rsi_wilder FROM wr")
def wilder_rsi(spark, d):
    return out(folds.wilder_rsi(T.candles(spark, d)), "rsi_wilder")


def bk(a, k, f):
    return f"list_extract({a}, -{k}).{f}"


def slope_sql(a):
    x = [bk(a, k, "i") for k in (3, 2, 1)]
    y = [bk(a, k, "p") for k in (3, 2, 1)]
    mx = f"(({x[0]} + {x[1]} + {x[2]}) / 3)"
    num = " + ".join(f"({i} - {mx}) * {j}" for i, j in zip(x, y))
    den = " + ".join(f"({i} - {mx}) * ({i} - {mx})" for i in x)
    return f"CASE WHEN len({a}) >= 3 THEN ({num}) / ({den}) WHEN len({a}) = 2 THEN ({y[2]} - {y[1]}) / ({x[2]} - {x[1]}) END"


def lsum(a):
    s = f"{bk(a, 2, 'p')} + {bk(a, 1, 'p')}"
    return f"CASE WHEN len({a}) >= 3 THEN {s} + {bk(a, 3, 'p')} ELSE {s} END"


def same(a, b, tol=0.02):
    return f"(abs({a} - {b}) / ((abs({a}) + abs({b})) / 2) <= {tol!r})"


H0, H1, H2 = (bk("ph", k, "p") for k in (3, 2, 1))
L0, L1, L2 = (bk("pl", k, "p") for k in (3, 2, 1))
PATTERNS = CANDLES + WILDER + f""", p0 AS (SELECT *, lag(high, 3) OVER {PW} AS h3, lag(low, 3) OVER {PW} AS l3,
  lag(rsi_wilder, 3) OVER {PW} AS r3, max(high) OVER {fr(7)} AS mh, min(low) OVER {fr(7)} AS ml,
  lag(open) OVER {PW} AS po, lag(close) OVER {PW} AS pc FROM wr),
p1 AS (SELECT *, list({{'i': rn - 3, 'p': h3, 'r': r3}}) FILTER (WHERE rn > 6 AND h3 >= mh) OVER {fr(294)} AS ph,
  list({{'i': rn - 3, 'p': l3, 'r': r3}}) FILTER (WHERE rn > 6 AND l3 <= ml) OVER {fr(294)} AS pl FROM p0),
p2 AS (SELECT *, coalesce(len(ph) >= 2 AND len(pl) >= 2, false) AS two,
  list_min(list_filter(list_transform(ph, lambda s: s.p), lambda v: v > close)) AS res,
  list_max(list_filter(list_transform(pl, lambda s: s.p), lambda v: v < close)) AS sup,
  ({slope_sql('ph')}) / ((({lsum('ph')}) + ({lsum('pl')})) / (least(len(ph), 3) + least(len(pl), 3))) AS t,
  ({slope_sql('pl')}) / ((({lsum('ph')}) + ({lsum('pl')})) / (least(len(ph), 3) + least(len(pl), 3))) AS b,
  CASE WHEN high > low THEN high - low ELSE 1e-9 END AS rng, abs(close - open) AS body,
  high - greatest(open, close) AS upper, least(open, close) - low AS lower FROM p1),
p3 AS (SELECT *, CASE WHEN two AND {H2} > {H1} AND {L2} > {L1} THEN 1 WHEN two AND {H2} < {H1} AND {L2} < {L1} THEN -1 ELSE 0 END AS pat_structure,
  CASE WHEN res - sup > 1e-9 THEN greatest(-1, least(1, 1 - 2 * (close - sup) / (res - sup))) ELSE 0 END AS pat_sr,
  greatest(-1, least(1,
   CASE WHEN {same(L1, L2)} AND {bk('pl', 1, 'i')} - {bk('pl', 2, 'i')} >= 3 AND close > greatest({L1}, {L2}) THEN 0.9 ELSE 0 END
   - CASE WHEN {same(H1, H2)} AND {bk('ph', 1, 'i')} - {bk('ph', 2, 'i')} >= 3 AND close < least({H1}, {H2}) THEN 0.9 ELSE 0 END
   + CASE WHEN {L1} < {L0} AND {L1} < {L2} AND {same(L0, L2, 0.03)} THEN 0.85 ELSE 0 END
   - CASE WHEN {H1} > {H0} AND {H1} > {H2} AND {same(H0, H2, 0.03)} THEN 0.85 ELSE 0 END)) AS pat_reversal,
  CASE WHEN NOT two THEN 0 WHEN abs(t) < 3e-4 AND b > 3e-4 THEN 0.6 WHEN abs(b) < 3e-4 AND t < -3e-4 THEN -0.6
   WHEN t > 3e-4 AND b > 3e-4 AND b > t THEN -0.5 WHEN t < -3e-4 AND b < -3e-4 AND b > t THEN 0.5 ELSE 0 END AS pat_continuation,
  greatest(-1, least(1, CASE WHEN {L2} < {L1} AND {bk('pl', 1, 'r')} > {bk('pl', 2, 'r')} + 2 THEN 0.7 ELSE 0 END
   - CASE WHEN {H2} > {H1} AND {bk('ph', 1, 'r')} < {bk('ph', 2, 'r')} - 2 THEN 0.7 ELSE 0 END)) AS pat_divergence FROM p2),
p4 AS (SELECT *, greatest(-1, least(1,
   CASE WHEN pc < po AND close > open AND close >= po AND open <= pc THEN 0.7 WHEN pc > po AND close < open AND close <= po AND open >= pc THEN -0.7 ELSE 0 END
   + CASE WHEN body < 0.35 * rng AND lower > 2 * body AND upper < body AND pat_structure <= 0 THEN 0.5 ELSE 0 END
   - CASE WHEN body < 0.35 * rng AND upper > 2 * body AND lower < body AND pat_structure >= 0 THEN 0.5 ELSE 0 END)) AS pat_candle FROM p3),
pat AS (SELECT product, ts, rn, {', '.join(f'CASE WHEN rn >= 40 THEN {c} ELSE 0 END AS {c}' for c in patterns.LEAN_WEIGHTS)} FROM p4)
"""


@query("W18 W19 W20 W21 W22 W23 W24 W25 W26", PATTERNS + f"""SELECT product, {EPOCH}, {rd(*patterns.LEAN_WEIGHTS)},
  round(greatest(-1, least(1, {' + '.join(f'{c} * {w!r}' for c, w in patterns.LEAN_WEIGHTS.items())})), 6) AS pat_lean,
  CASE WHEN rn < 40 THEN 'unknown' WHEN pat_structure > 0.5 THEN 'uptrend' WHEN pat_structure < -0.5 THEN 'downtrend' ELSE 'range' END AS structure FROM pat""")
def chart_patterns(spark, d):
    x = patterns.detect(T.candles(spark, d))
    return x.select("product", F.unix_seconds("ts").alias("ts"), "structure",
                    *[r6(F.col(c)).alias(c) for c in [*patterns.LEAN_WEIGHTS, "pat_lean"]])


@query("W27", PATTERNS + f"""SELECT product, {EPOCH},
  round(least(1, {' + '.join(f'{w!r} * greatest(0, -{c})' for c, w in patterns.THREAT_WEIGHTS.items())}), 6) AS threat_long,
  round(least(1, {' + '.join(f'{w!r} * greatest(0, {c})' for c, w in patterns.THREAT_WEIGHTS.items())}), 6) AS threat_short FROM pat""")
def exit_threat(spark, d):
    return out(patterns.detect(T.candles(spark, d)), "threat_long", "threat_short")


@query("W26 W27 (detected list)")
def detected_patterns(spark, d):
    x = patterns.detect(T.candles(spark, d))
    return (x.select("product", F.explode("detected").alias("p")).groupBy("product", "p.name", "p.direction")
            .agg(F.count(F.lit(1)).alias("n"), F.max("p.strength").alias("strength")))
