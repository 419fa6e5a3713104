"""Strategy scores, votes, gates, sizing, rules and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlab.functions.mathx import clip, r6
from marketlab.operators import indicators as I
from marketlab.operators import patterns as PT
from marketlab.operators import rules as R
from marketlab.operators import signals as G
from marketlab.plans.chart import PATTERNS as CHART
from marketlab.plans.price import ATRS, EPOCH, FEAT, FEATURES, PW, fr, out, rd
from marketlab.plans.chart import CANDLES as RCANDLES, ema_rec
from marketlab.plans.registry import query
from marketlab.sources import tables as T


def epoch_s():
    return F.unix_seconds("ts").alias("ts")


def inputs(f):
    """Features plus sentiment, book and derivative readings derived from the same bars."""
    rng = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    x = f.withColumns({
        "sent": clip(F.col("mom_4h") * 2), "n_docs": F.col("volume").cast("bigint") % 4,
        "imbalance": (2 * F.col("close") - F.col("high") - F.col("low")) / rng,
        "spread_bps": F.col("volume") % 20, "funding_rate": F.col("mom_1h") / 200,
        "oi_change_24h": F.col("mom_4h") / 3, "long_short_ratio": 1 + F.col("mom_4h") * 3,
        "taker_buy_ratio": 0.5 + F.col("mom_1h") / 4, "align": clip(F.col("macd_delta"))})
    return G.derivative_features(x)


def clp(x, lo=-1, hi=1):
    return f"greatest({lo}, least({hi}, {x}))"


POS = "((price - lo20) / CASE WHEN hi20 - lo20 <> 0 THEN hi20 - lo20 ELSE 1e-9 END)"
INPUTS = f""", inp0 AS (SELECT *, {clp('mom_4h * 2')} AS sent, CAST(volume AS BIGINT) % 4 AS n_docs,
  (2 * close - high - low) / CASE WHEN high > low THEN high - low ELSE 1 END AS imbalance, volume % 20 AS spread_bps,
  mom_1h / 200 AS funding_rate, mom_4h / 3 AS oi_change_24h, 1 + mom_4h * 3 AS long_short_ratio,
  0.5 + mom_1h / 4 AS taker_buy_ratio, {clp('macd_delta')} AS align FROM features),
inp AS (SELECT *, {clp('funding_rate / 0.0005')} AS funding_norm, {clp('oi_change_24h / 0.10')} AS oi_change_norm,
  {clp('(long_short_ratio - 1) / 1.2')} AS ls_crowding, {clp('(taker_buy_ratio - 0.5) * 8')} AS taker_aggression FROM inp0)
"""
SIDE = "CASE WHEN ema12 > ema26 THEN 1 ELSE -1 END"
SCORES = INPUTS + f""", sc0 AS (SELECT *, {SIDE} * 0.45 + {clp('macd_delta / (atr * 0.25 + 1e-9)')} * 0.3
   + {clp('mom_4h / 0.02')} * 0.25 + align * 0.2 AS t0,
  CASE WHEN rsi < 30 THEN (30 - rsi) / 30 WHEN rsi > 70 THEN -(rsi - 70) / 30 ELSE 0 END AS m0,
  {clp('sent * 1.6')} * 0.7 + {clp('mom_1h / 0.01')} * 0.3 AS n0 FROM inp),
sc AS (SELECT *, {clp(f'CASE WHEN {SIDE} * align < 0 THEN t0 * 0.6 ELSE t0 END')} AS s_trend,
  {clp("CASE WHEN trend <> 'sideways' THEN m0 * 0.5 ELSE m0 END * 1.4")} AS s_meanrev,
  CASE WHEN {POS} > 0.985 AND vol_ratio > 1.2 THEN {clp('0.6 + least(0.4, (vol_ratio - 1.2) * 0.4)')}
   WHEN {POS} < 0.015 AND vol_ratio > 1.2 THEN {clp('-0.6 - least(0.4, (vol_ratio - 1.2) * 0.4)')} ELSE 0 END AS s_breakout,
  {clp('CASE WHEN n_docs = 0 THEN n0 * 0.5 ELSE n0 END')} AS s_sentiment,
  {clp('imbalance * 2.2')} * CASE WHEN spread_bps > 8 THEN 0.4 ELSE 1 END AS s_microstructure,
  {clp(f'-0.35 * funding_norm + {SIDE} * greatest(0, oi_change_norm) * 0.30 - ls_crowding * 0.15 + taker_aggression * 0.20')} AS s_derivatives FROM sc0)
"""
NAMES = list(G.STRATEGIES)
SCOLS = [f"s_{n}" for n in NAMES]


def scored(spark, d):
    return G.score_strategies(inputs(I.regime_label(I.features(T.candles(spark, d)))))


@query("P22", FEAT + INPUTS + f"SELECT product, {EPOCH}, {rd('funding_norm', 'oi_change_norm', 'ls_crowding', 'taker_aggression')} FROM inp")
def derivative_features(spark, d):
    return out(inputs(I.features(T.candles(spark, d))), "funding_norm", "oi_change_norm", "ls_crowding", "taker_aggression")


@query("W30 X1", FEAT + SCORES + f"SELECT product, {EPOCH}, {rd(*SCOLS)} FROM sc")
def strategy_scores(spark, d):
    return out(scored(spark, d), *SCOLS)


WEIGHTS = {n: w for n, w in zip(NAMES, (0.25, 0.15, 0.2, 0.1, 0.2, 0.1))}
WSUM = " + ".join(f"CASE WHEN abs(s_{n}) > 0.05 THEN {w!r} ELSE 0 END" for n, w in WEIGHTS.items())
COMPOSITE = SCORES + f""", c0 AS (SELECT *, {' + '.join(f'CAST(abs({c}) > 0.05 AS INT)' for c in SCOLS)} AS n_active,
  {WSUM} AS wsum, {' + '.join(f'CASE WHEN abs(s_{n}) > 0.05 THEN {w!r} * s_{n} ELSE 0 END' for n, w in WEIGHTS.items())} AS num FROM sc),
c1 AS (SELECT *, CASE WHEN n_active > 0 THEN num / wsum ELSE 0 END AS composite FROM c0),
c2 AS (SELECT *, CASE WHEN n_active > 0 THEN ({' + '.join(f'CAST(abs({c}) > 0.05 AND {c} * composite > 0 AS INT)' for c in SCOLS)}) / n_active ELSE 0 END AS agreement FROM c1),
comp AS (SELECT *, least(1, abs(composite) * (0.4 + 0.6 * agreement) * (0.6 + 0.4 * least(1, n_active / 3))) AS confidence FROM c2)
"""


def voted(spark, d):
    return G.composite_vote(scored(spark, d), NAMES, WEIGHTS)


@query("A46", FEAT + COMPOSITE + f"SELECT product, {EPOCH}, CAST(n_active AS INT) AS n_active, {rd('composite', 'agreement', 'confidence')} FROM comp")
def composite_vote(spark, d):
    x = voted(spark, d)
    return x.select("product", epoch_s(), "n_active", *[r6(F.col(c)).alias(c) for c in ("composite", "agreement", "confidence")])


@query("A46 (weight boost and floor)", FEAT + SCORES + f""", w AS (SELECT *,
  {', '.join(f"CASE WHEN abs(s_{n}) > 0.05 THEN {WEIGHTS[n] * (2.5 if n == 'sentiment' else 1)!r} ELSE 0 END AS w_{n}" for n in NAMES)} FROM sc),
w2 AS (SELECT *, {' + '.join(f'w_{n}' for n in NAMES)} AS tot FROM w),
w3 AS (SELECT *, CASE WHEN abs(s_sentiment) > 0.05 AND w_sentiment < 0.4 * tot THEN 0.4 * (tot - w_sentiment) / 0.6 ELSE w_sentiment END AS ws FROM w2)
SELECT product, {EPOCH}, round(CASE WHEN tot > 0 THEN (ws * s_sentiment + {' + '.join(f'w_{n} * s_{n}' for n in NAMES if n != 'sentiment')})
  / CASE WHEN ws + tot - w_sentiment <> 0 THEN ws + tot - w_sentiment ELSE 1e-9 END ELSE 0 END, 6) AS composite FROM w3""")
def composite_vote_floor(spark, d):
    return out(G.composite_vote(scored(spark, d), NAMES, WEIGHTS, {"sentiment": 2.5}, ("sentiment", 0.4)), "composite")


@query("P17 K4", FEAT + COMPOSITE + f"""SELECT product, {EPOCH}, CASE WHEN composite > 0 THEN 1 ELSE -1 END AS direction,
  round(confidence, 6) AS confidence, round(composite * 25, 1) AS edge_bps,
  CAST(row_number() OVER (ORDER BY confidence DESC, product, ts) AS BIGINT) AS place
  FROM comp WHERE confidence >= 0.35""")
def ranked_candidates(spark, d):
    x = G.decide(voted(spark, d)).select("product", "ts", "direction", "confidence", "edge_bps", "actionable")
    x = G.ranked(x, "confidence", ["product", "ts"], where="actionable")
    return x.select("product", epoch_s(), "direction", r6(F.col("confidence")).alias("confidence"), r6(F.col("edge_bps")).alias("edge_bps"), "place")


@query("P17", FEAT + COMPOSITE + f"""SELECT product, {EPOCH}, CASE WHEN composite > 0 THEN 1 ELSE -1 END AS direction,
  confidence >= 0.35 AS actionable, confidence >= 0.2 AND confidence < 0.35 AS explorable,
  round(CASE WHEN composite > 0 THEN price - 2 * atr ELSE price + 2 * atr END, 6) AS stop FROM comp""")
def actionable_flags(spark, d):
    return G.decide(voted(spark, d)).select("product", epoch_s(), "direction", "actionable", "explorable", r6(F.col("stop")).alias("stop"))


@query("P9", FEAT + COMPOSITE + f"""SELECT product, {EPOCH}, NOT spread_bps > 12 AS spread_ok,
  NOT ((composite > 0 AND funding_rate > 0.0003) OR (composite <= 0 AND funding_rate < -0.0003)) AS funding_ok FROM comp""")
def entry_gates(spark, d):
    x = G.entry_gates(G.decide(voted(spark, d)), 12, 0.0003)
    return x.select("product", epoch_s(), "spread_ok", "funding_ok")


@query("P10", FEAT + f"""SELECT product, {EPOCH}, round(atr * 3, 6) AS take_dist, round((0.01 + 0.002) * 2.5 * price, 6) AS min_take_dist,
  CASE WHEN atr * 3 <= 0 THEN 'no volatility' WHEN atr * 3 < (0.01 + 0.002) * 2.5 * price THEN 'below cost' ELSE 'ok' END AS cost_reason FROM features""")
def cost_viability(spark, d):
    x = G.cost_viability(I.features(T.candles(spark, d)))
    return x.select("product", epoch_s(), r6(F.col("take_dist")).alias("take_dist"), r6(F.col("min_take_dist")).alias("min_take_dist"), "cost_reason")


@query("P11", FEAT + f", lq AS (SELECT product, ts, sum(volume) OVER {fr(288)} AS liq_volume, least(288, row_number() OVER {PW}) AS liq_bars FROM candles)"
       + COMPOSITE + f""", sz AS (SELECT *, CASE WHEN composite > 0 THEN 1 ELSE -1 END AS dir FROM comp JOIN lq USING (product, ts))
SELECT product, {EPOCH}, round(CASE WHEN ok THEN least(100000 * 0.0075 * (0.5 + confidence / 2) / (2 * atr / price), 20000,
  CASE WHEN liq_bars >= 12 THEN liq_volume * price * 0.01 END) ELSE 0 END, 4) AS notional,
  round(CASE WHEN ok THEN price - dir * 2 * atr ELSE 0 END, 6) AS stop, round(CASE WHEN ok THEN price + dir * 3 * atr ELSE 0 END, 6) AS take
FROM (SELECT *, atr > 0 AND 3 * atr >= 0.03 * price AS ok FROM sz)""")
def size_positions(spark, d):
    s = I.Series()
    bars = T.candles(spark, d).withColumns({"liq_volume": F.sum("volume").over(s.tail(288)),
                                            "liq_bars": F.least(F.lit(288), s.rownum())})
    x = inputs(I.regime_label(I.features(bars)))
    x = G.decide(G.composite_vote(G.score_strategies(x), NAMES, WEIGHTS)).drop("stop")
    x = G.size_positions(x, 100000.0, {})
    return x.select("product", epoch_s(), r6(F.col("notional"), 4).alias("notional"), r6(F.col("stop")).alias("stop"), r6(F.col("take")).alias("take"))


EVO = {"ema_fast": 12, "ema_slow": 26, "rsi_buy": 38, "rsi_sell": 62, "mom_w": 0.7, "short_w": 0.9}


@query("P16", FEAT + f"""SELECT product, {EPOCH}, round({clp(f'''CASE WHEN ema12 > ema26 THEN
  (0.35 + CASE WHEN {POS} > 0.97 THEN 0.4 ELSE 0 END + CASE WHEN rsi < 38 THEN 0.35 ELSE 0 END) * CASE WHEN mom_1h <= 0 THEN 0.4 ELSE 1 END
  ELSE (CASE WHEN {POS} < 0.03 THEN -0.4 ELSE 0 END + CASE WHEN rsi > 62 THEN -0.35 ELSE 0 END + CASE WHEN ema12 < ema26 THEN -0.35 ELSE 0 END)
   * CASE WHEN mom_1h >= 0 THEN 0.4 ELSE 1 END END''')}, 6) AS vote FROM features""")
def evolved_vote(spark, d):
    return out(G.evolved_vote(I.features(T.candles(spark, d)), EVO), "vote")


DERIVED = f""", dv AS (SELECT *, {clp(POS, 0, 1)} AS pos20, {clp('macd_delta / CASE WHEN atr <> 0 THEN atr ELSE 1e-9 END', -5, 5)} AS macd_norm,
  {SIDE} AS ema_cross FROM features)
"""


@query("P23", FEAT + DERIVED + f"SELECT product, {EPOCH}, {rd('pos20', 'macd_norm', 'ema_cross')} FROM dv")
def rule_features(spark, d):
    return out(G.derive_rule_features(I.features(T.candles(spark, d))), "pos20", "macd_norm", "ema_cross")


VX = ("rsi / 100 - 0.5", clp("macd / atr", -3, 3), clp("macd_delta / (0.25 * atr + 1e-9)", -3, 3), clp("mom_1h * 100", -3, 3),
      clp("mom_4h * 50", -3, 3), clp("vol_ratio - 1", -2, 2), clp("imbalance"), "least(2, spread_bps / 10)", clp("sent"), "0",
      clp("(price / sma20 - 1) * 100", -3, 3), clp("(sma20 / sma50 - 1) * 100", -3, 3), "least(3, volatility * 300)",
      "funding_norm", "oi_change_norm", "ls_crowding", "taker_aggression", "align")


@query("P24", CHART + FEATURES + INPUTS + f""", v AS (SELECT inp.product, inp.ts, {', '.join(f'{x} AS x{i}' for i, x in enumerate(VX))},
  {', '.join(f'{c} AS x{18 + i}' for i, c in enumerate(PT.LEAN_WEIGHTS))}, 0 AS x24, 0 AS x25 FROM inp JOIN pat USING (product, ts))
SELECT product, {EPOCH}, 26 AS width, {', '.join(f'round(x{i}, 6) AS x{i}' for i in range(26))} FROM v""")
def ml_vector(spark, d):
    x = inputs(I.features(PT.detect(T.candles(spark, d)).drop("rn")))
    v = G.ml_vector(x)
    return v.select("product", epoch_s(), F.size("x").alias("width"), *[r6(F.col("x")[i]).alias(f"x{i}") for i in range(26)])


RULES = [
    {"rule_id": "dip", "long": [{"feat": "rsi", "op": "<", "thr": 45.0}, {"feat": "ema_cross", "op": ">", "thr": 0.0}],
     "short": [{"feat": "rsi", "op": ">", "thr": 55.0}, {"feat": "ema_cross", "op": "<", "thr": 0.0}], "conf": 0.6},
    {"rule_id": "break", "long": [{"feat": "pos20", "op": ">", "thr": 0.6}], "short": [{"feat": "pos20", "op": "<", "thr": 0.4}], "conf": 0.8},
    {"rule_id": "mom", "long": [{"feat": "mom_1h", "op": ">", "thr": 0.01}, {"feat": "vol_ratio", "op": ">", "thr": 0.9},
                                {"feat": "macd_norm", "op": ">", "thr": -0.5}], "short": [], "conf": 0.5}]


def rule_sql():
    def side(cl):
        return " AND ".join(f"{c['feat']} {c['op']} {c['thr']}" for c in cl) or "false"
    return " UNION ALL ".join(f"SELECT '{r['rule_id']}' AS rule_id, product, ts, rn, close, CASE WHEN {side(r['long'])} THEN {r['conf']} "
                              f"WHEN {side(r['short'])} THEN -{r['conf']} ELSE 0 END AS vote FROM dv" for r in RULES)


def rule_votes(spark, d):
    x = G.derive_rule_features(I.features(T.candles(spark, d)))
    return R.rule_vote(R.with_rules(x, RULES)).withColumn("rule_id", F.col("rule.rule_id"))


@query("P13 X7", FEAT + DERIVED + f", rv AS ({rule_sql()}) SELECT rule_id, product, {EPOCH}, round(vote, 6) AS vote FROM rv")
def rule_vote(spark, d):
    return out(rule_votes(spark, d), "vote", keys=("rule_id", "product"))


def rules_from_events(spark, d):
    """One candidate rule per event, many of them malformed."""
    k = T.k_of()
    e = T.load(spark, d, "events").withColumn("k", k)
    feats = F.array(*[F.lit(x) for x in (*R.RULE_FEATURES, "unknown")])

    def clause(shift):
        return F.struct(F.get(feats, ((F.col("user_id") + shift) % 8).cast("int")).alias("feat"),
                        F.when(F.col("k") % 7 == shift, "=").when((F.col("k") + shift) % 2 == 0, ">").otherwise("<").alias("op"),
                        F.when(F.col("k") % 11 != shift, F.floor("value") / 10).alias("thr"))

    n = F.col("k") % 5
    cl = F.slice(F.array(*[clause(i) for i in range(4)]), 1, n.cast("int"))
    return e.select(F.col("event_id").alias("rule_id"), cl.cast(R.CLAUSE).alias("long"),
                    F.when(F.col("k") % 3 == 0, F.slice(cl, 1, 1)).cast(R.CLAUSE).alias("short"),
                    (F.col("k") % 6 / 4.0).alias("conf"))


def ev_clause(i):
    return (f"{{'feat': ['rsi','pos20','mom_1h','mom_4h','macd_norm','vol_ratio','ema_cross','unknown'][(user_id + {i}) % 8 + 1],"
            f" 'op': CASE WHEN k % 7 = {i} THEN '=' WHEN (k + {i}) % 2 = 0 THEN '>' ELSE '<' END,"
            f" 'thr': CASE WHEN k % 11 <> {i} THEN floor(value) / 10 END}}")


RULES_SQL = f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
r0 AS (SELECT event_id AS rule_id, [{', '.join(ev_clause(i) for i in range(4))}][1:k % 5] AS long, k, k % 6 / 4.0 AS conf FROM e),
r1 AS (SELECT rule_id, long, CASE WHEN k % 3 = 0 THEN long[1:1] ELSE [] END AS short, conf FROM r0),
bad AS (SELECT rule_id, bool_or(c.op = '=' OR c.feat = 'unknown' OR c.thr IS NULL) AS bad FROM
  (SELECT rule_id, unnest(long || short) AS c FROM r1) GROUP BY rule_id),
ok AS (SELECT r1.* FROM r1 JOIN bad USING (rule_id) WHERE NOT bad AND conf > 0 AND conf <= 1 AND len(long) <= 3)
"""


@query("P14", RULES_SQL + "SELECT rule_id, len(long) AS n_long, len(short) AS n_short, round(conf, 6) AS conf FROM ok")
def validate_rules(spark, d):
    x = R.validate_rules(rules_from_events(spark, d))
    return x.select("rule_id", F.size("long").cast("bigint").alias("n_long"),
                    F.size(F.coalesce("short", F.array().cast(R.CLAUSE))).cast("bigint").alias("n_short"), r6(F.col("conf")).alias("conf"))


CLKEY = "array_to_string(list_sort(list_transform({s}, lambda c: c.feat || '|' || c.op || '|' || printf('%.4f', c.thr))), ';')"


@query("U4 F13", RULES_SQL + f""", kx AS (SELECT rule_id, 'disc_' || substring(sha1({CLKEY.format(s='long')} || '#' ||
  {CLKEY.format(s='short')} || '#' || printf('%.3f', conf)), 1, 10) AS canonical_id FROM ok)
SELECT canonical_id, min(rule_id) AS rule_id FROM kx GROUP BY 1""")
def dedupe_rules(spark, d):
    return R.dedupe_rules(R.validate_rules(rules_from_events(spark, d))).select("canonical_id", "rule_id")


BT = DERIVED + f""", rv AS ({rule_sql()}), bt0 AS (SELECT *, sign(vote) AS pos,
  lead(close) OVER (PARTITION BY rule_id, product ORDER BY ts) AS nx FROM rv),
bt1 AS (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY rule_id, product ORDER BY ts), 0)) AS turn FROM bt0),
bt AS (SELECT *, pos * (nx / close - 1) - turn * 6e-4 AS ret, CAST(turn > 0 AND pos <> 0 AS INT) AS entry FROM bt1 WHERE nx IS NOT NULL)
"""


def backtest(spark, d):
    return R.rule_backtest(rule_votes(spark, d))


@query("W31", FEAT + BT + f"SELECT rule_id, product, {EPOCH}, round(ret, 8) AS ret, entry FROM bt")
def rule_backtest(spark, d):
    return backtest(spark, d).select("rule_id", "product", epoch_s(), r6(F.col("ret"), 8).alias("ret"), "entry")


FOLDS = BT + f""", fi AS (SELECT *, row_number() OVER (PARTITION BY rule_id, product ORDER BY ts) - 1 AS i,
  count(*) OVER (PARTITION BY rule_id, product) AS n FROM bt),
ff AS (SELECT *, n // 5 AS step, unnest([1, 2, 3, 4]) AS fold FROM fi),
fg AS (SELECT *, step * fold AS te, CASE WHEN fold < 4 THEN step * (fold + 1) ELSE n END AS stop FROM ff),
folds AS (SELECT *, CASE WHEN i < te THEN 'train' WHEN i >= te + 24 AND i < stop THEN 'test' END AS role FROM fg WHERE te + 24 < stop)
"""


@query("W32", FEAT + FOLDS + """SELECT rule_id, product, fold, role, count(*) AS n, round(avg(ret), 8) AS mean_ret
FROM folds WHERE role IS NOT NULL GROUP BY ALL""")
def walk_forward_folds(spark, d):
    x = R.fold_roles(backtest(spark, d), 4, 24, ("rule_id", "product"))
    return x.groupBy("rule_id", "product", "fold", "role").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ret"), 8).alias("mean_ret"))


PARAMS = [dict(ema_fast=8, ema_slow=21, breakout_n=20, rsi_buy=40, rsi_sell=60, mom_w=0.9, short_w=0.9, htf_w=0.9, htf_n=48,
               volz_w=0.0, vol_max=1.2, er_min=0.0, er_n=48),
          dict(ema_fast=12, ema_slow=26, breakout_n=10, rsi_buy=45, rsi_sell=55, mom_w=0.0, short_w=0.9, htf_w=0.0, htf_n=48,
               volz_w=0.9, vol_max=1.1, er_min=0.05, er_n=24),
          dict(ema_fast=5, ema_slow=34, breakout_n=30, rsi_buy=35, rsi_sell=70, mom_w=0.0, short_w=0.0, htf_w=0.0, htf_n=72,
               volz_w=0.0, vol_max=1.5, er_min=0.0, er_n=48)]


def param_sql(i, p):
    def em(n):
        return f"s{n}.v"
    t = "true"
    gate = " AND ".join([f"vn <= {p['vol_max']}" if p["volz_w"] > 0.5 else t, f"er{p['er_n']} >= {p['er_min']}" if p["er_min"] > 0 else t, "atr > 0"])
    mom = p["mom_w"] > 0.5
    joins = "".join(f" JOIN s{n} USING (product, rn)" for n in sorted({p["ema_fast"], p["ema_slow"]} | ({p["htf_n"]} if p["htf_w"] > 0.5 else set())))
    up = f"{em(p['ema_fast'])} > {em(p['ema_slow'])}"
    h = em(p["htf_n"]) if p["htf_w"] > 0.5 else None
    lo = f"{up} AND (close >= up{p['breakout_n']} OR rsi < {p['rsi_buy']}) AND {'close > c12' if mom else t} AND {f'close > {h}' if h else t} AND {gate}"
    sh = (f"{'true' if p['short_w'] > 0.5 else 'false'} AND NOT ({up}) AND (close <= dn{p['breakout_n']} OR rsi > {p['rsi_sell']}) AND "
          f"{'close < c12' if mom else t} AND {f'close < {h}' if h else t} AND {gate}")
    return f"SELECT {i} AS set_id, product, ts, coalesce({lo}, false) AS enter_long, coalesce({sh}, false) AS enter_short FROM base{joins} WHERE rn >= 60"


P15 = RCANDLES + "".join(ema_rec(n) for n in (5, 8, 12, 21, 26, 34, 48)) + ATRS + f""", vm AS (SELECT *, quantile_cont(atr, 0.5) OVER {fr(72, -1)} AS med,
  abs(close - lag(close) OVER {PW}) AS stp FROM a3),
base AS (SELECT *, CASE WHEN rn > 72 AND med > 0 THEN atr / med ELSE 1 END AS vn, lag(close, 12) OVER {PW} AS c12,
  {', '.join(f'max(high) OVER {fr(n, -1)} AS up{n}, min(low) OVER {fr(n, -1)} AS dn{n}' for n in (10, 20, 30))},
  CASE WHEN sum(stp) OVER {fr(24)} > 0 THEN abs(close - lag(close, 24) OVER {PW}) / sum(stp) OVER {fr(24)} ELSE 0 END AS er24 FROM vm),
pe AS ({' UNION ALL '.join(param_sql(i, p) for i, p in enumerate(PARAMS))})
"""


@query("P15 W11 W13 W37", P15 + f"SELECT set_id, product, {EPOCH}, enter_long, enter_short FROM pe")
def param_rule_entries(spark, d):
    x = R.param_entries(T.candles(spark, d), PARAMS)
    return x.select("set_id", "product", epoch_s(), F.coalesce("enter_long", F.lit(False)).alias("enter_long"),
                    F.coalesce("enter_short", F.lit(False)).alias("enter_short"))


@query("P21", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(p * 20 + 0.5) AS BIGINT) * 5 / 100 AS venue_price,
  CAST(q * 100000000 AS BIGINT) // 30000000 * 3 / 10 AS venue_qty, q * p >= 20000 AS min_notional_ok FROM (SELECT *,
  CAST(l_extendedprice / l_quantity AS DECIMAL(20, 8)) AS p, CAST(l_quantity * 1.01 AS DECIMAL(20, 8)) AS q FROM lineitem)""")
def round_to_venue(spark, d):
    li = T.load(spark, d, "lineitem").withColumns({
        "product": F.concat(F.lit("P"), F.col("l_suppkey") % 20), "price": F.col("l_extendedprice") / F.col("l_quantity"),
        "qty": F.col("l_quantity") * 1.01})
    x = G.round_to_venue(li, {}, default=("0.05", "0.3", "20000"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "venue_price", "venue_qty", "min_notional_ok")


@query("P27", FEAT + """SELECT side_trend, pnl_bucket, model_view, vol_state AS vol, count(*) AS n FROM (SELECT *,
  CASE WHEN trend = 'sideways' THEN 'neutral' WHEN (trend = 'bull') = (rsi > 50) THEN 'with' ELSE 'against' END AS side_trend,
  CASE WHEN mom_1h >= 0 THEN 'win' WHEN mom_1h > -greatest(atr / price, 0.002) THEN 'small_loss' ELSE 'big_loss' END AS pnl_bucket,
  CASE WHEN macd_delta > 0.05 THEN 'fav' WHEN macd_delta < -0.05 THEN 'adv' ELSE 'flat' END AS model_view FROM features) GROUP BY ALL""")
def position_state(spark, d):
    f = I.regime_label(I.features(T.candles(spark, d)))
    st = G.position_state(F.when(F.col("rsi") > 50, 1).otherwise(-1), F.col("mom_1h"), F.col("macd_delta"),
                          F.col("trend"), F.col("vol_state"), F.col("atr") / F.col("price"))
    return f.select(st.alias("s")).groupBy("s.side_trend", "s.pnl_bucket", "s.model_view", "s.vol").agg(F.count(F.lit(1)).alias("n"))
