"""Reader, ledger-table, cross-section and diagnosis queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketlab import schemas
from marketlab.functions.mathx import r6
from marketlab.operators import context as C
from marketlab.operators import indicators as I
from marketlab.operators import patterns as PT
from marketlab.operators import signals as SG
from marketlab.operators.joins import asof
from marketlab.operators.scans import shared_folder
from marketlab.plans.decision import COMPOSITE, voted
from marketlab.plans.price import CANDLES, FEAT, fr
from marketlab.plans.registry import query
from marketlab.plans.timejoins import LABELS, labels
from marketlab.plans.views import K, with_views
from marketlab.sources import ledger_io as IO
from marketlab.sources import readers as RD
from marketlab.sources import tables as T


def ev(spark, d):
    return T.load(spark, d, "events").withColumn("k", T.k_of())


@query("S2", f"""SELECT event_id, event_type AS product, round(100 + value, 6) AS price, round(99.5 + value, 6) AS bid, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM (SELECT *, {K} AS k FROM events) WHERE k % 4 <> 0 AND k % 5 <> 0""")
def read_ticks(spark, d):
    k = F.col("k")
    msg = F.to_json(F.struct(F.when(k % 4 == 0, "heartbeat").otherwise("ticker").alias("type"), F.col("event_type").alias("product_id"),
                             F.when(k % 5 == 0, "").otherwise((100 + F.col("value")).cast("string")).alias("price"), (99.5 + F.col("value")).cast("string").alias("best_bid"),
                             F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time")))
    x = RD.parse_ticks(ev(spark, d).select("event_id", msg.alias("value")))
    return x.select("event_id", "product", r6(F.col("price")).alias("price"), r6(F.col("bid")).alias("bid"), F.unix_seconds("ts").alias("ts"))


@query("S3", f"""WITH e AS (SELECT *, {K} AS k FROM events), l AS (SELECT event_id, value, k, unnest(range(1, 31)) AS i FROM e), s AS (SELECT event_id, sum((100 + value - i * 0.05) * (1 + (k * i) % 7)) FILTER (WHERE i <= 25) AS b, sum((100 + value + i * 0.05) * (1 + (k + i) % 5)) FILTER (WHERE i <= 25) AS a, any_value(value) AS v FROM l GROUP BY 1)
SELECT event_id, round(b, 4) AS bid_depth, round(a, 4) AS ask_depth, round((b - a) / (b + a), 6) AS imbalance, round(100 + v, 6) AS mid, round(0.1 / (100 + v) * 1e4, 6) AS spread_bps FROM s""")
def book_stats(spark, d):
    i = F.sequence(F.lit(1), F.lit(30))
    e = ev(spark, d)
    b = e.select("event_id", F.transform(i, lambda j: F.struct((100 + F.col("value") - j * 0.05).alias("price"), (1 + (F.col("k") * j) % 7).cast("double").alias("size"))).alias("bids"),
                 F.transform(i, lambda j: F.struct((100 + F.col("value") + j * 0.05).alias("price"), (1 + (F.col("k") + j) % 5).cast("double").alias("size"))).alias("asks"))
    x = RD.book_stats(b)
    return x.select("event_id", *[r6(F.col(c), 4 if "depth" in c else 6).alias(c) for c in ("bid_depth", "ask_depth", "imbalance", "mid", "spread_bps")])


@query("S4", CANDLES + """, r AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY ts DESC) AS r FROM candles), g AS (SELECT product, max(CASE WHEN r = 1 THEN volume END) AS now, max(CASE WHEN r = 25 THEN volume END) AS thn, max(CASE WHEN r = 1 THEN high / low END) AS ls,
  sum(CASE WHEN r <= 4 THEN high END) AS b, sum(CASE WHEN r <= 4 THEN low END) AS s FROM r WHERE r <= 25 GROUP BY 1) SELECT product, round(now, 6) AS oi_usd, round(now / thn - 1, 6) AS oi_change_24h, round(ls, 6) AS long_short_ratio, round(b / (b + s), 6) AS taker_buy_ratio FROM g""")
def read_derivatives(spark, d):
    h = T.candles(spark, d).select("product", "ts", F.col("volume").alias("oi"), (F.col("high") / F.col("low")).alias("long_short"), F.col("high").alias("buy"), F.col("low").alias("sell"))
    x = RD.derivatives(h)
    return x.select("product", *[r6(F.col(c)).alias(c) for c in x.columns[1:]])


@query("S6", f"SELECT event_id, 'src' || (user_id % 7) AS source, upper(event_type) AS asset, round(value, 6) AS value FROM (SELECT *, {K} AS k FROM events) WHERE k % 10 <> 3")
def read_signal_rows(spark, d):
    good = F.to_json(F.struct(F.concat(F.lit("src"), F.col("user_id") % 7).alias("source"), F.upper("event_type").alias("asset"), F.col("value")))
    line = F.when(F.col("k") % 10 == 3, F.substring(good, 1, 9)).otherwise(good)
    x = RD.parse_json_lines(ev(spark, d).select("event_id", line.alias("line")), "line", schemas.SIGNAL_ROW, "asset")
    return x.select("event_id", "source", "asset", r6(F.col("value")).alias("value"))


@query("S7", """SELECT asset, direction, count(*) AS n, round(sum(notional), 2) AS notional, max(rank) AS max_rank FROM (SELECT 'A' || (o_orderkey % 8) AS asset, CASE o_orderstatus WHEN 'F' THEN -1 WHEN 'O' THEN 1 ELSE 0 END AS direction, o_totalprice AS notional,
  CASE WHEN o_custkey % 5 = 0 THEN 9999 ELSE 1 + o_custkey % 10 END AS rank FROM orders) GROUP BY 1, 2""")
def read_snapshots(spark, d):
    o = T.load(spark, d, "orders")
    pos = F.struct(F.concat(F.lit("a"), F.col("o_orderkey") % 8).alias("asset"), F.when(F.col("o_orderstatus") == "F", -1).when(F.col("o_orderstatus") == "O", 1).alias("direction"), F.col("o_totalprice").alias("notional"))
    tr = F.struct(F.col("o_custkey").cast("string").alias("id"), F.when(F.col("o_custkey") % 5 != 0, 1 + F.col("o_custkey") % 10).alias("rank"), F.array(pos).alias("positions"))
    snap = F.to_json(F.struct(F.unix_seconds("o_orderdate").alias("ts"), F.array(tr).alias("traders")))
    body = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"snapshots": ['), snap, F.lit("]}"))).otherwise(F.concat(F.lit("["), snap, F.lit("]")))
    x = RD.explode_snapshots(o.select(body.alias("value")), "value")
    return x.groupBy("asset", "direction").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("notional"), 2).alias("notional"), F.max("rank").alias("max_rank"))


@query("S8 F12", f"""SELECT condition_id, category, p0, p1, round(spread, 6) AS spread, tick_size FROM (SELECT 'm' || event_id AS condition_id, event_type AS category, CASE WHEN k % 6 = 1 THEN 0.5 ELSE round((k + 1) / 101, 6) END AS p0, CASE WHEN k % 6 = 1 THEN 0.5 ELSE round(1 - (k + 1) / 101, 6) END AS p1,
  CASE WHEN k % 4 = 0 THEN 0 ELSE value / 1000 END AS spread, 0.01 AS tick_size, k FROM (SELECT *, {K} AS k FROM events)) WHERE k % 9 <> 0""")
def read_markets(spark, d):
    k = F.col("k")
    p = (k + 1) / 101
    raw = ev(spark, d).select(
        F.concat(F.lit("m"), "event_id").alias("conditionId"), F.lit("q").alias("question"), F.concat("event_type", F.lit("-2026-x")).alias("slug"),
        F.when(k % 9 == 0, '["A","B","C"]').otherwise('["Yes","No"]').alias("outcomes"), F.lit('["1","2"]').alias("clobTokenIds"),
        F.when(k % 6 == 1, '["x","NaN"]').otherwise(F.to_json(F.array(p.cast("string"), (1 - p).cast("string")))).alias("outcomePrices"),
        F.when(k % 4 != 0, (F.col("value") / 1000).cast("string")).alias("spread"), F.lit("0").alias("orderPriceMinTickSize"), F.lit(True).alias("active"),
        *[F.lit(None).cast("string").alias(c) for c in ("bestBid", "bestAsk", "lastTradePrice", "liquidity", "volume24hr", "orderMinSize", "oneHourPriceChange", "oneDayPriceChange", "endDate")],
        *[F.lit(None).cast("boolean").alias(c) for c in ("closed", "acceptingOrders")])
    x = RD.normalize_markets(raw)
    return x.select("condition_id", "category", r6(F.col("prices")[0]).alias("p0"), r6(F.col("prices")[1]).alias("p1"), r6(F.col("spread")).alias("spread"), "tick_size")


@query("S9", f"""SELECT title, ts, title LIKE 'FOMC%' AS is_fomc FROM (SELECT DISTINCT CASE WHEN k % 7 = 0 THEN 'FOMC statement' ELSE 'CPI ' || event_type END AS title, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS ts FROM (SELECT *, {K} AS k FROM events) WHERE k % 3 = 0 AND user_id % 2 = 0)""")
def read_calendar(spark, d):
    k = F.col("k")
    local = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 3600) * 3600 - 4 * 3600)
    rows = ev(spark, d).select(F.when(k % 7 == 0, "FOMC statement").otherwise(F.concat(F.lit("CPI "), "event_type")).alias("title"), F.when(F.col("user_id") % 2 == 0, "USD").otherwise("EUR").alias("country"),
                               F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-04:00")).alias("date"), F.when(k % 3 == 0, "High").otherwise("Low").alias("impact"))
    return RD.read_calendar(rows).select("title", F.unix_seconds("ts").alias("ts"), "is_fomc")


@query("P3 X2 F11", f"""SELECT event_id, upper(event_type) AS asset, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS direction, round(value, 6) AS notional, round(CASE WHEN k % 3 = 0 THEN 1.0 ELSE k END, 6) AS leverage FROM (SELECT *, {K} AS k FROM events) WHERE value > 0 AND k % 13 <> 0""")
def map_fields(spark, d):
    k = F.col("k")
    raw = F.to_json(F.struct(F.struct(F.when(k % 13 != 0, F.col("event_type")).alias("coin"), (k % 2 == 0).alias("directionLong"), F.col("value").alias("size"), F.when(k % 3 != 0, k).alias("lev")).alias("update")))
    x = RD.map_fields(ev(spark, d).select("event_id", raw.alias("j")), "j", {"asset": "update.coin", "side": "update.directionLong", "size": "update.size", "leverage": "update.lev", "score": "pnl"}, "true")
    return x.select("event_id", "asset", "direction", r6(F.col("notional")).alias("notional"), r6(F.col("leverage")).alias("leverage"))


FQ = with_views("forecasts")
BK = "CASE WHEN ttl_hours <= 24 THEN 'near' ELSE 'far' END"


@query("S12", FQ + f""", f AS (SELECT id, condition_id, {BK} AS bucket, round(predicted_p0, 6) AS p FROM forecasts), ex AS (SELECT DISTINCT condition_id, bucket FROM f WHERE id % 97 = 0), nw AS (SELECT * FROM f WHERE id % 97 <> 0)
SELECT condition_id, bucket, id, p FROM nw WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.condition_id = nw.condition_id AND ex.bucket = nw.bucket) QUALIFY row_number() OVER (PARTITION BY condition_id, bucket ORDER BY id) = 1""")
def insert_or_ignore(spark, d):
    f = T.forecasts(spark, d).select("id", "condition_id", F.when(F.col("ttl_hours") <= 24, "near").otherwise("far").alias("bucket"), r6(F.col("predicted_p0")).alias("p"))
    return IO.insert_or_ignore(f.where("id % 97 = 0"), f.where("id % 97 <> 0"), ["condition_id", "bucket"], ["id"])


@query("S13", LABELS + """, t AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0.5 END AS fwd, CAST(event_id % 2 = 0 AS INT) AS scored FROM signal_scores), u AS (SELECT event_id, raw, state FROM lab WHERE state <> 'retry')
SELECT t.event_id, round(CASE WHEN scored = 0 THEN raw ELSE fwd END, 6) AS fwd_return, CAST(CASE WHEN u.event_id IS NOT NULL THEN 1 ELSE scored END AS INT) AS scored FROM t LEFT JOIN u USING (event_id)""")
def label_once(spark, d):
    even = F.col("event_id") % 2 == 0
    t = T.signal_scores(spark, d).select("event_id", F.when(even, 0.5).alias("fwd_return"), even.cast("int").alias("scored"))
    u = labels(spark, d).where("state <> 'retry'").select("event_id", F.col("fwd_return_raw").alias("fwd_return"))
    return IO.label_once(t, u, "event_id", ["fwd_return"]).withColumn("fwd_return", r6(F.col("fwd_return")))


@query("S16", "SELECT event_id FROM events, (SELECT max(ts) AS now FROM events) WHERE epoch_us(ts) >= epoch_us(now) - 14 * 86400000000")
def prune_retention(spark, d):
    e = ev(spark, d)
    x = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return IO.prune(x, "ts", F.col("now"), 14 * 86400).select("event_id")


@query("A53 S10", """SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'signals_scored', count(*) FROM events WHERE event_id % 2 = 0""")
def table_counts(spark, d):
    e = T.load(spark, d, "events")
    return IO.table_counts({"orders": T.load(spark, d, "orders"), "lineitem": T.load(spark, d, "lineitem"), "events": e, "signals_scored": e.where("event_id % 2 = 0")})


DQ = with_views("decisions")


@query("K1", "SELECT event_id, round(value, 6) AS value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_rows(spark, d):
    return IO.recent(T.load(spark, d, "events"), ["ts", "event_id"], 100).select("event_id", r6(F.col("value")).alias("value"))


@query("K8", "SELECT event_id, round(value, 6) AS value FROM events WHERE event_id > 1234 ORDER BY event_id LIMIT 1000")
def paged_scan(spark, d):
    return IO.page(T.load(spark, d, "events"), "event_id", 1234, 1000).select("event_id", r6(F.col("value")).alias("value"))


@query("P4", DQ + "SELECT event_id, round(composite, 6) AS composite FROM decisions WHERE product = 'click' AND action = 'enter' ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_decisions(spark, d):
    return IO.recent_decisions(T.decisions(spark, d), 100, "click", "enter").select("event_id", r6(F.col("composite")).alias("composite"))


@query("P5", with_views("signal_scores") + "SELECT event_id, strategy FROM signal_scores, (SELECT max(ts) AS now FROM events) WHERE event_id % 2 = 1 AND ts <= now - INTERVAL 2 HOUR")
def matured_unscored(spark, d):
    x = T.signal_scores(spark, d).withColumn("scored", F.when(F.col("event_id") % 2 == 1, 0).otherwise(1))
    now = T.load(spark, d, "events").agg(F.max("ts").alias("now"))
    return IO.matured_unscored(x.crossJoin(F.broadcast(now)), F.col("now") - F.expr("interval 2 hours")).select("event_id", "strategy")


@query("J14", FEAT + f""", nf AS (SELECT product, price, rsi, regime FROM features QUALIFY row_number() OVER (PARTITION BY product ORDER BY ts DESC) = 1), dv AS (SELECT event_type AS product, avg(value) AS sentiment, count(*) AS n_docs FROM events WHERE value > 50 AND event_type <> 'error' GROUP BY 1)
SELECT p.product, round(price, 6) AS price, round(rsi, 6) AS rsi, regime, round(sentiment, 6) AS sentiment, n_docs, p.product < 'm' AS in_core FROM (SELECT DISTINCT event_type AS product FROM events) p LEFT JOIN nf USING (product) LEFT JOIN dv USING (product)""")
def product_cross_section(spark, d):
    e = T.load(spark, d, "events")
    f = I.regime_label(I.features(T.candles(spark, d)))
    f = f.groupBy("product").agg(F.max_by(F.struct("price", "rsi", "regime"), "ts").alias("f")).select("product", "f.*")
    s = e.where("value > 50 and event_type <> 'error'").groupBy(F.col("event_type").alias("product")).agg(F.avg("value").alias("sentiment"), F.count(F.lit(1)).alias("n_docs"))
    x = C.cross_section(e.select(F.col("event_type").alias("product")).distinct(), {"features": f, "mood": s})
    return x.select("product", r6(F.col("features.price")).alias("price"), r6(F.col("features.rsi")).alias("rsi"), "features.regime", r6(F.col("mood.sentiment")).alias("sentiment"), "mood.n_docs", (F.col("product") < "m").alias("in_core"))


@query("J21")
def context_rows(spark, d):
    p = PT.detect(T.candles(spark, d))
    last = p.groupBy("product").agg(F.max_by(F.struct("close", "pat_lean", "structure", "detected"), "ts").alias("p")).select("product", "p.*")
    sig = T.signal_scores(spark, d).groupBy("product").agg(F.avg(F.col("direction") * F.col("confidence")).alias("signal"))
    top = T.decisions(spark, d).withColumn("r", F.row_number().over(I.W.partitionBy("product").orderBy(F.desc("ts"), F.desc("event_id")))).where("r <= 3")
    texts = top.groupBy("product").agg(F.array_sort(F.collect_list(F.concat("action", F.lit(" "), "event_id"))).alias("texts"))
    return C.context_rows(last.join(sig, "product", "left").join(texts, "product", "left"))


@query("A61 P8 P9 P10 J5", FEAT + COMPOSITE + f""", md AS (SELECT product, ts, quantile_cont(close, 0.5) OVER {fr(60)} AS med FROM candles), g AS (SELECT c.*, med FROM comp c JOIN md USING (product, ts)),
z AS (SELECT CASE WHEN price < 101 THEN 'price below minimum' WHEN price > med * 1.3 THEN 'price spiked' WHEN price < med / 1.3 THEN 'price collapsed' WHEN spread_bps > 15 THEN 'spread too wide'
  WHEN (composite > 0 AND funding_rate > 0.0008) OR (composite <= 0 AND funding_rate < -0.0008) THEN 'funding extreme' WHEN atr * 3 < 0.03 * price THEN 'cost viability' WHEN confidence < 0.35 THEN 'low confidence' ELSE 'ok' END AS blocked_by, product FROM g)
SELECT product, blocked_by, count(*) AS n FROM z GROUP BY 1, 2""")
def entry_diagnosis(spark, d):
    med = I.price_sane(T.candles(spark, d), 101, 1.3).select("product", "ts", "sanity")
    x = SG.cost_viability(SG.entry_gates(SG.decide(voted(spark, d)), 15)).join(med, ["product", "ts"])
    x = C.entry_diagnosis(x, [("price below minimum", F.col("sanity") == "below minimum"), ("price spiked", F.col("sanity") == "spiked"), ("price collapsed", F.col("sanity") == "collapsed"),
                              ("spread too wide", ~F.col("spread_ok")), ("funding extreme", ~F.col("funding_ok")), ("cost viability", F.col("cost_reason") != "ok"), ("low confidence", F.col("confidence") < 0.35)])
    return x.groupBy("product", "blocked_by").agg(F.count(F.lit(1)).alias("n"))


@query("J7", with_views("trades") + """, h AS (SELECT 'P' || CAST(s_suppkey % 20 AS VARCHAR) AS product, sum(s_acctbal) / 1000 AS heat FROM supplier GROUP BY 1), m AS (SELECT product, 1 + 0.5 * greatest(-1, least(1, sum(pnl) / sum(qty * entry) / 0.05)) AS mult FROM trades GROUP BY 1)
SELECT product, round(heat, 6) AS heat, round(heat * mult, 6) AS eff_heat FROM h JOIN m USING (product)""")
def performance_heat(spark, d):
    h = T.load(spark, d, "supplier").groupBy(F.concat(F.lit("P"), F.col("s_suppkey") % 20).alias("product")).agg((F.sum("s_acctbal") / 1000).alias("heat"))
    t = T.trades(spark, d).groupBy("product").agg((F.sum("pnl") / F.sum(F.col("qty") * F.col("entry"))).alias("r"))
    # both sides are aggregates to one row per product; AQE broadcasts the smaller one when its measured size allows
    x = h.join(t, "product").withColumn("mult", 1 + 0.5 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r") / 0.05)))
    return x.select("product", r6(F.col("heat")).alias("heat"), r6(F.col("heat") * F.col("mult")).alias("eff_heat"))




@query("S11 S10", DQ + "SELECT 'events' AS table_name, count(*) AS n, count(DISTINCT date_trunc('day', ts)) AS days FROM events UNION ALL SELECT 'decisions', count(*), count(DISTINCT date_trunc('day', ts)) FROM decisions")
def append_events(spark, d):
    root = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    e = T.load(spark, d, "events")
    IO.append(e.select("ts", F.col("event_type").alias("kind"), F.col("props").alias("data")), root, "events")
    IO.append(T.decisions(spark, d).select("ts", "product", "composite", "confidence", "action"), root, "decisions")
    out = None
    for t in ("events", "decisions"):
        c = IO.read_ledger(spark, root, t).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("day").alias("days")).select(F.lit(t).alias("table_name"), "n", "days")
        out = c if out is None else out.unionByName(c)
    return out


@query("S14 J1", with_views("signal_scores", "decisions") + "SELECT count(*) AS n_labels, count(d.event_id) AS with_context, round(sum(d.composite), 4) AS composite FROM signal_scores s ASOF LEFT JOIN decisions d ON s.product = d.product AND s.ts >= d.ts")
def write_dataset(spark, d):
    path = f"{shared_folder(spark)}/dataset-{uuid.uuid4().hex}"
    lab = asof(T.signal_scores(spark, d), T.decisions(spark, d).withColumnRenamed("event_id", "decision_id"), payload=["decision_id", "composite"], tie=["decision_id"])
    IO.write_dataset(T.candles(spark, d), lab.select("event_id", "ts", "product", "strategy", "match.decision_id", "match.composite"), path)
    return spark.read.parquet(f"{path}/labels").agg(F.count(F.lit(1)).alias("n_labels"), F.count("decision_id").alias("with_context"), r6(F.sum("composite"), 4).alias("composite"))


@query("S15", with_views("trades") + "SELECT product, count(*) AS n, round(sum(pnl), 4) AS pnl FROM trades GROUP BY 1")
def write_report(spark, d):
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    t = T.trades(spark, d)
    by = t.groupBy("product").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("pnl"), 4).alias("pnl"))
    IO.write_report({"per_product": by, "per_reason": t.groupBy("exit_reason").agg(F.count(F.lit(1)).alias("n"))}, path)
    return spark.read.schema("product string, n bigint, pnl double").json(f"{path}/per_product")
