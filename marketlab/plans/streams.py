"""Streaming queries: the events table is read as a stream and drained to files, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketlab.functions.mathx import r6
from marketlab.operators.scans import shared_folder
from marketlab.plans.price import EPOCH, rd
from marketlab.plans.registry import query
from marketlab.plans.timejoins import near_sql
from marketlab.plans.views import with_views
from marketlab.sources import tables as T
from marketlab.streaming import ops as O


def events_stream(spark, d, name="events"):
    """One given table, a file or a folder of files, as a file stream with the table's own schema."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{d}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    s = reader.parquet(path) if O.is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in s.columns else s


def ticks_stream(spark, d):
    return events_stream(spark, d).select(F.col("event_type").alias("product"), "ts", (100 + F.col("value")).alias("price"), (1 + T.k_of()).alias("size"), "event_id", "user_id")


def folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drained(spark, stream, mode="append"):
    f = folder(spark)
    O.run_to_files(stream, f, mode)
    return spark.read.schema(stream.schema).parquet(f"{f}/data")


TK = with_views("ticks")
MARK = "(SELECT epoch_ms(max(ts)) - 600000 AS wm FROM events)"


@query("T1", TK + f""", b AS (SELECT product, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, CAST(sum(size) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2)
SELECT product, {EPOCH}, {rd('open', 'high', 'low', 'close', 'volume')} FROM b, {MARK} WHERE epoch_ms(ts) + 300000 <= wm""")
def stream_bars(spark, d):
    x = drained(spark, O.stream_bars(ticks_stream(spark, d)).drop("w"))
    return x.select("product", F.unix_seconds("ts").alias("ts"), *[r6(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")])


@query("T2", TK + f""", w AS (SELECT product, time_bucket(INTERVAL 5 MINUTE, ts) + to_minutes(5 * i) AS e FROM ticks, (SELECT unnest(range(1, 13)) AS i)) SELECT product, CAST(epoch(e) AS BIGINT) AS ts, count(*) AS n, count(*) > 4 AS over_limit
FROM w, {MARK} WHERE epoch_ms(e) <= wm GROUP BY 1, 2""")
def stream_sliding_counts(spark, d):
    x = drained(spark, O.sliding_counts(ticks_stream(spark, d), ["product"], limit=4))
    return x.select("product", F.unix_seconds("ts").alias("ts"), "n", "over_limit")


@query("T3", TK + "SELECT product, max(event_id) AS event_id, round(last(price ORDER BY ts, event_id), 6) AS price FROM ticks GROUP BY 1")
def stream_latest_ticker(spark, d):
    f = folder(spark)
    O.run_batches(O.latest_ticker(ticks_stream(spark, d)), lambda b, i: b.write.mode("overwrite").parquet(f"{f}/data"), f, "complete")
    return spark.read.parquet(f"{f}/data").select("product", "event_id", r6(F.col("price")).alias("price"))


@query("T4", TK + f""", g AS (SELECT product, ts, lag(ts) OVER (PARTITION BY product ORDER BY ts) AS p, lead(ts) OVER (PARTITION BY product ORDER BY ts) AS nx FROM ticks)
SELECT product, 'recovered' AS event, count(*) AS n FROM g, {MARK} WHERE epoch_us(ts) - epoch_us(p) > 3600000000 AND (epoch_us(ts) // 3600000000 + 1) * 3600000 <= wm GROUP BY 1
UNION ALL SELECT product, 'stale', count(*) FROM g, {MARK} WHERE (nx IS NULL OR epoch_us(nx) - epoch_us(ts) > 3600000000) AND (epoch_ms(ts) + 3600001 <= wm OR (epoch_us(nx) // 3600000000 + 1) * 3600000 <= wm) GROUP BY 1""")
def stream_stale_feeds(spark, d):
    return drained(spark, O.stale_feeds(ticks_stream(spark, d), 3600)).groupBy("product", "event").agg(F.count(F.lit(1)).alias("n"))


@query("T5", "SELECT count(*) AS n, sum(k) AS total FROM (SELECT user_id || '-' || (event_id // 3) AS k0, 1 AS k FROM events GROUP BY 1)")
def stream_dedupe(spark, d):
    e = events_stream(spark, d).select("ts", F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 3)).alias("exec_id"))
    return drained(spark, O.dedupe(e, "exec_id", "60 days")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("exec_id").alias("total"))


T6 = TK + near_sql("ticks", 1800, "q1") + f""", l AS (SELECT t.product, q1.px, (q1.px / price - 1) * CASE WHEN size % 2 = 0 THEN -1 ELSE 1 END AS al FROM ticks t JOIN q1 USING (event_id), {MARK} WHERE epoch_ms(ts) + 2400000 < wm)
SELECT product, CASE WHEN px IS NULL THEN 'abandon' ELSE 'scored' END AS state, count(*) AS n, round(avg(al), 6) AS mean_return FROM l GROUP BY 1, 2"""


@query("T6", T6)
def stream_label_maturation(spark, d):
    s = ticks_stream(spark, d).select("event_id", "product", "ts", F.when(F.col("size") % 2 == 0, -1).otherwise(1).alias("direction"), F.col("price").alias("p0"))
    x = drained(spark, O.mature_stream(s, ticks_stream(spark, d), 1800))
    return x.groupBy("product", "state").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("fwd_return_aligned")).alias("mean_return"))


@query("T7", with_views("features_long") + """, rf AS (SELECT * FROM features_long WHERE label < 5), cu AS (SELECT * FROM features_long WHERE label >= 5), lm AS (SELECT dim, min(value) AS lo, max(value) AS hi, count(*) AS n FROM rf GROUP BY 1), cn AS (SELECT dim, count(*) AS n FROM cu GROUP BY 1),
b AS (SELECT dim, least(7, floor((value - lo) / ((hi - lo) / 8))) AS b, label < 5 AS isref FROM features_long JOIN lm USING (dim) WHERE value >= lo), h AS (SELECT dim, b, sum(CAST(isref AS INT)) AS r, sum(1 - CAST(isref AS INT)) AS c FROM b GROUP BY 1, 2),
g AS (SELECT lm.dim, i AS b, lm.n AS nr, cn.n AS nc FROM lm JOIN cn USING (dim), range(8) t(i)), t AS (SELECT g.dim, greatest(1e-4, coalesce(r, 0) / nr) AS a, greatest(1e-4, coalesce(c, 0) / nc) AS q FROM g LEFT JOIN h ON g.dim = h.dim AND g.b = h.b)
SELECT 0 AS batch_id, dim, round(sum((q - a) * ln(q / a)), 6) AS psi, sum((q - a) * ln(q / a)) > 0.25 AS drifting FROM t GROUP BY dim""")
def stream_drift(spark, d):
    f = folder(spark)
    ref = T.features_long(spark, d).where("label < 5")
    e = events_stream(spark, d, "embeddings").where("label >= 5").select("vec_id", F.posexplode("embedding").alias("dim", "value"))
    O.run_batches(e, O.drift_sink(ref, "dim", "value", f"{f}/data"), f)
    return spark.read.parquet(f"{f}/data/batch=*").select("batch_id", "dim", r6(F.col("psi")).alias("psi"), "drifting")


@query("T8", with_views("decisions").replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT product, row_number() OVER (PARTITION BY product ORDER BY ts, event_id) AS i, abs(composite - confidence) AS e FROM decisions),
f(product, i, mean, cum, low, hit) AS (SELECT product, i, e, CAST(-0.005 AS DOUBLE), CAST(-0.005 AS DOUBLE), 0 FROM o WHERE i = 1 UNION ALL
  SELECT product, i, m, CASE WHEN c - lo > 5 THEN 0 ELSE c END, CASE WHEN c - lo > 5 THEN 0 ELSE lo END, CASE WHEN c - lo > 5 THEN 1 ELSE 0 END FROM (
    SELECT product, i, m, c, least(low, c) AS lo FROM (SELECT product, i, low, m, 0.999 * cum + e - m - 0.005 AS c FROM (
      SELECT o.product, o.i, o.e, f.cum, f.low, 0.999 * f.mean + 0.001 * o.e AS m FROM f JOIN o ON o.product = f.product AND o.i = f.i + 1))))
SELECT product, sum(hit) AS n_events FROM f GROUP BY 1 HAVING sum(hit) > 0""")
def stream_page_hinkley(spark, d):
    e = events_stream(spark, d).withColumn("k", T.k_of())
    e = e.select(F.col("event_type").alias("product"), F.timestamp_micros(F.unix_micros("ts") + (60 + F.col("k")) * 1_000_000).alias("ts"), "event_id", F.abs(F.col("k") / 50 - 1 - F.col("k") / 100).alias("error"))
    f = folder(spark)
    O.run_batches(e, O.page_hinkley_sink(f"{f}/data", "product", lam=5.0), f)
    return spark.read.parquet(f"{f}/data/hits/batch=*").groupBy("product").agg(F.count(F.lit(1)).alias("n_events"))


@query("T9 S12", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def stream_ledger_append(spark, d):
    f = folder(spark)
    e = events_stream(spark, d).select("user_id", "event_id", "ts")
    O.run_batches(e, O.ledger_sink(f"{f}/data", ["user_id"], ["event_id"]), f)
    return spark.read.parquet(f"{f}/data").select("user_id", "event_id")


@query("T10", TK + f""", g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 3600000000 THEN 1 ELSE 0 END AS nw FROM ticks), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g),
q AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM s GROUP BY user_id, s) SELECT user_id, CAST(epoch_us(a) AS BIGINT) AS start, n FROM q, {MARK} WHERE epoch_ms(b) + 3600000 <= wm""")
def stream_sessions(spark, d):
    x = drained(spark, O.sessions(ticks_stream(spark, d), ["user_id"], "1 hour"))
    return x.select("user_id", F.unix_micros("start").alias("start"), "n")


@query("T11", f"""SELECT sym, source_kind, sum(n) AS mentions, count(*) AS n_windows FROM (SELECT 'u' || CAST(user_id % 9 AS VARCHAR) AS sym, event_type AS source_kind, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2, 3), {MARK}
WHERE epoch_ms(h) + 3600000 <= wm GROUP BY 1, 2""")
def stream_mention_counts(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = events_stream(spark, d).select("ts", F.col("event_type").alias("kind"), F.concat(F.lit("u"), F.col("user_id") % 9).alias("sym"))
    x = drained(spark, O.mention_counts(e, F.array("sym"), "1 hour"))
    return x.groupBy("sym", "source_kind").agg(F.sum("weight").alias("mentions"), F.count(F.lit(1)).alias("n_windows"))


@query("T12 S16", "SELECT event_id FROM events, (SELECT max(ts) AS now FROM events) WHERE epoch_us(ts) >= epoch_us(now) - 7 * 86400000000")
def stream_retention(spark, d):
    f = folder(spark)
    e = events_stream(spark, d).select("event_id", "ts")
    O.run_batches(e, O.retention_sink(f"{f}/data", "ts", 7 * 86400), f)
    return O.retained(spark, f"{f}/data", e.schema, "ts", 7 * 86400).select("event_id")
