"""Streams equal their batch form on closed windows, and replays change nothing."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from marketlab.operators import bars as B
from marketlab.streaming import ops as O

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id bigint, product string, ts timestamp, price double, size bigint"


def feed(spark, path, chunks):
    for i, rows in enumerate(chunks):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/part={i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def ticks(n, gap=60):
    return [(i, "ab"[i % 2], T0 + dt.timedelta(seconds=gap * i), 100.0 + i % 7, 1) for i in range(n)]


def test_stream_bars_equal_batch(spark, tmp_path):
    t = ticks(240)
    s = feed(spark, str(tmp_path / "in"), [t[:100], t[100:200], t[200:]])
    O.run_to_files(O.stream_bars(s).drop("w"), str(tmp_path / "out"))
    got = {(r["product"], r["ts"]): (r["open"], r["close"], r["volume"]) for r in spark.read.parquet(str(tmp_path / "out/data")).collect()}
    batch = B.ticks_to_bars(spark.createDataFrame(t, SCHEMA), "5 minutes", order=("ts", "event_id")).collect()
    closed = {(r["product"], r["ts"]): (r["open"], r["close"], r["volume"]) for r in batch
              if r["ts"] + dt.timedelta(minutes=5) <= t[-1][2] - dt.timedelta(minutes=10)}
    assert got == closed and closed


def silences(times, limit, mark):
    """Events by definition: (event, time, silent seconds) of one key's sorted times, as far as the watermark has passed them."""
    out = []
    for p, t in zip(times, [*times[1:], None], strict=True):
        closed = t is not None and (int(t.timestamp()) // limit + 1) * limit <= mark.timestamp()
        if t is None or (t - p).total_seconds() > limit:
            if closed or p + dt.timedelta(seconds=limit, milliseconds=1) <= mark:
                out.append(("stale", p, float(limit)))
            if closed:
                out.append(("recovered", t, (t - p).total_seconds()))
    return out


@pytest.mark.parametrize("cuts", [1, 3, 6])
def test_stale_and_recovered_over_batches_with_late_rows(spark, tmp_path, cuts):
    r = random.Random(cuts)
    at, rows = T0, []
    for i in range(120):
        at += dt.timedelta(minutes=r.choice([1, 3, 9, 40, 61, 200]))
        rows.append((i, r.choice("aab"), at, 1.0, 1))
    rows = [x for _, x in sorted(enumerate(rows), key=lambda y: y[0] + r.choice([0, 0, 1.5]) * (cuts > 1))]
    size = -(-len(rows) // cuts)
    chunks = [rows[i:i + size] for i in range(0, len(rows), size)]
    # a row behind the watermark is dropped, whatever it says
    chunks[-1] = chunks[-1] + ([(999, "a", T0, 1.0, 1)] if cuts > 1 else [])
    s = feed(spark, str(tmp_path / "in"), chunks)
    O.run_to_files(O.stale_feeds(s, 3600, "1000 minutes"), str(tmp_path / "out"))
    got = sorted((r["product"], r["event"], r["at"], r["silent_sec"]) for r in spark.read.parquet(str(tmp_path / "out/data")).collect())
    mark = max(x[2] for x in rows) - dt.timedelta(minutes=1000)
    want = sorted((k, *e) for k in "ab" for e in silences(sorted(x[2] for x in rows if x[1] == k), 3600, mark))
    assert got == want and len(want) > 5


def test_ledger_sink_is_idempotent(spark, tmp_path):
    sink = O.ledger_sink(str(tmp_path / "led"), ["event_id"], ["ts"], buckets=4)
    first, second, third = (spark.createDataFrame(ticks(n), SCHEMA) for n in (10, 15, 2))
    for batch, i in ((first, 0), (first, 0), (second, 1), (second, 1), (third, 2), (second, 1)):
        sink(batch, i)
    x = spark.read.parquet(str(tmp_path / "led"))
    assert x.count() == 15 and x.select("event_id").distinct().count() == 15
    assert {r["batch"]: r["count"] for r in x.groupBy("batch").count().collect()} == {0: 10, 1: 5}
    assert x.select("bucket").distinct().count() > 1


def test_retention_drops_the_day_folders_of_earlier_batches(spark, tmp_path):
    path = str(tmp_path / "kept")
    sink = O.retention_sink(path, "ts", 3 * 86400)
    rows = [(i, "a", T0 + dt.timedelta(hours=5 * i), 1.0, 1) for i in range(60)]
    chunks = [rows[:20], rows[20:40], rows[40:] + rows[2:4]]
    for i, chunk in enumerate(chunks):
        for _ in range(2):
            sink(spark.createDataFrame(chunk, SCHEMA), i)
        seen = [x for c in chunks[:i + 1] for x in c]
        newest = max(x[2] for x in seen)
        want = sorted(x[0] for x in rows if x in seen and x[2] >= newest - dt.timedelta(days=3))
        schema = spark.createDataFrame([], SCHEMA).schema
        assert sorted(r["event_id"] for r in O.retained(spark, path, schema, "ts", 3 * 86400).collect()) == want
        days = sorted(p.name for p in (tmp_path / "kept/rows").iterdir() if p.name.startswith("day="))
        assert days[0] >= f"day={(newest - dt.timedelta(days=3)).date()}"


@pytest.mark.parametrize("rows", [20, 10 ** 6])
def test_page_hinkley_over_batches_equals_the_fold(spark, tmp_path, rows):
    r = random.Random(6)
    data = [(i, "ab"[i % 3 == 0], T0 + dt.timedelta(seconds=i), r.random() * (1 if i < 150 else 3), 1) for i in range(400)] + [(900, "c", T0, 1.0, 1)]
    s = feed(spark, str(tmp_path / "in"), [data[:130], data[130:300], data[300:]]).withColumnRenamed("price", "error")
    f = str(tmp_path / "out")
    sink = O.page_hinkley_sink(f, "product", lam=1.5, rows=rows)
    O.run_batches(s, sink, f)
    sink(spark.createDataFrame(data[300:], SCHEMA).withColumnRenamed("price", "error"), 2)  # a replay
    got = {r["event_id"]: r["ph_stat"] for r in spark.read.parquet(f"{f}/hits/batch=*").collect()}
    want = {}
    for k in "abc":
        n = mean = cum = low = 0
        for i, _, _, e, _ in (x for x in data if x[1] == k):
            n += 1
            mean = 0.999 * mean + 0.001 * e if n > 1 else e
            cum = 0.999 * cum + e - mean - 0.005
            low = min(low, cum)
            if cum - low > 1.5:
                want[i] = cum - low
                cum = low = 0
    assert got == pytest.approx(want, abs=1e-9) and len(want) > 3


def test_drift_sink_counts_its_reference_once(spark, tmp_path):
    ref = spark.createDataFrame([("f", float(i % 40)) for i in range(400)] + [("g", float(i)) for i in range(50)], "k string, v double")
    sink = O.drift_sink(ref, "k", "v", str(tmp_path))
    from marketlab.operators.study import psi
    for i, shift in enumerate((0.0, 15.0, 15.0)):
        cur = spark.createDataFrame([("f", i % 40 + shift) for i in range(200)], "k string, v double")
        sink(cur, i)
        got = spark.read.parquet(str(tmp_path / f"batch={i}")).collect()
        assert [(r["k"], r["psi"], r["drifting"]) for r in got] == [(r["k"], pytest.approx(r["psi"]), r["drifting"]) for r in psi(ref, cur, "k", "v").collect()]
        assert got[0]["drifting"] == (shift > 0)


@pytest.mark.parametrize("cuts", [1, 3])
def test_labels_mature_or_are_abandoned(spark, tmp_path, cuts):
    t = [(i, "a", T0 + dt.timedelta(seconds=60 * i + i * i % 37), 100.0 + i, 1) for i in range(600) if not 200 <= i < 260]
    size = -(-len(t) // cuts)
    chunks = [t[i:i + size] for i in range(0, len(t), size)]
    chunks[-1] = chunks[-1] + ([(995, "a", T0 - dt.timedelta(minutes=5), 1.0, 1)] if cuts > 1 else [])
    s = feed(spark, str(tmp_path / "in"), chunks)
    sig = s.where("event_id % 10 = 0 and event_id < 900").select("event_id", "product", "ts", F.lit(-1).alias("direction"), F.col("price").alias("p0"))
    O.run_to_files(O.mature_stream(sig, s, 1800), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out/data")).collect()
    got = {r["event_id"]: (r["state"], r["fwd_return_raw"], r["fwd_return_aligned"]) for r in rows}
    assert len(got) == len(rows)
    mark = t[-1][2] - dt.timedelta(minutes=10)
    want = {}
    for i, _, at, p0, _ in t:
        if i % 10 == 0 and at + dt.timedelta(seconds=2400) < mark:
            due = at + dt.timedelta(seconds=1800)
            near = sorted((abs(u - due), u, p) for _, _, u, p, _ in t if abs(u - due) < dt.timedelta(seconds=600))
            raw = near[0][2] / p0 - 1 if near else None
            want[i] = ("scored", pytest.approx(raw), pytest.approx(-raw)) if near else ("abandon", None, None)
    assert got == want and ("abandon", None, None) in want.values()


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    from marketlab.plans.streams import events_stream

    t = spark.createDataFrame(ticks(12), SCHEMA)
    t.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    t.coalesce(1).write.parquet(str(tmp_path / "whole"))
    (tmp_path / "one").mkdir()
    shutil.copy(next((tmp_path / "whole").glob("part-*.parquet")), tmp_path / "one/events.parquet")
    for name, folder in (("a", tmp_path), ("b", tmp_path / "one")):
        O.run_to_files(events_stream(spark, str(folder)).select("event_id"), str(tmp_path / name))
        assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / name / "data")).collect()) == list(range(12))


def test_labels_of_crowded_times_grow_with_the_rows(spark, tmp_path):
    """20,000 signals and prices within a minute are 400 million pairs in reach; nulls, repeats and ties as before."""
    at = [T0 + dt.timedelta(microseconds=3000 * i) for i in range(20_000)]
    t = [(i, "a", u, 100.0 + i, 1) for i, u in enumerate(at)]
    due = T0 + dt.timedelta(seconds=1800)
    t += [(100_000 + i, "a", due + dt.timedelta(microseconds=6000 * i), float(1 + i), 1) for i in range(10_000)]
    t += [(5, "a", at[5], 105.0, 1), (99_999, "a", due, 7.0, 1), (None, "a", due + dt.timedelta(microseconds=6000), None, 1), (200_000, None, at[9], 1.0, 1), (300_000, "b", at[9], 1.0, 1),
          (900_000, "a", T0 + dt.timedelta(hours=5), 1.0, 1)]
    s = feed(spark, str(tmp_path / "in"), [t[:15_000], t[15_000:]])
    sig = s.where("event_id < 20000 or event_id >= 200000").select("event_id", "product", "ts", F.lit(1).alias("direction"), F.col("price").alias("p0"))
    x = O.mature_stream(sig, s, 1800)
    assert "Join" not in x._jdf.queryExecution().analyzed().toString()
    O.run_to_files(x, str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out/data")).collect()
    got = {r["event_id"]: (r["state"], r["fwd_return_raw"]) for r in rows}
    assert len(got) == len(rows) == 20_002
    assert got.pop(200_000) == got.pop(300_000) == ("abandon", None)
    for i, (state, raw) in got.items():
        # signals between two prices are as near to both: the earlier one; at the first due time the smaller id, at the second the null one
        price = None if i in (2, 3) else 7.0 if i < 2 else float(1 + i // 2)
        assert (state, raw) == (("abandon", None) if price is None else ("scored", pytest.approx(price / (100.0 + i) - 1)))
