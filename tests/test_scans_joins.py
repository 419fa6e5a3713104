"""Scans and time joins against brute force, with hot keys, ties, gaps and any chunking."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketlab.operators import joins as J
from marketlab.operators import ledger as G
from marketlab.operators import scans as S

T0 = dt.datetime(2024, 1, 1)


def rows(n, keys="abc", seed=0, step=1800, hot=True):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = "a" if hot and r.random() < 0.6 else r.choice(keys)
        out.append((i, k, T0 + dt.timedelta(seconds=r.randrange(0, n) * step // 4), r.choice([None, r.gauss(0, 1)])))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(300), "id bigint, k string, ts timestamp, v double").withColumns(
        {"day": S.time_chunk("ts", S.DAY), "hour": S.time_chunk("ts", S.HOUR)})


RUNS = [S.Run("s", "sum", "v"), S.Run("mx", "max", "v"), S.Run("mn", "min", "v"), S.Run("la", "last", "v"), S.Run("lb", "last", "v", strict=True)]


@pytest.mark.parametrize("chunks", [["day"], ["day", "hour"]])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_equals_plain_window(frame, chunks, reverse):
    a = {r["id"]: r for r in S.running(frame, ["ts", "id"], RUNS, ["k"], chunks, reverse).collect()}
    b = {r["id"]: r for r in S.running(frame, ["ts", "id"], RUNS, ["k"], (), reverse).collect()}
    assert len(a) == len(b) == 300
    for i in a:
        for c in ("mx", "mn", "la", "lb"):
            assert a[i][c] == b[i][c]
        assert a[i]["s"] == pytest.approx(b[i]["s"]) if b[i]["s"] is not None else a[i]["s"] in (None, 0.0)


def test_row_index_without_keys(frame):
    got = [r["id"] for r in S.row_index(frame, ["ts", "id"], (), ["day"]).orderBy("rn").collect()]
    want = [r["id"] for r in frame.orderBy("ts", "id").collect()]
    assert got == want


def test_trailing_chunks_do_not_change_a_trailing_mean(frame):
    from pyspark.sql import Window as W
    x = frame.dropDuplicates(["k", "ts"])
    def mean(d, keys):
        return d.withColumn("m", F.avg("v").over(W.partitionBy(*keys).orderBy("ts").rowsBetween(-6, 0)))
    a = mean(x, ["k"])
    b = mean(S.trailing_chunks(x, ["k"], "ts", lookback=6, size=20), ["k", "_piece"]).where(~F.col("_warm"))
    va, vb = ({r["id"]: r["m"] for r in d.collect()} for d in (a, b))
    assert va.keys() == vb.keys()
    for i in va:
        assert va[i] == pytest.approx(vb[i]) if va[i] is not None else vb[i] is None


@pytest.mark.parametrize("n", [10, 10 ** 6])
@pytest.mark.parametrize("forward,strict", [(False, False), (False, True), (True, False), (True, True)])
def test_asof_matches_pandas(spark, forward, strict, n):
    left, right = rows(200, seed=1), [r for r in rows(150, seed=2) if r[1] != "c"]
    lf = spark.createDataFrame(left, "id bigint, k string, ts timestamp, v double")
    rt = spark.createDataFrame([(r[0], r[1], r[2]) for r in right], "rid bigint, k string, ts timestamp")
    got = {r["id"]: r["rid"] for r in J.asof(lf, rt, "k", "ts", ["rid"], ["rid"], forward=forward, strict=strict, rows=n)
           .select("id", "match.rid").collect()}
    assert len(got) == 200
    for i, k, t, _ in left:
        c = [(u, j) for j, kk, u, _ in right if kk == k and ((u > t if strict else u >= t) if forward else (u < t if strict else u <= t))]
        want = None if not c else (min(c)[1] if forward else max(c)[1])
        assert got[i] == want


def test_nearest_is_strict_and_prefers_the_earlier(spark):
    t = lambda s: T0 + dt.timedelta(seconds=s)
    lf = spark.createDataFrame([(1, "a", t(100)), (2, "a", t(1000)), (3, "b", t(0))], "id int, k string, ts timestamp")
    rt = spark.createDataFrame([("x", "a", t(90)), ("y", "a", t(110)), ("z", "a", t(1600))], "n string, k string, ts timestamp")
    got = {r["id"]: r["n"] for r in J.nearest(lf, rt, 600, "k", "ts", ["n"], ["n"]).select("id", "match.n").collect()}
    assert got == {1: "x", 2: None, 3: None}


def test_windows_flag_and_next_event(spark):
    ts = [T0 + dt.timedelta(minutes=10 * i) for i in range(60)]
    ev = [(T0 + dt.timedelta(hours=h), h == 4) for h in (1, 4, 9)]
    x = J.in_windows(spark.createDataFrame([(t,) for t in ts], "ts timestamp"), spark.createDataFrame(ev, "ts timestamp, f boolean"),
                     F.when(F.col("f"), 2700).otherwise(1800), F.when(F.col("f"), 5400).otherwise(2700), rows=7).collect()
    for r in x:
        inside = any(e - dt.timedelta(seconds=2700 if f else 1800) <= r["ts"] <= e + dt.timedelta(seconds=5400 if f else 2700) for e, f in ev)
        assert r["blackout"] == inside
        assert r["next_event"] == min((e for e, _ in ev if e > r["ts"]), default=None)


def test_first_touch_prefers_the_stop_inside_one_bar(spark):
    t = lambda h: T0 + dt.timedelta(hours=h)
    bars = spark.createDataFrame([("a", t(1), 101.0, 99.5, 100.0), ("a", t(2), 110.0, 90.0, 100.0), ("a", t(3), 120.0, 119.0, 119.5)],
                                 "product string, ts timestamp, high double, low double, close double")
    e = spark.createDataFrame([(1, "a", t(0), 1, 100.0, 95.0, 105.0), (2, "a", t(2), 1, 100.0, 80.0, 130.0), (3, "a", t(2), -1, 100.0, 130.0, 119.2)],
                              "entry_id int, product string, ts timestamp, side int, price double, stop double, take double")
    got = {r["entry_id"]: (r["exit_kind"], r["exit_price"]) for r in J.first_touch(e, bars, 7200).collect()}
    assert got == {1: ("stop", 95.0), 2: ("open", 119.5), 3: ("take", 119.2)}


def test_range_extremes_against_brute_force(spark):
    r = random.Random(3)
    bars = [("a", T0 + dt.timedelta(hours=h), r.uniform(1, 5), r.uniform(6, 9)) for h in range(200) if r.random() < 0.8]
    spans = [("a", T0 + dt.timedelta(minutes=r.randrange(0, 9000)), r.randrange(0, 4000)) for _ in range(80)]
    spans = [(p, o, o + dt.timedelta(minutes=m)) for p, o, m in spans]
    x = J.range_extremes(spark.createDataFrame(spans, "product string, opened timestamp, closed timestamp"),
                         spark.createDataFrame(bars, "product string, ts timestamp, low double, high double"), 3600).collect()
    assert len(x) == 80
    for row in x:
        hit = [b for b in bars if row["opened"] <= b[1] <= row["closed"]]
        assert row["lowest"] == (min(b[2] for b in hit) if hit else None)
        assert row["highest"] == (max(b[3] for b in hit) if hit else None)


def test_skyline_in_small_blocks(spark):
    r = random.Random(5)
    pts = [(i, r.randrange(12), r.randrange(12), r.randrange(12)) for i in range(150)]
    want = {p[0] for p in pts if not any(all(q[j] >= p[j] for j in (1, 2, 3)) and q[1:] != p[1:] for q in pts)}
    df = spark.createDataFrame(pts, "id bigint, x bigint, y bigint, z bigint").repartition(4)
    assert {r["id"] for r in J.skyline(df, "id", ["x", "y", "z"], block=7).collect()} == want


def test_equity_path_and_runs(spark):
    r = random.Random(7)
    pnl = [r.choice([-2.0, -1.0, 0.0, 1.0, 2.5]) for _ in range(120)]
    df = spark.createDataFrame([(i, T0 + dt.timedelta(hours=3 * i), p) for i, p in enumerate(pnl)], "i int, ts timestamp, pnl double")
    df = df.withColumn("day", S.time_chunk("ts", S.DAY))
    x = {q["i"]: q for q in G.equity_path(df, "pnl", ["ts"], (), ["day"], 50.0).collect()}
    eq, peak, cur, longest = 50.0, 50.0, 0, 0
    for i, p in enumerate(pnl):
        eq += p
        peak = max(peak, eq)
        assert x[i]["equity"] == pytest.approx(eq) and x[i]["peak"] == pytest.approx(peak)
        cur = 0 if eq >= peak else cur + 1
        longest = max(longest, cur)
    path = G.equity_path(df, "pnl", ["ts"], (), ["day"], 50.0)
    assert G.longest_runs(path.select("ts", "day", "at_peak"), {"n": ~F.col("at_peak")}, ["ts"], (), ["day"]).first()["n"] == longest


def test_decimation_keeps_the_ends(spark):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(hours=i)) for i in range(57)], "i int, ts timestamp").withColumn("day", S.time_chunk("ts", S.DAY))
    got = sorted(r["i"] for r in G.decimate(df, ["ts"], 10, ["day"]).collect())
    assert got == sorted({int(i * 56 / 9) for i in range(10)})
    assert G.decimate(df, ["ts"], 100, ["day"]).count() == 57


def test_empty_and_single_rows(spark):
    e = spark.createDataFrame([], "k string, ts timestamp, v double").withColumn("day", S.time_chunk("ts", S.DAY))
    assert S.running(e, ["ts"], RUNS, ["k"], ["day"]).count() == 0
    one = spark.createDataFrame([("a", T0, 1.0)], "k string, ts timestamp, v double").withColumn("day", S.time_chunk("ts", S.DAY))
    r = S.running(one, ["ts"], RUNS, ["k"], ["day"]).first()
    assert (r["s"], r["la"], r["lb"]) == (1.0, 1.0, None)
    assert J.asof(one, one.where("false"), "k", "ts", ["v"]).first()["match"] is None




def test_hot_and_cold_orders_agree(spark):
    r = random.Random(11)
    f = []
    for i in range(120):
        k = 1 if r.random() < 0.5 else r.randrange(2, 9)
        f.append((k, f"x{r.randrange(0, 80)}", T0 + dt.timedelta(minutes=17 * i), float(r.randrange(1, 5)), r.uniform(9, 11), 0.1))
    fills = spark.createDataFrame(f, "intent_id int, exec_id string, ts timestamp, qty double, price double, fee double")
    orders = spark.createDataFrame([(k, 20.0) for k in range(1, 9)], "intent_id int, order_qty double")
    a, b = ({x["intent_id"]: x for x in G.order_vwap(fills, orders, ["ts"], rows=h).collect()} for h in (3, 10 ** 6))
    assert a.keys() == b.keys()
    for k in a:
        seen, qty, val, n = set(), 0.0, 0.0, 0
        for kk, e, _, q, p, _ in f:
            if kk == k and e not in seen:
                seen.add(e)
                if qty + 1e-12 < 20.0:
                    qty, val, n = qty + q, val + q * p, n + 1
        for got in (a[k], b[k]):
            assert (got["filled_qty"], got["n_fills"]) == (qty, n) and got["vwap"] == pytest.approx(val / qty)
            assert got["status"] == ("FILLED" if qty >= 20.0 else "PARTIAL")


@pytest.mark.parametrize("n", [12, 10 ** 6])
def test_probes_of_several_horizons_in_one_pass(spark, n):
    left, right = rows(150, seed=4), rows(220, seed=5)
    lf = spark.createDataFrame([*left, (900, "a", None, 1.0), (901, None, T0, 1.0)], "id bigint, k string, ts timestamp, v double")
    rt = spark.createDataFrame([(r[0], r[1], r[2]) for r in right] + [(950, "a", None), (951, "b", right[0][2]), (952, "b", right[0][2])], "rid bigint, k string, ts timestamp")
    all_right = [(r[0], r[1], r[2]) for r in right] + [(951, "b", right[0][2]), (952, "b", right[0][2])]
    x = J.nearest(lf, rt, 5000, "k", "ts", ["rid"], ["rid"], {"now": 0, "later": 7200}, rows=n).collect()
    assert len(x) == 152
    for r in x:
        for name, off in (("now", 0), ("later", 7200)):
            at = r["ts"] + dt.timedelta(seconds=off) if r["ts"] else None
            near = sorted((abs(t - at), t, i) for i, k, t in all_right if at and k == r["k"] and abs(t - at) < dt.timedelta(seconds=5000))
            assert (r[name]["rid"] if r[name] else None) == (near[0][2] if near else None)
    back = J.asof(lf, rt, "k", "ts", ["rid"], ["rid"], offset=3600, rows=n).collect()
    for r in back:
        c = [(t, i) for i, k, t in all_right if r["ts"] and k == r["k"] and t <= r["ts"] + dt.timedelta(seconds=3600)]
        assert (r["match"]["rid"] if r["match"] else None) == (max(c)[1] if c else None)


def test_hot_keys_are_cut_into_even_slices(spark):
    r = random.Random(9)
    times = [("hot", int(1e6 * r.expovariate(1) ** 3)) for _ in range(4000)] + [("cold", i) for i in range(50)]
    df = spark.createDataFrame(times, "k string, _at bigint")
    b = J.time_slices(df, ["k"], 100).collect()
    assert [x["_h0"] for x in b] == ["hot"]
    cut = df.join(J.time_slices(df, ["k"], 100), J._same(["k"]), "left").withColumn("s", J._slice_of(F.col("_at")))
    sizes = {x["s"]: x["count"] for x in cut.where("k = 'hot'").groupBy("s").count().collect()}
    bounds = b[0]["_bounds"]
    assert max(sizes.values()) <= 200 and all(x["s"] == sum(y <= x["_at"] for y in bounds) for x in cut.where("k = 'hot'").collect())
    assert {x["s"] for x in cut.where("k = 'cold'").collect()} == {0}


def test_cooldown(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    entries = spark.createDataFrame([(1, "a", at(50)), (2, "a", at(100)), (3, "a", at(999)), (4, "a", at(1000)), (5, "a", at(1100)), (6, "b", at(100)), (7, "a", None), (8, None, at(100))],
                                    "id int, product string, ts timestamp")
    exits = spark.createDataFrame([("a", at(100)), ("a", at(100)), ("a", at(1050)), ("a", None), ("c", at(90))], "product string, ts timestamp")
    for rows in (2, 1_000_000):
        got = {r["id"]: r["cooling"] for r in J.cooldown(entries, exits, 900, rows=rows).collect()}
        assert got == {1: False, 2: True, 3: True, 4: False, 5: True, 6: False, 7: False, 8: False}


def test_short_equity_windows_take_the_sample_before(spark):
    marks = spark.createDataFrame([(T0 + dt.timedelta(hours=h), float(h)) for h in (0, 5, 9, 30)] + [(None, 7.0)], "ts timestamp, equity double")
    got = {tuple(r) for r in G.equity_windows(marks, {"1h": 3600, "1d": 86400, "2d": 172800}).collect()}
    assert got == {("1h", 2, 9.0, 30.0), ("1d", 2, 9.0, 30.0), ("2d", 4, 0.0, 30.0)}
    assert {tuple(r) for r in G.equity_windows(marks.limit(0), {"1h": 3600}).collect()} == set()
    assert {tuple(r) for r in G.equity_windows(marks.where("equity = 5"), {"1h": 3600}).collect()} == {("1h", 1, 5.0, 5.0)}


def test_trailing_counts_keep_no_window_of_rows(spark):
    r = random.Random(5)
    at = [None if i % 40 == 0 else 1_700_000_000_000_000 + r.choice([0, 1, 59_999_999, 60_000_000, 60_000_001, 86_400_000_000]) + r.randrange(90) * 1_000_000 for i in range(400)]
    rows = [(r.choice("ab"), t) for t in at]
    df = spark.createDataFrame(rows, "k string, us bigint").select("k", F.timestamp_micros("us").alias("ts"))
    x = G.trailing_count(df, "ts", 60, ["k"])
    want = {(k, t): sum(k2 == k and t2 is not None and t - 60_000_000 <= t2 <= t for k2, t2 in rows) for k, t in rows if t is not None}
    got = {(o["k"], o["us"]): o["n_trailing"] for o in x.select("k", F.unix_micros("ts").alias("us"), "n_trailing").collect()}
    assert got == want and x.count() == len(want)
    # a moving frame adds up each window anew, which grows as the square of the rows in it
    assert "RangeFrame" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_equity_path_computes_its_rows_once_for_all_chunk_totals(spark):
    r = random.Random(2)
    rows = [(i, i // 4, i // 16, i // 64, float(r.randrange(-9, 10))) for i in range(300)]
    x = G.equity_path(spark.createDataFrame(rows, "t int, c int, b int, a int, v double"), "v", ["t"], (), ["a", "b", "c"], 5.0)
    total, peak, want = 5.0, 5.0, {}
    for t, *_, v in rows:
        total += v
        peak = max(peak, total)
        want[t] = (total, peak)
    assert {o["t"]: (o["equity"], o["peak"]) for o in x.collect()} == want
    # once for the rows themselves; the totals are a table of their own
    assert x._jdf.queryExecution().optimizedPlan().toString().count("row_number") + x._jdf.queryExecution().optimizedPlan().toString().count("sum(v") <= 3
