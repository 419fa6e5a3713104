"""Folds in slices equal the plain fold, whatever the slices."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketlab.operators import ledger as G
from marketlab.operators import study as Y

T0 = dt.datetime(2024, 1, 1)


def hinkley(errors, delta, lam, alpha):
    n = mean = cum = low = 0.0
    out = []
    for e in errors:
        if e is None:
            out.append((None, None))
            continue
        n += 1
        mean = alpha * mean + (1 - alpha) * e if n > 1 else e
        cum = alpha * cum + e - mean - delta
        low = min(low, cum)
        out.append((cum - low, float(cum - low > lam)))
        if cum - low > lam:
            cum = low = 0.0
    return out


@pytest.mark.parametrize("lam,alpha,rows", [(0.4, 0.999, 40), (4.0, 0.999, 40), (1e9, 0.9999, 25), (2.0, 0.7, 60), (3.0, 0.999, 10 ** 6)])
def test_page_hinkley_of_a_hot_key_in_many_slices(spark, lam, alpha, rows):
    r = random.Random(3)
    data = [("hot", i, T0 + dt.timedelta(seconds=7 * i + r.randrange(5)), None if r.random() < 0.02 else r.random() * (1 if i % 500 < 300 else 2)) for i in range(1200)]
    data += [(k, i, T0 + dt.timedelta(seconds=i), r.random()) for k in "abc" for i in range(9)]
    data += [("same", i, T0, float(i)) for i in range(30)]
    df = spark.createDataFrame(data, "k string, i int, ts timestamp, e double").repartition(5)
    got = {(x["k"], x["i"]): (x["ph_stat"], x["drift"]) for x in Y.page_hinkley(df, ["k"], ["ts", "i"], "e", 0.005, lam, alpha, rows).collect()}
    assert len(got) == len(data)
    for k in ("hot", "a", "b", "c", "same"):
        mine = [x for x in data if x[0] == k]
        for x, want in zip(mine, hinkley([x[3] for x in mine], 0.005, lam, alpha), strict=True):
            if want[0] is None:
                assert got[k, x[1]] == (None, None)
            else:
                assert got[k, x[1]][0] == pytest.approx(want[0], abs=1e-9) and got[k, x[1]][1] == want[1]


@pytest.mark.parametrize("mean,rows", [(0.0, 30), (-3.0, 30), (5.0, 50), (-3.0, 10 ** 6)])
def test_reservations_of_a_large_account_in_many_slices(spark, mean, rows):
    r = random.Random(8)
    data = [("big", i, float(r.randrange(-20, 21)) + mean) for i in range(900)] + [("small", i, float(r.randrange(-9, 9))) for i in range(20)]
    df = spark.createDataFrame(data, "k string, i long, amount double").repartition(4)
    got = {(x["k"], x["i"]): (x["balance"], x["applied"]) for x in G.reserve_cash(df, 50.0, ["k"], ["i"], rows).collect()}
    for k in ("big", "small"):
        cash = 50.0
        for _, i, a in (x for x in data if x[0] == k):
            ok = not (a < 0 and cash + 1e-9 < -a)
            cash += a if ok else 0
            assert got[k, i] == (pytest.approx(cash, abs=1e-9), float(ok))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, ts timestamp, e double")
    assert Y.page_hinkley(none, ["k"], ["ts"], "e").columns == ["k", "ts", "e", "ph_stat", "drift"]
    assert Y.page_hinkley(none, ["k"], ["ts"], "e").count() == 0
    assert G.reserve_cash(none.withColumn("amount", F.lit(1.0)), 1.0, ["k"], ["ts"]).count() == 0
