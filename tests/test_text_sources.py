"""Text functions, readers and ledger tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marketlab import schemas
from marketlab.functions import text as X
from marketlab.operators import docs as D
from marketlab.sources import ledger_io as IO
from marketlab.sources import readers as RD

T0 = dt.datetime(2024, 1, 1)


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


def test_lexicon_negation_and_clamp(spark):
    lex = X.signed(X.BULL, X.BEAR)
    assert one(spark, "Bitcoin bullish rally", lambda c: X.lexicon_score(c, lex, X.NEGATORS)) == pytest.approx(1.0)
    assert one(spark, "not bullish today", lambda c: X.lexicon_score(c, lex, X.NEGATORS)) == pytest.approx(-2 / 3)
    assert one(spark, "", lambda c: X.lexicon_score(c, lex, X.NEGATORS)) == 0.0
    assert one(spark, "fed cuts rates, dovish easing", lambda c: X.lexicon_score(c, X.signed(X.MACRO_POS, X.MACRO_NEG))) == pytest.approx(1.0)


def test_text_helpers(spark):
    assert one(spark, "<p>a<script>x<b></script> b</p>", X.strip_html) == "a b"
    assert one(spark, "HTTPS://Ex.com/a/?utm_source=q&b=2&a=1&gclid=9#z", X.canonical_url) == "https://ex.com/a?a=1&b=2"
    assert one(spark, "ftp://x", X.canonical_url) == ""
    assert one(spark, "btc-USD", X.base_symbol) == "BTC"
    assert one(spark, "Will the Turtles' win - turtles against eagles?", X.terms) == ["turtles", "eagles"]
    assert one(spark, "$WIF and SOL, not USD", lambda c: X.tickers(c, F.array(F.lit("SOL"), F.lit("USD")))) == ["WIF", "SOL"]
    for t in ("2024-03-01T10:00:00-04:00", "2024-03-01T14:00:00Z", "Fri, 1 Mar 2024 14:00:00 +0000", "1709301600"):
        assert one(spark, t, lambda c: F.unix_seconds(X.parse_time(c))) == 1709301600
    assert one(spark, "soon", X.parse_time) is None
    assert one(spark, '{"a":{"b":"7"}}', lambda c: X.dig(c, "x.y", "a.b")) == "7"
    assert len(one(spark, "u", X.short_hash)) == 16 and one(spark, "u", lambda c: X.seed_of(c, F.lit("k"))) >= 0


def test_feed_items(spark):
    feed = "<rss>" + "".join(f"<item><title><![CDATA[Headline number {i} &amp; more]]></title></item>" for i in range(40)) + "<item><title>tiny</title></item></rss>"
    pages = spark.createDataFrame([(1, feed)], "id int, body string")
    assert D.feed_items(pages, "body", limit=30).count() == 30
    x = D.feed_items(pages, "body")
    assert x.count() == 40 and x.orderBy("item_no").first()["title"] == "Headline number 0 & more"


def test_bars_and_signals_from_files(spark, tmp_path):
    b = spark.createDataFrame([("a", T0, 1.0, 2.0, 0.5, 1.5, 9.0, 1), ("a", T0, 7.0, 7.0, 7.0, 7.0, 7.0, 0)], schemas.BARS + ", page bigint")
    b.write.parquet(str(tmp_path / "bars"))
    r = RD.read_bars(spark, str(tmp_path / "bars"), "parquet", "page").collect()
    assert len(r) == 1 and r[0]["open"] == 7.0
    (tmp_path / "s.jsonl").write_text('{"source":"x","ts":1,"asset":"BTC","value":0.5}\n{broken\n{"source":"y","ts":2,"asset":"ETH","value":-1}\n')
    assert {r["asset"] for r in RD.read_signal_rows(spark, str(tmp_path / "s.jsonl")).collect()} == {"BTC", "ETH"}
    snap = [{"ts": 5, "traders": [{"id": "t", "positions": [{"asset": "btc", "notional": 3}]}, {"id": "u", "rank": 2, "positions": []}]}]
    (tmp_path / "a.json").write_text(json.dumps(snap))
    (tmp_path / "b.json").write_text(json.dumps({"snapshots": snap}))
    rows = RD.read_snapshots(spark, str(tmp_path / "*.json")).collect()
    assert len(rows) == 4 and {(r["trader"], r["rank"], r["asset"], r["direction"]) for r in rows} == {("t", 9999, "BTC", 0), ("u", 2, None, 0)}


def test_ledger_appends_and_labels(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(T0, "k", "m")], "ts timestamp, kind string, message string")
    IO.append(df, root, "events")
    IO.append(df, root, "events")
    assert IO.read_ledger(spark, root, "events").count() == 2
    with pytest.raises(ValueError):
        IO.append(df.withColumn("odd", F.lit(1)), root, "events")
    t = spark.createDataFrame([(1, None, 0), (2, 0.5, 1), (3, None, 0)], "id int, y double, scored int")
    u = spark.createDataFrame([(1, 0.1), (2, 9.0), (3, None)], "id int, y double")
    once = IO.label_once(t, u, "id", ["y"])
    assert {(r["id"], r["y"], r["scored"]) for r in once.collect()} == {(1, 0.1, 1), (2, 0.5, 1), (3, None, 1)}
    again = IO.label_once(once, spark.createDataFrame([(1, 7.0)], "id int, y double"), "id", ["y"])
    assert {r["y"] for r in again.where("id = 1").collect()} == {0.1}
    new = spark.createDataFrame([(1, "a", 5), (1, "a", 4), (2, "b", 1)], "c int, b string, o int")
    assert {(r["c"], r["o"]) for r in IO.insert_or_ignore(new.where("c = 2"), new, ["c", "b"], ["o"]).collect()} == {(1, 4)}


def test_dataset_and_report_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "id int, v double")
    IO.write_dataset(df, df, str(tmp_path / "ds"))
    assert spark.read.parquet(str(tmp_path / "ds/labels")).count() == 1
    assert spark.read.json(str(tmp_path / "ds/meta")).first()["n_labels"] == 1
    IO.write_report({"one": df, "two": df}, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep/two")).count() == 1


def test_markets_and_calendar(spark):
    m = spark.createDataFrame([("c1", "q", "nfl-x", '["Y","N"]', '["1","2"]', '["0.3","bad"]'), ("c2", "q", "", '["A","B","C"]', '["1","2"]', "[]"), ("c3", "q", None, '["Y","N"]', '["1","2"]', None)],
                              "conditionId string, question string, slug string, outcomes string, clobTokenIds string, outcomePrices string")
    for f in schemas.MARKET.split(", ")[6:]:
        n, t = f.split()
        m = m.withColumn(n, F.lit(None).cast(t))
    got = {r["condition_id"]: (r["category"], list(r["prices"]), r["tick_size"]) for r in RD.normalize_markets(m).collect()}
    assert got == {"c1": ("nfl", [0.3, 0.5], 0.01), "c3": ("other", [0.5, 0.5], 0.01)}
