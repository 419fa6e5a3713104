"""Registry checks and a sample of queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

D = "/root/testdata/sf0.001"
SAMPLE = ["ticks_to_bars", "ohlcv_features", "ohlcv_features_chunked", "swing_atr", "mtf_trend", "chart_patterns", "composite_vote", "rule_backtest",
          "validate_rules", "asof_decision", "nearest_decision", "macro_blackout", "first_touch_exits", "mae_join", "pair_spread", "label_maturation",
          "tearsheet_overall", "trade_analytics", "protection_locks", "order_vwap", "ledger_balance", "arm_posteriors", "arm_decay", "pbo_cscv",
          "deflated_sharpe", "mention_heat", "canonical_urls", "rank_ic", "psi_drift", "conformal_quantile", "market_vote", "stream_bars"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 180


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_duckdb(spark, db, name):
    df = entry.queries()[name](spark, D)
    r = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    want = r.fetchall()
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, want)
