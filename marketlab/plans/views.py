"""The adapter views as DuckDB SQL, word for word what sources/tables.py builds."""

from __future__ import annotations

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

VIEWS = {
    "ticks": ((), f"""SELECT event_type AS product, ts, 100 + value AS price, 1 + {K} AS size,
        event_id, user_id FROM events"""),
    "candles": (("ticks",), """SELECT product, date_trunc('hour', ts) AS ts,
        first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
        last(price ORDER BY ts, event_id) AS close, CAST(sum(size) AS DOUBLE) AS volume
        FROM ticks GROUP BY 1, 2"""),
    "trades": ((), """SELECT 'P' || CAST(l_suppkey % 20 AS VARCHAR) AS product,
        CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side, l_quantity AS qty,
        l_extendedprice / l_quantity AS entry, l_extendedprice * l_tax * 0.1 AS fees,
        CAST(CAST(l_extendedprice AS DECIMAL(14, 2)) * CAST(l_discount - l_tax AS DECIMAL(6, 2)) AS DOUBLE) AS pnl, o_orderdate AS opened,
        o_orderdate + to_hours(CAST(1 + l_partkey % 72 AS INT)) AS closed,
        o_orderpriority AS regime_at_entry,
        CASE WHEN l_linestatus = 'O' THEN 'take-profit' ELSE 'stop-loss/trail' END AS exit_reason,
        l_linenumber = 7 AS hedge, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
        l_extendedprice, l_discount, l_tax, l_shipdate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "signal_scores": ((), f"""SELECT event_id, ts, 'S' || CAST(user_id % 13 AS VARCHAR) AS strategy,
        event_type AS product, CASE WHEN {K} % 2 = 0 THEN 1 ELSE -1 END AS direction,
        {K} / 100 AS confidence FROM events"""),
    "decisions": ((), f"""SELECT event_id, ts + to_seconds(60 + {K}) AS ts, event_type AS product, {K} / 50 - 1 AS composite,
        {K} / 100 AS confidence, CASE WHEN event_id % 5 = 1 THEN 'enter' ELSE 'skip' END AS action
        FROM events"""),
    "docs": ((), """SELECT doc_id, source, split_part(text, chr(10), 1) AS title, text AS body,
        TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INT)) AS ts, lang AS kind
        FROM documents"""),
    "fills": ((), """SELECT l_orderkey AS intent_id,
        concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS exec_id,
        'P' || CAST(l_suppkey % 20 AS VARCHAR) AS product, l_quantity AS qty,
        l_extendedprice / l_quantity AS price, l_tax AS fee, l_linenumber, l_shipdate AS ts
        FROM lineitem"""),
    "positions": ((), """SELECT date_trunc('day', o_orderdate) AS ts, o_custkey AS trader,
        1 + o_custkey % 10 AS rank, o_custkey % 100 / 100 AS score,
        'A' || CAST(o_orderkey % 8 AS VARCHAR) AS asset,
        CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS direction, o_totalprice AS notional
        FROM orders"""),
    "forecasts": ((), f"""SELECT *, least(0.99, greatest(0.01, market_p0 + (value - 50) / 500))
        AS predicted_p0 FROM (SELECT event_id AS id, user_id AS condition_id, ts AS forecast_ts,
        least(0.99, greatest(0.01, ({K} + 1) / 101)) AS market_p0,
        CASE WHEN event_id % 4 <> 0 THEN CASE WHEN value > 70 THEN 1 ELSE 0 END END
        AS resolved_outcome0, user_id % 97 * 9.0 AS ttl_hours, {K} AS k, value, event_id, user_id
        FROM events)"""),
    "votes": (("forecasts",), """SELECT id, 'momentum' AS strategy, k / 50 - 1 AS lean FROM forecasts
        UNION ALL SELECT id, 'mean_revert', (user_id % 21 - 10) / 10.0 FROM forecasts
        UNION ALL SELECT id, 'research', (event_id % 5 - 2) / 2.0 FROM forecasts"""),
    "features_long": ((), """SELECT vec_id, label, dim - 1 AS dim,
        CAST(embedding[dim] AS DOUBLE) AS value FROM (SELECT vec_id, label, embedding,
        unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings)"""),
}


def with_views(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` for the named views and what they build on."""
    seen: list[str] = []

    def visit(n):
        for dep in VIEWS[n][0]:
            visit(dep)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in seen) + "\n"
