"""Explicit schemas of inputs and ledger tables; no inference in production paths."""

from __future__ import annotations

BARS = "product string, ts timestamp, open double, high double, low double, close double, volume double"
TICK_MESSAGE = "type string, product_id string, price string, best_bid string, best_ask string, time string"
SIGNAL_ROW = "source string, ts double, asset string, value double, kind string, text string, meta map<string,string>"
POSITION = "struct<asset:string,direction:int,notional:double,leverage:double>"
SNAPSHOT = f"ts double, traders array<struct<id:string,rank:int,score:double,positions:array<{POSITION}>>>"
MARKET = ("conditionId string, question string, slug string, outcomes string, clobTokenIds string, outcomePrices string, "
          "bestBid string, bestAsk string, spread string, lastTradePrice string, liquidity string, volume24hr string, "
          "orderPriceMinTickSize string, orderMinSize string, oneHourPriceChange string, oneDayPriceChange string, "
          "endDate string, active boolean, closed boolean, acceptingOrders boolean")
CALENDAR = "title string, country string, date string, impact string"

# The ledger tables; `day` partitions each dataset.
LEDGER = {
    "events": "ts timestamp, kind string, message string, data string",
    "trades": "ts timestamp, product string, side string, qty double, price double, fee double, reason string, pnl double",
    "equity": "ts timestamp, equity double, cash double, exposure double",
    "signal_scores": "id bigint, ts timestamp, strategy string, product string, direction int, confidence double, "
                     "fwd_return double, scored int, regime string",
    "order_events": "ts timestamp, intent_id string, client_order_id string, product string, side string, event string, "
                    "qty double, price double, status string, venue string, data string",
    "decisions": "ts timestamp, cycle bigint, product string, direction int, composite double, confidence double, "
                 "ml_confidence double, action string, reason string, size_pre double, size_post double, regime string, "
                 "votes map<string,double>",
    "pm_forecasts": "id bigint, condition_id string, ttl_bucket string, forecast_ts timestamp, predicted_p0 double, "
                    "market_p0 double, votes map<string,double>, features string, evidence string, resolved_outcome0 int, "
                    "resolved_ts timestamp, due double, next_poll double, attempts int",
    "paper_portfolio": "id int, cash double, opening_cash double, migration_id string, created_ts timestamp",
    "paper_capital_events": "event_id string, sleeve string, amount double, reference string, ts timestamp",
}
