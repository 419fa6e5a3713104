"""Trade-ledger analytics: equity paths, tearsheets, streaks, protections, orders and balances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlab.functions.mathx import wilson
from marketlab.operators.joins import SLICE_ROWS, _same, _slice_of, asof, time_slices
from marketlab.operators.scans import DAY, HOUR, Run, micros, pin, row_index, running, seconds, time_chunk, time_pieces
from marketlab.operators.slices import FOLD_ROWS, reservation_jump, reservation_replay, sliced_fold

YEAR_SEC = 365.25 * 86400


def trade_return() -> Column:
    """Net return on entry notional, NULL where the notional is unknown."""
    n = F.abs(F.col("qty") * F.col("entry"))
    return F.when(n > 0, F.col("pnl") / n)


def equity_path(df: DataFrame, value: str, order: Sequence[str], keys=(), chunks=(), start: float = 0.0) -> DataFrame:
    """Cumulative equity, running peak (start included), drawdown and new-high flag per row, and `pos`,
    its place inside its chunk.

    The flag allows for the last digits of floating sums.

    Chunk sums and chunk-local maxima give both the equity and the peak before every chunk, so one
    pass over the rows and one scan of the small chunk table are enough.
    """
    keys, chunks = list(keys), list(chunks)
    part = keys + chunks
    w = (W.partitionBy(*part) if part else W.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumns({"_s": F.sum(value).over(w), "pos": F.row_number().over(w)}).withColumn("_m", F.max("_s").over(w))
    if chunks:
        # each scan of the totals reads them once per level, so they are computed once
        total = pin(local.groupBy(*part).agg(F.sum(value).alias("_sum"), F.max("_m").alias("_top")))
        c = running(total, chunks, [Run("_base", "sum", "_sum", strict=True)], keys, chunks[:-1])
        c = c.withColumn("_base", F.coalesce("_base", F.lit(0.0)))
        c = running(c, chunks, [Run("_high", "max", F.col("_base") + F.col("_top"), strict=True)], keys, chunks[:-1])
        local = local.join(c.select(*part, "_base", "_high"), part)
    else:
        local = local.withColumns({"_base": F.lit(0.0), "_high": F.lit(None).cast("double")})
    eq = F.col("_base") + F.col("_s") + start
    peak = F.greatest(F.lit(float(start)), F.col("_high") + start, F.col("_base") + F.col("_m") + start)
    x = local.withColumns({"equity": eq, "peak": peak}).drop("_s", "_m", "_base", "_high")
    return x.withColumns({"drawdown": F.when(F.col("peak") <= 0, 0.0).otherwise(1 - F.col("equity") / F.col("peak")),
                          "at_peak": F.col("equity") >= F.col("peak") - 1e-10 * F.abs("peak")})


def longest_runs(df: DataFrame, flags: dict[str, Column], order, keys=(), chunks=()) -> DataFrame:
    """Longest run of consecutive true rows of each flag per key.

    A run is the set of true rows sharing one count of false rows so far, so its length is a plain
    (map-side combined) count: no group is ever collected.
    """
    keys = list(keys)
    x = df.withColumns({f"_f_{n}": F.coalesce(c, F.lit(False)) for n, c in flags.items()})
    x = running(x, order, [Run(f"_g_{n}", "sum", (~F.col(f"_f_{n}")).cast("bigint")) for n in flags], keys, chunks)
    out = None
    for n in flags:
        runs = x.where(F.col(f"_f_{n}")).groupBy(*keys, f"_g_{n}").agg(F.count(F.lit(1)).alias("_len"))
        best = runs.groupBy(*keys).agg(F.max("_len").alias(n))
        if keys:
            base = df.select(*keys).distinct() if out is None else out
            out = base.join(best, keys, "left")
        else:
            best = best.agg(F.max(n).alias(n))
            out = best if out is None else out.crossJoin(best)
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in flags})


def moments(c: Column) -> dict[str, Column]:
    """A10: n, mean, population sd, skew and (non-excess) kurtosis as the reference defines them."""
    sd = F.stddev_pop(c)
    ok = (F.count(c) >= 2) & (sd > 0)
    return {"n": F.count(c), "mean": F.when(F.count(c) >= 2, F.avg(c)).otherwise(0.0),
            "sd": F.when(ok, sd).otherwise(0.0), "skew": F.when(ok, F.skewness(c)).otherwise(0.0),
            "kurt": F.when(F.count(c) < 2, 0.0).when(sd > 0, F.kurtosis(c) + 3).otherwise(3.0)}


def sharpe(c: Column) -> Column:
    sd = F.stddev_pop(c)
    return F.when((F.count(c) >= 2) & (sd > 0), F.avg(c) / sd).otherwise(0.0)


def sortino(c: Column, target: float = 0.0) -> Column:
    """Mean excess over downside RMS; 0 without downside."""
    dd = F.sqrt(F.avg(F.pow(F.least(F.lit(0.0), c - target), 2)))
    return F.when((F.count(c) >= 2) & (dd > 0), (F.avg(c) - target) / dd).otherwise(0.0)


def profit_factor(c: Column) -> Column:
    """Gross win over gross loss; NULL without losses (never infinite)."""
    loss = -F.sum(F.when(c < 0, c))
    return F.when(loss > 0, F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0.0)) / loss)


def win_loss(c: Column) -> dict[str, Column]:
    avg_win, avg_loss = F.coalesce(F.avg(F.when(c > 0, c)), F.lit(0.0)), F.coalesce(-F.avg(F.when(c < 0, c)), F.lit(0.0))
    return {"avg_win": avg_win, "avg_loss": avg_loss, "win_loss_ratio": F.when(avg_loss > 0, avg_win / avg_loss),
            "expectancy": F.avg(c), "profit_factor": profit_factor(c)}


def tearsheet(trades: DataFrame, order, chunks=(), start_cash: float = 10_000.0) -> DataFrame:
    """A2: one row of performance figures for a whole ledger, drawdown path included."""
    r = trade_return()
    x = equity_path(trades.withColumn("_r", r), "pnl", order, (), chunks, start_cash)
    x = pin(x.select("pos", *chunks, "closed", "pnl", "fees", "_r", "drawdown", "at_peak"))
    ret = F.col("_r")
    a = x.agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("net_pnl"), F.sum((F.col("pnl") > 0).cast("int")).alias("wins"),
              *[c.alias(k) for k, c in win_loss(ret).items()], sharpe(ret).alias("sharpe_per_trade"),
              sortino(ret).alias("sortino_per_trade"), F.count(ret).alias("_nr"),
              F.greatest(F.lit(0.0), F.max("drawdown")).alias("max_drawdown"), F.max("pnl").alias("best_trade_pnl"),
              F.min("pnl").alias("worst_trade_pnl"), F.sum("fees").alias("gross_entry_fees"),
              F.min("closed").alias("_first"), F.max("closed").alias("_last"))
    a = a.crossJoin(longest_runs(x.select("pos", *chunks, "at_peak"), {"max_dd_duration_trades": ~F.col("at_peak")}, ["pos"], (), chunks))
    years = (seconds("_last") - seconds("_first")) / YEAR_SEC
    end = F.lit(start_cash) + F.col("net_pnl")
    ann = F.when((years > 0) & (end > 0), F.pow(end / start_cash, 1 / years) - 1)
    ci = wilson(F.col("wins"), F.col("n"))
    return a.withColumns({**ci, "span_days": F.round((seconds("_last") - seconds("_first")) / 86400, 1),
                          "annualized_return": ann, "calmar": F.when(F.col("max_drawdown") > 0, ann / F.col("max_drawdown")),
                          "ann_sharpe": F.when((years > 0) & (F.col("_nr") > 1), F.col("sharpe_per_trade") * F.sqrt(F.col("n") / years))}
                         ).drop("_first", "_last", "_nr")


def tearsheet_slices(trades: DataFrame) -> DataFrame:
    """A3: figures overall, by regime and by exit reason in one GROUPING SETS pass; null -> unknown."""
    x = trades.select("pnl", trade_return().alias("_r"), F.coalesce("regime_at_entry", F.lit("unknown")).alias("regime"),
                      F.coalesce("exit_reason", F.lit("unknown")).alias("reason"))
    ret = F.col("_r")
    g = x.groupingSets([[], ["regime"], ["reason"]], "regime", "reason").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("net_pnl"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg(ret).alias("expectancy_pct"),
        profit_factor(ret).alias("profit_factor"), sharpe(ret).alias("sharpe_per_trade"), F.avg("pnl").alias("avg_pnl"))
    kind = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "regime").otherwise("exit_reason")
    return g.withColumns({"slice": kind, "key": F.coalesce("regime", "reason", F.lit("all"))}).drop("_g", "regime", "reason")


def trade_analytics(trades: DataFrame, order, chunks=()) -> DataFrame:
    """A4: profit factor, payoff, sample deviation, streaks and currency drawdown; a loss is pnl <= 0."""
    x = equity_path(trades, "pnl", order, (), chunks, 0.0)
    x = pin(x.select("pos", *chunks, "opened", "closed", "pnl", "peak", "equity"))
    p = F.col("pnl")
    a = x.agg(F.count(F.lit(1)).alias("trades"), F.sum((p > 0).cast("int")).alias("wins"), F.sum((p <= 0).cast("int")).alias("losses"),
              F.sum(p).alias("total_pnl"), F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("gross_profit"),
              F.coalesce(F.sum(F.when(p <= 0, p)), F.lit(0.0)).alias("gross_loss"), F.max(p).alias("largest_win"), F.min(p).alias("largest_loss"),
              F.stddev_samp(p).alias("pnl_stdev"), F.stddev_samp(F.least(F.lit(0.0), p)).alias("_down"),
              F.max(F.col("peak") - F.col("equity")).alias("max_drawdown_realized"),
              F.avg(seconds("closed") - seconds("opened")).alias("avg_hold_sec"))
    runs = longest_runs(x.select("pos", *chunks, "pnl"), {"best_win_streak": p > 0, "worst_loss_streak": p <= 0}, ["pos"], (), chunks)
    a = a.crossJoin(runs)
    avg, loss = F.col("total_pnl") / F.col("trades"), -F.col("gross_loss")
    return a.withColumns({
        "expectancy": avg, "profit_factor": F.when(loss != 0, F.col("gross_profit") / loss),
        "payoff_ratio": F.when((F.col("wins") > 0) & (F.col("losses") > 0) & (loss != 0),
                               (F.col("gross_profit") / F.col("wins")) / (loss / F.col("losses"))),
        "sharpe_per_trade": F.when(F.col("pnl_stdev") != 0, avg / F.col("pnl_stdev")),
        "sortino_per_trade": F.when(F.col("_down") != 0, avg / F.col("_down"))}).drop("_down")


def human_duration(sec: Column) -> Column:
    """59m, 1.5h, 2.0d."""
    s = F.floor(sec)
    return (F.when(s < 3600, F.concat(F.floor(s / 60), F.lit("m"))).when(s < 86400, F.format_string("%.1fh", s / 3600))
            .otherwise(F.format_string("%.1fd", s / 86400)))


def performance_scores(trades: DataFrame, now: DataFrame, lookback_sec: int, min_trades=3, max_boost=1.5, min_mult=0.3) -> DataFrame:
    """Net and return on stake per symbol in the look-back, and the bounded rank multiplier."""
    x = trades.crossJoin(F.broadcast(now)).where(seconds("closed") >= seconds("now") - lookback_sec)
    g = x.groupBy("sym").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pnl"), 4).alias("net"),
                             F.sum(F.abs("qty") * F.col("entry")).alias("_stake"), F.sum("pnl").alias("_net"))
    g = g.withColumn("net_ratio", F.when(F.col("_stake") > 0, F.round(F.col("_net") / F.col("_stake"), 6)).otherwise(0.0)).drop("_stake", "_net")
    span = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("net_ratio") / 0.05))
    mult = F.when(F.col("n") < min_trades, 1.0).when(span >= 0, 1 + (max_boost - 1) * span).otherwise(1 + (1 - min_mult) * span)
    tier = F.when(F.col("n") < min_trades, "untested").when(F.col("net_ratio") >= 0, "winner").otherwise("loser")
    return g.withColumns({"mult": mult, "tier": tier})


def is_stop_exit() -> Column:
    """A losing stop or liquidation exit."""
    return F.lower("exit_reason").rlike("stop|liquidation") & (F.col("pnl") < 0)


def window_drops(v: np.ndarray, start: np.ndarray, stop: np.ndarray, frac: float) -> np.ndarray:
    """Does the running sum of `v[start:stop]`, from 0, ever lose the share `frac` of its peak so far (of 1e-9 at least)?

    With the share fixed a range is four numbers: its sum, best and worst prefix, and most of (1 - frac) * peak - sum. Two
    neighbours combine without a look at their rows, so ranges of 1, 2, 4, ... rows are tabled one size at a time, and every window adds up the
    sizes its length is made of: log(rows) passes over arrays for all windows. Beyond the whole peak the largest peak no longer
    decides, so all windows walk row by row, side by side.
    """
    if frac <= 0:
        return np.ones(len(start), bool)
    if frac > 1:
        total, peak, hit = (np.zeros(len(start), kind) for kind in (float, float, bool))
        for k in range(int((stop - start).max(initial=0))):
            live = np.flatnonzero(start + k < stop)
            total[live] += v[start[live] + k]
            peak = np.maximum(peak, total)
            hit |= peak - total >= frac * np.maximum(peak, 1e-9)
        return hit
    solid = np.flatnonzero(v != 0)
    nth = np.searchsorted(solid, start)
    first = np.append(solid, len(v))[nth]
    alive = first < stop
    out = np.zeros(len(start), bool)
    # a loss before any gain is unbounded against the least peak; after a gain the peak stays above 0
    out[alive] = v[first[alive]] <= -frac * 1e-9
    todo = np.flatnonzero(alive & ~out)
    at, left = first[todo], (stop - first)[todo]

    def joined(x, y):
        (s1, b1, c1, w1), (s2, b2, c2, w2) = x, y
        return np.stack([s1 + s2, np.maximum(b1, s1 + b2), np.minimum(c1, s1 + c2), np.maximum(np.maximum(w1, (1 - frac) * b1 - s1 - c2), w2 - frac * s1)])

    table, total, begun = np.stack([v, v, v, -frac * v]), np.zeros((4, len(todo))), np.zeros(len(todo), bool)
    width = 1
    while len(todo) and width <= left.max():
        odd = np.flatnonzero(left & width)
        own = table[:, at[odd]]
        total[:, odd] = np.where(begun[odd], joined(total[:, odd], own), own)
        begun[odd] = True
        at[odd] += width
        table = joined(table[:, : max(0, table.shape[1] - width)], table[:, width:])
        width *= 2
    out[todo] = total[3] >= -1e-9
    return out


def protection_locks(trades: DataFrame, stop_limit=4, stop_look=3600, stop_lock=3600, low_limit=3, low_look=86400,
                     low_required=0.0, low_lock=21600, dd_limit=10, dd_look=43200, dd_frac=0.10, dd_lock=7200) -> DataFrame:
    """Locks in force after each closing time of each product: lock_until and reason, global or per pair.

    A limit of 0 or less switches its lock off. Trades are summed per (product, closing time) first; look-back frames then run on time pieces
    of 30 days (the longest look-back, if that is longer), so a task holds the distinct closing times of two of them. The cumulative pnl
    of a window's closing times tells whether it lost the share `dd_frac` (`window_drops`).
    """
    base = F.abs(F.col("qty")) * F.col("entry")
    per = trades.groupBy("product", "closed").agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"), F.sum(base).alias("stake"),
                                                  F.sum(is_stop_exit().cast("int")).alias("stops"))

    def frame(keys, look):
        return W.partitionBy(*keys, "_piece").orderBy(F.unix_seconds("closed")).rangeBetween(-look, 0)

    pair = time_pieces(per, "closed", low_look, 30 * DAY)
    f = frame(["product"], low_look)
    pair = pair.withColumns({"pair_n": F.sum("n").over(f), "_p": F.sum("pnl").over(f), "_b": F.sum("stake").over(f)}).where(~F.col("_warm"))
    ratio = F.when(F.col("_b") > 0, F.col("_p") / F.col("_b")).otherwise(0.0)
    pair = pair.select("product", "closed", "pair_n", ratio.alias("pair_ratio"))
    allp = per.groupBy("closed").agg(F.sum("n").alias("n"), F.sum("pnl").alias("pnl"), F.sum("stops").alias("stops"))
    g = time_pieces(allp.select(micros("closed").alias("_us"), "closed", "n", "pnl", "stops"), "closed", max(stop_look, dd_look), 30 * DAY).drop("closed")

    def looked_back(pdf):
        pdf = pdf.assign(t=pdf["_us"] // 1_000_000).sort_values(["t", "pnl"], ignore_index=True)
        t, own = pdf["t"].to_numpy(), ~pdf["_warm"].to_numpy()
        end = np.searchsorted(t, t[own], side="right")

        def within(column, look):
            upto = np.concatenate([[0], np.cumsum(pdf[column].to_numpy())])
            return upto[end] - upto[np.searchsorted(t, t[own] - look)]

        dropped = window_drops(pdf["pnl"].to_numpy(float), np.searchsorted(t, t[own] - dd_look), end, dd_frac)
        return pd.DataFrame({"_us": pdf["_us"][own], "stop_n": within("stops", stop_look), "dd_n": within("n", dd_look), "dropped": dropped})

    g = g.groupBy("_piece").applyInPandas(looked_back, "_us long, stop_n long, dd_n long, dropped boolean")
    x = pair.withColumn("_us", micros("closed")).join(g, "_us").drop("_us")
    t = F.unix_seconds("closed")
    stop = F.lit(stop_limit > 0) & (F.col("stop_n") >= stop_limit)
    dd = F.lit(dd_limit > 0) & (F.col("dd_n") >= dd_limit) & F.col("dropped")
    low = F.lit(low_limit > 0) & (F.col("pair_n") >= low_limit) & (F.col("pair_ratio") < low_required)
    return x.withColumns({
        "global_until": F.greatest(F.when(stop, t + stop_lock), F.when(dd, t + dd_lock)),
        "pair_until": F.when(low, t + low_lock),
        "reason": F.when(dd, "MaxDrawdown").when(stop, "StoplossGuard").when(low, "LowProfitPairs")})


def trailing_count(df: DataFrame, ts: str, window_sec: int, keys=()) -> DataFrame:
    """Rows in the trailing window at each distinct time.

    The rows of a time come in at it and go out a microsecond after the window, so one running sum along both holds the
    count: a row is looked at twice, however many lie in a window. Rows without a time don't count.
    """
    keys = list(keys)
    per = df.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    moves = F.array(F.struct((micros(ts) + window_sec * 1_000_000 + 1).alias("_us"), F.lit(0).alias("_in"), (-F.col("_n")).alias("_n")),
                    F.struct(micros(ts).alias("_us"), F.lit(1).alias("_in"), F.col("_n")))
    x = per.select(*keys, ts, F.explode(moves).alias("_m")).select(*keys, ts, "_m.*")
    x = x.withColumns({"_day": F.floor(F.col("_us") / (DAY * 1_000_000)), "_hour": F.floor(F.col("_us") / (HOUR * 1_000_000))})
    x = running(x, ["_us", "_in"], [Run("n_trailing", "sum", "_n")], keys, ["_day", "_hour"])
    return x.where("_in = 1").select(*keys, ts, "n_trailing")


def equity_marks(trades: DataFrame, start_cash: float, ts="closed") -> DataFrame:
    """Equity after each closing time: pnl summed per time first, so the curve is bounded by time."""
    per = trades.groupBy(F.col(ts).alias("ts")).agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("n"),
                                                    F.sum((F.col("pnl") > 0).cast("int")).alias("wins"))
    return equity_path(per.withColumn("_day", time_chunk("ts", DAY)), "pnl", ["ts"], (), ["_day"], start_cash).drop("_day")


def risk_status(marks: DataFrame, kill=0.15, daily=0.05) -> DataFrame:
    """Drawdown from the peak, loss since the UTC day's first mark, first crossings of both limits."""
    x = marks.withColumn("_day", time_chunk("ts", DAY))
    w = W.partitionBy("_day").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("day_loss", 1 - F.col("equity") / F.first("equity").over(w))
    x = x.withColumns({"halted_today": F.max(F.col("day_loss") >= daily).over(w)})
    x = running(x, ["ts"], [Run("_ever", "max", (F.col("drawdown") >= kill).cast("int"), strict=True)], (), ["_day"])
    return x.withColumn("kill_tripped", (F.col("drawdown") >= kill) & (F.coalesce("_ever", F.lit(0)) == 0)).drop("_ever", "_day")


def loss_scale(trades: DataFrame, order, chunks=(), step: float = 0.2, least: float = 0.25) -> DataFrame:
    """Losses in a row up to each trade (pnl of 0 or less counts as one) and the risk scale they leave."""
    x = row_index(trades, order, (), chunks, "rn")
    x = running(x, order, [Run("_won", "max", F.when(F.col("pnl") > 0, F.col("rn")))], (), chunks)
    x = x.withColumn("consecutive_losses", F.col("rn") - F.coalesce("_won", F.lit(0)))
    return x.withColumn("risk_scale", F.greatest(F.lit(least), F.least(F.lit(1.0), 1 - step * F.col("consecutive_losses")))).drop("_won")


def risk_state(trend: Column, vol: Column, dd: Column, streak: Column) -> Column:
    """Regime x drawdown x loss-streak bucket."""
    return F.concat_ws("/", trend, vol, F.when(dd < 0.03, 0).when(dd < 0.08, 1).otherwise(2),
                       F.when(streak == 0, 0).when(streak <= 2, 1).otherwise(2))


def reward_table(marks: DataFrame, state: Column, scale: Column, chunks=()) -> DataFrame:
    """Mean shaped reward per (state, action), offline, from consecutive equity marks."""
    x = marks.withColumns({"state": state, "action": scale})
    x = running(x, ["ts"], [Run("_e", "last", "equity", strict=True), Run("_s", "last", "state", strict=True),
                            Run("_a", "last", "action", strict=True)], (), chunks)
    r = F.ln(F.col("equity") / F.col("_e")) * (0.15 + 0.85 * F.col("_a")) - 0.5 * F.greatest(F.lit(0.0), F.col("drawdown") - 0.05) * F.col("_a")
    return (x.where((F.col("_e") > 0) & (F.col("equity") > 0)).groupBy(F.col("_s").alias("state"), F.col("_a").alias("action"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean_reward")))


def decimate(df: DataFrame, order, points: int = 800, chunks=()) -> DataFrame:
    """At most `points` rows at even index steps, first and last kept."""
    from marketlab.operators.scans import group_index

    x = group_index(df, order, (), chunks, "_rn", "_n")
    r = F.col("_rn") - 1
    i = F.ceil(r * (points - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    keep = (F.col("_n") <= points) | ((i < points) & (F.floor(i * (F.col("_n") - 1) / (points - 1)) == r))
    return x.where(keep).drop("_rn", "_n")


def order_vwap(fills: DataFrame, orders: DataFrame, arrival: Sequence[str], ts: str = "ts", rows: int = SLICE_ROWS) -> DataFrame:
    """Fills once per exec_id, ignored after the order is full; VWAP, fees and status.

    `orders` has intent_id and order_qty; `arrival` starts with `ts`. The time line of an order with more than `rows` fills is cut
    into slices, each led by what the slices before it hold.
    """
    first = F.row_number().over(W.partitionBy("intent_id", "exec_id").orderBy(*arrival))
    once = fills.withColumn("_nth", first).where("_nth = 1").drop("_nth")
    bounds = time_slices(fills.select("intent_id", micros(ts).alias("_at")), ["intent_id"], rows)
    once = once.join(F.broadcast(bounds), _same(["intent_id"]), "left").withColumn("_slice", _slice_of(micros(ts)))
    totals = once.where(F.col("_bounds").isNotNull()).groupBy("intent_id", "_slice").agg(F.sum("qty").alias("_q"))
    ahead = F.sum("_q").over(W.partitionBy("intent_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    lead = totals.select("intent_id", "_slice", F.lit(0).alias("_own"), ahead.alias("_q"))
    line = once.drop("_bounds", "_h0").withColumns({"_own": F.lit(1), "_q": F.col("qty")}).unionByName(lead, allowMissingColumns=True)
    way = W.partitionBy("intent_id", "_slice").orderBy("_own", *arrival, "exec_id").rowsBetween(W.unboundedPreceding, -1)
    x = line.withColumn("_before", F.sum("_q").over(way)).where("_own = 1").drop("_own", "_q", "_slice").join(orders, "intent_id")
    x = x.where(F.coalesce("_before", F.lit(0.0)) + 1e-12 < F.col("order_qty"))
    g = x.groupBy("intent_id").agg(F.sum("qty").alias("filled_qty"), (F.sum(F.col("qty") * F.col("price")) / F.sum("qty")).alias("vwap"),
                                   F.sum("fee").alias("fees"), F.first("order_qty").alias("order_qty"), F.count(F.lit(1)).alias("n_fills"))
    return g.withColumn("status", F.when(F.col("filled_qty") + 1e-12 >= F.col("order_qty"), "FILLED").otherwise("PARTIAL")).drop("order_qty")


def reconcile(local: DataFrame, venue_open: DataFrame, filled: DataFrame) -> DataFrame:
    """Resolve local orders against the venue's open orders and fills; flag drift and strangers."""
    x = (local.join(venue_open.select("order_id", F.lit(True).alias("_open")), "order_id", "full_outer")
         .join(filled.select("order_id", "filled_qty"), "order_id", "left"))
    f, known, is_open = F.coalesce("filled_qty", F.lit(0.0)), F.col("status").isNotNull(), F.coalesce("_open", F.lit(False))
    full = f + 1e-12 >= F.col("qty")
    done = F.col("status").isin("FILLED", "CANCELED", "REJECTED")
    res = (F.when(~known, "VENUE_ONLY").when(done, F.col("status"))
           .when(f > 0, F.when(full, "FILLED").otherwise("PARTIAL"))
           .when(F.col("status") == "UNKNOWN", F.when(is_open, "OPEN").otherwise("CANCELED")).otherwise(F.col("status")))
    x = x.withColumn("resolved", res)
    drift = known & ~done & F.col("resolved").isin("OPEN", "PARTIAL") & ~is_open & (f < F.col("qty"))
    return x.withColumn("drift", drift).select("order_id", "status", "resolved", "drift")


def funding_cost(marks: DataFrame, rates: DataFrame, key="product", chunks=()) -> DataFrame:
    """Notional x 8-hour rate x time since the key's previous mark, rate as of the mark."""
    x = running(marks, ["ts", "event_id"], [Run("_prev", "last", "ts", strict=True)], [key], chunks)
    x = asof(x, rates, key, "ts", ["funding_rate"], tie=["rate_id"], name="_rate")
    hours8 = (seconds("ts") - seconds("_prev")) / (8 * 3600)
    return x.withColumn("funding", F.col("notional") * F.col("_rate.funding_rate") * hours8).drop("_prev", "_rate")


def ledger_balance(events: DataFrame, order, opening: float, keys=(), chunks=()) -> DataFrame:
    """Signed cash events once per event_id, and the balance after each."""
    cols = [c for c in events.columns if c != "event_id"]
    once = events.groupBy("event_id").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_e")).select("event_id", "_e.*")
    x = running(once, [*order, "event_id"], [Run("balance", "sum", "amount")], keys, chunks)
    return x.withColumn("balance", F.col("balance") + opening)


def reserve_cash(events: DataFrame, opening: float, keys, order, rows: int = FOLD_ROWS) -> DataFrame:
    """Debits are refused when the account cannot cover them; large accounts run in slices of about `rows` rows."""
    return sliced_fold(events, keys, order, ["amount"], ["balance", "applied"], (opening,), reservation_replay(), reservation_jump, rows)


def position_marks(positions: DataFrame, prices: DataFrame, key="product") -> DataFrame:
    """Positions valued at the newest price, or at entry where none is known."""
    x = positions.join(prices.select(key, F.col("price").alias("_mark")), key, "left")
    mark = F.coalesce("_mark", "entry")
    pnl = F.col("side") * (mark - F.col("entry")) * F.col("qty")
    return x.withColumns({"mark": mark, "value": F.abs("qty") * mark, "unrealized": pnl,
                          "unrealized_pct": F.when(F.col("entry") > 0, F.col("side") * (mark / F.col("entry") - 1))}).drop("_mark")


def stance(trades: DataFrame, order, context: DataFrame) -> DataFrame:
    """Risk appetite in [0, 1] from the last 20 trades and one context row with drawdown,
    consecutive_losses, drifting, vol_state and blackout."""
    last = trades.orderBy(*[F.col(c).desc() for c in order]).limit(20).agg(
        F.count(F.lit(1)).alias("recent"), F.avg((F.col("pnl") > 0).cast("double")).alias("recent_win_rate"), F.sum("pnl").alias("recent_pnl"))
    x = last.crossJoin(context)
    wr, pnl, dd = F.col("recent_win_rate"), F.col("recent_pnl"), F.col("drawdown")
    t = (F.lit(0.5) + F.when(F.col("recent") < 8, 0.0).when((wr >= 0.55) & (pnl > 0), 0.20).when((wr <= 0.35) | (pnl < 0), -0.15).otherwise(0.0)
         + F.when(dd > 0.05, -0.25).when(dd > 0.02, -0.10).otherwise(0.0) + F.when(F.col("consecutive_losses") >= 3, -0.15).otherwise(0.0)
         + F.when(F.col("drifting"), -0.15).otherwise(0.0) + F.when(F.col("vol_state") == "high-vol", -0.10).otherwise(0.0)
         + F.when(F.col("blackout"), -0.20).otherwise(0.0))
    x = x.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))
    return x.withColumn("label", F.when(F.col("score") < 0.35, "passive").when(F.col("score") > 0.65, "aggressive").otherwise("neutral"))


def equity_windows(marks: DataFrame, windows: dict[str, int], ts="ts", equity="equity") -> DataFrame:
    """(lookback, points, first_equity, last_equity) of the samples within each look-back of the newest one.

    Where fewer than two lie inside, the newest sample before the window joins them, if there is one. Samples without a time take no
    part; no samples give no rows. All windows come from one map-side combined pass.
    """
    m = marks.select(F.col(ts).alias("_t"), F.col(equity).alias("_e")).where("_t is not null")
    looks = F.array(*[F.struct(F.lit(k).alias("lookback"), F.lit(v).cast("bigint").alias("sec")) for k, v in windows.items()])
    x = m.crossJoin(F.broadcast(m.agg(F.max("_t").alias("_now")))).withColumn("w", F.explode(looks))
    inside = micros("_t") >= micros("_now") - F.col("w.sec") * 1_000_000
    x = x.groupBy("w.lookback").agg(
        F.count_if(inside).alias("_n"), F.min_by("_e", F.when(inside, F.col("_t"))).alias("_first"), F.max_by("_e", F.when(inside, F.col("_t"))).alias("_last"),
        F.max_by("_e", F.when(~inside, F.col("_t"))).alias("_prior"), F.count_if(~inside).alias("_earlier"))
    more = (F.col("_n") < 2) & (F.col("_earlier") > 0)
    return x.select("lookback", (F.col("_n") + more.cast("int")).alias("points"), F.when(more, F.col("_prior")).otherwise(F.col("_first")).alias("first_equity"),
                    F.col("_last").alias("last_equity"))
