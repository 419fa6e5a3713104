"""Folds with branches over series of any length, in slices that run at once.

A key's series is cut into time slices of about `rows` rows. Each slice is replayed from a guessed entering state and returns a
summary: its exit state and how the exit answers to another entering state as long as the branches taken stay the same. A short
pass over a key's summaries, one per slice, carries the states from slice to slice; slices whose entering state has moved are
replayed and the pass repeated. Every round settles at least the first unsettled slice of each key, and branches that bring
trajectories together (resets, rejections) settle most at once. Keys of a single slice need no round. At the end all slices
are replayed from their settled states, so the result is that of the plain fold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marketlab.operators.joins import _same, _slice_of, time_slices
from marketlab.operators.scans import micros, pin

FOLD_ROWS, CLOSE = 200_000, 1e-11


def sliced_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], outputs: Sequence[str], start: Sequence[float],
                replay: Callable, predict: Callable, rows: int = FOLD_ROWS, starts: DataFrame | None = None) -> DataFrame:
    """`df` with double `outputs` of a fold along `order`, whose first column is a time or an integer.

    Keys listed in `starts` (keys, `state`) begin with their own state instead of `start`.

    `replay(state, *columns)` returns the outputs, the entering state it amounts to, the exit state and a list of numbers, the
    jump; `predict(used, exit, jump, state)` is the exit state if the slice is entered with `state` instead of `used`.
    """
    keys, order, names = list(keys), list(order), df.columns
    stamp = dict(df.dtypes)[order[0]]
    at = micros(order[0]) if stamp.startswith("timestamp") else F.col(order[0]).cast("bigint")
    bounds = pin(time_slices(df.select(*keys, at.alias("_at")), keys, rows))
    cut = df.join(F.broadcast(bounds), _same(keys), "left").withColumn("_slice", _slice_of(at))
    data = cut.withColumn("_hot", F.col("_bounds").isNotNull()).drop("_bounds", *[f"_h{i}" for i in range(len(keys))])
    hot = bounds.select(*[F.col(f"_h{i}").alias(k) for i, k in enumerate(keys)]).count()
    part = [*keys, "_slice"]
    numbers = "array<double>"
    named = ", ".join(f"`{c}` {t}" for c, t in data.select(*part).dtypes)

    def states(df):
        return df.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(part)], "state").groupBy(*[f"_g{i}" for i in range(len(part))])

    def columns(table):
        table = table.sort_by([(c, "ascending") for c in order])
        return table, [table[c].to_numpy(zero_copy_only=False).astype(float) for c in inputs]

    def heads(table, n=1):
        return {c: table[c].slice(0, n) for c in part}

    def summarise(table, entering):
        if not table.num_rows or not entering.num_rows:
            return empty
        _, used, ends, jump = replay(entering["state"][0].as_py(), *columns(table)[1])
        return pa.table({**heads(table), "used": [used], "ends": [ends], "jump": [jump]}, schema=summary)

    fields = data.select(*part).schema
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "date": pa.date32(), "double": pa.float64()}
    listed = pa.list_(pa.float64())
    nothing = to_arrow_schema(T.StructType([*df.schema.fields, *[T.StructField(o, T.DoubleType()) for o in outputs]])).empty_table()
    summary = pa.schema([*((f.name, arrow[f.dataType.simpleString()]) for f in fields), ("used", listed), ("ends", listed), ("jump", listed)])
    empty = summary.empty_table()

    def settle(pdf):
        pdf = pdf.sort_values("_slice")
        state, states, moved = list(start), [], []
        for i, (used, ends, jump) in enumerate(zip(pdf["used"], pdf["ends"], pdf["jump"], strict=True)):
            used, ends = list(used), list(ends)
            # the first slice was entered with the true start, whatever it amounts to
            same = i == 0 or all(abs(a - b) <= CLOSE * (1 + abs(a)) for a, b in zip(state, used, strict=True))
            states.append(used if i == 0 else state)
            moved.append(not same)
            state = ends if i == 0 else list(predict(used, ends, list(jump), state))
        return pdf[part].assign(state=states, moved=moved)

    default = F.array(*[F.lit(float(x)) for x in start])
    own = starts if starts is not None else data.limit(0).select(*keys).withColumn("state", F.array().cast(numbers))
    own = own.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.col("state").alias("_own"))
    named_hot = bounds.select(*[F.col(f"_h{i}").alias(k) for i, k in enumerate(keys)])
    entering = own.join(F.broadcast(named_hot), _same(keys), "left_anti").select(
        *[F.col(f"_h{i}").alias(k) for i, k in enumerate(keys)], F.lit(0).alias("_slice"), F.col("_own").alias("state"))
    if hot:
        narrow = pin(data.where("_hot").select(*dict.fromkeys([*part, *order, *inputs])))
        todo = narrow.select(*part).distinct().join(own, _same(keys), "left").select(*part, F.coalesce("_own", default).alias("state"))
        known = None
        while True:
            fresh = narrow.join(F.broadcast(todo.select(*part)), part, "left_semi").groupBy(*part).cogroup(states(todo)).applyInArrow(
                summarise, f"{named}, used {numbers}, ends {numbers}, jump {numbers}")
            known = pin(fresh if known is None else known.join(F.broadcast(todo.select(*part)), part, "left_anti").unionByName(fresh))
            settled = pin(known.groupBy(*keys).applyInPandas(settle, f"{named}, state {numbers}, moved boolean"))
            todo = settled.where("moved").select(*part, "state")
            if todo.isEmpty():
                break
        entering = entering.unionByName(settled.drop("moved"))
    schema = ", ".join(f"`{c}` {t}" for c, t in [*df.dtypes, *[(o, "double") for o in outputs]])

    def finish(table, entered):
        if not table.num_rows:
            return nothing
        table, cols = columns(table)
        outs = replay(entered["state"][0].as_py() if entered.num_rows else list(start), *cols)[0]
        table = table.select(names)
        for name, x in zip(outputs, outs, strict=True):
            table = table.append_column(name, pa.array(x, pa.float64(), from_pandas=True))
        return table

    return data.drop("_hot").groupBy(*part).cogroup(states(entering)).applyInArrow(finish, schema)


def page_hinkley_replay(delta: float, lam: float, alpha: float) -> Callable:
    """Replay of state (seen, mean, cum, low), which follows the outputs; rows without an error leave the state as it is."""
    size = max(1, min(4096, int(8 / -np.log10(alpha)))) if alpha < 1 else 4096
    powers = alpha ** np.arange(1, size + 1)

    def replay(state, error):
        ok = ~np.isnan(error)
        e = error[ok]
        seen, mean, cum, low = state
        if not seen and len(e):
            seen, mean = 1.0, float(e[0])
        used, n = [seen, mean, cum, low], len(e)
        d, level = np.empty(n), np.empty(n)
        for a in range(0, n, size):
            p = powers[: min(size, n - a)]
            means = p * (mean + (1 - alpha) * np.cumsum(e[a: a + size] / p))
            d[a: a + size], level[a: a + size] = e[a: a + size] - means - delta, means
            mean = float(means[-1])
        stat, hit, sums, floors = np.empty(n), np.zeros(n), np.zeros(n), np.zeros(n)
        at, step, reset, least, where = 0, 64, -1, np.inf, 0
        while at < n:
            p = powers[: min(step, size, n - at)]
            x = p * (cum + np.cumsum(d[at: at + len(p)] / p))
            lows = np.minimum(np.minimum.accumulate(x), low)
            s = x - lows
            over = np.flatnonzero(s > lam)
            if len(over):
                j = int(over[0])
                stat[at: at + j + 1], sums[at: at + j], floors[at: at + j] = s[: j + 1], x[:j], lows[:j]
                hit[at + j] = 1.0
                at, step, cum, low, least, where = at + j + 1, 64, 0.0, 0.0, np.inf, 0
                reset = at
                continue
            stat[at: at + len(p)], sums[at: at + len(p)], floors[at: at + len(p)] = s, x, lows
            i = int(np.argmin(x))
            if x[i] < least:
                least, where = float(x[i]), at + i + 1
            cum, low, at, step = float(x[-1]), float(lows[-1]), at + len(p), min(2 * step, size)
        whole, since = float(alpha ** n), max(reset, 0)
        jump = [float(reset >= 0), whole, -(n - since) * whole, least if np.isfinite(least) else 1e300, float(alpha ** where), -(where - since) * float(alpha ** where)]
        out = np.full((6, len(error)), np.nan)
        out[:, ok] = stat, hit, np.ones(n), level, sums, floors
        return out, used, [seen, mean, cum, low], jump

    return replay


def page_hinkley_jump(used, ends, jump, state) -> list[float]:
    """Mean, sum and lowest sum are linear in the entering mean and sum until a reset; a reset forgets the entering sums."""
    hit, whole, by_mean, least, least_by_cum, least_by_mean = jump
    dm, dc = state[1] - used[1], state[2] - used[2]
    mean = ends[1] + whole * dm
    if hit:
        return [1.0, mean, ends[2] + by_mean * dm, min(0.0, least + least_by_mean * dm)]
    return [1.0, mean, ends[2] + whole * dc + by_mean * dm, min(state[3], least + least_by_cum * dc + least_by_mean * dm)]


def reservation_replay(slack: float = 1e-9) -> Callable:
    """Replay of a balance that refuses debits beyond it; the jump is the range of shifts that changes no refusal."""
    def replay(state, amount):
        a = np.nan_to_num(amount)
        balance, n = state[0], len(a)
        held, applied = np.empty(n), np.ones(n)
        at, step, down, up = 0, 64, -np.inf, np.inf
        while at < n:
            x = np.cumsum(np.concatenate([[balance], a[at: at + step]]))
            debit = a[at: at + step] < 0
            bad = np.flatnonzero(debit & (x[:-1] + slack < -a[at: at + step]))
            j = int(bad[0]) if len(bad) else len(x) - 1
            held[at: at + j] = x[1: j + 1]
            kept = np.flatnonzero(debit[:j])
            if len(kept):
                down = max(down, float(-(x[kept + 1] + slack).min()))
            balance = float(x[j])
            if len(bad):
                held[at + j], applied[at + j] = balance, 0.0
                up = min(up, float(-a[at + j] - slack - balance))
                j += 1
            at, step = at + j, 64 if len(bad) else min(2 * step, 1 << 16)
        return np.stack([held, applied]), list(state), [balance], [down if np.isfinite(down) else -1e300, up if np.isfinite(up) else 1e300]

    return replay


def reservation_jump(used, ends, jump, state) -> list[float]:
    shift = state[0] - used[0]
    return [ends[0] + shift] if jump[0] <= shift < jump[1] else [ends[0]]
