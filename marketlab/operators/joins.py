"""Time joins: as-of, nearest, interval, first touch, range extremes and the skyline anti-join.

`probed` puts both sides on one time line and carries right rows to left rows in both directions. Several probes (before, after,
at a horizon) share one exchange: the right rows are moved by each probe's offset, the left rows stay whole and occur once. Keys
with many rows are cut into time slices by a quantile sketch of their own times, so neither a hot key nor a busy day is one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlab.operators.scans import micros, pin, time_chunk

SLICE_ROWS, FINEST = 1_000_000, 1024


def as_list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


@dataclass(frozen=True)
class Probe:
    """What a left row looks up once the right rows are moved back by `offset` (seconds, or a column of the right rows).

    The last right row before it, or with `forward` the first one after it; equal times count unless `strict`. Among equal times a
    backward probe takes the last in tie order, with `first` the first, as forward probes do. `largest` names a payload
    column whose running maximum is wanted instead of a row.
    """

    name: str
    offset: int | Column = 0
    forward: bool = False
    strict: bool = False
    largest: str | None = None


def time_slices(times: DataFrame, keys: Sequence[str], rows: int = SLICE_ROWS) -> DataFrame:
    """Slice bounds `_bounds` of the keys with more than `rows` rows in `times` (keys, `_at`), about `rows` between two bounds.

    At most one key in `rows` rows is listed, and one bound in `rows` rows in all, so the table is small whatever the
    input. A key has at most FINEST slices; rows of one instant stay together.
    """
    hot = times.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    named = hot.withColumnsRenamed({k: f"_h{i}" for i, k in enumerate(keys)})
    same = _same(keys)
    cuts = [i / FINEST for i in range(1, FINEST)]
    sketch = times.join(F.broadcast(named), same).groupBy(*keys).agg(F.max("_n").alias("_n"), F.percentile_approx("_at", cuts, 20_000).alias("_q"))
    step = F.greatest(F.lit(1), F.floor(F.lit(FINEST * rows) / F.col("_n"))).cast("int")
    return sketch.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)],
                         F.array_distinct(F.filter("_q", lambda q, i: (i + 1) % step == 0)).alias("_bounds"))


def _same(keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_h{i}"))
    return on


def _slice_of(at: Column) -> Column:
    """Number of bounds at or below `at`, by halving."""
    steps = F.array(*[F.lit(FINEST >> k) for k in range(1, FINEST.bit_length())])
    found = F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= F.size("_bounds")) & (F.get(F.col("_bounds"), lo + s - 1) <= at), lo + s).otherwise(lo))
    return F.when(F.col("_bounds").isNull() | at.isNull(), 0).otherwise(found)


def probed(left: DataFrame, right: DataFrame, probes: Sequence[Probe], key="product", ts: str = "ts", payload: Sequence[str] = (),
           tie: Sequence[str] = (), first: bool = False, rows: int = SLICE_ROWS) -> DataFrame:
    """`left` with one column a probe: the right row found, as struct of its time `ts` and `payload`, or the largest value.

    One exchange by key and slice, two sorts of it. What lies before and after a slice enters it as one leading row, made from the
    slices' totals; without hot keys there are none, and nothing is read for them. Rows without a time find nothing.
    """
    keys = as_list(key)
    payload = [c for c in payload if c not in ("ts", ts)]
    ties = [f"_tie{i}" for i in range(len(tie))]
    places, copy_of = [], []
    for p in probes:
        place = (p.offset, 2 if p.forward != p.strict else 0)
        same = [i for i, x in enumerate(places) if x[1] == place[1] and (x[0] is place[0] or isinstance(x[0], int) and isinstance(place[0], int) and x[0] == place[0])]
        copy_of.append(same[0] if same else len(places))
        places += [] if same else [place]

    def copy(i, offset, side):
        away = F.lit(offset) if isinstance(offset, int) else offset
        return F.struct(F.lit(i).alias("_copy"), (micros(ts) - away.cast("bigint") * 1_000_000).alias("_at"), F.lit(side).alias("_side"))

    r = right.where(F.col(ts).isNotNull()).select(
        *keys, F.struct(F.col(ts).alias("ts"), *payload).alias("_hit"), *[F.col(c).alias(a) for c, a in zip(tie, ties)],
        F.explode(F.array(*[copy(i, *x) for i, x in enumerate(places)])).alias("_m")).select(*keys, "_hit", *ties, "_m.*")
    lt = left.select(*keys, micros(ts).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = lt.unionByName(r, allowMissingColumns=True)
    bounds = time_slices(lt.select(*keys, "_at").unionAll(right.select(*keys, micros(ts).alias("_at"))), keys, rows)
    both = both.join(F.broadcast(bounds), _same(keys), "left").withColumn("_slice", _slice_of(F.col("_at")))
    part = [*keys, "_slice"]
    drops = ["_bounds", *[f"_h{i}" for i in range(len(keys))]]

    def value(i, p):
        hit = F.when(F.col("_copy") == copy_of[i], F.col("_hit"))
        return hit[p.largest] if p.largest else hit

    def total(i, p):
        v = value(i, p)
        if p.largest:
            return F.max(v)
        rank = F.struct(F.col("_at") if p.forward or not first else -F.col("_at"), *ties)
        return (F.min_by if p.forward or first else F.max_by)(v, F.when(v.isNotNull(), rank))

    totals = both.where(F.col("_bounds").isNotNull()).groupBy(*part).agg(*[total(i, p).alias(f"_t{i}") for i, p in enumerate(probes)])
    ahead = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)

    def carried(i, p):
        return (F.max(f"_t{i}") if p.largest else F.last(f"_t{i}", ignorenulls=True)).over(behind if p.forward else ahead)

    lead = totals.select(*part, F.lit(0).alias("_own"), *[carried(i, p).alias(f"_v{i}") for i, p in enumerate(probes)])
    data = both.drop(*drops).select("*", F.lit(1).alias("_own"), *[value(i, p).alias(f"_v{i}") for i, p in enumerate(probes)])
    line = data.unionByName(lead, allowMissingColumns=True)

    def order(back, down):
        way = (lambda c: F.col(c).desc()) if back else (lambda c: F.col(c).asc())
        return W.partitionBy(*part).orderBy("_own", way("_at"), way("_side"), *[F.col(c).desc() if down else F.col(c).asc() for c in ties]).rowsBetween(
            W.unboundedPreceding, 0)
    up, back = order(False, first), order(True, True)
    found = [(F.max(f"_v{i}") if p.largest else F.last(f"_v{i}", ignorenulls=True)).over(back if p.forward else up) for i, p in enumerate(probes)]
    out = line.select("_row", "_side", "_at", "_own", *[f.alias(p.name) for f, p in zip(found, probes)])
    return out.where("_own = 1 and _side = 1").select("_row.*", *[F.when(F.col("_at").isNotNull(), F.col(p.name)).alias(p.name) for p in probes])


def asof(left: DataFrame, right: DataFrame, key="product", ts: str = "ts", payload: Sequence[str] = (), tie: Sequence[str] = (), forward: bool = False,
         strict: bool = False, offset: int | Column = 0, rows: int = SLICE_ROWS, name: str = "match") -> DataFrame:
    """The last right row at or before left `ts` + `offset` seconds per key, as struct `name`.

    `forward` takes the first one at or after instead; `strict` excludes equal times; `tie` orders right rows of equal time.
    """
    return probed(left, right, [Probe(name, offset, forward, strict)], key, ts, payload, tie, rows=rows)


def nearest(left: DataFrame, right: DataFrame, tolerance_sec: float, key="product", ts: str = "ts", payload: Sequence[str] = (), tie: Sequence[str] = (),
            offsets: dict[str, int] | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    """The right row nearest to `ts` + offset, strictly closer than the tolerance; the earlier one on ties.

    `offsets` names each result (`match` at 0 by default); all are found in one pass.
    """
    offsets = offsets or {"match": 0}
    cols = [c for c in payload if c not in ("ts", ts)]
    probes = [Probe(f"_{way}_{n}", o, way == "f", way == "f") for n, o in offsets.items() for way in "bf"]
    x = probed(left, right, probes, key, ts, cols, tie or cols, first=True, rows=rows)

    def best(n, o):
        t = micros(ts) + o * 1_000_000
        b, f = F.col(f"_b_{n}"), F.col(f"_f_{n}")
        db, df = t - micros(b["ts"]), micros(f["ts"]) - t
        return F.when(F.least(db, df) < int(tolerance_sec * 1e6), F.when(f.isNull() | (db <= df), b).otherwise(f))

    return x.withColumns({n: best(n, o) for n, o in offsets.items()}).drop(*[p.name for p in probes])


def horizon_return(left: DataFrame, prices: DataFrame, horizon_sec: int, key="product", ts="ts", price="close", rows: int = SLICE_ROWS) -> DataFrame:
    """Price at or before `ts`, first price at or after `ts` + horizon, and the return between."""
    x = probed(left, prices, [Probe("_p0"), Probe("_p1", horizon_sec, forward=True)], key, ts, [price], rows=rows)
    p0, p1 = F.col(f"_p0.{price}"), F.col(f"_p1.{price}")
    return (x.withColumns({"p0": p0, "p1": p1, "ret": F.when(p0 > 0, p1 / p0 - 1)}).drop("_p0", "_p1"))


def in_windows(left: DataFrame, events: DataFrame, before: Column, after: Column, ts="ts", rows: int = SLICE_ROWS,
               names=("blackout", "next_event")) -> DataFrame:
    """Is `ts` inside [event - before, event + after] of any event, and when is the next event?

    A time is covered exactly when the latest end among the windows opened so far is not yet past, so a running maximum over the
    events moved to their openings replaces the range join; the next event comes from the same pass.
    """
    flag, nxt = names
    e = events.select(F.lit(0).alias("_all"), ts, before.cast("bigint").alias("_before"), (micros(ts) + after.cast("bigint") * 1_000_000).alias("_end"))
    x = probed(left.withColumn("_all", F.lit(0)), e, [Probe("_open", F.col("_before"), largest="_end"), Probe("_next", forward=True, strict=True)],
               "_all", ts, ["_end"], rows=rows)
    return x.withColumns({flag: F.coalesce(F.col("_open") >= micros(ts), F.lit(False)), nxt: F.col("_next.ts")}).drop("_all", "_open", "_next")


def cooldown(entries: DataFrame, exits: DataFrame, seconds: int, key="product", ts: str = "ts", rows: int = SLICE_ROWS // 4) -> DataFrame:
    """Each entry with its key's last exit at or before it (`last_exit`, null if none) and whether less than `seconds` have passed (`cooling`).

    Times are in the column `ts` of both sides; nulls there find no exit and don't cool. Only the time of an exit counts, so exits of
    one key and time are one row.
    """
    x = asof(entries, exits.select(*as_list(key), ts).distinct(), key, ts, rows=rows, name="_exit")
    since = micros(ts) - micros("_exit.ts")
    return x.withColumns({"last_exit": F.col("_exit.ts"), "cooling": F.coalesce(since < seconds * 1_000_000, F.lit(False))}).drop("_exit")


def first_touch(entries: DataFrame, bars: DataFrame, horizon_sec: int, entry_id="entry_id", key="product",
                ts="ts", slip: float = 0.0) -> DataFrame:
    """First later bar within the horizon that hits the stop or the take, the stop first when a
    bar hits both; unresolved entries leave at the last close in the horizon.

    Entries carry side, price, stop and take. Bars are matched by horizon-wide time slices, and only
    touching pairs leave the join.
    """
    h = horizon_sec
    e = entries.select(entry_id, key, F.col(ts).alias("_t0"), "side", "price", "stop", "take")
    e = e.withColumn("_b", F.explode(F.array(time_chunk("_t0", h), time_chunk("_t0", h) + 1)))
    b = bars.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), "high", "low", time_chunk(ts, h).alias("_bb"))
    stop_hit = F.when(F.col("side") > 0, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    take_hit = F.when(F.col("side") > 0, F.col("high") >= F.col("take")).otherwise(F.col("low") <= F.col("take"))
    lag = micros("_t") - micros("_t0")
    on = ((F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_bb")) & (lag > 0) & (lag <= h * 1_000_000)
          & (stop_hit | take_hit))
    hits = e.join(b, on).groupBy(entry_id).agg(
        F.min_by(F.struct(F.col("_t").alias("exit_ts"), F.when(stop_hit, "stop").otherwise("take").alias("exit_kind")),
                 "_t").alias("_h"))
    x = entries.join(hits, entry_id, "left")
    x = asof(x, bars, key, ts, ["close"], offset=h, name="_last")
    kind = F.coalesce(F.col("_h.exit_kind"), F.lit("open"))
    level = F.when(kind == "stop", F.col("stop")).when(kind == "take", F.col("take"))
    px = F.when(level.isNotNull(), level * (1 - F.col("side") * slip)).otherwise(F.col("_last.close"))
    return (x.withColumns({"exit_kind": kind, "exit_ts": F.coalesce(F.col("_h.exit_ts"), F.col("_last.ts")),
                           "exit_price": px, "ret": F.col("side") * (px / F.col("price") - 1)}).drop("_h", "_last"))


def range_extremes(spans: DataFrame, bars: DataFrame, slot_sec: int, key="product", start="opened", end="closed",
                   per_slice: int = 24) -> DataFrame:
    """Lowest low and highest high of the bars between two times.

    Spans are first reduced to distinct (key, first slot, last slot), a number bounded by time and
    not by rows; each meets the bars of the time slices it crosses.
    """
    x = spans.withColumns({"_s0": -time_chunk(F.timestamp_micros(-micros(start)), slot_sec), "_s1": time_chunk(end, slot_sec)})
    q = x.select(key, "_s0", "_s1").distinct().withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("_s0") / per_slice), F.greatest(F.floor(F.col("_s0") / per_slice),
                                                                                F.floor(F.col("_s1") / per_slice)))))
    b = bars.select(key, "low", "high", time_chunk("ts", slot_sec).alias("_slot")).withColumn(
        "_b", F.floor(F.col("_slot") / per_slice))
    agg = (q.join(b, [key, "_b"]).where("_slot between _s0 and _s1").groupBy(key, "_s0", "_s1")
           .agg(F.min("low").alias("lowest"), F.max("high").alias("highest")))
    return x.join(agg, [key, "_s0", "_s1"], "left").drop("_s0", "_s1")


def pair_bars(bars: DataFrame, key="product", ts="ts", price="close") -> DataFrame:
    """Aligned closes of every product pair a < b. The universe of products is small by nature
    (tens); the rows grow with bars times partners per bar."""
    a = bars.select(ts, F.col(key).alias("a"), F.col(price).alias("ca"))
    b = bars.select(ts, F.col(key).alias("b"), F.col(price).alias("cb"))
    return a.join(b, ts).where(F.col("a") < F.col("b"))


def pareto_prune(cands: DataFrame, objs: Sequence[str]) -> DataFrame:
    """Drop rows dominated by another row of the same partition: exact, and needs no shuffle."""
    objs = list(objs)

    def run(batches):
        for pdf in batches:
            v = pdf[objs].to_numpy(dtype="float64")
            keep = np.ones(len(v), dtype=bool)
            for i in np.argsort(-v.sum(axis=1)):
                if keep[i]:
                    dominated = (v <= v[i]).all(axis=1) & (v < v[i]).any(axis=1)
                    keep &= ~dominated
            yield pdf[keep]

    return cands.mapInPandas(run, cands.schema)


def skyline(df: DataFrame, ids: str, objs: Sequence[str], block: int = 20_000) -> DataFrame:
    """Rows no other row dominates (>= on all objectives, > on one).

    Local pruning leaves few candidates; they are then compared block by block, one equi-join on
    the block number, so no side is broadcast whatever its size.
    """
    c = pin(pareto_prune(df.select(ids, *objs), objs))
    m = max(1, -(-c.count() // block))
    a = c.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    b = c.select(*[F.col(o).alias(f"_o_{o}") for o in objs], F.pmod(F.xxhash64(ids), F.lit(m)).cast("int").alias("_b"))
    ge, gt = F.lit(True), F.lit(False)
    for o in objs:
        ge = ge & (F.col(f"_o_{o}") >= F.col(o))
        gt = gt | (F.col(f"_o_{o}") > F.col(o))
    lost = a.join(b, "_b").where(ge & gt).select(ids).distinct()
    return df.join(c.select(ids), ids, "left_semi").join(lost, ids, "left_anti")


def pareto_ranks(df: DataFrame, ids: str, objs: Sequence[str], fronts: int) -> DataFrame:
    """Peel up to `fronts` fronts; what is left keeps a null front."""
    rest, out = df, None
    for k in range(1, fronts + 1):
        top = skyline(rest, ids, objs).withColumn("front", F.lit(k))
        top = pin(top)
        out = top if out is None else out.unionByName(top)
        rest = pin(rest.join(top.select(ids), ids, "left_anti"))
        if rest.isEmpty():
            return out
    return out.unionByName(rest.withColumn("front", F.lit(None).cast("int")))


def newest_only(df: DataFrame, cols: Sequence[str], key="product", ts="ts") -> DataFrame:
    """Keep context columns on each key's newest row only, null elsewhere (no back-fill)."""
    newest = df.groupBy(key).agg(F.max(ts).alias("_newest"))
    x = df.join(newest, key)
    return x.withColumns({c: F.when(F.col(ts) == F.col("_newest"), F.col(c)) for c in cols}).drop("_newest")
