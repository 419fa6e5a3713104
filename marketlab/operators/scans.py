"""Ordered scans over groups of any size.

A window without partitioning, or partitioned by a key that may hold a third of all rows, sorts
that group in one task. `running` cuts the ordered group into chunks instead: every chunk is
scanned by its own task, the chunk totals (a map-side combined aggregate) are scanned one level
up, and what came before a chunk is handed to it as one leading row. With several chunk columns, coarse
to fine, the totals are themselves scanned in chunks, so no level has to hold a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY, HOUR = 86400, 3600


def shared_folder(spark) -> str:
    """The folder `spark.checkpoint.dir` names; where it is unset, one in the warehouse, which all machines share as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def pin(df: DataFrame) -> DataFrame:
    """Materialise `df` once and cut its lineage, by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@dataclass(frozen=True)
class Run:
    """One running aggregate: `kind` is sum, max, min or last (last non-null value so far).

    `strict` leaves the current row out of its own result.
    """

    name: str
    kind: str
    value: Column | str
    strict: bool = False


def micros(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c)


def seconds(c) -> Column:
    """Epoch seconds as a double, microsecond resolution."""
    return micros(c) / F.lit(1e6)


def pick_levels(df: DataFrame, levels: Sequence[str], rows_per_task: int = 5_000_000) -> list[str]:
    """How many of the chunk columns (coarse to fine) an input needs, at least the first.

    Assumes the hottest coarse chunk may hold a third of all rows; finer chunks cost a fixed amount
    each, so small inputs do without. Pass a plain table scan: its row count comes from file footers.
    """
    return list(levels) if df.count() / 3 > rows_per_task else list(levels[:1])


def time_chunk(c, width_sec: int) -> Column:
    """Number of the `width_sec` wide time slice a timestamp falls into."""
    return F.floor(micros(c) / F.lit(width_sec * 1_000_000))


def _fold(run: Run, v, order: Column | None = None, reverse: bool = False, over=None):
    if run.kind == "last":
        if over is not None:
            return F.last(v, ignorenulls=True).over(over)
        return (F.min_by if reverse else F.max_by)(v, F.when(v.isNotNull(), order))
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[run.kind](v)
    return agg if over is None else agg.over(over)


def running(df: DataFrame, order: Sequence[str], runs: Sequence[Run], keys: Sequence[str] = (),
            chunks: Sequence[str] = (), reverse: bool = False) -> DataFrame:
    """Exact running aggregates along `order` within `keys`.

    `chunks` names columns, coarse to fine, that never decrease along `order`; with none given a
    plain window is used. `reverse` scans from the end. Ties in `order` are the caller's to break.
    What came before a chunk enters it as one extra leading row, so the rows themselves are shuffled
    once and never joined.
    """
    keys, chunks = list(keys), list(chunks)
    part = keys + chunks
    val = {r.name: (F.col(r.value) if isinstance(r.value, str) else r.value) for r in runs}
    ways = [(F.col(c).desc() if reverse else F.col(c).asc()) for c in order]
    base = W.partitionBy(*part) if part else W.partitionBy(F.lit(0))

    def over(run, spec):
        return spec.rowsBetween(W.unboundedPreceding, -1 if run.strict else 0)

    if not chunks:
        spec = base.orderBy(*ways)
        return df.select("*", *[_fold(r, val[r.name], over=over(r, spec)).alias(r.name) for r in runs])

    rank = F.struct(*order)
    totals = df.groupBy(*part).agg(*[_fold(r, val[r.name], rank, reverse).alias(f"_t_{r.name}") for r in runs])
    carry = running(totals, chunks, [Run(f"_c_{r.name}", r.kind, f"_t_{r.name}", strict=True) for r in runs],
                    keys, chunks[:-1], reverse)
    carry = carry.select(*part, F.lit(0).alias("_carried"), *[F.col(f"_c_{r.name}").alias(f"_v_{r.name}") for r in runs])
    data = df.select("*", F.lit(1).alias("_carried"), *[val[r.name].alias(f"_v_{r.name}") for r in runs])
    spec = base.orderBy(F.col("_carried"), *ways)
    both = data.unionByName(carry, allowMissingColumns=True)
    out = both.select("*", *[_fold(r, F.col(f"_v_{r.name}"), over=over(r, spec)).alias(f"_o_{r.name}") for r in runs])
    return out.where("_carried = 1").select(*df.columns, *[F.col(f"_o_{r.name}").alias(r.name) for r in runs])


def row_index(df: DataFrame, order, keys=(), chunks=(), name: str = "rn") -> DataFrame:
    """1-based position along `order` (a row_number that scales past one task per group)."""
    return running(df, order, [Run(name, "sum", F.lit(1).cast("bigint"))], keys, chunks)


def group_index(df: DataFrame, order, keys=(), chunks=(), name="rn", size="n_rows") -> DataFrame:
    """Position plus the size of the group, the latter from a pre-aggregated count."""
    keys = list(keys)
    if not keys:
        counts = df.agg(F.count(F.lit(1)).alias(size))
        return row_index(df, order, keys, chunks, name).crossJoin(F.broadcast(counts))
    return row_index(df, order, keys, chunks, name).join(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size)), keys)


def trailing_chunks(df: DataFrame, keys, ts: str, lookback: int, size: int = 100_000,
                    width_sec: int = DAY, tie: Sequence[str] = ()) -> DataFrame:
    """Cut each key's series into pieces of `size` rows, each led by `lookback` rows of warm-up.

    Any operator with frames of at most `lookback` trailing rows may then run with
    `keys + ["_piece"]` as its key; rows with `_warm` are dropped afterwards. Only the warm-up
    rows are doubled, so one long series becomes many window tasks.
    """
    rows = row_index(df.withColumn("_day", time_chunk(ts, width_sec)), [ts, *tie], keys, ["_day"], "_rn")
    piece = F.floor((F.col("_rn") - 1) / size)
    lead = (F.col("_rn") - 1) % size >= size - lookback
    both = F.when(lead, F.array(piece, piece + 1)).otherwise(F.array(piece))
    return (rows.withColumn("_own", piece).withColumn("_piece", F.explode(both))
            .withColumn("_warm", F.col("_piece") != F.col("_own")).drop("_day", "_own"))


def time_pieces(df: DataFrame, ts: str, lookback_sec: int, width_sec: int = DAY) -> DataFrame:
    """Cut a time line into pieces of `width_sec`, each led by the rows of the piece before it.

    RANGE frames of at most `lookback_sec` may then be partitioned by `_piece`; drop `_warm` rows after.
    """
    width = max(width_sec, lookback_sec)
    own = time_chunk(ts, width)
    return (df.withColumn("_own", own).withColumn("_piece", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
            .withColumn("_warm", F.col("_piece") != F.col("_own")).drop("_own"))
