"""Recurrences along a series.

Linear recurrences (`decayed`) are solved piecewise with running sums and so stay in the JVM.
Recurrences with branches (`fold_rows`) need one pass
in order: rows are hash partitioned by key, sorted by Spark and streamed batch by batch through a
small step function, so memory does not grow with the length of a series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def decayed(df: DataFrame, terms: dict[str, tuple[Column, float]], keys="product", rn: str = "rn") -> DataFrame:
    """y[t] = q * y[t-1] + x[t] with y[0] = x[0], for each named (x, q); `rn` is the 1-based position.

    A term's series is cut where q^len falls below 1e-18. Inside a piece y is q^p times a running
    sum of x * q^-p, whose terms grow and so lose no precision; of what came before a piece only
    the end of the piece right before it still counts. All terms share the one partitioning by key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = W.partitionBy(*keys).orderBy(rn)
    out = df
    for name, (x, q) in terms.items():
        size = math.ceil(18 / -math.log10(q))
        pc, pos = F.floor((F.col(rn) - 1) / size), (F.col(rn) - 1) % size
        out = out.withColumns({"_pc": pc, "_q": F.pow(F.lit(q), pos)})
        run = W.partitionBy(*keys, "_pc").orderBy(rn).rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumn("_l", F.col("_q") * F.sum(x / F.col("_q")).over(run))
        end = F.last(F.when(pos == size - 1, F.col("_l")), ignorenulls=True).over(
            order.rowsBetween(W.unboundedPreceding, -1))
        out = out.withColumn(name, F.col("_l") + F.coalesce(end, F.lit(0.0)) * F.col("_q") * q)
    return out.drop("_pc", "_q", "_l")


def ema_series(bars: DataFrame, c: str, spans: dict[str, int], keys="product", ts="ts") -> DataFrame:
    """Full-history EMA seeded with the first value."""
    part = [keys] if isinstance(keys, str) else list(keys)
    x = bars.withColumn("_n", F.row_number().over(W.partitionBy(*part).orderBy(ts)))
    first = F.col("_n") == 1
    return decayed(x, {name: (F.when(first, F.col(c)).otherwise(F.col(c) * (2 / (n + 1))), 1 - 2 / (n + 1))
                       for name, n in spans.items()}, part, "_n").drop("_n")


def wilder_rsi(bars: DataFrame, c="close", n: int = 14, keys="product", ts="ts", name="rsi_wilder") -> DataFrame:
    """Wilder RSI over the whole series, 50 until n changes are known."""
    part = [keys] if isinstance(keys, str) else list(keys)
    w = W.partitionBy(*part).orderBy(ts)
    x = bars.withColumns({"_n": F.row_number().over(w), "_d": F.col(c) - F.lag(c).over(w)})
    x = x.withColumns({"_g": F.greatest(F.col("_d"), F.lit(0.0)), "_s": F.greatest(-F.col("_d"), F.lit(0.0))})
    seed = w.rowsBetween(-(n - 1), 0)

    def term(v):
        return (F.when(F.col("_n") == n + 1, F.avg(v).over(seed))
                .when(F.col("_n") > n + 1, F.col(v) / n).otherwise(0.0))

    x = x.withColumns({"_tg": term("_g"), "_ts": term("_s")})
    x = decayed(x, {"_ag": (F.col("_tg"), 1 - 1 / n), "_al": (F.col("_ts"), 1 - 1 / n)}, part, "_n")
    rs = F.when(F.col("_al") > 1e-12, F.col("_ag") / F.col("_al")).otherwise(999.0)
    return (x.withColumn(name, F.when(F.col("_n") > n, 100 - 100 / (1 + rs)).otherwise(50.0))
            .drop("_n", "_d", "_g", "_s", "_tg", "_ts", "_ag", "_al"))


def fold_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], object],
              step: Callable, inputs: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """`state, out = step(state, *inputs)` over every row in order; adds double `outputs`."""
    keys, inputs, outputs = list(keys), list(inputs), list(outputs)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
                       + [f"`{o}` double" for o in outputs])

    def run(batches):
        key, state = None, None
        for pdf in batches:
            cols = [pdf[c].tolist() for c in inputs]
            ids = list(zip(*[pdf[k].tolist() for k in keys])) if keys else [()] * len(pdf)
            rows = []
            for i, this in enumerate(ids):
                if state is None or this != key:
                    key, state = this, start()
                state, res = step(state, *[c[i] for c in cols])
                rows.append(res)
            yield pdf.assign(**dict(pd.DataFrame(rows, columns=outputs, index=pdf.index, dtype="float64")))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def fold_scalar(df: DataFrame, keys, order: Sequence[str], fields: Sequence[str], zero: Column,
                merge: Callable, finish: Callable | None = None, name="state") -> DataFrame:
    """One result per key from a list folded in order, inside the JVM.

    The list holds a whole group, so feed it rows already aggregated to a bounded grain (cycles, days).
    """
    item = F.struct(*order, *[f for f in fields if f not in order])
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_xs"))
    return lists.select(*keys, F.aggregate("_xs", zero, merge, finish).alias(name) if finish
                        else F.aggregate("_xs", zero, merge).alias(name))
