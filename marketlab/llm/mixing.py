"""Operator 6: mixing sources to target weights by systematic sampling.

Sources get targets by weight, filled up like vessels: no target passes `most` times its source's size, and the excess goes
to the others by weight. Every document of a source has the same expected copies, target / source size. Along an order by
size, the prefix sums of the expected copies plus one offset per source cross integers; each crossing emits one copy. The
order spreads the copies over all sizes, so what a source takes differs from its target by about its largest document.

Null texts have size 0; a source without words has target 0; null sources form one, last source; rows with equal id and
size in a source are interchangeable; the offset is a hash of the source, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import load, query, word_count, written
from marketlab.operators import scans
from marketlab.operators.scans import Run

WEIGHTS = (5, 2, 1)
MOST = 3


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size).

    With the caps c = most * size in the order of c / weight, the level is the largest of (all - caps so far) / (weights to
    come) over the prefixes of that order; a target is the smaller of the cap and level * weight.
    """
    src = sizes.withColumns({"gone": F.col("source").isNull().cast("int"), "lead": F.coalesce(F.substring("source", 1, 2), F.lit(""))})
    src = written(scans.row_index(src, ["gone", "source"], chunks=["gone", "lead"], name="place"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    src = src.withColumn("weight", w).withColumn("cap", (most * F.col("source_size")).cast("double"))
    src = src.withColumn("fill", F.col("cap") / F.col("weight")).withColumn("slice", F.floor(F.log2(1 + F.col("fill")) * 16))
    runs = scans.running(src, ["fill", "place"], [Run("caps", "sum", "cap", strict=True), Run("used", "sum", "weight", strict=True)], chunks=["slice"])
    total = src.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    level = (runs.crossJoin(F.broadcast(total)).select(
        ((F.col("total") - F.coalesce("caps", F.lit(0.0))) / (F.col("weights") - F.coalesce("used", F.lit(0.0)))).alias("l")).agg(F.max("l").alias("level")))
    return src.crossJoin(F.broadcast(level)).select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def sampled(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """`docs` (doc_id, source, size) with source_size, target and the number of `copies` the mix takes of each row.

    Rows, sizes and targets are tables of their own: a scan reads its input once per level, so one plan over all of them repeats
    each step many times over, and the driver keeps every state of it.
    """
    docs = written(docs)
    sizes = written(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = written(targets(sizes, weights, most).withColumnRenamed("source", "_source"))
    rows = docs.withColumns({"_coarse": F.floor(F.col("size") / 64), "_slice": F.floor(F.col("doc_id") / 4096)})
    rows = scans.row_index(rows, ["size", "doc_id"], ["source"], ["_coarse", "size", "_slice"], "_at")
    rows = rows.join(goal, rows["source"].eqNullSafe(goal["_source"])).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    copies = F.floor(rate * F.col("_at") + start) - F.floor(rate * (F.col("_at") - 1) + start)
    return rows.withColumn("copies", F.least(copies, F.lit(most)).cast("long")).drop("_coarse", "_slice", "_at")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM p),
f AS (SELECT *, sum(cap) OVER o - cap AS caps, sum(weight) OVER o - weight AS used FROM w
      WINDOW o AS (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING)),
l AS (SELECT max(((SELECT sum(source_size) FROM s) - caps) / ((SELECT sum(weight) FROM w) - used)) AS level FROM f),
g AS (SELECT source, source_size, least(cap, level * weight) AS target FROM w, l),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS pos,
        CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
        ('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (least(floor(rate * pos + start) - floor(rate * (pos - 1) + start), 3) * size)::BIGINT AS taken FROM r
"""


@query("op6_systematic_mixing", SQL)
def op6(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", word_count("text").alias("size"))
    return sampled(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def stage(spark, docs: DataFrame, d: str) -> DataFrame:
    """The mix of `docs`: each row as often as it is taken. Rows equal in all columns are interchangeable, others are taken by themselves."""
    cols = [F.col(c) for c in docs.columns]
    docs = docs.withColumn("_key", F.xxhash64(*cols, *[c.isNull() for c in cols]))
    plan = written(sampled(docs.select("doc_id", "_key", "source", word_count("text").alias("size"))).select("_key", "copies"))
    taken = plan.groupBy("_key").agg(F.sum("copies").alias("copies")).where("copies > 0")
    one = docs.dropDuplicates(["_key"])
    return one.join(taken, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        *[c for c in docs.columns if c != "_key"])
