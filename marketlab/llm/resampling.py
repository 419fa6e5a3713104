"""Operator 12: importance resampling towards a target by hashed n-grams, hashed with position-table CRC.

A CRC is linear in its bytes: it is the XOR of each byte's contribution, which depends on the byte and its distance from the end
only, and of a constant that depends on the length. `CONTRIBUTION[distance, byte]` holds the first for distances below 256, so the
crc32 of all features of a block of texts is one gather and one `bitwise_xor.reduceat` over the features' spans. Longer spans
are folded in blocks of 256 bytes: the register so far enters the next block as four bytes at its head.

Counts cover all documents and the whole target; each task sends one row a bucket at most. Bucket gains are fixed-point log
ratios with add-one smoothing; a document's weight is its floored mean gain, to which Gumbel noise hashed from the id is added, so the
highest scores are a sample without replacement. Ranks come from a running count over slices of the score, so no task holds them all.

Null and empty texts have no features and weight 0 and can't be drawn unless the least length is 0; a null id hashes as the
empty string and ranks last among equal scores; repeated rows are drawn separately; extra columns are ignored; an empty
target leaves T = 0; an empty table has an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import load, query, written
from marketlab.llm.words import blocks
from marketlab.operators import scans

POLY, REACH = 0xEDB88320, 256
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Bytes that can stand in a word once A-Z are folded.
SOLID = np.zeros(256, bool)
SOLID[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Contribution of a byte by its distance from the end, and the register after 0 to REACH zero bytes from all ones."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLY), one >> 1)
    far, start = [one], [np.uint32(0xFFFFFFFF)]
    for _ in range(REACH):
        start.append(one[start[-1] & 255] ^ (start[-1] >> np.uint32(8)))
        far.append(one[far[-1] & 255] ^ (far[-1] >> np.uint32(8)))
    return np.stack(far[:REACH]), np.array(start, np.uint32)


CONTRIBUTION, START = _tables()


def _raw(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XOR of the contributions of spans of at most REACH bytes, none empty."""
    stop = np.cumsum(size)
    first = stop - size
    step = np.arange(stop[-1])
    at = step + np.repeat(start - first, size)
    away = np.repeat(stop - 1, size) - step
    return np.bitwise_xor.reduceat(CONTRIBUTION.ravel().take((away << 8) | data[at]), first)


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each span of `data` (bytes); spans may overlap and have any length."""
    size = end - start
    out = np.zeros(len(size), np.uint32)
    head = np.where(size > REACH, (size - 1) % REACH + 1, size)
    some = np.flatnonzero(size > 0)
    if len(some):
        out[some] = START[head[some]] ^ _raw(data, start[some], head[some])
    left = np.flatnonzero(size > REACH)
    at = start + head
    while len(left):
        reg = out[left]
        moved = np.zeros(len(left), np.uint32)
        for k in range(4):
            moved ^= CONTRIBUTION[REACH - 1 - k, (reg >> np.uint32(8 * k)) & 255]
        out[left] = moved ^ _raw(data, at[left], np.full(len(left), REACH))
        at[left] += REACH
        left = left[at[left] < end[left]]
    return np.where(size > 0, out ^ np.uint32(0xFFFFFFFF), 0).astype(np.uint32)


def features(texts: pa.Array, longest: int, buckets: int):
    """For blocks of the column: first row, number of rows, row of each feature and its bucket.

    Words are written one after the other with a space between, so each run of 1 to `longest` words is one span.
    """
    for block in blocks(texts):
        data = FOLD[block.data]
        begin, end = block.spans(SOLID[data])
        size = end - begin
        if not len(size):
            yield block, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        row = block.row_of(begin)
        if longest == 1:
            yield block, row, (crc32(data, begin, end) % buckets).astype(np.int64)
            continue
        to = np.cumsum(size + 1) - size - 1
        joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        own = np.concatenate([[0], np.cumsum(size)[:-1]])
        step = np.arange(own[-1] + size[-1])
        joined[step + np.repeat(to - own, size)] = data[step + np.repeat(begin - own, size)]
        rows, found = [], []
        for k in range(1, longest + 1):
            m = len(size) - k + 1
            if m <= 0:
                break
            at = np.flatnonzero(row[:m] == row[k - 1:])
            if len(at):
                rows.append(row[at])
                found.append((crc32(joined, to[at], to[at + k - 1] + size[at + k - 1]) % buckets).astype(np.int64))
        yield block, np.concatenate(rows), np.concatenate(found)


def _counts(longest, buckets):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in features(batch["text"], longest, buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
    return run


def counted(df: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): features of the whole table `df` (text) by bucket."""
    return (df.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts(longest, buckets), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket; at most `buckets` rows reach the driver."""
    s, t = (counted(x, longest, buckets) for x in (docs, target))
    both = s.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(t.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    n = np.zeros((2, buckets))
    for r in rows:
        n[:, r["bucket"]] = r["s"], r["t"]
    s, t = n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weights(gain, longest):
    def run(batches):
        for batch in batches:
            for block, row, found in features(batch["text"], longest, len(gain)):
                n = np.bincount(row, minlength=block.rows)
                total = np.zeros(block.rows, np.int64)
                np.add.at(total, row, gain[found])
                words = n if longest == 1 else None
                if words is None:
                    begin, _ = block.spans(SOLID[FOLD[block.data]])
                    words = np.bincount(block.row_of(begin), minlength=block.rows)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(block.first, block.rows), pa.array(words), pa.array(n),
                                                  pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], names=["doc_id", "n_words", "n_features", "weight"])
    return run


def gumbel(seed: int) -> Column:
    """Fixed-point Gumbel noise of the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT,
              seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): `percent` of the documents with `least` words get a rank."""
    gain = gains(docs, target, longest, buckets)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _weights(gain, longest), "doc_id long, n_words long, n_features long, weight long")
    rows = written(rows.withColumn("score", F.col("weight") + gumbel(seed)))
    able = rows.where(F.col("n_words") >= least)
    drawn = able.count() * percent // 100
    able = able.withColumns({"_band": -F.floor(F.col("score") / 256), "_down": -F.col("score"), "_last": F.col("doc_id").isNull().cast("int")})
    ranked = scans.row_index(able, ["_down", "_last", "doc_id", "weight", "n_features"], chunks=["_band", "_down"], name="rank").drop("_band", "_down", "_last")
    rest = rows.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest)


SQL = r"""
WITH t8 AS (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS i)), t AS (SELECT list(v ORDER BY i) AS t FROM t8),
lows AS (SELECT 0 AS own, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 1, NULL, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
sets AS (SELECT row_number() OVER () AS r, own, doc_id, coalesce(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM lows),
w AS (SELECT r, own, unnest(words) AS w FROM sets),
v AS (SELECT DISTINCT w FROM w),
b AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(w))::BIGINT), lambda i: ('0x' || substr(hex(w), (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, x: xor(c // 256, t[(xor(c, x) % 256 + 1)::INT]))) % 10000 AS bucket FROM v, t),
n AS (SELECT bucket, count(*) FILTER (WHERE own = 0) AS s, count(*) FILTER (WHERE own = 1) AS t FROM w JOIN b USING (w) GROUP BY 1),
a AS (SELECT count(*) FILTER (WHERE own = 0)::DOUBLE AS s, count(*) FILTER (WHERE own = 1)::DOUBLE AS t FROM w),
g AS (SELECT bucket, floor(1000 * ln((n.t + 1)::DOUBLE * (a.s + 10000) / ((n.s + 1)::DOUBLE * (a.t + 10000))))::BIGINT AS gain FROM n, a),
m AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM w JOIN b USING (w) JOIN g USING (bucket) WHERE own = 0 GROUP BY 1),
x AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(floor(total / n), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM sets LEFT JOIN m USING (r) WHERE own = 0),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place,
    count(*) FILTER (WHERE n_features >= 20) OVER () * 10 // 100 AS k FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= k THEN place END AS rank FROM z
"""


@query("op12_importance_resampling", SQL)
def op12(spark, d):
    return resampled(load(spark, d, "documents"), load(spark, d, "benchmark")).drop("n_words")
