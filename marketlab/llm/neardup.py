"""Operator 9: MinHash near-duplicates by one-permutation hashing with optimal densification, bands and stars.

Each set is hashed once: a shingle's hash names a bin and a value, and a bin keeps its smallest value. An empty bin takes the
value of the first filled bin along a probe sequence of its own (universal hashing of bin and attempt), the same for all
sets. 216 bins make 36 bands of 6: sets at a similarity of 0.8 miss all of them with probability 2e-5, and sets at 0.5 share
one with 0.43. Candidates are stars of buckets (see `similar`), links are confirmed on the full sets.

Nulls and texts without words have an empty set and no link; equal sets are one class, whatever the number of copies; rows
that agree in id and text are one document; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm import similar
from marketlab.llm.common import load, query, written
from marketlab.llm.words import U, blocks, mix, per_row

BINS, ROWS, LEAST = 216, 6, 4
_rng = np.random.default_rng(5)
PROBES = _rng.integers(0, BINS, (4096, BINS))


def one_permutation(row: np.ndarray, members: np.ndarray, rows: int) -> np.ndarray:
    """Densified signature (rows x BINS) of each row's set; rows without members stay zero."""
    h = mix(members, 11)
    where = row * BINS + ((h >> U(32)) * U(BINS) >> U(32)).astype(np.int64)
    value = mix(members, 12) & U(2**40 - 1)
    order = np.sort((where.astype(U) << U(40)) | value) if rows * BINS < 1 << 24 else None
    if order is None:
        raise ValueError("too many rows in one block")
    at = (order >> U(40)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
    sig, full = np.zeros(rows * BINS, U), np.zeros(rows * BINS, bool)
    sig[at[first]] = order[first] & U(2**40 - 1)
    full[at[first]] = True
    sig, full = sig.reshape(rows, BINS), full.reshape(rows, BINS)
    r, b = np.nonzero(~full & full.any(1)[:, None])
    for step in PROBES:
        if not len(r):
            break
        donor = step[b]
        hit = full[r, donor]
        sig[r[hit], b[hit]] = sig[r[hit], donor[hit]]
        r, b = r[~hit], b[~hit]
    for x, y in zip(r, b, strict=True):
        sig[x, y] = sig[x, np.argmax(full[x])]
    return sig


def set_ids(row: np.ndarray, members: np.ndarray, rows: int) -> np.ndarray:
    return mix(per_row(row, rows, mix(members, 21)) + per_row(row, rows, mix(members, 22) >> U(7)) * U(3)).view(np.int64)


def _features(k: int):
    def run(batches):
        for batch in batches:
            for block in blocks(batch["text"]):
                row, members = block.words(True).sets(k)
                n = np.bincount(row, minlength=block.rows)
                sig = one_permutation(row, members, block.rows)
                bands = similar.band_hashes(sig, ROWS)
                wide = n >= LEAST
                offsets = np.concatenate([[0], np.cumsum(np.where(wide, bands.shape[1], 0))])
                yield pa.RecordBatch.from_arrays([
                    *(batch[c].slice(block.first, block.rows) for c in ("doc_id", "key")), pa.array(n.astype(np.int64)), pa.array(set_ids(row, members, block.rows)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands[wide].ravel())),
                    pa.array([x.tobytes() for x in (sig & U(255)).astype(np.uint8)], pa.binary())],
                    names=["doc_id", "key", "n", "id", "bands", "sig"])
    return run


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, key, node), one row per row of `docs` (doc_id, text).

    Two documents are linked if 100 * intersection >= percent * union of their sets of k-word shingles. `key` is the hash of
    id and text, `node` names the component even where ids repeat.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key().alias("key"))
    feats = written(docs.select("doc_id", "key", "text").mapInArrow(
        _features(k), "doc_id long, key long, n long, id long, bands array<long>, sig binary"))
    classes = written(feats.where(F.col("n") >= LEAST).groupBy("id").agg(
        *[F.first(c).alias(c) for c in ("n", "key", "bands", "sig")]))
    def texts(ids: DataFrame) -> DataFrame:
        return ids.join(classes.select("id", "key"), "id").join(docs.select("key", "text"), "key").select("id", "text").dropDuplicates(["id"])

    found = similar.linked(classes, similar.shared_buckets(classes), BINS, percent, k, texts)
    real = feats.where("n > 0").select("doc_id", "key", "n", "id")
    least = (real.groupBy("id").agg(F.min("doc_id").alias("least")).join(found, "id", "left")
             .withColumn("node", F.coalesce("component", "id")))
    known = least.join(least.groupBy("node").agg(F.min("least").alias("component_id")), "node").select("id", "node", "component_id")
    out = real.join(known, "id").drop("id").unionByName(feats.where("n = 0").select(
        "doc_id", "key", "n", F.col("key").alias("node"), F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "key", "node")


def key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


@query("op9_minhash_near_dedup")
def op9(spark, d):
    return near_duplicates(load(spark, d, "documents")).drop("key", "node")


def stage(spark, docs: DataFrame, d: str) -> DataFrame:
    """Documents of `docs` without near copies (five-word shingles, similarity 0.8): one of each group stays."""
    kept = near_duplicates(docs, k=5).where("kept").groupBy("node").agg(F.min("key").alias("_key")).select("_key")
    # one row of each kept key: equal rows have equal keys
    return docs.withColumn("_key", key()).join(kept, "_key").dropDuplicates(["_key"]).drop("_key")
