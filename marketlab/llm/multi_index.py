"""Operator 4: nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised apart; a cell is a pair of centroids. A query walks the cells in the order of summed
half distances, by a heap over the two sorted centroid lists, until the cells hold the share `share` of all entries, and `wanted` at
least, so that recall doesn't fall as the table grows; cells of one first half lie together. Every vector is in the index; the
centroids, 4 times the fourth root of the number of vectors for each half and CENTROIDS at least, come from a bounded sample of `sample`
vectors, those with the smallest id hashes. Cells hold any number of vectors: each first half is dealt over blocks of `block`
entries and the queries over groups of `asks`, a query visits every block of its cells, and each block ranks the entries of these cells by the exact distance in double precision and passes on its nearest k. These meet in one aggregation per query.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. Fewer candidates than k
give all of them; ties go to the smaller id; ids that repeat are separate entries; a null id takes no part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import load, lowest, query, written

CENTROIDS, SAMPLE, ROUNDS, WANTED, SHARE, BLOCK, ASKS, K = 64, 20_000, 12, 22_000, 0.45, 2048, 4096, 10


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, v as doubles of the most common length."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).select("d").first()
    return rows.where(F.size("v") == (size["d"] if size else 0))


def centroids(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's iterations from a spread start."""
    rng = np.random.default_rng(7)
    if not len(points):
        return points
    chosen = [points[rng.integers(len(points))]]
    far = ((points - chosen[0]) ** 2).sum(1)
    while len(chosen) < k and far.max() > 0:
        chosen.append(points[rng.choice(len(points), p=far / far.sum())])
        far = np.minimum(far, ((points - chosen[-1]) ** 2).sum(1))
    c = np.array(chosen)
    for _ in range(rounds):
        own = squares(points, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, points[:, j], len(c)) for j in range(points.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy()
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def walk(left: np.ndarray, right: np.ndarray, held: np.ndarray, wanted: int) -> list[int]:
    """Cells (numbers) in the order of left[i] + right[j] until they hold `wanted` entries."""
    i_of, j_of = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen, out, total = [(left[i_of[0]] + right[j_of[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and total < wanted:
        _, a, b = heapq.heappop(heap)
        cell = int(i_of[a]) * len(right) + int(j_of[b])
        if held[cell]:
            out.append(cell)
            total += held[cell]
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(left) and y < len(right) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (left[i_of[x]] + right[j_of[y]], x, y))
    return out


def nearest(vectors: DataFrame, every: int = 100, k: int = K, wanted: int = WANTED, sample: int = SAMPLE, block: int = BLOCK, share: float = SHARE,
            asks: int = ASKS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest; queries are the ids divisible by `every`."""
    points = written(usable(vectors))
    whole = points.count()
    wanted, size = max(wanted, int(np.ceil(share * whole))), max(CENTROIDS, int(np.ceil(4 * whole ** 0.25)))
    groups = max(1, -(-points.where(F.col("vec_id") % every == 0).count() // asks))
    some = lowest(points.withColumn("u", F.xxhash64("vec_id")), "u", sample).orderBy("u", "vec_id").limit(sample).select("v").toArrow()["v"].combine_chunks()
    train = matrix(some if isinstance(some, pa.Array) else pa.array([], pa.list_(pa.float64())))
    half = train.shape[1] // 2
    books = [centroids(train[:, :half], size), centroids(train[:, half:], size)]

    def assign(batches):
        for b in batches:
            x = matrix(b["v"])
            if len(x):
                own = [pa.array(squares(y, c).argmin(1).astype(np.int32)) for y, c in zip((x[:, :half], x[:, half:]), books, strict=True)]
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], *own], names=["vec_id", "v", "i", "j"])

    index = written(points.mapInArrow(assign, "vec_id long, v array<double>, i int, j int"))
    held = np.zeros((max(1, len(books[0])), max(1, len(books[1]))), np.int64)
    for r in index.groupBy("i", "j").count().collect():  # at most size ** 2 rows, 16 * sqrt(whole) of a large table
        held[r["i"], r["j"]] = r["count"]
    parts = np.maximum(1, -(-held.sum(1) // block))

    def visits(batches):
        for b in batches:
            x = matrix(b["v"])
            if not len(x):
                continue
            near = squares(x[:, :half], books[0]), squares(x[:, half:], books[1])
            rows = []
            for q in range(len(x)):
                cells = np.array(walk(near[0][q], near[1][q], held.ravel(), wanted + 1))
                for i in np.unique(cells // held.shape[1]):
                    js = cells[cells // held.shape[1] == i] % held.shape[1]
                    rows += [(q, i, p, js) for p in range(parts[i])]
            q, i, p, js = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(q)), b["v"].take(pa.array(q)), pa.array(i, pa.int32()), pa.array(p, pa.int32()),
                                              pa.array(js, pa.list_(pa.int32()))], names=["query_id", "v", "i", "part", "js"])

    count = F.element_at(F.lit([int(x) for x in parts]), F.col("i") + 1)
    entries = index.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), count).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = index.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInArrow(visits, "query_id long, v array<double>, i int, part int, js array<int>")
    asked = asked.withColumn("g", F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(groups)).cast("int"))

    def rank(key, asked, entries):
        q, e = asked["query_id"].to_numpy(), entries["vec_id"].to_numpy()
        if not len(q) or not len(e):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, y = matrix(asked["v"].combine_chunks()), matrix(entries["v"].combine_chunks())
        order = np.argsort(e, kind="stable")
        e, y, j, out = e[order], y[order], entries["j"].to_numpy()[order], []
        js = asked["js"].combine_chunks()
        visited = np.zeros((len(q), held.shape[1]), bool)
        visited[np.repeat(np.arange(len(q)), np.diff(js.offsets.to_numpy())), js.flatten().to_numpy()] = True
        for first in range(0, len(q), 256):
            own = q[first: first + 256]
            near = squares(x[first: first + 256], y)
            near[(own[:, None] == e[None]) | ~visited[first: first + 256][:, j]] = np.inf
            most = min(k + 20, len(e))
            cut = np.partition(near, most - 1, axis=1)[:, most - 1]
            for i in range(len(own)):
                at = np.flatnonzero(near[i] <= cut[i] * (1 + 1e-9) + 1e-9) if np.isfinite(cut[i]) else np.flatnonzero(np.isfinite(near[i]))
                d = np.sqrt(((y[at] - x[first + i]) ** 2).sum(1))
                best = np.argsort(d, kind="stable")[:k]
                out.append((np.full(len(best), own[i]), e[at[best]], d[best]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(z) for z in zip(*out, strict=True)), strict=True)))

    found = asked.groupBy("g", "i", "part").cogroup(entries.groupBy("g", "i", "part")).applyInArrow(rank, "query_id long, vec_id long, score double")
    top = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))


@query("op4_inverted_multi_index")
def op4(spark, d):
    return nearest(load(spark, d, "embeddings"))
