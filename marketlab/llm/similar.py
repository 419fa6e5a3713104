"""Candidates, exact checks and components of near-duplicate classes; shared by the document and the paragraph operator.

Input is a table of classes (one row per different set): `id` long, `n` set size, `bands` array<long>, `sig` binary.

1. Every bucket (an equal band) names two stars, its smallest and its largest id; a member is a candidate of each. That is
   at most two pairs per member and band, whatever the bucket's size.
2. Candidates whose sizes rule the similarity out go; then those whose signatures agree in so few places that the similarity
   is out of reach (six standard deviations); the rest is checked on the full sets.
3. Components of the links found. A bucket that lies in one component needs nothing more. For the members of the others it is
   counted how many of a set's members stand in no other of these sets: with d such members in n, a set can't be
   more alike to any other than (n - d) / n. What stays is gathered in clusters (buckets that share members), and the members outside a
   cluster's largest component are compared with all its others in blocks of about `side` by `side` sets, dealt over tasks
   whatever the cluster's size. A block emits its links only, so no colliding pair of two components stays undecided and no
   pairs are made as rows; then the components are made anew.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from marketlab.llm.common import written
from marketlab.llm.words import U, blocks, mix


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in `links` (a, b): the smallest id it is connected with.

    Alternates large and small stars, each a window over the edges of an id, until every id hangs on one root; every round is
    a table in the shared folder and notes whether the round before it had ended the work, so no query of its own asks for that.
    No links give an empty table.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    ended = edges.isEmpty()
    while not ended:
        seen = Observation()
        edges = written(_round(edges, seen))
        ended = not seen.get["open"]
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _round(edges: DataFrame, seen: Observation) -> DataFrame:
    """A large and a small star over distinct `edges` (u > v); `seen` gets as `open` whether any id with a smaller neighbour had another one."""
    whole = Window.partitionBy("u")
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    each = both.withColumns({"m": F.min("v").over(whole), "near": F.count(F.lit(1)).over(whole)}).observe(
        seen, F.max(((F.col("m") < F.col("u")) & (F.col("near") > 1)).cast("int")).alias("open"))
    large = each.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return (large.withColumn("m", F.min("v").over(whole)).select(F.explode(F.array(
        F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        .select("e.*").where("u <> v").distinct())


def _in_reach(n, m, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _bytes(column: pa.Array, places: int) -> np.ndarray:
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    start = int(np.frombuffer(offsets, np.int32)[column.offset])
    return np.frombuffer(data, np.uint8)[start: start + len(column) * places].reshape(len(column), places)


def _agreeing(places: int, percent: int):
    """Keep candidates whose signatures agree often enough for the similarity asked for."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                want = percent / 100
                free = np.minimum(np.minimum(b["a_n"].to_numpy(), b["b_n"].to_numpy()), places)
                least = want - 6 * np.sqrt(want * (1 - want) / free)
                same = (_bytes(b["a_sig"], places) == _bytes(b["b_sig"], places)).mean(1)
                yield b.select(["a", "b"]).filter(pa.array(same >= least))
    return run


def checked(pairs: DataFrame, classes: DataFrame, places: int, percent: int, k: int, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of candidate `pairs` (a, b), those that are links by the full sets of k-word shingles of their `texts`."""
    def same(batches):
        for b in batches:
            inter, union = same_share(b["a_text"], b["b_text"], k)
            yield b.select(["a", "b"]).filter(pa.array(100 * inter >= percent * union))

    side = classes.select("id", "n", "sig")
    both = (pairs.join(side.select(F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("sig").alias("a_sig")), "a")
            .join(side.select(F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("sig").alias("b_sig")), "b"))
    left = written(both.mapInArrow(_agreeing(places, percent), "a long, b long"))
    body = written(texts(left.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    return (left.join(body.select(F.col("id").alias("a"), F.col("text").alias("a_text")), "a")
            .join(body.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b")
            .select("a", "b", "a_text", "b_text").mapInArrow(same, "a long, b long").distinct())


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(id, n, bucket, lo, hi): the members of each bucket of several ids, with its smallest and its largest id.

    A band of every class crosses one exchange; most stand alone in their bucket and end there.
    """
    whole = Window.partitionBy("bucket")
    rows = classes.select("id", "n", F.explode("bands").alias("bucket"))
    return written(rows.withColumns({"lo": F.min("id").over(whole), "hi": F.max("id").over(whole)}).where("lo < hi"))


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member of a bucket with the smallest and with the largest one, where their sizes allow the similarity."""
    whole = Window.partitionBy("bucket")
    sized = members.withColumns({"lo_n": F.min_by("n", "id").over(whole), "hi_n": F.max_by("n", "id").over(whole)})
    ends = F.explode(F.array(F.struct(F.col("lo").alias("to"), F.col("lo_n").alias("to_n")), F.struct(F.col("hi").alias("to"), F.col("hi_n").alias("to_n"))))
    return (sized.select("id", "n", ends.alias("end")).select("id", "n", "end.*").where("id <> to").where(_in_reach(F.col("n"), F.col("to_n"), percent))
            .select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct())


def linked(classes: DataFrame, members: DataFrame, places: int, percent: int, k: int, texts: Callable[[DataFrame], DataFrame], side: int = 500) -> DataFrame:
    """(id, component) of every linked id; `members` are the `shared_buckets` of the classes, `texts` gives (id, text) for a table of ids."""
    links = written(checked(_stars(members, percent), classes, places, percent, k, texts))
    found = written(components(links))
    named = members.select("id", "n", "bucket").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rest = written(_split(named))
    body = written(texts(rest.select("id").distinct()))
    only = (body.mapInArrow(_members(k), "id long, member long").groupBy("member").agg(F.min("id").alias("id"), F.max("id").alias("last"))
            .where("id = last").groupBy("id").agg(F.count(F.lit(1)).alias("d")))
    rest = rest.join(only, "id", "left").where(100 * (F.col("n") - F.coalesce("d", F.lit(0))) >= percent * F.col("n")).drop("d")
    rest = written(_split(rest))
    if rest.isEmpty():
        return found
    late = written(_compared(rest, body, percent, k, side))
    return found if late.isEmpty() else components(links.unionAll(late))


def _split(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with the bucket's `head`."""
    whole = Window.partitionBy("bucket")
    return rows.withColumns({"c0": F.min("component").over(whole), "c1": F.max("component").over(whole), "head": F.min("id").over(whole)}).where("c0 <> c1").drop("c0", "c1")


def _members(k: int):
    def run(batches):
        for b in batches:
            for x in blocks(b["text"]):
                row, members = x.words(True).sets(k)
                yield pa.RecordBatch.from_arrays([b["id"].slice(x.first, x.rows).take(pa.array(row)), pa.array(members.view(np.int64))], names=["id", "member"])
    return run


def _compared(rest: DataFrame, body: DataFrame, percent: int, k: int, side: int) -> DataFrame:
    """Links between different components of a cluster of buckets, found block by block."""
    cluster = components(rest.select(F.col("id").alias("a"), F.col("head").alias("b"))).withColumnRenamed("component", "cluster")
    each = written(rest.select("id", "component").distinct().join(cluster, "id"))
    shares = each.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("size"))
    plan = shares.groupBy("cluster").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("size")).select(
        "cluster", F.col("top.component").alias("main"), F.ceil(F.col("size") / side).alias("ys"),
        F.ceil((F.col("size") - F.col("top.size")) / side).alias("xs"))
    each = each.join(plan, "cluster").join(body, "id")
    spread = F.xxhash64("id", F.lit(17))
    left = each.where("component <> main").select("cluster", "id", "component", "text", F.pmod(spread, F.col("xs")).alias("x"),
                                                  F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"))
    right = each.where("xs > 0").select(*[F.col(c).alias(f"{c}_") for c in ("cluster", "id", "component", "text")], F.pmod(spread, F.col("ys")).alias("y_"),
                                        F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x_"))

    def run(key, a, b):
        out = [np.zeros((0, 2), np.int64)]
        if a.num_rows and b.num_rows:
            (row, one), (row2, two) = _sets(a["text"], k), _sets(b["text_"], k)
            code, both = np.unique(np.concatenate([one, two]), return_inverse=True)
            one, two = both[: len(one)], both[len(one):]
            n1, n2 = np.bincount(row, minlength=a.num_rows), np.bincount(row2, minlength=b.num_rows)
            ids, kind = (a["id"].to_numpy(), b["id_"].to_numpy()), (a["component"].to_numpy(), b["component_"].to_numpy())
            begin, has = np.cumsum(n1) - n1, np.zeros(len(code), bool)
            for i in range(a.num_rows):
                mine = one[begin[i]: begin[i] + n1[i]]
                has[mine] = True
                inter = np.bincount(row2[has[two]], minlength=b.num_rows)
                has[mine] = False
                at = np.flatnonzero((100 * inter >= percent * (n1[i] + n2 - inter)) & (kind[1] != kind[0][i]))
                out.append(np.stack([np.full(len(at), ids[0][i]), ids[1][at]], 1))
        pairs = np.concatenate(out)
        return pa.table({"a": pairs.min(1) if len(pairs) else pairs[:, 0], "b": pairs.max(1) if len(pairs) else pairs[:, 1]})

    return left.groupBy("cluster", "x", "y").cogroup(right.groupBy("cluster_", "x_", "y_")).applyInArrow(run, "a long, b long").distinct()


def _sets(column, k: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [(r + x.first, m) for x in blocks(column) for r, m in [x.words(True).sets(k)]]
    return tuple(np.concatenate(z) for z in zip(*parts, strict=True))


def same_share(a: pa.Array, b: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Intersection and union sizes of the sets of k-word shingles, row by row."""
    inter, union = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    width = 64
    for first in range(0, len(a), width):
        keys = []
        for side in (a, b):
            part = [(((x.first + r).astype(U) << U(52)) | s) for x in blocks(side.slice(first, width)) for r, s in [x.words(True).sets(k)]]
            keys.append(np.concatenate(part) if part else np.zeros(0, U))
        each = [np.bincount((x >> U(52)).astype(np.int64), minlength=width) for x in keys]
        common = np.bincount((np.intersect1d(*keys, assume_unique=True) >> U(52)).astype(np.int64), minlength=width)
        n = min(width, len(a) - first)
        inter[first: first + n] = common[:n]
        union[first: first + n] = (each[0] + each[1] - common)[:n]
    return inter, union


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    """One bucket hash per band of `rows` neighbouring signature places."""
    n, places = sig.shape
    bands = places // rows
    h = np.tile(np.arange(bands, dtype=U) + U(1), (n, 1))
    for j in range(rows):
        h = h * U(0xD6E8FEB86659FD93) + mix(sig[:, j: bands * rows: rows], j + 1)
    return mix(h).view(np.int64)
