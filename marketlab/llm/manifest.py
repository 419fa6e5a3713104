"""Operator 13: Merkle manifest of a dataset by time-forward processing.

Nodes are labelled (level, place). Going forward, a priority queue ordered by the receiver's label delivers digests to parents;
going back, the same queue in reversed order delivers proof steps to children. A task's queue holds one block, the 4,096
neighbouring nodes whose messages meet three levels up; messages that leave a block lie in a table, the queue's outer part, which
the next round's exchange deals out by label. Every round has 4,096 times fewer nodes, so three rounds serve 6.9e10
leaves of one source. Places come from a range sort and the counts of its partitions, so a source may hold any share of the rows.

A source's tree has the leaves in order of doc_id (null first, equal ids by digest); the sources' subroots, null first and then
by UTF-8 bytes, make the upper tree by the same functions. Null fields count as `-`; empty texts as `0:`; a repeated row is a
leaf of its own; extra columns are ignored; an empty table has no leaves and an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlab.llm.common import load, query, written

FAN, HEIGHT = 16, 3
STEPS = "array<struct<slot:int,others:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def levels_of(total: int, height: int) -> int:
    """Levels a block climbs, of a tree with `total` nodes at the block's foot."""
    return next(k for k in range(height + 1) if FAN**k >= total or k == height)


def forward(digests: Sequence[str], levels: int) -> tuple[str, dict]:
    """Digest of a block's top, and what each label (level, place) has received."""
    queue = [(1, at // FAN, at % FAN, d) for at, d in enumerate(digests)]
    received = {}
    while queue[0][0] <= levels:
        level, place = queue[0][:2]
        got = []
        while queue and queue[0][:2] == (level, place):
            got.append(heapq.heappop(queue)[3])
        received[level, place] = got
        heapq.heappush(queue, (level + 1, place // FAN, place % FAN, digest(*got)))
    return queue[0][3], received


def backward(received: dict, levels: int, tail: tuple) -> Iterator[tuple[int, tuple]]:
    """Place and proof of each node at a block's foot; a proof is (slot, others, proof of the parent), the root's is ()."""
    queue = [(-levels, 0, tail)]
    while queue:
        level, place, proof = heapq.heappop(queue)
        if level == 0:
            yield place, proof
            continue
        run = received[-level, place]
        for slot in range(len(run)):
            heapq.heappush(queue, (level + 1, place * FAN + slot, (slot, "".join(run[:slot] + run[slot + 1:]), proof)))


def steps_of(proof: tuple) -> list[dict]:
    out = []
    while proof:
        out.append({"slot": proof[0], "others": proof[1]})
        proof = proof[2]
    return out


def proof_of(steps: list[dict]) -> tuple:
    return reduce(lambda above, s: (s["slot"], s["others"], above), reversed(steps), ())


def folded(leaf: str, proof: tuple) -> str:
    """The root that a leaf and a proof lead to."""
    while proof:
        cut, others = 64 * proof[0], proof[1]
        leaf, proof = digest(others[:cut], leaf, others[cut:]), proof[2]
    return leaf


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`df`, written, with `place` along `order` within `keys`, from 0, and the `total` rows of its key."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
                   .withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit(2**33 - 1))})
    parts = rows.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    within = W.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(within.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*keys, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(within).alias("total"))
    return (rows.join(parts, [*keys, "_part"]).withColumn("place", F.col("_row") + F.col("_shift"))
            .drop("_at", "_part", "_row", "_shift"))


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("place")


def _climb(keys, height):
    def run(table):
        table = _ordered(table)
        total = table["total"][0].as_py()
        top, _ = forward(table["digest"].to_pylist(), levels_of(total, height))
        row = table.slice(0, 1).select([*keys, "block"]).to_pydict()
        return pa.table(row | {"total": [-(-total // FAN**height)], "digest": [top]},
                        schema=pa.schema([*(table.schema.field(c) for c in [*keys, "block"]), ("total", pa.int64()), ("digest", pa.string())]))
    return run


def grow(nodes: DataFrame, keys: Sequence[str], height: int = HEIGHT) -> list[DataFrame]:
    """Forward sweep over `nodes` (keys, place, total, digest): the nodes of each round, the last of which holds the tops."""
    span = FAN**height
    rounds = [nodes.withColumn("block", F.floor(F.col("place") / span))]
    most = nodes.agg(F.max("total")).first()[0] or 0
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", block long, total long, digest string"
    while True:
        feet = rounds[-1].select(*keys, "block", "place", "total", "digest")
        tops = written(feet.groupBy(*keys, "block").applyInArrow(_climb(keys, height), schema))
        rounds.append(tops.withColumnRenamed("block", "place").withColumn("block", F.floor(F.col("place") / span)))
        if most <= span:
            return rounds
        most = -(-most // span)


def _descend(carried, finish, height):
    def run(table, tail):
        if not table.num_rows or not tail.num_rows:
            return finish(None, None, None)
        table = _ordered(table)
        levels = levels_of(table["total"][0].as_py(), height)
        _, received = forward(table["digest"].to_pylist(), levels)
        return finish(table, backward(received, levels, proof_of(tail["steps"][0].as_py())), {c: tail[c][0].as_py() for c in carried})
    return run


def _pass_on(keys, schema):
    def finish(table, proofs, more):
        if table is None:
            return schema.empty_table()
        proofs = sorted(proofs, key=lambda x: x[0])
        n = table.num_rows
        return pa.table({**{c: table[c] for c in keys}, "block": table["place"], "steps": [steps_of(p) for _, p in proofs],
                         **{c: [v] * n for c, v in more.items()}}, schema=schema)
    return finish


def deliver(rounds: list[DataFrame], tails: DataFrame, keys: Sequence[str], carried: Sequence[str], finish, schema: str,
            height: int = HEIGHT) -> DataFrame:
    """Reversed sweep: `tails` (keys, steps, carried columns) are the proofs of the tops; the last round ends in `finish`."""
    kinds = {f.name: f.dataType.simpleString() for f in tails.schema}
    mid = ", ".join(f"{c} {kinds[c]}" for c in keys) + f", block long, steps {STEPS}" + "".join(f", {c} {kinds[c]}" for c in carried)
    tails = tails.select(*keys, F.lit(0).cast("long").alias("block"), "steps", *carried)
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    step = pa.list_(pa.struct([("slot", pa.int32()), ("others", pa.string())]))
    between = pa.schema([*((c, arrow[kinds[c]]) for c in keys), ("block", pa.int64()), ("steps", step), *((c, arrow[kinds[c]]) for c in carried)])
    for nodes in reversed(rounds[1:-1]):
        feet = nodes.select(*keys, "block", "place", "total", "digest")
        tails = written(feet.groupBy(*keys, "block").cogroup(tails.groupBy(*keys, "block"))
                        .applyInArrow(_descend(carried, _pass_on(keys, between), height), mid))
    return rounds[0].groupBy(*keys, "block").cogroup(tails.groupBy(*keys, "block")).applyInArrow(_descend(carried, finish, height), schema)


LEAF = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()),
                  ("folded_root", pa.string()), ("verified", pa.bool_())])


def _audited(with_proofs: bool):
    step = pa.list_(pa.struct([("slot", pa.int32()), ("others", pa.string())]))
    schema = LEAF.append(pa.field("proof", step)) if with_proofs else LEAF

    def finish(table, proofs, more):
        if table is None:
            return schema.empty_table()
        leaf, found = table["digest"].to_pylist(), table["found"].to_pylist()
        texts, ends, kept = [None] * len(leaf), [None] * len(leaf), [None] * len(leaf)
        for at, proof in proofs:
            ends[at] = folded(found[at], proof)
            steps = steps_of(proof)
            texts[at] = digest(*(s["others"] for s in steps))
            kept[at] = steps if with_proofs else None
        cols = {"doc_id": table["doc_id"], "leaf": leaf, "subroot": [more["subroot"]] * len(leaf), "root": [more["root"]] * len(leaf),
                "proof_sha256": texts, "folded_root": ends, "verified": [e == more["root"] for e in ends]}
        return pa.table(cols | ({"proof": kept} if with_proofs else {}), schema=schema)
    return finish


def field(c) -> Column:
    """A field as hashed: `-` if null, else its UTF-8 byte count, a colon and the value."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(docs: DataFrame, text: Column | None = None) -> Column:
    fields = [F.col(c) if c in docs.columns else F.lit(None) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*map(field, fields), field(F.col("text") if text is None else text)), 256)


def audited(docs: DataFrame, found: Column, with_proofs: bool = False, height: int = HEIGHT) -> DataFrame:
    """Manifest of `docs` and the check of `found`, the leaf digest of each row as it is now, against it.

    Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; `with_proofs` adds the steps themselves, from
    the leaf to the root.
    """
    src = ["known", "src"]
    leaves = docs.select(F.col("source").isNotNull().cast("int").alias("known"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
                         F.col("doc_id").cast("long").alias("doc_id"), leaf_of(docs).alias("digest"), found.alias("found"))
    lower = grow(placed(leaves, src, ["doc_id", "digest"]), src, height)
    subroots = placed(lower[-1].select(F.lit(0).alias("all"), *src, "digest"), ["all"], src)
    upper = grow(subroots, ["all"], height)
    root = upper[-1].select("all", F.array().cast(STEPS).alias("steps"), F.col("digest").alias("root"))

    step = pa.list_(pa.struct([("slot", pa.int32()), ("others", pa.string())]))
    kinds = pa.schema([("known", pa.int32()), ("src", pa.string()), ("steps", step), ("subroot", pa.string()), ("root", pa.string())])

    def finish(table, proofs, more):
        if table is None:
            return kinds.empty_table()
        proofs = sorted(proofs, key=lambda x: x[0])
        return pa.table({"known": table["known"], "src": table["src"], "steps": [steps_of(p) for _, p in proofs], "subroot": table["digest"],
                         "root": [more["root"]] * table.num_rows}, schema=kinds)
    tails = written(deliver(upper, root, ["all"], ["root"], finish, f"known int, src string, steps {STEPS}, subroot string, root string", height))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return deliver(lower, tails, src, ["subroot", "root"], _audited(with_proofs), schema + (f", proof {STEPS}" if with_proofs else ""), height)


def tampered(docs: DataFrame) -> Column:
    """Leaf digests after lower-casing A-Z in the text of rows whose id's crc32 is divisible by 5."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return leaf_of(docs, F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text")))


def _sql(depth: int = 8) -> str:
    """DuckDB twin; `depth` levels hold 16^depth leaves a source and as many sources."""
    out = [r"""WITH t8 AS (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS i)), t AS (SELECT list(v ORDER BY i) AS t FROM t8),
d AS (SELECT *, CAST(doc_id AS VARCHAR) AS id FROM documents),
c AS (SELECT d.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(id, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256 + 1)::INT]))) % 5 = 0 AS hit FROM d, t),
f AS (SELECT doc_id, source, source IS NOT NULL AS known, coalesce(source, '') AS src, """
        + " || ".join(f"coalesce(octet_length(encode({x})) || ':' || {x}, '-')" for x in ("id", "source", "lang", "n_chars::VARCHAR")) + r""" AS head,
    text, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now FROM c),
l AS (SELECT doc_id, known, src, """ + ", ".join(f"sha256(head || coalesce(octet_length(encode({x})) || ':' || {x}, '-')) AS {n}" for x, n in (("text", "leaf"), ("now", "found"))) + """ FROM f),
a0 AS (SELECT known, src, row_number() OVER (PARTITION BY known, src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h FROM l)"""]

    def tree(name, keys):
        part = ", ".join(keys)
        for k in range(1, depth + 1):
            out.append(f""", {name}g{k} AS (SELECT {part}, pos // 16 AS up, list(h ORDER BY pos) AS run, sum(count(*)) OVER (PARTITION BY {part}) AS n FROM {name}{k - 1} GROUP BY {part}, up),
{name}{k} AS (SELECT {part}, up AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {name}g{k})""")

    def climb(name, keys, src, start):
        """Proof text and folded digest of each row of `src`, which has `pos`, `proof` and `now`."""
        prev = src
        for k in range(1, depth + 1):
            on = " AND ".join(f"x.{c} = g.{c}" for c in keys)
            slot = "(x.pos % 16)::INT"
            out.append(f""", {start}{k} AS (SELECT x.* REPLACE (x.pos // 16 AS pos,
  x.proof || CASE WHEN n > 1 THEN array_to_string(run[:{slot}] || run[{slot} + 2:], '') ELSE '' END AS proof,
  CASE WHEN n > 1 THEN sha256(array_to_string(run[:{slot}], '') || x.now || array_to_string(run[{slot} + 2:], '')) ELSE x.now END AS now)
  FROM {prev} x JOIN {name}g{k} g ON {on} AND x.pos // 16 = g.up)""")
            prev = f"{start}{k}"
        return prev

    tree("a", ["known", "src"])
    out.append(f", b0 AS (SELECT 1 AS one, known, src, row_number() OVER (ORDER BY known, src) - 1 AS pos, h FROM a{depth})")
    tree("b", ["one"])
    out.append(", p0 AS (SELECT known, src, doc_id, leaf, row_number() OVER (PARTITION BY known, src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, '' AS proof, found AS now FROM l)")
    low = climb("a", ["known", "src"], "p0", "p")
    out.append(f", q0 AS (SELECT p.* REPLACE (b.pos AS pos), 1 AS one, b.h AS subroot FROM {low} p JOIN b0 b ON p.known = b.known AND p.src = b.src)")
    top = climb("b", ["one"], "q0", "q")
    out.append(f"\nSELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = b.h AS verified FROM {top} q JOIN b{depth} b ON q.one = b.one")
    return "".join(out)


@query("op13_merkle_manifest", _sql())
def op13(spark, d):
    docs = load(spark, d, "documents")
    return audited(docs, tampered(docs))
