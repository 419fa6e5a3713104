"""Operator 7: best-two-fit packing of tokenised documents into sequences.

Documents are tokenised whole in Arrow batches and written as pieces (ids themselves are reduced to a checksum and a length,
or kept where the caller wants them). Pieces are dealt evenly over groups of about `per_group`, whatever their documents, and each
group is packed by itself: a sequence starts with the longest piece left and is filled greedily with the longest that fits;
then its smallest piece goes back if two unpacked pieces fill the larger gap more tightly. All choices are made on counts per
length, so the cost of a sequence does not depend on the group's size. A group can waste one sequence, under 0.01 %.

Null texts are empty documents (one end id); rows may repeat; extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import load, query, written

LENGTH = 2048
_tokenizers: dict = {}


class Tokens:
    """Ids of whole texts as little-endian 32-bit bytes, by the tokenizer file at `path`.

    A byte-level BPE never merges across a single space before a word, so a text is split there and the ids of each
    stretch are kept; `ranks`, the same vocabulary, serves for stretches. Texts with double spaces or a special token's
    string are encoded in one go.
    """

    def __init__(self, path: str, ranks: str | None, most: int = 400_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.most = most
        self.small = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.small = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.small is None or "  " in text or any(t in text for t in self.special):
            return self.slow(text)
        first, *rest = text.split(" ")
        known, encode = self.known, self.small.encode_ordinary
        out = [np.array(encode(first), "<u4").tobytes()]
        for w in rest:
            ids = known.get(w)
            if ids is None:
                if len(known) >= self.most:
                    known.clear()
                ids = known[w] = np.array(encode(" " + w), "<u4").tobytes()
            out.append(ids)
        return b"".join(out)


def tokens(name: str) -> Tokens:
    """The tokenizer of this Python worker for a public vocabulary, made once."""
    if name not in _tokenizers:
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks = public_tokenizers.path(f"{name}.tiktoken")
        _tokenizers[name] = Tokens(public_tokenizers.path(f"{name}.json"), ranks if os.path.exists(ranks) else None)
    return _tokenizers[name]


def pieces(docs: DataFrame, name: str = "byte_bpe_50k", length: int = LENGTH, end: int = 0, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each piece; the first of a long document is the shorter one."""
    def run(batches):
        encode, last = tokens(name), np.array([end], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                data = encode(text.as_py() or "") + last
                n = len(data) // 4
                cut = [0, *range(n - (n - 1) // length * length, n + 1, length)]
                rows += [(doc, i, x, y - x, zlib.crc32(data[4 * x: 4 * y]), data[4 * x: 4 * y] if ids else None)
                         for i, (x, y) in enumerate(zip(cut, cut[1:], strict=False))]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), schema=schema, preserve_index=False)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if ids else out.drop("ids")


def best_two_fit(lengths: np.ndarray, room: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    stacks: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1]:
        stacks.setdefault(int(lengths[i]), []).append(int(i))
    count = np.zeros(room + 1, np.int64)
    for k, v in stacks.items():
        count[k] = len(v)
    sizes = np.arange(room + 1)
    fits = np.maximum.accumulate(np.where(count > 0, sizes, 0))  # longest length in stock up to each length

    def take(k: int, by: int = -1) -> None:
        count[k] += by
        if count[k] == (0 if by < 0 else 1):
            stop = k + int(np.argmax(count[k + 1:] > 0)) + 1 if (count[k + 1:] > 0).any() else room + 1
            fits[k:stop] = k if by > 0 else fits[k - 1]

    seq, offset, number = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    left = len(lengths)
    while left:
        held, gap = [], room
        while gap and (k := int(fits[gap])):
            take(k)
            held.append(k)
            gap -= k
        if gap and len(held) > 1 and left > len(held):
            low = held[-1]
            wide = gap + low
            first = sizes[1: wide][count[1: wide] > 0]
            if len(first):
                second = fits[wide - first]
                twice = (second == first) & (count[first] < 2)
                second = np.where(twice, fits[np.maximum(first - 1, 0)], second)
                both = np.where(second > 0, first + second, 0)
                best = int(np.argmax(both))
                if both[best] > low:
                    take(low, 1)
                    held[-1:] = sorted((int(first[best]), int(second[best])), reverse=True)
                    take(held[-1])
                    take(held[-2])
        at = 0
        for k in held:
            i = stacks[k].pop()
            seq[i], offset[i] = number, at
            at += k
        left -= len(held)
        number += 1
    return seq, offset


def packed(parts: DataFrame, room: int = LENGTH, per_group: int = 50_000) -> DataFrame:
    """`parts` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    parts = written(parts)
    groups = max(1, -(-parts.count() // per_group))
    dealt = parts.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(key, table):
        seq, offset = best_two_fit(table["length"].to_numpy(), room)
        return table.append_column("sequence_id", pa.array(seq + (key[0].as_py() << 32))).append_column("offset", pa.array(offset)).drop_columns(["g"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    return dealt.groupBy("g").applyInArrow(run, f"{fields}, sequence_id long, offset long")


@query("op7_best_two_fit")
def op7(spark, d):
    return packed(pieces(load(spark, d, "documents")))


def stage(spark, docs: DataFrame, d: str) -> DataFrame:
    """The packed pieces of `docs`, the pipeline's last result."""
    return packed(pieces(docs))
