"""Operator 11: benchmark decontamination with one FM-index per shard of the training texts.

A shard is some whole texts of about 4 MB. Its words, numbered, make one sequence with a terminator after each text; the
suffix array comes from prefix doubling that sorts again only what is still tied. The index keeps the Burrows-Wheeler transform as a
wavelet matrix (packed bits and counts per 64), the first row of each word and the positions of every 16th word and of each text's
first. All phrases are searched at once, backwards, two ranks a level and step; rows found walk back to a sampled
position. Occurrences become removal spans by a running sum over the shard's words.

Phrases are the windows of the benchmark's items. They go to the tasks in parts of at most `PART` words, dealt by item; each part
is one more narrow pass over the texts that adds its spans and items, so a benchmark of any size is searched whole, and the
driver holds one part at a time. Terminators compare by place, so copies of a text don't tie beyond its end.

Null and empty texts have no words, spans or items; an item without words has no window; items are told apart by their id (null:
the empty name), so rows of one id are one item; repeated documents are judged one by one; extra columns pass through unless they
have the name of a result; empty tables give an empty result or documents without hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import load, query
from marketlab.llm.words import U, blocks

WINDOW, SAMPLE, SHARD, PART = 10, 16, 1 << 22, 4_000_000
#: Bytes of words: digits, letters and all of UTF-8 beyond ASCII.
SOLID = np.zeros(256, bool)
SOLID[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def suffix_array(symbols: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Suffix array of words numbered from 1; `stops` are the places of the terminators, which rank first and by place."""
    n = len(symbols)
    s = symbols + len(stops) - 1
    s[stops] = np.arange(len(stops))
    bits = int(s.max()).bit_length() or 1
    took = max(1, min(3, 62 // bits))
    key = s.copy()
    for k in range(1, took):
        key <<= bits
        key[:-k] |= s[k:]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        at = order[tied]
        key = (rank[at] << 31) | rank[at + took]
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[tied] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank[at] = tied[head]
        tied = tied[~(new & np.append(new[1:], True))]
        took *= 2
    return order


class Bits:
    """Bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, U)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before `at`."""
        block = at >> 6
        return self.before[block] + np.bitwise_count(self.words[block] & ((U(1) << (at & 63).astype(U)) - U(1)))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(U)) & U(1) > 0


class FMIndex:
    """Backward search and location over `symbols`, words numbered 1 to `top` with a 0 at each of `stops`, the last place included."""

    def __init__(self, symbols: np.ndarray, stops: np.ndarray, top: int):
        order = suffix_array(symbols, stops)
        last = symbols[order - 1]
        counts = np.bincount(symbols, minlength=top + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        sampled = (order % SAMPLE == 0) | (last == 0)
        self.sampled, self.places = Bits(sampled), order[sampled]
        self.levels = []
        x = last.astype(np.int32)
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (x >> bit) & 1 > 0
            self.levels.append((bit, Bits(ones), len(x) - int(ones.sum())))
            x = np.concatenate([x[~ones], x[ones]])
        self.begin = np.zeros(top + 1, np.int64)
        heads = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        self.begin[x[heads]] = heads

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases: `phrases` holds words (0: none of the shard's), right-aligned."""
        width = phrases.shape[1]
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.first[-1])
        live = np.arange(len(sizes))
        for k in range(1, width + 1):
            live = live[(sizes[live] >= k) & (low[live] < high[live])]
            if not len(live):
                break
            c = phrases[live, width - k]
            known = c > 0
            high[live[~known]] = low[live[~known]]
            live, c = live[known], c[known]
            ends = np.stack([low[live], high[live]])
            for bit, ones, zeros in self.levels:
                up = ones.rank(ends)
                ends = np.where((c >> bit) & 1 > 0, zeros + up, ends - up)
            low[live], high[live] = self.first[c] + ends - self.begin[c]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the rows' suffixes."""
        out, steps, left = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            done = self.sampled[rows[left]]
            hit = left[done]
            out[hit] = self.places[self.sampled.rank(rows[hit])] + steps[hit]
            left = left[~done]
            at, c = rows[left], np.zeros(len(left), np.int64)
            for bit, ones, zeros in self.levels:
                one, up = ones[at], ones.rank(at)
                at = np.where(one, zeros + up, at - up)
                c |= one.astype(np.int64) << bit
            rows[left] = self.first[c] + at - self.begin[c]
            steps[left] += 1
        return out


def _windows(window):
    """(item, words): the distinct windows of each item as word hashes."""
    def run(batches):
        for batch in batches:
            items = batch["item"].to_pylist()
            for block in blocks(batch["text"]):
                start, end = block.spans(SOLID[block.data])
                h, row = block.hashes(start, end, True).view(np.int64), block.row_of(start)
                n = np.bincount(row, minlength=block.rows)
                for r, (first, size) in enumerate(zip(np.cumsum(n) - n, n, strict=True)):
                    if size:
                        wide = min(window, size)
                        grams = np.unique(np.lib.stride_tricks.sliding_window_view(h[first: first + size], wide), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array([items[block.first + r]] * len(grams)), pa.array(list(grams), pa.list_(pa.int64()))],
                                                         names=["item", "words"])
    return run


class Phrases:
    """Distinct phrases of a part, right-aligned in `words`, and the items of each, as positions in the sorted names."""

    def __init__(self, rows: list, window: int):
        self.names = sorted({r["item"] for r in rows})
        at = {name: i for i, name in enumerate(self.names)}
        found: dict[tuple, list[int]] = {}
        for r in rows:
            found.setdefault(tuple(r["words"]), []).append(at[r["item"]])
        self.sizes = np.array([len(p) for p in found], np.int64)
        self.words = np.zeros((len(found), window), np.int64)
        for i, p in enumerate(found):
            self.words[i, window - len(p):] = p
        self.items = [np.array(x) for x in found.values()]


def _marked(phrases, window, shard):
    """One pass: adds to `n_words`, `spans` and `items` what this part's phrases hit."""
    known, number = np.unique(phrases.words, return_inverse=True)
    known, number = known.view(U), number.reshape(phrases.words.shape)
    by = np.argsort(known)
    known, back = known[by], np.argsort(by)
    inside = np.arange(window) >= window - phrases.sizes[:, None]

    def shard_of(block, spans, items):
        start, end = block.spans(SOLID[block.data])
        n = np.bincount(block.row_of(start), minlength=block.rows)
        words, symbols = np.unique(block.hashes(start, end, True), return_inverse=True)
        stops = np.cumsum(n + 1) - 1
        place = np.arange(len(symbols)) + np.repeat(np.arange(block.rows), n)
        text = np.zeros(len(symbols) + block.rows, np.int64)
        text[place] = symbols + 1
        cover = np.zeros(len(text) + 1, np.int64)
        for r, spent in enumerate(spans):
            for s in spent or ():
                cover[stops[r] - n[r] + s["start"]] += 1
                cover[stops[r] - n[r] + s["stop"]] -= 1
        at = np.searchsorted(words, known) if len(words) else np.zeros(len(known), np.int64)
        at = np.where(at < len(words), at, 0)
        own = np.where(words[at] == known, at + 1, 0) if len(words) else at
        wanted = np.where(inside, own[back][number], 0)
        able = np.flatnonzero(((wanted > 0) | ~inside).all(axis=1)) if len(words) else []
        if len(able):
            index = FMIndex(text, stops, len(words))
            low, high = index.search(wanted[able], phrases.sizes[able])
            many = high - low
            hits = [set(x or ()) for x in items]
            ends = np.cumsum(many)
            for a in range(0, int(ends[-1]), 1 << 20):
                row = np.arange(a, min(a + (1 << 20), int(ends[-1])))
                which = np.searchsorted(ends, row, side="right")
                found = index.locate(low[which] + row - (ends[which] - many[which]))
                np.add.at(cover, found, 1)
                np.add.at(cover, found + phrases.sizes[able[which]], -1)
                pairs = np.unique(np.searchsorted(stops, found) * len(phrases.sizes) + able[which])
                for doc, p in zip(*np.divmod(pairs, len(phrases.sizes)), strict=True):
                    hits[doc].update(phrases.items[p])
            items = [sorted(x if isinstance(x, str) else phrases.names[x] for x in h) for h in hits]
        hit = np.cumsum(cover)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        first, stop = edge[::2], edge[1::2]
        doc = np.searchsorted(stops, first)
        char = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
        base = (stops - n)[doc]
        word = first - doc, stop - doc - 1
        spans = [[] for _ in range(block.rows)]
        for d, a, b, c0, c1 in zip(doc, first - base, stop - base, char[start[word[0]]] - char[block.bounds[doc]], char[end[word[1]]] - char[block.bounds[doc]],
                                   strict=True):
            spans[d].append({"start": int(a), "stop": int(b), "from": int(c0), "to": int(c1)})
        return n, spans, [x or [] for x in items]

    def run(batches):
        for batch in batches:
            for block in blocks(batch["text"], shard):
                part = batch.slice(block.first, block.rows)
                n, spans, items = shard_of(block, part["spans"].to_pylist(), part["items"].to_pylist())
                made = {"n_words": pa.array(n), "spans": pa.array(spans, SPANS), "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([made.get(c, part[c]) for c in batch.schema.names], names=batch.schema.names)
    return run


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("from", pa.int32()), ("to", pa.int32())]))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part: int = PART, shard: int = SHARD) -> DataFrame:
    """`docs` with n_words, `spans` and `items`.

    `spans` are the merged hit words [start, stop) with their code points [from, to) in the text; `items` the sorted ids of the
    items with an occurring window. `part` bounds the words of phrases sent to a task at once, `shard` the bytes of a shard.
    """
    spark = docs.sparkSession
    found = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(
        _windows(window), "item string, words array<long>").distinct()
    total = found.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = -(-total // part)
    out = docs.drop("n_words", "spans", "items").withColumns({
        "text": F.col("text").cast("string"), "n_words": F.lit(0).cast("long"),
        "spans": F.array().cast("array<struct<start:int,stop:int,from:int,to:int>>"), "items": F.array().cast("array<string>")})
    for k in range(max(parts, 1)):
        rows = found.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).collect() if parts else []
        sent = spark.sparkContext.broadcast(Phrases(rows, window))
        out = out.mapInArrow(lambda batches, sent=sent: _marked(sent.value, window, shard)(batches), out.schema)
    return out


def cleaned(found: DataFrame) -> DataFrame:
    """The rows of `contaminated` with their spans cut out of the text."""
    spans = F.concat(F.col("spans"), F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"),
                                                     F.length("text").alias("from"), F.length("text").alias("to"))))
    kept = F.transform(spans, lambda s, i: F.substring(F.col("text"), F.when(i > 0, F.element_at(spans, i)["to"]).otherwise(0) + 1,
                                                       s["from"] - F.when(i > 0, F.element_at(spans, i)["to"]).otherwise(0)))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), F.array_join(kept, "")))


SQL = r"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
g AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p))),
o AS (SELECT r, i, g.m, phrase FROM g SEMI JOIN p USING (phrase)),
h AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS i FROM o) GROUP BY 1),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM o JOIN p USING (phrase)) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


@query("op11_fm_index", SQL)
def op11(spark, d):
    found = contaminated(load(spark, d, "documents").select("doc_id", "text"), load(spark, d, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
