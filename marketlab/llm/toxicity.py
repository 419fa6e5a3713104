"""Operator 8: toxicity by a linear-chain conditional random field over tokens.

The labels mark documents. Token labels are drawn from them: among all labelled training texts, near copies counting once, the
tokens, and tokens with first bytes, whose document frequency among toxic texts is far above that among clean ones (ratio and
log-likelihood) are marked, and offending where they stand in a toxic text. A two-label chain with features of the token, its neighbours and
its ends, and of being marked, is fitted to these sequences; so a marked term counts even where the fit has no text with it; forward-backward gives each token's marginal. A document's score is a logistic function, fitted to the document labels, of its largest
marginal and of the logarithm of their sum; its offending spans are the runs of tokens above one half, in code points.

The fit takes the `sample` labelled rows with the smallest id hashes of each label, near copies counting once, and shifts the intercept to the share of
each label among all labelled rows; that bound is the only one, every whole text is scored. A token is a run of letters, digits and bytes beyond ASCII, A-Z folded. Null and empty texts have no
marginals and get the score of the intercept; without labelled rows of both labels every score is 0; several labels of an id
count as toxic if one is; extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import load, lowest, query, written
from marketlab.llm.neardup import one_permutation
from marketlab.llm.similar import band_hashes
from marketlab.llm.words import SET_MASK, U, Words, blocks, mix

SAMPLE, BITS, RATIO, LEAST, EVIDENCE, EPOCHS = 3000, 17, 30.0, 3, 12.0, 4
STRETCH = 500_000  # tokens scored at once
_b = np.arange(256)
INNER = (_b >= 0x80) | ((_b >= 48) & (_b < 58)) | ((_b | 32 >= 97) & (_b | 32 < 123))
PREFIXES = (4, 5, 6, 7, 8)  # bytes
TABLES = 5 + len(PREFIXES)
TERMS = 1 + len(PREFIXES)


class Tokens(Words):
    """Words of letters and digits."""

    def __init__(self, block):
        self.block = block
        self.start, self.end = block.spans(INNER[block.data])
        self.hash = block.hashes(self.start, self.end, True)
        self.row = block.row_of(self.start)
        self.n = np.bincount(self.row, minlength=block.rows)
        self.first = np.cumsum(self.n) - self.n

    def leads(self) -> list[np.ndarray]:
        """For each length of PREFIXES the hash of a token's first bytes, 0 where it isn't longer than that."""
        data, n, h, out = self.block.data, self.end - self.start, np.zeros(len(self.hash), U), []
        for j in range(max(PREFIXES)):
            h = h * U(257) + np.where(n > j, data[np.where(n > j, self.start + j, 0)] | 32 if len(n) else 0, 0).astype(U)
            if j + 1 in PREFIXES:
                out.append(np.where(n > j + 1, mix(h, j), U(0)))
        return out

    def terms(self) -> list[np.ndarray]:
        """Upper 52 bits of the hashes of a token and of each length of its first bytes, 0 where it has none."""
        return [h >> U(12) for h in (self.hash, *self.leads())]

    def marked(self, terms: list[np.ndarray]) -> np.ndarray:
        """Whether a token or its first bytes are among the marked terms."""
        return np.logical_or.reduce([np.isin(h, known) & (h > 0) for h, known in zip(self.terms(), terms, strict=True)])

    def features(self, terms: list[np.ndarray]) -> np.ndarray:
        """Per token a place in each feature table: itself, the one before, the one after, its last bytes, its first bytes, whether it is marked."""
        n, data = len(self.hash), self.block.data
        before, after, last = np.zeros(n, U), np.zeros(n, U), np.zeros(n, U)
        if n > 1:
            same = self.row[1:] == self.row[:-1]
            before[1:][same], after[:-1][same] = self.hash[:-1][same], self.hash[1:][same]
        for j in range(4):
            inside = (self.end - self.start) > j
            last = last * U(257) + np.where(inside, data[np.where(inside, self.end - 1 - j, 0)] | 32 if n else 0, 0).astype(U)
        places = [(mix(h, i + 1) >> U(64 - BITS)).astype(np.int32) for i, h in enumerate((self.hash, before, after, last, *self.leads()))]
        return np.stack([*places, self.marked(terms).astype(np.int32)], 1)


def _groups(sizes: np.ndarray, most: int = 1_000_000):
    order = np.argsort(-sizes, kind="stable")
    first = 0
    while first < len(order) and sizes[order[first]]:
        n = max(1, min(2048, most // int(sizes[order[first]])))
        yield order[first: first + n][sizes[order[first: first + n]] > 0]
        first += n


def _step(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Message of a label's log odds `x` through the transition scores t[from, to]."""
    return np.logaddexp(t[0, 1], x + t[1, 1]) - np.logaddexp(t[0, 0], x + t[1, 0])


def marginals(score: np.ndarray, first: np.ndarray, sizes: np.ndarray, move: np.ndarray, pairs: bool = False):
    """P(label 1) of each token of many sequences (tokens `first` to `first + size`), and the expected moves if asked for."""
    out, moves = np.zeros(len(score)), np.zeros((2, 2))
    for group in _groups(sizes):
        n, size = int(sizes[group[0]]), sizes[group]
        live = (size[None] > np.arange(n)[:, None]).sum(1)
        at = np.minimum(first[group][None] + np.arange(n)[:, None], len(score) - 1)
        s = score[at]
        a, b = np.zeros((n, len(group))), np.zeros((n, len(group)))
        a[0] = s[0]
        for t in range(1, n):
            m = live[t]
            a[t, :m] = s[t, :m] + _step(a[t - 1, :m], move)
        for t in range(n - 2, -1, -1):
            m = live[t + 1]
            b[t, :m] = _step(s[t + 1, :m] + b[t + 1, :m], move.T)
        valid = np.arange(n)[:, None] < size[None]
        out[at[valid]] = 1 / (1 + np.exp(-np.clip((a + b)[valid], -60, 60)))
        if pairs and n > 1:
            both = valid[1:]
            x, y = a[:-1][both], (s[1:] + b[1:])[both]
            raw = np.stack([np.zeros(len(x)) + move[0, 0], y + move[0, 1], x + move[1, 0], x + y + move[1, 1]], 1)
            raw = np.exp(raw - raw.max(1, keepdims=True))
            moves += (raw / raw.sum(1, keepdims=True)).sum(0).reshape(2, 2)
    return out, moves


class Model:
    """Feature tables, transition scores, marked terms and the document's logistic coefficients; `ready` is false without examples."""

    def __init__(self):
        self.w, self.move, self.coef, self.ready = np.zeros((TABLES, 1 << BITS), np.float32), np.zeros((2, 2)), np.zeros(3), False
        self.terms = [np.zeros(0, U)] * TERMS

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sum((self.w[j][features[:, j]] for j in range(TABLES)), np.zeros(len(features))).astype(np.float64)

    def fit(self, texts: pa.Array, toxic: np.ndarray, terms: list[np.ndarray], odds: float = 0.0) -> Model:
        """Fit to texts that are no copies of each other; `odds` is the log odds of label 1 in the sample beyond those of all labelled rows."""
        self.terms = terms
        n = sum(int(np.count_nonzero(np.diff(INNER[b.data], prepend=False, append=False))) // 2 + b.rows for b in blocks(texts))
        row, feat, at = np.empty(n, np.int32), np.empty((n, TABLES), np.int32), 0  # n: as many tokens at most
        for b in blocks(texts):
            t = Tokens(b)
            to = at + len(t.row)
            row[at: to], feat[at: to], at = t.row + b.first, t.features(terms), to
        row, feat = row[:at], feat[:at]
        sizes = np.bincount(row, minlength=len(texts))
        label = (feat[:, -1] == 1) & (toxic[row] == 1)
        # stretches of 256 tokens
        first, size = [], []
        begin = np.cumsum(sizes) - sizes
        for i in range(len(texts)):
            for x in range(0, sizes[i], 256):
                first.append(begin[i] + x)
                size.append(min(256, sizes[i] - x))
        first, size = np.array(first, np.int64), np.array(size, np.int64)
        rng, sums, move_sums = np.random.default_rng(1), np.full(self.w.shape, 1e-3), np.full((2, 2), 1e-3)
        for _ in range(EPOCHS if len(first) else 0):
            for some in np.array_split(rng.permutation(len(first)), max(1, len(first) // 300)):
                take = np.concatenate([np.arange(f, f + n) for f, n in zip(first[some], size[some], strict=True)])
                begin_at = np.cumsum(size[some]) - size[some]
                p, moves = marginals(self.scores(feat[take]), begin_at, size[some], self.move, True)
                y = label[take].astype(float)
                for j in range(TABLES):
                    grad = np.bincount(feat[take, j], y - p, 1 << BITS) - 1e-4 * self.w[j]
                    sums[j] += grad * grad
                    self.w[j] += (0.3 * grad / np.sqrt(sums[j])).astype(np.float32)
                inner = np.ones(len(take), bool)
                inner[begin_at] = False
                z = y.astype(int)
                seen_moves = np.zeros((2, 2))
                np.add.at(seen_moves, (z[:-1][inner[1:]], z[1:][inner[1:]]), 1)
                grad = seen_moves - moves
                move_sums += grad * grad
                self.move += 0.1 * grad / np.sqrt(move_sums)
        x = np.zeros((len(texts), 3))
        edge = np.append(begin, at)
        cut = np.unique([0, *np.searchsorted(begin, np.arange(0, at, STRETCH)), len(texts)])
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            mine = slice(edge[lo], edge[hi])
            p, _ = marginals(self.scores(feat[mine]), begin[lo:hi] - begin[lo], sizes[lo:hi], self.move)
            x[lo:hi] = self.inputs(p, row[mine] - lo, hi - lo)
        self.coef, y = np.zeros(3), toxic.astype(float)
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(x @ self.coef, -30, 30)))
            self.coef = self.coef + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1]), x.T @ (y - q) - np.array([0, 0.1, 0.1]) * self.coef)
        self.coef[0] -= odds
        self.ready = True
        return self

    @staticmethod
    def inputs(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        most = np.zeros(rows)
        np.maximum.at(most, row, p)
        return np.stack([np.ones(rows), most, np.log1p(np.bincount(row, p, rows))], 1)


def _bands(batches):
    """Keys of each row, one of which near copies share; texts of up to 5 tokens have their whole sequence as key."""
    for b in batches:
        for block in blocks(b["text"]):
            t = Tokens(block)
            r, members = t.sets(2)
            bands = band_hashes(one_permutation(r, members, block.rows), 6).copy()
            short, whole = np.flatnonzero(t.n <= 5), np.zeros(int((t.n <= 5).sum()), U)
            for j in range(5):
                has = t.n[short] > j
                whole[has] = whole[has] * U(257) + t.hash[t.first[short[has]] + j]
            wide = np.where(t.n > 5, bands.shape[1], 1)
            bands[short, 0] = mix(whole, 99).view(bands.dtype)
            keep = np.arange(bands.shape[1])[None] < wide[:, None]
            yield pa.RecordBatch.from_arrays([*(b[c].slice(block.first, block.rows) for c in ("doc_id", "r")),
                                              pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(wide)), pa.int32()), pa.array(bands[keep].view(np.int64)))],
                                             names=["doc_id", "r", "bands"])


def _frequencies(batches):
    """Per stretch of some 8 MB of text the number of toxic and of clean texts that hold a term."""
    for b in batches:
        found = [[] for _ in range(TERMS)]
        for block in blocks(b["text"]):
            toxic = b["clean"].slice(block.first, block.rows).to_numpy() == 0
            t = Tokens(block)
            for k, h in enumerate(t.terms()):
                pair = np.unique(((t.row.astype(U) << U(52)) | h)[h > 0])
                bad = toxic[(pair >> U(52)).astype(np.int64)]
                found[k].append(_totals(pair & SET_MASK, bad, ~bad))
            if len(found[0]) == 8:
                yield from _counted(found)
                found = [[] for _ in range(TERMS)]
        yield from _counted(found)


def _totals(word: np.ndarray, a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word once, with the sums of its `a` and `c`."""
    word, code = np.unique(word, return_inverse=True)
    return word, *(np.bincount(code, x, len(word)).astype(np.int64) for x in (a, c))


def _counted(found: list[list]):
    for k, parts in enumerate(found):
        if parts:
            word, a, c = _totals(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), k, np.int32)), pa.array(word.view(np.int64)), pa.array(a), pa.array(c)], names=["k", "term", "a", "c"])


def distinct(docs: DataFrame, marks: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The rows (clean, r, text) of the marked documents without near copies, and the rows of each label before that.

    Of rows that share a key the first by label, toxic before clean, and hash stays. Keys find the survivors, so the texts are
    exchanged once; that join sorts both sides at every size, as it must beyond the size of a broadcast.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r"))
    signed = docs.mapInArrow(_bands, "doc_id long, r long, bands array<long>")
    signed = written(signed.join(marks, "doc_id").select((1 - F.col("toxic")).alias("clean"), "r", "bands"))
    count = {1 - r["clean"]: r["count"] for r in signed.groupBy("clean").count().collect()}
    keys = signed.select("clean", "r", F.explode("bands").alias("band"))
    heads = keys.groupBy("band").agg(F.min(F.struct("clean", "r")).alias("head"))
    later = keys.join(heads, "band").where(F.struct("clean", "r") > F.col("head")).select("r").distinct()
    first = signed.select("clean", "r").distinct().join(later, "r", "left_anti")
    return written(docs.select("r", "text").join(first.hint("merge"), "r").dropDuplicates(["r"])), count


def offending(rows: DataFrame, n1: int, n0: int) -> list[np.ndarray]:
    """Marked terms of tokens and of each length of first bytes, by document frequencies over all `rows`."""
    counts = rows.mapInArrow(_frequencies, "k int, term long, a long, c long").groupBy("k", "term").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    share = (a + c) / (n1 + n0)
    ratio = (a + 0.5) / (n1 + 1) / ((c + 0.5) / (n0 + 1))
    g = 2 * (a * F.log(a / (share * n1)) + F.when(c > 0, c * F.log(c / (share * n0))).otherwise(0.0))
    found = counts.where((a >= LEAST) & (ratio >= RATIO) & (g >= EVIDENCE)).select("k", "term").collect()
    return [np.array(sorted(r["term"] for r in found if r["k"] == k), np.int64).view(U) for k in range(TERMS)]


def _fitted(terms: list[np.ndarray], odds: float):
    """The one model of all rows (text, clean, r), pickled."""
    def fit(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            table = pa.Table.from_batches(parts).sort_by([("clean", "ascending"), ("r", "ascending")])
            del parts
            model = Model().fit(table["text"].cast(pa.large_string()).combine_chunks(), 1 - table["clean"].to_numpy(), terms, odds)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return fit


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled rows that are not held out: terms marked over all of them, a chain fitted to the bounded sample in one task."""
    marks = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows, count = distinct(docs.where("not held_out"), marks)
    if set(count) != {0, 1}:
        return Model()
    once = {1 - r["clean"]: r["count"] for r in rows.groupBy("clean").count().collect()}
    if set(once) != {0, 1}:
        return Model()
    terms = offending(rows, once[1], once[0])
    taken = {v: min(n, sample) for v, n in once.items()}
    odds = float(np.log(taken[1] / count[1]) - np.log(taken[0] / count[0]))

    some = [lowest(rows.where(F.col("clean") == 1 - v), "r", sample).select("text", "clean", "r") for v in (1, 0)]
    return pickle.loads(some[0].unionByName(some[1]).repartition(1).mapInArrow(_fitted(terms, odds), "model binary").first()["model"])


def _judged(model: Model):
    """Scores and spans of each row, in stretches of some `STRETCH` tokens: a task's memory doesn't follow the size of Spark's batches."""
    def one(b, at, p_of):
        row = np.concatenate([x[0] for x in at])
        sizes = np.bincount(row, minlength=b.num_rows)
        p, _ = marginals(np.concatenate(p_of).astype(float), np.cumsum(sizes) - sizes, sizes, model.move)
        x = model.inputs(p, row, b.num_rows)
        score = 1 / (1 + np.exp(-np.clip(x @ model.coef, -30, 30))) if model.ready else np.zeros(b.num_rows)
        hot = np.flatnonzero(p > 0.5)
        spans = [[] for _ in range(b.num_rows)]
        start, end = (np.concatenate([z[i] for z in at]) for i in (1, 2))
        for i in hot.tolist():
            own = spans[row[i]]
            if own and i > 0 and p[i - 1] > 0.5 and row[i - 1] == row[i]:
                own[-1]["end"] = int(end[i])
            else:
                own.append({"start": int(start[i]), "end": int(end[i])})
        return pa.RecordBatch.from_arrays(
            [b["doc_id"], b["held_out"], b["key"], pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            names=["doc_id", "held_out", "key", "score", "predicted", "spans"])

    def run(batches):
        for b in batches:
            first, at, p_of = 0, [], []
            for block in blocks(b["text"]):
                t = Tokens(block)
                lead = np.cumsum((block.data & 0xC0) != 0x80) if len(block.data) else np.zeros(0, np.int64)
                at.append(((t.row + block.first - first).astype(np.int32), *_points(t, block, lead)))
                p_of.append(model.scores(t.features(model.terms)).astype(np.float32))
                last = block.first + block.rows
                if last == b.num_rows or sum(map(len, p_of)) >= STRETCH:
                    yield one(b.slice(first, last - first), at, p_of)
                    first, at, p_of = last, [], []

    return run


def scored(docs: DataFrame, labels: DataFrame, held_out, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, key, score, predicted, spans) of each row of `docs`; `key` is the hash of id and text."""
    from marketlab.llm.neardup import key

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.col("text").cast("string").alias("text"), key().alias("key"))
    model = trained(docs, labels, sample)

    return docs.mapInArrow(_judged(model), "doc_id long, held_out boolean, key long, score double, predicted int, spans array<struct<start: int, end: int>>")


def _points(t: Tokens, block, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of tokens in code points from the start of their text."""
    upto = np.concatenate([[0], lead])
    base = upto[block.bounds[t.row]]
    return (upto[t.start] - base).astype(np.int32), (upto[t.end] - base).astype(np.int32)


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


@query("op8_toxic_span_crf")
def op8(spark, d):
    return scored(load(spark, d, "documents"), load(spark, d, "labels"), held_out()).select("doc_id", "held_out", "score", "predicted", "spans")


def stage(spark, docs: DataFrame, d: str) -> DataFrame:
    """Documents of `docs` that are not predicted toxic."""
    from marketlab.llm.neardup import key

    judged = scored(docs, load(spark, d, "labels"), held_out()).where("predicted = 0").select(F.col("key").alias("_key")).distinct()
    return docs.withColumn("_key", key()).join(judged, "_key", "left_semi").drop("_key")
