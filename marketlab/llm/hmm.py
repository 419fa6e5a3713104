"""Operator 10: hidden Markov language model, trained by Baum-Welch over all partitions.

States emit word classes: every word with a share of at least 1 / 5000 of the training tokens is a class of its own, the others
fall into classes by their ending; within its class a word has the smoothed share (c + 1) / (N_class + V_class + 1), which leaves
one place for unknown words. So the emissions are a bounded table while the word counts grow with the corpus and never leave
Spark: words with a share of at least 1e-6 (a million at most) go to the tasks, the counts of the others are joined.

Texts are encoded once. An E-step runs over all training rows; partitions return expected counts which Spark sums, the driver
divides. Training cuts sequences of over `segment` tokens into stretches, scoring never does: the scaled forward recursion gives the exact
likelihood of the whole sequence. The start of the training is fitted on a bounded sample of `sample` rows.

Null texts are empty (one end token); rows repeat freely; with no training rows every probability is uniform and every word
unknown; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import load, lowest, query, written
from marketlab.llm.words import U, Lookup, Words, blocks, mix, per_row

STATES, ENDINGS, OWN_SHARE, KNOWN_SHARE, SAMPLE, SEGMENT = 12, 512, 1 / 5000, 1e-6, 1500, 2048
END = np.int64(1)  # the hash that stands for the end token


def endings(words: Words) -> np.ndarray:
    """Class number by the last three bytes of each word, the missing ones being 0."""
    data, n = words.block.data, words.end - words.start
    last = [np.where(n > j, data[np.maximum(words.end - 1 - j, 0)] if len(data) else 0, 0).astype(U) for j in range(3)]
    return (mix(last[0] | (last[1] << U(8)) | (last[2] << U(16)), 31) % U(ENDINGS)).astype(np.int32)


def _counts(batches):
    for b in batches:
        learn = ~b["held_out"].to_numpy(zero_copy_only=False)
        for block in blocks(b["text"], 8 << 20):
            own = learn[block.first: block.first + block.rows]
            words = block.words(True)
            mine = own[words.row]
            h, at, n = np.unique(words.hash[mine], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.append(h.view(np.int64), END)), pa.array(np.append(endings(words)[mine][at], np.int32(-1))),
                pa.array(np.append(n, own.sum()).astype(np.int64))], names=["h", "ending", "c"])


class Vocabulary:
    """The bounded part of the model: classes, and counts of the words that a million entries hold."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
        self.tokens, self.types = int(total[0] or 0), int(total[1])
        known = counts.where(F.col("c") >= KNOWN_SHARE * self.tokens).toArrow()
        order = np.argsort(known["h"].to_numpy().view(U))
        self.keys, self.c = known["h"].to_numpy().view(U)[order], known["c"].to_numpy()[order]
        ending = known["ending"].to_numpy()[order]
        alone = (self.c >= OWN_SHARE * self.tokens) | (ending < 0)
        self.classes = ENDINGS + int(alone.sum())
        self.cls = np.where(alone, ENDINGS + np.cumsum(alone) - 1, ending)
        self.end = int(self.cls[np.flatnonzero(self.keys == U(END))[0]]) if (self.keys == U(END)).any() else self._add_end()
        n, v = np.zeros(self.classes), np.zeros(self.classes)
        for r in counts.where("ending >= 0").groupBy("ending").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            n[r["ending"]], v[r["ending"]] = r["n"], r["v"]
        single = alone & (ending >= 0)
        np.subtract.at(n, ending[single], self.c[single])
        np.subtract.at(v, ending[single], 1)
        self.spread = np.log10(n + v + 1)  # log10 of a class's denominator, of use for the first ENDINGS classes
        self.share = np.where(np.arange(self.classes) < ENDINGS, n + 1, 1.0)
        self.share[self.cls[alone]] = self.c[alone]
        self.share /= self.share.sum()

    def _add_end(self) -> int:
        self.classes += 1
        return self.classes - 1


def _encode(vocabulary: Vocabulary):
    def run(batches):
        lookup, voc = Lookup(vocabulary.keys), vocabulary
        end_c = voc.c[voc.keys == U(END)].sum()
        for b in batches:
            for block in blocks(b["text"], 4 << 20):
                words = block.words(True)
                at = lookup(words.hash)
                ending, rare = endings(words), at < 0
                cls = np.where(rare, ending, voc.cls[at] if len(voc.cls) else ending)
                logc = np.where(rare, 0.0, np.log10(voc.c[at] + 1.0) if len(voc.c) else 0.0)
                inner = np.where(cls < ENDINGS, logc - voc.spread[np.minimum(cls, ENDINGS - 1)], 0.0)
                n = words.n
                seq = np.full(len(cls) + block.rows, voc.end, np.uint16)
                ends = np.cumsum(n + 1)
                keep = np.ones(len(seq), bool)
                keep[ends - 1] = False
                seq[keep] = cls
                hashes, offsets = words.hash[rare].view(np.int64), np.concatenate([[0], np.cumsum(np.bincount(words.row[rare], minlength=block.rows))])
                raw = seq.tobytes()
                cut = np.concatenate([[0], ends]) * 2
                yield pa.RecordBatch.from_arrays([
                    *(b[c].slice(block.first, block.rows) for c in ("uid", "doc_id", "held_out")),
                    pa.array((n + 1).astype(np.int64)), pa.array([raw[x:y] for x, y in zip(cut, cut[1:], strict=False)], pa.binary()),
                    pa.array(per_row(words.row, block.rows, (~rare).astype(np.int64)) + int(end_c > 0)),
                    pa.array(per_row(words.row, block.rows, logc) + np.log10(end_c + 1.0)), pa.array(per_row(words.row, block.rows, inner)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes))],
                    names=["uid", "doc_id", "held_out", "n_tokens", "seq", "known", "logc", "inner", "rare"])
    return run


def _batches(seqs: list[np.ndarray], most: int = 300_000):
    """Indices of sequences of like length, longest first, in groups of a bounded padded size."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    first = 0
    while first < len(order):
        n = max(1, min(768, most // max(1, len(seqs[order[first]]))))
        yield order[first: first + n]
        first += n


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in seqs])
    obs = np.zeros((size[0], len(seqs)), np.uint16)
    for i, s in enumerate(seqs):
        obs[: len(s), i] = s
    live = (size[None] > np.arange(size[0])[:, None]).sum(1)
    return obs, live


def forward(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Exact log10 likelihoods; `emit` is classes x states, only the current step is held."""
    out = np.zeros(len(seqs))
    for group in _batches(seqs, 4_000_000):
        obs, live = _padded([seqs[i] for i in group])
        total, a = np.zeros(len(group)), None
        for t in range(len(obs)):
            m = live[t]
            a = (start if t == 0 else a[:m] @ move) * emit[obs[t, :m]]
            c = a.sum(1)
            a /= c[:, None]
            total[:m] += np.log10(c)
        out[group] = total
    return out


def expected(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of first states, moves and emissions (classes x states) by forward-backward."""
    k = len(start)
    first, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros(emit.shape)
    for group in _batches(seqs):
        obs, live = _padded([seqs[i] for i in group])
        steps = len(obs)
        alpha, scale = np.zeros((steps, len(group), k)), np.ones((steps, len(group)))
        for t in range(steps):
            m = live[t]
            a = (start if t == 0 else alpha[t - 1, :m] @ move) * emit[obs[t, :m]]
            scale[t, :m] = c = a.sum(1)
            alpha[t, :m] = a / c[:, None]
        beta = np.ones((len(group), k))
        back = move.T.copy()
        for t in range(steps - 1, 0, -1):
            m = live[t]
            ahead = emit[obs[t, :m]] * beta[:m] / scale[t, :m, None]
            moves += alpha[t - 1, :m].T @ ahead
            alpha[t, :m] *= beta[:m]
            beta[:m] = ahead @ back
        alpha[0] *= beta
        first += alpha[0].sum(0)
        valid = np.arange(len(group))[None] < live[:, None]
        seen, gamma = obs[valid], alpha[valid]
        for j in range(k):
            emits[:, j] += np.bincount(seen, gamma[:, j], len(emits))
    return first, moves * move, emits


def divided(first, moves, emits, share) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities from expected counts, with one pseudo-count per state and row."""
    emits = emits + share[:, None]
    return (first + 1) / (first + 1).sum(), (moves + 1) / (moves + 1).sum(1, keepdims=True), emits / emits.sum(0)


def _stretches(column, segment: int) -> list[np.ndarray]:
    seqs = [np.frombuffer(x.as_py(), np.uint16) for x in column]
    return [s[i: i + segment] for s in seqs for i in range(0, len(s), segment)]


def trained(rows: DataFrame, voc: Vocabulary, states: int = STATES, rounds: int = 2, sample: int = SAMPLE):
    """Baum-Welch: a start on the sample's rows, then `rounds` passes over all training rows."""
    learn = rows.where("not held_out").select("uid", "seq")
    some = lowest(learn.withColumn("u", F.xxhash64("uid")), "u", sample).orderBy("u", "uid").limit(sample).select("seq").toArrow()["seq"]
    seqs = [s[i: i + 256] for s in _stretches(some, 8 * SEGMENT) for i in range(0, len(s), 256)]
    rng = np.random.default_rng(3)
    emits = voc.share[:, None] * rng.gamma(0.5, 1, (voc.classes, states)) * 1000
    model = divided(np.ones(states), np.eye(states) * 50 * states, emits, voc.share)
    for _ in range(12 if seqs else 0):
        model = divided(*expected(seqs, *model), voc.share)

    def run(now):
        def e_step(batches):
            sums = [np.zeros(now[0].shape), np.zeros(now[1].shape), np.zeros(now[2].shape)]
            for b in batches:
                for total, more in zip(sums, expected(_stretches(b["seq"], SEGMENT), *now), strict=True):
                    total += more
            flat = np.concatenate([x.ravel() for x in sums])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["at", "n"])
        return e_step

    for _ in range(rounds if seqs else 0):
        flat = np.zeros(states + states * states + voc.classes * states)
        found = learn.select("seq").mapInArrow(run(model), "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        flat[found["at"].to_numpy()] = found["n"].to_numpy()
        model = divided(flat[:states], flat[states: states * (states + 1)].reshape(states, states),
                        flat[states * (states + 1):].reshape(voc.classes, states), voc.share)
    return model


def scored(docs: DataFrame, held_out, states: int = STATES, rounds: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; `held_out` is a boolean column."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = written(docs.select("held_out", "text").mapInArrow(_counts, "h long, ending int, c long")
                     .groupBy("h").agg(F.min("ending").alias("ending"), F.sum("c").alias("c")).where("c > 0"))
    voc = Vocabulary(counts)
    rows = written(docs.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(
        _encode(voc), "uid long, doc_id long, held_out boolean, n_tokens long, seq binary, known long, logc double, inner double, rare array<long>"))
    model = trained(rows, voc, states, rounds)

    def score(batches):
        for b in batches:
            own = forward([np.frombuffer(x.as_py(), np.uint16) for x in b["seq"]], *model)
            yield b.drop_columns(["seq"]).append_column("own", pa.array(own))

    rare = (rows.select("uid", F.explode("rare").alias("h")).join(counts.where(F.col("c") < KNOWN_SHARE * voc.tokens).select("h", "c"), "h")
            .groupBy("uid").agg(F.count(F.lit(1)).alias("r_known"), F.sum(F.log10(F.col("c") + 1)).alias("r_logc")))
    done = rows.drop("rare").mapInArrow(score, "uid long, doc_id long, held_out boolean, n_tokens long, known long, logc double, inner double, own double")
    whole = F.log10(F.lit(float(voc.tokens + voc.types + 1)))
    more = F.coalesce("r_logc", F.lit(0.0))
    return done.join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("r_known", F.lit(0))).alias("n_known"), F.lit(voc.tokens).cast("long").alias("train_tokens"),
        (F.col("logc") + more - F.col("n_tokens") * whole).alias("base_score"), (F.col("own") + F.col("inner") + more).alias("score"))


@query("op10_hidden_markov_model")
def op10(spark, d):
    return scored(load(spark, d, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
