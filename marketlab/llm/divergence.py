"""Operator 1: quality rules by distribution divergence.

A document's character classes and common words are compared with its language's reference, the sums over all documents of
that language, by the Jensen-Shannon distance (base 2, 0 to 1). A document fails if either distance passes its threshold;
below `least_words` words only the base rules judge. Sampling noise alone makes short texts differ, so a threshold is widened by
`slack / sqrt(n)`. Common words are those with a share of at least `word_share` of a language's words, at most 1 / word_share of
them. References of languages of `lang_words` words or more are broadcast. A smaller language fits a task, and its documents are
judged there against their own sums, however few: a language of one document is its own reference, so that document's distances are 0.

Null texts are empty; documents of null language are judged by the base rules alone; each row is judged by itself,
so repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import load, query, written
from marketlab.llm.words import GAP, U, Lookup, Words, blocks


@dataclass(frozen=True)
class Limits:
    class_distance: float = 0.25
    word_distance: float = 0.3
    slack: float = 1.5
    least_words: int = 50
    word_share: float = 0.002
    lang_words: int = 10_000


#: Byte classes: lower and upper case ASCII letters, other scripts' lead bytes, digits, white space, sentence marks, symbols, the rest.
CLASSES = 8
KIND = np.full(256, 7, np.uint8)
KIND[97:123], KIND[65:91], KIND[0xC0:], KIND[48:58], KIND[GAP] = 0, 1, 2, 3, 4
KIND[[ord(c) for c in ".,;:!?'\"()-"]], KIND[[ord(c) for c in "#*$%&|<>"]], KIND[0x80:0xC0] = 5, 6, 8  # 8: continuation bytes, not counted


def class_counts(block) -> np.ndarray:
    at = block.row_of(np.arange(len(block.data)))
    return np.bincount(at * 9 + KIND[block.data], minlength=block.rows * 9).reshape(block.rows, 9)[:, :CLASSES]


def base_counts(block, words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a block."""
    data, rows = block.data, block.rows
    at = block.row_of(np.arange(len(data)))
    char = ((data & 0xC0) != 0x80) & ~GAP[data]
    symbol = np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))
    start, end = block.spans(data != 10)
    solid = np.concatenate([[0], np.cumsum(~GAP[data])])
    full = solid[end] > solid[start]
    start, end = start[full], end[full]
    line = (block.row_of(start).astype(U) << U(52)) | (block.hashes(start, end, False) >> U(12))
    first, n = np.unique(line, return_counts=True)
    dup = np.bincount((first >> U(52)).astype(np.int64), n - 1, rows).astype(np.int64)
    i, gram = words.grams(3)
    key = (words.row[i].astype(U) << U(52)) | (gram >> U(12))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words.hash) + 2, bool)
    for j in range(3):
        hit[i[twice] + j] = True
    return {"n_words": words.n, "word_chars": np.bincount(at[char], minlength=rows), "n_symbols": np.bincount(at[symbol], minlength=rows),
            "n_dup_lines": dup, "n_repeat_words": np.bincount(words.row[hit[: len(words.hash)]], minlength=rows)}


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of rows of counts; 0 for empty rows."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = q / np.maximum(q.sum(1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        each = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.maximum(each.sum(1) / 2, 0)) * (p.sum(1) > 0)


def _parts(batches):
    """Per batch, language and member its count: classes as members below 9, words as their hash."""
    for b in batches:
        langs = b["lang"].dictionary_encode()
        code, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary
        for block in blocks(b["text"], 8 << 20):
            own = code[block.first: block.first + block.rows]
            words, classes = block.words(False), class_counts(block)
            for k in np.unique(own[~np.isnan(own)] if own.dtype.kind == "f" else own).astype(int):
                mine = own == k
                h, n = np.unique(words.hash[mine[words.row]], return_counts=True)
                members = np.concatenate([np.arange(CLASSES), h.view(np.int64)])
                yield pa.RecordBatch.from_arrays([
                    pa.array([names[k].as_py()] * len(members)), pa.array(members), pa.array(np.repeat([True, False], [CLASSES, len(h)])),
                    pa.array(np.concatenate([classes[mine].sum(0), n]).astype(np.int64))], names=["lang", "member", "is_class", "n"])


def references(docs: DataFrame, limits: Limits) -> tuple[dict[str, tuple], bool]:
    """Per language its class counts, its common words' hashes (sorted) and their counts with the rest in the end; whether there are smaller languages."""
    counts = written(docs.select("lang", "text").mapInArrow(_parts, "lang string, member long, is_class boolean, n long")
                     .groupBy("lang", "is_class", "member").agg(F.sum("n").alias("n")))
    sizes = counts.where("not is_class").groupBy("lang").agg(F.sum("n").alias("total"))
    small = bool(sizes.where((F.col("total") < limits.lang_words) & F.col("lang").isNotNull()).take(1))
    sizes = sizes.where(F.col("total") >= limits.lang_words)
    rows = counts.join(F.broadcast(sizes), "lang").where(F.col("is_class") | (F.col("n") >= limits.word_share * F.col("total"))).collect()
    out = {}
    for lang in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == lang]
        classes = np.zeros(CLASSES)
        for r in own:
            if r["is_class"]:
                classes[r["member"]] = r["n"]
        words = sorted((np.int64(r["member"]).view(U), r["n"]) for r in own if not r["is_class"])
        n = [x[1] for x in words]
        out[lang] = classes, np.array([x[0] for x in words], U), np.array([*n, own[0]["total"] - sum(n)], float)
    return out, small


def own_reference(texts: pa.Array, limits: Limits) -> tuple:
    """As `references`, of the texts of one small language."""
    classes, hashes = np.zeros(CLASSES), [np.zeros(0, U)]
    for block in blocks(texts):
        classes += class_counts(block).sum(0)
        hashes.append(block.words(False).hash)
    h, n = np.unique(np.concatenate(hashes), return_counts=True)
    common = n >= limits.word_share * n.sum()
    return classes, h[common], np.append(n[common], n[~common].sum()).astype(float)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judged(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    refs, small = references(docs, limits)

    def run(batches, refs=refs):
        tables = {k: (c, Lookup(w), n) for k, (c, w, n) in refs.items()}
        for b in batches:
            langs = np.array(b["lang"].to_pylist(), object)
            for block in blocks(b["text"]):
                words, own = block.words(False), langs[block.first: block.first + block.rows]
                counts, classes = base_counts(block, words), class_counts(block)
                far = np.zeros((2, block.rows))
                for lang in {x for x in own if x in tables}:
                    mine = np.flatnonzero(own == lang)
                    reference, lookup, n = tables[lang]
                    far[0, mine] = distance(classes[mine], reference[None])
                    new = np.full(block.rows, -1)
                    new[mine] = np.arange(len(mine))
                    use = new[words.row] >= 0
                    at = lookup(words.hash[use])
                    at[at < 0] = len(n) - 1
                    hist = np.bincount(new[words.row[use]] * len(n) + at, minlength=len(mine) * len(n)).reshape(-1, len(n))
                    far[1, mine] = distance(hist, n[None])
                n = counts["n_words"]
                wide = limits.slack / np.sqrt(np.maximum(n, 1))
                failed = (n < 50) | (100 * counts["n_repeat_words"] > 50 * n)
                odd = (n >= limits.least_words) & ((far[0] > limits.class_distance + wide / 5) | (far[1] > limits.word_distance + wide))
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(block.first, block.rows), *[pa.array(counts[c].astype(np.int64)) for c in COUNTS],
                     pa.array(failed), pa.array(~failed & ~odd), pa.array(far[0]), pa.array(far[1])],
                    names=["doc_id", *COUNTS, "base_failed", "kept", "class_distance", "word_distance"])

    def alone(table):
        table = table.combine_chunks()
        lang = table["lang"][0].as_py()
        return pa.Table.from_batches(run(table.to_batches(), {lang: own_reference(table["text"], limits)}))

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, class_distance double, word_distance double"
    if not small:
        return docs.mapInArrow(run, schema)
    main = F.col("lang").isNull() | F.col("lang").isin(list(refs)) | (F.coalesce(F.length("text"), F.lit(0)) == 0)
    return docs.where(main).mapInArrow(run, schema).unionByName(docs.where(~main).groupBy("lang").applyInArrow(alone, schema))


@query("op1_distribution_divergence")
def op1(spark, d):
    return judged(load(spark, d, "documents"))
