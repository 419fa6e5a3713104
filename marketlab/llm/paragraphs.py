"""Operator 3: repeated paragraphs by MinHash bands, and repeated passages inside longer paragraphs.

A paragraph is a line of at least `PARAGRAPH` words (shorter ones have too few shingles to be told from set phrases). Its five-word shingles are signed by 36 permutations in 12 bands of 3, so a pair at
a similarity of 0.8 collides but for 2e-4. Colliding paragraphs are joined as stars and checked exactly, components take one
paragraph each, the first by document and place (see `similar`).

A passage that stands inside different paragraphs makes them no more alike than its share. Paragraphs are therefore also cut by content:
of any 35 neighbouring 16-word blocks the one of the smallest hash is an anchor, so a window of 50 words names one anchor, and the
same one wherever it stands. Windows whose anchor stands in several documents are hashed whole, and each finds its own first
document, whatever other texts hold the anchor; neighbouring windows with the same first document make a run. Always the smaller id keeps
its copy, so the smallest document of a passage never loses it.

Nulls, empty and short texts have no paragraph; rows that agree in id and text are one document; rows of null id take
no part; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlab.llm import similar
from marketlab.llm.common import dropped, folder, load, query, written
from marketlab.llm.neardup import key, set_ids
from marketlab.llm.words import U, Block, blocks, mix

PARAGRAPH, LEAST, SHINGLE, PLACES, ROWS, PERCENT = 10, 50, 5, 36, 3, 80
SPAN, REACH = 16, 35


def lines(block: Block) -> tuple[Block, np.ndarray, np.ndarray]:
    """The lines of a block as texts of their own, the row of each and its first byte within the row."""
    start, end = block.spans(block.data != 10)
    bounds = np.concatenate([start, end[-1:]]) if len(start) else np.zeros(1, np.int64)
    inner = Block(0, block.data[bounds[0]: bounds[-1]], bounds - bounds[0])
    row = block.row_of(start)
    return inner, row, start - block.bounds[row]


def permuted(row: np.ndarray, members: np.ndarray, rows: int) -> np.ndarray:
    """MinHash signature (rows x PLACES) of sets whose members are sorted by row; rows without members stay zero."""
    sig = np.zeros((rows, PLACES), U)
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        for j in range(PLACES):
            sig[row[first], j] = np.minimum.reduceat(mix(members, 1000 + j), first)
    return sig


def window_anchors(words, stretch: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the first word and hash of each block of SPAN words; for each window of LEAST words its first word and the number of its anchor block."""
    at, h = words.grams(SPAN)
    begin, picked = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(at) - REACH + 1, stretch):
        part = slice(lo, lo + stretch + REACH - 1)
        low, row = (h[part] & ~U(0xFFFFFF)) | np.arange(len(at[part])).astype(U), words.row[at[part]]
        n, width, least = len(low) - REACH + 1, 1, low
        while 2 * width <= REACH:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        inside = row[:n] == row[REACH - 1:]
        least = np.minimum(least[:n], least[REACH - width: REACH - width + n])[inside]
        begin.append(at[part][:n][inside])
        picked.append(lo + (least & U(0xFFFFFF)).astype(np.int64))
    return at, h, np.concatenate(begin), np.concatenate(picked)


def anchors(words) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of each anchor block."""
    at, h, _, picked = window_anchors(words)
    i = np.unique(picked)
    return at[i], h[i]


def _units(batches):
    """Rows of both kinds: paragraphs (id, bands, sig, first word, words) and anchors (id only)."""
    for b in batches:
        for block in blocks(b["text"]):
            whole = block.words(True)
            inner, row, _ = lines(block)
            words = inner.words(True)
            long = words.n >= PARAGRAPH
            pick = np.cumsum(long) - 1
            r, members = words.sets(SHINGLE) if inner.rows < 4096 else _many(words)
            mine = long[r]
            r, members = pick[r[mine]], members[mine]
            n = int(long.sum())
            sig = permuted(r, members, n)
            bands = similar.band_hashes(sig, ROWS)
            place = words.first[long] - whole.first[row[long]]
            at, hashes = anchors(whole)
            owner = np.concatenate([row[long], whole.row[at]]) + block.first
            m = len(at)
            offsets = np.concatenate([np.arange(n + 1) * bands.shape[1], np.full(m, n * bands.shape[1])])
            yield pa.RecordBatch.from_arrays([
                b["doc_id"].take(pa.array(owner)), b["key"].take(pa.array(owner)), pa.array(np.append(set_ids(r, members, n), hashes.view(np.int64))),
                pa.array(np.append(np.bincount(r, minlength=n), np.zeros(m, np.int64))),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands.ravel())),
                pa.array([*(x.tobytes() for x in (sig & U(255)).astype(np.uint8)), *[b""] * m], pa.binary()),
                pa.array(np.append(place, at - whole.first[whole.row[at]])), pa.array(np.append(words.n[long], np.full(m, SPAN)))],
                names=["doc_id", "key", "id", "n", "bands", "sig", "first", "words"])


def _many(words) -> tuple[np.ndarray, np.ndarray]:
    """As `Words.sets`, for blocks of more lines than a packed row number holds."""
    at, h = words.grams(SHINGLE)
    row, h = words.row[at], h >> U(12)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(row) else np.zeros(0, bool)
    return row[new], h[new]


_GAPS = str.maketrans("\t\n\v\f\r", "     ")


def _marked(lists) -> tuple[np.ndarray, pa.Array]:
    """Row and first word, packed, of each element of a list column, and these elements."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    owner, flat = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()
    first = flat.field("first") if pa.types.is_struct(flat.type) else flat
    return (owner.astype(np.int64) << 40) | first.to_numpy(), flat


def _parts(batches):
    """Of each document the hash and first word of each window of LEAST words whose anchor is among `anchors`, first words of blocks,
    and `id` and text of the lines that begin at the first words of `lines`."""
    for b in batches:
        anchor_at, _ = _marked(b["anchors"])
        line_at, line = _marked(b["lines"])
        order = np.argsort(line_at)
        for block in blocks(b["text"]):
            w = block.words(True)
            at, _, begin, picked = window_anchors(w)
            row, anchor = w.row[begin], at[picked]
            use = np.isin(((row + block.first) << 40) | (anchor - w.first[row]), anchor_at)
            begin, row = begin[use], row[use]
            h = np.zeros(len(begin), U)
            for j in range(LEAST):
                h = h * U(0xD6E8FEB86659FD93) + w.hash[begin + j]
            mine, n = pa.array(row + block.first), len(begin)
            yield pa.RecordBatch.from_arrays([*(b[c].take(mine) for c in ("doc_id", "key")), pa.array(mix(h, 5).view(np.int64)), pa.array(begin - w.first[row]),
                                              pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=PART)
            start, end = block.spans(block.data != 10)
            row, word = block.row_of(start), np.searchsorted(w.start, start)
            place = ((row + block.first) << 40) | (word - w.first[row])
            own = np.flatnonzero(np.isin(place, line_at) & (np.searchsorted(w.start, end) > word))
            ids = line.take(pa.array(order[np.searchsorted(line_at, place[own], sorter=order)])).field("id")
            text = [block.data[x:y].tobytes().decode() for x, y in zip(start[own], end[own], strict=True)]
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, ids, pa.array(text, pa.string())], names=PART)


PART = ["doc_id", "key", "window", "first", "id", "text"]


def _runs(batches):
    """Stretches covered by neighbouring windows, whose sorted first words are `firsts`."""
    for b in batches:
        at = b["firsts"].flatten().to_numpy()
        row = np.repeat(np.arange(b.num_rows), b["firsts"].value_lengths().to_numpy(zero_copy_only=False))
        if not len(row):
            continue
        begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]))
        mine = pa.array(row[begin])
        yield pa.RecordBatch.from_arrays([*(b[c].take(mine) for c in ("doc_id", "key")), pa.array(at[begin]), pa.array(np.diff(np.append(begin, len(row))) + LEAST - 1),
                                          b["kept_doc_id"].take(mine)], names=["doc_id", "key", "first", "words", "kept_doc_id"])


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, key, first, words, kept_doc_id, kind): each repeated stretch of a document, from word `first` on, kept in another one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key().alias("key")).where("doc_id is not null")
    spark, whole_units, whole_classes = docs.sparkSession, folder(docs.sparkSession), folder(docs.sparkSession)
    units = written(docs.select("doc_id", "key", "text").mapInArrow(
        _units, "doc_id long, key long, id long, n long, bands array<long>, sig binary, first long, words long"), whole_units)
    classes = written(units.where("n > 0").groupBy("id").agg(*[F.first(c).alias(c) for c in ("n", "key", "first", "bands", "sig")]), whole_classes)
    # from here on bands and signatures stand in the classes only
    units = written(units.drop("bands", "sig"))
    dropped(spark, whole_units)
    paragraphs = units.where("n > 0")
    members = similar.shared_buckets(classes)

    # documents cross one exchange, for their candidate lines and for their windows
    lines_of = classes.select("id", "key", "first").join(members.select("id").distinct(), "id", "left_semi")
    marks = units.where("n = 0").select("id", "key", "first")
    anchor = Window.partitionBy("id")
    shared = marks.withColumns({"least": F.min("key").over(anchor), "last": F.max("key").over(anchor)}).where("least < last")
    places = (shared.select("key", F.col("first").alias("anchor"), F.lit(None).cast("struct<first: long, id: long>").alias("line"))
              .unionAll(lines_of.select("key", F.lit(None).cast("long"), F.struct("first", "id"))))
    held = places.groupBy("key").agg(F.collect_set("anchor").alias("anchors"), F.collect_list("line").alias("lines"))
    parts = written(docs.join(held, "key").select("doc_id", "key", "text", "anchors", "lines").mapInArrow(
        _parts, "doc_id long, key long, window long, first long, id long, text string"))

    def texts(ids: DataFrame) -> DataFrame:
        return ids.join(parts.where("id is not null").select("id", "text").dropDuplicates(["id"]), "id")

    found = similar.linked(classes, members, PLACES, PERCENT, SHINGLE, texts)
    dropped(spark, whole_classes)
    named = (paragraphs.select("doc_id", "key", "id", "first", "words").join(found, "id", "left")
             .withColumn("component", F.coalesce("component", "id")).drop("id"))
    heads = (named.groupBy("component").agg(F.min("doc_id").alias("kept_doc_id"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    named = named.join(heads.drop("size"), "component")
    places = named.where("doc_id = kept_doc_id").groupBy("component").agg(F.min("first").alias("kept_first"))
    whole = (named.join(places, "component").where("doc_id <> kept_doc_id or first <> kept_first")
             .select("doc_id", "key", "first", "words", "kept_doc_id", F.lit("paragraph").alias("kind")))

    windows = parts.where("window is not null").select("doc_id", "key", "window", "first")
    kept = windows.withColumn("kept_doc_id", F.min("doc_id").over(Window.partitionBy("window"))).where("doc_id <> kept_doc_id")
    inside = (kept.groupBy("doc_id", "key", "kept_doc_id").agg(F.sort_array(F.collect_set("first")).alias("firsts"))
              .mapInArrow(_runs, "doc_id long, key long, first long, words long, kept_doc_id long").withColumn("kind", F.lit("passage")))
    return whole.unionByName(inside).distinct()


@query("op3_paragraph_minhash")
def op3(spark, d):
    return repeated(load(spark, d, "documents")).drop("key")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the word ranges (first, words); lines of which nothing is left go."""
    out, seen = [], 0
    gone = sorted(spans)
    for line in text.split("\n"):
        words = [w for w in line.translate(_GAPS).split(" ") if w]
        cut = [any(f <= i < f + n for f, n in gone) for i in range(seen, seen + len(words))] if gone and any(
            f < seen + len(words) and seen < f + n for f, n in gone) else []
        seen += len(words)
        if not any(cut):
            out.append(line)
        elif not all(cut):
            out.append(" ".join(w for w, c in zip(words, cut, strict=True) if not c))
    return "\n".join(out)


def stage(spark, docs: DataFrame, d: str) -> DataFrame:
    """`docs` without repeated paragraphs and passages; every document stays, if with less text."""
    cuts = (repeated(docs).groupBy("key").agg(F.collect_set(F.struct("first", "words")).alias("_cuts")).withColumnRenamed("key", "_key"))
    rows = docs.withColumn("_key", key()).join(cuts, "_key", "left")

    def run(batches):
        for b in batches:
            texts = b["text"].to_pylist()
            for i, c in enumerate(b["_cuts"].to_pylist()):
                if c and texts[i] is not None:
                    texts[i] = without(texts[i], [(x["first"], x["words"]) for x in c])
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).drop_columns(["_cuts"])

    kept = rows.select(*docs.columns, "_cuts")
    out = kept.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
