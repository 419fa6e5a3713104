"""What repeated paragraphs exchange, and what they leave in the shared folder."""

import re
from pathlib import Path

import pyarrow as pa

from marketlab.llm import paragraphs, similar
from marketlab.llm.words import blocks


def test_parts_are_the_lines_and_windows_asked_for():
    line = " ".join(f"w{i}" for i in range(60))
    text = f"\n \n{line}\nfew words\n\nä {line}\tend"
    block = next(blocks(pa.array([text])))
    at, _ = paragraphs.anchors(block.words(True))
    b = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([70, 80]), pa.array([None, text]), pa.array([[], at.tolist()], pa.list_(pa.int64())),
                                    pa.array([[], [{"first": 62, "id": 5}, {"first": 0, "id": 4}]], pa.list_(pa.struct([("first", pa.int64()), ("id", pa.int64())])))],
                                   names=["doc_id", "key", "text", "anchors", "lines"])
    rows = pa.Table.from_batches(paragraphs._parts([b])).to_pylist()
    assert {(r["id"], r["text"]) for r in rows if r["id"] is not None} == {(4, line), (5, f"ä {line}\tend")}
    windows = [r for r in rows if r["window"] is not None]
    assert {(r["doc_id"], r["key"]) for r in windows} == {(8, 80)}
    assert [r["first"] for r in windows] == list(range(124 - 50 + 1))
    first = {r["first"]: r["window"] for r in windows}
    assert first[0] == first[63] and first[10] == first[73] and first[11] != first[74]


def test_buckets_of_one_id_end(spark):
    rows = [(1, 9, [10, 20]), (2, 9, [10, 30]), (3, 9, [40, 30]), (4, 9, [50, 60]), (5, 9, []), (6, 9, [10, 70])]
    got = similar.shared_buckets(spark.createDataFrame(rows, "id long, n long, bands array<long>"))
    assert {tuple(r) for r in got.collect()} == {(1, 9, 10, 1, 6), (2, 9, 10, 1, 6), (6, 9, 10, 1, 6), (2, 9, 30, 2, 3), (3, 9, 30, 2, 3)}


def test_documents_and_bands_cross_one_exchange(spark, monkeypatch):
    """Texts are exchanged once, for lines and windows together; tables that nothing reads any more go."""
    plans, places = [], []
    write = paragraphs.written

    def watched(df, path=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        places.append(path)
        return write(df, path)

    monkeypatch.setattr(paragraphs, "written", watched)
    monkeypatch.setattr(similar, "written", watched)
    line = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"a {line} b"), (2, f"c {line} d"), (3, line), (4, line), (5, None)], "doc_id long, text string")
    got = paragraphs.repeated(docs)
    assert sum("Exchange" in p and re.search(r"Scan ExistingRDD", p) is not None for p in plans) == 1
    assert not any(p.count("explode(bands") > 1 for p in plans)
    assert {(r["doc_id"], r["kept_doc_id"], r["kind"]) for r in got.collect()} == {(i, 1, k) for i in (2, 3, 4) for k in ("paragraph", "passage")}
    gone = [p.removeprefix("file:") for p in places if p]
    assert len(gone) == 2 and not any(Path(p).exists() for p in gone)
