"""Memory of a task in toxicity does not follow the size of Spark's batches."""

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from marketlab.llm import toxicity
from marketlab.llm.words import blocks


@pytest.fixture(scope="module")
def batch():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 1500)) for _ in range(1500)] + [None, "", "only these words"]
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([False] * n), pa.array(range(n)), pa.array([i % 3 % 2 for i in range(n)]), pa.array(texts)],
                                      names=["doc_id", "held_out", "key", "clean", "text"])


def peak(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_term_counts_of_a_large_batch(batch):
    assert batch["text"].nbytes > 8 << 20
    got, mb = peak(lambda: pa.Table.from_batches(toxicity._frequencies([batch])).group_by(["k", "term"]).aggregate([("a", "sum"), ("c", "sum")]))
    assert mb < 120
    want = {}
    for block in blocks(batch["text"].slice(0, 20)):
        t = toxicity.Tokens(block)
        for k, h in enumerate(t.terms()):
            for row, term in set(zip(t.row.tolist(), h[h > 0].tolist() if k == 0 else h.tolist(), strict=True)):
                if term:
                    want.setdefault((k, term), [0, 0])[batch["clean"][row].as_py()] += 1
    few = pa.Table.from_batches(toxicity._frequencies([batch.slice(0, 20)])).to_pylist()
    assert {(r["k"], r["term"]): [r["a"], r["c"]] for r in few} == want
    assert got.num_rows >= len(want)


def test_scores_of_a_large_batch(batch):
    model, rng = toxicity.Model(), np.random.default_rng(3)
    model.w, model.move, model.coef, model.ready = rng.normal(size=model.w.shape).astype(np.float32), np.array([[0.3, -0.2], [0.1, 0.4]]), np.array([-1, 0.5, 0.2]), True
    got, mb = peak(lambda: pa.Table.from_batches(toxicity._judged(model)([batch])))
    assert mb < 160
    assert got["doc_id"].to_pylist() == batch["doc_id"].to_pylist()
    alone = [pa.Table.from_batches(toxicity._judged(model)([batch.slice(i, 1)])).to_pylist()[0] for i in (0, 700, 1499, 1500, 1501, 1502)]
    assert [got.slice(r["doc_id"], 1).to_pylist()[0] for r in alone] == alone


def test_fit_of_large_samples(batch, monkeypatch):
    labels = batch["clean"].to_numpy()
    rows = pa.RecordBatch.from_arrays([batch["text"], batch["clean"], batch["doc_id"]], names=["text", "clean", "r"])
    known = [np.unique(h[h > 0])[::37] for h in toxicity.Tokens(next(blocks(batch["text"].slice(0, 20)))).terms()]
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    out, mb = peak(lambda: list(toxicity._fitted(known, 0.5)([rows])))
    tokens = 1500 * 1500 + 3
    assert mb < tokens * (toxicity.TABLES * 4 + 4) / 1e6 + 110  # features and rows, and stretches beside them
    one = pickle.loads(out[0]["model"][0].as_py())
    monkeypatch.setattr(toxicity, "STRETCH", 10**9)
    order = np.lexsort((np.arange(len(labels)), labels))
    two = toxicity.Model().fit(batch["text"].take(pa.array(order)), 1 - labels[order], known, 0.5)
    assert one.ready and np.array_equal(one.w, two.w) and np.array_equal(one.coef, two.coef)


def test_fit_of_texts_without_tokens_and_of_one_long_text(monkeypatch):
    monkeypatch.setattr(toxicity, "STRETCH", 50)
    none = [np.zeros(0, np.uint64)] * toxicity.TERMS
    assert toxicity.Model().fit(pa.array(["", None, " . "]), np.array([0, 1, 1]), none).ready
    assert toxicity.Model().fit(pa.array(["a b", "", "word " * 400]), np.array([0, 1, 1]), none).ready
