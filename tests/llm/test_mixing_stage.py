"""The mixing stage takes each row as often as the plan says, also where ids and texts repeat."""

from collections import Counter

from pyspark.sql import functions as F

from marketlab.llm import mixing
from marketlab.llm.common import word_count


def test_rows_of_one_id_and_text_in_several_sources(spark):
    same = " ".join(f"w{i}" for i in range(30))
    rows = [(1, same, "en", "a", 1), (1, same, "en", "b", 1), (1, same, "de", "b", 1), (1, same, None, "b", 1), (1, same, "b", None, 1), (1, same, "en", "a", 1)]
    rows += [(10 + i, f"text {i} " * (3 + i % 5), "en", "abc"[i % 3], i) for i in range(60)] + [(2, None, "en", None, None), (None, "no id here", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plan = mixing.sampled(docs.select("doc_id", "text", "lang", "n_chars", "source", word_count("text").alias("size")))
    want = Counter()
    for r in plan.collect():
        want[r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]] += r["copies"]
    got = mixing.stage(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(tuple(r) for r in got.collect()) == +want
    assert mixing.stage(spark, docs.where(F.lit(False)), "").count() == 0


def test_plans_stay_small(spark, monkeypatch):
    """The driver keeps every state of a plan: rows, sizes and targets are tables, not repeated in each level of each scan."""
    plans, write = [], mixing.written

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    def watched(df, path=None):
        plans.append(exchanges(df))
        return write(df, path)

    monkeypatch.setattr(mixing, "written", watched)
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * i) for i in range(20)], "doc_id long, source string, text string")
    plans.append(exchanges(mixing.stage(spark, docs, "")))
    assert max(plans) <= 20
