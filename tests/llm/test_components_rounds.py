"""Rounds of components stay small for the driver: three exchanges each, no query that only asks for the end, no joins for sizes and splits."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketlab.llm import similar


def smallest(links):
    head = {x: x for link in links for x in link}
    for _ in head:
        for a, b in links:
            head[a] = head[b] = min(head[a], head[b])
    return {x: y for x, y in head.items()}


def graphs():
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(40)]
    hub = [(500, i) for i in range(1, 300)] + [(0, i) for i in range(1, 300)]
    some = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    return {"chain": rng.sample(chain, 40), "hub": hub, "some": [(a, b) for a, b in some if a != b], "flat": [(9, 1), (8, 1), (7, 2), (7, 2)],
            "negative": [(-(2**63), 5), (5, 2**63 - 1)], "none": []}


@pytest.mark.parametrize("name", list(graphs()))
def test_components_in_few_small_plans(spark, monkeypatch, name):
    plans, write = [], similar.written

    def watched(df, path=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, path)

    links = graphs()[name]
    sc = spark.sparkContext
    monkeypatch.setattr(similar, "written", watched)
    sc.setJobGroup(f"components-{name}", "")
    found = similar.components(spark.createDataFrame(links, "a long, b long"))
    jobs = len(sc.statusTracker().getJobIdsForGroup(f"components-{name}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    rows = found.collect()
    assert Counter(r["id"] for r in rows) == Counter({x for link in links for x in link})
    assert {r["id"]: r["component"] for r in rows} == smallest(links)
    assert all(p.count("Exchange ") <= 3 and "Join" not in p for p in plans)
    # the first table takes two jobs and its emptiness up to two, each later round at most four
    assert jobs <= 4 * len(plans)


def test_stars_and_splits_without_joins(spark):
    rows = [(1, 10, [7, 8]), (2, 20, [7]), (3, 11, [7, 9]), (4, 40, [8, 9]), (5, 50, [6]), (6, 45, [9])]
    members = similar.shared_buckets(spark.createDataFrame(rows, "id long, n long, bands array<long>"))
    assert {tuple(r) for r in similar._stars(members, 80).collect()} == {(1, 3), (4, 6)}
    assert {tuple(r) for r in similar._stars(members, 50).collect()} == {(1, 2), (1, 3), (2, 3), (4, 6)}
    split = similar._split(members.withColumn("component", F.when(F.col("id") < 4, 1).otherwise(F.col("id"))))
    assert {(r["id"], r["bucket"], r["head"]) for r in split.collect()} == {(1, 8, 1), (4, 8, 1), (3, 9, 3), (4, 9, 3), (6, 9, 3)}
    again = similar._split(split.withColumn("component", F.when(F.col("id") > 3, 4).otherwise(F.col("component"))).where("id > 3 or bucket = 8"))
    assert {(r["id"], r["bucket"], r["head"]) for r in again.collect()} == {(1, 8, 1), (4, 8, 1)}
    for df in (similar._stars(members, 80), split):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
