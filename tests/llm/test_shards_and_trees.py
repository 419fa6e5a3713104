"""Decontamination, resampling and manifest against brute force, and on odd tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlab.llm import decontamination, manifest, resampling

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, items string, weight string, leaf string"
SAME = " ".join(f"w{i}" for i in range(80))
ODD = [(1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n\t -", None, "b", 4), (4, "One", "en", "b", 3), (4, "One", "en", "b", 3),
       (5, SAME, "en", "a", 1), (6, SAME.upper(), "en", "a", 1), (7, SAME + " tail", "de", "c", 1), (8, "word " * 30_000, "en", "a", 1),
       (9, "é ñ 日本 " * 4 + "a--b\r\nc", "fr", "", 1), (None, "null id text of some more words", "en", "a", 1), (10, "x" * 70_000 + " y", "en", "a", 2),
       (11, "before it " + SAME + ", after it", None, None, -3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.read.parquet(f"{D}/benchmark.parquet")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def places(text):
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))]


def words(text):
    return [w for w, _, _ in places(text)]


def test_crc_of_spans_is_zlibs():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 40_000, dtype=np.uint8)
    size = np.concatenate([rng.integers(0, 12, 500), [255, 256, 257, 511, 512, 513, 768, 769, 20_000, 1, 0]])
    start = rng.integers(0, 20_000, len(size))
    got = resampling.crc32(data, start, start + size)
    assert got.tolist() == [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(start, size, strict=True)]
    assert resampling.crc32(data, start[:0], start[:0]).tolist() == []


@pytest.mark.parametrize("longest,table", [(1, "docs"), (2, "docs"), (1, "odd"), (3, "odd")])
def test_resampling_against_brute_force(request, bench, longest, table):
    table = request.getfixturevalue(table)
    rows = [(r["doc_id"], words(r["text"])) for r in table.collect()]

    def grams(w):
        return [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10_000 for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, w in rows:
        np.add.at(s, grams(w), 1)
    for r in bench.collect():
        np.add.at(t, grams(words(r["text"])), 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    want = []
    for i, w in rows:
        g = grams(w)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0], r[3], r[2]))
    for place, r in enumerate(able, 1):
        r.append(place if place <= 10 * len(able) // 100 else None)
    got = resampling.resampled(table, bench, longest).collect()
    assert sorted(map(str, (list(r) for r in got))) == sorted(str((r + [None])[:6]) for r in want)


def test_resampling_of_empty_tables(spark, odd, bench):
    none = odd.limit(0)
    assert resampling.resampled(none, bench).count() == 0
    assert resampling.resampled(odd, bench.limit(0)).count() == len(ODD)
    ranks = sorted(r["rank"] for r in resampling.resampled(odd, bench, least=0, percent=100).collect())
    assert ranks == list(range(1, len(ODD) + 1))


@pytest.mark.parametrize("seed,letters", [(0, 2), (1, 3), (2, 40), (3, 1)])
def test_index_finds_what_a_scan_finds(seed, letters):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(1, letters + 1, n).tolist() for n in (*rng.integers(0, 60, 12), 0, 1)]
    texts += texts[:4]
    symbols = np.concatenate([[*t, 0] for t in texts]).astype(np.int64)
    stops = np.flatnonzero(symbols == 0)
    order = decontamination.suffix_array(symbols, stops)

    def suffix(i):
        stop = stops[np.searchsorted(stops, i)]
        return [(1, int(c)) for c in symbols[i:stop]] + [(0, int(stop))]
    assert order.tolist() == sorted(range(len(symbols)), key=suffix)
    index = decontamination.FMIndex(symbols, stops, letters)
    sizes = rng.integers(1, 7, 200)
    phrases = np.zeros((200, 8), np.int64)
    for i, n in enumerate(sizes):
        phrases[i, 8 - n:] = rng.integers(0 if i % 9 == 0 else 1, letters + 1, n)
    low, high = index.search(phrases, sizes)
    for i, n in enumerate(sizes):
        p = phrases[i, 8 - n:].tolist()
        want = [] if 0 in p else [j for j in range(len(symbols) - n + 1) if symbols[j:j + n].tolist() == p]
        assert sorted(index.locate(np.arange(low[i], high[i])).tolist()) == want


def brute(rows, items, window=10):
    out = []
    for i, text in rows:
        at = places(text)
        w = [x for x, _, _ in at]
        hit, found = set(), set()
        for name, item in items:
            v = words(item)
            n = min(window, len(v))
            pieces = {tuple(v[j:j + n]) for j in range(len(v) - n + 1)} if n else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j:j + n]) in pieces:
                    hit.update(range(j, j + n))
                    found.add(str(name) if name is not None else "")
        cut = [(at[a][1], at[b][2]) for a in sorted(hit) if a - 1 not in hit for b in [next(b for b in range(a, len(w)) if b + 1 not in hit)]]
        out.append((i, len(w), len(hit), sorted(found), cut))
    return out


@pytest.mark.parametrize("part,shard", [(4_000_000, 1 << 22), (900, 3000)])
def test_decontamination_against_brute_force(spark, docs, odd, bench, part, shard):
    more = spark.createDataFrame([(900, "One"), (901, SAME[:60]), (901, "日本 é ñ 日本"), (902, None), (903, "- -"), (None, "some more")], "item_id long, text string")
    for table, items in ((docs, bench), (odd, more), (odd, bench.unionByName(more))):
        want = brute([(r["doc_id"], r["text"]) for r in table.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
        got = decontamination.contaminated(table, items, part=part, shard=shard)
        rows = [(r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), r["items"], [(s["from"], s["to"]) for s in r["spans"]])
                for r in got.collect()]
        assert sorted(map(str, rows)) == sorted(map(str, want))
    for r, c in zip(got.collect(), decontamination.cleaned(got).collect(), strict=True):
        keep, at = "", 0
        for s in r["spans"]:
            keep, at = keep + r["text"][at:s["from"]], s["to"]
        assert c["text"] == (None if r["text"] is None else keep + r["text"][at:])


def test_decontamination_of_empty_tables(odd, bench):
    assert decontamination.contaminated(odd.limit(0), bench).count() == 0
    assert {len(r["spans"]) for r in decontamination.contaminated(odd, bench.limit(0)).collect()} == {0}


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(hashes):
    """Top of a run of digests and each one's proof steps."""
    steps, group = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k, g in enumerate(group):
            run = hashes[g // 16 * 16:g // 16 * 16 + 16]
            steps[k].append((g % 16, "".join(run[:g % 16] + run[g % 16 + 1:])))
        hashes = [sha(*hashes[i:i + 16]) for i in range(0, len(hashes), 16)]
        group = [g // 16 for g in group]
    return hashes[0], steps


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(rows):
    by = {}
    for r in rows:
        leaf = sha(*(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))
        bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None
        now = sha(*(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")), field(lower(r["text"]) if bad else r["text"]))
        by.setdefault(r["source"], []).append(((r["doc_id"] is not None, r["doc_id"], leaf), leaf, now))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops, below = [], []
    for s in names:
        leaves = sorted(by[s])
        top, steps = climb([x[1] for x in leaves])
        tops.append(top)
        below.append((leaves, steps))
    root, above = climb(tops)
    out = []
    for top, more, (leaves, steps) in zip(tops, above, below, strict=True):
        for (key, leaf, now), own in zip(leaves, steps, strict=True):
            end = now
            for slot, others in own + more:
                end = sha(others[:64 * slot], end, others[64 * slot:])
            out.append((key[1], leaf, top, root, sha(*(o for _, o in own + more)), end, end == root))
    return out


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest_against_brute_force(spark, docs, odd, height):
    many = spark.range(700).select(F.when(F.col("id") % 9 > 0, F.shiftright("id", 1)).alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"),
                                   F.when(F.col("id") < 600, "hot").when(F.col("id") < 690, F.concat(F.lit("s"), "id")).alias("source"), F.col("id").alias("n_chars"))
    for table in (docs, odd, many):
        got = manifest.audited(table, manifest.tampered(table), height=height).collect()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, tree(table.collect())))


def test_manifest_gives_proofs_and_takes_odd_tables(docs, odd):
    kept = manifest.audited(docs, manifest.leaf_of(docs), with_proofs=True).collect()
    for r in kept:
        end = r["leaf"]
        for s in r["proof"]:
            end = sha(s["others"][:64 * s["slot"]], end, s["others"][64 * s["slot"]:])
        assert r["verified"] and end == r["root"]
    assert manifest.audited(odd.limit(0), manifest.leaf_of(odd)).count() == 0
    assert manifest.audited(odd.limit(1), manifest.leaf_of(odd)).first()["verified"]
