"""Documents, mentions, external signals and the tradable universe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlab.functions.mathx import clip
from marketlab.functions.text import GENERIC_TERMS, NARRATIVE_STOP, base_symbol, clean_markup, words
from marketlab.operators.folds import fold_scalar
from marketlab.operators.scans import seconds


def feed_items(pages: DataFrame, body: str, item=r"(?is)<(?:item|entry)[\s>](.*?)</(?:item|entry)>",
               title=r"(?is)<title[^>]*>(.*?)</title>", limit: int | None = None, shortest: int = 8) -> DataFrame:
    """Titles of the items of each feed text, the first `limit` where given."""
    items = F.regexp_extract_all(body, F.lit(item), F.lit(1))
    items = items if limit is None else F.slice(items, 1, limit)
    keep = [c for c in pages.columns if c != body]
    x = pages.select(*keep, F.posexplode(items).alias("item_no", "_i"))
    x = x.where(F.col("_i").rlike(title)).withColumn("title", clean_markup(F.regexp_extract("_i", title, 1)))
    return x.where(F.length("title") >= shortest).drop("_i")


def tag_assets(df: DataFrame, text: str, keywords: dict[str, list[str]]) -> DataFrame:
    """Assets any of whose keywords occurs in the text, tested in place against a literal list."""
    low = F.lower(text)
    hits = []
    for asset, kws in keywords.items():
        cond = F.lit(False)
        for k in kws:
            cond = cond | F.contains(low, F.lit(k.lower()))
        hits.append(F.when(cond, F.lit(asset)))
    return df.withColumn("assets", F.array_compact(F.array(*hits)))


def score_documents(df: DataFrame, text: str, scorer: Callable[[Column], Column], name: str = "score") -> DataFrame:
    """Score texts with any column function: the lexicon expression or a user's pandas UDF, kept in [-1, 1]."""
    return df.withColumn(name, clip(scorer(F.col(text))))


def doc_sentiment(docs: DataFrame, fear_greed: float | None = None) -> DataFrame:
    """Per asset score and document count, shrunk toward the market mood below five documents.

    `docs` has score, macro (flag) and assets. The market mood blends headlines, fear & greed and macro.
    """
    mood = docs.agg(F.coalesce(F.avg(F.when(~F.col("macro"), F.col("score"))), F.lit(0.0)).alias("_base"),
                    F.coalesce(F.avg(F.when(F.col("macro"), F.col("score"))), F.lit(0.0)).alias("_macro"))
    fg = 0.0 if fear_greed is None else (fear_greed - 50) / 50
    mood = mood.select((0.5 * F.col("_base") + 0.3 * fg + 0.2 * F.col("_macro")).alias("market_sentiment"))
    g = (docs.where(~F.col("macro")).select("score", F.explode("assets").alias("asset")).groupBy("asset")
         .agg(F.avg("score").alias("raw_score"), F.count(F.lit(1)).alias("n_docs")))
    w = F.least(F.lit(1.0), F.col("n_docs") / 5)
    return g.crossJoin(F.broadcast(mood)).withColumn("score", w * F.col("raw_score") + (1 - w) * F.col("market_sentiment"))


def narratives(docs: DataFrame, text: str, k: int = 10, stop=NARRATIVE_STOP) -> DataFrame:
    """Most frequent words longer than three characters; ties by word."""
    kept = F.filter(words(text), lambda w: (F.length(w) > 3) & ~w.isin(*stop))
    return (docs.select(F.explode(kept).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "topic").limit(k))


def mention_heat(mentions: DataFrame, last_cycle: Column, sym="sym", cycle="cycle", weight="weight", decay=0.85, low=0.2) -> DataFrame:
    """heat = weighted mentions, times 0.85 at the end of every cycle, forgotten below 0.2.

    Mentions are summed per symbol and cycle before the fold; a second source adds a standing bonus.
    """
    per = mentions.groupBy(sym, cycle).agg(F.sum(weight).cast("double").alias("w"))
    zero = F.struct(F.lit(0).cast("bigint").alias("c"), F.lit(0.0).alias("h"))

    def aged(s, to):
        h = s["h"] * F.pow(F.lit(decay), to - s["c"])
        return F.when(h >= low, h).otherwise(0.0)

    heat = fold_scalar(per, [sym], [cycle], ["w"], zero,
                       lambda s, b: F.struct(b[cycle].cast("bigint").alias("c"), (aged(s, b[cycle]) + b["w"]).alias("h")),
                       lambda s: F.struct(s["c"].alias("c"), s["h"].alias("h")), "_s")
    h = F.col("_s.h") * F.pow(F.lit(decay), last_cycle + 1 - F.col("_s.c"))
    src = mentions.groupBy(sym).agg(F.count_distinct("source_kind").alias("n_sources"))
    x = heat.withColumn("heat", h).where(F.col("heat") >= low).join(src, sym)
    return x.select(sym, "n_sources", (F.col("heat") + F.when(F.col("n_sources") >= 2, 0.5 * (F.col("n_sources") - 1)).otherwise(0.0)).alias("heat"))


def universe_rank(cands: DataFrame, core: list[str], slots: int = 8, special_slots: int = 4, least_heat: float = 1.5) -> DataFrame:
    """Chosen symbols and rejects with a reason.

    `cands`: sym, heat, mult, special (separate slot budget), listed, liquid. Unlisted and illiquid
    candidates are rejected before slots are dealt out by effective heat.
    """
    x = cands.where(~F.col("sym").isin(*core) & (F.col("heat") >= least_heat))
    x = x.withColumns({"eff_heat": F.col("heat") * F.col("mult"), "reason": F.when(~F.col("listed"), "not listed")
                       .when(~F.col("liquid"), "volume below floor")})
    w = W.partitionBy("special").orderBy(F.desc("eff_heat"), "sym")
    ok = x.where(F.col("reason").isNull()).withColumn("place", F.row_number().over(w))
    ok = ok.withColumn("reason", F.when(F.col("place") > F.when(F.col("special"), special_slots).otherwise(slots), "no slot").otherwise("chosen"))
    return ok.select("sym", "eff_heat", "special", "reason").unionByName(x.where(F.col("reason").isNotNull()).select("sym", "eff_heat", "special", "reason"))


def universe_diff(current: DataFrame, target: DataFrame, core: DataFrame, held: DataFrame, key="sym") -> DataFrame:
    """Added and removed symbols; core stays, and so does what is held."""
    full = target.select(key).union(core.select(key)).union(held.select(key).intersect(current.select(key))).distinct()
    return (full.subtract(current.select(key)).withColumn("change", F.lit("added"))
            .unionByName(current.select(key).subtract(full).withColumn("change", F.lit("removed"))))


def source_health(fetches: DataFrame) -> DataFrame:
    """Successes, failures since the last success, and promotion or demotion of trial sources.

    `fetches`: source, seq (order), ok, items, candidate.
    """
    g = fetches.groupBy("source").agg(F.sum(F.col("ok").cast("int")).alias("successes"), F.max(F.when(F.col("ok"), F.col("seq"))).alias("_ok"),
                                      F.max_by("items", F.when(F.col("ok"), F.col("seq"))).alias("last_items"), F.max("candidate").alias("candidate"))
    late = (fetches.where(~F.col("ok")).join(g.select("source", "_ok"), "source").where(F.col("_ok").isNull() | (F.col("seq") > F.col("_ok")))
            .groupBy("source").agg(F.count(F.lit(1)).alias("failures")))
    x = g.join(late, "source", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    status = (F.when(F.col("candidate") & (F.col("failures") >= 6), "demoted")
              .when(F.col("candidate") & (F.col("successes") >= 2) & (F.col("last_items") >= 3), "promoted")
              .when(F.col("failures") > 0, "backoff").when(F.col("successes") > 0, "ok").otherwise("untested"))
    backoff = F.when(F.col("failures") > 0, F.least(F.lit(1800.0), F.pow(F.lit(2.0), F.col("failures")) * 60))
    return x.withColumns({"status": status, "backoff_sec": backoff}).drop("_ok")


def normalize_signals(raw: DataFrame, now: Column, longest: int | None = None) -> DataFrame:
    """Alias coalesce, finite check and clamp; `ok` tells accepted rows from rejects. Texts keep `longest` characters where given."""
    text = F.coalesce("text", F.lit(""))
    asset = base_symbol(F.coalesce(F.col("asset"), F.col("symbol"), F.col("product"), F.lit("")))
    v = F.coalesce("value", "lean", "score").try_cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return raw.select(
        "*", F.substring(F.coalesce("source", F.lit("unknown")), 1, 64).alias("n_source"), F.coalesce("ts", now).alias("n_ts"),
        asset.alias("n_asset"), clip(v).alias("n_value"), F.substring(F.coalesce("kind", F.lit("signal")), 1, 32).alias("n_kind"),
        (text if longest is None else F.substring(text, 1, longest)).alias("n_text"), ((asset != "") & v.isNotNull()).alias("ok"))


def fresh(age: Column, max_age: float) -> Column:
    """Neither too old nor from the future."""
    return (age >= 0) & (age <= max_age)


def freshness_mean(rows: DataFrame, keys, value: str, age: Column, max_age: float) -> DataFrame:
    """Mean with weights falling linearly to zero at the age limit."""
    w = 1 - age / max_age
    x = rows.where(fresh(age, max_age)).groupBy(*keys).agg(F.sum(w * F.col(value)).alias("_n"), F.sum(w).alias("_d"))
    return x.select(*keys, F.when(F.col("_d") > 0, clip(F.col("_n") / F.col("_d"))).alias("signal"))


def latest_per_key(rows: DataFrame, key: str, order, n: int) -> DataFrame:
    """K2: newest n rows per key; Spark trims each task to n per key before the shuffle."""
    w = W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def signal_status(rows: DataFrame, age: Column, max_age: float) -> DataFrame:
    """Rows, newest time and fresh rows overall, per source and per asset."""
    x = rows.select("source", "asset", "ts", fresh(age, max_age).cast("int").alias("_f"))
    g = x.groupingSets([[], ["source"], ["asset"]], "source", "asset").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"), F.sum("_f").alias("fresh_rows"))
    kind = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "source").otherwise("asset")
    return g.select(kind.alias("slice"), F.coalesce("source", "asset", F.lit("all")).alias("key"), "n", "last_ts", "fresh_rows")


def merge_documents(new: DataFrame, old: DataFrame, key: Column, order, cap: int | None = None) -> DataFrame:
    """New documents before old, the first of each key wins; the first `cap` where given. Keys meet as hashes of 256 bits."""
    both = new.withColumn("_old", F.lit(0)).unionByName(old.withColumn("_old", F.lit(1))).withColumn("_key", F.sha2(key.cast("string"), 256))
    arrival = ["_old", *order]
    row = F.struct(*[c for c in both.columns if c != "_key"])
    one = both.groupBy("_key").agg(F.min_by(row, F.struct(*arrival)).alias("_d")).select("_d.*")
    return (one if cap is None else one.orderBy(*arrival).limit(cap)).drop("_old")


def research_queue(counts: DataFrame, cap: int | None = None, reserved: int = 2, least: int = 3) -> DataFrame:
    """K5: assets with enough mentions, `reserved` of the special class first, the rest by count; the first `cap` where given."""
    x = counts.where(F.col("mentions") >= least)
    first = x.where("special").orderBy(F.desc("mentions"), "asset").limit(reserved).withColumn("priority", F.lit(True))
    rest = (x.join(first.select("asset"), "asset", "left_anti").withColumn("priority", F.lit(False)))
    both = first.unionByName(rest.select(*first.columns))
    return both if cap is None else both.orderBy(F.desc("priority"), F.desc("mentions"), "asset").limit(cap)


def evidence_match(queries: DataFrame, docs: DataFrame, q_id: str, d_id: str, generic=GENERIC_TERMS, parts: int = 16) -> DataFrame:
    """Documents sharing terms with a query; a single generic term is not enough.

    Document terms that no query has are dropped before the shuffle, by the queries' vocabulary where that is small enough to be sent and by
    a semi join else. Terms are dealt out by term and a part of the document's hash, the queries' terms once to each part, so a
    frequent term is many tasks; pairs are counted per (query, document) with map-side combine.
    """
    q = queries.select(q_id, F.explode("terms").alias("_t"))
    dt = docs.select(d_id, F.explode("terms").alias("_t")).join(q.select("_t").distinct(), "_t", "left_semi")
    dt = dt.withColumn("_part", F.pmod(F.xxhash64(d_id), F.lit(parts)).cast("int"))
    q = q.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    g = q.join(dt, ["_t", "_part"]).groupBy(q_id, d_id).agg(F.count(F.lit(1)).alias("matched"), F.max((~F.col("_t").isin(*generic)).cast("int")).alias("_s"))
    return g.where((F.col("matched") > 1) | (F.col("_s") == 1)).drop("_s")


def evidence_coverage(queries: DataFrame, matches: DataFrame, q_id: str, d_id: str) -> DataFrame:
    """Markets seen and covered, coverage ratio, distinct documents."""
    m = matches.agg(F.count_distinct(q_id).alias("markets_covered"), F.count_distinct(d_id).alias("fresh_documents"))
    return (queries.agg(F.count_distinct(q_id).alias("markets_seen")).crossJoin(m)
            .withColumn("coverage", F.when(F.col("markets_seen") > 0, F.round(F.col("markets_covered") / F.col("markets_seen"), 4)).otherwise(0.0)))


def age_sec(now: Column, ts: str) -> Column:
    return seconds(now) - seconds(ts)
