"""Operator 2: URL filter by the ratio of two character language models, DataFrame functions only.

Rules (host and path prefix) decide where they fit. The others are judged by two smoothed variable-order Markov models, one
of the urls that rules allow and one of those they block: a character's probability after a context of up to three characters
is the Witten-Bell mixture of its own counts and the next shorter context's, so unseen contexts fall back by themselves. Characters are folded to 32
symbols, which bounds the model at 32^4 entries whatever the corpus: it is one array of log ratios, looked up by position.
The score is the mean log10 ratio per character; the threshold is where normal approximations of the two classes' scores,
taken on a fifth of the ruled urls that training leaves out, are equally wrong.

Nulls and urls without "://" have empty host and path and the score of an empty text; with no ruled urls at all every score
is 0 and passes; repeated urls are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import load, query, written

RULES = {"allow": ["com/", "www.example.com/en/"], "block": ["example.com/en/", "net/es/", "net/fr/"]}
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0.-/_"  # digits are 0, what is not listed is the last symbol
A = len(SYMBOLS) + 1
ORDER = 4  # longest n-gram
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url) -> tuple:
    """Host (A-Z lower-cased) and path of a url column, empty without "://"."""
    shape = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.coalesce(F.regexp_extract(url, shape, 1), F.lit("")), UPPER, LOWER)
    return host, F.coalesce(F.regexp_extract(url, shape, 2), F.lit(""))


def fitting(host, path, rules: Sequence[str]):
    """The longest of `rules` that fits: its host or a subdomain, and a path that starts with its path."""
    pick = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):
        name, _, rest = r.partition("/")
        pick = F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), F.lit(r)).otherwise(pick)
    return pick


def _codes(text):
    """Array of symbol numbers (1 to A) of a text column."""
    plain = F.translate(F.translate(text, UPPER, LOWER), "123456789", "0" * 9)
    chars = F.array_remove(F.split(plain, ""), "")
    at = F.lit(SYMBOLS)
    return F.transform(chars, lambda c: F.when(F.instr(at, c) > 0, F.instr(at, c)).otherwise(F.lit(A)))


def _grams(codes):
    """Number of the n-gram that ends at each place, the text being led by last symbols."""
    n, lead = F.size(codes), F.concat(F.array_repeat(F.lit(A), ORDER - 1), codes)
    out = F.transform(F.slice(lead, 1, n), lambda c: c - 1)
    for j in range(1, ORDER):
        out = F.zip_with(out, F.slice(lead, j + 1, n), lambda g, c: g * A + c - 1)
    return out


def model(samples: DataFrame) -> DataFrame:
    """One row, one array `ratio`: log10 of accepted over rejected probability of each n-gram's last character.

    `samples` holds `grams` and `good` (boolean).
    """
    grams = (samples.select("good", F.explode("grams").alias("g")).groupBy("g").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")))
    out = samples.sparkSession.range(1).select(F.lit(0).alias("g"), F.lit(1.0 / A).alias("p_good"), F.lit(1.0 / A).alias("p_bad"))
    for k in range(1, ORDER + 1):
        own = grams.groupBy((F.col("g") % A ** k).alias("s")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        context = own.groupBy(F.floor(F.col("s") / A).alias("c")).agg(
            *[F.sum(c).alias(f"n_{c}") for c in ("good", "bad")], *[F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in ("good", "bad")])
        # the shorter context's probability of the same last character, under each possible first character
        longer = out.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(A - 1)))).withColumn("g", F.col("first") * A ** (k - 1) + F.col("g"))
        longer = longer.join(own, F.col("g") == F.col("s"), "left").join(context, F.floor(F.col("g") / A) == F.col("c"), "left")
        n = {c: F.coalesce(F.col(f"n_{c}"), F.lit(0)) for c in ("good", "bad")}
        t = {c: F.coalesce(F.col(f"t_{c}"), F.lit(0)) for c in ("good", "bad")}
        out = longer.select("g", *[F.when(n[c] + t[c] > 0, (F.coalesce(F.col(c), F.lit(0)) + t[c] * F.col(f"p_{c}")) / (n[c] + t[c]))
                                   .otherwise(F.col(f"p_{c}")).alias(f"p_{c}") for c in ("good", "bad")])
    table = out.select("g", (F.log10("p_good") - F.log10("p_bad")).cast("float").alias("r"))
    return table.agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "r"))), lambda x: x["r"]).alias("ratio"))


def _score(grams, ratio):
    total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(ratio, g).cast("double"))
    return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(F.lit(0.0))


def judged(pages: DataFrame, allow: Sequence[str], block: Sequence[str]) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, threshold) of each row of `pages` (page_id, url)."""
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", fitting(F.col("host"), F.col("path"), [*allow, *block]))
    grams = _grams(_codes(F.concat("host", "path")))
    ruled = rows.where("rule is not null").select(
        F.col("rule").isin(list(allow)).alias("good"), grams.alias("grams"), (F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0).alias("aside"))
    ratio = written(model(ruled.where("not aside")))
    scored = ruled.where("aside").withColumn("_ratio", ratio.scalar()).select("good", _score(F.col("grams"), F.col("_ratio")).alias("s"))
    each = scored.agg(*[f(F.when(F.col("good") == good, F.col("s"))).alias(f"{n}{int(good)}")
                        for good in (True, False) for n, f in (("m", F.avg), ("d", F.stddev_pop))])
    spread = F.col("d0") + F.col("d1")
    middle = F.when(spread > 0, (F.col("m1") * F.col("d0") + F.col("m0") * F.col("d1")) / spread).otherwise((F.col("m0") + F.col("m1")) / 2)
    threshold = written(each.select(F.coalesce(F.when(F.col("m1") > F.col("m0"), middle), F.lit(0.0)).alias("threshold")))
    out = rows.withColumn("_ratio", ratio.scalar()).select("*", _score(grams, F.col("_ratio")).alias("score")).withColumn("threshold", threshold.scalar())
    own = F.when(F.col("rule").isin(list(allow)), "allow").when(F.col("rule").isNotNull(), "block")
    return out.select("page_id", "host", "path", "rule", F.coalesce(own, F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block"))
                      .alias("verdict"), "score", "threshold")


@query("op2_url_markov_ratio")
def op2(spark, d):
    return judged(load(spark, d, "pages"), RULES["allow"], RULES["block"])
