"""Text, mention, signal-ingestion and universe queries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from marketlab.functions import text as X
from marketlab.functions.mathx import r6
from marketlab.operators import docs as D
from marketlab.operators import ledger as G
from marketlab.operators import scans as S
from marketlab.plans.registry import query
from marketlab.plans.views import with_views
from marketlab.sources import tables as T

DV = with_views("docs")
BULL = {"the": 1.0, "and": 0.5, "with": 2.0}
BEAR = {"of": 1.0, "for": 1.5, "by": 0.5}
NEG = ("that", "it")
MPOS, MNEG = {"die": 1.5, "der": 1.0, "que": 0.5}, {"la": 1.0, "en": 0.5, "les": 2.0}


def case(d, w="w"):
    return f"CASE {w} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.items()) + " ELSE 0 END"


def lex_sql(name, lex, negs=()):
    neg = f"CASE WHEN i > 1 AND ws[i - 1] IN ({', '.join(repr(n) for n in negs)}) THEN -1 ELSE 1 END" if negs else "1"
    return f""", {name}w AS (SELECT doc_id, regexp_extract_all(lower(body), '[a-z][a-z\\-'']+') AS ws FROM docs),
{name}u AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM {name}w),
{name}v AS (SELECT doc_id, sum({case(lex, 'ws[i]')} * {neg}) AS s FROM {name}u GROUP BY 1),
{name} AS (SELECT doc_id, greatest(-1, least(1, coalesce(s, 0) / greatest(3, len(ws) * 0.35))) AS score FROM {name}w LEFT JOIN {name}v USING (doc_id))
"""


LEX, MAC = X.signed(BULL, BEAR), X.signed(MPOS, MNEG)


@query("F1", DV + lex_sql("lx", LEX, NEG) + "SELECT doc_id, round(score, 6) AS score FROM lx")
def lexicon_sentiment(spark, d):
    return T.docs(spark, d).select("doc_id", r6(X.lexicon_score(F.col("body"), LEX, NEG)).alias("score"))


@query("F2", DV + lex_sql("mc", MAC) + "SELECT doc_id, round(score, 6) AS score FROM mc")
def macro_score(spark, d):
    return T.docs(spark, d).select("doc_id", r6(X.lexicon_score(F.col("body"), MAC)).alias("score"))


@query("F1 F2 J7 (built-in lexicons)", DV + lex_sql("lx", X.signed(X.BULL, X.BEAR), [n.replace("'", "") for n in X.NEGATORS if "'" not in n]) + "SELECT doc_id, round(score, 6) AS score FROM lx")
def finance_sentiment(spark, d):
    return T.docs(spark, d).select("doc_id", r6(X.lexicon_score(F.col("body"), X.signed(X.BULL, X.BEAR), X.NEGATORS)).alias("score"))


@query("X3", DV + lex_sql("mc", MAC) + "SELECT doc_id, round(score, 6) AS score FROM mc")
def pluggable_scorer(spark, d):
    word, weights = re.compile(X.WORD), dict(MAC)

    @F.pandas_udf("double")
    def scorer(texts: pd.Series) -> pd.Series:
        found = texts.str.lower().map(word.findall)
        return found.map(lambda ws: sum(weights.get(w, 0.0) for w in ws) / max(3.0, len(ws) * 0.35))

    x = D.score_documents(T.docs(spark, d), "body", scorer)
    return x.select("doc_id", r6(F.col("score")).alias("score"))


LISTED = ("CI", "OF", "DE", "TO", "AND", "LA", "EN", "IN", "ER", "DER", "WAS", "OU", "THE")
TICK = DV + f""", tk AS (SELECT doc_id, kind, source, unnest(list_filter(list_distinct(list_concat(regexp_extract_all(body, '\\$([A-Z]{{2,6}})(?:[^A-Za-z0-9_]|$)', 1),
  list_intersect(string_split_regex(body, '[^A-Za-z0-9_]+'), {list(LISTED)!r}))), lambda s: s NOT IN ({', '.join(repr(b) for b in X.TICKER_BLACKLIST)}))) AS sym FROM docs)
"""


def mentions(spark, d):
    listed = F.array(*[F.lit(s) for s in LISTED])
    return T.docs(spark, d).select("doc_id", "kind", "source", F.explode(X.tickers(F.col("body"), listed)).alias("sym"))


@query("F3", TICK + "SELECT sym, count(*) AS n_docs, min(doc_id) AS first_doc FROM tk GROUP BY 1")
def ticker_mentions(spark, d):
    return mentions(spark, d).groupBy("sym").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


HEAT = TICK.replace("WITH ", "WITH RECURSIVE ", 1) + """, mw AS (SELECT sym, doc_id // 60 AS c, CASE WHEN kind = 'fr' THEN 3 ELSE 1 END AS w, kind FROM tk), pr AS (SELECT sym, c, CAST(sum(w) AS DOUBLE) AS w FROM mw GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY c) AS i FROM pr), ls AS (SELECT max(doc_id // 60) AS last FROM docs),
f(sym, i, c, h) AS (SELECT sym, i, c, w FROM o WHERE i = 1 UNION ALL SELECT o.sym, o.i, o.c, o.w + CASE WHEN f.h * power(0.85, o.c - f.c) >= 0.2 THEN f.h * power(0.85, o.c - f.c) ELSE 0 END FROM f JOIN o ON o.sym = f.sym AND o.i = f.i + 1),
z AS (SELECT sym, h * power(0.85, last + 1 - c) AS h FROM f, ls QUALIFY row_number() OVER (PARTITION BY sym ORDER BY i DESC) = 1), sr AS (SELECT sym, count(DISTINCT kind) AS n_sources FROM mw GROUP BY 1),
heat AS (SELECT sym, n_sources, h + CASE WHEN n_sources >= 2 THEN 0.5 * (n_sources - 1) ELSE 0 END AS heat FROM z JOIN sr USING (sym) WHERE h >= 0.2)
"""


def heat_table(spark, d):
    m = mentions(spark, d).select("sym", F.floor(F.col("doc_id") / 60).alias("cycle"), F.when(F.col("kind") == "fr", 3).otherwise(1).alias("weight"), F.col("kind").alias("source_kind"))
    last = T.docs(spark, d).agg(F.floor(F.max("doc_id") / 60).alias("last"))
    # the newest cycle is one number, carried along as part of the fold's key
    keyed = m.crossJoin(F.broadcast(last)).withColumn("sym", F.struct("sym", "last"))
    return D.mention_heat(keyed, F.col("sym.last")).select("sym.sym", "n_sources", "heat")


@query("A25", HEAT + "SELECT sym, n_sources, round(heat, 6) AS heat FROM heat")
def mention_heat(spark, d):
    return heat_table(spark, d).select("sym", "n_sources", r6(F.col("heat")).alias("heat"))


@query("A26 J8", HEAT + """, cd AS (SELECT sym, heat, heat * (1 + length(sym) / 10) AS eff, sym < 'E' AS special, CASE WHEN sym IN ('WAS') THEN 'not listed' WHEN sym IN ('OU') THEN 'volume below floor' END AS rj FROM heat WHERE sym NOT IN ('DE') AND heat >= 1.5),
ok AS (SELECT *, row_number() OVER (PARTITION BY special ORDER BY eff DESC, sym) AS r FROM cd WHERE rj IS NULL)
SELECT sym, round(eff, 6) AS eff_heat, special, CASE WHEN r > CASE WHEN special THEN 2 ELSE 4 END THEN 'no slot' ELSE 'chosen' END AS reason FROM ok UNION ALL SELECT sym, round(eff, 6), special, rj FROM cd WHERE rj IS NOT NULL""")
def universe_rank(spark, d):
    c = heat_table(spark, d).withColumns({"mult": 1 + F.length("sym") / 10, "special": F.col("sym") < "E", "listed": F.col("sym") != "WAS", "liquid": F.col("sym") != "OU"})
    return D.universe_rank(c, ["DE"], 4, 2).withColumn("eff_heat", r6(F.col("eff_heat")))


PG = "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g') AS h FROM pages"


@query("F4", f"SELECT page_id, length(t) AS n_chars, sha256(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM ({PG}))")
def html_strip(spark, d):
    t = X.strip_html(F.col("html"))
    return T.load(spark, d, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("digest"))


UNESC = "i"
for _k, _v in X.ENTITIES.items():
    UNESC = f"replace({UNESC}, '{_k}', '{_v.replace(chr(39), chr(39) * 2)}')"


@query("S5", f"""WITH it AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li[\\s>](.*?)</li>', 1)) AS i FROM pages), tt AS (SELECT page_id, regexp_extract(i, '(?is)<a[^>]*>(.*?)</a>', 1) AS i FROM it WHERE regexp_matches(i, '(?is)<a[^>]*>(.*?)</a>')),
c AS (SELECT page_id, trim(regexp_replace({UNESC}, '<[^>]+>', ' ', 'g')) AS title FROM tt) SELECT page_id, title, count(*) AS n FROM c WHERE length(title) >= 4 GROUP BY 1, 2""")
def read_feed_items(spark, d):
    p = T.load(spark, d, "pages").select("page_id", "html")
    # list items of a page have the shape <li><a>title</a></li>
    x = D.feed_items(p, "html", r"(?is)<li[\s>](.*?)</li>", r"(?is)<a[^>]*>(.*?)</a>", shortest=4)
    return x.groupBy("page_id", "title").agg(F.count(F.lit(1)).alias("n"))


def terms_sql(c):
    stop = ", ".join(repr(s) for s in X.QUERY_STOP)
    return (f"list_filter(list_transform(list_filter(regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9''\\-]{{2,}}'), lambda t: t NOT IN ({stop})), "
            f"lambda t: regexp_replace(t, '^[''\\-]+|[''\\-]+$', '', 'g')), lambda t: length(t) >= 4)")


@query("F5", DV + f", t AS (SELECT doc_id, unnest(list_distinct({terms_sql('body')})) AS term FROM docs) SELECT term, count(*) AS n_docs FROM t GROUP BY 1 HAVING count(*) > 3")
def query_terms(spark, d):
    return (T.docs(spark, d).select("doc_id", F.explode(X.terms(F.col("body"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs")).where("n_docs > 3"))


@query("A24 K3", DV + f""", w AS (SELECT unnest(regexp_extract_all(lower(body), '[a-z][a-z\\-'']+')) AS topic FROM docs) SELECT topic, count(*) AS n FROM w WHERE length(topic) > 3
  AND topic NOT IN ({', '.join(repr(s) for s in X.NARRATIVE_STOP)}) GROUP BY 1 ORDER BY n DESC, topic LIMIT 10""")
def narratives(spark, d):
    return D.narratives(T.docs(spark, d), "body")


KEYWORDS = {"A0": ["tion "], "A1": ["eau", "ment"], "A2": ["the th"], "A3": ["ing and", "und "], "A4": ["ando"]}
TAG = ", tg AS (" + " UNION ALL ".join(f"SELECT doc_id, kind, '{a}' AS asset FROM docs WHERE {' OR '.join(f'contains(lower(body), {k!r})' for k in ks)}" for a, ks in KEYWORDS.items()) + ")\n"


def tagged(spark, d):
    return D.tag_assets(T.docs(spark, d), "body", KEYWORDS)


@query("J11", DV + TAG + "SELECT asset, count(*) AS n_docs, sum(doc_id) AS id_sum FROM tg GROUP BY 1")
def asset_tagging(spark, d):
    return tagged(spark, d).select("doc_id", F.explode("assets").alias("asset")).groupBy("asset").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_id").alias("id_sum"))


@query("A23", DV + lex_sql("lx", LEX, NEG) + lex_sql("mc", MAC) + TAG + """, mm AS (SELECT 0.5 * (SELECT avg(score) FROM lx JOIN docs USING (doc_id) WHERE kind <> 'de') + 0.3 * (62 - 50) / 50 + 0.2 * (SELECT avg(score) FROM mc JOIN docs USING (doc_id) WHERE kind = 'de') AS m),
g AS (SELECT asset, avg(score) AS rs, count(*) AS n FROM tg JOIN lx USING (doc_id) WHERE kind <> 'de' GROUP BY 1)
SELECT asset, n AS n_docs, round(m, 6) AS market_sentiment, round(least(1, n / 5) * rs + (1 - least(1, n / 5)) * m, 6) AS score FROM g, mm""")
def doc_sentiment(spark, d):
    x = tagged(spark, d).withColumn("macro", F.col("kind") == "de")
    x = x.withColumn("score", F.when(F.col("macro"), X.lexicon_score(F.col("body"), MAC)).otherwise(X.lexicon_score(F.col("body"), LEX, NEG)))
    return D.doc_sentiment(x, 62).select("asset", "n_docs", r6(F.col("market_sentiment")).alias("market_sentiment"), r6(F.col("score")).alias("score"))


@query("K5", DV + TAG + """, c AS (SELECT asset, count(*) AS mentions, asset IN ('A0', 'A3', 'A4') AS special FROM tg GROUP BY 1 HAVING count(*) >= 3), f AS (SELECT * FROM c WHERE special ORDER BY mentions DESC, asset LIMIT 2)
SELECT asset, mentions, special, priority FROM (SELECT *, true AS priority FROM f UNION ALL SELECT *, false FROM c WHERE asset NOT IN (SELECT asset FROM f))""")
def research_queue(spark, d):
    c = tagged(spark, d).select(F.explode("assets").alias("asset")).groupBy("asset").agg(F.count(F.lit(1)).alias("mentions")).withColumn("special", F.col("asset").isin("A0", "A3", "A4"))
    return D.research_queue(c)


@query("A27", """WITH f AS (SELECT source, doc_id AS seq, n_chars > 900 AS ok, n_chars % 7 AS items, CAST(replace(source, 'src', '') AS INT) % 2 = 0 AS candidate FROM documents),
g AS (SELECT source, sum(CAST(ok AS INT)) AS successes, max(CASE WHEN ok THEN seq END) AS lo, max_by(items, CASE WHEN ok THEN seq END) AS last_items, bool_or(candidate) AS candidate FROM f GROUP BY 1),
l AS (SELECT source, count(*) AS failures FROM f JOIN g USING (source) WHERE NOT ok AND (lo IS NULL OR seq > lo) GROUP BY 1), h AS (SELECT g.*, coalesce(failures, 0) AS failures FROM g LEFT JOIN l USING (source))
SELECT source, successes, failures, last_items, candidate, CASE WHEN failures > 0 THEN least(1800, power(2, failures) * 60) END AS backoff_sec, CASE WHEN candidate AND failures >= 6 THEN 'demoted'
  WHEN candidate AND successes >= 2 AND last_items >= 3 THEN 'promoted' WHEN failures > 0 THEN 'backoff' WHEN successes > 0 THEN 'ok' ELSE 'untested' END AS status FROM h""")
def source_health(spark, d):
    f = T.load(spark, d, "documents").select("source", F.col("doc_id").alias("seq"), (F.col("n_chars") > 900).alias("ok"), (F.col("n_chars") % 7).alias("items"),
                                             (F.replace("source", F.lit("src"), F.lit("")).cast("int") % 2 == 0).alias("candidate"))
    return D.source_health(f)


@query("U1", DV + """, u AS (SELECT *, CAST(CAST(replace(source, 'src', '') AS INT) < 10 AS INT) AS old FROM docs), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY body ORDER BY old, doc_id) = 1)
SELECT doc_id, source FROM k""")
def merge_documents(spark, d):
    x = T.docs(spark, d)
    n = F.replace("source", F.lit("src"), F.lit("")).cast("int")
    return D.merge_documents(x.where(n >= 10), x.where(n < 10), F.col("body"), ["doc_id"]).select("doc_id", "source")


@query("U6", DV + TAG + """, s AS (SELECT DISTINCT asset, source FROM tg JOIN docs USING (doc_id) UNION SELECT 'A' || CAST(s_suppkey % 8 AS VARCHAR), 'manual' || CAST(s_nationkey % 5 AS VARCHAR) FROM supplier)
SELECT asset, count(*) AS n_sources, string_agg(source, ',' ORDER BY source) AS sources FROM s GROUP BY 1""")
def asset_sources(spark, d):
    found = tagged(spark, d).select(F.explode("assets").alias("asset"), "source")
    manual = T.load(spark, d, "supplier").select(F.concat(F.lit("A"), F.col("s_suppkey") % 8).alias("asset"), F.concat(F.lit("manual"), F.col("s_nationkey") % 5).alias("source"))
    s = found.union(manual).distinct()
    return s.groupBy("asset").agg(F.count(F.lit(1)).alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("U2 U3", """WITH cur AS (SELECT s_suppkey AS sym FROM supplier WHERE s_acctbal > 0), tgt AS (SELECT l_suppkey AS sym FROM lineitem GROUP BY 1 HAVING avg(l_discount) > 0.05), core AS (SELECT s_suppkey AS sym FROM supplier WHERE s_nationkey < 3),
held AS (SELECT DISTINCT l_suppkey AS sym FROM lineitem WHERE l_quantity = 50 AND l_tax = 0.08), t AS (SELECT sym FROM tgt UNION SELECT sym FROM core UNION (SELECT sym FROM held INTERSECT SELECT sym FROM cur))
SELECT sym, 'added' AS change FROM (SELECT sym FROM t EXCEPT SELECT sym FROM cur) UNION ALL SELECT sym, 'removed' FROM (SELECT sym FROM cur EXCEPT SELECT sym FROM t)""")
def universe_diff(spark, d):
    s, li = T.load(spark, d, "supplier"), T.load(spark, d, "lineitem")
    k = F.col("s_suppkey").alias("sym")
    tgt = li.groupBy(F.col("l_suppkey").alias("sym")).agg(F.avg("l_discount").alias("a")).where("a > 0.05")
    held = li.where("l_quantity = 50 and l_tax = 0.08").select(F.col("l_suppkey").alias("sym"))
    return D.universe_diff(s.where("s_acctbal > 0").select(k), tgt, s.where("s_nationkey < 3").select(k), held)


URL_SQL = """SELECT page_id, regexp_replace(url, '#.*$', '') || CASE WHEN url LIKE '%?%' THEN '&utm_source=a&gclid=1' ELSE '/?utm_campaign=b&b=2&a=1' END AS u FROM pages"""


@query("U5 F13", f"""WITH s AS ({URL_SQL}), p AS (SELECT page_id, lower(regexp_extract(u, '^(https?)://', 1)) AS scheme, lower(regexp_extract(u, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_replace(regexp_extract(u, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|oc|hl|gl)(=|$)'))) AS q FROM s),
c AS (SELECT page_id, scheme || '://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM p)
SELECT canonical, substring(sha256(canonical), 1, 16) AS doc_hash, min(page_id) AS page_id, count(*) AS n FROM c GROUP BY 1, 2""")
def canonical_urls(spark, d):
    u = F.regexp_replace("url", "#.*$", "")
    p = T.load(spark, d, "pages").select("page_id", F.concat(u, F.when(F.contains("url", F.lit("?")), "&utm_source=a&gclid=1").otherwise("/?utm_campaign=b&b=2&a=1")).alias("u"))
    p = p.select("page_id", X.canonical_url(F.col("u")).alias("canonical"))
    return p.groupBy("canonical", X.short_hash(F.col("canonical")).alias("doc_hash")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


EV = DV + f""", q AS (SELECT item_id, unnest(list_distinct({terms_sql('text')})) AS t FROM benchmark), t AS (SELECT doc_id, unnest(list_distinct({terms_sql('body')})) AS t FROM docs),
m AS (SELECT item_id, doc_id, count(*) AS matched FROM q JOIN t USING (t) GROUP BY 1, 2 HAVING count(*) > 1 OR max(CASE WHEN t IN ({', '.join(repr(g) for g in X.GENERIC_TERMS)}) THEN 0 ELSE 1 END) = 1)
"""


def evidence(spark, d):
    q = T.load(spark, d, "benchmark").select("item_id", X.terms(F.col("text")).alias("terms"))
    return q, D.evidence_match(q, T.docs(spark, d).select("doc_id", X.terms(F.col("body")).alias("terms")), "item_id", "doc_id")


@query("J18", EV + "SELECT item_id, count(*) AS n_docs, sum(matched) AS n_matches FROM m GROUP BY 1")
def evidence_match(spark, d):
    return evidence(spark, d)[1].groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("matched").alias("n_matches"))


@query("A68", EV + "SELECT (SELECT count(*) FROM benchmark) AS markets_seen, count(DISTINCT item_id) AS markets_covered, count(DISTINCT doc_id) AS fresh_documents, round(count(DISTINCT item_id) / (SELECT count(*) FROM benchmark), 4) AS coverage FROM m")
def evidence_coverage(spark, d):
    q, m = evidence(spark, d)
    return D.evidence_coverage(q, m, "item_id", "doc_id")


RAW = """WITH r AS (SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, value AS val, 'src' || CAST(user_id % 7 AS VARCHAR) AS source FROM events),
s AS (SELECT event_id, ts, source, k, CASE WHEN k % 4 = 3 THEN '' ELSE upper(event_type) END AS asset, CASE WHEN k % 5 = 1 THEN NULL WHEN k % 5 = 0 THEN 0.25 ELSE greatest(-1, least(1, val / 40 - 1)) END AS value FROM r),
ok AS (SELECT * FROM s WHERE asset <> '' AND value IS NOT NULL), nw AS (SELECT max(ts) AS now FROM events)
"""


def raw_signals(spark, d):
    k = F.col("k")
    e = T.load(spark, d, "events").withColumn("k", T.k_of())
    return e.select("event_id", "ts", F.concat(F.lit("src"), F.col("user_id") % 7).alias("source"), F.when(k % 4 == 0, F.concat("event_type", F.lit("-usd"))).alias("asset"),
                    F.when(k % 4 == 1, F.col("event_type")).alias("symbol"), F.when(k % 4 == 2, F.col("event_type")).alias("product"),
                    F.when(k % 5 == 0, None).when(k % 5 == 1, "abc").otherwise((F.col("value") / 40 - 1).cast("string")).alias("value"),
                    F.when(k % 5 == 0, "0.25").alias("lean"), F.lit(None).cast("string").alias("score"), F.lit("signal").alias("kind"), F.concat(F.lit("note "), k).alias("text"))


def accepted(spark, d):
    x = D.normalize_signals(raw_signals(spark, d), F.current_timestamp()).where("ok")
    now = T.load(spark, d, "events").agg(F.max("ts").alias("now"))
    return x.select("event_id", F.col("n_ts").alias("ts"), F.col("n_source").alias("source"), F.col("n_asset").alias("asset"), F.col("n_value").alias("value"),
                    F.col("n_text").alias("text")).crossJoin(F.broadcast(now))


@query("P1 P2 F15", RAW + "SELECT source, sum(CAST(asset <> '' AND value IS NOT NULL AS INT)) AS accepted, sum(CAST(asset = '' OR value IS NULL AS INT)) AS rejected, round(sum(CASE WHEN asset <> '' THEN value END), 4) AS total FROM s GROUP BY 1")
def normalize_signal_rows(spark, d):
    x = D.normalize_signals(raw_signals(spark, d), F.current_timestamp())
    return x.groupBy(F.col("n_source").alias("source")).agg(F.sum(F.col("ok").cast("int")).alias("accepted"), F.sum((~F.col("ok")).cast("int")).alias("rejected"),
                                                            r6(F.sum(F.when(F.col("ok"), F.col("n_value"))), 4).alias("total"))


AGE = "(epoch(now) - epoch(ts))"


@query("A29 P18", RAW + f"SELECT asset, round(sum((1 - {AGE} / 864000) * value) / sum(1 - {AGE} / 864000), 6) AS signal FROM ok, nw WHERE {AGE} BETWEEN 0 AND 864000 GROUP BY 1")
def freshness_mean(spark, d):
    x = D.freshness_mean(accepted(spark, d), ["asset"], "value", D.age_sec(F.col("now"), "ts"), 864000.0)
    return x.select("asset", r6(F.col("signal")).alias("signal"))


@query("K2", RAW + f"SELECT asset, event_id, '[' || source || '] note ' || k AS line FROM ok, nw WHERE {AGE} BETWEEN 0 AND 864000 QUALIFY row_number() OVER (PARTITION BY asset ORDER BY ts DESC, event_id DESC) <= 3")
def latest_texts(spark, d):
    x = accepted(spark, d).where(D.fresh(D.age_sec(F.col("now"), "ts"), 864000.0))
    x = D.latest_per_key(x, "asset", ["ts", "event_id"], 3)
    return x.select("asset", "event_id", F.concat(F.lit("["), "source", F.lit("] "), "text").alias("line"))


@query("A28", RAW + f""", g AS (SELECT source, asset, GROUPING(source, asset) AS gid, count(*) AS n, max(ts) AS lt, sum(CAST({AGE} BETWEEN 0 AND 864000 AS INT)) AS f FROM ok, nw GROUP BY GROUPING SETS ((), (source), (asset)))
SELECT CASE gid WHEN 3 THEN 'all' WHEN 1 THEN 'source' ELSE 'asset' END AS slice, coalesce(source, asset, 'all') AS key, n, CAST(epoch_us(lt) AS BIGINT) AS last_ts, f AS fresh_rows FROM g""")
def signal_status(spark, d):
    x = D.signal_status(accepted(spark, d), D.age_sec(F.col("now"), "ts"), 864000.0)
    return x.withColumn("last_ts", S.micros("last_ts"))


@query("F6 F7 F10 F12", """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS mail, CAST(floor(epoch(ts)) AS BIGINT) AS raw, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day_index, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS rendered,
  split_part(event_type || '-x-2026', '-', 1) AS category, CASE WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm' WHEN s < 86400 THEN printf('%.1fh', s / 3600) ELSE printf('%.1fd', s / 86400) END AS human FROM (SELECT *, floor(value * 1000) + 7 AS s FROM events)""")
def time_functions(spark, d):
    e = T.load(spark, d, "events")
    plus4 = F.timestamp_seconds(F.unix_seconds("ts") - 4 * 3600)
    iso = F.concat(F.date_format(plus4, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-04:00"))
    mail = F.concat(F.lit("Mon, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    t = {"iso": X.parse_time(iso), "mail": X.parse_time(mail), "raw": X.parse_time(F.unix_seconds("ts").cast("string"))}
    return e.select("event_id", *[F.unix_seconds(c).alias(n) for n, c in t.items()], F.floor(F.unix_seconds("ts") / 86400).alias("day_index"), X.iso_text(F.col("ts")).alias("rendered"),
                    X.first_slug(F.lit(""), F.concat("event_type", F.lit("-x-2026"))).alias("category"), G.human_duration(F.floor(F.col("value") * 1000) + 7).alias("human"))
