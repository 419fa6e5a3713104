"""Text expressions: tokens, lexicon scores, HTML, URLs, ids and times. All stay inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlab.functions.mathx import clip

WORD = r"[a-z][a-z\-']+"

# Entity texts replaced when cleaning feed titles (ampersand last).
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}

# Words left out of narrative counts.
NARRATIVE_STOP = ("the", "and", "for", "with", "this", "that", "from", "will", "has", "have", "are", "its", "was", "new",
                  "how", "why", "what", "you", "your", "after", "amid", "over", "into", "more", "than", "says", "could",
                  "here", "week", "just", "not", "but", "all")

# Words that never become query terms, and single terms too common to match alone.
QUERY_STOP = ("about", "after", "against", "among", "before", "being", "championship", "could", "does", "from", "have", "into",
              "market", "over", "should", "team", "than", "that", "their", "there", "these", "they", "this", "under", "will",
              "with", "would", "win", "yes", "no")
GENERIC_TERMS = ("city", "county", "country", "council", "election", "government", "league", "national", "president", "price",
                 "state", "united")

# Capitals that look like tickers but are not.
TICKER_BLACKLIST = ("USD", "USDT", "USDC", "ETF", "CEO", "SEC", "AI", "US", "UK", "EU", "GDP", "API", "NFT", "DEFI", "FUD",
                    "FOMO", "ATH", "TVL", "APR", "APY", "IPO", "NYSE", "CPI", "FED", "DOJ", "OK", "USA", "RSS", "URL", "PM",
                    "AM", "THE", "FOR", "NEW", "ALL", "ONE", "TOP", "NOW", "BIG", "WHY", "HOW", "CAN")

# Sentiment and macro lexicons and negators, as word -> weight.
BULL = {"surge": 2, "soar": 2, "rally": 2, "breakout": 2, "bullish": 2, "ath": 2, "all-time": 1.5, "record": 1.5,
        "adoption": 1.5, "etf": 1, "approval": 1.5, "gain": 1, "gains": 1, "up": .5, "rise": 1, "rises": 1, "rising": 1,
        "jump": 1.5, "pump": 1, "moon": 1.5, "buy": .5, "buying": 1, "accumulate": 1.5, "inflow": 1.5, "institutional": 1,
        "upgrade": 1, "partnership": 1, "launch": .5, "growth": 1, "bull": 1.5, "optimism": 1.5, "recovery": 1,
        "rebound": 1.5, "halving": .5}
BEAR = {"crash": 2, "plunge": 2, "dump": 2, "bearish": 2, "selloff": 2, "sell-off": 2, "hack": 2, "exploit": 2, "scam": 2,
        "fraud": 2, "lawsuit": 1.5, "sec": .5, "ban": 1.5, "fear": 1, "fud": 1, "drop": 1, "drops": 1, "fall": 1,
        "falls": 1, "down": .5, "decline": 1, "liquidation": 1.5, "liquidations": 1.5, "outflow": 1.5, "bankrupt": 2,
        "bankruptcy": 2, "collapse": 2, "warning": 1, "risk": .5, "sell": .5, "selling": 1, "panic": 2, "bear": 1.5,
        "correction": 1, "tumble": 1.5}
MACRO_POS = {"cut": 1.5, "cuts": 1.5, "cutting": 1.5, "dovish": 2, "easing": 1.5, "stimulus": 1.5, "cooling": 1,
             "cooled": 1, "slowing": .5, "soft": .5, "approval": 1.5, "approved": 1.5, "adoption": 1.5, "clarity": 1,
             "friendly": 1, "legalize": 1.5, "etf": .5, "growth": .5, "rally": 1}
MACRO_NEG = {"hike": 1.5, "hikes": 1.5, "hawkish": 2, "tightening": 1.5, "inflation": .5, "recession": 2, "crackdown": 2,
             "lawsuit": 1.5, "ban": 2, "sues": 1.5, "enforcement": 1.5, "restrictions": 1.5, "hot": .5, "surge": .3,
             "tariff": 1, "tariffs": 1, "war": 1, "crisis": 2, "default": 1.5}
NEGATORS = ("not", "no", "never", "without", "isn't", "isnt", "aren't", "arent", "won't", "wont", "fails", "fail", "unlikely",
            "denies", "denied", "rejects", "rejected")


def words(text) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def signed(pos: dict[str, float], neg: dict[str, float]) -> dict[str, float]:
    return {w: pos.get(w, 0.0) - neg.get(w, 0.0) for w in {**pos, **neg}}


def lexicon_score(text, lexicon: dict[str, float], negators=()) -> Column:
    """F1 / F2: summed word weights over max(3, 0.35 n), clamped; a negator before a word flips it.

    Words pass a hash test against the lexicon first, so only hits reach the weight lookup.
    """
    table = F.create_map(*[x for w, v in lexicon.items() for x in (F.lit(w), F.lit(float(v)))])
    keys, negs = list(lexicon), list(negators)

    def step(a, w):
        v = F.when(w.isin(*keys), F.try_element_at(table, w) * F.when(a["neg"], -1.0).otherwise(1.0)).otherwise(0.0)
        return F.struct((a["sum"] + v).alias("sum"), w.isin(*negs).alias("neg"))

    def score(ws):
        if negs:
            total = F.aggregate(ws, F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("neg")), step, lambda a: a["sum"])
        else:
            total = F.aggregate(F.filter(ws, lambda w: w.isin(*keys)), F.lit(0.0), lambda a, w: a + F.try_element_at(table, w))
        return clip(total / F.greatest(F.lit(3.0), F.size(ws) * 0.35))

    # the one-element array binds the words to a name, so the text is split once
    return F.transform(F.array(words(text)), score)[0]


def unescape(c) -> Column:
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def clean_markup(c) -> Column:
    """Entities, CDATA marks and tags removed, ends trimmed."""
    c = F.replace(F.replace(unescape(c), F.lit("<![CDATA["), F.lit("")), F.lit("]]>"), F.lit(""))
    return F.trim(F.regexp_replace(c, r"<[^>]+>", " "))


def strip_html(c) -> Column:
    """script, style and noscript blocks, then tags, dropped; white space collapsed."""
    for tag in ("script", "style", "noscript"):
        c = F.regexp_replace(c, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def terms(text) -> Column:
    """distinct tokens of at least four characters without stop words, in order of appearance."""
    toks = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9'\-]{2,}"), F.lit(0))
    kept = F.filter(toks, lambda t: ~t.isin(*QUERY_STOP))
    bare = F.transform(kept, lambda t: F.regexp_replace(t, r"^['\-]+|['\-]+$", ""))
    return F.array_distinct(F.filter(bare, lambda t: F.length(t) >= 4))


def query_text(question, category) -> Column:
    """search text from the first six terms of a question and the first of its category."""
    picked = F.concat(F.slice(terms(question), 1, 6), F.slice(terms(category), 1, 1))
    return F.substring(F.array_join(F.array_distinct(picked), " "), 1, 180)


def tickers(text, listed, blacklist=TICKER_BLACKLIST) -> Column:
    """$-prefixed symbols, and bare capitals that are listed, without the blacklist. `listed` is an array column."""
    dollar = F.regexp_extract_all(text, F.lit(r"\$([A-Z]{2,6})(?:[^A-Za-z0-9_]|$)"), F.lit(1))
    bare = F.array_intersect(F.split(text, "[^A-Za-z0-9_]+"), listed)
    return F.array_except(F.array_union(dollar, bare), F.array(*[F.lit(b) for b in blacklist]))


def base_symbol(c) -> Column:
    """BTC-USD -> BTC."""
    return F.upper(F.trim(F.split_part(c, F.lit("-"), F.lit(1))))


TRACKING = ("gclid", "fbclid", "oc", "hl", "gl")


def canonical_url(url) -> Column:
    """Lower-case scheme and host, no trailing slash, tracking parameters dropped, the rest sorted."""
    u = F.trim(url)
    scheme, host = F.lower(F.regexp_extract(u, r"^(?i)(https?)://", 1)), F.lower(F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), r"/+$", "")
    params = F.filter(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(
        rf"^(utm_[^=]*|{'|'.join(TRACKING)})(=|$)"))
    q = F.array_join(F.array_sort(F.transform(params, lambda p: F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))))), "&")
    full = F.concat(scheme, F.lit("://"), host, path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when((scheme != "") & (host != ""), full).otherwise("")


def short_hash(c, n: int = 16) -> Column:
    """first n hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, n)


def seed_of(*parts) -> Column:
    """reproducible integer seed from context values."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("bigint")


def parse_time(c) -> Column:
    """ISO with offset or Z, RFC 2822 (weekday ignored), or epoch seconds; NULL when none fits."""
    iso = F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    local = F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    mail = F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss xx"))
    epoch = F.when(c.rlike(r"^\d+(\.\d+)?$"), F.timestamp_micros((c.try_cast("double") * 1_000_000).cast("bigint")))
    return F.coalesce(iso, local, mail, epoch)


def iso_text(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def first_slug(*cols) -> Column:
    """lower-case first word of the first non-empty slug, else other."""
    c = F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in cols])
    return F.coalesce(F.lower(F.split_part(c, F.lit("-"), F.lit(1))), F.lit("other"))


def dig(obj, *paths: str) -> Column:
    """first dotted path present in a JSON text."""
    return F.coalesce(*[F.get_json_object(obj, "$." + p) for p in paths])
