"""Operator 5: main text of html pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the text between two tags of block elements, with the chain of its open elements. Scripts, styles,
comments, drawings, option lists and the like hold no text; what media elements show in their stead is text of their block. Features of a block are its ancestors' tags, the telling parts of their class, id and role names, and
its text: length, share of linked text, closing mark, place on the page. Two labels, main text or not; trained on labelled pages, decoded by
Viterbi. The labelled pages are made up by `labelled_pages` (a few layouts with varied furniture, known labels) and, in `trained`,
joined by a bounded sample of the table's own pages whose markup names the article, with words of that table.

Null or empty html and pages without a main block give an empty text; broken markup is read as far as it goes: unclosed
inline elements end with their block, an unclosed block ends with its parent, an unclosed head with what can't stand in it; rows repeat freely; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import load, lowest, query

SAMPLE, EPOCHS = 300, 4
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "head", "select"}
IN_HEAD = {"base", "basefont", "bgsound", "head", "link", "meta", "noscript", "script", "style", "template", "title"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
          "object", "audio", "video", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
          "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}
#: Silent elements and what can't stand in them, so ends them where their end tag is missing.
OUTSIDE = {"svg": ENDS_P | {"body", "p", "li", "dt", "dd"}, "select": {"article", "body", "main", "section", "p"}}
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)", re.S)
NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")


def leaf_blocks(page: str) -> list[tuple[str, frozenset, int]]:
    """(text, telling marks of the open elements, characters inside links) of each leaf block, in page order.

    The scan goes on behind the end tag of a raw element, so nothing inside one is read as markup. An element without text of
    its own doesn't cut the block it stands in.
    """
    stack: list[tuple[str, list[str]]] = []
    places: dict[str, list[int]] = defaultdict(list)
    marks: Counter[str] = Counter()
    out, text, linked, in_link, pos = [], [], 0, 0, 0
    hidden: list[int] = []

    def close():
        nonlocal linked
        if text:
            own = " ".join(entities.unescape("".join(text)).split())
            if own:
                out.append((own, frozenset(marks), linked))
            text.clear()
        linked = 0

    def pop():
        tag, own = stack.pop()
        places[tag].pop()
        if tag in SILENT:
            hidden.pop()
        for m in own:
            marks[m] -= 1
            if not marks[m]:
                del marks[m]

    while m := TOKEN.match(page, pos):
        pos = m.end()
        ending, tag, rest, plain = m.groups()
        if stack and stack[-1][0] == "head" and (plain.strip() if plain is not None else tag and not ending and tag.lower() not in IN_HEAD):
            pop()
        if plain is not None:
            if not hidden:
                text.append(plain)
                if in_link:
                    linked += len(plain.strip())
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br" or tag == "img":
                text.append(" ") if not hidden else None
            elif tag == "a" and not hidden:
                in_link = 0 if ending else 1
            continue
        if ending:
            if places[tag]:
                if not hidden or places[tag][-1] < hidden[0]:
                    close()
                    in_link = 0
                for _ in range(len(stack) - places[tag][-1]):
                    pop()
            elif tag == "p" and not hidden:
                close()
            continue
        for holder, others in OUTSIDE.items():
            while places[holder] and tag in others and not places["foreignobject"]:
                pop()
        if not hidden and tag not in SILENT:
            close()
            in_link = 0
        ended = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        while stack and stack[-1][0] in ended:
            pop()
        if tag in VOID or rest.endswith("/") and tag not in RAW:
            continue
        names = {n for g in NAMES.findall(rest) for n in WORD.findall("".join(g).lower())} & TELLING if rest else ()
        own = [*({tag} & TAGS), *(f".{n}" for n in names)]
        if tag in SILENT:
            hidden.append(len(stack))
        places[tag].append(len(stack))
        stack.append((tag, own))
        marks.update(own)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, pos)
            pos = end.start() if end else len(page)
    close()
    return out


#: Parts of class, id and role names and what they tell, fixed values.
TELLING = {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "consent", "notice", "alert", "gdpr", "menu", "nav", "navbar",
           "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "copyright", "sidebar", "aside", "widget", "related", "recommended",
           "share", "social", "comment", "comments", "reply", "discussion", "disqus", "newsletter", "subscribe", "signup", "login", "search", "form", "popup",
           "modal", "pagination", "pager", "tags", "toolbar", "article", "content", "main", "post", "entry", "story", "body", "text", "complementary",
           "contentinfo", "meta", "byline", "author"}
TAGS = {"article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "p", "h1", "h2", "h3", "h4", "blockquote", "pre", "div",
        "figure", "figcaption", "button", "dl", "td"}
FEATURES = {n: i for i, n in enumerate(
    [*(f"tag:{t}" for t in sorted(TAGS)), *(f"name:{t}" for t in sorted(TELLING)), *(f"words:{i}" for i in range(8)), *(f"link:{i}" for i in range(4)),
     "stop", "mark", "symbol", "first", "last", "early", "late", "always"])}


def features(blocks: list[tuple[str, frozenset, int]]) -> list[list[int]]:
    out = []
    for i, (text, marks, linked) in enumerate(blocks):
        own = [FEATURES["always"], FEATURES[f"words:{min(7, (text.count(' ') + 1).bit_length() - 1)}"],
               FEATURES[f"link:{min(3, 4 * linked // max(1, len(text)))}"]]
        for m in sorted(marks):
            k = FEATURES.get(f"name:{m[1:]}" if m[0] == "." else f"tag:{m}")
            if k is not None:
                own.append(k)
        own += [FEATURES[n] for n, yes in (("stop", text[-1] in ".!?\"'”"), ("mark", "," in text or "." in text), ("symbol", text[0] in "©&|»·"), ("first", i == 0),
                                           ("last", i == len(blocks) - 1), ("early", 4 * i < len(blocks)), ("late", 4 * i >= 3 * len(blocks))) if yes]
        out.append(own)
    return out


class Chain:
    """Weights of label 1 per feature and transition scores [from, to]."""

    def __init__(self):
        self.w, self.move = np.zeros(len(FEATURES)), np.zeros((2, 2))

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], epochs: int = EPOCHS) -> Chain:
        rng, sums, move_sums = np.random.default_rng(2), np.full(len(FEATURES), 1e-3), np.full((2, 2), 1e-3)
        for _ in range(epochs):
            for i in rng.permutation(len(pages)):
                feats, y = pages[i]
                if not feats:
                    continue
                p, moves = self.marginals([self.w[f].sum() for f in feats])
                grad, want = np.zeros(len(FEATURES)), np.zeros((2, 2))
                for f, a, b in zip(feats, y, p, strict=True):
                    grad[f] += a - b
                for a, b in zip(y, y[1:], strict=False):
                    want[a, b] += 1
                grad -= 1e-3 * self.w
                sums += grad * grad
                self.w += 0.2 * grad / np.sqrt(sums)
                move_sums += (want - moves) ** 2
                self.move += 0.1 * (want - moves) / np.sqrt(move_sums)
        return self

    def marginals(self, s) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(s), self.move
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        e = np.stack([np.zeros(n), np.array(s)], 1)
        a[0] = e[0]
        for t in range(1, n):
            a[t] = e[t] + np.logaddexp(a[t - 1, 0] + m[0], a[t - 1, 1] + m[1])
        for t in range(n - 2, -1, -1):
            x = e[t + 1] + b[t + 1]
            b[t] = np.logaddexp(m[:, 0] + x[0], m[:, 1] + x[1])
        z = np.logaddexp(*a[-1])
        pair = np.exp(a[:-1, :, None] + m[None] + (e + b)[1:, None] - z).sum(0) if n > 1 else np.zeros((2, 2))
        return np.exp(a[:, 1] + b[:, 1] - z), pair

    def decode(self, feats: list[list[int]]) -> list[int]:
        """Viterbi labels."""
        w, ((m00, m01), (m10, m11)) = self._list, self.move.tolist()
        zero, one, back = 0.0, 0.0, []
        for t, f in enumerate(feats):
            s = sum([w[k] for k in f])
            if t == 0:
                zero, one = 0.0, s
                continue
            to0, to1 = (one + m10 > zero + m00), (one + m11 > zero + m01)
            back.append((to0, to1))
            zero, one = (one + m10 if to0 else zero + m00), s + (one + m11 if to1 else zero + m01)
        y = [int(one > zero)] if feats else []
        for to0, to1 in reversed(back):
            y.append(int(to1 if y[-1] else to0))
        return y[::-1]

    @property
    def _list(self) -> list[float]:
        return self.w.tolist()


def labelled_pages(n: int = 300, seed: int = 4) -> list[tuple[str, set]]:
    """Made-up pages of varied layout and the texts that are their main blocks."""
    rng = np.random.default_rng(seed)
    words = ["ka", "mo", "ter", "lin", "sol", "ve", "ra", "pid", "on", "gel", "tu", "mar", "ni", "se", "dor"]

    def say(low, high, end="."):
        return " ".join("".join(rng.choice(words, rng.integers(1, 4))) for _ in range(rng.integers(low, high))).capitalize() + end

    def wrap(tag, inner, name=None):
        return f'<{tag} {rng.choice(["class", "id"])}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def links(k):
        return wrap("ul", "".join(f'<li><a href="/x">{say(1, 3, rng.choice(["", ".", ","]))}</a></li>' for _ in range(k)))

    pages = []
    for _ in range(n):
        main, body = set(), []

        def keep(text, main=main):
            main.add(text)
            return text

        parts = [wrap(rng.choice(["h1", "h1", "h2"]), keep(say(2, 12, rng.choice(["", "."]))))]
        for _ in range(rng.integers(1, 9)):
            kind = rng.random()
            text = keep(say(1, 5) if kind < 0.15 else say(8, 90))
            parts.append("<p><b>" + text + "<br>" if kind > 0.93 else wrap(rng.choice(["p", "p", "p", "p", "blockquote", "h2", "li"]), text))
            if rng.random() < 0.12:
                parts.append(wrap("div", say(3, 14), rng.choice(["ad", "ads", "promo", "share social", "newsletter signup", "related"])))
        holder = rng.integers(4)
        inner = "".join(parts)
        article = (wrap("article", inner), wrap("main", inner), wrap("div", inner, rng.choice(["content", "post entry", "story body", "main content", "article text"])),
                   wrap("main", wrap("article", inner, "post")))[holder]
        before = [wrap("nav", links(rng.integers(2, 8))), wrap("header", say(1, 6, "") + links(2)), wrap("div", say(5, 25), "cookie consent notice"),
                  wrap("div", links(4), rng.choice(["menu", "navbar navigation", "breadcrumb"])), wrap("div", say(4, 20), rng.choice(["ad", "banner", "sponsored", "alert"])),
                  wrap("form", say(1, 4) + "<input><button>" + say(1, 2, "") + "</button>", "search"), wrap("aside", "<p>" + say(5, 40) + "</p>")]
        after = [wrap("footer", "&copy; " + say(2, 25)), wrap("aside", links(3) + "<p>" + say(5, 40) + "</p>", "sidebar"), wrap("div", "<p>" + say(5, 60) + "</p>", "sidebar widget"),
                 wrap(rng.choice(["section", "div"]), "".join(wrap("div", "<p>" + say(3, 60) + "</p>", "comment") for _ in range(rng.integers(1, 4))), "comments"),
                 wrap("form", "<label>" + say(1, 4) + "</label><p>" + say(3, 20) + "</p>", "reply"), wrap("div", say(3, 12) + links(3), "related"),
                 wrap("div", say(4, 20), "footer copyright")]
        body += [before[i] for i in sorted(rng.choice(len(before), rng.integers(0, 5), False))] + [article]
        body += [after[i] for i in sorted(rng.choice(len(after), rng.integers(0, 5), False))]
        pages.append(("<html><head><title>" + say(2, 6) + "</title><script>var a='<p>';</script></head><body>" + "".join(body)
                      + ("</body></html>" if rng.random() < 0.9 else ""), main))
    return pages


def trained(pages: DataFrame, sample: int = SAMPLE) -> Chain:
    """A chain from made-up pages and from the table's pages with the smallest id hashes whose markup has an article element."""
    data = []
    for page, main in labelled_pages():
        blocks = leaf_blocks(page)
        data.append((features(blocks), [int(b[0] in main) for b in blocks]))
    own = pages.where(F.col("html").cast("string").rlike("(?i)<article")).select(F.xxhash64("page_id", "url").alias("h"), "html")
    for r in lowest(own, "h", sample).orderBy("h", "html").limit(sample).collect():
        blocks = leaf_blocks(r["html"])
        furniture = {"nav", "footer", "aside", "form", ".ad", ".comments", ".comment"}
        data.append((features(blocks), [int("article" in m and not m & furniture) for _, m, _ in blocks]))
    return Chain().fit(data)


def extracted(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) of each row of `pages` (page_id, url, html)."""
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    chain = trained(pages, sample)

    def run(batches):
        for b in batches:
            texts, n = [], []
            for page in b["html"]:
                blocks = leaf_blocks(page.as_py() or "")
                y = chain.decode(features(blocks))
                texts.append("\n".join(x[0] for x, keep in zip(blocks, y, strict=True) if keep))
                n.append(len(blocks))
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int32())],
                                             names=["page_id", "url", "text", "n_chars", "n_blocks"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks int")


@query("op5_block_crf")
def op5(spark, d):
    return extracted(load(spark, d, "pages"))
