"""HTML extraction by the maximum-scoring run of a page: words count for it, tags against it, by weights from labelled pages."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import below

#: Labelled pages (those with one article or main element) that the weights are fitted on, at most, and the characters up to
#: which a page counts as a labelled one. Both are parameters of extract_text; every page is extracted, whatever its length.
LABELLED, LABELLED_CHARS = 1_000, 1_000_000
#: Strength of the data against the prior: words that all labelled pages together count for, at most, and the prior's precision.
EVIDENCE, PRECISION, STEPS = 5_000.0, 1.0, 1_500
#: Log odds against content from which an element speaks for all it holds, whatever stands inside it.
FIRM = -2.0

#: A tag; a quote opens a value only behind an equals sign. PLAIN ends at the next ">", for pages whose quotes don't pair.
TAG = re.compile(r"""<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+)>""")
PLAIN = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>")
MARKS = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "xmp", "noframes", "math", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
CONTENT = ("article", "main")
#: What the weights are before any page is seen: the fit starts from these values and moves them as the labelled pages say.
#: Elements, and words in class, id or role (with a dot), that mostly hold page furniture; those that mostly hold content.
FURNITURE = ("nav", "aside", "footer", "form", "menu", "dialog", "button", "select", "head")
FURNITURE_WORDS = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "promo", "promotion", "sponsor", "sponsored", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer",
    "comment", "comments", "disqus", "replies", "respond", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search", "share",
    "sharing", "social", "related", "recommended", "widget", "toolbar", "contentinfo", "complementary", "copyright", "pagination", "pager", "skip",
)
PRIOR = {x: -4.0 for x in FURNITURE} | {f".{x}": -4.0 for x in FURNITURE_WORDS} | {"header": -1.5, ".header": -1.5, ".masthead": -1.5, ".topbar": -1.5} | {x: 2.0 for x in CONTENT}
#: Elements that hold no content, however much of a page they hold; words of what readers wrote; words of a site's own heading.
NEVER = {"nav", "footer", "aside", "head", "menu", "dialog", "button", "select"}
REMARKS = {".comment", ".comments", ".disqus", ".replies", ".respond"}
SITE = {"header", ".site", ".masthead", ".topbar", ".logo", ".brand"}
#: Share of the words outside of NEVER elements from which an element is the frame of the content, not a part beside it.
FRAME = 0.8
#: Words and tags inside and outside of content that are counted before any page is seen.
DENSITY = {("word", True): 9, ("tag", True): 1, ("word", False): 5, ("tag", False): 5}


class Weights(NamedTuple):
    """feature: log odds of content that an open element adds by its name or a word of its class, id or role; word and tag: the
    log odds of either kind of token, which are above and below zero as content has fewer tags a word."""

    feature: dict[str, float]
    word: float
    tag: float


def scan(page: str):
    """The page in order: ("open", name, features), ("shut", depth, name), ("lone", name, ()) and ("text", text, ()).

    depth is the number of open elements that stay; a lone tag opens nothing, be it void, raw or an end without a begin. Contents
    of RAW elements are left out. Work is linear in the page, whatever its nesting: positions of open elements are kept by name,
    what no ">" ends is text, and after the first tag whose quotes don't pair tags end at the next ">".
    """
    at, n, last, quotes = 0, len(page), page.rfind(">"), True
    stack: list[str] = []
    places: dict[str, list[int]] = {}

    def shut(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop()].pop()

    while at < n:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = n if stop < 0 else stop
            yield "text", page[at:stop], ()
            at = stop
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = n if stop < 0 else stop + 3
            continue
        if at > last:
            # nothing ends a tag from here on
            yield "text", page[at:], ()
            return
        if page[at + 1] in "!?":
            at = page.find(">", at) + 1
            continue
        m = TAG.match(page, at) if quotes else None
        if m is None:
            m = PLAIN.match(page, at)
            if m is None:
                yield "text", "<", ()
                at += 1
                continue
            quotes = False
        at = m.end()
        name, is_end, rest = m["name"].lower(), bool(m["end"]), m["rest"]
        if is_end:
            if places.get(name):
                depth = places[name][-1]
                shut(depth)
                yield "shut", depth, name
            else:
                yield "lone", name, ()
            continue
        if name in RAW:
            yield "lone", name, ()
            close = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = page.find(">", close.end()) + 1 if close else n
            at = at or n
            continue
        if name in VOID or rest.endswith("/"):
            yield "lone", name, ()
            continue
        # a block ends an open paragraph, with the elements left open in it; an item ends the item before it
        depth = places["p"][-1] if name in BLOCK and places.get("p") else len(stack) - 1 if name == "li" and stack and stack[-1] == "li" else None
        if depth is not None:
            ended = stack[depth]
            shut(depth)
            yield "shut", depth, ended
        places.setdefault(name, []).append(len(stack))
        stack.append(name)
        # what holds the whole page tells nothing, nor does the name of a generic container
        own = () if name in ("html", "body", "div", "span") else (name,)
        yield "open", name, (*own, *(f".{x}" for x in _marks(rest))) if rest and name not in ("html", "body") else own


def _marks(rest: str) -> list[str]:
    """Words of class, id and role; names that tell of what is absent or elsewhere (has-sidebar) are left out."""
    out = set()
    for a in MARKS.findall(rest):
        for name in "".join(a).lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            if words and words[0] not in ("has", "no", "with", "without", "not"):
                out.update(words)
    return sorted(out)


class _Open:
    """The open elements of a page, each with the features that it added to those of the elements around it."""

    def __init__(self):
        self.active: Counter = Counter()
        self.added: list[tuple] = []

    def open(self, features: tuple) -> tuple:
        new = tuple(f for f in features if f not in self.active)
        self.active.update(new)
        self.added.append(new)
        return new

    def shut(self, depth: int) -> None:
        while len(self.added) > depth:
            for f in self.added.pop():
                del self.active[f]


def observations(page: str) -> tuple[Counter, Counter]:
    """Of a labelled page, words by (features of the open elements, in content) and tokens by (kind, in content)."""
    words: Counter = Counter()
    kinds: Counter = Counter()
    elements = _Open()
    for kind, what, features in scan(page):
        if kind == "open":
            elements.open(features)
        elif kind == "shut":
            elements.shut(what)
        inside = "article" in elements.active or "main" in elements.active
        n = len(entities.unescape(what).split()) if kind == "text" else 1
        if n:
            kinds["word" if kind == "text" else "tag", inside] += n
            if kind == "text":
                words[tuple(sorted(elements.active)), inside] += n
    return words, kinds


def fit(words: Counter, kinds: Counter) -> Weights:
    """Weights by logistic regression of the label on the features of the open elements, from PRIOR on.

    Each observation counts half as it is and half without the elements that made its label, so that the other features are
    learned too and hold on pages without those elements. The loss is convex and the steps are fixed: equal counts give equal
    weights. Without observations they are those of PRIOR.
    """
    kinds = Counter(DENSITY) + kinds
    share = lambda kind, inside: kinds[kind, inside] / (kinds["word", inside] + kinds["tag", inside])
    density = {kind: math.log(share(kind, True) / share(kind, False)) for kind in ("word", "tag")}
    seen = sorted({f for (fs, _) in words for f in fs})
    if not seen:
        return Weights(dict(PRIOR), density["word"], density["tag"])
    place = {f: k for k, f in enumerate(seen)}
    start = np.array([PRIOR.get(f, 0.0) for f in seen])
    sets, labels, counts = [], [], []
    for (fs, inside), n in sorted(words.items()):
        for hidden in (False, True):
            sets.append([place[f] for f in fs if not (hidden and f in CONTENT)])
            labels.append(1.0 if inside else 0.0)
            counts.append(n / 2)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    col = np.array([k for x in sets for k in x], np.int64)
    y, c = np.array(labels), np.array(counts)
    c *= min(EVIDENCE, c.sum()) / c.sum()
    rate = 1 / (PRECISION + 0.25 * c.sum() * max(1, max(map(len, sets))))
    w, before = start.copy(), start.copy()
    for t in range(STEPS):
        ahead = w + (t / (t + 3)) * (w - before)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, ahead[col], len(sets)), -40, 40)))
        slope = np.bincount(col, (c * (p - y))[row], len(seen)) + PRECISION * (ahead - start)
        before, w = w, ahead - rate * slope
    return Weights(PRIOR | dict(zip(seen, w.tolist(), strict=True)), density["word"], density["tag"])


def frames(tokens: list[tuple]) -> set[int]:
    """Places of the open tags whose elements hold the content, so that nothing they are called makes them furniture.

    These are the article or main element with the most words, all elements around it, and inside it the articles with half of
    its words. Without such an element, those that have paragraphs and FRAME or more of the words that stand outside of NEVER
    elements; inside the content element, those that have as much of its words and a first-level heading. Comments are never such
    frames.
    """
    words = paragraphs = titles = 0
    outer: int | None = None  # depth of the outermost NEVER element that is open
    stack: list[int] = []
    held: dict[int, list[int]] = {}
    parent: dict[int, int] = {}

    def shut(depth):
        while len(stack) > depth:
            k = stack.pop()
            held[k] = [now - before for now, before in zip((words, paragraphs, titles), held[k], strict=True)]

    for k, (kind, what, _) in enumerate(tokens):
        if kind == "text":
            words += len(what.split()) if outer is None else 0
        elif kind == "open":
            parent[k] = stack[-1] if stack else -1
            held[k] = [words, paragraphs, titles]
            paragraphs += what == "p"
            titles += what == "h1"
            outer = len(stack) if outer is None and what in NEVER else outer
            stack.append(k)
        elif kind == "shut":
            shut(what)
            outer = outer if outer is not None and outer < what else None
    shut(0)
    marks = {k: tokens[k][1] for k in held if tokens[k][1] in CONTENT}
    core = max(marks, key=lambda k: (held[k][0], -k), default=None)
    if core is not None and not held[core][0]:
        core = None
    total = words if core is None else held[core][0]
    out = set()
    for k, (n, ps, hs) in held.items():
        name, features = tokens[k][1], tokens[k][2]
        if core is not None and k < core:
            continue
        if k == core or name in CONTENT and core is not None and 2 * n >= total:
            out.add(k)
        elif total and (ps if core is None else hs) and n >= FRAME * total and name not in NEVER and not REMARKS.intersection(features):
            out.add(k)
    while core is not None and core >= 0:
        out.add(core)
        core = parent[core]
    return out


def scored(page: str, weights: Weights) -> tuple[list[tuple[str, str, float]], list[tuple[int, int]]]:
    """The page's tokens with their scores: ("text", text, score), ("tag", name, score), and None for the score of what is left
    out; with the places of first-level headings that are no site's own.

    A word's and a tag's score are the log odds of their kind plus those that the open elements add; a frame of the content only
    adds what speaks for it. A block, or another element by its class, id or role, that turns them from above zero to zero or
    below, or lowers them by FIRM or more by what it is called, is furniture wherever it stands: it is left out with all it
    holds and doesn't end the run around it.
    """
    out: list[tuple] = []
    heads: list[tuple[int, int]] = []
    elements = _Open()
    odds, tops, turned, title = [0.0], [math.inf], None, None  # log odds and their bound at each depth; depths from which all is left out, and of an open heading
    get = weights.feature.get
    tokens = list(scan(page))
    kept = frames(tokens)
    for k, (kind, what, features) in enumerate(tokens):
        if kind == "text":
            out.append(("text", what, None if turned is not None else len(what.split()) * (weights.word + odds[-1])))
            continue
        if kind == "shut":
            elements.shut(what)
            del odds[what + 1 :], tops[what + 1 :]
            if turned is not None and what < turned:
                turned = None
            out.append(("tag", features, None if turned is not None else weights.tag + odds[-1]))
            if title is not None and what <= title[0]:
                heads.append((title[1], k + 1))
                title = None
            continue
        if kind == "open":
            new = elements.open(tuple(f for f in features if get(f, 0.0) > 0) if k in kept else features)
            own = sum(get(f, 0.0) for f in new)
            now = min(odds[-1] + own, tops[-1])
            speaks = what in BLOCK or sum(get(f, 0.0) for f in new if f != what) < 0
            firm = sum(get(f, 0.0) for f in new if f in PRIOR or f[0] == ".") <= FIRM
            if turned is None and speaks and (firm or now <= 0 < odds[-1]):
                turned = len(odds)
            if what == "h1" and turned is None and title is None and not SITE.intersection(elements.active):
                title = len(odds) - 1, k
            tops.append(min(tops[-1], now) if speaks and own <= FIRM else tops[-1])
            odds.append(now)
        out.append(("tag", what, None if turned is not None else weights.tag + odds[-1]))
    return out, heads


def best_run(scores: list[float | None]) -> tuple[int, int]:
    """Begin and end of the contiguous run with the largest sum above zero (the first such, and of those the shortest); (0, 0) if
    there is none. None counts as zero."""
    best, span, now, first = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if now <= 0:
            now, first = 0.0, i
        now += s or 0.0
        if now > best:
            best, span = now, (first, i + 1)
    return span


def extract(page: str | None, weights: Weights) -> str:
    """Text of the best run of a page, less the furniture inside it: one blank line between blocks. A run without a first-level
    heading is led by the last one before it."""
    tokens, heads = scored(page or "", weights)
    begin, end = best_run([x[2] for x in tokens])
    ahead = [h for h in heads if h[1] <= begin] if end and not any(begin < stop and start < end for start, stop in heads) else []
    blocks: list[str] = []
    parts: list[str] = []

    def flush():
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            blocks.append(text)
        parts.clear()

    for kind, what, score in [x for start, stop in ahead[-1:] for x in tokens[start:stop]] + tokens[begin:end]:
        if kind == "tag":
            if what in BLOCK:
                flush()
            elif what == "br":
                parts.append(" ")
        elif score is not None:
            parts.append(what)
    flush()
    return "\n\n".join(blocks)


def fit_weights(pages: DataFrame, id_col: str, html_col: str, labelled: int = LABELLED, labelled_chars: int = LABELLED_CHARS) -> Weights:
    """Weights from up to `labelled` pages whose content is marked: those with exactly one article or main element.

    Pages are taken by a hash threshold that follows from a count, so that only the sample itself moves: no page is sorted or
    sent that isn't in it. Counts are added up in Spark; what comes to the driver follows from the sample's size.
    """
    page = F.col(f"`{html_col}`")
    marked = pages.filter((F.length(page) <= labelled_chars) & (F.regexp_count(page, F.lit(r"(?i)<(article|main)\b")) == 1))
    key = F.xxhash64(F.col(f"`{id_col}`"), page)
    total = marked.count()
    # a fifth more than asked for, as hashes vary; what is still over goes by rank within the sample
    sample = marked.filter(below(key, 1.2 * labelled / max(1, total))).select(page.alias("html"), key.alias("key"))
    sample = sample.orderBy("key").limit(labelled).select("html") if total > labelled else sample.select("html")

    def run(batches):
        for b in batches:
            words, kinds = Counter(), Counter()
            for x in b.column(0).to_pylist():
                w, k = observations(x)
                words += w
                kinds += k
            rows = [(list(fs), inside, n) for (fs, inside), n in sorted(words.items())] + [([f"#{kind}"], inside, n) for (kind, inside), n in sorted(kinds.items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())], names=["features", "inside", "n"])

    words, kinds = Counter(), Counter()
    for x in sample.mapInArrow(run, "features array<string>, inside boolean, n long").groupBy("features", "inside").agg(F.sum("n").alias("n")).collect():
        if len(x.features) == 1 and x.features[0][:1] == "#":
            kinds[x.features[0][1:], x.inside] += x.n
        else:
            words[tuple(x.features), x.inside] += x.n
    return fit(words, kinds)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", labelled: int = LABELLED, labelled_chars: int = LABELLED_CHARS) -> DataFrame:
    """Every row of pages with a column text: the main text of its page, empty if there is none.

    Null or empty html gives an empty text. Without labelled pages the weights are those of PRIOR. A column text of pages is
    replaced; others pass through. Each page is scanned once, from end to end; repeated rows are extracted each. Of equal runs
    the first is taken. Deep nesting and elements that are never closed cost no more than others.
    """
    weights = fit_weights(pages, id_col, html_col, labelled, labelled_chars)

    @F.pandas_udf("string")
    def text(page):
        import pandas as pd

        return pd.Series([extract(x, weights) for x in page], dtype=object)

    return pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() != "text"], text(F.col(f"`{html_col}`")).alias("text"))


def op4_html_extraction(spark, sf_dir):
    from .common import table

    t = extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text")
    return t.withColumn("n_chars", F.length("text").cast("long"))
