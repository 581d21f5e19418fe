"""Line dedup, quality rules, HTML extraction and substring dedup against plain versions on small tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandwise.llm import html_text, quality, substring
from strandwise.llm.line_dedup import dedup_lines

SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def plain_line_dedup(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = ascii_lower(line.strip(SPACES))
            if len(k) >= 20:
                holders[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[k := ascii_lower(x.strip(SPACES))]) >= 3 and len(k) >= 20 and max(holders[k], key=lambda v: (v is not None, v or 0)) != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


LINE = "Ärger über the SAME long line"


def test_line_dedup_against_plain(spark):
    rows = [(1, f"a\n {LINE} \nb\n"), (2, f"{LINE.replace('SAME', 'same')}\n{LINE}"), (3, LINE), (3, LINE), (4, LINE.replace("Ä", "ä")), (5, None), (6, ""), (None, LINE + "\nx"), (7, "short\n" * 4), (8, "short"), (9, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in dedup_lines(df).collect()), key=str)
    assert got == plain_line_dedup(rows)


def test_line_dedup_rows_of_one_id_with_other_texts(spark):
    rows = [(1, "x\n" + LINE), (1, LINE + "\nx\ny"), (2, LINE), (3, LINE)]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plain_line_dedup(rows)


def test_line_dedup_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", "clash", 5)], "doc_id long, text string, n_lines string, digest int")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "digest", "n_lines", "n_dropped"]
    assert [tuple(r) for r in out.collect()] == [(1, "a", 5, 1, 0)]
    assert dedup_lines(df.limit(0)).count() == 0


def plain_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)


def test_quality_counts_against_plain(spark):
    rng = random.Random(5)
    texts = [None, "", " \n ", "one", "é # a|b\n\na|b\na|b\n"]
    texts += [" ".join(rng.choice(["a", "bb", "c!", "d\n", "é"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["x y z u v w p q " * 9, "word " * 30 + "end", "a b c d e f g h " * 2 + " ".join(map(str, range(300)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(df).collect()}
    assert got == {i: plain_quality(t) for i, t in enumerate(texts)}


def test_quality_lines_go_and_documents_with_them(spark):
    good = "This is a plain sentence of ten words, nothing more here.\n" * 1 + "Another plain line that has some other ten words in it."
    good += "\nYet a third one with words enough to pass the count."
    nav = "home | about | news | contact"
    rows = [(1, f"{good}\n{nav}"), (2, good), (3, f"{good}\n" + "thing*** " * 30), (4, "LOUD!! " * 3 + good.replace("\n", " ")), (5, f"{good}\nAll rights reserved 2020")]
    got = {r.doc_id: (r.kept, r.clean_text) for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (True, good) and got[2] == (True, good) and not got[3][0] and got[4][0] and got[5] == (True, good)


SENTENCE = "This is a plain sentence that has a good number of words in it, and then some more of them."
FAILING = [
    "Tous droits réservés 2020.", "Alle Rechte vorbehalten.", "Política de privacidad aquí.", "Skip to content", "home » news » sport » contact", "a · b · c · d",
    "see http://a.b/c www.d.e", "2020 2021 2022 2023 2024 99", "THIS LINE IS ALL IN CAPITALS.", "ÄÖÜ ÉÈÊ ÑÁÍ ÓÚÀ ÂÎÔ", "And then it went on...", "Weiter lesen…", "*** buy ### now %%%", "buy!! now!!",
]
STAYING = ["A single heading", SENTENCE + "..", "One link http://a.b/c in a line of plain words.", "In 2020 and 2021 there were 12345678 of them in all of the town, or so they say.", "NASA and ESA met.", '"Is it?"', "", " \t"]


def test_quality_lines_by_shape(spark):
    rows = [(f"f{i}", f"{SENTENCE}\n{x}\n{SENTENCE} {SENTENCE}") for i, x in enumerate(FAILING)] + [(f"s{i}", f"{SENTENCE}\n{x}\n{SENTENCE} {SENTENCE}") for i, x in enumerate(STAYING)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for i, x in enumerate(FAILING):
        assert got[f"f{i}"].clean_text == f"{SENTENCE}\n{SENTENCE} {SENTENCE}" and got[f"f{i}"].lost_words == len(x.split()), x
    for i, x in enumerate(STAYING):
        assert got[f"s{i}"].clean_text.split("\n")[1] == x and got[f"s{i}"].lost_words == 0, x


def test_quality_runs_of_items(spark):
    """Three short lines or more without a sentence end go, wherever they stand; fewer stay, as do short sentences."""
    rng = random.Random(3)
    pool = [SENTENCE, "Home", "About us here", "It rained.", "", "Read: more"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    item = lambda x: x in ("Home", "About us here", "Read: more")
    for r in quality.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        lines, out, k = texts[r.doc_id].split("\n"), [], 0
        while k < len(lines):
            run = 1
            while item(lines[k]) and k + run < len(lines) and item(lines[k + run]):
                run += 1
            out += lines[k : k + run] if not item(lines[k]) or run < 3 else []
            k += run
        assert r.clean_text == "\n".join(out), texts[r.doc_id]


def test_quality_extra_columns(spark):
    out = quality.quality_rules(spark.createDataFrame([(1, None, 2, 3)], "doc_id long, text string, kept int, w int"))
    assert out.columns[:3] == ["doc_id", "text", "w"] and out.first().kept is False
    assert quality.quality_rules(out.limit(0).select("doc_id", "text")).count() == 0


PAGE = '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad">buy this now</div><article><h1>Head &lt;1&gt;</h1><p>First  <b>bold</b>\n text<br>more.<p>Second&nbsp;one.</p></article><section class="comments"><p>nice post, I liked all of it</p></section><footer>&copy; me</footer></body></html>'


def test_html_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>no article here but words"), (1, "u", PAGE), (5, "u", "a < b <"), (6, "u", '<div class="has-sidebar"><p>text stays here</p></div><form><p>not this</p></form>')]
    got = sorted((r.page_id, r.text, r.url) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).fillna("").collect())
    want = "Head <1>\n\nFirst bold text more.\n\nSecond one."
    assert [g[:2] for g in got] == [(1, want), (1, want), (2, ""), (3, ""), (4, "no article here but words"), (5, "a < b <"), (6, "text stays here")]


def test_html_weights_without_labels(spark):
    df = spark.createDataFrame([(1, "<p>plain words only</p><nav>x y</nav>", "old")], "page_id long, html string, text string")
    assert html_text.extract_text(df).first().text == "plain words only"
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_html_against_plain_best_run():
    """The run taken is, of all runs, the one with the largest sum; of equal ones the first and shortest."""
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.choice([None, -3, -1, -0.5, 0, 1, 2, 4]) for _ in range(rng.randrange(14))]
        runs = [(i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)]
        total = {r: sum(x or 0 for x in s[r[0] : r[1]]) for r in runs}
        begin, end = html_text.best_run(s)
        best = max(total.values(), default=0)
        assert sum(x or 0 for x in s[begin:end]) == max(best, 0) and (begin, end) == (0, 0) or total[begin, end] == best
        if best > 0:
            assert end == min(j for i, j in runs if total[i, j] == best)


def labelled(n=40):
    rng = random.Random(7)
    text = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(k))
    side = lambda: f'<div class="zz9"><span>{text(20)}</span></div><nav><ul><li><a href="/">{text(2)}</a></li></ul></nav>'
    return [f"<html><body>{side()}<article><h1>{text(4)}</h1>{''.join(f'<p>{text(30)}</p>' for _ in range(4))}</article>{side()}</body></html>" for _ in range(n)]


def fitted(pages):
    words, kinds = Counter(), Counter()
    for p in pages:
        w, k = html_text.observations(p)
        words += w
        kinds += k
    return html_text.fit(words, kinds)


def test_html_weights_decide():
    """What is furniture is learned: a class that no list knows goes, on pages with and without the labelling element."""
    w = fitted(labelled())
    assert w.word > 0 > w.tag and w.feature[".zz9"] < -0.5 and w.feature["p"] > 0
    plain = html_text.Weights({}, w.word, w.tag)
    for page in labelled(5) + [p.replace("article>", "div>") for p in labelled(5)]:
        got = html_text.extract(page, w)
        body = re.search(r"<(?:article|div)><h1>.*</p>(?=</)", page)[0]
        assert got == "\n\n".join(re.findall(r"<(?:h1|p)>(.*?)</", body))
        assert html_text.extract(page, plain) != got


def test_html_paragraphs_in_furniture_are_furniture():
    w = fitted(labelled())
    for name in ('section class="comments"', "aside", "footer", 'div id="cookie-notice"', 'div class="zz9"'):
        side = f"<{name}>{'<p>some words of a reader stand here</p>' * 3}</{name.split()[0]}>"
        page = f"<html><body>{side}<article><h1>Top</h1>{side}<p>the text itself</p></article>{side}</body></html>"
        got = html_text.extract(page, w)
        assert got == "Top\n\nthe text itself" or "zz9" in name, name


def test_html_labels_override_the_prior():
    """Where labelled pages hold their content in a class of furniture, its weight turns."""
    pages = [p.replace("<h1>", '<section class="notice"><h1>').replace("</article>", "</section></article>") for p in labelled()]
    assert html_text.PRIOR[".notice"] < 0 and fitted(pages).feature[".notice"] > html_text.PRIOR[".notice"] + 2


def test_html_deep_nesting_is_linear():
    import time

    w = html_text.fit(Counter(), Counter())
    start = time.perf_counter()
    for page in ("<div>" * 100_000 + "<p>some words", "<p>" + "<b>" * 100_000 + "words</i>" * 50_000, "<div>" * 50_000 + "<p>x" * 50_000 + "</span>" * 50_000):
        html_text.extract(page, w)
    assert time.perf_counter() - start < 20
    assert html_text.extract("<article>" + "<p>one two three four</p>" * 20_000 + "</article>", w).count("\n\n") == 19_999


def test_html_sample_is_bounded(spark):
    rows = [(i, p, "x", 3) for i, p in enumerate(labelled(60))]
    df = spark.createDataFrame(rows, "page_id long, html string, inside string, key int")
    out = html_text.extract_text(df, labelled=10)
    assert out.columns == ["page_id", "html", "inside", "key", "text"] and out.filter("text = ''").count() == 0


WORDS = [f"w{i}x" for i in range(4000)]


def test_passages_inside_lines_are_found():
    rng = random.Random(3)
    pick = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    for _ in range(200):
        p = pick(51)
        a, b = f"{pick(rng.randrange(60))} {p} {pick(rng.randrange(60))}", f"{pick(rng.randrange(60))} é {p}\n{pick(rng.randrange(60))}"
        kept, starts, stops = substring.cut(b, substring.units(a)[0])
        assert starts and kept == "".join(c for i, c in enumerate(b) if not any(s <= i < e for s, e in zip(starts, stops, strict=True)))
        assert substring.cut(a, np.zeros(0, np.uint64)) == (a, [], [])


def test_word_hashes_do_not_depend_on_place():
    raw = ("abc É xyz " * 30_000).encode()
    h, s, e = substring.word_hashes(np.frombuffer(raw, np.uint8))
    assert len(set(h.tolist())) == 3 and len(h) == 90_000
    one, _, _ = substring.word_hashes(np.frombuffer(b"a" * 200_000 + b" b", np.uint8))
    assert len(one) == 2


def test_substring_dedup(spark):
    rng = random.Random(8)
    pick = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    p, q, line = pick(60), pick(80), pick(30)
    rows = [(1, f"{pick(30)} {p} {pick(9)}"), (2, f"{pick(12)} {p} {pick(40)}"), (3, pick(90)), (4, None), (5, ""), (6, q), (7, q), (7, q), (8, f"{pick(5)}\n{line}\n{pick(5)}"), (9, f"{line}\nend"), (None, p), (10, f"{q[:300]} {pick(3)} {p} {pick(3)} {p}")]
    got = sorted(((r.doc_id, r.text, r.removed, r.n_removed) for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=lambda x: (x[0] is None, x[0] or 0))
    by = {g[0]: g for g in got}
    for i in (1, 3, 5, 6, 8):
        assert by[i][1] == dict(rows)[i] and by[i][2] == [] and by[i][3] == 0
    assert by[4][1] == ""
    for i, t in rows:
        g = by[i]
        keep = "".join(c for k, c in enumerate(t or "") if not any(s.start <= k < s.stop for s in g[2]))
        assert keep == g[1] and g[3] == sum(s.stop - s.start for s in g[2])
    assert len(by[7][1].split()) < 20 and by[9][1].strip() == "end" and len(by[None][1].split()) < 20
    kept = [r[1] or "" for r in got]
    grams = [{tuple(t.split()[k : k + 50]) for k in range(len(t.split()) - 49)} for t in kept]
    assert not any(grams[a] & grams[b] for a in range(len(grams)) for b in range(a))
    assert len(by[2][1].split()) < 12 + 40 + 21


def plain_units(text, pieces=True):
    """(words, begin, end, is_line) of the units of a text, by lists of words; marks from the same hashes of word pairs."""
    words, lines = [], []
    for k, line in enumerate((text or "").split("\n")):
        for w in re.findall(r"[^\x20\x09-\x0D]+", line):
            words.append(ascii_lower(w))
            lines.append(k)
    n, out = len(words), []
    if n < substring.SPAN + 2:
        return words, []
    if pieces:
        h, _, _ = substring.word_hashes(np.frombuffer(" ".join(words).encode(), np.uint8))
        pairs = substring._mix(h[:-1] * np.uint64(3) + h[1:]).tolist()
        width = min(substring.WINDOW, n - 1)
        marks = sorted({min(range(i, i + width), key=lambda j: (pairs[j], j)) for i in range(n - width)})
        for m in marks:
            to = next((x for x in marks if x >= m + substring.SPAN), None)
            if to is not None:
                out.append((m, to + 2, False))
    for gap in (0, 1):
        cuts = [0, *(i for i in range(1, n) if lines[i] - lines[i - 1] > gap), n]
        out += [(a, b, True) for a, b in zip(cuts, cuts[1:]) if b - a >= substring.MIN_UNIT]
    return words, sorted(set(out))


def plain_substrings(rows):
    """What stays of each row's words, by comparing the words of units themselves."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = {}, {}
    for i in order:
        doc = (rows[i][0], None if rows[i][0] is not None else i)
        words, found = plain_units(rows[i][1])
        for a, b, line in found:
            seen.setdefault((line, tuple(words[a:b])), doc)
    for i in order:
        doc = (rows[i][0], None if rows[i][0] is not None else i)
        words, found = plain_units(rows[i][1])
        mine, gone, cover = set(), set(), []
        for a, b, line in sorted(found):
            key = (line, tuple(words[a:b]))
            if seen[key] != doc or key in mine:
                (gone.update(range(a, b)) if line else cover.append((a, b)))
            mine.add(key)
        at = 0
        while at < len(cover):
            a, b = cover[at]
            while at + 1 < len(cover) and cover[at + 1][0] <= b:
                at += 1
                b = max(b, cover[at][1])
            if b - a >= substring.MIN_RUN:
                gone.update(range(a, b))
            at += 1
        out[i] = [w for k, w in enumerate(words) if k not in gone]
    return out


def test_substring_dedup_against_plain(spark):
    rng = random.Random(21)
    pick = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    p, line, para = pick(70), pick(26), f"{pick(10)}\n{pick(9)}\n{pick(8)}"
    rows = [(i, f"{pick(rng.randrange(40))} {p if i % 3 else ''} {pick(rng.randrange(30))}\n{line if i % 4 else pick(5)}\n\n{para if i % 5 else pick(3)}\n\n{pick(20)}") for i in range(30)]
    rows += [(None, f"{p} {pick(30)}"), (None, f"x {p}"), (None, p.upper()), (None, None), (4, p), (7, f"{pick(3)}\n{line}\n{pick(3)}\n{line}"), (90, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place int").coalesce(1)
    got = {r.place: [ascii_lower(w) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text)] for r in substring.dedup_substrings(df).collect()}
    assert got == plain_substrings(rows)


def test_lines_and_paragraphs_go_by_themselves():
    rng = random.Random(22)
    pick = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    line, para = pick(30), f"{pick(9)}\n{pick(9)}\n{pick(9)}"
    seen = substring.units(f"{line}\n\n{para}", False)[0]
    a, b = pick(20), pick(20)
    kept, starts, stops = substring.cut(f"{a}\n{line.upper()}\n{b}\n\n{para}\n\n{b[:20]}", seen, False)
    assert kept == f"{a}\n\n{b}\n\n\n\n{b[:20]}" and len(starts) == 2
    # inside a longer line only pieces find them
    assert substring.cut(f"{a} {line} {b}", seen, False)[0] == f"{a} {line} {b}"


def test_null_ids_are_documents_of_their_own(spark):
    rng = random.Random(23)
    p = " ".join(rng.choice(WORDS) for _ in range(80))
    df = spark.createDataFrame([(None, p)] * 50 + [(None, "other words")], "doc_id long, text string")
    kept = [r.text for r in substring.dedup_substrings(df).collect()]
    assert kept.count(p) == 1 and "other words" in kept and max(len(t.split()) for t in kept if t != p) < 20


def test_substring_columns(spark):
    df = spark.createDataFrame([(1, "a", "x", 3)], "doc_id long, text string, removed string, late int")
    out = substring.dedup_substrings(df)
    assert out.columns == ["doc_id", "text", "late", "removed", "n_removed"] and out.count() == 1
    assert substring.dedup_substrings(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["Á" * 5, "a b " * 40, "\n\n", "x" * 70_000 + " y"])
def test_units_of_odd_texts(text):
    kept, starts, stops = substring.cut(text, np.zeros(0, np.uint64))
    assert len(starts) == len(stops) and kept is not None


@pytest.mark.parametrize("links", [5, 10, 40])
def test_html_furniture_inside_an_article_does_not_end_it(links):
    menu = "<ul>" + "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(links)) + "</ul>"
    parts = [f"<nav>{menu}</nav>", f"<aside>{menu}</aside>", f'<div class="advert">{menu}</div>', f'<form action="/go">{menu}<input name="q"><button>Send</button></form>', f'<div class="share">{menu}<script>track("a < b");</script></div>']
    table = html_text.fit(Counter(), Counter())
    learned = fitted(labelled())
    for part in parts:
        page = f"<html><body>{part}<article><h1>A short title</h1>{part}<p>{'middle words stand here ' * 30}</p>{part}<p>The last paragraph.</p></article>{part}</body></html>"
        for w in (table, learned):
            assert html_text.extract(page, w).split("\n\n") == ["A short title", ("middle words stand here " * 30).strip(), "The last paragraph."], part[:20]


STORY = [f"Sentence {k} of the story goes on with plain words, one after another." for k in range(20)]
BODY = "<h1>The story</h1>" + "".join(f"<p>{x}</p>" for x in STORY)
NAV = "<nav><ul>" + "".join(f'<li><a href="/{k}">Menu {k}</a></li>' for k in range(8)) + "</ul></nav>"
REPLIES = '<section class="comments">' + "<p>Nice words of a reader, thanks a lot for them.</p>" * 5 + "</section>"
TEMPLATES = {
    "form": f"<html><body>{NAV}<form action='/post'><article>{BODY}</article></form></body></html>",
    "search": f'<div id="search-page"><main>{BODY}</main></div>',
    "sidebar": f'<div class="layout-sidebar-right">{NAV}<article>{BODY}</article><aside><p>Beside the text.</p></aside></div>',
    "navbar": f'<div class="navbar-layout"><div><article>{BODY}</article></div></div>',
    "frame without labels": f'<body>{NAV}<form id="search-form"><div class="layout-sidebar-left">{BODY}</div></form><footer>c me</footer></body>',
    "advert outside": f'<body><div class="post-body">{BODY.replace("<p>Sentence 9", NAV + chr(60) + "div class=ad>BUYNOW</div><p>Sentence 9")}</div></body>',
    "adverts in body": f'<body>{BODY.replace("<p>Sentence 4", "<div class=advert><p>Buy this</p></div><p>Sentence 4")}{REPLIES}</body>',
    "social policy": f'<body><article class="post social-policy">{BODY}</article>{REPLIES}</body>',
    "comments open": f'<body>{NAV}<article class="post has-comments comments-open">{BODY}{REPLIES}</article></body>',
    "page header": f'<body>{NAV}<div class="page-header"><h1>The story</h1></div>{BODY.replace("<h1>The story</h1>", "")}</body>',
    "main with parts": f'<main class="content">{NAV}<div class="notice">We set cookies.</div><article class="comment-on-law">{BODY}</article>{REPLIES}<aside>Related</aside></main>',
    "quotes": f"<body><a href=x\">{NAV}</a><article title='it\"s'>{BODY}</article><p class=\"y>",
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_html_templates(name):
    """Whole article, nothing else, on pages of other templates than the learned ones."""
    for w in (html_text.fit(Counter(), Counter()), fitted(labelled())):
        assert html_text.extract(TEMPLATES[name], w).split("\n\n") == ["The story", *STORY]


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a '\">", '<a =">" ', "<!x ", "<script></script ", "</a", "<!--", '<a "> "', "<p class='", "<"])
def test_html_unclosed_tags_are_linear(unit):
    import time

    w = html_text.fit(Counter(), Counter())
    start = time.perf_counter()
    for end in ("", ">", '">'):
        html_text.extract(unit * (1_000_000 // len(unit)) + end, w)
    assert time.perf_counter() - start < 15
    # what no bracket ends is text
    assert html_text.extract("<p>plain words and <a two three", w) == "plain words and <a two three"
