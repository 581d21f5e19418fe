import random
import re

import numpy as np
import pytest

from strandwise.llm import decontamination as dec


def plain(docs, items, width=10):
    """Every window of every item at every place of every text."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = cut(text)
        for i in range(len(w) - min(width, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + min(width, len(w))]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, own = cut(text), set(), set()
        for at in range(len(w)):
            for k in range(1, width + 1):
                if at + k <= len(w) and tuple(w[at : at + k]) in windows:
                    hit |= set(range(at, at + k))
                    own |= windows[tuple(w[at : at + k])]
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in own if x is not None))))
    return sorted(out, key=repr)


def made(seed=3):
    r = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "él", "ÑU", "42", "x", "delta"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(k, text(r.choice([2, 9, 10, 14, 30]))) for k in range(12)] + [(3, text(12)), (None, text(11)), (90, None), (91, ""), (92, "?!"), (93, "unmistakable")]
    docs = [(k, text(r.randrange(60)) + (items[k % 12][1] if k % 3 == 0 else "") + text(4)) for k in range(30)]
    docs += [(7, docs[7][1]), (None, items[0][1]), (40, None), (41, ""), (42, "a " * 30000 + items[4][1] + " b" * 30000), (43, "An UNMISTAKABLE word")]
    return docs, items


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in df.collect()), key=repr)


def test_against_plain_python(spark):
    docs, items = made()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert result(dec.find_leaks(d, b)) == want
    # the join of large benchmarks gives the same rows
    assert result(dec.find_leaks(d, b, most=0)) == want
    assert any(h for _, _, h, _ in want) and any(not h and n for _, n, h, _ in want)


def test_equal_hashes_are_verified(monkeypatch):
    docs, items = made(5)
    monkeypatch.setattr(dec, "window_hashes", lambda x, at, k: np.full(len(at), 7, np.uint64))
    found = dec.WindowSet([(None if i is None else str(i), (t or "").encode()) for i, t in items], 10)
    got = []
    for i, t in docs:
        n, spans, own = found.scan((t or "").encode())
        got.append((i, n, int(dec.covered(n, spans).sum()), tuple(own)))
    assert sorted(got, key=repr) == plain(docs, items)


@pytest.mark.parametrize("most", [dec.MAX_BYTES, 0])
def test_spans_and_documents_go(spark, most):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Énd before. {item.upper()}! After it.", 5), (2, "clean text stays", 6), (3, None, 7), (4, item, 8)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string, n_words long"), spark.createDataFrame([(1, item)], "item_id long, text string")
    spans = {r.doc_id: [(s["first"], s["last"]) for s in r.spans] for r in dec.find_leaks(d, b, most=most).collect()}
    assert spans[1] == [(12, 12 + len(item))] and spans[2] == [] and spans[3] == []
    out = {r.doc_id: (r.text, r.n_words) for r in dec.decontaminate(d, b, most=most).collect()}
    assert out == {1: ("Énd before. ! After it.", 5), 2: ("clean text stays", 6), 3: (None, 7), 4: ("", 8)}
    out = dec.decontaminate(d, b, most_share=0.9, most=most)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in dec.decontaminate(d, b, "documents", most=most).collect()) == [2, 3]


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    for most in (0, dec.MAX_BYTES):
        assert result(dec.find_leaks(d, b, most=most)) == [(1, 2, 0, ())]
        assert dec.find_leaks(d.limit(0), d.select(d.doc_id.alias("item_id"), "text"), most=most).count() == 0


def test_texts_are_cut_between_words():
    body = ("word,ünder " * 300_000).encode()
    parts = [p for _, p in dec.pieces(body)]
    assert len(parts) > 2 and b"".join(parts) == body and sum(len(dec.words(p)) for p in parts) == 600_000
