import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from strandwise.llm import divergence as dv


def plain(docs, min_docs=3, scale=10**9, top=200):
    """The contract's words, with Python's integers."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    cut = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))) for lang, source, text in docs]
    held, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in cut:
        held[lang].update(set(w))
        n[lang, source].update(w)
    out = []
    for lang in {c[0] for c in cut}:
        terms = [t for t, k in held[lang].items() if k >= min_docs]
        sources = sorted(s for a, s in n if a == lang)
        count = {s: Counter({t: n[lang, s][t] for t in terms}) for s in sources}
        all_of = Counter()
        for s in sources:
            all_of.update(count[s])
        p = lambda c: {t: 1 + scale * (c[t] + 1) // (sum(c.values()) + len(terms)) for t in terms}
        own, q = {s: p(count[s]) for s in sources}, p(all_of)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = sorted(((-sum(f(own[s][t], own[o][t]) for t in terms), o.encode()) for o in sources if o != s))
            best = sorted((-f(own[s][t], q[t]), t.encode()) for t in terms if count[s][t] and own[s][t] > q[t])[:top]
            for part, rows in (("pair", pairs), ("term", best)):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(rows)]
    return sorted(out)


def made(seed=1):
    r = random.Random(seed)
    vocab = ["the", "The", "Straße", "über", "naïve", "日本", "x", "don", "zebra", "q" * 40, "éa"]
    text = lambda k: "".join(r.choice(vocab[: 4 + k % 8]) + r.choice([" ", "1", "'", "\n", "--"]) for _ in range(r.randrange(40)))
    docs = [(r.choice(["en", "de", None]), r.choice(["a", "b", "é", None, "z"]), text(k)) for k in range(80)]
    return docs + [("en", "empty", ""), ("en", "none", None), ("one", "a", "lone words lone"), ("two", "a", "only"), ("two", "b", "?"), docs[0], docs[0]]


def test_against_plain_python(spark):
    docs = made()
    df = spark.createDataFrame([(*d, 7, "clash") for d in docs], "lang string, source string, text string, n long, term string")
    assert sorted(tuple(r) for r in dv.divergences(df).collect()) == plain(docs)
    assert sorted(tuple(r) for r in dv.divergences(df, top=2, min_docs=5, scale=1000).collect()) == plain(docs, 5, 1000, 2)
    assert dv.divergences(df.limit(0)).collect() == []


def test_slices_of_one_hash_are_told_apart():
    text = np.frombuffer(b"ab cd ab efg cd hij efg ab", np.uint8)
    starts, ends = dv.slices(text)
    weak = lambda s: len(s)
    numbers, first = dv.grouped(text, starts, ends, weak)
    words = [text.tobytes()[a:b] for a, b in zip(starts, ends, strict=True)]
    assert [words[first[k]] for k in numbers] == words and len(first) == len(set(words))


def test_long_text_is_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(dv, "BUFFER", 50)
    body = ("Straße words and " * 40 + "w" * 10_000 + " über").encode()
    terms, n = dv._one_long(body)
    assert dict(zip(terms, n.tolist(), strict=True)) == {"straße".encode(): 40, b"words": 40, b"and": 40, b"w" * 10_000: 1, "über".encode(): 1}


def test_blocks_of_sources_sum_to_the_whole():
    r = random.Random(4)
    p0 = {s: r.randrange(1, 50) for s in range(7)}
    cells = {(s, t): r.randrange(1, 1000) for s in range(7) for t in range(20) if r.random() < 0.3 and s != 5}
    f = lambda a, b: (a - b) ** 2 // b
    got = {}
    for a in range(4):
        for b in range(4):
            rows = [(s, f"s{s}", None, p0[s]) for s in range(7) if s // 2 in (a, b)] + [(s, f"s{s}", str(t).encode(), p) for (s, t), p in cells.items() if s // 2 in (a, b)]
            r.shuffle(rows)
            cols = list(zip(*rows, strict=True))
            t = pa.table({"sid": pa.array(cols[0], pa.int64()), "source": cols[1], "term": pa.array(cols[2], pa.binary()), "p": pa.array(cols[3], pa.int64())})
            out = dv.pair_sums(t, a, b, 2)
            for row in zip(*out.values(), strict=True):
                got[row[:2]] = row[2:]
    want = {}
    for a in range(7):
        for b in range(7):
            if a != b:
                terms = {t for s, t in cells if s in (a, b)}
                want[f"s{a}", f"s{b}"] = (f(p0[a], p0[b]), sum(f(cells.get((a, t), p0[a]), cells.get((b, t), p0[b])) for t in terms), len(terms))
    assert got == want


def test_counts_beyond_a_long_product(spark):
    n, total = 2**61, 2**62 + 12345
    r = spark.createDataFrame([(n, total)], "n long, total long").select(dv.share(spark_col("n"), spark_col("total"), dv.SCALE).alias("p")).first()
    assert r.p == 1 + dv.SCALE * (n + 1) // total


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)
