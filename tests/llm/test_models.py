"""Language model, near-duplicates, components, top-k and the pipeline against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strandwise.llm import gru, lm_scoring, simhash, topk
from strandwise.llm.common import Scratch
from strandwise.llm.components import components


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    dims = gru.shapes(15, 6, 3, 4, 5)
    p = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in dims.items()}
    model = gru.Model(p, np.concatenate([np.arange(12) % 3, [3, 4, 5]]), np.concatenate([np.arange(12) // 3, [-1] * 3]))
    x, y, begin, doc = next(iter(gru.Windows([rng.integers(0, 15, n) for n in (9, 4, 5)], 2, 9, 0)))
    h = np.zeros((5, 2), np.float32)
    grads, _, count, _ = model.gradients(x, y, begin, doc >= 0, h)
    for k in p:
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in p[k].shape)
            old, losses = p[k][i], []
            for e in (0.01, 0.0, -0.01):
                p[k][i] = old + e
                losses.append(model.gradients(x, y, begin, doc >= 0, h)[1])
            p[k][i] = old
            # the exponential has corners: the slope lies between those to either side
            right, left = ((losses[j] - losses[j + 1]) / 0.01 / count for j in (0, 1))
            assert min(left, right) - 4e-4 < grads[k][i] < max(left, right) + 4e-4


def test_exponential():
    x = np.linspace(-60, 60, 100_001).astype(np.float32)
    e = gru._exp(x.copy()).astype(float)
    assert (np.diff(e) >= 0).all() and (e > 0).all()
    assert 0.999 < (e / np.exp(x.astype(float))).min() and (e / np.exp(x.astype(float))).max() < 1.063
    slope = np.diff(e) / np.diff(x.astype(float))
    given = gru._slope(gru._exp(x.copy())).astype(float)[:-1]
    assert np.mean(abs(slope / given - 1) < 0.01) > 0.97


def coder_of(counted, total=None):
    return lm_scoring.Coder(pa.array([w for w, _ in counted], pa.string()), np.array([c for _, c in counted]), total)


def test_state_is_carried_across_windows():
    rng = np.random.default_rng(1)
    coder = coder_of([("a", 9), ("", 3), ("bb", 2)])
    model = gru.Model(gru.start(coder.dims), coder.out_class, coder.out_slot)
    texts = [rng.integers(0, 3, n) for n in (50, 1, 7, 33, 90)]
    want = model.score(texts, 5, 1000, 0)
    for width, steps in ((1, 7), (3, 16), (256, 1)):
        assert np.allclose(model.score(texts, width, steps, 0), want, atol=1e-3)


def test_outputs_are_probabilities():
    coder = coder_of([(w, 9 - i) for i, w in enumerate("abcde")] + [("", 1)])
    model = gru.Model(gru.start(coder.dims), coder.out_class, coder.out_slot)
    ids = np.arange(len(coder.out_class))
    logp, _ = model.output(np.ones((len(ids), lm_scoring.HIDDEN), np.float32), ids)
    assert abs(np.exp(logp.astype(np.float64)).sum() - 1) < 1e-3


def plain_score(p, coder, ids):
    """The same model in plain loops over one text, in double precision."""
    soft = lambda v: v / (1 + abs(v))

    def bend(v):
        """Between powers of two linear, equal to e^v at them."""
        t = v / math.log(2)
        return 2.0 ** math.floor(t) * (1 + t - math.floor(t))

    q = {k: v.astype(float) for k, v in p.items()}
    n, h, x, out = q["U"].shape[0], np.zeros(q["U"].shape[0]), coder.first, 0.0
    for y in ids:
        g, u = q["E"][x] + q["b"], h @ q["U"]
        z = [(1 + soft(g[i] + u[i])) / 2 for i in range(n)]
        r = [(1 + soft(g[n + i] + u[n + i])) / 2 for i in range(n)]
        c = [soft(g[2 * n + i] + r[i] * (u[2 * n + i] + q["bn"][i])) for i in range(n)]
        h = np.array([c[i] + z[i] * (h[i] - c[i]) for i in range(n)])
        k, slot = coder.out_class[y], coder.out_slot[y]
        e = [bend(v) for v in h @ q["C"] + q["cb"]]
        out += math.log(e[k] / sum(e))
        if slot >= 0:
            e = [bend(v) for v in h @ q["O"][k] + q["ob"][k]]
            out += math.log(e[slot] / sum(e))
        x = y
    return out


def test_scores_against_plain_loops():
    rng = np.random.default_rng(4)
    coder = coder_of([("a", 9), ("", 3), ("bb", 2)])
    p = {k: rng.normal(0, 0.4, s).astype(np.float32) for k, s in coder.dims.items()}
    texts = [rng.integers(0, len(coder.out_class), n) for n in (1, 40, 7, 120)]
    got = gru.Model(p, coder.out_class, coder.out_slot).score(texts, 3, 16, coder.first)
    assert np.allclose(got, [plain_score(p, coder, t) for t in texts], rtol=2e-4, atol=2e-3)


def test_a_long_text_among_short_ones_takes_little_memory():
    import tracemalloc

    texts = [np.zeros(1_000_000, np.int32)] + [np.zeros(20, np.int32)] * 511
    tracemalloc.start()
    seen = sum(int((doc >= 0).sum()) for _, _, _, doc in gru.Windows(texts, 512, 16, 0))
    assert seen == 1_000_000 + 511 * 20 and tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()


def test_words_are_split_as_the_contract_says():
    texts = [None, "", "  A b\x0bC\x0cÉ\x1cd ", "\n", "x" * 5, "\u00a0y Z\r\n"]
    flat, ends = lm_scoring.split(pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert flat.to_pylist() == [w.decode() for t in want for w in t] and ends.tolist() == np.cumsum([len(t) for t in want]).tolist()
    assert lm_scoring.split(pa.array(texts)[1:4])[1].tolist() == [0, 4, 4]


def test_neural_words_follow_from_the_counts():
    common = [(f"w{i}", 3000 - i) for i in range(3000)]
    total = sum(c for _, c in common)
    coder = coder_of(common, total)
    assert sum(c for _, c in common[: coder.own]) >= lm_scoring.SHARE * total and coder.own > 512
    assert lm_scoring.HIDDEN >= 32 and coder.heads >= 32 and coder.heads * coder.width >= coder.own
    assert coder_of(common, 2 * total).own == 3000 and coder_of(common[:600], 10**9).own == 600
    # a word with an id of its own, whatever the rank
    assert len(set(coder.id[: coder.own])) == coder.own and coder.id[coder.own : 3000].min() >= coder.spelled


def test_training_goes_through_whole_texts():
    """One beginning a text, every token once, each after its predecessor, however long the text."""
    texts = [np.arange(n, dtype=np.int32) + 1 for n in (5000, 40, 700)]
    seen = Counter()
    begins = 0
    for x, y, begin, doc in gru.Windows(texts, 8, 16, 0, lm_scoring.LONGEST):
        begins += begin.sum()
        assert (x == y - 1)[doc >= 0].all() and len(x) <= lm_scoring.LONGEST
        seen.update(zip(doc[doc >= 0].tolist(), y[doc >= 0].tolist(), strict=True))
    assert begins == 3 and len(seen) == 5740 and set(seen.values()) == {1}


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b""]


def held(d):
    return zlib.crc32(str(d).encode()) % 7 == 2


def test_lm_scores_base_and_gain(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice([["the", "of", "and", "house"], ["der", "und", "die", "haus"]][i % 2]) for _ in range(60))) for i in range(900)]
    rows += [(5000, None), (5001, ""), (5002, "Unseen wörd zzz"), (5002, "Unseen wörd zzz"), (5003, "the " * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    got = lm_scoring.lm_scores(df, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2).collect()
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update(tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        tokens = tokens_of(texts[r.doc_id])
        assert r.held_out == held(r.doc_id) and r.n_tokens == len(tokens) and r.train_tokens == n
        assert r.n_known == sum(counts[w] > 0 for w in tokens)
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)) < 1e-6 * len(tokens)
        assert r.score < 0
    out = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_beats_the_unigram_in_each_language(spark):
    """On held-out documents of the driver's table, all of them and those of each language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("clash"))
    got = lm_scoring.lm_scores(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2)
    by = got.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
    assert len(by) == 4 and all(r.s > r.b for r in by)


def test_lm_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm_scoring.lm_scores(df, F.lit(True)).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and r.base_score == 0
    assert lm_scoring.lm_scores(df.limit(0), F.lit(False)).count() == 0


def test_rare_words_are_joined(spark, monkeypatch):
    """With few words sent to the tasks, the joined rest gives the same scores."""
    rows = [(i, "the of " * 20 + f"rare{i % 7} odd{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cond = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    one = {r.doc_id: r.base_score for r in lm_scoring.lm_scores(df, cond).collect()}
    monkeypatch.setattr(lm_scoring, "COMMON", 20)
    two = {r.doc_id: r.base_score for r in lm_scoring.lm_scores(df, cond).collect()}
    assert all(abs(one[k] - two[k]) < 1e-6 for k in one)


def plain_fingerprint(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(points, linked):
    root = list(range(len(points)))
    for i in range(len(points)):
        for j in range(i):
            if linked(points[i], points[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprints():
    for t in ["", None, "one", "Two words", "A b C d e", "x y z " * 50, "É É É ß"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_near_duplicates_against_plain(spark):
    rng = random.Random(9)
    voc = [f"v{i}" for i in range(300)]
    base = [" ".join(rng.choice(voc) for _ in range(80)) for _ in range(12)]
    rows = [(i, base[i % 12] if i < 30 else base[i % 12].replace(base[i % 12].split()[3], "Q", 1)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "single"), (3, base[3]), (None, base[5])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    points = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(points, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert got == sorted(((i, p, least.get(r)) for (i, _), p, r in zip(rows, points, root, strict=True)), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("cell", "levels", "parts"), [(20_000, 8, 2), (60, 8, 2), (60, 0, 2), (200, 8, 4), (30, 2, 3)])
def test_tree_shards_find_every_link(spark, monkeypatch, cell, levels, parts):
    """Shards that hold all, that grow trees of their own, that are dealt in blocks, and all of these on smaller parts."""
    monkeypatch.setattr(simhash, "LEVELS", levels)
    rng = random.Random(11)
    fps = [rng.getrandbits(64) for _ in range(1500)]
    for f in fps[:150]:
        for _ in range(3):
            g = f
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                g ^= 1 << b
            fps.append(g)
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(0, int(x)) for x in fps.view(np.int64)] + [(1, int(x)) for x in fps.view(np.int64)[:50]], "tab int, fp long")
    scratch = Scratch(spark)
    links = simhash.near_links(df, scratch, parts=parts, sample=1024, shard=30 if levels else 100, cell=cell, regrow=64).filter("tab = 0").select("a", "b")
    found = {r.a % (1 << 64): r.b % (1 << 64) for r in components(links, scratch).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    group = np.arange(len(fps))
    for _ in range(len(fps)):
        new = np.where(near, group[None, :], len(fps)).min(1)
        if (new == group).all():
            break
        group = new
    # components agree as partitions
    mine = [found.get(int(f), int(f)) for f in fps]
    assert len(set(mine)) == len(set(group.tolist())) == len(set(zip(mine, group.tolist(), strict=True)))


def test_equal_parts_are_dealt_in_blocks(spark):
    """Fingerprints that agree in one part can't be split by it, however many levels grow."""
    rng = np.random.default_rng(9)
    fps = np.unique(rng.integers(0, 1 << 32, 400, np.uint64) | np.uint64(7 << 32))
    df = spark.createDataFrame([(0, int(x)) for x in fps.view(np.int64)], "tab int, fp long")
    scratch = Scratch(spark)
    got = components(simhash.near_links(df, scratch, bits=9, sample=100, shard=10, cell=50, regrow=64).select("a", "b"), scratch).count()
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 9
    root = plain_components(range(len(fps)), lambda a, b: near[a, b])
    assert got == len(fps) - len(set(root))


def test_one_link_a_fingerprint():
    """A group of thousands of near copies gives one link each, not one per pair."""
    rng = np.random.default_rng(3)
    center = np.uint64(0x0123456789ABCDEF)
    fp = np.unique(np.array([center ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (3000, 2))], np.uint64))
    a, b = simhash.local_links(fp, np.ones(len(fp), bool), np.ones(len(fp), bool), 3)
    assert len(a) < len(fp)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    out = {r.a: r.b for r in components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark)).collect()}
    assert out == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 160)}, 201: 200}


def test_topk_against_plain(spark):
    rng = np.random.default_rng(5)
    vecs = [[float(x) for x in v] for v in rng.normal(0, 1, (300, 6)).round(1)]
    rows = [(i, v, "c") for i, v in enumerate(vecs)]
    rows += [(400, None, "c"), (450, [float("nan")] * 6, "c"), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0], "c"), (402, [float("inf")] * 6, "c"), (403, vecs[0], "c"), (403, vecs[0], "c"), (500, [1.0, 2.0], "c"), (501, [], "c"), (550, [], "c"), (None, vecs[1], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block=70, query_block=3).collect())
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, v in good:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i and len(w) == len(v))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def plain_top(rows, k=5):
    out = []
    for i, v in rows:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 3e5, 3e7, 1e30])
def test_topk_of_large_values(spark, scale):
    """Above 2^53 and above 2^63 order and ties are those of the whole numbers; scores that fit no long are null."""
    rng = np.random.default_rng(8)
    vecs = [[float(np.float32(x)) for x in v] for v in rng.normal(0, scale, (120, 3))]
    vecs[7], vecs[9] = vecs[3], [vecs[3][0], vecs[3][1], math.nextafter(vecs[3][2], math.inf)]
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")
    got = sorted(topk.top_k(df, F.col("vec_id") % 50 == 0, block=40, per_center=20).collect(), key=lambda r: r[:2])
    want = plain_top([(i, [math.floor(256 * x) for x in v]) for i, v in enumerate(vecs)])
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [w[:3] for w in want]
    assert [r.score for r in got] == [w[3] if -(2**63) <= w[3] < 2**63 else None for w in want]


def test_topk_asks_few_blocks_of_clustered_vectors(spark):
    rng = np.random.default_rng(12)
    centers = rng.normal(0, 40, (30, 8))
    vecs = np.repeat(centers, 60, 0) + rng.normal(0, 0.2, (1800, 8))
    vecs[100:700] = vecs[0]  # a third of all rows is one vector
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block=90, per_center=60).collect())
    assert got == plain_top([(i, [math.floor(256 * float(x)) for x in v]) for i, v in enumerate(vecs)])


def test_sort_keys_sort_as_numbers():
    n = [0, 1, -1, 9, 10, -9, -10, 99, 2**53, 2**53 + 1, -(2**63), 10**40, -(10**40), 5 * 10**39]
    assert sorted(n, key=topk.sort_key) == sorted(n)


def test_bounds_leave_out_products():
    """Clustered vectors: most products are never computed."""
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 2000, (40, 8))
    x = np.floor(np.repeat(centers, 100, 0) + rng.normal(0, 20, (4000, 8)))
    ids = np.arange(len(x))
    q, i, s, work = topk.best(x[:20], ids[:20], x, ids, topk.choose_pivots(x[::10], 16), 5)
    exact = x[:20] @ x.T
    for k in range(20):
        exact[k, k] = -np.inf
        assert sorted(np.array(s)[np.array(q) == k]) == sorted(np.sort(exact[k])[-5:])
    assert work < 20 * len(x) / 3
