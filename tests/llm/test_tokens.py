"""Token counts, BPE and packing against brute force and the tokenizer libraries."""

import hashlib
import itertools
import math
import random
from collections import Counter

import pytest

from strandwise.llm import bpe, packing, token_counts
from strandwise.llm.quality import n_words


def plain_unigram(text, scores, unknown):
    """Best score over all splits, by plain dynamic programming over whole words."""
    best = [(0.0, 0)] + [(float("-inf"), 0)] * len(text)
    for to in range(1, len(text) + 1):
        for a in range(to):
            piece = text[a:to]
            if piece in scores:
                c = (best[a][0] + scores[piece], best[a][1] + 1)
            elif to - a == 1:
                c = (best[a][0] + unknown, best[a][1] + len(piece.encode()))
            else:
                continue
            if c[0] > best[to][0]:
                best[to] = c
    return best[-1]


def test_trie_against_plain():
    rng = random.Random(1)
    scores = {p: -rng.random() * 5 for p in ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", "bb", "é"]}
    trie = token_counts.Trie(scores)
    for _ in range(3):
        for w in map("".join, itertools.product("abéx", repeat=4)):
            assert trie.tokens(w.encode()) == plain_unigram("▁" + w, scores, trie.unknown)[1]
        trie.clear()


def test_long_words_leave_the_trie(monkeypatch):
    scores = {"▁": -1.0, "a": -1.0, "ab": -1.5, "b": -1.0, "▁a": -1.2}
    short = token_counts.Trie(scores).tokens(b"ab" * 40)
    monkeypatch.setattr(token_counts, "LONG", 10)
    assert token_counts.Trie(scores).tokens(b"ab" * 40) == short


def test_small_tries_change_nothing(monkeypatch):
    scores = token_counts.vocabulary(token_counts.default_model())
    words = [w.encode() for w in ("hello", "world", "hellos", "naïve", "日本", "worlds") * 3]
    want = [token_counts.Trie(scores).tokens(w) for w in words]
    monkeypatch.setattr(token_counts, "MAX_NODES", 3)
    trie = token_counts.Trie(scores)
    assert [trie.tokens(w) for w in words] == want


def test_scores_are_log_probabilities():
    scores = token_counts.vocabulary(token_counts.default_model())
    assert abs(math.fsum(math.exp(s) for s in scores.values()) - 1) < 1e-9 and min(scores.values()) > -20
    assert "▁" in scores and "▁▁" not in scores


def test_frequent_words_are_one_token():
    trie = token_counts.Trie(token_counts.vocabulary(token_counts.default_model()))
    assert {w: trie.tokens(w.encode()) for w in ("the", "of", "quick", "international", "understanding")} == {w: 1 for w in ("the", "of", "quick", "international", "understanding")}


def test_tokens_a_word_are_near_those_of_the_encoder():
    """Over the words of a table of documents, not more than the merges give, and at most a tenth fewer."""
    import pyarrow.parquet as pq
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    trie = token_counts.Trie(token_counts.vocabulary(token_counts.default_model()))
    words = [w for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()[:120] for w in (t or "").encode().split()]
    known = {w: len(sp.encode(w.decode())) for w in set(words)}
    mine, theirs = sum(trie.tokens(w) for w in words), sum(known[w] for w in words)
    assert 0.9 * theirs <= mine <= 1.02 * theirs


def test_real_vocabulary_against_all_splits():
    """The split with the largest product of probabilities, of all splits there are; equal sums take the longest last piece."""
    scores = token_counts.vocabulary(token_counts.default_model())
    trie = token_counts.Trie(scores)
    for w in ("unbelievable", "haus", "straße", "x1y2", "日本x", "naïve", "q", "thethe"):
        count, score = trie.scored(w.encode())
        best = max(sum(scores.get(p, trie.unknown if len(p) == 1 else float("-inf")) for p in split) for split in every_split("▁" + w))
        assert abs(score - best) < 1e-9 and count == plain_unigram("▁" + w, scores, trie.unknown)[1]


def every_split(text):
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        yield [text[a:b] for a, b in itertools.pairwise(at)]


def test_ties_take_the_longest_last_piece():
    trie = token_counts.Trie({"▁": -1.0, "▁a": -1.0, "a": -1.0, "b": -1.0, "ab": -1.0})
    assert trie.scored(b"ab") == (2, -2.0) and trie.scored(b"a") == (1, -1.0)


def test_token_counts_rows(spark):
    rows = [(1, "hello hello world"), (1, "hello hello world"), (2, None), (3, ""), (None, " \n x y ")]
    got = sorted(((r.doc_id, r.n_pretokens, r.n_distinct, r.n_tokens) for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    trie = token_counts.Trie(token_counts.vocabulary(token_counts.default_model()))
    h, w = trie.tokens(b"hello"), trie.tokens(b"world")
    assert got[0][1:] == (3, 2, 2 * h + w) and got[1] == got[0] and got[2] == (2, 0, 0, 0) and got[3] == (3, 0, 0, 0) and got[4][:3] == (None, 1, 1)


ODD = ["", "a", "it's 12ab cd's  x\n\n y" * 20, "word " * 40_000, "ab12" * 30_000, "   " * 500 + "é", "日本語テキスト" * 3000, "'s't 's" * 99, "<|endoftext|> x"]


@pytest.mark.parametrize("size", [7, 64, 1 << 16])
def test_parts_encode_as_the_whole(size):
    enc = bpe.encoding(*bpe.default_ranks())
    for text in ODD:
        cut = list(bpe.parts(text, size))
        assert "".join(cut) == text
        assert [t for p in cut for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_bpe_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, None), (None, "x y")]
    out = bpe.decode_ids(bpe.encode_texts(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(hashlib.sha256(bytes(r.decoded)).hexdigest() for r in out) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert bpe.encode_texts(spark.createDataFrame([], "doc_id long, text string, ids int")).columns == ["doc_id", "ids"]
    # bytes that are no UTF-8 by themselves decode as they are
    enc = bpe.encoding(*bpe.default_ranks())
    lone = next(i for i in range(256) if len(enc.decode_bytes([i])) == 1 and enc.decode_bytes([i])[0] > 127)
    raw = bpe.decode_ids(spark.createDataFrame([(1, [lone])], "doc_id long, ids array<int>")).first().decoded
    assert bytes(raw) == enc.decode_bytes([lone])


def plain_pack(lengths, opening, sizes, cost):
    """One plan by the same rule, with plain searches through all bins and all pieces still to come."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins, at = [], {}
    for place, i in enumerate(order):
        n = lengths[i]
        fit = [(room, k) for k, (room, _) in enumerate(bins) if room >= n]
        if fit:
            k = min(fit)[1]
        else:
            offers = []
            for s in opening:
                if s >= n:
                    used = n
                    for j in order[place + 1 :]:
                        if used + lengths[j] <= s:
                            used += lengths[j]
                    offers.append((cost(min(z for z in sizes if z >= used)) / used, s))
            bins.append((min(offers)[1], 0))
            k = len(bins) - 1
        at[i] = (k, bins[k][1])
        bins[k] = (bins[k][0] - n, bins[k][1] + n)
    final = [min(z for z in sizes if z >= u) for _, u in bins]
    return sum(map(cost, final)), [(*at[i], final[at[i][0]]) for i in range(len(lengths))]


def plain_optimum(lengths, sizes, cost):
    """The least cost of all partitions of the pieces into bins."""
    if not lengths:
        return 0.0
    first, rest, best = lengths[0], lengths[1:], float("inf")
    for mask in range(1 << len(rest)):
        used = first + sum(n for k, n in enumerate(rest) if mask >> k & 1)
        if used <= max(sizes):
            best = min(best, cost(min(z for z in sizes if z >= used)) + plain_optimum([n for k, n in enumerate(rest) if not mask >> k & 1], sizes, cost))
    return best


def total_cost(packed, cost):
    return sum(cost(z) for z in {b: z for b, _, z in packed}.values())


MIXES = (((8, 16, 32), 2, 64), ((10,), 0, 10**9), ((4, 100), 7, 200))


def test_pack_against_plain():
    rng = random.Random(4)
    for sizes, fixed, attention in MIXES:
        cost = lambda z: packing.cost_of(z, fixed, attention)  # noqa: B023, E731
        for _ in range(40):
            lengths = [rng.randrange(1, max(sizes) + 1) for _ in range(rng.randrange(1, 50))]
            got = packing.pack(lengths, sizes, fixed, attention)
            plans = [plain_pack(lengths, o, sizes, cost) for r in range(1, len(sizes) + 1) for o in itertools.combinations(sizes, r) if max(o) >= max(lengths)]
            assert any(got == p[1] for p in plans) and abs(total_cost(got, cost) - min(p[0] for p in plans)) < 1e-6
            used = {}
            for n, (b, o, z) in sorted(zip(lengths, got, strict=True), key=lambda x: x[1]):
                assert used.get(b, 0) == o and o + n <= z
                used[b] = o + n


def test_pack_against_the_optimum():
    rng = random.Random(8)
    ratios = []
    for sizes, fixed, attention in MIXES:
        cost = lambda z: packing.cost_of(z, fixed, attention)  # noqa: B023, E731
        for _ in range(25):
            lengths = [rng.randrange(1, max(sizes) + 1) for _ in range(rng.randrange(1, 9))]
            ratios.append(total_cost(packing.pack(lengths, sizes, fixed, attention), cost) / plain_optimum(lengths, sizes, cost))
    assert min(ratios) > 1 - 1e-9 and max(ratios) < 1.3 and sum(r < 1 + 1e-9 for r in ratios) > 0.8 * len(ratios)


def test_mixed_sizes_beat_any_single_one():
    rng = random.Random(15)
    lengths = [min(4096, max(1, int(rng.lognormvariate(5.5, 1.2)))) for _ in range(4000)]
    packed = packing.pack(lengths)
    opened = Counter({b: z for b, _, z in packed}.values())
    assert len(opened) >= 3 and min(opened.values()) > 5
    single = []
    for s in packing.SIZES:
        # pieces cut to the one size, as that size needs
        cut = [m for n in lengths for m in [s] * (n // s) + [n % s] * (n % s > 0)]
        if len(cut) == len(lengths):
            single.append(total_cost(packing.pack(cut, (s,)), packing.cost_of))
    assert single and total_cost(packed, packing.cost_of) < 0.95 * min(single)


def test_sequences_hold_every_token_once(spark):
    """Byte-level BPE ids, packed by their real counts and put together."""
    texts = [(i, f"text {i} " * (1 + 37 * i % 400)) for i in range(40)] + [(100, "a b c d " * 3000), (101, ""), (None, "no id here")]
    ids = bpe.encode_texts(spark.createDataFrame(texts, "doc_id long, text string")).cache()
    packed = packing.best_fit_packing(ids, packing.F.size("ids"), shard_rows=30)
    made = packing.sequences(packed, ids).collect()
    assert all(0 < len(r.ids) <= r.bin_size and r.bin_size in packing.SIZES for r in made)
    place = {(r.bin_id, r.bin_offset): r for r in packed.collect()}
    whole = {}
    for r in made:
        for (b, o), p in place.items():
            if b == r.bin_id:
                whole.setdefault(p.doc_id, {})[p.start] = r.ids[o : o + p.n_tokens]
    want = {r.doc_id: list(r.ids) for r in ids.collect() if r.ids}
    assert {d: [x for k in sorted(v) for x in v[k]] for d, v in whole.items()} == want
    assert sum(len(r.ids) for r in made) == sum(map(len, want.values()))


def test_hot_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 7)
    df = spark.createDataFrame([(None, 3)] * 50 + [(1, 4096 * 30 + 5), (2, 9)], "doc_id long, n int")
    out = packing.best_fit_packing(df, df.n).collect()
    assert len(out) == 50 + 31 + 1 and sum(r.n_tokens for r in out) == 150 + 4096 * 30 + 5 + 9
    assert sorted(r.copy for r in out if r.doc_id is None) == list(range(50)) and sorted(r.start for r in out if r.doc_id == 1) == [4096 * k for k in range(31)]


def test_packing_ids_and_columns(spark):
    df = spark.createDataFrame([("b", 5, 1, 2), ("a", 5, 1, 2), (None, None, 1, 2)], "doc_id string, n int, shard int, copy int")
    out = packing.best_fit_packing(df, df.n).collect()
    assert sorted((r.doc_id, r.bin_offset) for r in out) == [("a", 0), ("b", 5)]


def test_packing_rows(spark):
    rows = [(1, 5000), (2, 10), (2, 10), (2, 10), (3, None), (4, 0), (None, 77), (5, 4096), (6, 1)] + [(9, 3)] * 500
    df = spark.createDataFrame(rows, "doc_id long, n int")
    out = packing.best_fit_packing(df, df.n, shard_rows=100).collect()
    assert sum(r.n_tokens for r in out) == sum(n or 0 for _, n in rows)
    assert len({(r.doc_id, r.copy, r.piece) for r in out}) == len(out) and {r.doc_id for r in out} == {1, 2, None, 5, 6, 9}
    bins = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append(r)
    for rs in bins.values():
        rs.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in rs] == [0, *itertools.accumulate(r.n_tokens for r in rs)][:-1]
        used = sum(r.n_tokens for r in rs)
        assert all(r.bin_used == used and r.bin_size == min(s for s in packing.SIZES if s >= used) for r in rs)
    again = packing.best_fit_packing(df.repartition(5), df.n, shard_rows=100).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert packing.best_fit_packing(df.limit(0), df.n).count() == 0


def test_words_of_a_column(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("",), (" \n",), ("a b\x0bc",), ("é",)], "text string")
    assert [r[0] for r in df.select(n_words(F.col("text"))).collect()] == [0, 0, 3, 1]
