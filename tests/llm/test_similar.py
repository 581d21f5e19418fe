"""The near-dedup stage on pairs on either side of the similarity, on repeated and null ids, and on a group of many parts."""

import random

import pytest

import corpus_pipeline
from strandwise.llm import similar


def plain_similarity(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def changed(rng, text, n):
    words = text.split()
    for k in range(n):
        words[(k + 1) * len(words) // (n + 1)] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("cell", [2_000, 8])
def test_stage_drops_pairs_from_the_similarity_on(spark, monkeypatch, cell):
    monkeypatch.setattr(similar, "CELL", cell)
    rng = random.Random(4)
    make = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows, stay = [], set()
    for i in range(60):
        length, n = [(100, 1), (100, 2), (400, 8), (60, 1), (100, 6), (400, 40)][i % 6]
        base = make(length)
        copy = changed(rng, base, n)
        rows += [(1000 + i, copy), (i, base)]
        assert (plain_similarity(base, copy) >= 0.8) == (i % 6 < 4)
        stay |= {i} if i % 6 < 4 else {i, 1000 + i}
    big = make(400)
    rows += [(5000 + k, changed(rng, big, 1)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, None).collect()]
    assert sorted(got) == sorted([*stay, 5000])


def test_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(5)
    a, b, c = (" ".join(f"w{rng.randrange(5000)}" for _ in range(100)) for _ in range(3))
    rows = [(1, a), (2, changed(rng, a, 1)), (2, b), (None, b), (None, c), (None, c), (3, None), (4, " "), (3, "few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, df, None)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(1, a), (2, b), (None, c), (3, None), (3, "few words")], df.schema).collect()))
