"""The pipeline against plain Python on a small corpus, and its guard."""

import random

import corpus_pipeline
from strandwise.llm import packing, quality

from .test_cleaning import WORDS, plain_line_dedup, plain_quality, plain_substrings


def corpus():
    rng = random.Random(12)
    pick = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared, passage = "A line that many documents share, word for word.", pick(60)
    docs = []
    for i in range(40):
        t = f"{pick(40)}\n{shared}\n{pick(30)}" if i % 3 else f"{pick(25)} {passage} {pick(25)}"
        docs.append((i, t))
    docs += [(50, docs[4][1]), (51, docs[4][1].replace(docs[4][1].split()[2], "other", 1)), (52, pick(5)), (53, "junk*** " * 40), (54, None), (55, f"{pick(50)}\nhome | news | about | more"), (56, pick(9000))]
    return docs


def plain(docs):
    def clean(t):
        lines = (t or "").split("\n")
        bad = [x for x in lines if sum(x.count(c) for c in quality.SYMBOLS) >= 3]
        kept = "\n".join(x for x in lines if x not in bad)
        lost = sum(len(x.split()) for x in bad)
        return kept, not plain_quality(t)[5] and 100 * lost <= quality.MAX_LOST * plain_quality(t)[0]

    docs = [(i, clean(t)[0]) for i, t in docs if clean(t)[1]]
    docs = [(i, t) for i, t, _, _ in plain_line_dedup(docs)]
    docs.sort()
    stay = []
    for i, t in docs:
        w = t.lower().split()
        grams = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        if all(len(grams & g) < 0.8 * len(grams | g) for _, _, g in stay):
            stay.append((i, t, grams))
    docs = [(i, t) for i, t, _ in stay]
    return {docs[i][0]: len(w) + 1 for i, w in plain_substrings(docs).items()}


def test_run_against_plain(spark, tmp_path):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        assert r.bin_offset + r.n_tokens <= r.bin_used <= r.bin_size and r.bin_size in packing.SIZES
    assert got == plain(docs)
    assert {52, 53, 54, 50}.isdisjoint(got) and 55 in got


def test_stages_keep_the_columns_and_bear_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, fp int, gone string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == docs.columns, name
        assert out.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "substring_dedup", "packing"]
