"""Spliced coding sequences, the codons that edits meet and their effects, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from strandwise.functions.nt import rc
from strandwise.functions.tables import codons
from strandwise.operators import coding

SCHEMA = "doc_id string, feature_id long, strand long, segments array<struct<start0:long,end0:long>>, n long, topology string, codon_start int, table int"


def plain_order(segments, n, circular):
    s = sorted(segments)
    if not circular or len(s) < 2:
        return s
    gaps = [s[i + 1][0] - s[i][1] for i in range(len(s) - 1)] + [s[0][0] + n - s[-1][1]]
    k = (gaps.index(max(gaps)) + 1) % len(s) if max(gaps) >= 0 else 0
    return s[k:] + s[:k]


def plain_coding(seq, f):
    places = [i for a, b in plain_order(f[3], f[4], f[5] == "circular") for i in range(a, b)]
    text = "".join(seq[i] for i in places)
    if f[2] == -1:
        text, places = rc(text), places[::-1]
    skip = f[6] - 1 if f[6] in (2, 3) else 0
    return text[skip:], places, skip


def made(seed, docs=6, each=12):
    rng = random.Random(seed)
    seqs, feats = {}, []
    for d in range(docs):
        n = rng.randrange(30, 120)
        seqs[f"d{d}"] = "".join(rng.choice("ACGTN" if d == 0 else "ACGT") for _ in range(n))
        for k in range(each):
            cuts = sorted(rng.sample(range(n + 1), 2 * rng.randrange(1, 5)))
            segs = list(zip(cuts[::2], cuts[1::2]))
            rng.shuffle(segs)
            feats.append((f"d{d}", k, rng.choice([1, -1]), segs, n, "circular" if d % 2 else "linear", rng.choice([None, 0, 1, 2, 3]), rng.choice([None, 1, 2, 4, 11])))
    return seqs, feats


@pytest.mark.parametrize("block", [4, 7, 4096])
def test_coding_sequences_against_plain(spark, monkeypatch, block):
    monkeypatch.setattr(coding, "BLOCK", block)
    seqs, feats = made(block)
    feats += [("d0", 99, 1, [], len(seqs["d0"]), "linear", 1, 1), ("gone", 1, 1, [(0, 5)], 9, "circular", 1, 1), ("d1", 98, -1, [(3, 3)], len(seqs["d1"]), "circular", 2, 1)]
    docs = spark.createDataFrame(list(seqs.items()), "doc_id string, seq string")
    got = {(r.doc_id, r.feature_id): r.coding for r in coding.coding_sequences(spark.createDataFrame(feats, SCHEMA), docs).collect()}
    assert len(got) == len(feats)
    for f in feats:
        assert got[f[0], f[1]] == (plain_coding(seqs[f[0]], f)[0] if f[0] in seqs else ""), f


@pytest.mark.parametrize("block", [5, 4096])
def test_edited_codons_against_plain(spark, monkeypatch, block):
    monkeypatch.setattr(coding, "BLOCK", block)
    seqs, feats = made(40 + block)
    rng = random.Random(9)
    edits = [(d, k, a := rng.randrange(len(s)), min(len(s), a + rng.choice([0, 1, 1, 4, 20]))) for d, s in seqs.items() for k in range(5)]
    got = {(r.doc_id, r.feature_id): (r.edit_ids, r.first_codon) for r in coding.edited_codons(spark.createDataFrame(feats, SCHEMA), spark.createDataFrame(edits, "doc_id string, edit_id long, edit_start long, edit_end long")).collect()}
    want = {}
    for f in feats:
        _, places, skip = plain_coding(seqs[f[0]], f)
        ids, found = set(), []
        for d, k, a, b in edits:
            if d != f[0]:
                continue
            for s, e in f[3]:
                if a == b and s <= a <= e:
                    ids.add(k)
                    found.append(places.index(min(a, e - 1)))
                elif a < b and max(a, s) < min(b, e):
                    ids.add(k)
                    found.append(min(places.index(i) for i in range(max(a, s), min(b, e))))
        if ids:
            want[f[0], f[1]] = (sorted(ids), (min(found) - skip) // 3 + 1)
    assert got == want


def test_effects_of_known_changes(spark):
    cases = [
        ("ATGAAATAA", "ATGAAGTAA", 1, "synonymous", None), ("ATGAAATAA", "ATGACATAA", 1, "missense", 2), ("ATGAAATAA", "ATGTAATAA", 1, "nonsense", 2), ("ATGAAATAA", "ATGAAAGAA", 1, "stop_lost", 3),
        ("ATGAAATAA", "GTGAAATAA", 1, "start_lost,missense", 1), ("ATGAAATAA", "ATGGGGAAATAA", 1, "stop_lost,inframe_insertion", 2), ("ATGAAATAA", "ATGTAA", 1, "nonsense,inframe_deletion", 2), ("ATGAAATAA", "ATGAATAA", 1, "frameshift,stop_lost", 2),
        ("ATGTGAAAATAA", "ATGTGGAAATAA", 2, "synonymous", None), ("ATGTGAAAATAA", "ATGTGGAAATAA", 11, "stop_lost", 2), ("ATGAGAAAA", "ATGCGAAAA", 2, "stop_lost", 2), ("AT", "AT", 1, "synonymous", None),
        ("ATGAAATAA", None, 1, "coding_sequence_change", None), ("ATGAAATAA", "", 1, "stop_lost,start_lost,inframe_deletion", 1),
    ]
    seg = lambda x: [(0, len(x))]
    ref = [(f"c{i}", 1, 1, seg(a), len(a), "linear", 1, t) for i, (a, b, t, *_) in enumerate(cases)]
    qry = [(f"c{i}", 1, 1, seg(b), len(b), "linear", 1, t) for i, (a, b, t, *_) in enumerate(cases) if b is not None]
    docs = lambda k: spark.createDataFrame([(f"c{i}", c[k]) for i, c in enumerate(cases)], "doc_id string, seq string")
    edits = spark.createDataFrame([(f"c{i}", 1, 0, 1) for i in range(len(cases))], "doc_id string, edit_id long, edit_start long, edit_end long")
    out = coding.consequences(spark.createDataFrame(ref, SCHEMA), spark.createDataFrame(qry, SCHEMA), docs(0), docs(1), edits)
    got = {r.doc_id: r for r in out.collect()}
    for i, (a, b, t, kinds, first) in enumerate(cases):
        r, code = got[f"c{i}"], codons(t)
        assert (",".join(r.kinds), r.first_affected) == (kinds, first), (a, b, r)
        assert r.ref_protein == "".join(code[a[k : k + 3]] for k in range(0, len(a) - 2, 3)) and r.table == t
    none = edits.limit(0)
    assert coding.consequences(spark.createDataFrame(ref, SCHEMA), spark.createDataFrame(qry, SCHEMA), docs(0), docs(1), none).count() == 0
    assert out.select(F.max("first_codon")).first()[0] == 1
