"""Alignment, re-alignment, matching of features and products, against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandwise.functions.tables import enzymes
from strandwise.operators import align, diff, matching, products, workspace

SEGMENTS = "array<struct<start0:bigint,end0:bigint>>"


def _plain_score(a, b):
    s = [[-2 * (i + j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s[i][j] = max(s[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), s[i - 1][j] - 2, s[i][j - 1] - 2)
    return s


def _plain_steps(a, b):
    s, i, j, out = _plain_score(a, b), len(a), len(b), []
    while i or j:
        if i and j and s[i][j] == s[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
            out, i, j = [*out, align.BOTH], i - 1, j - 1
        elif i and s[i][j] == s[i - 1][j] - 2:
            out, i = [*out, align.UP], i - 1
        else:
            out, j = [*out, align.LEFT], j - 1
    return out[::-1]


def _rescored(x, y):
    return sum(-2 if "-" in p else 2 if p[0] == p[1] else -1 for p in zip(x, y, strict=True))


def _text(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def _edited(rng, t, changes):
    for _ in range(changes):
        p = rng.randrange(len(t) + 1)
        t = rng.choice([t[:p] + _text(rng, rng.randrange(9)) + t[p:], t[:p] + t[p + rng.randrange(9) :], t[:p] + "G" + t[p + 1 :]])
    return t


def test_alignment_of_short_texts_is_the_plain_one():
    rng = random.Random(7)
    for _ in range(300):
        a, b = _text(rng, rng.randrange(15)), _text(rng, rng.randrange(15))
        way, best = align.steps(a, b)
        assert best == align.score(a, b) == _plain_score(a, b)[-1][-1]
        assert way.tolist() == _plain_steps(a, b)


def test_alignment_of_long_texts_in_bands_and_parts():
    rng = random.Random(8)
    for n, changes in ((400, 3), (600, 60), (500, 0)):
        a = _text(rng, n)
        b = _edited(rng, a, changes) if changes else _text(rng, 350)
        best = _plain_score(a, b)[-1][-1]
        assert align.score(a, b) == best
        for cells in (1 << 25, 2000):
            way, got = align.steps(a, b, cells)
            x, y, same = align.aligned(a, b, way)
            assert (x.replace("-", ""), y.replace("-", "")) == (a, b)
            assert got == best == _rescored(x, y) and same == sum(p == q for p, q in zip(x, y, strict=True))


def test_alignments_of_empty_and_null(spark):
    d = spark.createDataFrame([("a", None, "ACG"), ("b", "", ""), ("c", "ACGT", "AGT")], "doc_id string, reference string, query string")
    got = {r.doc_id: tuple(r)[1:] for r in align.alignments(d).collect()}
    assert got == {"a": ("---", "ACG", 0, -6, 0.0), "b": ("", "", 0, 0, 0.0), "c": ("ACGT", "A-GT", 3, 4, 75.0)}
    assert {r.doc_id: r.score for r in diff.alignment_scores(d).collect()} == {"a": -6, "b": 0, "c": 4}
    assert align.alignments(d.limit(0)).count() == 0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, e in enumerate(b, 1):
            last, row[j] = row[j], min(last + (c != e), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_realigned_differences(spark):
    rng = random.Random(9)
    texts = [("", "ACG"), ("ACGT", ""), ("ACGT", "ACGT")]
    for _ in range(60):
        a = _text(rng, rng.randrange(20, 120))
        texts.append((a, _edited(rng, a, rng.randrange(1, 5))))
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "doc_id long, reference string, query string")
    script = diff.differences(pairs)
    found = align.realigned(pairs, script).cache()
    assert {r.doc_id: r.query for r in align.rebuilt(pairs, found).collect()} == {i: b for i, (_, b) in enumerate(texts)}
    size = lambda df: {r.doc_id: r.n for r in df.groupBy("doc_id").agg(F.sum(F.greatest(F.length("ref_bases"), F.length("qry_bases"))).alias("n")).collect()}
    before, after = size(script), size(found)
    assert all(after[k] <= before[k] for k in before)
    # one group for the whole text: the edit distance itself
    whole = size(align.realigned(pairs, script, gap=1000))
    for i, (a, b) in enumerate(texts):
        kinds = len({(r.ref_start0, r.qry_start0) for r in found.filter(F.col("doc_id") == i).collect()})
        assert whole.get(i, 0) >= _distance(a, b) and (kinds > 0) == (a != b)
    assert sum(whole.get(i, 0) == _distance(a, b) for i, (a, b) in enumerate(texts)) >= len(texts) * 9 // 10


def _greedy(reference, query):
    left, out = dict(query), {}
    for i, (name, kind, start) in sorted(reference.items(), key=lambda x: (x[1][2], x[1][0], x[0])):
        scored = [(-(1_000_000 if k == i else 100_000 - abs(s - start)), s, k) for k, (m, t, s) in left.items() if k == i or (m.lower() == name.lower() and t == kind and abs(s - start) <= 100_000)]
        if scored:
            out[i] = min(scored)[2]
            del left[out[i]]
    return out


def test_features_match_as_one_by_one(spark):
    rng = random.Random(10)
    sides, rows = {}, {0: [], 1: []}
    for doc in range(40):
        for side in (0, 1):
            # ids of both sides overlap in part; names, types and starts tie often
            f = {rng.randrange(12) + side * 6: (rng.choice(["ori", "ORI", "bla"]), rng.choice(["CDS", "misc"]), rng.randrange(8)) for _ in range(rng.randrange(10))}
            sides[doc, side] = f
            rows[side] += [(doc, i, n, t, 1, [(s, s + 5)]) for i, (n, t, s) in f.items()]
    schema = f"doc_id long, feature_id long, name string, type string, strand long, segments {SEGMENTS}"
    a, b = (spark.createDataFrame(rows[k], schema) for k in (0, 1))
    got = {}
    for r in matching.match_features(a, b).collect():
        got.setdefault(r.doc_id, {})[r.reference_id] = r.query_id
    for doc in range(40):
        assert got.get(doc, {}) == _greedy(sides[doc, 0], sides[doc, 1])
    molecules = spark.createDataFrame([(d, 20, "circular") for d in range(40)], "doc_id long, n long, topology string")
    compared = matching.compare(a, b, molecules).collect()
    assert sorted((r.doc_id, r.reference_id) for r in compared if r.reference_id is not None) == sorted((d, i) for d in range(40) for i in sides[d, 0])
    assert sorted((r.doc_id, r.query_id) for r in compared if r.query_id is not None) == sorted((d, i) for d in range(40) for i in sides[d, 1])
    assert all(abs(r["shift"]) <= 10 for r in compared if r["shift"] is not None)
    assert matching.match_features(a.limit(0), b).count() == 0


def test_features_on_pieces_base_by_base(spark):
    rng = random.Random(11)
    feats, pieces, want = [], [], {}
    for k in range(120):
        n = rng.randrange(5, 40)
        start, size, turned, off = rng.randrange(n), rng.randrange(1, n + 1), rng.random() < 0.5, rng.randrange(50)
        a = rng.randrange(n)
        segments = [(a, rng.randrange(a, n) + 1)] if rng.random() < 0.6 else [(a, n), (0, rng.randrange(a + 1))]
        feats.append((k, k, 1, segments))
        pieces.append((k, start, size, n, turned, off))
        place = {(start + i) % n: off + (size - 1 - i if turned else i) for i in range(size)}
        want[k] = {place[p] for x, y in segments for p in range(x, y) if p in place}
    f = spark.createDataFrame(feats, f"doc_id long, feature_id long, strand long, segments {SEGMENTS}")
    p = spark.createDataFrame(pieces, "doc_id long, start0 long, length long, n long, inverted boolean, offset long")
    rows = products.carry(f, p, ["doc_id"]).collect()
    assert {r.doc_id: {i for s in r.segments for i in range(s.start0, s.end0)} for r in rows} == want
    assert all(r.strand == (-1 if pieces[r.doc_id][4] else 1) for r in rows)
    counts = products.left_out(products.carry(f, p, ["doc_id"]), ["doc_id"]).collect()
    assert {r.doc_id: r.n_features for r in counts} == {k: int(bool(v)) for k, v in want.items()}


def test_segments_through_the_end_of_a_circle(spark):
    d = spark.createDataFrame([([(2, 5)],), ([(8, 13)],), ([(11, 14)],), ([],)], f"s {SEGMENTS}")
    got = [[tuple(x) for x in r[0]] for r in d.select(products.through_end(F.col("s"), F.lit(10))).collect()]
    assert got == [[(2, 5)], [(8, 10), (0, 3)], [(1, 4)], []]


def test_clones_in_both_orientations_and_errors(spark):
    vector, insert = "AAAGAATTCTTTTTTTTTTGAATTCCCC", "GGGGAATTCACACACACGAATTCTG"
    docs = spark.createDataFrame(
        [(1, "circular", vector), (2, "circular", insert), (3, "circular", "ACGTACGTAC"), (4, "linear", "CCCGAATTCAAA")], "doc_id long, topology string, seq string"
    ).withColumn("n", F.length("seq").cast("long"))
    pairs = spark.createDataFrame([(1, 2, None), (1, 3, None), (3, 1, None), (1, 4, None), (1, 2, 99)], "vector_id long, insert_id long, vector_fragment long")
    rows = products.clone(pairs, docs, enzymes("EcoRI")).collect()
    errors = sorted((r.vector_id, r.insert_id, r.error_code) for r in rows if r.error_code)
    assert errors == [(1, 2, "VECTOR_FRAGMENT_NOT_FOUND"), (1, 3, "NO_INSERT_CUT"), (1, 4, "INCOMPATIBLE_ENDS"), (3, 1, "NO_VECTOR_CUT")]
    made = {r.orientation: r for r in rows if not r.error_code}
    assert set(made) == {"forward", "reverse"}
    turn = str.maketrans("ACGT", "TGCA")
    for way, r in made.items():
        assert r.product_length == len(r.sequence)
        # both joints are sites again
        assert (r.sequence + r.sequence[:5]).count("GAATTC") == 2
        body = (insert + insert)[r.insert_start0 : r.insert_start0 + r.insert_length]
        inner = body[5:] if way == "forward" else body[5:].translate(turn)[::-1]
        assert inner in r.sequence + r.sequence
    none = products.clone(pairs, docs, []).collect()
    assert {r.error_code for r in none} == {"NO_ENZYMES"}


def test_runs_of_one_kind():
    x, y = (np.frombuffer(t, np.uint8) for t in (b"ACGT", b"AGGTT"))
    assert align.runs(x, y, np.array([0, 0, 0, 0, 2], np.uint8)) == [("substitution", 1, 2, 1, 2), ("insertion", 4, 4, 4, 5)]


def test_coordinates_as_typed(spark):
    typed = {":12": (12, 12), "12": (12, 12), " 12-30\t": (12, 30), "12 .. 30": (12, 30), "12..101": (None, None), "30-12": (None, None), "0-5": (None, None), "1..": (None, None),
             ": 12": (None, None), "12--30": (None, None), "12...30": (None, None), "1-2-3": (None, None), "": (None, None), "-": (None, None), "9" * 40: (None, None), None: (None, None)}
    d = spark.createDataFrame([(t,) for t in typed], "t string")
    got = d.select("t", *[c.alias(k) for k, c in workspace.parse_coordinates(F.col("t"), F.lit(100)).items()]).collect()
    assert {r.t: (r.start1, r.end1) for r in got} == typed
    wide = d.filter("t = '12..101'").select(workspace.parse_coordinates(F.col("t"))["end1"]).collect()
    assert wide[0][0] == 101
