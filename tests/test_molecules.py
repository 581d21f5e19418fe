"""Operators on small molecules with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from strandwise.functions import nt
from strandwise.functions.tables import codons, enzymes, nuclease
from strandwise.operators import assembly, crispr, diff, digest, edit, features, orf, pcr, restriction, scan, workspace


def molecules(spark, *rows):
    return spark.createDataFrame([(i, t, s, len(s)) for i, (t, s) in enumerate(rows)], "doc_id long, topology string, seq string, n long")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_tables():
    assert len(enzymes()) == 87 and codons()["ATG"] == "M" and codons(2)["TGA"] == "W"
    assert nuclease("cas9")["name"] == nuclease("nothing")["name"] == "SpCas9" and nuclease("CPF1")["spacer"] == 23


@pytest.mark.parametrize("block", [4, 7, 100])
def test_scan_finds_overlapping_and_ambiguous(spark, block):
    for text, motif, want in (("AAAAA", "AAAA", [0, 1]), ("TGTANCTA", "AR", [3]), ("ACGT", "TT", []), ("NNN", "GA", [0, 1])):
        d = spark.createDataFrame([(1, len(text), text, nt.site_class(motif), len(motif))], "doc_id long, n long, hay string, regex string, width int")
        assert sorted(r.start0 for r in scan.scan(d, block).collect()) == want


def test_sites_through_the_origin(spark):
    s = molecules(spark, ("circular", "TTCAAAAAAGAA"), ("linear", "TTCAAAAAAGAA"), ("linear", "GGTCTCAAAA"), ("circular", "GAA"))
    got = rows(restriction.restriction_sites(s, enzymes("EcoRI", "BsaI")).select("doc_id", "enzyme_id", "strand", "start0", "end0", "fwd_cut0", "rev_cut0"))
    # the cut of a site near a linear end is taken modulo the length
    assert got == [(0, "ecori", 1, 9, 3, 10, 2), (2, "bsai", 1, 0, 6, 7, 1)]


def digest_of(spark, s, *names):
    return digest.fragments(s, digest.cuts(restriction.restriction_sites(s, enzymes(*names))))


def test_fragments_add_up(spark):
    rng = random.Random(1)
    s = molecules(spark, *[(t, "".join(rng.choice("ACGT") for _ in range(rng.randrange(30, 900)))) for t in ("linear", "circular") * 20])
    got = digest_of(spark, s, "MseI", "AluI").groupBy("doc_id").agg(F.sum("length").alias("x")).join(s, "doc_id").filter("x <> n").count()
    assert got == 0
    one = rows(digest_of(spark, molecules(spark, ("circular", "AAGAATTCAA"), ("linear", "AAGAATTCAA"), ("circular", "A" * 9)), "EcoRI").select("doc_id", "fragment_no", "start0", "end0", "length"))
    assert one == [(0, 1, 3, 3, 10), (1, 1, 0, 3, 3), (1, 2, 3, 10, 7), (2, 1, 0, 9, 9)]


def test_cut_ends(spark):
    s = molecules(spark, ("linear", "AAGAATTCAA"), ("linear", "AACTGCAGAA"), ("linear", "AACCCGGGAA"))
    c = digest.cuts(restriction.restriction_sites(s, enzymes("EcoRI", "PstI", "SmaI")))
    assert rows(digest.cut_ends(s, c).select("doc_id", "cut0", "end_type", "left_overhang", "right_overhang")) == [(0, 3, "5' overhang", "AATT", "AATT"), (1, 7, "3' overhang", "TGCA", "TGCA"), (2, 5, "blunt", "", "")]


def pcr_of(spark, topology, seq, fwd, rev):
    s = molecules(spark, (topology, seq))
    p = spark.createDataFrame([(0, "f", fwd), (0, "r", rev)], "doc_id long, primer_id string, primer string")
    return pcr.amplicons(pcr.bindings(s, p), "f", "r")


def test_pcr(spark):
    a = pcr_of(spark, "linear", "AAAAATGCGGGGCCATAAAA", "ATGC", "ATGG").collect()
    assert [(r.start0, r.end0, r.length) for r in a] == [(4, 16, 12)]
    assert sorted(r.length for r in pcr_of(spark, "linear", "ATGCATGCCCATCCAT", "ATGC", "ATGG").collect()) == [8, 12, 12, 16]
    c = pcr_of(spark, "circular", "CCATAAAAAAAAATGC", "ATGC", "ATGG").collect()
    assert [(r.start0, r.end0, r.length, r.wraps) for r in c] == [(12, 4, 8, True)]
    assert pcr_of(spark, "linear", "AAAACCATGGGGATGCAAAA", "ATGC", "ATGG").count() == 0


def test_primer_bindings(spark):
    p = spark.createDataFrame([(0, "p", "GAATTC"), (1, "w", "TGAA")], "doc_id long, primer_id string, primer string")
    got = rows(pcr.bindings(molecules(spark, ("linear", "---GAATTC---"), ("circular", "A----TGA")), p).select("doc_id", "orientation", "start0", "end0", "wraps"))
    assert got == [(0, "forward", 3, 9, False), (0, "reverse", 3, 9, False), (1, "forward", 5, 1, True)]


def test_guides(spark):
    t = crispr.targets(molecules(spark, ("linear", "ATGCGATCGATCGATCGATCAGGTTTT"), ("circular", "AGG" + "A" * 20)), "SpCas9").collect()
    a = [r for r in t if r.doc_id == 0 and r.strand == 1 and r.pam == "AGG"]
    assert [(r.cut0, r.gc_percent) for r in a] == [(17, 50)]
    assert any(r.doc_id == 1 and r.pam_start0 == 0 and r.spacer == "A" * 20 for r in t)


def test_golden_gate(spark):
    p = spark.createDataFrame([(1, 0, "GGTCTCAATGCTTAACCGGGCTAAGAGACC"), (1, 1, "GGTCTCAGCTATTTTATGCAGAGACC"), (2, 0, "AAAA"), (2, 1, "GGTCTCAATGCTTGGTCTCAAACCGGGCTAAGAGACC")], "assembly_id long, ord long, seq string")
    d = assembly.digest_parts(p)
    first = d.filter("assembly_id = 1 and ord = 0").first()
    assert (first.left_overhang, first.right_overhang, first.body) == ("ATGC", "GCTA", "ATGCTTAACCGGGCTA")
    assert {r.error for r in d.filter("assembly_id = 2").collect()} == {"MISSING_FORWARD", "INTERNAL_FORWARD"}
    built = {r.assembly_id: (r.n_compatible, r.sequence) for r in assembly.assemble(d).collect()}
    assert built == {1: (2, "ATGCTTAACCGGGCTATTTT"), 2: (0, None)}


def test_domestication():
    new, where = assembly.domesticate_one("ATGGGTCTCTAA", "GGTCTC")
    code = codons()
    assert "GGTCTC" not in new and "GAGACC" not in new and where
    assert [code[new[i : i + 3]] for i in range(0, 12, 3)] == list("MGL*")
    rng = random.Random(4)
    for _ in range(50):
        s = "".join(rng.choice("ACGT") for _ in range(60)) + "GGTCTC" + "".join(rng.choice("ACGT") for _ in range(60))
        new, _ = assembly.domesticate_one(s, "GGTCTC")
        assert new is None or ("GGTCTC" not in new and "GAGACC" not in new and [code[new[i : i + 3]] for i in range(0, 126, 3)] == [code[s[i : i + 3]] for i in range(0, 126, 3)])


def test_known_features(spark):
    lib = spark.createDataFrame([(7, "AAGTC")], "item_id long, motif string")
    got = features.known_features(molecules(spark, ("linear", "CCAAGTCGGGACTTAA"), ("circular", "GTCGGGAA")), lib, 5)
    assert rows(got.select("doc_id", "strand", "start0", "end0", "wraps")) == [(0, -1, 9, 14, False), (0, 1, 2, 7, False), (1, 1, 6, 3, True)]


def test_reading_frames(spark):
    body = "ATG" + "GCT" * 31 + "TAA"
    o = orf.open_reading_frames(molecules(spark, ("linear", "CC" + body + "G"), ("circular", body[50:] + "CCC" + body[:50]), ("linear", nt.rc(body))))
    got = {(r.doc_id, r.strand, r.start0, r.length, r.wraps) for r in o.collect()}
    assert {(0, 1, 2, 99, False), (1, 1, 52, 99, True), (2, -1, 0, 99, False)} <= got


def test_edits(spark):
    one = spark.createDataFrame([("0123456789",)], "s string")
    assert one.select(edit.delete_range(F.col("s"), F.lit(8), F.lit(2))).first()[0] == "234567"
    seg = lambda *xs: F.array(*[F.struct(F.lit(a).cast("long").alias("start0"), F.lit(b).cast("long").alias("end0")) for a, b in xs])
    run = lambda c: [tuple(x) for x in one.select(c).first()[0]]
    assert run(edit.segments_after_insert(seg((0, 5), (5, 25), (30, 40)), F.lit(10), F.lit(6))) == [(0, 5), (5, 31), (36, 46)]
    assert run(edit.segments_after_rotate(seg((8, 10), (0, 2)), F.lit(5), F.lit(10))) == [(3, 7)]
    assert run(edit.segments_after_delete(seg((0, 4), (2, 6), (5, 7), (6, 12), (1, 12)), F.lit(4), F.lit(8))) == [(0, 4), (2, 4), (4, 8), (1, 8)]


def test_least_rotation():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("ACG") for _ in range(rng.randrange(1, 14)))
        all_ = [t[i:] + t[:i] for i in range(len(t))]
        assert diff.least_rotation(t) == all_.index(min(all_))
        assert diff.canonical(t)[0] == diff.canonical(nt.rc(t))[0] == diff.canonical(t[3:] + t[:3])[0]


def test_edit_scripts():
    assert diff.edit_script("ACGT", "ATGT") == [("substitution", 1, 1, "C", "T")]
    assert diff.edit_script("ACGT", "ACGTT") == [("insertion", 4, 4, "", "T")] or diff.edit_script("ACGT", "ACGTT")[0][0] == "insertion"
    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randrange(12))) for _ in range(2))
        out, at, cost = [], 0, 0
        for _, i, _, x, y in diff.edit_script(a, b):
            assert a[i : i + len(x)] == x
            out.append(a[at:i] + y)
            at = i + len(x)
            cost += len(x) + len(y)
        assert "".join(out) + a[at:] == b
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if a[i] == b[j] else max(lcs[i][j + 1], lcs[i + 1][j])
        assert cost == len(a) + len(b) - 2 * lcs[-1][-1]
    assert diff.edit_script("A" * 50, "C" * 50, limit=3) is None


def test_consequences(spark):
    d = spark.createDataFrame([("ATGGAATTTTAA", "ATGGACTTTTAA"), ("ATGGAATTTTAA", "ATGGAGTTTTAA"), ("ATGGAATTTTAA", "ATGTAATTTTAA"), ("ATGGAA", "ATGGAAC"), ("ATGGAA", "CTGGAA"), ("ATGTAA", "ATGTCA")], "a string, b string")
    assert [r[0] for r in d.select(diff.consequence(F.col("a"), F.col("b"))).collect()] == ["missense", "synonymous", "nonsense", "frameshift", "start_lost", "stop_lost"]


def test_lanes_do_not_overlap(spark):
    rng = random.Random(5)
    f = [(1, i, [(a, a + rng.randrange(1, 30))]) for i, a in enumerate(rng.randrange(200) for _ in range(60))]
    got = {r.feature_id: r.lane for r in features.assign_lanes(spark.createDataFrame(f, "doc_id long, feature_id long, segments array<struct<start0:long,end0:long>>")).collect()}
    for _, i, [(a, b)] in f:
        assert not any(i < j and got[i] == got[j] and a < d and c < b for _, j, [(c, d)] in f)


def test_commit_once(spark):
    tx = spark.createDataFrame([(1, 1, 0, "h", "approved"), (2, 1, 0, "h", "approved"), (3, 1, 1, "h", "approved"), (4, 2, 0, "x", "pending"), (5, 9, 0, "h", "approved"), (6, 1, 0, "h", "rejected")], "tx_id long, doc_id long, base_version long, base_hash string, decision string")
    cur = spark.createDataFrame([(1, 0, "h"), (2, 0, "h")], "doc_id long, version long, hash string")
    assert [r.status for r in workspace.commit(tx, cur).orderBy("tx_id").collect()] == ["applied", "stale", "stale", "pending", "stale", "rejected"]


def test_scripts_beyond_the_limit_and_of_long_pairs(spark):
    rng = random.Random(5)
    a = "".join(rng.choice("ACGT") for _ in range(50_007))
    b = a[:30_000] + nt.rc(a[30_000]) + a[30_001:]
    assert diff.edit_script(a, b) == [("substitution", 30_000, 30_000, a[30_000], b[30_000])]
    assert diff.positional_script("AACCGGTT", "AAGCTTT") == [("substitution", 2, 2, "C", "G"), ("substitution", 4, 4, "G", "T"), ("deletion", 5, 5, "G", "")]
    d = spark.createDataFrame([("x", "A" * 50, "C" * 50), ("y", "ACGT", "ACGT"), ("z", None, "AC"), ("e", "", "")], "doc_id string, reference string, query string")
    got = rows(diff.differences(d, limit=3))
    assert got == [("x", "substitution", 0, 0, "A" * 50, "C" * 50), ("z", "insertion", 0, 0, "", "AC")]
    for _ in range(40):
        a, b = ("".join(rng.choice("AC") for _ in range(rng.randrange(14))) for _ in range(2))
        for script in (diff.edit_script(a, b), diff.positional_script(a, b)):
            out, at = "", 0
            for _, i, j, x, y in script:
                out += a[at:i]
                assert a[i : i + len(x)] == x and len(out) == j
                out, at = out + y, i + len(x)
            assert out + a[at:] == b


def test_runs_of_differences_across_blocks(spark):
    d = spark.createDataFrame([(1, "AAAAAAAAAA", "AAACCCAAAC"), (2, "ACGT", "ACGT"), (3, "", ""), (4, None, "A")], "doc_id long, reference string, query string")
    for block in (2, 4, 4096):
        assert rows(diff.difference_runs(d, block)) == [(1, 3, 6, 3, "AAA", "CCC"), (1, 9, 10, 1, "A", "C")]


def test_rotation_of_short_and_repeating_pairs(spark):
    d = spark.createDataFrame([(1, "AACCGTACG", "CGTACGAAG"), (2, "ACACACAC", "CACACACA"), (3, "ACG", "ACGT"), (4, "ACGTT" * 20, "T" + "ACGTT" * 19 + "ACGA")], "doc_id long, reference string, query string")
    got = {r.doc_id: r.rotation for r in diff.rotations(d).collect()}

    def plain(a, b):
        return max(range(len(a)), key=lambda r: (sum(x == y for x, y in zip(a[r:] + a[:r], b)), -r))

    assert got == {1: plain("AACCGTACG", "CGTACGAAG"), 2: 1, 3: None, 4: plain("ACGTT" * 20, "T" + "ACGTT" * 19 + "ACGA")}


def test_motifs_of_mixed_widths(spark):
    rng = random.Random(9)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (300, 41, 12, 0)]
    mols = molecules(spark, *[(t, s) for s in seqs for t in ("linear", "circular")])
    motifs = {1: seqs[0][10:60], 2: nt.rc(seqs[0][100:120]), 3: "GAATTC", 4: (seqs[1] + seqs[1])[30:55], 5: seqs[2], 6: "", 7: seqs[0][10:30] + "A" * 9}
    lib = spark.createDataFrame(list(motifs.items()), "item_id long, motif string")
    want = set()
    for i, s in enumerate(x for s in seqs for x in (s, s)):
        for k, m in motifs.items():
            for strand, t in ((1, m), (-1, nt.rc(m))):
                if t and len(t) <= len(s) and (strand == 1 or t != m):
                    hay = s + s[: len(t) - 1] if i % 2 else s
                    want |= {(i, k, strand, p, len(t)) for p in range(len(hay) - len(t) + 1) if hay[p : p + len(t)] == t}
    got = scan.find_motifs(mols, lib).select("doc_id", "item_id", "strand", "start0", "width").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_alignment_scores_have_no_limit(spark):
    d = spark.createDataFrame([("a", "ACGT", "ACGA"), ("b", "ACGTA", "ACGTA"), ("c", None, "A")], "doc_id string, reference string, query string")
    assert rows(diff.alignment_scores(d)) == [("a", 5), ("b", 10), ("c", -2)]


def test_canonical_rotation_is_the_least_of_both_strands(spark):
    rng = random.Random(2)
    for _ in range(30):
        t = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 40)))
        assert diff.canonical(t)[0] == min(x[i:] + x[:i] for x in (t, nt.rc(t)) for i in range(len(t)))


def test_features_on_fragments(spark):
    frags = spark.createDataFrame([(1, 1, 4, 4, 10), (2, 1, 0, 3, 3), (2, 2, 3, 10, 7), (3, 1, 8, 2, 4), (3, 2, 2, 8, 6)], "doc_id long, fragment_no long, start0 long, end0 long, length long")
    kind = "doc_id long, feature_id long, strand long, n long, segments array<struct<start0:long,end0:long>>"
    feats = spark.createDataFrame([(1, 1, 1, 10, [(2, 6)]), (2, 1, -1, 10, [(1, 5)]), (2, 2, 1, 10, [(4, 4)]), (3, 1, 1, 10, [(9, 10), (0, 1)]), (3, 2, 1, 10, [(1, 3)])], kind)
    want = [(1, 1, 1, 1, 0, 10, 4, False), (2, 1, 1, -1, 1, 3, 2, True), (2, 2, 1, -1, 0, 2, 2, True), (3, 1, 1, 1, 1, 3, 2, False), (3, 1, 2, 1, 3, 4, 1, True), (3, 2, 2, 1, 0, 1, 1, True)]
    for size in (2, 1024):
        assert rows(features.on_fragments(feats, frags, size)) == want
    assert features.on_fragments(feats.limit(0), frags).count() == 0


def test_projects_keep_their_creation(spark):
    stored = spark.createDataFrame([(1, 1, 10, 11), (1, 2, 20, 21), (2, 1, 30, 31)], "user_id long, project_id long, created long, updated long")
    changes = spark.createDataFrame([(1, 1, 50, False), (1, 1, 40, True), (1, 2, 60, False), (1, 2, 60, True), (2, 9, 70, False)], "user_id long, project_id long, at long, deleted boolean")
    assert rows(workspace.upsert_projects(stored, changes)) == [(1, 1, 10, 50), (2, 1, 30, 31), (2, 9, 70, 70)]


def test_normalize_takes_rna(spark):
    assert spark.range(1).select(nt.normalize(F.lit(" acgu\n\tAc "))).first()[0] == "ACGTAC"
