"""Formats, streams and the entry's contract."""

from pyspark.sql import functions as F

import __spark_entry__
from strandwise.functions import nt
from strandwise.sources import formats, protocol
from strandwise.streaming import activity


def test_fasta_records(spark):
    t = spark.createDataFrame([(1, ">a x\r\nAC\r\n\r\ngt\n>b\n>\nNN"), (2, "ACGU\n>c\nAC GT"), (3, ">bad\nAC!T"), (4, "")], "file_id long, text string")
    got = [tuple(r) for r in formats.read_fasta(t).orderBy("file_id", "record_no").collect()]
    assert got == [(1, 1, "a", "ACGT", "DNA", None), (1, 2, "b", "", "UNKNOWN", "EMPTY_RECORD"), (1, 3, "sequence 3", "NN", "DNA", None), (2, 1, "sequence 1", "ACGU", "RNA", None), (2, 2, "c", "ACGT", "DNA", None), (3, 1, "bad", "AC!T", "UNKNOWN", "INVALID_CHARACTERS")]


GB = """LOCUS       pX 40 bp    DNA     circular SYN 01-JAN-2024
DEFINITION  A test.
FEATURES             Location/Qualifiers
     CDS             complement(join(31..40,1..9))
                     /label="two parts"
                     /codon_start=1
     promoter        12..20
     gene            <25..>24
ORIGIN
        1 acgtacgtac gtacgtacgt acgtacgtac gtacgtacgt
//
"""


def test_genbank(spark):
    g = formats.read_genbank(spark.createDataFrame([(1, GB), (2, None)], "file_id long, text string")).orderBy("file_id").collect()
    a = g[0]
    assert (a.name, a.topology, a.seq, len(a.features)) == ("pX", "circular", "ACGT" * 10, 2)
    assert a.features[0].strand == -1 and [tuple(s) for s in a.features[0].segments] == [(30, 40), (0, 9)]
    assert a.features[0].qualifiers == {"label": ["two parts"], "codon_start": ["1"]} and g[1].seq == ""


def test_scalars(spark):
    d = spark.createDataFrame([("AACG",)], "s string")
    s = F.col("s")
    got = d.select(nt.reverse_complement(s), nt.gc_permille(s), nt.subsequence(s, F.lit(3), F.lit(1)), nt.rotate(s, F.lit(1)), nt.alphabet(F.lit("ACGU")), nt.alphabet(F.lit("xyz")), nt.alphabet(F.lit("TU")), nt.translate_codons(F.lit("ATGTAANNNA"))).first()
    assert tuple(got) == ("CGTT", 500, "GA", "ACGA", "RNA", "UNKNOWN", "MIXED", "M*X")
    assert [r[0] for r in d.select(F.explode(F.array(*[protocol.well(F.lit(k)) for k in (0, 7, 8, 95)]))).collect()] == ["A1", "H1", "A2", "H12"]


def test_stream_gives_the_batch_result(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{src}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    q = activity.windowed_counts(activity.activity_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.window_start, r.tool): r.n_events for r in spark.table("w").collect()}
    want = {(r.window_start, r.tool): r.n_events for r in activity.windowed_counts(e).collect()}
    assert got == want and want
    assert activity.session_counts(e).agg(F.sum("n_events")).first()[0] == e.count()


def test_fasta_ingest_reads_a_file_once(spark, tmp_path):
    folder = tmp_path / "fa"
    folder.mkdir()
    (folder / "a.fa").write_text(">x\nACGT\n>y\nGG\n")
    run = lambda: activity.ingest_fasta(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert run().count() == 2
    (folder / "b.fa").write_text(">z\nTT\n")
    assert sorted(r.name for r in run().collect()) == ["x", "y", "z"]
    assert run().count() == 3


def test_entry(spark):
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 80
    assert __spark_entry__.entry(spark).count() > 0


def test_files(spark, tmp_path):
    (tmp_path / "a.gb").write_text(GB)
    (tmp_path / "b.fa").write_text(">x\nAC\n")
    assert sorted(r.format for r in formats.read_files(spark, str(tmp_path)).collect()) == ["fasta", "genbank"]
