"""The data source, the table function and the tools."""

import pytest

from strandwise.plans import tools
from strandwise.sources import datasource


def test_fasta_source_and_site_function(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "a.fa").write_text(">x one\nTTCAAAA\nAAGAA\n>y\nGGTCTC\n")
    (tmp_path / "b.fa").write_text("ACGT\n")
    df = spark.read.format("fasta").option("paths", f"{tmp_path}/a.fa,{tmp_path}/b.fa").load()
    assert sorted((r.record_no, r.name, r.seq) for r in df.collect()) == [(0, "", "ACGT"), (1, "x", "TTCAAAAAAGAA"), (2, "y", "GGTCTC")]
    df.createOrReplaceTempView("records")
    got = spark.sql("SELECT name, s.* FROM records, LATERAL find_sites(seq, true, 'EcoRI') s").collect()
    assert [tuple(r) for r in got] == [("x", "ecori", 1, 9)]


def test_tools(spark):
    docs = spark.createDataFrame([(1, "linear", "AAGAATTCAA", 10)], "doc_id long, topology string, seq string, n long")
    assert tools.call("digest", docs, names=["EcoRI"]).count() == 2
    with pytest.raises(tools.ToolError, match="UNKNOWN_TOOL"):
        tools.call("nothing", docs)
    done, code = tools.run_batch([("analyze_restriction_sites", {"names": ["EcoRI"]}), ("find_orfs", {"wrong": 1}), ("find_orfs", {})], docs)
    assert len(done) == 1 and code == "INVALID_ARGUMENT"
