"""Text formats: FASTA, GenBank, raw and JSON, read and written as columns and tables."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.batches import pieces
from ..functions.nt import alphabet, sanitize


def sniff(text: Column) -> Column:
    """json, genbank, fasta or raw, by how a text begins."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[\{\[]") & F.contains(t, F.lit('"sequence"')) & F.contains(t, F.lit('"id"')), "json").when(t.startswith("LOCUS"), "genbank").when(t.startswith(">"), "fasta").otherwise("raw")


def fold(seq: Column, width: int = 80) -> Column:
    """Lines of `width` letters."""
    return F.array_join(F.regexp_extract_all(seq, F.lit(f"(.{{1,{width}}})"), 1), "\n")


def write_fasta(name: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), fold(seq), F.lit("\n"))


def read_fasta(texts: DataFrame, default: str = "sequence") -> DataFrame:
    """(file_id, record_no, name, seq, alphabet, error) of texts (file_id, text): headers, any line ends, blank lines skipped.

    A name is the header's first word, or the default with the record's number; letters before any header open a record. A
    record without letters, or with letters beyond the nucleotide codes, has an error.
    """
    lines = texts.select("file_id", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("pos", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    w = W.partitionBy("file_id").orderBy("pos")
    head = F.col("line").startswith(">")
    # letters before the first header belong to record 1 as well
    lines = lines.withColumn("bare", F.first(~head).over(w).cast("int")).withColumn("record_no", F.sum(head.cast("int")).over(w) + F.col("bare"))
    g = lines.groupBy("file_id", "record_no").agg(
        F.max(F.when(head, F.substr("line", F.lit(2)))).alias("header"), F.array_sort(F.collect_list(F.when(~head, F.struct("pos", F.upper(F.regexp_replace("line", r"\s", "")).alias("t"))))).alias("ls")
    )
    seq = F.array_join(F.transform("ls", lambda x: x["t"]), "")
    g = g.withColumn("seq", seq).withColumn("name", F.coalesce(F.nullif(F.split(F.trim("header"), r"\s+")[0], F.lit("")), F.concat(F.lit(default + " "), F.col("record_no").cast("string"))))
    error = F.when(F.col("seq") == "", "EMPTY_RECORD").when(~F.col("seq").rlike("^[ACGTURYSWKMBDHVN.-]+$"), "INVALID_CHARACTERS")
    return g.select("file_id", F.col("record_no").cast("long").alias("record_no"), "name", "seq", alphabet(F.col("seq")).alias("alphabet"), error.alias("error"))


def read_raw(text: Column) -> Column:
    return sanitize(text)


def origin_block(seq: Column) -> Column:
    """GenBank's ORIGIN lines: the place of the first base, right-aligned to nine, and six groups of ten in lower case."""
    lines = F.regexp_extract_all(F.lower(seq), F.lit("(.{1,60})"), 1)
    return F.array_join(F.transform(lines, lambda t, i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.array_join(F.regexp_extract_all(t, F.lit("(.{1,10})"), 1), " "))), "\n")


def location(segments: Column, strand: Column) -> Column:
    """GenBank's location of 0-based segments: a..b, joined, and as a complement on strand -1."""
    parts = F.transform(segments, lambda s: F.concat((s["start0"] + 1).cast("string"), F.lit(".."), s["end0"].cast("string")))
    text = F.when(F.size(segments) == 1, F.get(parts, F.lit(0))).otherwise(F.concat(F.lit("join("), F.array_join(parts, ","), F.lit(")")))
    return F.when(strand == -1, F.concat(F.lit("complement("), text, F.lit(")"))).otherwise(text)


def locus_name(name: Column) -> Column:
    """Up to 16 letters, digits and underscores."""
    return F.substr(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"), F.lit(1), F.lit(16))


def header_fields(text: Column) -> dict[str, Column]:
    """Length, topology, definition, organism and number of features from a GenBank text's header."""
    one = lambda rx: F.nullif(F.regexp_extract(text, rx, 1), F.lit(""))
    return {
        "length": one(r"(?m)^LOCUS\s+\S+\s+(\d+) bp").cast("long"),
        "topology": F.when(F.regexp_like(text, F.lit(r"(?m)^LOCUS.*\bcircular\b")), "circular").otherwise("linear"),
        "definition": F.regexp_replace(one(r"(?m)^DEFINITION\s+((?:.*)(?:\n {12}.*)*)"), r"\s+", " "),
        "organism": one(r"(?m)^ {2}ORGANISM\s+(.*)$"),
        "n_features": F.regexp_count(text, F.lit(r"(?m)^ {5}\S+\s+\S")).cast("long"),
    }


def parse_location(text: str) -> tuple[int, list[tuple[int, int]]]:
    """(strand, 0-based segments) of a GenBank location; parts that run backwards or are malformed are left out."""
    strand = -1 if "complement" in text else 1
    spans = [(int(a) - 1, int(b or a)) for a, b in re.findall(r"<?(\d+)(?:\.\.>?(\d+))?", text)]
    return strand, [(a, b) for a, b in spans if a < b]


def parse_genbank(text: str) -> dict:
    """Name, topology, sequence and features (type, strand, segments, qualifiers) of one GenBank record."""
    head = re.search(r"(?m)^LOCUS\s+(\S+)(.*)$", text)
    seq = "".join(re.findall(r"[A-Za-z]+", text.split("ORIGIN", 1)[1].split("\n", 1)[-1].split("//")[0])).upper() if "ORIGIN" in text else ""
    body = text.split("FEATURES", 1)[1].split("ORIGIN")[0] if "FEATURES" in text else ""
    feats = []
    for m in re.finditer(r"(?m)^ {5}(\S+) +(.*(?:\n {21}(?!/).*)*)((?:\n {21}/.*(?:\n {21}(?!/).*)*)*)", body):
        strand, segs = parse_location(re.sub(r"\s", "", m[2]))
        quals: dict[str, list[str]] = {}
        for q in re.finditer(r'/(\w+)(?:=("(?:[^"]|"")*"|\S+))?', m[3]):
            quals.setdefault(q[1], []).append(re.sub(r"\s*\n\s+", " ", (q[2] or "").strip('"')))
        if segs:
            feats.append({"type": m[1], "strand": strand, "segments": [{"start0": a, "end0": b} for a, b in segs], "qualifiers": list(quals.items())})
    return {"name": head[1] if head else None, "topology": "circular" if head and "circular" in head[2] else "linear", "seq": seq, "features": feats}


GENBANK = "file_id long, name string, topology string, seq string, features array<struct<type:string,strand:int,segments:array<struct<start0:bigint,end0:bigint>>,qualifiers:map<string,array<string>>>>"


def read_genbank(texts: DataFrame) -> DataFrame:
    """texts (file_id, text), one record each, as rows of GENBANK: a small parser row by row."""
    kind = pa.struct([("type", pa.string()), ("strand", pa.int32()), ("segments", pa.list_(pa.struct([("start0", pa.int64()), ("end0", pa.int64())]))), ("qualifiers", pa.map_(pa.string(), pa.list_(pa.string())))])

    def run(batches):
        # the dicts of a record's features are many times its text
        for b in pieces(batches):
            got = [parse_genbank(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([g[k] for g in got], pa.string()) for k in ("name", "topology", "seq")], pa.array([g["features"] for g in got], pa.list_(kind))], names=["file_id", "name", "topology", "seq", "features"])

    return texts.select("file_id", "text").mapInArrow(run, GENBANK)


def write_genbank(docs: DataFrame, date: str) -> DataFrame:
    """(doc_id, text) of docs (doc_id, name, topology, seq, features: array<struct<type, strand, segments, label>>)."""
    lines = F.transform("features", lambda f: F.concat(F.lit("     "), F.rpad(f["type"], 16, " "), location(f["segments"], f["strand"]), F.lit('\n                     /label="'), F.replace(f["label"], F.lit('"'), F.lit("'")), F.lit('"\n')))
    locus = F.concat(F.lit("LOCUS       "), F.rpad(locus_name(F.col("name")), 16, " "), F.lit(" "), F.lpad(F.length("seq").cast("string"), 11, " "), F.lit(" bp    DNA     "), F.rpad("topology", 8, " "), F.lit(f" SYN {date}\n"))
    return docs.select("doc_id", F.concat(locus, F.lit("DEFINITION  "), F.col("name"), F.lit(".\nFEATURES             Location/Qualifiers\n"), F.array_join(lines, ""), F.lit("ORIGIN\n"), origin_block(F.col("seq")), F.lit("\n//\n")).alias("text"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file_id, path, format, text) of text files, one row each."""
    t = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return t.select(F.xxhash64("path").alias("file_id"), "path", sniff(F.col("text")).alias("format"), "text")
