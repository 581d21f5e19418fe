"""Spliced coding sequences: exons in reading order, their bases, the codons that edits meet, and what becomes of the protein."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nt import let, reverse_complement, translate_codons

#: Bases of a molecule that travel as one row, and that exons and edits meet by.
BLOCK = 4_096
#: Effects in the order in which they are named.
KINDS = ("frameshift", "nonsense", "stop_lost", "start_lost", "inframe_insertion", "inframe_deletion", "missense", "synonymous", "coding_sequence_change")


def reading_order(segments: Column, n: Column, topology: Column) -> Column:
    """Segments by start; those of a circular molecule begin behind the largest gap between them (of equal gaps the first)."""

    def turned(s):
        size = F.size(s)
        gaps = F.transform(s, lambda x, i: F.when(i + 1 < size, F.get(s, i + 1)["start0"]).otherwise(F.get(s, F.lit(0))["start0"] + n) - x["end0"])
        first = let(gaps, lambda g: F.when(F.array_max(g) < 0, 0).otherwise(F.array_position(g, F.array_max(g)) % size)).cast("int")
        return let(first, lambda k: F.concat(F.slice(s, k + 1, size), F.slice(s, F.lit(1), k)))

    by_start = F.array_sort(segments)
    return F.when((topology == "circular") & (F.size(segments) > 1), let(by_start, turned)).otherwise(by_start)


def exons(feats: DataFrame) -> DataFrame:
    """(doc_id, feature_id, strand, exon, start0, end0, before): the exons of feats (doc_id, feature_id, strand, segments, n,
    topology) in reading order along the forward strand, with the bases of the exons before each."""
    ordered = feats.select("doc_id", "feature_id", "strand", reading_order(F.col("segments"), F.col("n"), F.col("topology")).alias("s"))
    before = F.transform("s", lambda x, i: F.aggregate(F.slice("s", F.lit(1), i), F.lit(0).cast("long"), lambda acc, y: acc + y["end0"] - y["start0"]))
    rows = ordered.select("doc_id", "feature_id", "strand", F.posexplode(F.arrays_zip("s", before.alias("before"))).alias("exon", "x"))
    return rows.select("doc_id", "feature_id", "strand", "exon", "x.s.start0", "x.s.end0", "x.before")


def _blocks(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BLOCK), F.floor(end / BLOCK)))


def coding_sequences(feats: DataFrame, docs: DataFrame) -> DataFrame:
    """feats with a column coding: the bases of their exons in reading order, reverse complemented on strand -1, from the base that
    codon_start (a column of feats, 1 to 3; anything else counts as 1) names.

    Molecules travel in blocks, which exons meet by equality, so no molecule is copied to each of its features and a chromosome is
    many rows. Features without bases, or of no molecule in docs (doc_id, seq), have an empty coding sequence.
    """
    parts = exons(feats).filter("end0 > start0").withColumn("block", _blocks(F.col("start0"), F.col("end0") - 1))
    text = docs.select("doc_id", F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("block", "bases")).withColumn("block", F.col("block").cast("long"))
    at = F.col("block") * BLOCK
    first = F.greatest(F.col("start0") - at, F.lit(0))
    piece = F.substr("bases", first + 1, F.least(F.col("end0") - at, F.lit(BLOCK)) - first)
    found = parts.join(text, ["doc_id", "block"]).select("doc_id", "feature_id", F.struct("exon", "block", piece.alias("bases")).alias("p"))
    joined = found.groupBy("doc_id", "feature_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["bases"]), "").alias("__bases"))
    skip = F.when(F.col("codon_start").isin(2, 3), F.col("codon_start") - 1).otherwise(0)
    bases = F.coalesce("__bases", F.lit(""))
    out = feats.join(joined, ["doc_id", "feature_id"], "left")
    return out.withColumn("coding", F.substr(F.when(F.col("strand") == -1, reverse_complement(bases)).otherwise(bases), skip + 1)).drop("__bases")


def edited_codons(feats: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, feature_id, edit_ids, first_codon) of the features that edits (doc_id, edit_id, edit_start, edit_end) touch.

    first_codon is the smallest number, from 1, of a codon that holds the first base of an edit in the feature's own direction; the
    codon that begins before codon_start counts as 0. An empty edit (an insertion) touches the exons it lies in or at the edge of,
    and is at the base behind it, or at the last base of the exon. Exons and edits meet by block.
    """
    e = exons(feats)
    size = F.sum(F.col("end0") - F.col("start0")).alias("size")
    length = e.groupBy("doc_id", "feature_id").agg(size)
    left = e.filter("end0 > start0").withColumn("block", _blocks(F.col("start0"), F.col("end0")))
    right = edits.withColumn("block", _blocks(F.col("edit_start"), F.greatest("edit_start", F.col("edit_end") - 1)))
    empty = F.col("edit_start") == F.col("edit_end")
    touches = F.when(empty, F.col("edit_start").between(F.col("start0"), F.col("end0"))).otherwise((F.col("start0") < F.col("edit_end")) & (F.col("edit_start") < F.col("end0")))
    last = F.col("end0") - 1
    base = F.when(empty, F.least("edit_start", last)).when(F.col("strand") == -1, F.least(F.col("edit_end") - 1, last)).otherwise(F.greatest("edit_start", "start0"))
    hits = left.join(right, ["doc_id", "block"]).filter(touches).select("doc_id", "feature_id", "edit_id", (F.col("before") + base - F.col("start0")).alias("at"))
    hits = hits.groupBy("doc_id", "feature_id").agg(F.array_sort(F.collect_set("edit_id")).alias("edit_ids"), F.min("at").alias("low"), F.max("at").alias("high"))
    start = feats.select("doc_id", "feature_id", "strand", F.when(F.col("codon_start").isin(2, 3), F.col("codon_start") - 1).otherwise(0).alias("skip"))
    at = F.when(F.col("strand") == -1, F.col("size") - 1 - F.col("high")).otherwise(F.col("low")) - F.col("skip")
    return hits.join(length, ["doc_id", "feature_id"]).join(start, ["doc_id", "feature_id"]).select("doc_id", "feature_id", "edit_ids", (F.floor(at / 3) + 1).alias("first_codon"))


def effects(before: Column, after: Column, p: Column, q: Column) -> Column:
    """All effects that hold of a change between two coding sequences with the proteins p and q, in the order of KINDS."""
    grown = F.length(after) - F.length(before)
    stop = lambda t: F.when(F.instr(t, "*") > 0, F.instr(t, "*")).otherwise(F.lit(2_147_483_647))
    whole, same, starts = grown % 3 == 0, p == q, lambda t: F.left(t, F.lit(1)) == "M"
    holds = {
        "frameshift": ~whole,
        "nonsense": stop(q) < stop(p),
        "stop_lost": stop(q) > stop(p),
        "start_lost": starts(p) & ~starts(q),
        "inframe_insertion": whole & (grown > 0),
        "inframe_deletion": whole & (grown < 0),
        "missense": ~same & (stop(p) == stop(q)),
        "synonymous": same,
    }
    return F.array_compact(F.array(*[F.when(holds[k], k) for k in KINDS if k in holds]))


def first_difference(p: Column, q: Column) -> Column:
    """Place, from 1, of the first amino acid that differs, the end of the shorter protein included; null if there is none."""
    letters = F.arrays_zip(F.split(p, "").alias("p"), F.split(q, "").alias("q"))
    at = F.array_position(F.transform(letters, lambda x: ~x["p"].eqNullSafe(x["q"])), True)
    return F.when(p.isNull() | q.isNull() | (p == q), None).when((p == "") | (q == ""), 1).otherwise(at)


def consequences(reference: DataFrame, query: DataFrame, ref_docs: DataFrame, qry_docs: DataFrame, edits: DataFrame) -> DataFrame:
    """One row for each coding feature of reference that an edit touches: (doc_id, feature_id, kinds, table, ref_length, qry_length,
    ref_protein, qry_protein, first_affected, ref_window, qry_window, edit_ids, first_codon).

    reference and query (doc_id, feature_id, strand, segments, n, topology, codon_start, table) are paired by feature_id: give the
    query's matched features the ids of their partners. Feature ids are unique in a molecule. table is that of the reference's
    feature: 2 and 11 are themselves, all else 1; the windows hold two amino acids to each side of the first that differs. A feature without partner
    has coding_sequence_change, and nulls for the query.
    """
    touched = edited_codons(reference, edits)
    keep = touched.select("doc_id", "feature_id")
    code = F.when(F.col("table").isin(2, 11), F.col("table")).otherwise(1).cast("int")
    a = coding_sequences(reference.join(keep, ["doc_id", "feature_id"], "left_semi"), ref_docs).select("doc_id", "feature_id", code.alias("table"), F.col("coding").alias("a"))
    b = coding_sequences(query.join(keep, ["doc_id", "feature_id"], "left_semi"), qry_docs).select("doc_id", "feature_id", F.col("coding").alias("b"))
    both = a.join(b, ["doc_id", "feature_id"], "left").withColumn("p", translate_codons(F.col("a"), F.col("table"))).withColumn("q", translate_codons(F.col("b"), F.col("table")))
    both = both.withColumn("first_affected", first_difference(F.col("p"), F.col("q")).cast("long"))
    kinds = F.when(F.col("b").isNull(), F.array(F.lit(KINDS[-1]))).otherwise(effects(F.col("a"), F.col("b"), F.col("p"), F.col("q")))
    low = F.greatest(F.col("first_affected") - 3, F.lit(0))
    window = lambda t: F.coalesce(F.substr(t, low + 1, F.col("first_affected") + 2 - low), F.lit(""))
    return both.join(touched, ["doc_id", "feature_id"]).select(
        "doc_id", "feature_id", kinds.alias("kinds"), "table", F.length("a").cast("long").alias("ref_length"), F.length("b").cast("long").alias("qry_length"), F.col("p").alias("ref_protein"), F.col("q").alias("qry_protein"),
        "first_affected", window("p").alias("ref_window"), window("q").alias("qry_window"), "edit_ids", "first_codon",
    )
