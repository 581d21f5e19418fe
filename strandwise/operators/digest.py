"""Digests: cuts, fragments, end chemistry, compatible ends and two-fragment cloning plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nt import let, reverse_complement, subsequence


def cuts(sites: DataFrame) -> DataFrame:
    """(doc_id, topology, n, cut0, n_sites, rev_cut0, ambiguous): distinct forward cuts; the reverse cut of the first site there."""
    first = F.min(F.struct("start0", "enzyme_id", "strand", "rev_cut0"))
    c = sites.groupBy("doc_id", "topology", "n", F.col("fwd_cut0").alias("cut0")).agg(F.count(F.lit(1)).alias("n_sites"), first.alias("f"), F.countDistinct("rev_cut0").alias("d"))
    return c.select("doc_id", "topology", "n", "cut0", "n_sites", F.col("f.rev_cut0").alias("rev_cut0"), F.col("f.enzyme_id").alias("enzyme_id"), (F.col("d") > 1).alias("ambiguous"))


def fragments(docs: DataFrame, cut_table: DataFrame) -> DataFrame:
    """(doc_id, fragment_no, start0, end0, length, left_cut, right_cut) of every document; a cut is null at a natural end.

    No cut leaves one fragment. k cuts leave k + 1 fragments of a linear molecule (a cut at 0 leaves an empty first one) and k of a
    circular one, the last through the origin.
    """
    # the cuts of a molecule are one row, so that the table of cuts is made and read once
    at = cut_table.groupBy("doc_id").agg(F.sort_array(F.collect_list("cut0")).alias("at"))
    c = docs.select("doc_id", "topology", "n").join(at, "doc_id", "left")
    size = F.size("at")
    piece = lambda no, a, b, length, left, right: F.struct(*[x.cast("long").alias(k) for k, x in (("fragment_no", no), ("start0", a), ("end0", b), ("length", length), ("left_cut", left), ("right_cut", right))])
    none, zero, n = F.lit(None), F.lit(0), F.col("n")
    uncut = F.array(piece(F.lit(1), zero, n, n, none, none))
    head = F.array(piece(F.lit(1), zero, F.get("at", zero), F.get("at", zero), none, F.get("at", zero)))
    following = lambda i: F.get("at", i + 1)
    rest = F.transform("at", lambda x, i: piece(i + 2, x, F.coalesce(following(i), n), F.coalesce(following(i), n) - x, x, following(i)))
    around = F.transform("at", lambda x, i: let(F.coalesce(following(i), F.get("at", zero)), lambda y: piece(i + 1, x, y, y - x + F.when(i + 1 == size, n).otherwise(0), x, y)))
    pieces = F.when(F.col("at").isNull(), uncut).when(F.col("topology") == "circular", around).when(F.col("topology") == "linear", F.concat(head, rest))
    return c.select("doc_id", F.explode(pieces).alias("x")).select("doc_id", "x.*")


def signed_distance(fwd: Column, rev: Column, n: Column, topology: Column) -> Column:
    """rev - fwd; the short way round on a circular molecule."""
    d = rev - fwd
    return F.when(topology != "circular", d).when(d * 2 > n, d - n).when(d * 2 < -n, d + n).otherwise(d)


def cut_ends(docs: DataFrame, cut_table: DataFrame) -> DataFrame:
    """(doc_id, cut0, end_type, overhang, left_overhang, right_overhang, ambiguous): the single strand of a cut, read on its strand."""
    # a molecule meets its cuts once, as one row, so that no sequence is copied to each cut
    own = cut_table.withColumn("d", signed_distance(F.col("cut0"), F.col("rev_cut0"), F.col("n"), F.col("topology")))
    own = own.groupBy("doc_id", "n").agg(F.collect_list(F.struct("cut0", "d", "ambiguous", F.when(F.col("d") >= 0, F.col("cut0")).otherwise(F.col("rev_cut0")).alias("a"))).alias("cuts"))
    j = own.join(docs.select("doc_id", "seq"), "doc_id")

    def text(c):
        end = F.pmod(c["a"] + F.abs(c["d"]), F.col("n"))
        return F.when(c["d"] == 0, "").otherwise(subsequence(F.col("seq"), c["a"], F.when(end == 0, F.col("n")).otherwise(end)))

    c = j.select("doc_id", F.explode(F.transform("cuts", lambda c: F.struct(c["cut0"].alias("cut0"), c["d"].alias("d"), c["ambiguous"].alias("ambiguous"), text(c).alias("overhang")))).alias("x")).select("doc_id", "x.*")
    size = F.abs("d")
    kind = F.when(F.col("ambiguous"), "ambiguous").when(F.col("d") > 0, "5' overhang").when(F.col("d") < 0, "3' overhang").otherwise("blunt")
    c = c.withColumn("end_type", kind)
    left = F.when(F.col("d") > 0, reverse_complement(F.col("overhang"))).otherwise(F.col("overhang"))
    right = F.when(F.col("d") < 0, reverse_complement(F.col("overhang"))).otherwise(F.col("overhang"))
    return c.select("doc_id", "cut0", "end_type", size.alias("overhang_len"), left.alias("left_overhang"), right.alias("right_overhang"), "ambiguous")


def compatible(type_a: Column, a: Column, type_b: Column, b: Column) -> Column:
    """Whether two ends anneal: both blunt, or the same polarity with one overhang the other's reverse complement."""
    sticky = type_a.isin("5' overhang", "3' overhang")
    return F.coalesce(((type_a == "blunt") & (type_b == "blunt")) | (sticky & (type_a == type_b) & (a == reverse_complement(b))), F.lit(False))


def clone_plans(pairs: DataFrame, frags: DataFrame, ends: DataFrame) -> DataFrame:
    """For each pair (vector_id, insert_id): the longest vector fragment with two cut ends, the longest such insert fragment, and
    whether it ligates forward or reversed. error_code names what is missing."""
    cut = frags.filter("left_cut is not null and right_cut is not null and length > 0")
    best = cut.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("length"), "fragment_no"))).filter("r = 1")
    e = ends.select("doc_id", "cut0", "end_type", "left_overhang", "right_overhang")
    # a fragment's left end is the right side of its left cut
    sides = best.join(e.select("doc_id", F.col("cut0").alias("left_cut"), F.col("end_type").alias("lt"), F.col("right_overhang").alias("lo")), ["doc_id", "left_cut"])
    sides = sides.join(e.select("doc_id", F.col("cut0").alias("right_cut"), F.col("end_type").alias("rt"), F.col("left_overhang").alias("ro")), ["doc_id", "right_cut"])
    side = lambda p: sides.select(F.col("doc_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("length", "lt", "lo", "rt", "ro")])
    j = pairs.join(side("vector"), "vector_id", "left").join(side("insert"), "insert_id", "left")
    c = lambda n: F.col(n)
    fwd = compatible(c("vector_rt"), c("vector_ro"), c("insert_lt"), c("insert_lo")) & compatible(c("insert_rt"), c("insert_ro"), c("vector_lt"), c("vector_lo"))
    rev = compatible(c("vector_rt"), c("vector_ro"), c("insert_rt"), c("insert_ro")) & compatible(c("insert_lt"), c("insert_lo"), c("vector_lt"), c("vector_lo"))
    error = F.when(c("vector_length").isNull(), "NO_VECTOR_CUT").when(c("insert_length").isNull(), "NO_INSERT_CUT").when(~(fwd | rev), "INCOMPATIBLE_ENDS")
    return j.select("vector_id", "insert_id", "vector_length", "insert_length", fwd.alias("forward"), rev.alias("reverse"), F.when(fwd | rev, c("vector_length") + c("insert_length")).alias("product_length"), error.alias("error_code"))
