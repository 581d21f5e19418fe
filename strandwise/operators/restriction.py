"""Restriction sites, cutter classes and enzyme lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import find, strand_patterns, with_patterns

_KINDS = {"enzyme_id": "string", "strand": "bigint", "width": "int", "fwd": "bigint", "rev": "bigint"}


def restriction_sites(docs: DataFrame, enzymes: list[dict]) -> DataFrame:
    """(doc_id, topology, n, enzyme_id, strand, start0, end0, fwd_cut0, rev_cut0) of every site of the enzymes in docs (doc_id, topology, seq, n).

    Ambiguous bases match if they share a base with the site's. Palindromic sites are reported once, on strand 1. Cuts are taken
    modulo the length on linear molecules too.
    """
    patterns = strand_patterns([{"enzyme_id": e["enzyme_id"], "motif": e["recognition"], "fwd": e["fwd_cut"], "rev": e["rev_cut"]} for e in enzymes])
    hits = find(docs.select("doc_id", "topology", "n", "seq"), patterns, _KINDS).withColumn("end_", F.col("start0") + F.col("width"))
    n, end = F.col("n"), F.when(F.col("end_") <= F.col("n"), F.col("end_")).otherwise(F.col("end_") % F.col("n"))
    fwd = F.when(F.col("strand") == 1, F.col("start0") + F.col("fwd")).otherwise(F.col("end_") - F.col("rev"))
    rev = F.when(F.col("strand") == 1, F.col("start0") + F.col("rev")).otherwise(F.col("end_") - F.col("fwd"))
    return hits.select("doc_id", "topology", "n", "enzyme_id", "strand", "start0", end.alias("end0"), F.pmod(fwd, n).alias("fwd_cut0"), F.pmod(rev, n).alias("rev_cut0"))


def site_counts(docs: DataFrame, sites: DataFrame, enzymes: list[dict]) -> DataFrame:
    """(doc_id, enzyme_id, n_sites) for every document and enzyme, zeros included."""
    every = with_patterns(docs.select("doc_id"), enzymes, {"enzyme_id": "string"})
    counted = sites.groupBy("doc_id", "enzyme_id").agg(F.count(F.lit(1)).alias("n_sites"))
    return every.join(counted, ["doc_id", "enzyme_id"], "left").withColumn("n_sites", F.coalesce("n_sites", F.lit(0)))


def cutter_class(n_sites: Column) -> Column:
    return F.when(n_sites == 0, "non").when(n_sites == 1, "unique").when(n_sites == 2, "double").otherwise("multiple")


def end_type(fwd: Column, rev: Column) -> Column:
    return F.when(fwd < rev, "5' overhang").when(fwd > rev, "3' overhang").otherwise("blunt")


def lookup(terms: DataFrame, enzymes: DataFrame) -> DataFrame:
    """terms (term, and any other columns) with enzyme_id: by id or name, else by another name (the last enzyme of that name), in any case; else null."""
    own = enzymes.select(F.lower("name").alias("key"), "enzyme_id", F.lit(0).alias("tier"), F.lit(0).alias("ord"))
    other = enzymes.select(F.explode("aliases").alias("key"), "enzyme_id", F.lit(1).alias("tier"), "ord").withColumn("key", F.lower("key"))
    first = W.partitionBy("key").orderBy("tier", F.desc("ord"))
    keys = own.unionByName(other).withColumn("r", F.row_number().over(first)).filter("r = 1").select("key", "enzyme_id")
    return terms.join(F.broadcast(keys), F.lower(F.trim("term")) == F.col("key"), "left").select(*[terms[c] for c in terms.columns], keys["enzyme_id"])


def suggest(terms: DataFrame, enzymes: DataFrame, most: int = 5) -> DataFrame:
    """Up to `most` enzymes for each term: names or other names that begin with it, then those that hold it, then those within two
    edits. A trailing 1, 2 or 3 is read as a Roman number."""
    t = F.lower(F.trim("term"))
    for digit, roman in (("1", "i"), ("2", "ii"), ("3", "iii")):
        t = F.regexp_replace(t, digit + "$", roman)
    names = enzymes.withColumn("names", F.transform(F.concat(F.array("name"), F.col("aliases")), lambda x: F.lower(x)))
    pairs = terms.withColumn("t", t).join(F.broadcast(names))
    tier = (
        F.when(F.exists("names", lambda x: x.startswith(F.col("t"))), 0)
        .when(F.exists("names", lambda x: F.contains(x, F.col("t"))), 1)
        .when(F.levenshtein("t", F.lower("name")) <= 2, 2)
    )
    ranked = pairs.withColumn("tier", tier).filter("tier is not null").withColumn("rank", F.row_number().over(W.partitionBy("term").orderBy("tier", F.levenshtein("t", F.lower("name")), "enzyme_id")))
    return ranked.filter(F.col("rank") <= most).select("term", F.col("rank").cast("long").alias("rank"), "enzyme_id", F.col("tier").cast("long").alias("tier"))


def enzyme_filter(table: DataFrame, text: str = "", categories: tuple[str, ...] = ()) -> DataFrame:
    """Enzymes of a table (enzyme_id, name, aliases, category) whose name or another name holds the text in any case, of these categories
    (none: of all)."""
    want = text.strip().lower()
    named = F.contains(F.lower("name"), F.lit(want)) | F.coalesce(F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(want))), F.lit(False))
    return table.filter(named & F.col("category").isin(*categories) if categories else named)
