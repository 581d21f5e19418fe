"""Inputs of the queries, derived from the driver's tables, and the same derivations as SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.batches import pieces

_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bases(text):
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), _LETTERS, _BASES)


def _bases(batches):
    """A pass over batches (doc_id, text in lower case): (doc_id, seq, n), by a look-up of bytes, as a pattern took most of a query's time."""
    base = np.zeros(256, np.uint8)
    base[[ord(c) for c in _LETTERS]] = [ord(c) for c in _BASES]
    for b in pieces(batches):
        text = b.column(1).cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        found = base[np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
        kept = np.flatnonzero(found)
        at = np.searchsorted(kept, ends - ends[0])
        seq = pa.Array.from_buffers(pa.string(), len(text), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(found[kept])])
        yield pa.RecordBatch.from_arrays([b.column(0), seq, pa.array(np.diff(at), pa.int64())], names=["doc_id", "seq", "n"])


def sequences(spark: SparkSession, sf_dir: str, least: int = 20) -> DataFrame:
    """doc_id, topology, seq, n: one molecule per document of at least `least` bases; even ids are circular."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.lower("text").alias("text"))
    d = d.mapInArrow(_bases, f"doc_id {dict(d.dtypes)['doc_id']}, seq string, n bigint").filter(F.col("n") >= least)
    return d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "circular").otherwise("linear").alias("topology"), "seq", "n")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, category, motif: the bases of each benchmark item, reverse complemented for odd items."""
    m = bases(F.col("text"))
    odd = F.reverse(F.translate(m, "ACGT", "TGCA"))
    p = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 3).alias("category"), F.when(F.col("item_id") % 2 == 1, odd).otherwise(m).alias("motif"))
    return p.filter(F.length("motif") > 0)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, feature_id, type, strand, start0, end0, n, topology, segments: placed by the line items; circular ones may wrap."""
    items = table(spark, sf_dir, "lineitem")
    seqs = sequences(spark, sf_dir).select("doc_id", "topology", "n")
    total = F.broadcast(table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("docs")))
    order = W.partitionBy("doc_id").orderBy(*[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")])
    placed = items.join(total).withColumn("doc_id", F.col("l_orderkey") % F.col("docs")).join(seqs, "doc_id")
    f = placed.select(
        "doc_id", F.row_number().over(order).cast("long").alias("feature_id"), "topology", "n",
        F.when(F.col("l_returnflag") == "A", "CDS").when(F.col("l_returnflag") == "N", "promoter").otherwise("misc_feature").alias("type"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).cast("long").alias("strand"),
        (F.col("l_partkey") * 97 % F.col("n")).alias("start0"), F.least(30 + 3 * F.col("l_quantity").cast("long"), F.col("n")).alias("len"),
    )
    over = F.col("start0") + F.col("len") > F.col("n")
    end = F.when(~over, F.col("start0") + F.col("len")).when(F.col("topology") == "linear", F.col("n")).otherwise(F.col("start0") + F.col("len") - F.col("n"))
    f = f.withColumn("end0", end).withColumn("wraps", over & (F.col("topology") == "circular"))
    seg = lambda a, b: F.struct(a.cast("long").alias("start0"), b.cast("long").alias("end0"))
    return f.withColumn("segments", F.when(F.col("wraps"), F.array(seg(F.col("start0"), F.col("n")), seg(F.lit(0), F.col("end0")))).otherwise(F.array(seg(F.col("start0"), F.col("end0"))))).drop("len")


SEQUENCES = f"""
all_seq AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'circular' ELSE 'linear' END AS topology,
         translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_LETTERS}', '{_BASES}') AS seq FROM documents
), s AS (SELECT *, CAST(length(seq) AS BIGINT) AS n FROM all_seq WHERE length(seq) >= 20)"""

PANEL = f"""
panel0 AS (
  SELECT item_id, item_id % 3 AS category, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_LETTERS}', '{_BASES}') AS m FROM benchmark
), panel AS (
  SELECT item_id, category, CASE WHEN item_id % 2 = 1 THEN reverse(translate(m, 'ACGT', 'TGCA')) ELSE m END AS motif FROM panel0 WHERE length(m) > 0
)"""

FEATURES = """
f0 AS (
  SELECT s.doc_id, s.topology, s.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS feature_id,
         CASE l_returnflag WHEN 'A' THEN 'CDS' WHEN 'N' THEN 'promoter' ELSE 'misc_feature' END AS type,
         CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS BIGINT) AS strand,
         l_partkey * 97 % s.n AS start0, least(30 + 3 * CAST(trunc(l_quantity) AS BIGINT), s.n) AS len
  FROM lineitem JOIN s ON l_orderkey % (SELECT count(*) FROM documents) = s.doc_id
), f AS (
  SELECT doc_id, topology, n, feature_id, type, strand, start0, start0 + len > n AND topology = 'circular' AS wraps,
         CASE WHEN start0 + len <= n THEN start0 + len WHEN topology = 'linear' THEN n ELSE start0 + len - n END AS end0 FROM f0
), fs AS (
  SELECT doc_id, feature_id, type, strand, n, 1 AS k, start0 AS a, CASE WHEN wraps THEN n ELSE end0 END AS b FROM f
  UNION ALL SELECT doc_id, feature_id, type, strand, n, 2, 0, end0 FROM f WHERE wraps
)"""
