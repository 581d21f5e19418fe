"""Queries that compare two versions of a molecule and its features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, diff, edit, matching
from ..plans.fixtures import FEATURES, SEQUENCES, features as feature_table, sequences


def _named(spark, d):
    return feature_table(spark, d).withColumn("name", F.concat("type", F.lit(" "), (F.col("feature_id") % 7).cast("string")))


def _revised(spark, d):
    """Features after a revision: a fifth is gone, two of three have new ids, every second that can has moved, every fourth name is in
    capitals, and every eleventh feature has a copy nearby."""
    f, i = _named(spark, d), F.col("feature_id")
    far = i * 7 % 40
    moved = F.transform("segments", lambda s: F.struct((s["start0"] + far).alias("start0"), (s["end0"] + far).alias("end0")))
    free = (F.size("segments") == 1) & (F.col("end0") + far <= F.col("n"))
    f = f.withColumn("segments", F.when((i % 2 == 0) & free, moved).otherwise(F.col("segments")))
    kept = f.filter(i % 5 != 0).withColumn("name", F.when(i % 4 == 0, F.upper("name")).otherwise(F.col("name")))
    copies = f.filter(i % 11 == 0).withColumn("feature_id", i + 2_000_000)
    return kept.withColumn("feature_id", F.when(i % 3 == 0, i).otherwise(i + 1_000_000)).unionByName(copies)


def feature_match(spark, d):
    """Each molecule's features against those of a revision, most of which have other ids."""
    return matching.compare(_named(spark, d), _revised(spark, d), sequences(spark, d).select("doc_id", "n", "topology"))


def _neighbours(spark, d):
    """Each molecule, and the same with a base changed, two deleted five bases on, and two inserted four bases after these."""
    s = sequences(spark, d).select("doc_id", F.col("seq").alias("reference"), F.pmod(F.col("doc_id") * 29, F.col("n") - 19).cast("int").alias("p"))
    part = lambda a, n: F.substr("reference", F.col("p") + a + 1, F.lit(n))
    query = F.concat(F.substr("reference", F.lit(1), F.col("p")), F.translate(part(0, 1), "ACGT", "TGCA"), part(1, 5), part(8, 4), F.lit("GA"), F.substr("reference", F.col("p") + 13))
    return s.withColumn("query", query)


def realigned_differences(spark, d):
    """Neighbouring changes in every molecule: edits after re-alignment, and whether they give the query."""
    found = diff.realigned_pairs(_neighbours(spark, d), keep=("reference",))
    total = F.aggregate("differences", F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.length(x["ref_bases"]), F.length(x["qry_bases"])))
    return align.rebuilt_pairs(found).select("doc_id", total.alias("edit_distance"), F.sha2("query", 256).alias("sha256"))


def alignment(spark, d):
    """Whole molecules against themselves with a base changed, five deleted or five inserted."""
    s = sequences(spark, d).select("doc_id", F.col("seq").alias("reference"), F.pmod(F.col("doc_id") * 23, F.col("n") - 5).cast("int").alias("p"))
    t, p, k = F.col("reference"), F.col("p"), F.col("doc_id") % 3
    one = edit.replace_range(t, p, p + 1, F.translate(F.substr(t, p + 1, F.lit(1)), "ACGT", "TGCA"))
    pairs = s.select("doc_id", "reference", F.when(k == 0, one).when(k == 1, edit.delete_range(t, p, p + 5)).otherwise(edit.insert_text(t, p, F.lit("ACGTT"))).alias("query"))
    a = align.alignments(pairs, keep=("reference", "query"))
    whole = (F.replace("aligned_reference", F.lit("-"), F.lit("")) == F.col("reference")) & (F.replace("aligned_query", F.lit("-"), F.lit("")) == F.col("query"))
    return a.select("doc_id", "matches", "score", F.length("aligned_query").cast("long").alias("n_columns"), "identity_percent", whole.alias("whole"))


_REVISED = """
rf AS (
  SELECT doc_id, topology, n, feature_id, type || ' ' || (feature_id % 7) AS name, type, strand, start0, wraps, end0, CASE WHEN wraps THEN n - start0 + end0 ELSE end0 - start0 END AS size FROM f
), mv AS (
  SELECT *, CASE WHEN feature_id % 2 = 0 AND NOT wraps AND end0 + feature_id * 7 % 40 <= n THEN feature_id * 7 % 40 ELSE 0 END AS far FROM rf
), qf AS (
  SELECT doc_id, CASE WHEN feature_id % 3 = 0 THEN feature_id ELSE feature_id + 1000000 END AS feature_id, CASE WHEN feature_id % 4 = 0 THEN upper(name) ELSE name END AS name, type, strand, start0 + far AS start0, wraps, end0 + far AS end0, size FROM mv WHERE feature_id % 5 <> 0
  UNION ALL SELECT doc_id, feature_id + 2000000, name, type, strand, start0 + far, wraps, end0 + far, size FROM mv WHERE feature_id % 11 = 0
), cand AS (
  SELECT doc_id, rid, list(qid ORDER BY score DESC, qs, qid) AS cs FROM (
    SELECT rf.doc_id, rf.feature_id AS rid, qf.feature_id AS qid, qf.start0 AS qs, CASE WHEN rf.feature_id = qf.feature_id THEN 1000000 ELSE 100000 - abs(rf.start0 - qf.start0) END AS score
    FROM rf JOIN qf ON rf.doc_id = qf.doc_id AND (rf.feature_id = qf.feature_id OR (lower(rf.name) = lower(qf.name) AND rf.type = qf.type))
  ) WHERE score >= 0 GROUP BY ALL
), sq AS (
  SELECT rf.doc_id, rf.feature_id AS rid, row_number() OVER (PARTITION BY rf.doc_id ORDER BY rf.start0, rf.name, rf.feature_id) AS i, coalesce(cs, []) AS cs FROM rf LEFT JOIN cand ON rf.doc_id = cand.doc_id AND rf.feature_id = cand.rid
), m AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS rid, CAST(NULL AS BIGINT) AS qid FROM rf
  UNION ALL
  SELECT doc_id, i, CASE WHEN qid IS NULL THEN used ELSE list_append(used, qid) END, rid, qid
  FROM (SELECT sq.doc_id, sq.i, used, sq.rid, list_filter(cs, lambda c: NOT list_contains(used, c))[1] AS qid FROM m JOIN sq ON sq.doc_id = m.doc_id AND sq.i = m.i + 1)
), j AS (
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.feature_id AS rid, b.feature_id AS qid, a.name AS an, b.name AS bn, a.type AS ta, b.type AS tb, a.strand AS asd, b.strand AS bsd, a.start0 AS sa, b.start0 AS sb, a.wraps AS wa, b.wraps AS wb, a.end0 AS ea, b.end0 AS eb, a.size AS za, b.size AS zb
  FROM (SELECT rf.*, m.qid FROM rf LEFT JOIN m ON rf.doc_id = m.doc_id AND rf.feature_id = m.rid) a FULL JOIN qf b ON a.doc_id = b.doc_id AND a.qid = b.feature_id
), ch AS (
  SELECT j.*, s.n, s.topology, CASE WHEN rid IS NULL OR qid IS NULL THEN '' ELSE concat_ws(',', CASE WHEN an <> bn THEN 'name' END, CASE WHEN ta <> tb THEN 'type' END, CASE WHEN sa <> sb OR ea <> eb OR wa <> wb THEN 'coordinates' END, CASE WHEN asd <> bsd THEN 'strand' END) END AS changes FROM j JOIN s USING (doc_id)
)"""


def _w(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes)


QUERIES = {f.__name__: f for f in (feature_match, realigned_differences, alignment)}

ORACLE_SQL = {
    "feature_match": _w(SEQUENCES, FEATURES, _REVISED) + """
SELECT doc_id, rid AS reference_id, qid AS query_id, CASE WHEN qid IS NULL THEN 'removed' WHEN rid IS NULL THEN 'added' WHEN changes <> '' THEN 'modified' ELSE 'unchanged' END AS kind, changes,
       CASE WHEN topology <> 'circular' THEN sb - sa WHEN (sb - sa) * 2 > n THEN sb - sa - n WHEN (sb - sa) * 2 < -n THEN sb - sa + n ELSE sb - sa END AS shift, coalesce(zb, 0) - coalesce(za, 0) AS length_delta
FROM ch""",
    "realigned_differences": _w(SEQUENCES) + """, x AS (SELECT doc_id, seq, doc_id * 29 % (n - 19) AS p FROM s), y AS (SELECT doc_id, seq, p, substr(seq, 1, p) || translate(substr(seq, p + 1, 1), 'ACGT', 'TGCA') || substr(seq, p + 2, 5) || substr(seq, p + 9, 4) || 'GA' || substr(seq, p + 13) AS q FROM x)
SELECT doc_id, levenshtein(substr(seq, greatest(1, p - 60), CASE WHEN p > 60 THEN 140 ELSE p + 79 END), substr(q, greatest(1, p - 60), CASE WHEN p > 60 THEN 140 ELSE p + 79 END)) AS edit_distance, sha256(q) AS sha256 FROM y""",
    "alignment": _w(SEQUENCES) + """ SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN n - 1 WHEN 1 THEN n - 5 ELSE n END AS matches, CASE doc_id % 3 WHEN 0 THEN 2 * n - 3 WHEN 1 THEN 2 * n - 20 ELSE 2 * n - 10 END AS score,
CASE doc_id % 3 WHEN 2 THEN n + 5 ELSE n END AS n_columns, CASE doc_id % 3 WHEN 0 THEN (n - 1) * 100.0::DOUBLE / n WHEN 1 THEN (n - 5) * 100.0::DOUBLE / n ELSE n * 100.0::DOUBLE / (n + 5) END AS identity_percent, true AS whole FROM s""",
}
