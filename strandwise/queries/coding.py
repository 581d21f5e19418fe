"""Queries on spliced coding sequences: what edits of whole molecules do to the proteins of their features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import codons
from ..operators import coding
from ..plans.fixtures import FEATURES, SEQUENCES, features as feature_table, sequences
from ..plans.rounds import cut
from .editing import _RC

_EACH = 50


def _coding_features(spark, d):
    """The CDS features: those of 60 bases or more that don't wrap have an intron, their middle third."""
    f = feature_table(spark, d).filter("type = 'CDS'")
    third = F.floor((F.col("end0") - F.col("start0")) / 3)
    seg = lambda a, b: F.struct(a.alias("start0"), b.alias("end0"))
    spliced = F.array(seg(F.col("start0"), F.col("start0") + third), seg(F.col("end0") - third, F.col("end0")))
    f = f.withColumn("segments", F.when((F.col("end0") - F.col("start0") >= 60) & ~F.col("wraps"), spliced).otherwise(F.col("segments")))
    table = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(11)), (F.col("doc_id") % 3 + 1).cast("int"))
    return f.select("doc_id", "feature_id", "strand", "segments", "n", "topology", (F.col("feature_id") % 3 + 1).alias("codon_start"), table.alias("table"))


def _edited(spark, d):
    """Molecules with every fiftieth base complemented, and then one or three bases deleted or inserted at p, by the id."""
    s = sequences(spark, d).withColumn("p", F.col("doc_id") * 31 % (F.col("n") - 4)).withColumn("k", F.col("doc_id") % 5)
    s = s.withColumn("gone", F.when(F.col("k") == 1, 1).when(F.col("k") == 2, 3).otherwise(0)).withColumn("new", F.when(F.col("k") == 3, "A").when(F.col("k") == 4, "ACG").otherwise(""))
    parts = F.regexp_extract_all("seq", F.lit(f".{{1,{_EACH}}}"), F.lit(0))
    changed = F.array_join(F.transform(parts, lambda x: F.concat(F.left(x, F.lit(_EACH - 1)), F.translate(F.substr(x, F.lit(_EACH)), "ACGT", "TGCA"))), "")
    p = F.col("p").cast("int")
    return s.withColumn("edited", changed).withColumn("edited", F.concat(F.substr("edited", F.lit(1), p), "new", F.substr("edited", p + F.col("gone") + 1)))


def cds_consequences(spark, d):
    """Effects on every CDS feature that an edit touches; every thirteenth is gone from the edited molecule."""
    # the features are asked for six times and made once
    mols, f = _edited(spark, d), cut(_coding_features(spark, d))
    size = F.col("gone") - F.length("new")
    moved = lambda x: F.when(x <= F.col("p"), x).otherwise(F.greatest(x - size, F.col("p")))
    revised = f.filter(F.col("feature_id") % 13 != 0).join(mols.select("doc_id", "p", "gone", "new"), "doc_id")
    revised = revised.withColumn("segments", F.transform("segments", lambda s: F.struct(moved(s["start0"]).alias("start0"), moved(s["end0"]).alias("end0")))).withColumn("n", F.col("n") - size)
    points = mols.filter(F.col("n") >= _EACH).select("doc_id", F.explode(F.sequence(F.lit(_EACH - 1).cast("long"), F.col("n") - 1, F.lit(_EACH).cast("long"))).alias("edit_start"))
    points = points.select("doc_id", F.floor(F.col("edit_start") / _EACH).alias("edit_id"), "edit_start", (F.col("edit_start") + 1).alias("edit_end"))
    edits = points.unionByName(mols.filter("k > 0").select("doc_id", F.lit(-1).cast("long").alias("edit_id"), F.col("p").alias("edit_start"), (F.col("p") + F.col("gone")).alias("edit_end")))
    out = coding.consequences(f, revised, mols.select("doc_id", "seq"), mols.select("doc_id", F.col("edited").alias("seq")), edits)
    return out.withColumn("kinds", F.array_join("kinds", ",")).withColumn("n_edits", F.size("edit_ids").cast("long")).drop("edit_ids")


def _map(table: int) -> str:
    return "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in codons(table).items()) + "}"


def _protein(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '...'), lambda c: coalesce(CASE WHEN tab = 2 THEN {_map(2)}[c] ELSE {_map(1)}[c] END, 'X')), '')"


_FIRST = "CASE WHEN p <> q THEN list_filter(range(1, greatest(length(p), length(q)) + 1), lambda i: substr(p, i, 1) <> substr(q, i, 1))[1] END"

QUERIES = {"cds_consequences": cds_consequences}

ORACLE_SQL = {
    "cds_consequences": "WITH " + SEQUENCES + "," + FEATURES + f""", x AS (
  SELECT doc_id, n, topology, seq, doc_id * 31 % (n - 4) AS pt, doc_id % 5 AS k, CASE doc_id % 5 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS gone, CASE doc_id % 5 WHEN 3 THEN 'A' WHEN 4 THEN 'ACG' ELSE '' END AS ins,
         array_to_string(list_transform(regexp_extract_all(seq, '.{{1,{_EACH}}}'), lambda c: substr(c, 1, {_EACH - 1}) || translate(substr(c, {_EACH}), 'ACGT', 'TGCA')), '') AS c FROM s
), m AS (SELECT *, gone - length(ins) AS size, substr(c, 1, pt) || ins || substr(c, pt + gone + 1) AS edited FROM x
), fr AS (
  SELECT f.doc_id, feature_id, strand, 1 + feature_id % 3 AS cs, CASE f.doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 11 END AS tab, m.n, m.topology, seq, edited, pt, size,
         CASE WHEN wraps THEN 0 ELSE start0 END AS a1, CASE WHEN wraps THEN end0 WHEN end0 - start0 >= 60 THEN start0 + (end0 - start0) // 3 ELSE end0 END AS b1,
         CASE WHEN wraps THEN start0 WHEN end0 - start0 >= 60 THEN end0 - (end0 - start0) // 3 END AS a2, CASE WHEN wraps THEN f.n WHEN end0 - start0 >= 60 THEN end0 END AS b2
  FROM f JOIN m USING (doc_id) WHERE type = 'CDS'
), sides AS (
  SELECT 'r' AS side, doc_id, feature_id, strand, cs, tab, n, topology, seq, a1, b1, a2, b2 FROM fr
  UNION ALL SELECT 'q', doc_id, feature_id, strand, cs, tab, n - size, topology, edited, CASE WHEN a1 <= pt THEN a1 ELSE greatest(a1 - size, pt) END, CASE WHEN b1 <= pt THEN b1 ELSE greatest(b1 - size, pt) END,
         CASE WHEN a2 <= pt THEN a2 WHEN a2 IS NOT NULL THEN greatest(a2 - size, pt) END, CASE WHEN b2 <= pt THEN b2 WHEN b2 IS NOT NULL THEN greatest(b2 - size, pt) END FROM fr WHERE feature_id % 13 <> 0
), od AS (SELECT *, topology = 'circular' AND a2 IS NOT NULL AND a2 - b1 >= 0 AND a2 - b1 >= a1 + n - b2 AS swapped, substr(seq, a1 + 1, b1 - a1) AS e1, coalesce(substr(seq, a2 + 1, b2 - a2), '') AS e2 FROM sides
), cd AS (SELECT *, CASE WHEN swapped THEN e2 || e1 ELSE e1 || e2 END AS j FROM od
), co AS (SELECT *, substr(CASE WHEN strand = -1 THEN {_RC.format('j')} ELSE j END, cs) AS coding FROM cd
), pr AS (SELECT side, doc_id, feature_id, tab, coding, {_protein('coding')} AS protein FROM co
), ed AS (
  SELECT doc_id, i // {_EACH} AS edit_id, i AS es, i + 1 AS ee FROM (SELECT doc_id, unnest(range({_EACH - 1}, n, {_EACH})) AS i FROM m)
  UNION ALL SELECT doc_id, -1, pt, pt + gone FROM m WHERE k > 0
), rx AS (
  SELECT doc_id, feature_id, strand, cs, a1 AS a, b1 AS b, CASE WHEN swapped THEN b2 - a2 ELSE 0 END AS before, length(j) AS total FROM cd WHERE side = 'r'
  UNION ALL SELECT doc_id, feature_id, strand, cs, a2, b2, CASE WHEN swapped THEN 0 ELSE b1 - a1 END, length(j) FROM cd WHERE side = 'r' AND a2 IS NOT NULL
), hit AS (
  SELECT rx.doc_id, feature_id, edit_id, strand, cs, total, before - a + CASE WHEN es = ee THEN least(es, b - 1) WHEN strand = -1 THEN least(ee, b) - 1 ELSE greatest(es, a) END AS pos
  FROM rx JOIN ed ON rx.doc_id = ed.doc_id AND CASE WHEN es = ee THEN es BETWEEN a AND b ELSE a < ee AND es < b END WHERE a < b
), touched AS (
  SELECT doc_id, feature_id, count(DISTINCT edit_id) AS n_edits, CAST(floor((CASE WHEN strand = -1 THEN total - 1 - max(pos) ELSE min(pos) END - (cs - 1)) / 3.0) + 1 AS BIGINT) AS first_codon FROM hit GROUP BY doc_id, feature_id, strand, cs, total
), b AS (
  SELECT t.*, r.tab, r.coding AS a, r.protein AS p, o.coding AS c, o.protein AS q FROM touched t JOIN pr r ON r.side = 'r' AND r.doc_id = t.doc_id AND r.feature_id = t.feature_id
  LEFT JOIN pr o ON o.side = 'q' AND o.doc_id = t.doc_id AND o.feature_id = t.feature_id
), w AS (
  SELECT *, length(c) - length(a) AS grown, CASE WHEN instr(p, '*') > 0 THEN instr(p, '*') ELSE 1000000000 END AS sp, CASE WHEN instr(q, '*') > 0 THEN instr(q, '*') ELSE 1000000000 END AS sq, {_FIRST} AS first_affected FROM b
)
SELECT doc_id, feature_id, CASE WHEN c IS NULL THEN 'coding_sequence_change' ELSE concat_ws(',', CASE WHEN grown % 3 <> 0 THEN 'frameshift' END, CASE WHEN sq < sp THEN 'nonsense' END, CASE WHEN sq > sp THEN 'stop_lost' END,
         CASE WHEN p[1] = 'M' AND q[1] <> 'M' THEN 'start_lost' END, CASE WHEN grown % 3 = 0 AND grown > 0 THEN 'inframe_insertion' END, CASE WHEN grown % 3 = 0 AND grown < 0 THEN 'inframe_deletion' END,
         CASE WHEN p <> q AND sp = sq THEN 'missense' END, CASE WHEN p = q THEN 'synonymous' END) END AS kinds,
       tab AS "table", length(a) AS ref_length, length(c) AS qry_length, p AS ref_protein, q AS qry_protein, first_affected,
       coalesce(substr(p, greatest(first_affected - 3, 0) + 1, first_affected + 2 - greatest(first_affected - 3, 0)), '') AS ref_window,
       coalesce(substr(q, greatest(first_affected - 3, 0) + 1, first_affected + 2 - greatest(first_affected - 3, 0)), '') AS qry_window, n_edits, first_codon FROM w""",
}
