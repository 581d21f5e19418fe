"""Queries on the products of cloning and assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import enzymes
from ..operators import assembly, products
from ..plans.fixtures import FEATURES, SEQUENCES, features as feature_table, sequences
from .design import _PARTS, _parts
from .sites import _CUTS, _ENDS, _RC, _scan_sql

#: Frequent cutters, one with overhangs and one blunt, so that many molecules have fragments of all kinds of ends.
CUTTERS = ("TaqI", "AluI")


def _clones(spark, d):
    """Each circular molecule as the vector of the next one; of every fourth pair the first fragments are asked for, of every ninth a
    vector fragment that isn't there."""
    s = sequences(spark, d)
    i = F.col("doc_id")
    first = F.when(i % 4 == 0, F.lit(1))
    pairs = s.filter("topology = 'circular'").select(i.alias("vector_id"), (i + 1).alias("insert_id"), F.when(i % 9 == 0, 1_000_000).otherwise(first).cast("long").alias("vector_fragment"), first.cast("long").alias("insert_fragment"))
    pairs = pairs.join(s.select(i.alias("insert_id")), "insert_id", "left_semi")
    return products.clone(pairs, s, enzymes(*CUTTERS))


def clone_products(spark, d):
    """Every product with its hash, or why there is none."""
    return _clones(spark, d).select("vector_id", "insert_id", "vector_fragment", "insert_fragment", "orientation", "product_length", F.sha2("sequence", 256).alias("sha256"), "error_code")


def clone_product_features(spark, d):
    """How many features of either molecule each product has, and how many it leaves out; where those it has begin and end."""
    c = products.clone_features(_clones(spark, d), sequences(spark, d), feature_table(spark, d).select("doc_id", "feature_id", "strand", "segments"))
    on = ["vector_id", "insert_id", "orientation", "piece"]
    place = lambda f, x: f(F.when(F.size("segments") > 0, x))
    # one grouping, as the features on the products are not made twice
    return products.left_out(c, on, place(F.sum, F.get("segments", F.lit(0))["start0"] * F.col("feature_id") % 1000 * F.col("strand")).alias("start_sum"), place(F.sum, F.element_at(F.when(F.size("segments") > 0, F.col("segments")), -1)["end0"]).alias("end_sum"))


def clone_feature_places(spark, d):
    """The segments of all features on all products."""
    c = products.clone_features(_clones(spark, d), sequences(spark, d), feature_table(spark, d).select("doc_id", "feature_id", "strand", "segments"))
    return c.select("vector_id", "insert_id", "orientation", "piece", "feature_id", "strand", F.explode("segments").alias("s")).select("vector_id", "insert_id", "orientation", "piece", "feature_id", "strand", "s.start0", "s.end0")


def assembly_feature_places(spark, d):
    """Features of the parts on the assembled circles: a fourth of each molecule's features is on each part."""
    parts = assembly.digest_parts(_parts(spark, d))
    f = feature_table(spark, d).select(F.col("doc_id").alias("assembly_id"), F.pmod("feature_id", F.lit(4)).alias("ord"), "feature_id", "strand", "start0")
    size = parts.select("assembly_id", "ord", F.length("seq").cast("long").alias("size"))
    f = f.join(size, ["assembly_id", "ord"]).withColumn("a", F.pmod("start0", "size"))
    b = F.least(F.col("a") + 12 + F.col("feature_id") % 20, F.col("size"))
    f = f.select("assembly_id", "ord", "feature_id", "strand", F.array(F.struct(F.col("a").alias("start0"), b.alias("end0"))).alias("segments"))
    c = products.assembly_features(parts, f)
    return c.select("assembly_id", "ord", "feature_id", "strand", F.explode_outer("segments").alias("s")).select("assembly_id", "ord", "feature_id", "strand", "s.start0", "s.end0")


def _w(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _fits(a: str, b: str) -> str:
    return f"coalesce(({a}t = 'blunt' AND {b}t = 'blunt') OR ({a}t = {b}t AND {a}t LIKE '%overhang' AND {a}o = {_RC.format(b + 'o')}), false)"


_CLONES = f"""
fe AS (
  SELECT frag.*, l.end_type AS lt, l.right_overhang AS lo, r.end_type AS rt, r.left_overhang AS ro, lc.rev_cut0 AS lrev, rc.rev_cut0 AS rrev,
         row_number() OVER (PARTITION BY frag.doc_id ORDER BY frag.length DESC, 'frag_' || fragment_no) = 1 AS bv, row_number() OVER (PARTITION BY frag.doc_id ORDER BY l.end_type IS NULL OR r.end_type IS NULL, frag.length DESC, 'frag_' || fragment_no) = 1 AS bi
  FROM frag LEFT JOIN ends l ON l.doc_id = frag.doc_id AND l.cut0 = left_cut LEFT JOIN ends r ON r.doc_id = frag.doc_id AND r.cut0 = right_cut
  LEFT JOIN cuts lc ON lc.doc_id = frag.doc_id AND lc.cut0 = left_cut LEFT JOIN cuts rc ON rc.doc_id = frag.doc_id AND rc.cut0 = right_cut
), pr AS (
  SELECT v.doc_id AS vector_id, i.doc_id AS insert_id, CASE WHEN v.doc_id % 9 = 0 THEN 1000000 WHEN v.doc_id % 4 = 0 THEN 1 END AS wv, CASE WHEN v.doc_id % 4 = 0 THEN 1 END AS wi, v.seq AS vseq, i.seq AS iseq, v.n AS vn, i.n AS inn FROM s v JOIN s i ON i.doc_id = v.doc_id + 1 WHERE v.topology = 'circular'
), pj AS (
  SELECT pr.*, v.fragment_no AS vf, v.start0 AS vs, v.length AS vl, v.lt AS vlt, v.lo AS vlo, v.rt AS vrt, v.ro AS vro, i.fragment_no AS fi, i.start0 AS st, i.length AS il, i.lt AS ilt, i.lo AS ilo, i.rt AS irt, i.ro AS iro, i.lrev AS ilrev, i.rrev AS irrev
  FROM pr LEFT JOIN fe v ON v.doc_id = vector_id AND CASE WHEN wv IS NULL THEN v.bv ELSE v.fragment_no = wv END LEFT JOIN fe i ON i.doc_id = insert_id AND CASE WHEN wi IS NULL THEN i.bi ELSE i.fragment_no = wi END
), pk AS (
  SELECT *, {_fits('vr', 'il')} AND {_fits('ir', 'vl')} AS fwd, {_fits('vr', 'ir')} AND {_fits('il', 'vl')} AS rev FROM pj
), pe AS (
  SELECT *, CASE WHEN vector_id NOT IN (SELECT doc_id FROM cuts) THEN 'NO_VECTOR_CUT' WHEN vf IS NULL THEN 'VECTOR_FRAGMENT_NOT_FOUND' WHEN insert_id NOT IN (SELECT doc_id FROM cuts) THEN 'NO_INSERT_CUT' WHEN fi IS NULL THEN 'INSERT_FRAGMENT_NOT_FOUND' WHEN NOT (fwd OR rev) THEN 'INCOMPATIBLE_ENDS' END AS error_code FROM pk
), po AS (
  SELECT *, unnest(CASE WHEN error_code IS NOT NULL THEN [NULL] WHEN fwd AND rev THEN ['forward', 'reverse'] WHEN fwd THEN ['forward'] ELSE ['reverse'] END) AS orientation FROM pe
)"""
_CARRIED = """
pc AS (
  SELECT vector_id, insert_id, orientation, 0 AS piece, vector_id AS doc_id, vs AS start0, vl AS length, false AS inv, 0 AS off, vn AS pn FROM po WHERE error_code IS NULL
  UNION ALL SELECT vector_id, insert_id, orientation, 1, insert_id, st, il, orientation = 'reverse', vl, inn FROM po WHERE error_code IS NULL
), rn AS (
  SELECT *, start0 AS ra, least(start0 + length, pn) AS rb, 0 AS pos FROM pc UNION ALL SELECT *, 0, start0 + length - pn, pn - start0 FROM pc WHERE start0 + length > pn
), cs AS (
  SELECT vector_id, insert_id, orientation, piece, feature_id, CASE WHEN inv THEN -strand ELSE strand END AS strand, inv, off, length, pos + greatest(a, ra) - ra AS x, pos + least(b, rb) - ra AS y
  FROM rn JOIN fs ON fs.doc_id = rn.doc_id AND greatest(a, ra) < least(b, rb)
), cp AS (SELECT *, off + CASE WHEN inv THEN length - y ELSE x END AS start0, off + CASE WHEN inv THEN length - x ELSE y END AS end0 FROM cs)"""
_MADE = (SEQUENCES, FEATURES, _scan_sql(CUTTERS), _CUTS, _ENDS, _CLONES, _CARRIED)

QUERIES = {f.__name__: f for f in (clone_products, clone_product_features, clone_feature_places, assembly_feature_places)}

ORACLE_SQL = {
    "clone_products": _w(SEQUENCES, _scan_sql(CUTTERS), _CUTS, _ENDS, _CLONES) + f"""
SELECT vector_id, insert_id, vf AS vector_fragment, fi AS insert_fragment, orientation, CASE WHEN error_code IS NULL THEN vl + il END AS product_length, error_code,
       CASE WHEN error_code IS NULL THEN sha256(substr(vseq || vseq, vs + 1, vl) || CASE WHEN orientation = 'forward' THEN substr(iseq || iseq, st + 1, il) WHEN ilrev < irrev THEN {_RC.format('substr(iseq, ilrev + 1, irrev - ilrev)')} WHEN orientation = 'reverse' THEN {_RC.format('substr(iseq, ilrev + 1) || substr(iseq, 1, irrev)')} END) END AS sha256
FROM po""",
    "clone_product_features": _w(*_MADE) + """, ft AS (SELECT vector_id, insert_id, orientation, piece, feature_id, any_value(strand) AS strand, min(start0) AS a, max(end0) AS b FROM cp GROUP BY ALL),
al AS (SELECT pc.vector_id, pc.insert_id, pc.orientation, pc.piece, f.feature_id, ft.strand, a, b FROM pc JOIN f ON f.doc_id = pc.doc_id LEFT JOIN ft ON ft.vector_id = pc.vector_id AND ft.insert_id = pc.insert_id AND ft.orientation = pc.orientation AND ft.piece = pc.piece AND ft.feature_id = f.feature_id)
SELECT vector_id, insert_id, orientation, piece, CAST(sum(a * feature_id % 1000 * strand) AS BIGINT) AS start_sum, CAST(sum(b) AS BIGINT) AS end_sum, count(a) AS n_features, count(*) - count(a) AS n_left_out FROM al GROUP BY ALL""",
    "clone_feature_places": _w(*_MADE) + " SELECT vector_id, insert_id, orientation, piece, feature_id, strand, start0, end0 FROM cp",
    "assembly_feature_places": _w(SEQUENCES, FEATURES, _PARTS) + """, ps AS (SELECT gp.assembly_id, gp.ord, length(gp.seq) AS size, f + 6 AS bs, length(body) AS bl FROM gp JOIN g2 USING (assembly_id, ord) JOIN dp USING (assembly_id, ord)),
good AS (SELECT assembly_id FROM jc GROUP BY ALL HAVING bool_and(compatible) AND count(*) >= 2),
pt AS (SELECT ps.*, sum(bl - 4) OVER (PARTITION BY assembly_id ORDER BY ord) - (bl - 4) AS off, sum(bl - 4) OVER (PARTITION BY assembly_id) AS n FROM ps SEMI JOIN good USING (assembly_id)),
pf AS (SELECT pt.*, f.feature_id, f.strand, f.start0 % size AS a, least(f.start0 % size + 12 + f.feature_id % 20, size) AS b FROM pt JOIN f ON f.doc_id = pt.assembly_id AND f.feature_id % 4 = pt.ord),
pl AS (SELECT *, off + a - bs AS x, off + b - bs AS y FROM pf WHERE a >= bs AND b <= bs + bl),
pw AS (SELECT assembly_id, ord, feature_id, strand, x AS start0, least(y, n) AS end0 FROM pl WHERE x < n UNION ALL SELECT assembly_id, ord, feature_id, strand, 0, least(y - n, n) FROM pl WHERE x < n AND y > n UNION ALL SELECT assembly_id, ord, feature_id, strand, x % n, least(x % n + y - x, n) FROM pl WHERE x >= n),
pg AS (SELECT assembly_id, ord, feature_id, strand, start0, end0 FROM pw WHERE start0 < end0)
SELECT pf.assembly_id, pf.ord, pf.feature_id, pf.strand, CAST(pg.start0 AS BIGINT) AS start0, CAST(pg.end0 AS BIGINT) AS end0 FROM pf LEFT JOIN pg USING (assembly_id, ord, feature_id)""",
}
