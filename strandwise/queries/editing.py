"""Queries on edits, features, differences and text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nt
from ..functions.tables import codons, enzymes
from ..operators import diff, edit, features, restriction
from ..plans.fixtures import FEATURES, SEQUENCES, features as feature_table, sequences, table
from ..sources import formats, protocol
from .sites import _scan_sql

_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
_CODE = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in codons().items()) + "}"
PANEL = ("EcoRI", "HindIII", "BamHI", "PstI", "SmaI", "Bsu36I", "BsaI", "SfiI")


def _place(n, k: int):
    """A place of a molecule that follows from its id."""
    return F.pmod(F.col("doc_id") * k, n)


def edit_sequences(spark, d):
    s = sequences(spark, d).withColumn("p", _place(F.col("n") - 12, 13).cast("int"))
    t, p = F.col("seq"), F.col("p")
    forms = {"insert": edit.insert_text(t, p, F.lit("ACGTT")), "delete": edit.delete_range(t, p, p + 7), "delete_wrapped": edit.delete_range(t, F.col("n").cast("int") - 4, F.lit(5)), "replace": edit.replace_range(t, p, p + 5, F.lit("GG")), "reverse_complement": edit.invert_range(t, p, p + 9), "rotate_origin": edit.rotate_origin(t, p)}
    rows = s.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("action"), v.alias("x")) for k, v in forms.items()])).alias("e"))
    return rows.select("doc_id", "e.action", F.length("e.x").cast("long").alias("new_length"), F.sha2("e.x", 256).alias("sha256"))


def _after(spark, d, change, circular=False):
    f = feature_table(spark, d).withColumn("p", _place(F.col("n") - 12, 13))
    f = f.filter("topology = 'circular'") if circular else f
    out = edit.with_segments(f, change(F.col("segments"), F.col("p"), F.col("n")))
    return out.select("doc_id", "feature_id", F.explode("segments").alias("s")).select("doc_id", "feature_id", "s.start0", "s.end0")


def edit_insert(spark, d):
    return _after(spark, d, lambda s, p, n: edit.segments_after_insert(s, p, F.lit(5)))


def edit_delete(spark, d):
    return _after(spark, d, lambda s, p, n: edit.segments_after_delete(s, p, p + 7))


def edit_delete_wrapped(spark, d):
    return _after(spark, d, lambda s, p, n: edit.segments_after_delete(s, n - 4, F.lit(5)), True)


def edit_replace(spark, d):
    return _after(spark, d, lambda s, p, n: edit.segments_after_replace(s, p, p + 5, F.lit(2)))


def edit_rc_region(spark, d):
    return _after(spark, d, lambda s, p, n: edit.segments_after_invert(s, F.floor(p / 2), n - 6))


def edit_rotate(spark, d):
    return _after(spark, d, lambda s, p, n: edit.segments_after_rotate(s, p, n), True)


def affected_features(spark, d):
    s = sequences(spark, d).select("doc_id", F.explode(F.array(F.struct(F.lit("span").alias("edit_id"), _place(F.col("n") - 12, 13).alias("a"), (_place(F.col("n") - 12, 13) + 10).alias("b")), F.struct(F.lit("point").alias("edit_id"), _place(F.col("n"), 17).alias("a"), _place(F.col("n"), 17).alias("b")))).alias("e"))
    edits = s.select("doc_id", "e.edit_id", F.col("e.a").alias("edit_start"), F.col("e.b").alias("edit_end"))
    return features.affected(feature_table(spark, d), edits)


def _planted(spark, d):
    """Each molecule, and the same with three bases complemented at a place that follows from its id."""
    s = sequences(spark, d).select("doc_id", F.col("seq").alias("reference"), _place(F.col("n") - 3, 29).cast("int").alias("p"))
    return s.withColumn("query", edit.replace_range(F.col("reference"), F.col("p"), F.col("p") + 3, F.translate(F.substr("reference", F.col("p") + 1, F.lit(3)), "ACGT", "TGCA")))


def _one_changed(spark, d):
    s = sequences(spark, d).select("doc_id", F.col("seq").alias("reference"), _place(F.col("n"), 31).cast("int").alias("p"))
    return s.withColumn("query", edit.replace_range(F.col("reference"), F.col("p"), F.col("p") + 1, F.translate(F.substr("reference", F.col("p") + 1, F.lit(1)), "ACGT", "TGCA")))


def invariant_report(spark, d):
    """What a staged replacement changes: bases, length, protein and the sites of one enzyme."""
    p = _planted(spark, d)
    where = edit.changed_positions(F.col("reference"), F.col("query"))
    sites = lambda c: F.regexp_count(c, F.lit("GAATTC")).cast("long")
    a, b = nt.translate_codons(F.col("reference")), nt.translate_codons(F.col("query"))
    p = p.withColumn("w", where)
    return p.select("doc_id", F.size("w").cast("long").alias("n_changed"), F.get("w", F.lit(0)).cast("long").alias("first_changed"), (F.length("query") - F.length("reference")).cast("long").alias("length_delta"), sites(F.col("reference")).alias("sites_before"), sites(F.col("query")).alias("sites_after"), (a == b).alias("synonymous"))


def diff_planted_edits(spark, d):
    """One base complemented: the shortest script is that substitution."""
    return diff.differences(_one_changed(spark, d))


def diff_runs(spark, d):
    return diff.difference_runs(_planted(spark, d).select("doc_id", "reference", "query"))


def canonical_rotation(spark, d):
    """Least rotations of whole circular molecules; SQL would compare every rotation with every other, so there is none."""
    return diff.canonical_forms(sequences(spark, d).filter("topology = 'circular'").select("doc_id", "seq")).select("doc_id", "canonical")


def nw_score(spark, d):
    """Each molecule against itself with one base changed."""
    return diff.alignment_scores(_one_changed(spark, d))


def protein_consequence(spark, d):
    p = _planted(spark, d)
    p = p.withColumn("reference", F.concat(F.lit("ATG"), "reference")).withColumn("query", F.concat(F.lit("ATG"), "query"))
    return p.select("doc_id", diff.consequence(F.col("reference"), F.col("query")).alias("consequence"))


def feature_list_filter(spark, d):
    """Features of one type in any case, by a part of the name, without sources."""
    f = feature_table(spark, d).filter((F.lower("type") == "cds") & (F.col("strand") == 1))
    return f.select("doc_id", "feature_id", "type", "start0", "end0")


def feature_dedupe(spark, d):
    f = feature_table(spark, d).withColumn("start0", F.floor(F.col("start0") / 50)).withColumn("segments", F.array(F.struct("start0")))
    return features.dedupe(f, ["CDS", "promoter"]).select("doc_id", "feature_id", "type")


def feature_overlap_join(spark, d):
    return features.overlap_pairs(feature_table(spark, d))


def feature_line_tiles(spark, d):
    return features.line_tiles(feature_table(spark, d))


def feature_lanes(spark, d):
    return features.assign_lanes(feature_table(spark, d))


def feature_diff(spark, d):
    """Every fifth feature removed, every seventh moved, every eleventh new."""
    f = feature_table(spark, d)
    q = f.filter("feature_id % 5 <> 0").withColumn("segments", F.when(F.col("feature_id") % 7 == 0, F.transform("segments", lambda s: F.struct((s["start0"] + 1).alias("start0"), s["end0"].alias("end0")))).otherwise(F.col("segments")))
    return features.feature_diff(f.filter("feature_id % 11 <> 0"), q)


def site_clusters(spark, d):
    return features.site_clusters(restriction.restriction_sites(sequences(spark, d), enzymes(*PANEL)))


def _fasta(spark, d):
    """Documents in files of up to eight records."""
    s = sequences(spark, d)
    rec = s.select(F.floor(F.col("doc_id") / 8).alias("file_id"), "doc_id", formats.write_fasta(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(" note")), F.col("seq")).alias("t"))
    return rec.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "t"))), lambda x: x["t"]), "\r\n").alias("text"))


def fasta_roundtrip(spark, d):
    s = sequences(spark, d).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.sha2("seq", 256).alias("written"))
    r = formats.read_fasta(_fasta(spark, d))
    return s.join(r, "name", "left").select("name", (F.sha2("seq", 256) == F.col("written")).alias("same"))


def fasta_parse_records(spark, d):
    return formats.read_fasta(_fasta(spark, d)).select("file_id", "record_no", "name", F.length("seq").cast("long").alias("length"), "alphabet", "error")


def genbank_origin_block(spark, d):
    return sequences(spark, d).select("doc_id", F.sha2(formats.origin_block(F.col("seq")), 256).alias("sha256"))


def genbank_locations(spark, d):
    return feature_table(spark, d).select("doc_id", "feature_id", formats.location(F.col("segments"), F.col("strand")).alias("location"))


def genbank_roundtrip(spark, d):
    """Molecules with all their features, written and parsed back."""
    f = feature_table(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", "type", "strand", "segments"))).alias("fs"))
    docs = sequences(spark, d).join(f, "doc_id", "left").withColumn("name", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    kind = "array<struct<type:string,strand:bigint,segments:array<struct<start0:bigint,end0:bigint>>,label:string>>"
    docs = docs.withColumn("features", F.coalesce(F.transform("fs", lambda x: F.struct(x["type"].alias("type"), x["strand"].alias("strand"), x["segments"].alias("segments"), F.concat(F.lit("f"), x["feature_id"].cast("string")).alias("label"))), F.array()).cast(kind))
    text = formats.write_genbank(docs, "01-JAN-2024")
    back = formats.read_genbank(text.select(F.col("doc_id").alias("file_id"), "text")).withColumnRenamed("file_id", "doc_id").withColumnRenamed("seq", "seq2").withColumnRenamed("features", "f2").withColumnRenamed("topology", "t2").drop("name")
    j = docs.join(back, "doc_id")
    strip = lambda c: F.transform(c, lambda x: F.struct(x["type"], x["strand"].cast("long"), x["segments"]))
    return j.select("doc_id", F.size("f2").cast("long").alias("n_features"), ((F.col("seq") == F.col("seq2")) & (F.col("topology") == F.col("t2")) & (strip(F.col("features")) == strip(F.col("f2")))).alias("same"))


def raw_import(spark, d):
    t = F.concat(formats.origin_block(F.col("seq")), F.lit("\n -."))
    s = sequences(spark, d).select("doc_id", formats.read_raw(t).alias("seq"))
    return s.withColumn("alphabet", nt.alphabet(F.col("seq")))


def format_sniff(spark, d):
    s = sequences(spark, d).withColumn("k", F.col("doc_id") % 4)
    text = F.when(F.col("k") == 0, F.concat(F.lit(' {"id":1,"sequence":"'), "seq", F.lit('"}'))).when(F.col("k") == 1, F.concat(F.lit("LOCUS x\n"), "seq")).when(F.col("k") == 2, F.concat(F.lit(">a\n"), "seq")).otherwise(F.col("seq"))
    return s.select("doc_id", formats.sniff(text).alias("format"))


def json_roundtrip(spark, d):
    s = sequences(spark, d)
    back = F.from_json(F.to_json(F.struct("doc_id", "topology", "seq", "n")), "doc_id long, topology string, seq string, n long")
    return s.withColumn("b", back).select("doc_id", F.col("b.topology").alias("topology"), F.col("b.n").alias("n"), F.sha2("b.seq", 256).alias("sha256"))


def genbank_header(spark, d):
    s = sequences(spark, d)
    text = F.concat(F.lit("LOCUS       D"), F.col("doc_id").cast("string"), F.lit("   "), F.col("n").cast("string"), F.lit(" bp    DNA     "), F.col("topology"), F.lit(" SYN 01-JAN-2024\nDEFINITION  A vector with\n            two lines.\nACCESSION   X\n  ORGANISM  Escherichia coli\nFEATURES             Location/Qualifiers\n     source          1.."), F.col("n").cast("string"), F.lit("\n     CDS             1..9\nORIGIN\n"))
    return s.select("doc_id", *[c.alias(k) for k, c in formats.header_fields(text).items()])


def protocol_recipe(spark, d):
    s = sequences(spark, d)
    return s.select("doc_id", *[c.alias(k) for k, c in protocol.pcr_recipe(F.col("doc_id") % 120, F.col("n")).items() if k != "error_code"])


def _w(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


_EDIT = ", e AS (SELECT fs.*, s.topology, doc_id * 13 % (fs.n - 12) AS p FROM fs JOIN s USING (doc_id))"
_SAME = "SELECT doc_id, feature_id, a AS start0, b AS end0 FROM x WHERE a < b"
_PLANT = """, pl AS (SELECT doc_id, n, seq AS r, doc_id * 29 % (n - 3) AS p FROM s),
pq AS (SELECT *, substr(r, 1, p) || translate(substr(r, p + 1, 3), 'ACGT', 'TGCA') || substr(r, p + 4) AS q FROM pl)"""


def _prot(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '...'), lambda c: coalesce({_CODE}[c], 'X')), '')"


_FASTA_LINE = "array_to_string(regexp_extract_all(seq, '.{1,80}'), chr(10))"

QUERIES = {
    f.__name__: f
    for f in (
        edit_sequences, edit_insert, edit_delete, edit_delete_wrapped, edit_replace, edit_rc_region, edit_rotate, affected_features, invariant_report, diff_planted_edits, diff_runs, canonical_rotation, nw_score,
        protein_consequence, feature_list_filter, feature_dedupe, feature_overlap_join, feature_line_tiles, feature_lanes, feature_diff, site_clusters, fasta_roundtrip, fasta_parse_records, genbank_origin_block,
        genbank_locations, genbank_roundtrip, raw_import, format_sniff, json_roundtrip, genbank_header, protocol_recipe,
    )
}

ORACLE_SQL = {
    "edit_sequences": _w(SEQUENCES) + f""", q AS (SELECT *, doc_id * 13 % (n - 12) AS p FROM s), e AS (
        SELECT doc_id, 'insert' AS action, substr(seq, 1, p) || 'ACGTT' || substr(seq, p + 1) AS x FROM q UNION ALL SELECT doc_id, 'delete', substr(seq, 1, p) || substr(seq, p + 8) FROM q
        UNION ALL SELECT doc_id, 'delete_wrapped', substr(seq, 6, n - 9) FROM q UNION ALL SELECT doc_id, 'replace', substr(seq, 1, p) || 'GG' || substr(seq, p + 6) FROM q
        UNION ALL SELECT doc_id, 'reverse_complement', substr(seq, 1, p) || {_RC.format('substr(seq, p + 1, 9)')} || substr(seq, p + 10) FROM q UNION ALL SELECT doc_id, 'rotate_origin', substr(seq, p + 1) || substr(seq, 1, p) FROM q)
        SELECT doc_id, action, CAST(length(x) AS BIGINT) AS new_length, sha256(x) AS sha256 FROM e""",
    "edit_insert": _w(SEQUENCES, FEATURES) + _EDIT + ", x AS (SELECT doc_id, feature_id, CASE WHEN a >= p THEN a + 5 ELSE a END AS a, CASE WHEN b <= p THEN b ELSE b + 5 END AS b FROM e) " + _SAME.replace(" WHERE a < b", ""),
    "edit_delete": _w(SEQUENCES, FEATURES) + _EDIT + ", x AS (SELECT doc_id, feature_id, CASE WHEN a <= p THEN a WHEN a >= p + 7 THEN a - 7 ELSE p END AS a, CASE WHEN b <= p THEN b WHEN b >= p + 7 THEN b - 7 ELSE p END AS b FROM e) " + _SAME,
    "edit_delete_wrapped": _w(SEQUENCES, FEATURES) + _EDIT + ", x AS (SELECT doc_id, feature_id, greatest(a, 5) - 5 AS a, least(b, n - 4) - 5 AS b FROM e WHERE topology = 'circular') " + _SAME,
    "edit_replace": _w(SEQUENCES, FEATURES) + _EDIT + """, y AS (SELECT doc_id, feature_id, p, CASE WHEN a <= p THEN a WHEN a >= p + 5 THEN a - 5 ELSE p END AS a, CASE WHEN b <= p THEN b WHEN b >= p + 5 THEN b - 5 ELSE p END AS b FROM e),
        x AS (SELECT doc_id, feature_id, CASE WHEN a >= p THEN a + 2 ELSE a END AS a, CASE WHEN b <= p THEN b ELSE b + 2 END AS b FROM y WHERE a < b) """ + _SAME,
    "edit_rc_region": _w(SEQUENCES, FEATURES) + _EDIT + """, y AS (SELECT *, p // 2 AS l, n - 6 AS r, bool_and(a >= p // 2 AND b <= n - 6) OVER (PARTITION BY doc_id, feature_id) AS inside FROM e),
        x AS (SELECT doc_id, feature_id, CASE WHEN inside THEN l + r - b ELSE a END AS a, CASE WHEN inside THEN l + r - a ELSE b END AS b FROM y) """ + _SAME.replace(" WHERE a < b", ""),
    "edit_rotate": _w(SEQUENCES, FEATURES) + _EDIT + """, y AS (SELECT doc_id, feature_id, n, ((a - p) % n + n) % n AS a, ((a - p) % n + n) % n + b - a AS b FROM e WHERE topology = 'circular'),
        z AS (SELECT doc_id, feature_id, a, least(b, n) AS b FROM y UNION ALL SELECT doc_id, feature_id, 0, b - n FROM y WHERE b > n),
        m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id, feature_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM z),
        g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, feature_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)
        SELECT doc_id, feature_id, min(a) AS start0, max(b) AS end0 FROM g GROUP BY doc_id, feature_id, k""",
    "affected_features": _w(SEQUENCES, FEATURES) + """, ed AS (SELECT doc_id, 'span' AS edit_id, doc_id * 13 % (n - 12) AS l, doc_id * 13 % (n - 12) + 10 AS r FROM s UNION ALL SELECT doc_id, 'point', doc_id * 17 % n, doc_id * 17 % n FROM s)
        SELECT DISTINCT doc_id, edit_id, feature_id FROM fs JOIN ed USING (doc_id) WHERE CASE WHEN l = r THEN a <= l AND l <= b ELSE a < r AND l < b END""",
    "invariant_report": _w(SEQUENCES) + _PLANT + f"""
        SELECT doc_id, CAST(3 AS BIGINT) AS n_changed, p AS first_changed, CAST(length(q) - length(r) AS BIGINT) AS length_delta, CAST(len(string_split(r, 'GAATTC')) - 1 AS BIGINT) AS sites_before, CAST(len(string_split(q, 'GAATTC')) - 1 AS BIGINT) AS sites_after,
        {_prot('r')} = {_prot('q')} AS synonymous FROM pq""",
    "diff_planted_edits": _w(SEQUENCES) + """, x AS (SELECT doc_id, seq, doc_id * 31 % n AS p FROM s)
        SELECT doc_id, 'substitution' AS kind, p AS ref_start0, p AS qry_start0, substr(seq, p + 1, 1) AS ref_bases, translate(substr(seq, p + 1, 1), 'ACGT', 'TGCA') AS qry_bases FROM x""",
    "diff_runs": _w(SEQUENCES) + _PLANT + " SELECT doc_id, p AS start0, p + 3 AS end0, CAST(3 AS BIGINT) AS n, substr(r, p + 1, 3) AS ref_bases, substr(q, p + 1, 3) AS qry_bases FROM pq",
    "nw_score": _w(SEQUENCES) + " SELECT doc_id, 2 * n - 3 AS score FROM s",
    "protein_consequence": _w(SEQUENCES) + _PLANT + f""", t AS (SELECT doc_id, r, q, {_prot("'ATG' || r")} AS a, {_prot("'ATG' || q")} AS b FROM pq)
        SELECT doc_id, CASE WHEN r = q THEN 'none' WHEN a[1] = 'M' AND b[1] <> 'M' THEN 'start_lost' WHEN instr(b, '*') > 0 AND (instr(a, '*') = 0 OR instr(b, '*') < instr(a, '*')) THEN 'nonsense'
        WHEN instr(a, '*') > 0 AND (instr(b, '*') = 0 OR instr(b, '*') > instr(a, '*')) THEN 'stop_lost' WHEN a = b THEN 'synonymous' ELSE 'missense' END AS consequence FROM t""",
    "feature_list_filter": _w(SEQUENCES, FEATURES) + " SELECT doc_id, feature_id, type, start0, end0 FROM f WHERE type = 'CDS' AND strand = 1",
    "feature_dedupe": _w(SEQUENCES, FEATURES) + " SELECT doc_id, feature_id, type FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, strand, start0 // 50 ORDER BY CASE type WHEN 'CDS' THEN 1 WHEN 'promoter' THEN 2 ELSE 3 END, feature_id) = 1",
    "feature_overlap_join": _w(SEQUENCES, FEATURES) + " SELECT x.doc_id, x.feature_id AS left_id, y.feature_id AS right_id, CAST(sum(least(x.b, y.b) - greatest(x.a, y.a)) AS BIGINT) AS overlap FROM fs x JOIN fs y ON x.doc_id = y.doc_id AND x.feature_id < y.feature_id AND x.type <> y.type AND x.a < y.b AND y.a < x.b GROUP BY ALL",
    "feature_line_tiles": _w(SEQUENCES, FEATURES) + ", t AS (SELECT doc_id, feature_id, a, b, unnest(range(a // 60, (b - 1) // 60 + 1)) AS line_no FROM fs WHERE a < b) SELECT doc_id, feature_id, line_no, greatest(a, line_no * 60) AS start0, least(b, line_no * 60 + 60) AS end0, least(b, line_no * 60 + 60) - greatest(a, line_no * 60) >= 5 AS labelled FROM t",
    "feature_diff": _w(SEQUENCES, FEATURES) + " SELECT doc_id, feature_id, CASE WHEN feature_id % 11 = 0 THEN 'added' WHEN feature_id % 5 = 0 THEN 'removed' WHEN feature_id % 7 = 0 THEN 'modified' ELSE 'unchanged' END AS kind FROM f WHERE NOT (feature_id % 11 = 0 AND feature_id % 5 = 0)",
    "site_clusters": _w(SEQUENCES, _scan_sql(PANEL)) + """, y AS (SELECT *, CASE WHEN start0 - lag(start0) OVER w <= greatest(1, n / 180) THEN 0 ELSE 1 END AS new, min(start0) OVER (PARTITION BY doc_id) + n - max(start0) OVER (PARTITION BY doc_id) AS gap FROM sites WINDOW w AS (PARTITION BY doc_id ORDER BY start0, enzyme_id, strand)),
        z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start0, enzyme_id, strand ROWS UNBOUNDED PRECEDING) AS c FROM y), v AS (SELECT *, max(c) OVER (PARTITION BY doc_id) AS most FROM z),
        u AS (SELECT *, CASE WHEN topology = 'circular' AND gap <= greatest(1, n / 180) AND c = most THEN 1 ELSE c END AS cc FROM v)
        SELECT doc_id, CAST(cc AS BIGINT) AS cluster_no, count(*) AS n_sites, min(start0) AS first0, max(start0) AS last0 FROM u GROUP BY doc_id, cc""",
    "fasta_roundtrip": _w(SEQUENCES) + " SELECT 'doc' || doc_id AS name, true AS same FROM s",
    "fasta_parse_records": _w(SEQUENCES) + " SELECT doc_id // 8 AS file_id, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS record_no, 'doc' || doc_id AS name, n AS length, 'DNA' AS alphabet, CAST(NULL AS VARCHAR) AS error FROM s",
    "genbank_origin_block": _w(SEQUENCES) + """, l AS (SELECT doc_id, i, lpad(CAST(i * 60 + 1 AS VARCHAR), 9, ' ') || ' ' || array_to_string(regexp_extract_all(substr(lower(seq), CAST(i * 60 + 1 AS BIGINT), 60), '.{1,10}'), ' ') AS t FROM (SELECT *, unnest(range(0, (n + 59) // 60)) AS i FROM s))
        SELECT doc_id, sha256(string_agg(t, chr(10) ORDER BY i)) AS sha256 FROM l GROUP BY 1""",
    "genbank_locations": _w(SEQUENCES, FEATURES) + """, t AS (SELECT doc_id, feature_id, any_value(strand) AS strand, count(*) AS k, string_agg((a + 1) || '..' || b, ',' ORDER BY fs.k) AS x FROM fs GROUP BY 1, 2), u AS (SELECT *, CASE WHEN k > 1 THEN 'join(' || x || ')' ELSE x END AS y FROM t)
        SELECT doc_id, feature_id, CASE WHEN strand = -1 THEN 'complement(' || y || ')' ELSE y END AS location FROM u""",
    "genbank_roundtrip": _w(SEQUENCES, FEATURES) + " SELECT s.doc_id, count(f.feature_id) AS n_features, true AS same FROM s LEFT JOIN f ON s.doc_id = f.doc_id GROUP BY 1",
    "raw_import": _w(SEQUENCES) + " SELECT doc_id, seq, 'DNA' AS alphabet FROM s",
    "format_sniff": _w(SEQUENCES) + " SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'genbank' WHEN 2 THEN 'fasta' ELSE 'raw' END AS format FROM s",
    "json_roundtrip": _w(SEQUENCES) + " SELECT doc_id, topology, n, sha256(seq) AS sha256 FROM s",
    "genbank_header": _w(SEQUENCES) + " SELECT doc_id, n AS length, topology, 'A vector with two lines.' AS definition, 'Escherichia coli' AS organism, CAST(2 AS BIGINT) AS n_features FROM s",
    "protocol_recipe": _w(SEQUENCES) + """, r AS (SELECT doc_id, n, greatest(1, least(96, doc_id % 120)) AS k FROM s)
        SELECT doc_id, k AS reactions, CAST(9.0 AS DOUBLE) AS water_ul, CAST(greatest(15, ceil(n / 1000.0 * 30)) AS BIGINT) AS extension_s, floor(CAST(k * 12.5 AS DOUBLE) * CAST(1.1 AS DOUBLE) * 10 + 0.5) / 10 AS mix_ul, floor(CAST(k AS DOUBLE) * CAST(1.15 AS DOUBLE) * 10 + 0.5) / 10 AS template_ul,
        CAST(ceil(k * 5 / 96.0) AS BIGINT) AS tip_racks, substr('ABCDEFGH', (k - 1) % 8 + 1, 1) || CAST((k - 1) // 8 + 1 AS VARCHAR) AS last_well FROM r""",
}
