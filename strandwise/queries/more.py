"""Further queries: coordinates, places on the map, manifests, rotations, regions, projects and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nt
from ..functions.tables import enzyme_table, enzymes
from ..operators import crispr, diff, digest, edit, features, restriction, workspace as ws
from ..plans.fixtures import FEATURES, SEQUENCES, features as feature_table, sequences, table
from .design import _crispr_sql
from .editing import _PLANT, _one_changed, _planted
from .sites import PAIR, _CUTS, _scan_sql


def coordinate_parse(spark, d):
    """Places of features as users type them, some of them behind the molecule's end, before its begin, or turned round."""
    f, k = feature_table(spark, d), F.col("feature_id") % 7
    a, b = (F.col("start0") + 1).cast("string"), F.col("end0").cast("string")
    forms = (F.concat(F.lit(":"), a), F.concat(a, F.lit("-"), b), F.concat(F.lit(" "), a, F.lit(" .. "), b, F.lit(" ")), F.concat(a, F.lit(".."), (F.col("end0") + F.col("n")).cast("string")), F.concat("type", F.lit(" "), a), F.concat("start0", F.lit("-"), b), F.concat(a, F.lit("..")))
    t = f.select("doc_id", "feature_id", "n", F.coalesce(*[F.when(k == i, x) for i, x in enumerate(forms)]).alias("query"))
    return t.select("doc_id", "feature_id", "query", *[c.alias(x) for x, c in ws.parse_coordinates(F.col("query"), F.col("n")).items()])


def selection_overlap(spark, d):
    """Features that a selection of the middle third touches, by their first segment that does."""
    f = feature_table(spark, d)
    a, b = F.floor(F.col("n") / 3), F.floor(F.col("n") * 2 / 3)
    hit = F.filter("segments", lambda s: features.overlaps(s["start0"], s["end0"], a, b))
    return f.withColumn("h", F.get(hit, F.lit(0))).filter("h is not null").select("doc_id", "feature_id", (F.col("h.start0") + 1).alias("start1"), F.col("h.end0").alias("end1"))


def feature_midpoints(spark, d):
    """Middle of each feature along the molecule, and its angle on a circular map in thousandths of a turn."""
    f = feature_table(spark, d)
    size = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + s["end0"] - s["start0"])
    mid = F.pmod(F.col("start0") + F.floor(size / 2), F.col("n"))
    return f.select("doc_id", "feature_id", size.alias("size"), mid.alias("mid0"), F.floor(mid * 1000 / F.col("n")).alias("angle_permille"))


def sequence_fnv(spark, d):
    return sequences(spark, d).select("doc_id", diff.fnv1a(F.col("seq")).alias("fnv"))


def diff_manifest(spark, d):
    """Sorted JSON of each planted difference and its checksum."""
    r = diff.difference_runs(_planted(spark, d).select("doc_id", "reference", "query"))
    j = r.select("doc_id", F.to_json(F.struct("doc_id", "end0", "n", "qry_bases", "ref_bases", "start0")).alias("manifest"))
    return j.withColumn("checksum", F.lpad(F.lower(F.hex(diff.fnv1a(F.col("manifest")))), 8, "0"))


def diff_summary(spark, d):
    p = _one_changed(spark, d).select("doc_id", "reference", "query")
    return diff.summary(p, diff.differences(p))


def rotation_votes(spark, d):
    """Molecules read as circles, turned by a known amount and in every second one a base changed, find their place again."""
    s = sequences(spark, d).select("doc_id", "n", F.col("seq").alias("reference"))
    p = s.withColumn("query", nt.rotate(F.col("reference"), F.pmod(F.col("doc_id") * 37, F.col("n")).cast("int"))).withColumn("p", F.floor(F.col("n") / 2).cast("int"))
    changed = edit.replace_range(F.col("query"), F.col("p"), F.col("p") + 1, F.translate(F.substr("query", F.col("p") + 1, F.lit(1)), "ACGT", "TGCA"))
    p = p.withColumn("query", F.when(F.col("doc_id") % 2 == 0, changed).otherwise(F.col("query"))).select("doc_id", "reference", "query")
    placed = diff.rotations(p, keep=("reference", "query")).withColumn("turned", nt.rotate(F.col("reference"), F.col("rotation").cast("int")))
    return placed.select("doc_id", F.size(edit.changed_positions(F.col("turned"), F.col("query"))).cast("long").alias("n_changed"))


def crispr_region(spark, d):
    """Guides of score 60 or more whose PAM lies in the second quarter of a linear molecule."""
    t = crispr.targets(sequences(spark, d).filter("topology = 'linear'"), "SpCas9")
    a, b = F.floor(F.col("n") / 4), F.floor(F.col("n") / 2)
    t = t.filter((F.col("pam_start0") >= a) & (F.col("pam_start0") + 3 <= b))
    return crispr.top_targets(t, 20, 60).select("doc_id", "rank", "strand", "pam_start0", "score")


def copy_region(spark, d):
    """New molecules from regions: the first half as it is, the rest reverse complemented."""
    s = sequences(spark, d)
    half = F.floor(F.col("n") / 2).cast("int")
    x = F.explode(F.array(F.struct(F.lit("copy").alias("kind"), nt.subsequence(F.col("seq"), F.lit(0), half).alias("t")), F.struct(F.lit("inverted").alias("kind"), nt.reverse_complement(nt.subsequence(F.col("seq"), half, F.col("n").cast("int"))).alias("t"))))
    return s.select("doc_id", x.alias("x")).select("doc_id", "x.kind", F.length("x.t").cast("long").alias("n"), F.sha2("x.t", 256).alias("sha256"))


def enzyme_catalog(spark, d):
    e = enzyme_table(spark)
    return e.select("enzyme_id", "recognition", "category", restriction.end_type(F.col("fwd_cut"), F.col("rev_cut")).alias("end_type"), "overhang_len", F.size("aliases").alias("n_aliases"))


def project_list(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("project_id"), F.col("o_orderdate").alias("updated"))
    return ws.projects(o, 5).select("user_id", "project_id", "place")


def restore_revision(spark, d):
    e = table(spark, d, "events")
    h = e.select((F.col("user_id")).alias("doc_id"), F.col("event_id").alias("version"), F.sha2(F.col("event_id").cast("string"), 256).alias("hash"))
    want = e.groupBy(F.col("user_id").alias("doc_id")).agg(F.min("event_id").alias("to_version"))
    return ws.restore(h, want)


def fragment_features(spark, d):
    """Features carried onto the fragments of a double digest."""
    cut = digest.cuts(restriction.restriction_sites(sequences(spark, d), enzymes(*PAIR)))
    return features.on_fragments(feature_table(spark, d), digest.fragments(sequences(spark, d).select("doc_id", "topology", "n"), cut))


def interval_map(spark, d):
    """The first third of each circular molecule's canonical form, and the same bases on the molecule itself."""
    s = sequences(spark, d).filter("topology = 'circular'").select("doc_id", "seq", "n")
    c = diff.canonical_forms(s).join(s, "doc_id").withColumn("k", F.floor(F.col("n") / 3))
    c = c.withColumn("segments", diff.to_original(F.lit(0), F.col("k"), F.col("strand"), F.col("rotation"), F.col("n")))
    part = F.aggregate("segments", F.lit(""), lambda x, s: F.concat(x, F.substr("seq", s["start0"].cast("int") + 1, (s["end0"] - s["start0"]).cast("int"))))
    back = F.when(F.col("strand") == 1, part).otherwise(nt.reverse_complement(part))
    return c.select("doc_id", F.col("k").alias("n_bases"), (back == F.left("canonical", F.col("k").cast("int"))).alias("same"))


def normalized(spark, d):
    """Molecules as RNA in lower case with line ends, normalized."""
    return sequences(spark, d).select("doc_id", F.sha2(nt.normalize(F.regexp_replace(F.lower(F.translate("seq", "T", "U")), "(.{60})", "$1\r\n ")), 256).alias("sha256"))


def enzyme_search(spark, d):
    """Enzymes with "bs" in one of their names."""
    return restriction.enzyme_filter(enzyme_table(spark), "Bs").select("enzyme_id", "name", "category")


def project_upsert(spark, d):
    """Orders as stored projects, events as changes to them, every seventh a deletion."""
    stored = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("project_id"), F.col("o_orderkey").alias("created"), F.col("o_orderkey").alias("updated"))
    e = table(spark, d, "events")
    ch = e.select(F.col("event_id").alias("project_id"), (F.col("event_id") % 7 == 0).alias("deleted"), (F.col("event_id") + 1_000_000_000).alias("at"), "user_id")
    own = stored.select("project_id", F.col("user_id").alias("owner"))
    # a change of a stored project is its owner's
    ch = ch.join(own, "project_id", "left").select(F.coalesce("owner", "user_id").alias("user_id"), "project_id", "at", "deleted")
    return ws.upsert_projects(stored, ch)


def hydrate_unseen(spark, d):
    """Stored documents that the workspace doesn't hold yet."""
    stored, held = sequences(spark, d, 0).select("doc_id", "n"), sequences(spark, d, 100).filter("doc_id % 3 = 0").select("doc_id")
    return stored.join(held, "doc_id", "left_anti")


def _w(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


_CAT = ", ".join(f"('{e['enzyme_id']}', '{e['recognition']}', '{e['category']}', {e['fwd_cut']}, {e['rev_cut']}, {len(e['aliases'])})" for e in enzymes())
_FNV = "list_reduce(list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: xor(h, c) * 16777619 % 4294967296, CAST(2166136261 AS BIGINT))"

QUERIES = {f.__name__: f for f in (coordinate_parse, selection_overlap, feature_midpoints, sequence_fnv, diff_manifest, diff_summary, rotation_votes, crispr_region, copy_region, enzyme_catalog, project_list, restore_revision, hydrate_unseen, fragment_features, interval_map, normalized, enzyme_search, project_upsert)}

ORACLE_SQL = {
    "coordinate_parse": _w(SEQUENCES, FEATURES) + """, x AS (
        SELECT doc_id, feature_id, n, CASE feature_id % 7 WHEN 0 THEN ':' || (start0 + 1) WHEN 1 THEN (start0 + 1) || '-' || end0 WHEN 2 THEN ' ' || (start0 + 1) || ' .. ' || end0 || ' ' WHEN 3 THEN (start0 + 1) || '..' || (end0 + n) WHEN 4 THEN type || ' ' || (start0 + 1) WHEN 5 THEN start0 || '-' || end0 ELSE (start0 + 1) || '..' END AS query FROM f
    ), y AS (SELECT *, string_split(replace(ltrim(trim(query), ':'), '..', '-'), '-') AS ps FROM x), z AS (SELECT *, TRY_CAST(trim(ps[1]) AS BIGINT) AS a, TRY_CAST(trim(ps[len(ps)]) AS BIGINT) AS b FROM y)
        SELECT doc_id, feature_id, query, CASE WHEN a >= 1 AND b >= a AND b <= n THEN a END AS start1, CASE WHEN a >= 1 AND b >= a AND b <= n THEN b END AS end1 FROM z""",
    "selection_overlap": _w(SEQUENCES, FEATURES) + ", h AS (SELECT doc_id, feature_id, a, b, row_number() OVER (PARTITION BY doc_id, feature_id ORDER BY k) AS r FROM fs WHERE a < n * 2 // 3 AND n // 3 < b) SELECT doc_id, feature_id, a + 1 AS start1, b AS end1 FROM h WHERE r = 1",
    "feature_midpoints": _w(SEQUENCES, FEATURES) + ", z AS (SELECT *, CASE WHEN wraps THEN n - start0 + end0 ELSE end0 - start0 END AS size FROM f), m AS (SELECT *, (start0 + size // 2) % n AS mid0 FROM z) SELECT doc_id, feature_id, size, mid0, mid0 * 1000 // n AS angle_permille FROM m",
    "sequence_fnv": _w(SEQUENCES) + f" SELECT doc_id, {_FNV.format('seq')} AS fnv FROM s",
    "diff_manifest": _w(SEQUENCES) + _PLANT + f""", j AS (SELECT doc_id, CAST(to_json({{'doc_id': doc_id, 'end0': p + 3, 'n': 3, 'qry_bases': substr(q, p + 1, 3), 'ref_bases': substr(r, p + 1, 3), 'start0': p}}) AS VARCHAR) AS manifest FROM pq)
        SELECT doc_id, manifest, lpad(lower(printf('%x', {_FNV.format('manifest')})), 8, '0') AS checksum FROM j""",
    "diff_summary": _w(SEQUENCES) + " SELECT doc_id, CAST(1 AS BIGINT) AS n_differences, CAST(1 AS BIGINT) AS edit_distance, (n - 1) * 100.0::DOUBLE / n AS identity_percent FROM s",
    "rotation_votes": _w(SEQUENCES) + " SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_changed FROM s",
    "crispr_region": _w(SEQUENCES, _crispr_sql("SpCas9")) + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, strand DESC, pam_start0) AS rank, strand, pam_start0, score FROM tg WHERE topology = 'linear' AND score >= 60 AND pam_start0 >= n // 4 AND pam_start0 + 3 <= n // 2 QUALIFY rank <= 20",
    "copy_region": _w(SEQUENCES) + """, x AS (SELECT doc_id, 'copy' AS kind, substr(seq, 1, n // 2) AS t FROM s UNION ALL SELECT doc_id, 'inverted', reverse(translate(substr(seq, n // 2 + 1), 'ACGT', 'TGCA')) FROM s)
        SELECT doc_id, kind, CAST(length(t) AS BIGINT) AS n, sha256(t) AS sha256 FROM x""",
    "enzyme_catalog": f"WITH e(enzyme_id, recognition, category, f, r, n_aliases) AS (VALUES {_CAT}) SELECT enzyme_id, recognition, category, CASE WHEN f < r THEN '5'' overhang' WHEN f > r THEN '3'' overhang' ELSE 'blunt' END AS end_type, abs(f - r) AS overhang_len, n_aliases FROM e",
    "project_list": "SELECT o_custkey AS user_id, o_orderkey AS project_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders QUALIFY place <= 5",
    "restore_revision": "SELECT user_id AS doc_id, max(event_id) + 1 AS version, sha256(CAST(min(event_id) AS VARCHAR)) AS hash FROM events GROUP BY 1",
    "hydrate_unseen": _w(SEQUENCES) + " SELECT doc_id, CAST(length(seq) AS BIGINT) AS n FROM all_seq WHERE NOT (doc_id % 3 = 0 AND length(seq) >= 100)",
    "fragment_features": _w(SEQUENCES, FEATURES, _scan_sql(PAIR), _CUTS) + """, fr AS (SELECT frag.doc_id, fragment_no, frag.start0, frag.length, s.n FROM frag JOIN s USING (doc_id)),
        pc AS (SELECT doc_id, fragment_no, n, start0 AS origin, start0 AS c, least(start0 + length, n) AS d FROM fr UNION ALL SELECT doc_id, fragment_no, n, start0, 0, start0 + length - n FROM fr WHERE start0 + length > n),
        sz AS (SELECT doc_id, feature_id, sum(b - a) AS size FROM fs GROUP BY ALL),
        j AS (SELECT fs.doc_id, pc.fragment_no, fs.feature_id, fs.strand, ((greatest(a, c) - origin) % pc.n + pc.n) % pc.n AS x, least(b, d) - greatest(a, c) AS k FROM fs JOIN pc ON fs.doc_id = pc.doc_id AND greatest(a, c) < least(b, d))
        SELECT doc_id, fragment_no, feature_id, strand, min(x) AS first0, max(x + k) AS last0, CAST(sum(k) AS BIGINT) AS n_bases, sum(k) < any_value(size) AS clipped FROM j JOIN sz USING (doc_id, feature_id) GROUP BY ALL""",
    "interval_map": _w(SEQUENCES) + " SELECT doc_id, n // 3 AS n_bases, true AS same FROM s WHERE topology = 'circular'",
    "normalized": _w(SEQUENCES) + " SELECT doc_id, sha256(seq) AS sha256 FROM s",
    "enzyme_search": "WITH e(enzyme_id, name, aliases, category) AS (VALUES " + ", ".join(f"('{e['enzyme_id']}', '{e['name']}', '{' '.join(e['aliases'])}', '{e['category']}')" for e in enzymes()) + ") SELECT enzyme_id, name, category FROM e WHERE contains(lower(name), 'bs') OR contains(lower(aliases), 'bs')",
    "project_upsert": """WITH ch AS (SELECT coalesce(o_custkey, user_id) AS user_id, event_id AS project_id, event_id % 7 = 0 AS deleted, event_id + 1000000000 AS pos FROM events LEFT JOIN orders ON o_orderkey = event_id),
        la AS (SELECT user_id, project_id, max(pos) AS pos, arg_max(deleted, pos) AS deleted FROM ch GROUP BY ALL)
        SELECT coalesce(la.user_id, o_custkey) AS user_id, coalesce(la.project_id, o_orderkey) AS project_id, coalesce(o_orderkey, pos) AS created, coalesce(pos, o_orderkey) AS updated
        FROM orders FULL JOIN la ON o_orderkey = la.project_id AND o_custkey = la.user_id WHERE NOT coalesce(deleted, false)""",
}
