"""Queries on nucleotide content, restriction sites and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nt
from ..functions.tables import codons, enzyme_table, enzymes
from ..operators import digest, restriction
from ..operators.scan import strand_patterns
from ..plans.fixtures import SEQUENCES, sequences, table

#: Enzymes of the queries: overhangs of either polarity, blunt ends, an ambiguous site, and one that cuts outside its site.
PANEL = ("EcoRI", "HindIII", "BamHI", "PstI", "SmaI", "Bsu36I", "BsaI", "SfiI")
PAIR = ("EcoRI", "HindIII")
#: All names of the catalogue's enzymes, other names behind the own ones.
NAMES = tuple(dict.fromkeys([e["name"] for e in enzymes()] + [a for e in enzymes() for a in e["aliases"]]))


def _scan_sql(names: tuple[str, ...]) -> str:
    """CTE `sites`: string splits give the parts between matches, whose lengths add up; a site of SfiI that begins inside an earlier one is not found."""
    rows = []
    for p in strand_patterns([{"motif": e["recognition"], **e} for e in enzymes(*names)]):
        rx = "".join({"N": "[ACGT]"}.get(c, c) for c in (p["motif"] if p["strand"] == 1 else nt.rc(p["motif"])))
        rows.append(f"('{p['enzyme_id']}', {p['strand']}, '{rx}', {p['width']}, {p['fwd_cut']}, {p['rev_cut']})")
    return f"""
pat(enzyme_id, strand, rx, w, fwd, rev) AS (VALUES {', '.join(rows)}),
hay AS (
  SELECT doc_id, topology, n, pat.*, string_split_regex(CASE WHEN topology = 'circular' THEN seq || substr(seq, 1, w - 1) ELSE seq END, rx) AS parts
  FROM s, pat WHERE n >= w
), hit AS (
  SELECT *, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * w AS BIGINT) AS start0
  FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM hay)
), sites AS (
  SELECT doc_id, topology, n, enzyme_id, CAST(strand AS BIGINT) AS strand, start0, CASE WHEN start0 + w <= n THEN start0 + w ELSE (start0 + w) % n END AS end0,
         ((CASE WHEN strand = 1 THEN start0 + fwd ELSE start0 + w - rev END) % n + n) % n AS fwd_cut0,
         ((CASE WHEN strand = 1 THEN start0 + rev ELSE start0 + w - fwd END) % n + n) % n AS rev_cut0
  FROM hit
)"""


_CUTS = """
cuts AS (
  SELECT doc_id, topology, n, fwd_cut0 AS cut0, arg_min(rev_cut0, (start0, enzyme_id, strand)) AS rev_cut0, count(DISTINCT rev_cut0) > 1 AS ambiguous
  FROM sites GROUP BY ALL
), c AS (
  SELECT *, lead(cut0) OVER (PARTITION BY doc_id ORDER BY cut0) AS next0, row_number() OVER (PARTITION BY doc_id ORDER BY cut0) AS k, min(cut0) OVER (PARTITION BY doc_id) AS first0 FROM cuts
), frag AS (
  SELECT doc_id, k AS fragment_no, cut0 AS start0, coalesce(next0, first0) AS end0, coalesce(next0 - cut0, n - cut0 + first0) AS length, cut0 AS left_cut, coalesce(next0, first0) AS right_cut FROM c WHERE topology = 'circular'
  UNION ALL SELECT doc_id, 1, 0, cut0, cut0, NULL, cut0 FROM c WHERE topology = 'linear' AND k = 1
  UNION ALL SELECT doc_id, k + 1, cut0, coalesce(next0, n), coalesce(next0, n) - cut0, cut0, next0 FROM c WHERE topology = 'linear'
  UNION ALL SELECT doc_id, 1, 0, n, n, NULL, NULL FROM s WHERE doc_id NOT IN (SELECT doc_id FROM c)
)"""

_ENDS = """
e0 AS (
  SELECT c.doc_id, c.topology, c.n, c.cut0, c.rev_cut0, c.ambiguous, s.seq || s.seq AS twice, rev_cut0 - cut0 AS raw FROM cuts c JOIN s USING (doc_id)
), e1 AS (
  SELECT *, CASE WHEN topology <> 'circular' THEN raw WHEN raw * 2 > n THEN raw - n WHEN raw * 2 < -n THEN raw + n ELSE raw END AS d FROM e0
), e2 AS (
  SELECT *, substr(twice, CASE WHEN d >= 0 THEN cut0 ELSE rev_cut0 END + 1, abs(d)) AS o FROM e1
), ends AS (
  SELECT doc_id, cut0, CASE WHEN ambiguous THEN 'ambiguous' WHEN d > 0 THEN '5'' overhang' WHEN d < 0 THEN '3'' overhang' ELSE 'blunt' END AS end_type, abs(d) AS overhang_len,
         CASE WHEN d > 0 THEN reverse(translate(o, 'ACGT', 'TGCA')) ELSE o END AS left_overhang,
         CASE WHEN d < 0 THEN reverse(translate(o, 'ACGT', 'TGCA')) ELSE o END AS right_overhang, ambiguous FROM e2
)"""


def _sites(spark, d, names=PANEL):
    return restriction.restriction_sites(sequences(spark, d), enzymes(*names))


def nt_profile(spark, d):
    s = F.col("seq")
    return sequences(spark, d, 0).select("doc_id", "n", nt.gc_permille(s).alias("gc_permille"), *[nt.count_of(s, c).cast("long").alias(f"n_{c.lower()}") for c in "ACGT"], nt.alphabet(s).alias("alphabet"))


def nt_reverse_complement(spark, d):
    return sequences(spark, d, 0).select("doc_id", nt.reverse_complement(F.col("seq")).alias("rc"))


def nt_subsequence_wrapped(spark, d):
    return sequences(spark, d).select("doc_id", nt.subsequence(F.col("seq"), F.floor(F.col("n") * 3 / 4).cast("int"), F.floor(F.col("n") / 4).cast("int")).alias("part"), nt.subsequence(F.col("seq"), F.lit(5), F.lit(15)).alias("inner_part"))


def nt_rotate(spark, d):
    return sequences(spark, d).select("doc_id", nt.rotate(F.col("seq"), F.pmod(F.col("doc_id") * 7, F.col("n")).cast("int")).alias("rotated"))


def nt_sha256(spark, d):
    return sequences(spark, d, 0).select("doc_id", nt.sequence_hash(F.col("seq")).alias("sha256"))


def translate_frames(spark, d):
    s = sequences(spark, d)
    strands = s.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("strand"), F.col("seq").alias("x")), F.struct(F.lit(-1).alias("strand"), nt.reverse_complement(F.col("seq")).alias("x")))).alias("p"))
    frames = strands.select("doc_id", "p.strand", "p.x", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("frame"))
    p = nt.translate_codons(F.substr("x", F.col("frame")))
    return frames.select("doc_id", F.col("strand").cast("long").alias("strand"), F.col("frame").cast("long").alias("frame"), p.alias("protein"))


def site_scan(spark, d):
    return _sites(spark, d).drop("topology", "n")


def site_counts(spark, d):
    return _sites(spark, d).groupBy("enzyme_id").agg(F.count(F.lit(1)).alias("n_sites"), F.countDistinct("doc_id").alias("n_docs"))


def _counts(spark, d):
    return restriction.site_counts(sequences(spark, d), _sites(spark, d), enzymes(*PANEL))


def unique_double_cutters(spark, d):
    return _counts(spark, d).filter("n_sites in (1, 2)").select("doc_id", "enzyme_id", "n_sites", restriction.cutter_class(F.col("n_sites")).alias("cutter"))


def non_cutters(spark, d):
    every = _counts(spark, d).select("doc_id", "enzyme_id")
    return every.join(_sites(spark, d).select("doc_id", "enzyme_id"), ["doc_id", "enzyme_id"], "left_anti")


def cutter_filter_by_class(spark, d):
    e = F.broadcast(enzyme_table(spark, *PANEL).select("enzyme_id", "category"))
    c = _counts(spark, d).join(e, "enzyme_id").withColumn("cutter", restriction.cutter_class(F.col("n_sites")))
    return c.rollup("category", "cutter").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("n_sites").alias("n_sites"))


def _enzyme_order(spark):
    rows = [(e["enzyme_id"], e["name"], e["aliases"], i) for i, e in enumerate(enzymes())]
    return spark.createDataFrame(rows, "enzyme_id string, name string, aliases array<string>, ord int")


def _terms(spark, d):
    """A search term for each part: an enzyme's name in other case, padded, cut short, with a letter or a number too many, or no name."""
    k = F.col("p_partkey")
    name = F.get(F.array(*[F.lit(x) for x in NAMES]), (k % len(NAMES)).cast("int"))
    forms = (F.lower(name), F.concat(F.lit(" "), F.upper(name), F.lit(" ")), F.left(name, F.length(name) - 1), F.concat(name, F.lit("x")), F.regexp_replace(name, "I$", "1"), F.col("p_brand"), name)
    term = F.coalesce(*[F.when(k % len(forms) == i, f) for i, f in enumerate(forms)])
    return table(spark, d, "part").select("p_partkey", term.alias("term"))


def enzyme_lookup(spark, d):
    return restriction.lookup(_terms(spark, d), _enzyme_order(spark))


def enzyme_suggest(spark, d):
    return restriction.suggest(_terms(spark, d).select("term").distinct(), _enzyme_order(spark))


def _fragments(spark, d, names=PAIR):
    return digest.fragments(sequences(spark, d).select("doc_id", "topology", "n"), digest.cuts(_sites(spark, d, names)))


def digest_fragments(spark, d):
    return _fragments(spark, d, ("EcoRI",))


def double_digest(spark, d):
    return _fragments(spark, d)


def digest_invariant(spark, d):
    s = sequences(spark, d).select("doc_id", "n")
    return _fragments(spark, d).groupBy("doc_id").agg(F.sum("length").alias("total"), F.count(F.lit(1)).alias("n_fragments")).join(s, "doc_id").select("doc_id", "n_fragments", "total", (F.col("total") == F.col("n")).alias("holds"))


def digest_sorted_by_length(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("doc_id").orderBy(F.desc("length"), "fragment_no")
    f = _fragments(spark, d).withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
    return f.select("doc_id", F.col("rank").cast("long").alias("rank"), "fragment_no", "length")


def cut_ends(spark, d):
    return digest.cut_ends(sequences(spark, d), digest.cuts(_sites(spark, d)))


def compatible_end_pairs(spark, d):
    """Pairs of ends that anneal, counted by overhang: ends meet by their overhangs, not one by one."""
    e = digest.cut_ends(sequences(spark, d), digest.cuts(_sites(spark, d))).filter("end_type <> 'ambiguous'")
    left = e.groupBy("end_type", F.col("left_overhang").alias("o")).agg(F.count(F.lit(1)).alias("n_left"))
    right = e.groupBy("end_type", nt.reverse_complement(F.col("right_overhang")).alias("o")).agg(F.count(F.lit(1)).alias("n_right"))
    return left.join(right, ["end_type", "o"]).select("end_type", F.col("o").alias("overhang"), "n_left", "n_right", (F.col("n_left") * F.col("n_right")).alias("n_pairs"))


def clone_plan(spark, d):
    s = sequences(spark, d)
    cut = digest.cuts(_sites(spark, d, PAIR))
    pairs = s.filter("topology = 'circular'").select(F.col("doc_id").alias("vector_id"), (F.col("doc_id") + 1).alias("insert_id"))
    pairs = pairs.join(s.select(F.col("doc_id").alias("insert_id")), "insert_id", "left_semi").select("vector_id", "insert_id")
    return digest.clone_plans(pairs, digest.fragments(s.select("doc_id", "topology", "n"), cut), digest.cut_ends(s, cut))


def _w(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_ENZ = f"""enz(enzyme_id, name, ord) AS (VALUES {_values([(e['enzyme_id'], e['name'], i) for i, e in enumerate(enzymes())])}),
al(enzyme_id, alias) AS (VALUES {_values([(e['enzyme_id'], a) for e in enzymes() for a in e['aliases']])})"""
_COUNTS = f"""en(enzyme_id, category) AS (VALUES {_values([(e['enzyme_id'], e['category']) for e in enzymes(*PANEL)])}),
cnt AS (SELECT s.doc_id, en.enzyme_id, en.category, coalesce(x.k, 0) AS n_sites FROM s CROSS JOIN en LEFT JOIN (SELECT doc_id, enzyme_id, count(*) AS k FROM sites GROUP BY ALL) x ON x.doc_id = s.doc_id AND x.enzyme_id = en.enzyme_id),
cls AS (SELECT *, CASE n_sites WHEN 0 THEN 'non' WHEN 1 THEN 'unique' WHEN 2 THEN 'double' ELSE 'multiple' END AS cutter FROM cnt)"""
_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
_CODE = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in codons().items()) + "}"

_TERMS = f"""named AS (SELECT p_partkey, p_brand, [{', '.join(f"'{x}'" for x in NAMES)}][p_partkey % {len(NAMES)} + 1] AS name FROM part), terms AS (
  SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN lower(name) WHEN 1 THEN ' ' || upper(name) || ' ' WHEN 2 THEN name[:-2] WHEN 3 THEN name || 'x' WHEN 4 THEN regexp_replace(name, 'I$', '1') WHEN 5 THEN p_brand ELSE name END AS term FROM named)"""

QUERIES = {
    f.__name__: f
    for f in (
        nt_profile, nt_reverse_complement, nt_subsequence_wrapped, nt_rotate, nt_sha256, translate_frames, site_scan, site_counts, unique_double_cutters, non_cutters, cutter_filter_by_class,
        enzyme_lookup, enzyme_suggest, digest_fragments, double_digest, digest_invariant, digest_sorted_by_length, cut_ends, compatible_end_pairs, clone_plan,
    )
}

ORACLE_SQL = {
    "nt_profile": _w(SEQUENCES) + """, p AS (SELECT doc_id, seq, CAST(length(seq) AS BIGINT) AS n, length(seq) - length(replace(seq, 'A', '')) AS n_a, length(seq) - length(replace(seq, 'C', '')) AS n_c,
        length(seq) - length(replace(seq, 'G', '')) AS n_g, length(seq) - length(replace(seq, 'T', '')) AS n_t FROM all_seq)
        SELECT doc_id, n, CAST(CASE WHEN n > 0 THEN floor((n_g + n_c) * 1000.0 / n + 0.5) ELSE 0 END AS BIGINT) AS gc_permille, n_a, n_c, n_g, n_t, CASE WHEN n > 0 THEN 'DNA' ELSE 'UNKNOWN' END AS alphabet FROM p""",
    "nt_reverse_complement": _w(SEQUENCES) + f" SELECT doc_id, {_RC.format('seq')} AS rc FROM all_seq",
    "nt_subsequence_wrapped": _w(SEQUENCES) + " SELECT doc_id, substr(seq, CAST(floor(n * 3 / 4) AS BIGINT) + 1) || substr(seq, 1, CAST(floor(n / 4) AS BIGINT)) AS part, substr(seq, 6, 10) AS inner_part FROM s",
    "nt_rotate": _w(SEQUENCES) + " SELECT doc_id, substr(seq, doc_id * 7 % n + 1) || substr(seq, 1, doc_id * 7 % n) AS rotated FROM s",
    "nt_sha256": _w(SEQUENCES) + " SELECT doc_id, sha256(upper(trim(seq))) AS sha256 FROM all_seq",
    "translate_frames": _w(SEQUENCES) + f""", x AS (SELECT doc_id, 1 AS strand, seq AS x FROM s UNION ALL SELECT doc_id, -1, {_RC.format('seq')} FROM s), y AS (SELECT *, unnest([1, 2, 3]) AS frame FROM x)
        SELECT doc_id, CAST(strand AS BIGINT) AS strand, CAST(frame AS BIGINT) AS frame, array_to_string(list_transform(regexp_extract_all(substr(x, frame), '...'), lambda c: coalesce({_CODE}[c], 'X')), '') AS protein FROM y""",
    "site_scan": _w(SEQUENCES, _scan_sql(PANEL)) + " SELECT doc_id, enzyme_id, strand, start0, end0, fwd_cut0, rev_cut0 FROM sites",
    "site_counts": _w(SEQUENCES, _scan_sql(PANEL)) + " SELECT enzyme_id, count(*) AS n_sites, count(DISTINCT doc_id) AS n_docs FROM sites GROUP BY 1",
    "unique_double_cutters": _w(SEQUENCES, _scan_sql(PANEL), _COUNTS) + " SELECT doc_id, enzyme_id, n_sites, cutter FROM cls WHERE n_sites IN (1, 2)",
    "non_cutters": _w(SEQUENCES, _scan_sql(PANEL), _COUNTS) + " SELECT doc_id, enzyme_id FROM cls WHERE n_sites = 0",
    "cutter_filter_by_class": _w(SEQUENCES, _scan_sql(PANEL), _COUNTS) + " SELECT category, cutter, count(*) AS n_pairs, CAST(sum(n_sites) AS BIGINT) AS n_sites FROM cls GROUP BY ROLLUP (category, cutter)",
    "enzyme_lookup": f"""WITH {_ENZ}, {_TERMS}, k AS (SELECT lower(name) AS key, enzyme_id, 0 AS tier, 0 AS ord FROM enz UNION ALL SELECT lower(alias), enzyme_id, 1, ord FROM al JOIN enz USING (enzyme_id))
        SELECT p_partkey, term, (SELECT first(enzyme_id ORDER BY tier, ord DESC) FROM k WHERE key = lower(trim(term))) AS enzyme_id FROM terms""",
    "enzyme_suggest": f"""WITH {_ENZ}, {_TERMS}, t0 AS (SELECT DISTINCT term FROM terms), t AS (SELECT term, regexp_replace(regexp_replace(regexp_replace(lower(trim(term)), '1$', 'i'), '2$', 'ii'), '3$', 'iii') AS t FROM t0),
        nm AS (SELECT enzyme_id, lower(name) AS x FROM enz UNION ALL SELECT enzyme_id, lower(alias) FROM al),
        p AS (SELECT term, enz.enzyme_id, levenshtein(t, lower(enz.name)) AS d, CASE WHEN bool_or(starts_with(x, t)) THEN 0 WHEN bool_or(contains(x, t)) THEN 1 WHEN levenshtein(t, lower(enz.name)) <= 2 THEN 2 END AS tier
              FROM t CROSS JOIN enz JOIN nm USING (enzyme_id) GROUP BY term, t, enz.enzyme_id, enz.name),
        r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tier, d, enzyme_id) AS rank FROM p WHERE tier IS NOT NULL)
        SELECT term, rank, enzyme_id, CAST(tier AS BIGINT) AS tier FROM r WHERE rank <= 5""",
    "digest_fragments": _w(SEQUENCES, _scan_sql(("EcoRI",)), _CUTS) + " SELECT * FROM frag",
    "double_digest": _w(SEQUENCES, _scan_sql(PAIR), _CUTS) + " SELECT * FROM frag",
    "digest_invariant": _w(SEQUENCES, _scan_sql(PAIR), _CUTS) + " SELECT frag.doc_id, count(*) AS n_fragments, CAST(sum(length) AS BIGINT) AS total, sum(length) = any_value(s.n) AS holds FROM frag JOIN s USING (doc_id) GROUP BY 1",
    "digest_sorted_by_length": _w(SEQUENCES, _scan_sql(PAIR), _CUTS) + ", r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, fragment_no) AS rank, fragment_no, length FROM frag) SELECT * FROM r WHERE rank <= 3",
    "cut_ends": _w(SEQUENCES, _scan_sql(PANEL), _CUTS, _ENDS) + " SELECT * FROM ends",
    "compatible_end_pairs": _w(SEQUENCES, _scan_sql(PANEL), _CUTS, _ENDS) + f""", l AS (SELECT end_type, left_overhang AS overhang, count(*) AS n_left FROM ends WHERE end_type <> 'ambiguous' GROUP BY ALL),
        r AS (SELECT end_type, {_RC.format('right_overhang')} AS overhang, count(*) AS n_right FROM ends WHERE end_type <> 'ambiguous' GROUP BY ALL)
        SELECT end_type, overhang, n_left, n_right, n_left * n_right AS n_pairs FROM l JOIN r USING (end_type, overhang)""",
    "clone_plan": _w(SEQUENCES, _scan_sql(PAIR), _CUTS, _ENDS) + f""", b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, fragment_no) AS r FROM frag WHERE left_cut IS NOT NULL AND right_cut IS NOT NULL AND length > 0),
        x AS (SELECT b.doc_id, b.length, l.end_type AS lt, l.right_overhang AS lo, r.end_type AS rt, r.left_overhang AS ro FROM b JOIN ends l ON l.doc_id = b.doc_id AND l.cut0 = b.left_cut JOIN ends r ON r.doc_id = b.doc_id AND r.cut0 = b.right_cut WHERE b.r = 1),
        p AS (SELECT v.doc_id AS vector_id, i.doc_id AS insert_id FROM s v JOIN s i ON i.doc_id = v.doc_id + 1 WHERE v.topology = 'circular'),
        j AS (SELECT vector_id, insert_id, v.length AS vl, i.length AS il, v.lt AS vlt, v.lo AS vlo, v.rt AS vrt, v.ro AS vro, i.lt AS ilt, i.lo AS ilo, i.rt AS irt, i.ro AS iro FROM p LEFT JOIN x v ON v.doc_id = vector_id LEFT JOIN x i ON i.doc_id = insert_id),
        k AS (SELECT *, coalesce((vrt = 'blunt' AND ilt = 'blunt') OR (vrt = ilt AND vrt LIKE '%overhang' AND vro = {_RC.format('ilo')}), false) AND coalesce((irt = 'blunt' AND vlt = 'blunt') OR (irt = vlt AND irt LIKE '%overhang' AND iro = {_RC.format('vlo')}), false) AS f,
              coalesce((vrt = 'blunt' AND irt = 'blunt') OR (vrt = irt AND vrt LIKE '%overhang' AND vro = {_RC.format('iro')}), false) AND coalesce((ilt = 'blunt' AND vlt = 'blunt') OR (ilt = vlt AND ilt LIKE '%overhang' AND ilo = {_RC.format('vlo')}), false) AS g FROM j)
        SELECT vector_id, insert_id, vl AS vector_length, il AS insert_length, f AS forward, g AS reverse, CASE WHEN f OR g THEN vl + il END AS product_length,
               CASE WHEN vl IS NULL THEN 'NO_VECTOR_CUT' WHEN il IS NULL THEN 'NO_INSERT_CUT' WHEN NOT (f OR g) THEN 'INCOMPATIBLE_ENDS' END AS error_code FROM k""",
}
