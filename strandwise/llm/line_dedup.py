"""Line dedup: lines found in many documents stay only in the largest document id that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_folded, salted_join

MIN_CHARS, MIN_DOCS = 20, 3


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Every row of docs with its text less the repeated lines, plus n_lines and n_dropped (long).

    A line's key is its trimmed, lower-cased form. Keys of at least min_chars code points found in at least min_docs distinct
    document ids lose all their lines except in the largest id holding them; other lines stay, joined by \\n.
    Null text counts as empty, that is one empty line. A null id is a document of its own, below every other id. Rows that
    repeat an id count as one document and are all returned. Columns of docs named n_lines or n_dropped are replaced; other
    columns pass through. An empty table gives an empty result.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    # rows of one id may differ in text: positions belong to the pair of id and text
    rows = rows.withColumn("mark", F.xxhash64("body"))
    lines = rows.select("id", "mark", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    lines = lines.filter(F.length("line") >= min_chars).select("id", "mark", "pos", F.btrim("line", F.lit(SPACES)).alias("key"))
    lines = lines.filter(F.length("key") >= min_chars).select("id", "mark", "pos", F.unhex(F.md5(ascii_folded(F.col("key")))).alias("digest"))
    holders = lines.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("m")).groupBy("digest").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("m").alias("n"), F.max("id").alias("keeper"))
    repeated = holders.filter(F.col("n_docs") >= min_docs).select("digest", "n", "keeper")
    gone = salted_join(lines, repeated, "digest", "n", F.struct("id", "pos")).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy("id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("gone")).select(F.col("id").alias("id_"), F.col("mark").alias("mark_"), "gone")
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("id_")) & (F.col("mark") == F.col("mark_")), "left")
    out = out.select("row", "body", "gone", F.split("body", "\n", -1).alias("lines"))
    n = F.size("lines")
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(n))
    between = F.transform(
        F.zip_with(F.slice(edges, 1, F.size("gone") + 1), F.slice(edges, 2, F.size("gone") + 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda x: F.slice(F.col("lines"), x["a"] + 2, x["b"] - x["a"] - 1),
    )
    kept = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(F.flatten(between), "\n"))
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    own = {text_col.lower(), "n_lines", "n_dropped"}
    keep = [F.col(f"row.`{c}`").alias(c) if c.lower() not in own else kept.alias(c) for c in docs.columns if c.lower() not in own or c.lower() == text_col.lower()]
    return out.select(*keep, n.cast("long").alias("n_lines"), n_gone.cast("long").alias("n_dropped"))


def op1_line_dedup(spark, sf_dir):
    from .common import table

    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), j AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
