"""Queries on staged edits, activity, search, and the ordinary relational work on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import nt
from ..functions.tables import enzyme_table, enzymes
from ..operators import workspace as ws
from ..plans.fixtures import FEATURES, SEQUENCES, features, sequences, table
from ..streaming.activity import windowed_counts

QUERY = "cds"


def _transactions(spark, d):
    """One staged edit an event: its base is now and then an older version, and now and then another text."""
    e = table(spark, d, "events")
    docs = F.broadcast(table(spark, d, "documents").agg(F.count(F.lit(1)).alias("docs")))
    e = e.join(docs).withColumn("doc_id", F.col("event_id") * 7 % F.col("docs"))
    cur = sequences(spark, d, 0).select("doc_id", (F.col("doc_id") % 3).alias("version"), nt.sequence_hash(F.col("seq")).alias("hash"))
    tx = e.join(cur, "doc_id").select(
        F.col("event_id").alias("tx_id"), "doc_id", (F.col("event_id") % 3).alias("base_version"), F.when(F.col("event_id") % 5 == 0, "old").otherwise(F.col("hash")).alias("base_hash"),
        F.when(F.col("event_id") % 11 == 0, "rejected").when(F.col("event_id") % 13 == 0, "pending").otherwise("approved").alias("decision"),
    )
    return tx, cur


def tx_commit(spark, d):
    return ws.commit(*_transactions(spark, d))


def tx_status_counts(spark, d):
    return tx_commit(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def undo_depth(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return ws.undo_depth(e, "user_id", ["ts", "event_id"], F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)).select("event_id", "user_id", "depth")


def activity_latest(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("actor"), F.col("event_type").alias("tool"))
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


def activity_by_tool(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_actors"), F.max("ts").alias("last_ts"))
    return g


def activity_sessions(spark, d):
    return ws.sessions(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", 1800).withColumn("session_no", F.col("session_no").cast("long"))


def activity_windows(spark, d):
    return windowed_counts(table(spark, d, "events")).select("window_start", "tool", "n_events")


def batch_prefix(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return ws.until_error(c, "conv_id", "turn", F.coalesce(F.col("n") % 7 == 0, F.lit(False))).select("conv_id", "turn", "role")


def upsert_documents(spark, d):
    s = sequences(spark, d).select("doc_id", "topology", "n")
    e = table(spark, d, "events").join(F.broadcast(table(spark, d, "documents").agg(F.count(F.lit(1)).alias("docs"))))
    ch = e.select((F.col("event_id") * 7 % F.col("docs")).alias("doc_id"), F.lit("linear").alias("topology"), (F.col("event_id") % 1000).alias("n"), (F.col("event_id") % 17 == 0).alias("deleted"), F.col("event_id").alias("at"))
    return ws.upsert(s, ch, "doc_id", "at")


def workspace_search(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc "), "source").alias("label"))
    f = features(spark, d).select(F.concat_ws(":", "doc_id", "feature_id").alias("id"), F.col("type").alias("label"))
    e = enzyme_table(spark).select(F.col("enzyme_id").alias("id"), F.col("name").alias("label"))
    return ws.search({"document": docs, "feature": f, "enzyme": e}, QUERY)


def document_list(spark, d):
    """Documents with length, content and version, as the list shows them."""
    s = sequences(spark, d, 0)
    return s.select("doc_id", "topology", "n", (nt.gc_permille(F.col("seq")) / 10).alias("gc_percent"), F.concat(F.substr("seq", F.lit(1), F.lit(10)), F.lit("..."), F.right("seq", F.lit(10))).alias("preview"))


def coordinate_check(spark, d):
    """1-based inclusive places of features, and whether they are valid for their molecule."""
    f = features(spark, d)
    error = F.when((F.col("topology") == "linear") & (F.col("end0") < F.col("start0")), "INVERTED_RANGE").when((F.col("start0") < 0) | (F.col("end0") > F.col("n")), "OUT_OF_BOUNDS")
    return f.select("doc_id", "feature_id", (F.col("start0") + 1).alias("start1"), F.col("end0").alias("end1"), F.col("wraps"), error.alias("error_code"))


def semi_customers_with_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def anti_parts_never_sold(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


def union_intersect_except(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    b = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": b.exceptAll(a.distinct()).distinct()}
    out = None
    for name, df in parts.items():
        part = df.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total")).select(F.lit(name).alias("op"), "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


def rollup_flag_status(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_suppkey").alias("total"), F.grouping_id().cast("long").alias("level"))


def rank_suppliers(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy(F.desc("n"), "l_suppkey")
    # the best hundred by a distributed top-k; only these are ranked in one task
    top = g.orderBy(F.desc("n"), "l_suppkey").limit(100)
    return top.select("l_suppkey", "n", F.row_number().over(w).cast("long").alias("rank"))


def topk_orders(spark, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, d, "orders").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 3")
    return o.select("o_custkey", "o_orderkey", "rank")


def _w(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


_TX = """, cur AS (SELECT doc_id, doc_id % 3 AS version, sha256(seq) AS hash FROM all_seq),
tx AS (SELECT event_id AS tx_id, doc_id, event_id % 3 = version AND event_id % 5 <> 0 AND NOT (event_id % 11 = 0) AND NOT (event_id % 13 = 0) AS fits, version, CASE WHEN event_id % 11 = 0 THEN 'rejected' WHEN event_id % 13 = 0 THEN 'pending' ELSE 'approved' END AS decision
       FROM events JOIN cur ON event_id * 7 % (SELECT count(*) FROM documents) = doc_id),
st AS (SELECT *, sum(CASE WHEN fits THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY tx_id) AS k FROM tx),
res AS (SELECT tx_id, doc_id, CASE WHEN decision <> 'approved' THEN decision WHEN fits AND k = 1 THEN 'applied' ELSE 'stale' END AS status, version FROM st)"""
_ENZ = ", ".join(f"('{e['enzyme_id']}', '{e['name']}')" for e in enzymes())

QUERIES = {
    f.__name__: f
    for f in (
        tx_commit, tx_status_counts, undo_depth, activity_latest, activity_by_tool, activity_sessions, activity_windows, batch_prefix, upsert_documents, workspace_search, document_list, coordinate_check,
        semi_customers_with_orders, anti_parts_never_sold, union_intersect_except, rollup_flag_status, rank_suppliers, topk_orders,
    )
}

ORACLE_SQL = {
    "tx_commit": _w(SEQUENCES) + _TX + " SELECT tx_id, doc_id, status, CASE WHEN status = 'applied' THEN version + 1 ELSE version END AS version FROM res",
    "tx_status_counts": _w(SEQUENCES) + _TX + " SELECT status, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM res GROUP BY 1",
    "undo_depth": """WITH a AS (SELECT event_id, user_id, ts, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
        b AS (SELECT *, least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS low FROM a) SELECT event_id, user_id, CAST(least(50, s - low) AS BIGINT) AS depth FROM b""",
    "activity_latest": "SELECT event_id, ts, user_id AS actor, event_type AS tool FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "activity_by_tool": "SELECT event_type AS tool, count(*) AS n, count(DISTINCT user_id) AS n_actors, max(ts) AS last_ts FROM events GROUP BY 1",
    "activity_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events),
        b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM a) SELECT user_id, CAST(k AS BIGINT) AS session_no, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY 1, 2""",
    "activity_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type AS tool, count(*) AS n_events FROM events GROUP BY 1, 2",
    "batch_prefix": """WITH a AS (SELECT conv_id, turn, role, coalesce(max(CASE WHEN length(text) % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM conversations) SELECT conv_id, turn, role FROM a WHERE f = 0""",
    "upsert_documents": _w(SEQUENCES) + """, ch AS (SELECT event_id * 7 % (SELECT count(*) FROM documents) AS doc_id, 'linear' AS topology, event_id % 1000 AS n, event_id % 17 = 0 AS deleted, event_id AS pos FROM events),
        u AS (SELECT doc_id, topology, n, false AS deleted, -1 AS pos FROM s UNION ALL SELECT * FROM ch) SELECT doc_id, topology, n FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) = 1 AND NOT deleted""",
    "workspace_search": _w(SEQUENCES, FEATURES) + f""", en(id, label) AS (VALUES {_ENZ}), u AS (SELECT 0 AS k, 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, 'doc ' || source AS label FROM documents
        UNION ALL SELECT 1, 'feature', doc_id || ':' || feature_id, type FROM f UNION ALL SELECT 2, 'enzyme', id, label FROM en)
        SELECT kind, id, label FROM u WHERE contains(lower(label), '{QUERY}') ORDER BY k, label, id LIMIT 40""",
    "document_list": _w(SEQUENCES) + """ SELECT doc_id, topology, CAST(length(seq) AS BIGINT) AS n, CASE WHEN length(seq) > 0 THEN floor((length(seq) * 2 - length(replace(seq, 'G', '')) - length(replace(seq, 'C', ''))) * 1000.0 / length(seq) + 0.5) / 10 ELSE 0 END AS gc_percent, substr(seq, 1, 10) || '...' || right(seq, 10) AS preview FROM all_seq""",
    "coordinate_check": _w(SEQUENCES, FEATURES) + " SELECT doc_id, feature_id, start0 + 1 AS start1, end0 AS end1, wraps, CASE WHEN topology = 'linear' AND end0 < start0 THEN 'INVERTED_RANGE' WHEN end0 > n THEN 'OUT_OF_BOUNDS' END AS error_code FROM f",
    "semi_customers_with_orders": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "anti_parts_never_sold": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)",
    "union_intersect_except": """WITH a AS (SELECT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0), u AS (SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b)
        UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a)), o AS (SELECT unnest(['union', 'intersect', 'except']) AS op)
        SELECT o.op, count(u.k) AS n, CAST(sum(u.k) AS BIGINT) AS total FROM o LEFT JOIN u USING (op) GROUP BY 1""",
    "rollup_flag_status": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_suppkey) AS BIGINT) AS total, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "rank_suppliers": "SELECT l_suppkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS rank FROM lineitem GROUP BY 1 QUALIFY rank <= 100",
    "topk_orders": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3",
}
