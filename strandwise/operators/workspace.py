"""Staged edits, histories, activity and search over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def commit(transactions: DataFrame, current: DataFrame) -> DataFrame:
    """Transactions (tx_id, doc_id, base_version, base_hash, decision) with their status against documents (doc_id, version, hash).

    Rejected ones stay so; an approved one applies where its base is the current version and hash, else it is stale, and of
    several for one document only the first applies; others are pending. A document that is gone makes them stale.
    """
    j = transactions.join(current, "doc_id", "left")
    fits = F.coalesce((F.col("base_version") == F.col("version")) & (F.col("base_hash") == F.col("hash")), F.lit(False))
    j = j.withColumn("fits", fits & (F.col("decision") == "approved"))
    first = F.sum(F.when(F.col("fits"), 1).otherwise(0)).over(W.partitionBy("doc_id").orderBy("tx_id"))
    status = F.when(F.col("decision") == "rejected", "rejected").when(F.col("decision") == "pending", "pending").when(F.col("fits") & (first == 1), "applied").otherwise("stale")
    return j.select("tx_id", "doc_id", status.alias("status"), F.when(status == "applied", F.col("version") + 1).otherwise(F.col("version")).alias("version"))


def undo_depth(log: DataFrame, key: str, order: list[str], step: Column, most: int = 50) -> DataFrame:
    """log with depth: edits (+1) stack up, undos (-1) take off, never below none; reported up to `most`."""
    w = W.partitionBy(key).orderBy(*order)
    run = log.withColumn("__s", F.sum(step).over(w)).withColumn("__low", F.least(F.lit(0), F.min("__s").over(w)))
    return run.withColumn("depth", F.least(F.lit(most), F.col("__s") - F.col("__low")).cast("long")).drop("__s", "__low")


def sessions(log: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, session_no, n_events, first_ts, last_ts): events less than the gap apart."""
    w = W.partitionBy(key).orderBy(ts)
    s = log.withColumn("__new", F.when(F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts)) <= gap_seconds * 1_000_000, 0).otherwise(1)).withColumn("session_no", F.sum("__new").over(w))
    return s.groupBy(key, "session_no").agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def until_error(steps: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """The steps of each batch up to and with its first that failed."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return steps.withColumn("__f", F.coalesce(F.max(failed.cast("int")).over(w), F.lit(0))).filter("__f = 0").drop("__f")


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """base with the latest change of each key; a change with deleted = true takes the row out."""
    both = base.withColumn("__at", F.lit(None).cast(dict(changes.dtypes)[order])).withColumn("deleted", F.lit(False)).unionByName(changes.withColumnRenamed(order, "__at"))
    latest = W.partitionBy(key).orderBy(F.col("__at").desc_nulls_last())
    return both.withColumn("__r", F.row_number().over(latest)).filter("__r = 1 and not deleted").drop("__r", "__at", "deleted")


def search(kinds: dict[str, DataFrame], query: str, most: int = 40) -> DataFrame:
    """(kind, id, label) of up to `most` rows of tables (id, label) whose label holds the query, in the order of kinds, label and id."""
    q = query.strip().lower()
    found = None
    for k, (kind, df) in enumerate(kinds.items()):
        part = df.filter(F.contains(F.lower("label"), F.lit(q))).select(F.lit(k).alias("__k"), F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "label")
        found = part if found is None else found.unionByName(part)
    return found.orderBy("__k", "label", "id").limit(most).drop("__k")


def parse_coordinates(text: Column, n: Column | None = None) -> dict[str, Column]:
    """start1 and end1 of ":12", "12", "12-30" or "12..30"; null for other texts, for place 0, for ends before their start, and for
    places behind the last of n, if it is given."""
    blank = F.lit(" \t\r\n\f\v")
    t = F.trim(text, blank)
    t = F.when(F.startswith(t, F.lit(":")), F.substr(t, F.lit(2))).otherwise(t)
    dots, dash = F.instr(t, ".."), F.instr(t, "-")
    at, wide = F.when(dots > 0, dots).otherwise(dash), F.when(dots > 0, 2).otherwise(1)
    one = at == 0
    number = lambda x: F.when((F.length(x) > 0) & (F.translate(x, "0123456789", "") == ""), x.try_cast("long"))
    a = number(F.when(one, t).otherwise(F.rtrim(F.substr(t, F.lit(1), at - 1), blank)))
    b = F.when(one, a).otherwise(number(F.ltrim(F.substr(t, at + wide), blank)))
    ok = (a >= 1) & (b >= a)
    if n is not None:
        ok = ok & (b <= n)
    return {"start1": F.when(ok, a), "end1": F.when(ok, b)}


def projects(list_of: DataFrame, most: int = 250) -> DataFrame:
    """Each user's latest `most` projects (user_id, project_id, updated), with their place in the list."""
    w = W.partitionBy("user_id").orderBy(F.desc("updated"), "project_id")
    return list_of.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= most)


def restore(history: DataFrame, requests: DataFrame) -> DataFrame:
    """(doc_id, version, hash): a new version with an old one's content, for requests (doc_id, to_version); unknown ones give none."""
    last = history.groupBy("doc_id").agg(F.max("version").alias("last"))
    j = requests.join(history.withColumnRenamed("version", "to_version"), ["doc_id", "to_version"]).join(last, "doc_id")
    return j.select("doc_id", (F.col("last") + 1).alias("version"), "hash")


def upsert_projects(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """(user_id, project_id, created, updated) after changes (user_id, project_id, at, deleted).

    The latest change of a project counts, one that deletes it first if several have one time. A project that is there keeps its time
    of creation; a new one is created at its latest change. Users change only projects of their own, as the key holds the user.
    """
    key = ["user_id", "project_id"]
    last = changes.groupBy(*key).agg(F.max(F.struct("at", "deleted")).alias("c"))
    j = stored.select(*key, "created", "updated").join(last, key, "full").filter("not coalesce(c.deleted, false)")
    return j.select(*key, F.coalesce("created", "c.at").alias("created"), F.coalesce("c.at", "updated").alias("updated"))
