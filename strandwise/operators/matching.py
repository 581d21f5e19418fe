"""Features of two versions of a molecule, matched one to one and compared."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A feature of the same id counts more than any distance; one of the same name and type counts less by a point a base.
SAME_ID, SAME_NAME = 1_000_000, 100_000


def _first(segments: str) -> Column:
    return F.coalesce(F.get(segments, F.lit(0))["start0"], F.lit(0).cast("long"))


def _best_free(reference: list[dict], query: list[dict]) -> tuple[list[int | None], list[int | None]]:
    """For each feature of reference, in order, the place in query of the best that is still free, and its score.

    Queries of one name and type stand by start and id. The nearest free one is the last before a start or the first behind it; taken ones
    are stepped over by links that are shortened as they are followed, so the cost is that of the sorting.
    """
    by_id = {x["feature_id"]: i for i, x in enumerate(query) if x["feature_id"] is not None}
    lists: dict[tuple, list[tuple]] = {}
    for i, x in enumerate(query):
        if None not in (x["feature_id"], x["key"], x["type"]):
            lists.setdefault((x["key"], x["type"]), []).append((x["start"], x["feature_id"], i))
    where = {}
    for name, rows in lists.items():
        rows.sort(key=lambda r: r[:2])
        for at, (_, _, i) in enumerate(rows):
            where[i] = (name, at)
    # links of place at: to the next free one from there on, and to the last free one before and with it (both moved by one)
    up, down = ({name: list(range(len(rows) + 1)) for name, rows in lists.items()} for _ in range(2))

    def free(links: list[int], at: int) -> int:
        end = at
        while links[end] != end:
            end = links[end]
        while links[at] != end:
            links[at], at = end, links[at]
        return end

    taken, out, scores = [False] * len(query), [], []
    for r in reference:
        i, score = by_id.get(r["feature_id"]), SAME_ID
        if i is None or taken[i]:
            i, name = None, (r["key"], r["type"])
            rows = lists.get(name)
            if rows and r["feature_id"] is not None:
                split = bisect_left(rows, r["start"], key=lambda x: x[0])
                left, right = free(down[name], split), free(up[name], split)
                found = []
                if left:
                    # of equal starts the least id that is free
                    start = rows[left - 1][0]
                    found.append((r["start"] - start, start, free(up[name], bisect_left(rows, start, key=lambda x: x[0]))))
                if right < len(rows):
                    found.append((rows[right][0] - r["start"], rows[right][0], right))
                if found and min(found)[0] <= SAME_NAME:
                    i, score = rows[min(found)[2]][2], SAME_NAME - min(found)[0]
        out.append(i)
        scores.append(None if i is None else score)
        if i is not None:
            taken[i] = True
            if i in where:
                name, at = where[i]
                up[name][at], down[name][at + 1] = at + 1, at
    return out, scores


def _matched(a: Column, b: Column) -> Column:
    """For each feature of the array a, in order, the place in the array b of its best free one, and the score."""

    @F.arrow_udf("struct<at:array<int>,score:array<bigint>>")
    def match(references, queries):
        got = [_best_free(references[i].as_py() or [], queries[i].as_py() or []) for i in range(len(references))]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.int64()))], names=["at", "score"])

    keys = lambda x: F.transform(x, lambda f: F.struct(f["feature_id"].alias("feature_id"), F.lower(f["name"]).alias("key"), f["type"].alias("type"), f["start"].alias("start")))
    return match(keys(a), keys(b))


def _by_document(reference: DataFrame, query: DataFrame) -> DataFrame:
    """(doc_id, a, b, m): the features of both in arrays, those of reference by start, name and id, and what _matched gives."""
    size = F.aggregate("segments", F.lit(0).cast("long"), lambda t, s: t + s["end0"] - s["start0"])
    whole = F.struct(_first("segments").alias("start"), "name", "feature_id", "type", *(["segments", "strand", size.alias("size")] if "strand" in reference.columns else []))
    side = lambda df, k: df.groupBy("doc_id").agg(F.sort_array(F.collect_list(whole)).alias(k))
    j = side(reference, "a").join(side(query, "b"), "doc_id", "full")
    return j.withColumn("a", F.coalesce("a", F.array().cast(dict(j.dtypes)["a"]))).withColumn("b", F.coalesce("b", F.array().cast(dict(j.dtypes)["b"]))).withColumn("m", _matched(F.col("a"), F.col("b")))


def match_features(reference: DataFrame, query: DataFrame) -> DataFrame:
    """(doc_id, reference_id, query_id, score): every feature of reference, by start, name and id, has the best feature of query that is
    still free: the same id, else the same name (in any case) and type, the nearest first, then the first, then the least id.

    reference and query: doc_id, feature_id (once a document), name, type, segments. The features of a document are one row, and
    are gone through one by one; no pairs of features are formed, so a document costs what the sorting of its features costs.
    """
    j = _by_document(reference.drop("strand"), query)
    x = j.select("doc_id", "b", F.explode(F.arrays_zip("a", F.col("m.at").alias("at"), F.col("m.score").alias("score"))).alias("x")).filter("x.at is not null")
    return x.select("doc_id", F.col("x.a.feature_id").alias("reference_id"), F.get("b", F.col("x.at"))["feature_id"].alias("query_id"), F.col("x.score").alias("score"))


def signed_shift(before: Column, after: Column, n: Column, topology: Column) -> Column:
    """after - before, the short way round on a circular molecule."""
    d = after - before
    return F.when((topology != "circular") | (n <= 0), d).when(d * 2 > n, d - n).when(d * 2 < -n, d + n).otherwise(d)


def compare(reference: DataFrame, query: DataFrame, molecules: DataFrame) -> DataFrame:
    """(doc_id, reference_id, query_id, kind, changes, shift, length_delta) of all features of both, matched by match_features.

    kind is modified, unchanged, removed or added; changes names what differs of name, type, coordinates and strand. shift is the way
    from start to start, on molecules (doc_id, n, topology) that are circular the short way round.
    """
    d = _by_document(reference, query)
    partner = F.transform("m.at", lambda at: F.when(at.isNotNull(), F.get("b", at)))
    free = F.array_except(F.when(F.size("b") > 0, F.sequence(F.lit(0), F.size("b") - 1)).otherwise(F.array().cast("array<int>")), "m.at")
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    none = lambda c: F.lit(None).cast(dict(d.dtypes)[c].removeprefix("array<")[:-1])
    both = F.zip_with("a", partner, pair)
    added = F.transform(free, lambda at: pair(none("a"), F.get("b", at)))
    j = d.select("doc_id", F.explode(F.concat(both, added)).alias("x")).select("doc_id", "x.a", "x.b").join(molecules.select("doc_id", "n", "topology"), "doc_id", "left")
    j = j.withColumn("reference_id", F.col("a.feature_id")).withColumn("query_id", F.col("b.feature_id"))
    fields = {"name": "name", "type": "type", "coordinates": "segments", "strand": "strand"}
    changes = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), k) for k, c in fields.items()]))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    kind = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.size(changes) > 0, "modified").otherwise("unchanged")
    delta = F.coalesce(F.col("b.size"), F.lit(0)) - F.coalesce(F.col("a.size"), F.lit(0))
    return j.select("doc_id", "reference_id", "query_id", kind.alias("kind"), F.when(both, F.array_join(changes, ",")).otherwise("").alias("changes"), signed_shift(F.col("a.start"), F.col("b.start"), F.col("n"), F.col("topology")).alias("shift"), delta.alias("length_delta"))
