"""Exact top-k inner products by pivot tables: bounds from distances to many pivots decide what is sent and evaluated at all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, below, ceil_div

#: Pivots; vectors that pivots and centers are chosen from (about); rows of a block of candidates and of queries; candidates a
#: center should have, and centers (at most).
PIVOTS, SAMPLE, BLOCK, QUERY_BLOCK, PER_CENTER, CENTERS = 48, 2048, 20_000, 20_000, 4_000, 256
#: Products of vectors with norms below this are exact in doubles, and so is every partial sum.
EXACT = 2.0**52


def whole_steps(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, a whole number held as a double; vectors null or holding null or
    non-finite components, or such as become so, are left out."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double") * scale)
    # NaN sorts above every number, so one comparison leaves out NaN and both infinities
    good = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & good)
    # floor() gives a long, which is exact below 2^53; from there on a double has no fraction
    return rows.select("vec_id", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)).alias("v"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample that lie far from each other: each the farthest from those chosen before."""
    far = np.full(len(sample), np.inf)
    chosen = []
    at = 0
    for _ in range(min(count, len(sample))):
        chosen.append(at)
        far = np.minimum(far, ((sample - sample[at]) ** 2).sum(1))
        at = int(far.argmax())
        if far[at] == 0:
            break
    return sample[chosen]


def distances(a: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2 * a @ points.T, 0))


def _slack(q2, x2):
    """What rounding may take from a distance between vectors of these squared norms."""
    return 1e-6 * (1 + np.sqrt(q2) + np.sqrt(x2))


def _bound(q2, x2, low):
    """Above q.x where |q - x| >= low: 2 q.x = |q|^2 + |x|^2 - |q - x|^2, with room for rounding."""
    return (q2 + x2 - np.maximum(low - _slack(q2, x2), 0) ** 2) / 2 + 0.5 + 1e-12 * (q2 + x2)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, pivots: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[list, list, list, int]:
    """(query, id, score) of the k best rows of each query, a query's own id left out, and the number of products computed.

    For a pivot p, |q - x| >= |d(q, p) - d(x, p)|; the largest of these over the pivots bounds the distance from below, and so the
    product from above. Rows whose bound is below the query's k-th score so far, or below its floor, go pivot by pivot; the rest
    come in order of their bounds, and a query stops at the first bound below its k-th score (an equal one could still bring a
    tie with a smaller id). Where products leave the range in which doubles are exact, all are computed as whole numbers of any length.
    """
    if not len(rows) or not len(queries):
        return [], [], [], 0
    with np.errstate(over="ignore"):
        q2, x2 = (queries**2).sum(1), (rows**2).sum(1)
    if not np.sqrt(q2.max()) * np.sqrt(x2.max()) < EXACT or not max(q2.max(), x2.max()) < EXACT:
        return _best_whole(queries, query_ids, rows, ids, k)
    table, dq = distances(rows, pivots), distances(queries, pivots)
    out_q, out_x, out_s, work = [], [], [], 0

    def take(i, part, got_s, got_x):
        part = part[ids[part] != query_ids[i]]
        got_s, got_x = np.concatenate([got_s, rows[part] @ queries[i]]), np.concatenate([got_x, ids[part]])
        top = np.lexsort((got_x, -got_s))[:k]
        return got_s[top], got_x[top], len(part)

    for i in range(len(queries)):
        floor = -np.inf if floors is None else floors[i]
        alive, low = np.arange(len(rows)), np.zeros(len(rows))
        for p in range(0, table.shape[1], 8):
            low = np.maximum(low, np.abs(table[alive, p : p + 8] - dq[i, p : p + 8]).max(1, initial=0))
            bound = _bound(q2[i], x2[alive], low)
            if not p and len(alive) > 8 * k:
                # a first look at the best bounds gives a floor
                first = alive[np.argpartition(-bound, 4 * k)[: 4 * k]]
                got_s, _, n = take(i, first, np.zeros(0), np.zeros(0, ids.dtype))
                work += n
                floor = max(floor, got_s[k - 1]) if len(got_s) >= k else floor
            stay = bound >= floor
            before = len(alive)
            alive, low, bound = alive[stay], low[stay], bound[stay]
            if p and len(alive) > 0.9 * before:
                break
        order = np.argsort(-bound, kind="stable") if len(alive) else alive
        got_s, got_x = np.zeros(0), np.zeros(0, ids.dtype)
        at, step = 0, 64
        while at < len(order):
            if len(got_s) >= k and bound[order[at]] < got_s[k - 1]:
                break
            got_s, got_x, n = take(i, alive[order[at : at + step]], got_s, got_x)
            work += n
            at += step
            step *= 2
        out_q += [query_ids[i]] * len(got_s)
        out_x += got_x.tolist()
        out_s += [int(x) for x in got_s.tolist()]
    return out_q, out_x, out_s, work


def _best_whole(queries, query_ids, rows, ids, k):
    whole = lambda a: [[int(x) for x in r] for r in a.tolist()]
    out_q, out_x, out_s, work = [], [], [], 0
    candidates = whole(rows)
    for q, i in zip(whole(queries), query_ids.tolist(), strict=True):
        scored = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for x, j in zip(candidates, ids.tolist(), strict=True) if j != i)
        work += len(scored)
        for s, j in scored[:k]:
            out_q.append(i)
            out_x.append(j)
            out_s.append(-s)
    return out_q, out_x, out_s, work


def sort_key(n: int) -> str:
    """A text that sorts as the number does, however long it is."""
    digits = f"{abs(n)}"
    text = f"{len(digits):04d}{digits}"
    return "1" + text if n >= 0 else "0" + text.translate(str.maketrans("0123456789", "9876543210"))


def _grid(column) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(values), -1)


class _Ball:
    """What is known of the candidates of each center of one dimension: their number, largest squared norm, largest distance from
    the center, and the range of distances from each pivot."""

    def __init__(self, centers: np.ndarray, pivots: np.ndarray):
        n, p = len(centers), len(pivots)
        self.centers, self.pivots = centers, pivots
        self.n, self.x2, self.radius = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        self.near, self.far = np.full((n, p), np.inf), np.full((n, p), -np.inf)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Above the product of each query (rows) with any candidate of each center (columns)."""
        q2 = (q**2).sum(1)
        dq = distances(q, self.pivots)
        low = np.zeros((len(q), len(self.centers)))
        for p in range(len(self.pivots)):
            np.maximum(low, np.maximum(self.near[None, :, p] - dq[:, p, None], dq[:, p, None] - self.far[None, :, p]), out=low)
        by_pivots = _bound(q2[:, None], self.x2[None, :], low)
        # q.x = q.c + q.(x - c)
        by_center = q @ self.centers.T + np.sqrt(q2)[:, None] * (self.radius + _slack(self.x2, 0.0))[None, :] * (1 + 1e-9) + 0.5
        out = np.minimum(by_pivots, by_center)
        # beyond the exact range nothing is ruled out
        safe = (np.sqrt(q2)[:, None] * np.sqrt(self.x2)[None, :] < EXACT) & (q2[:, None] < EXACT) & (self.x2[None, :] < EXACT)
        return np.where(self.n[None, :] == 0, -np.inf, np.where(safe, out, np.inf))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK, per_center: int = PER_CENTER) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest integer inner products with each query row, itself left out.

    Ties go to the smaller id. is_query is a condition on vec_id. Rows with a null vector, or with null or non-finite
    components, empty ones, or those with a null id take no part; vectors of different lengths are compared with those of their own length only.
    Rows that repeat an id are candidates each; of query rows that repeat an id the least vector asks. Queries with no candidate
    give no rows. Products are exact whatever their size; a score that doesn't fit a long is null, in its right rank.

    Candidates are dealt to centers, the nearest one's each, and within a center to blocks of bounded size. A query first asks
    one block of the center with the largest product, whose k-th score is its floor; then all other blocks of those centers only
    whose bound reaches the floor. Pivots and centers are fitted on a bounded sample; they decide speed, not results.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = whole_steps(vectors, id_col, vec_col).filter("vec_id is not null and size(v) > 0").withColumn("dim", F.size("v"))
    total = rows.count()
    sample: dict[int, list] = {}
    for x in rows.filter(below(F.xxhash64("vec_id", "v"), SAMPLE / max(1, total))).select("dim", "v").collect():
        sample.setdefault(x.dim, []).append(x.v)
    balls = {}
    for d, values in sample.items():
        got = np.array(values, np.float64).reshape(-1, d)
        balls[d] = _Ball(got[: max(1, min(CENTERS, ceil_div(total, per_center)))], choose_pivots(got, pivots))

    def place(batches):
        """Rows with their center and a number to deal them out by; a dimension that the sample misses has one center."""
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                c = np.zeros(len(own), np.int32)
                part = b.take(pa.array(own))
                if d in balls:
                    with np.errstate(over="ignore", invalid="ignore"):
                        c = np.nan_to_num(distances(_grid(part.column(2)), balls[d].centers), nan=0.0).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(c), pa.array(np.arange(at, at + len(own)))], names=["vec_id", "dim", "v", "c", "at"])
                at += len(own)

    kind = dict(rows.dtypes)["vec_id"]
    placed, _ = scratch.keep(rows.select("vec_id", "dim", "v").mapInArrow(place, f"vec_id {kind}, dim int, v array<double>, c int, at long"))

    def ranges(batches):
        found: dict[int, _Ball] = {}
        for b in batches:
            dims, c = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                if d not in balls:
                    continue
                mine = found.setdefault(d, _Ball(balls[d].centers, balls[d].pivots))
                x, at = _grid(b.column(0).take(pa.array(own))), c[own]
                with np.errstate(over="ignore", invalid="ignore"):
                    far, radius, x2 = distances(x, mine.pivots), np.sqrt(((x - mine.centers[at]) ** 2).sum(1)), (x**2).sum(1)
                np.add.at(mine.n, at, 1)
                np.maximum.at(mine.x2, at, x2)
                np.maximum.at(mine.radius, at, radius)
                np.minimum.at(mine.near, at, far)
                np.maximum.at(mine.far, at, far)
        for d, m in found.items():
            for c in np.flatnonzero(m.n).tolist():
                p = len(m.pivots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * p, pa.int32()), pa.array([c] * p, pa.int32()), pa.array(range(p), pa.int32()), pa.array([int(m.n[c])] * p), pa.array([float(m.x2[c])] * p), pa.array([float(m.radius[c])] * p), pa.array(m.near[c]), pa.array(m.far[c])],
                    names=["dim", "c", "p", "n", "x2", "radius", "near", "far"],
                )

    known = placed.select("v", "dim", "c").mapInArrow(ranges, "dim int, c int, p int, n long, x2 double, radius double, near double, far double")
    # centers times pivots rows, whatever the input
    for x in known.groupBy("dim", "c", "p").agg(F.sum("n").alias("n"), F.max("x2").alias("x2"), F.max("radius").alias("radius"), F.min("near").alias("near"), F.max("far").alias("far")).collect():
        m = balls[x.dim]
        m.n[x.c], m.x2[x.c], m.radius[x.c], m.near[x.c, x.p], m.far[x.c, x.p] = x.n, x.x2, x.radius, x.near, x.far
    blocks_of = _nested(placed.groupBy("dim", "c").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).collect())
    sent, facts = spark.sparkContext.broadcast(blocks_of), spark.sparkContext.broadcast(balls)
    several = [(d * CENTERS + c, n) for d, m in blocks_of.items() for c, n in m.items() if n > 1]
    n_blocks = F.create_map(*[F.lit(x) for kv in several for x in kv])[F.col("dim") * CENTERS + F.col("c")] if several else F.lit(1)
    blocked = placed.withColumn("s", F.pmod(F.col("at"), F.coalesce(n_blocks, F.lit(1)).cast("long")).cast("int"))

    # the query among rows of one id, and the block that holds it, are those of the least vector
    asks = placed.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "at")).alias("m")).select("vec_id", "m.v", "m.dim", "m.at")

    def first(batches):
        for b in batches:
            dims, at = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                part = b.take(pa.array(own))
                blocks, ball = sent.value[d], facts.value.get(d)
                c = np.zeros(len(own), np.int64)
                if ball is not None:
                    with np.errstate(over="ignore", invalid="ignore"):
                        c = np.where(ball.n[None, :] > 0, np.nan_to_num(_grid(part.column(1)) @ ball.centers.T, nan=0.0), -np.inf).argmax(1)
                s = at[own] % np.array([blocks[x] for x in c.tolist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(c.astype(np.int32)), pa.array(s.astype(np.int32)), pa.nulls(len(own), pa.float64())], names=["vec_id", "v", "dim", "c", "s", "floor"])

    routed = f"vec_id {kind}, v array<double>, dim int, c int, s int, floor double"
    asked, _ = scratch.keep(asks.select("vec_id", "v", "dim", "at").mapInArrow(first, routed))
    out = f"query_id {kind}, vec_id {kind}, key string, score long, rough double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q = x = s = []
        if left.num_rows and right.num_rows:
            ball = facts.value.get(left.column("dim")[0].as_py())
            a, b = _grid(left.column("v")), _grid(right.column("v"))
            floors = np.array([-np.inf if f is None else f for f in left.column("floor").to_pylist()])
            q, x, s, _ = best(a, left.column("vec_id").to_numpy(), b, right.column("vec_id").to_numpy(), ball.pivots if ball is not None else b[:1], k, floors)
        fits = [n if -(2**63) <= n < 2**63 else None for n in s]
        rough = [float(n) if abs(n) < EXACT else None for n in s]
        kind = right.column("vec_id").type
        return pa.table({"query_id": pa.array(q, kind), "vec_id": pa.array(x, kind), "key": pa.array([sort_key(n) for n in s], pa.string()), "score": pa.array(fits, pa.int64()), "rough": pa.array(rough, pa.float64())})

    def search(queries: DataFrame) -> DataFrame:
        """The k best of every (query, block) that queries names, blocks of queries by blocks of candidates."""
        loads = queries.groupBy("dim", "c", "s").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("nq"))
        keys = ["dim", "c", "s", "qb"]
        left = queries.join(loads, keys[:3]).withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.col("nq")).cast("int"))
        right = blocked.join(loads, keys[:3]).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
        return left.select(*keys, "vec_id", "v", "floor").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "v").groupBy(*keys)).applyInArrow(run, out)

    near, _ = scratch.keep(search(asked))
    place_of = W.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    floors = near.withColumn("r", F.row_number().over(place_of)).filter(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("rough").alias("floor"))

    def rest(batches):
        for b in batches:
            dims = b.column(2).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                part = b.take(pa.array(own))
                blocks, ball = sent.value[d], facts.value.get(d)
                floor = np.array([-np.inf if f is None else f for f in part.column(5).to_pylist()])
                c0, s0 = part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_numpy(zero_copy_only=False)
                for lo in range(0, len(own), 512):
                    hi = min(len(own), lo + 512)
                    with np.errstate(over="ignore", invalid="ignore"):
                        may = ball.bounds(_grid(part.column(1).slice(lo, hi - lo))) >= floor[lo:hi, None] if ball is not None else np.ones((hi - lo, 1), bool)
                    i, c = np.nonzero(may)
                    times = np.array([blocks.get(x, 0) for x in c.tolist()], np.int64)
                    i, c, s = np.repeat(i, times) + lo, np.repeat(c, times), np.concatenate([np.arange(t) for t in times.tolist()] or [np.zeros(0, np.int64)])
                    new = (c != c0[i]) | (s != s0[i])
                    i, c, s = i[new], c[new], s[new]
                    at = pa.array(i)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), pa.array(c.astype(np.int32)), pa.array(s.astype(np.int32)), part.column(5).take(at)], names=["vec_id", "v", "dim", "c", "s", "floor"])

    again = asked.drop("floor").join(floors, "vec_id", "left").select("vec_id", "v", "dim", "c", "s", "floor").mapInArrow(rest, routed)
    again, _ = scratch.keep(again)
    ranked = near.unionByName(search(again)).withColumn("rank", F.row_number().over(place_of))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nested(rows) -> dict[int, dict[int, int]]:
    out: dict[int, dict[int, int]] = {}
    for x in rows:
        out.setdefault(x.dim, {})[x.c] = x.blocks
    return out


def op9_topk_search(spark, sf_dir):
    from .common import table

    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
