"""Best-fit packing with several bin sizes: the documents of a shard are packed jointly into bins of the permitted lengths."""

from __future__ import annotations

import bisect
import itertools
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ceil_div
from .quality import n_words

#: Permitted sequence lengths, in tokens. A sequence of size s costs s + BIN_COST + s * s / ATTENTION tokens' worth: what each
#: sequence costs whatever its length, and attention, whose cost grows with the square.
SIZES, BIN_COST, ATTENTION = (512, 1024, 2048, 4096), 16, 16_384
#: Pieces that are packed together in one task; the mean of a shard.
SHARD_ROWS = 20_000
#: Copies of one id and length, and pieces of one document, from which they are dealt out before they become rows.
CHUNK = 10_000


def cost_of(size: int, bin_cost: float = BIN_COST, attention: float = ATTENTION) -> float:
    return size + bin_cost + size * size / attention


def _fill(room: int, left: list[int], mask: int) -> int:
    """Tokens that go into room if the longest piece left that fits is put in, again and again. left: pieces by length; mask: a
    bit for each length of which some are left."""
    used = 0
    while room > 0 and (n := (mask & ((2 << room) - 1)).bit_length() - 1) > 0:
        k = min(left[n], room // n)
        used += k * n
        room -= k * n
        mask &= (1 << n) - 1
    return used


def _plan(order: list[int], lengths: list[int], opening: tuple[int, ...], sizes: tuple[int, ...], bin_cost: float, attention: float) -> tuple[float, list[tuple[int, int]], list[int]]:
    """Cost, (bin, offset) of each piece and final bin sizes, if bins open with sizes of `opening` only."""
    left = [0] * (max(lengths, default=0) + 1)
    for n, k in Counter(lengths).items():
        left[n] = k
    mask = sum(1 << n for n, k in enumerate(left) if k)
    room: list[tuple[int, int]] = []  # (room, bin), sorted: best fit is the first at or above a length
    used: list[int] = []
    at: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    final = lambda u: next(s for s in sizes if s >= u)
    for i in order:
        n = lengths[i]
        left[n] -= 1
        if not left[n]:
            mask ^= 1 << n
        k = bisect.bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            b, free, least = len(used), 0, 0.0
            for s in opening:
                if s >= n:
                    u = n + _fill(s - n, left, mask)
                    c = cost_of(final(u), bin_cost, attention) / u
                    if not free or c < least:
                        free, least = s, c
            used.append(0)
        at[i] = (b, used[b])
        used[b] += n
        if free > n:
            bisect.insort(room, (free - n, b))
    bins = [final(u) for u in used]
    return sum(cost_of(s, bin_cost, attention) for s in bins), at, bins


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES, bin_cost: float = BIN_COST, attention: float = ATTENTION) -> list[tuple[int, int, int]]:
    """(bin, offset, size of the bin) of each piece, none longer than the largest size; equal inputs give equal bins.

    Longest first. A piece goes to the open bin with the least room that holds it. If none does, a bin opens with the size that
    costs least a token, its contents being the piece and what of the pieces still to come would fill it. Every choice of sizes
    to open with that holds the longest piece is planned so, and the plan of the least cost is kept (of equal ones that with the
    fewest sizes, then the smallest). At the end each bin has shrunk to the smallest size that holds its contents.
    """
    sizes = tuple(sorted(sizes))
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    longest = max(lengths, default=0)
    best = None
    for r in range(1, len(sizes) + 1):
        for opening in itertools.combinations(sizes, r):
            if opening[-1] >= longest:
                plan = _plan(order, lengths, opening, sizes, bin_cost, attention)
                if best is None or plan[0] < best[0] - 1e-9:
                    best = plan
    _, at, bins = best
    return [(b, o, bins[b]) for b, o in at]


def best_fit_packing(docs: DataFrame, length: Column, id_col: str = "doc_id", sizes: tuple[int, ...] = SIZES, bin_cost: float = BIN_COST, attention: float = ATTENTION, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece of a document: doc_id, copy, piece, start, n_tokens, bin_id, bin_offset, bin_size, bin_used.

    length gives a document's tokens; null counts as none, and documents without tokens get no row. A document longer than the
    largest size is cut into pieces of that size and a remainder. Rows that repeat an id and length are packed each, as copy 0,
    1, ... A null id is packed like any other. Documents are dealt by a hash of id, length and copy to shards of about
    shard_rows pieces, so that one hot id or length spreads, and each shard is packed by itself: its size doesn't grow with the
    input, and the same rows give the same bins. Ties go to the smaller id. Only ids and lengths are shuffled, and lengths are
    counted once. Other columns of docs take no part, whatever their names.
    """
    largest = max(sizes)
    counted = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n")).filter("n > 0")
    # repeated rows meet as counts, then spread again as copies
    counted, _ = Scratch(docs.sparkSession).keep(counted.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("m")))
    pieces = F.ceil(F.col("n") / largest)
    total, most = counted.agg(F.sum(F.col("m") * pieces), F.max(F.greatest("m", pieces))).first()
    shards = max(1, ceil_div(int(total or 0), shard_rows))
    copies = _dealt(counted, "m", "copy", ["doc_id", "n"], most or 0)
    rows = _dealt(copies.withColumn("m", pieces), "m", "piece", ["doc_id", "n", "copy"], most or 0)
    rows = rows.select("doc_id", "copy", "piece", (F.col("piece").cast("long") * largest).alias("start"), F.least(F.lit(largest), F.col("n") - F.col("piece").cast("long") * largest).cast("int").alias("n_tokens"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", "copy", "piece"), F.lit(shards)).cast("int"))

    def run(shard: pa.Table) -> pa.Table:
        d = shard.to_pydict()
        order = sorted(range(shard.num_rows), key=lambda i: (d["doc_id"][i] is not None, d["doc_id"][i] or 0, d["copy"][i], d["piece"][i]))
        bins = pack([d["n_tokens"][i] for i in order], sizes, bin_cost, attention)
        used: dict[int, int] = {}
        for i, (b, _, _) in zip(order, bins, strict=True):
            used[b] = used.get(b, 0) + d["n_tokens"][i]
        out = shard.select(["doc_id", "copy", "piece", "start", "n_tokens"]).take(pa.array(order, pa.int64()))
        name = str(d["shard"][0])
        for c, v, kind in (("bin_id", [f"{name}-{b}" for b, _, _ in bins], pa.string()), ("bin_offset", [o for _, o, _ in bins], pa.int32()), ("bin_size", [z for _, _, z in bins], pa.int32()), ("bin_used", [used[b] for b, _, _ in bins], pa.int32())):
            out = out.append_column(c, pa.array(v, kind))
        return out

    kind = dict(counted.dtypes)["doc_id"]
    return rows.groupBy("shard").applyInArrow(run, f"doc_id {kind}, copy int, piece int, start long, n_tokens int, bin_id string, bin_offset int, bin_size int, bin_used int")


def _dealt(df: DataFrame, count: str, name: str, keys: list[str], most: int) -> DataFrame:
    """A row for each number below `count`, as `name`. Where a row has many, chunks of them are dealt out first, so that no task
    makes them all."""
    n = F.col(count).cast("int")
    if most <= CHUNK:
        return df.select(*keys, F.explode(F.sequence(F.lit(0), n - 1)).alias(name))
    chunks = df.select(*keys, n.alias("__n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(CHUNK))).alias("__from"))
    chunks = chunks.repartition(*keys, "__from")
    return chunks.select(*keys, F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + CHUNK, F.col("__n")) - 1)).alias(name))


def sequences(packed: DataFrame, tokens: DataFrame, ids_col: str = "ids") -> DataFrame:
    """(bin_id, bin_size, ids): the packed sequences themselves, each the tokens of its pieces in order of their offsets.

    packed is what best_fit_packing gives for the lengths of tokens (doc_id, ids), whose ids must not repeat. A document's array
    meets its pieces by its id; a bin gathers as many tokens as its size at most. Null ids match too.
    """
    t = tokens.select(F.col("doc_id").alias("__id"), F.col(f"`{ids_col}`").alias("ids"))
    parts = packed.join(t, F.col("doc_id").eqNullSafe(F.col("__id"))).select("bin_id", "bin_size", "bin_offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("n_tokens")).alias("part"))
    return parts.groupBy("bin_id", "bin_size").agg(F.sort_array(F.collect_list(F.struct("bin_offset", "part"))).alias("parts")).select("bin_id", "bin_size", F.flatten(F.transform("parts", lambda x: x["part"])).alias("ids"))


def doc_tokens(text_col: str = "text") -> Column:
    """A document's length for packing: its words and one end mark."""
    return n_words(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) + 1


def op6_best_fit_packing(spark, sf_dir):
    from .common import table

    return best_fit_packing(table(spark, sf_dir, "documents").select("doc_id", "text"), doc_tokens())
