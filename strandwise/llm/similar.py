"""Exact similarity of word shingles: sets, fingerprints of sets, and the check of candidate groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Texts, and shingles of texts, that one task compares (at most, but for a single text).
CELL, CELL_SHINGLES = 500, 4_000_000

def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles (A-Z lower-cased, words without ASCII white space); a shorter text is one."""
    words = (text or "").encode().lower().split()
    flat = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words or [b""]])
    starts, stops = np.concatenate([[0], ends[:-1]])[:n].tolist(), (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(flat[s:e], 42) for s, e in zip(starts, stops, strict=True)), np.uint64, n))


def set_prints(grams: np.ndarray, tables: int) -> np.ndarray:
    """`tables` fingerprints of 64 bits of a set of hashes, each bit one of the least member under an order of its own.

    Two sets of similarity s differ in (1 - s) / 2 of their bits on average: in 6.4 of 64 at 0.8, where fingerprints by majority
    differ in 9.6, so that fewer bits find the same pairs.
    """
    rng = np.random.default_rng(17)
    n = 64 * tables
    factors, shifts = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(grams), 1 << 10):
            np.minimum(low, (factors[:, None] * grams[None, k : k + (1 << 10)] + shifts[:, None]).min(1), out=low)
        # which member it is decides the bit, not its rank
        low = (low ^ (low >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        low = (low ^ (low >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.packbits((low >> np.uint64(63)).astype(np.uint8)).view(">u8").astype(np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection by union of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return common / (len(a) + len(b) - common)


def verified(members: DataFrame, texts: DataFrame, scratch: Scratch, width: int = 5, least: float = 0.8) -> DataFrame:
    """(a, b): links between near copies among the members (node, least, row, size, root) of each group `root`.

    Shingle sets are made of the members' texts (row, text) only. A group is dealt to parts of bounded size, in which each text
    is linked to the first, by id, that leads and that it is a near copy of; a text with none leads. The leaders of a group's
    parts then meet, block by block, so no group is too large for a task, and a group of copies costs its members times its leaders.
    """

    def gather(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x, width).tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["row", "grams"])

    def lead(t: pa.Table) -> pa.Table:
        ids, node = t.column("least").to_pylist(), t.column("node").to_pylist()
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("grams")]
        leaders: list[int] = []
        sizes = np.zeros(len(node), np.int64)
        to = list(range(len(node)))
        for i in sorted(to, key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, node[i])):
            n = len(grams[i])
            known = sizes[: len(leaders)]
            # sizes alone rule a pair out if the smaller is under `least` of the larger
            fit = np.flatnonzero((known >= least * n) & (n >= least * known)).tolist()
            j = next((leaders[k] for k in fit if similarity(grams[i], grams[leaders[k]]) >= least), None)
            if j is None:
                sizes[len(leaders)] = n
                leaders.append(i)
            else:
                to[i] = j
        return pa.table({"root": t.column("root"), "a": pa.array(node, pa.int64()), "b": pa.array([node[j] for j in to], pa.int64())})

    asked = members.select("row").distinct()
    grams, _ = scratch.keep(texts.join(asked, "row", "left_semi").mapInArrow(gather, "row long, grams binary"))
    cells = lambda df: df.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CELL), F.ceil(F.sum("size") / CELL_SHINGLES)).cast("int").alias("k"))
    block = lambda seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col("k"))
    out = "root long, a long, b long"
    columns = ["root", "node", "least", "grams"]
    dealt = members.join(cells(members), "root").join(grams, "row")
    first, _ = scratch.keep(dealt.select(*columns, block(1).alias("part")).groupBy("root", "part").applyInArrow(lead, out))
    # a group that one task has seen whole is settled
    several = cells(members).filter("k > 1").select("root")
    leaders = first.filter("a = b").select("root", F.col("a").alias("node")).join(several, "root", "left_semi")
    leaders, _ = scratch.keep(members.join(leaders, ["root", "node"]))
    pairs = leaders.join(cells(leaders), "root").join(grams, "row").select(*columns, block(2).alias("own"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    more = pairs.groupBy("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).applyInArrow(lead, out)
    links, _ = scratch.keep(first.unionByName(more).filter("a <> b").select("a", "b"))
    return links
