"""Guide targets of Cas nucleases, their scores, and microhomology deletions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nt import count_of, rc, rotate, site_sets
from ..functions.tables import nuclease
from .scan import find


def targets(docs: DataFrame, name: str) -> DataFrame:
    """(doc_id, topology, n, strand, pam_start0, spacer, pam, cut0, bottom_cut0, gc_percent, score) of every target in docs.

    A spacer and its PAM are found as one pattern of fixed width on either strand. PAM letters must be in the PAM's sets. Linear
    molecules leave out the last start of a forward 5' PAM, and reverse ones that start before spacer + PAM.
    """
    c = nuclease(name)
    k, p = c["spacer"], len(c["pam"])
    spacer = ["ACGT"] * k
    first = c["side"] == "5prime"
    fwd, back = site_sets(c["pam"], True), site_sets(rc(c["pam"]), True)
    patterns = [{"strand": 1, "sets": fwd + spacer if first else spacer + fwd, "pam_at": 0 if first else k}, {"strand": -1, "sets": spacer + back if first else back + spacer, "pam_at": k if first else 0}]
    h = find(docs.filter("n >= 23").select("doc_id", "topology", "n", "seq"), patterns, {"strand": "bigint", "pam_at": "int"}, shorter=True).withColumn("i", F.col("start0") + F.col("pam_at"))
    linear = F.col("topology") == "linear"
    if first:
        h = h.filter(~linear | ((F.col("strand") == 1) & (F.col("i") < F.col("n") - p - k)) | ((F.col("strand") == -1) & (F.col("i") >= k + p)))
    i, n, s = F.pmod("i", "n"), F.col("n"), F.col("strand")
    guide = F.substr("hit", F.lit(p + 1 if first else 1), F.lit(k))
    pam = F.substr("hit", F.lit(1 if first else k + 1), F.lit(p))
    at = lambda off: F.pmod(F.when(s == 1, i + (p if first else 0) + off).otherwise(i + (0 if first else p) - off), n)
    out = h.select("doc_id", "topology", "n", "strand", i.alias("pam_start0"), guide.alias("spacer"), pam.alias("pam"), at(c["top"]).alias("cut0"), (at(c["bottom"]) if first else F.lit(None).cast("long")).alias("bottom_cut0"))
    gc = F.floor(count_of(F.col("spacer"), "GC") * 100.0 / k + 0.5)
    out = out.withColumn("gc_percent", gc.cast("long"))
    seed = F.substr("spacer", F.lit(1 if first else k - 4), F.lit(5))
    cost = F.greatest(c["gc_low"] - F.col("gc_percent"), F.col("gc_percent") - c["gc_high"], F.lit(0)) * 1.5
    for run, points in (("TTTT", 35), ("GGGG", 15), ("CCCC", 15)):
        cost = cost + F.when(F.contains("spacer", F.lit(run)), points).otherwise(0)
    cost = cost + F.when(~seed.rlike("[GC]"), 10).otherwise(0)
    return out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100 - cost + 0.5))).cast("long"))


def top_targets(found: DataFrame, most: int = 50, least_score: int = 0) -> DataFrame:
    """The best `most` targets of each document; equal scores by strand, forward first, then by position."""
    w = W.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("strand"), "pam_start0")
    return found.filter(F.col("score") >= least_score).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= most)


def _microhomologies(width: int, most: int):
    """A pass over batches (doc_id, rank, cut0, region, rel): pairs (len, l, r) of equal stretches of 2 to 6 bases on either side
    of rel, the best one of each distance r - l and of these the best `most`; by score, then len, l and r."""

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, 1_000):
                b = whole.slice(first, 1_000)
                texts = [(x or "").encode("ascii", "replace") for x in b.column(3).to_pylist()]
                n = np.array([len(x) for x in texts])[:, None]
                rel = b.column(4).to_numpy(zero_copy_only=False)[:, None]
                bases = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8).reshape(-1, width).astype(np.uint64)
                found = []
                for k in range(2, 7):
                    at = np.arange(width - k + 1)
                    code = sum(bases[:, i : i + len(at)] << np.uint64(8 * i) for i in range(k))
                    same = code[:, :, None] == code[:, None, :]
                    same &= (at + k <= rel)[:, :, None]
                    same &= ((at >= rel) & (at + k <= n))[:, None, :]
                    g, l, r = np.nonzero(same)
                    found.append((g, np.full(len(g), k), l, r))
                g, k, l, r = (np.concatenate(x) for x in zip(*found, strict=True))
                score = np.floor(np.array([2.2**x for x in range(7)])[k] / np.sqrt(r - l) * 10 + 0.5)
                order = np.lexsort((r, l, k, -score, r - l, g))
                size, owner = (r - l)[order], g[order]
                order = order[(np.diff(size, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0)]
                order = order[np.lexsort((r[order], l[order], k[order], -score[order], g[order]))]
                owner = g[order]
                begin = np.flatnonzero(np.diff(owner, prepend=-1))
                order = order[np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order)))) < most]
                rows = pa.array(g[order])
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in range(4)), *(pa.array(x[order].astype(np.int32)) for x in (k, l, r))], names=["doc_id", "rank", "cut0", "region", "len", "l", "r"])

    return run


def mmej_deletions(docs: DataFrame, cuts: DataFrame, radius: int = 30, most: int = 5) -> DataFrame:
    """(doc_id, rank, cut0, deletion_no, microhomology, length, size, frameshift, score, frameshift_probability) of guides (doc_id, rank, cut0).

    Microhomologies of 2 to 6 bases, one on either side of the cut within the radius; the best of each deletion size, the best
    `most` sizes. Every guide gives a bounded number of pairs.
    """
    j = cuts.select("doc_id", "rank", "cut0").join(docs.select("doc_id", "topology", "seq", "n"), "doc_id")
    circular, n = F.col("topology") == "circular", F.col("n")
    left = F.when(circular, F.pmod(F.col("cut0") - radius, n)).otherwise(F.greatest(F.lit(0), F.col("cut0") - radius)).cast("int")
    # a window over the origin takes its rest from the begin; only a molecule shorter than the window is read round more than once
    round_ = F.when(n >= 2 * radius, F.concat(F.substr("seq", left + 1, F.lit(2 * radius)), F.substr("seq", F.lit(1), F.greatest(F.lit(0), left + 2 * radius - n).cast("int"))))
    round_ = round_.otherwise(F.substr(F.repeat(rotate(F.col("seq"), left), F.ceil(F.lit(2.0 * radius) / n).cast("int")), F.lit(1), F.lit(2 * radius)))
    region = F.when(circular, round_).otherwise(F.substr("seq", left + 1, (F.least("n", F.col("cut0") + radius) - left).cast("int")))
    j = j.select("doc_id", "rank", "cut0", region.alias("region"), F.when(circular, F.lit(radius)).otherwise(F.col("cut0") - left).cast("int").alias("rel"))
    kinds = dict(j.dtypes)
    j = j.mapInArrow(_microhomologies(2 * radius, most), ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "rank", "cut0", "region")) + ", len int, l int, r int")
    j = j.withColumn("motif", F.substr("region", F.col("l") + 1, F.col("len")))
    size = (F.col("r") - F.col("l")).cast("long")
    j = j.withColumn("size", size).withColumn("score", F.floor(F.pow(F.lit(2.2), "len") / F.sqrt("size") * 10 + 0.5) / 10)
    guide = ["doc_id", "rank"]
    no = W.partitionBy(*guide).orderBy(F.desc("score"), "len", "l", "r")
    j = j.withColumn("deletion_no", F.row_number().over(no).cast("long")).filter(F.col("deletion_no") <= most).withColumn("frameshift", F.col("size") % 3 != 0)
    every = W.partitionBy(*guide)
    total = F.sum("score").over(every)
    p = F.floor(F.sum(F.when(F.col("frameshift"), F.col("score")).otherwise(0.0)).over(every) / total * 100 + 0.5) / 100
    return j.select(*guide, "cut0", "deletion_no", F.col("motif").alias("microhomology"), F.col("len").cast("long").alias("length"), "size", "frameshift", "score", p.alias("frameshift_probability"))
