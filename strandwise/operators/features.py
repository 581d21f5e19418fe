"""Features: detection by motif, screening, filters, dedupe, overlaps, tiles, clusters, lanes and annotation diffs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import find_motifs


def known_features(docs: DataFrame, library: DataFrame, seed: int = 16) -> DataFrame:
    """(doc_id, item_id, strand, start0, end0, wraps): exact occurrences of the library's motifs, of any widths, on both strands."""
    hits = find_motifs(docs, library, seed)
    end = F.col("start0") + F.col("width")
    return hits.select("doc_id", "item_id", "strand", "start0", F.when(end <= F.col("n"), end).otherwise(end % F.col("n")).alias("end0"), (end > F.col("n")).alias("wraps"))


def screen(docs: DataFrame, signatures: DataFrame, seed: int = 16, least: int = 18) -> DataFrame:
    """(doc_id, n_hits, n_agents, tier, compliant) of every document by a panel (item_id, category, motif) given as input.

    Signatures may have any widths. Category 0 ranks before 1 before 2. Sequences shorter than `least` are compliant without a search.
    """
    hits = find_motifs(docs.filter(F.col("n") >= least), signatures, seed)
    best = hits.join(signatures.select("item_id", "category"), "item_id")
    best = best.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("item_id").alias("n_agents"), F.min("category").alias("best"))
    out = docs.select("doc_id").join(best, "doc_id", "left")
    tier = F.when(F.col("best") == 0, "tier1").when(F.col("best") == 1, "toxin").when(F.col("best") == 2, "other").otherwise("none")
    return out.select("doc_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("n_agents", F.lit(0)).alias("n_agents"), tier.alias("tier"), F.col("n_hits").isNull().alias("compliant"))


def overlaps(a, b, c, d):
    """Half-open intervals [a, b) and [c, d) share a base; an empty one touches what it lies in or at the edge of."""
    return F.when(c == d, (a <= c) & (c <= b)).otherwise((a < d) & (c < b))


def affected(feats: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, edit_id, feature_id) of features with a segment that an edit (doc_id, edit_id, edit_start, edit_end) touches."""
    j = feats.select("doc_id", "feature_id", "segments").join(edits, "doc_id")
    return j.filter(F.exists("segments", lambda s: overlaps(s["start0"], s["end0"], F.col("edit_start"), F.col("edit_end")))).select("doc_id", "edit_id", "feature_id")


def dedupe(feats: DataFrame, priority: list[str]) -> DataFrame:
    """One feature for each document, strand and segments: the type first in `priority`, then the smaller id."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("type")), F.lit(0))
    rank = F.when(rank == 0, len(priority) + 1).otherwise(rank)
    w = W.partitionBy("doc_id", "strand", "segments").orderBy(rank, "feature_id")
    return feats.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def overlap_pairs(feats: DataFrame, bin_size: int = 256) -> DataFrame:
    """(doc_id, left_id, right_id, overlap): pairs of features of different types that share bases, and how many.

    A range join by bins: segments meet in the bins they cover, and a pair counts in the first bin that both cover.
    """
    seg = feats.select("doc_id", "feature_id", "type", F.explode("segments").alias("s")).select("doc_id", "feature_id", "type", "s.start0", "s.end0").filter("end0 > start0")
    seg = seg.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start0") / bin_size), F.floor((F.col("end0") - 1) / bin_size))))
    r = seg.select("doc_id", "bin", *[F.col(c).alias(f"r_{c}") for c in ("feature_id", "type", "start0", "end0")])
    lo, hi = F.greatest("start0", "r_start0"), F.least("end0", "r_end0")
    j = seg.join(r, ["doc_id", "bin"]).filter((F.col("feature_id") < F.col("r_feature_id")) & (F.col("type") != F.col("r_type")) & (lo < hi) & (F.floor(lo / bin_size) == F.col("bin")))
    return j.groupBy("doc_id", F.col("feature_id").alias("left_id"), F.col("r_feature_id").alias("right_id")).agg(F.sum(hi - lo).alias("overlap"))


def on_fragments(feats: DataFrame, frags: DataFrame, bin_size: int = 1024) -> DataFrame:
    """(doc_id, fragment_no, feature_id, strand, first0, last0, n_bases, clipped): features on the fragments (doc_id, fragment_no, start0,
    length) of a digest, in the fragment's own coordinates.

    A range join by bins, in which a pair of pieces counts in the first bin that both cover. A feature that a cut divides is on both
    fragments and clipped on each; fragments through the origin are taken in two pieces.
    """
    seg = feats.select("doc_id", "feature_id", "strand", "n", F.aggregate("segments", F.lit(0).cast("long"), lambda x, s: x + s["end0"] - s["start0"]).alias("size"), F.explode("segments").alias("s"))
    seg = seg.select("doc_id", "feature_id", "strand", "n", "size", F.col("s.start0").alias("a"), F.col("s.end0").alias("b")).filter("b > a")
    over = F.greatest(F.col("start0") + F.col("length") - F.col("n"), F.lit(0))
    piece = lambda a, b: F.struct(a.cast("long").alias("c"), b.cast("long").alias("d"))
    sizes = feats.groupBy("doc_id").agg(F.max("n").alias("n"))
    cut = frags.select("doc_id", "fragment_no", "start0", "length").join(sizes, "doc_id").withColumn("x", F.explode(F.array(piece(F.col("start0"), F.col("start0") + F.col("length") - over), piece(F.lit(0), over))))
    cut = cut.select("doc_id", "fragment_no", F.col("start0").alias("origin"), "x.c", "x.d").filter("d > c")
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor((F.col(b) - 1) / bin_size)))
    lo, hi = F.greatest("a", "c"), F.least("b", "d")
    j = seg.withColumn("bin", bins("a", "b")).join(cut.withColumn("bin", bins("c", "d")), ["doc_id", "bin"]).filter((lo < hi) & (F.floor(lo / bin_size) == F.col("bin")))
    at = F.pmod(lo - F.col("origin"), F.col("n"))
    g = j.groupBy("doc_id", "fragment_no", "feature_id", "strand", "size").agg(F.min(at).alias("first0"), F.max(at + hi - lo).alias("last0"), F.sum(hi - lo).alias("n_bases"))
    return g.select("doc_id", "fragment_no", "feature_id", "strand", "first0", "last0", "n_bases", (F.col("n_bases") < F.col("size")).alias("clipped"))


def line_tiles(feats: DataFrame, line: int = 60, label: int = 5) -> DataFrame:
    """(doc_id, feature_id, line_no, start0, end0, labelled): features cut into the lines of a sequence view."""
    seg = feats.select("doc_id", "feature_id", F.explode("segments").alias("s")).filter("s.end0 > s.start0")
    t = seg.withColumn("line_no", F.explode(F.sequence(F.floor(F.col("s.start0") / line), F.floor((F.col("s.end0") - 1) / line))))
    a, b = F.greatest(F.col("s.start0"), F.col("line_no") * line), F.least(F.col("s.end0"), (F.col("line_no") + 1) * line)
    return t.select("doc_id", "feature_id", "line_no", a.alias("start0"), b.alias("end0"), (b - a >= label).alias("labelled"))


def site_clusters(sites: DataFrame) -> DataFrame:
    """(doc_id, cluster_no, n_sites, first0, last0): sites nearer than max(1, n / 180) to the one before; on circular molecules the
    last cluster joins the first if the gap through the origin is as small."""
    near = F.greatest(F.lit(1.0), F.col("n") / 180)
    w = W.partitionBy("doc_id").orderBy("start0", "enzyme_id", "strand")
    s = sites.withColumn("new", F.when(F.col("start0") - F.lag("start0").over(w) <= near, 0).otherwise(1)).withColumn("c", F.sum("new").over(w))
    every = W.partitionBy("doc_id")
    s = s.withColumn("gap", F.min("start0").over(every) + F.col("n") - F.max("start0").over(every)).withColumn("most", F.max("c").over(every))
    s = s.withColumn("c", F.when((F.col("topology") == "circular") & (F.col("gap") <= near) & (F.col("c") == F.col("most")), 1).otherwise(F.col("c")))
    return s.groupBy("doc_id", F.col("c").cast("long").alias("cluster_no")).agg(F.count(F.lit(1)).alias("n_sites"), F.min("start0").alias("first0"), F.max("start0").alias("last0"))


def assign_lanes(feats: DataFrame) -> DataFrame:
    """(doc_id, feature_id, lane): each feature, by start, in the first lane where it overlaps none.

    Order-dependent, so a small helper goes through the sorted features of whole molecules. As starts ascend, of a lane's features of one
    segment only the last one counts; segments of others, which may lie ahead, are kept by themselves until they are passed.
    """
    kind = feats.select("doc_id").dtypes[0][1]

    def run(batches):
        doc, last, ahead = None, [], []
        for b in batches:
            segments, out = b.column(3), []
            bounds, (starts, ends) = segments.offsets.to_pylist(), (segments.values.field(k).to_pylist() for k in (0, 1))
            for k, own in enumerate(b.column(0).to_pylist()):
                if own != doc:
                    doc, last, ahead = own, [], []
                i, j = bounds[k], bounds[k + 1]
                if j - i == 1 and starts[i] < ends[i]:
                    x, y = starts[i], ends[i]
                    lane = next((n for n, z in enumerate(last) if z[1] <= x and not (ahead[n] and any(x < d and c < y for c, d in ahead[n]))), len(last))
                    more = []
                else:
                    more = list(zip(starts[i:j], ends[i:j], strict=True))
                    lane = next((n for n, z in enumerate(last) if not any(x < d and c < y for x, y in more for c, d in (z, *ahead[n]))), len(last))
                if lane == len(last):
                    last.append((-1, -1))
                    ahead.append([])
                if more:
                    ahead[lane] += more
                else:
                    last[lane] = (x, y)
                    ahead[lane] = [s for s in ahead[lane] if s[1] > x]
                out.append(lane)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], names=["doc_id", "feature_id", "lane"])

    first = F.array_min(F.transform("segments", lambda s: s["start0"]))
    rows = feats.select("doc_id", "feature_id", first.alias("first"), "segments").repartition("doc_id").sortWithinPartitions("doc_id", "first", "feature_id")
    return rows.mapInArrow(run, f"doc_id {kind}, feature_id long, lane long")


def feature_diff(reference: DataFrame, query: DataFrame) -> DataFrame:
    """(doc_id, feature_id, kind): added, removed, modified or unchanged, features being matched by id."""
    cols = ["type", "strand", "segments"]
    a = reference.select("doc_id", "feature_id", F.struct(*cols).alias("before"))
    b = query.select("doc_id", "feature_id", F.struct(*cols).alias("after"))
    j = a.join(b, ["doc_id", "feature_id"], "full")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "unchanged").otherwise("modified")
    return j.select("doc_id", "feature_id", kind.alias("kind"))
