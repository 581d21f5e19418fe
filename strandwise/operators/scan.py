"""Motif scan: every overlapping occurrence of patterns in sequences, on either strand, through the origin of circular ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import pieces
from ..functions.nt import let, rc, site_class, site_sets

#: Bases of a block. A long sequence is scanned block by block, so that its cost is linear and its blocks are rows of their own; a block
#: is small, as its starts are summed up in an array that is copied at every match.
BLOCK = 4_096
#: Places at which patterns are tried at once.
PLACES = 1 << 20


def match_starts(text: Column, regex: Column) -> Column:
    """0-based starts of all matches of a regular expression of fixed width, overlapping ones included.

    A mark is put before every match by a lookahead, and the lengths of the parts between marks add up to the starts.
    """
    parts = F.split(F.regexp_replace(text, F.concat(F.lit("(?="), regex, F.lit(")")), F.lit("|")), "[|]")
    lengths = let(parts, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: F.length(x).cast("long")))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["all"], acc["at"] + n).alias("all"))
    return F.aggregate(lengths, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")), step, lambda acc: acc["all"])


def matches(text: Column, regex: Column) -> Column:
    """(start, hit) of all matches, as match_starts, with their text: whoever reads a hit doesn't have to walk to it in the text again."""
    hits = F.regexp_extract_all(text, F.concat(F.lit("(?=("), regex, F.lit("))")), F.lit(1))
    return F.zip_with(match_starts(text, regex), hits, lambda at, hit: F.struct(at.alias("start"), hit.alias("hit")))


def haystack(seq: Column, topology: Column, width: Column) -> Column:
    """The sequence to search for a pattern of `width`: circular ones go on with their first width - 1 bases."""
    n = F.length(seq)
    return F.when((topology == "circular") & (n >= width) & (width > 1), F.concat(seq, F.substr(seq, F.lit(1), width - 1))).otherwise(seq)


def wrapped(seq: Column, topology: Column, width: Column) -> Column:
    """As haystack, but a circular sequence shorter than the pattern is read round more than once."""
    n = F.length(seq)
    return F.when(topology == "circular", F.substr(F.repeat(seq, F.ceil(width / n).cast("int") + 1), F.lit(1), n + width - 1)).otherwise(seq)


def scan(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, n, hay, regex, width, ... ) with a row for each match of regex in hay: its start0 and its text in hit.

    hay is cut into blocks that overlap by width - 1; other columns pass through.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length("hay") - 1, F.lit(0)), F.lit(block))
    cut = docs.withColumn("__at", F.explode(starts)).withColumn("__part", F.substr("hay", F.col("__at") + 1, block + F.col("width") - 1))
    found = cut.drop("hay").withColumn("__m", F.explode(matches(F.col("__part"), F.col("regex"))))
    return found.withColumn("hit", F.col("__m.hit")).withColumn("start0", F.col("__at") + F.col("__m.start")).drop("__at", "__m", "__part")


def strand_patterns(motifs: list[dict], contained: bool = False) -> list[dict]:
    """Motifs (name, motif, ...) on strand 1, and on strand -1 unless they are their own reverse complement."""
    out = []
    for m in motifs:
        for strand, text in ((1, m["motif"]), (-1, rc(m["motif"]))):
            if strand == 1 or text != m["motif"].upper():
                out.append(m | {"strand": strand, "sets": site_sets(text, contained), "regex": site_class(text, contained), "width": len(text)})
    return out


def find(docs: DataFrame, patterns: list[dict], kinds: dict[str, str], shorter: bool = False) -> DataFrame:
    """docs (doc_id, topology, n, seq) without seq, with a row for each match of each pattern: its start0, its text in hit, reverse
    complemented for a pattern of strand -1, and the pattern's own columns that kinds names with their types.

    A pattern's sets are the letters that it takes at each place. Circular molecules are read on through their origin, those shorter
    than the pattern only with `shorter`. A molecule is read once for all patterns, which are tried at many places at a time.
    """
    most = max(len(p["sets"]) for p in patterns)
    columns = [c for c in docs.columns if c != "seq"]
    types = dict(docs.dtypes)
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}

    def run(batches):
        turn = np.frombuffer(rc(bytes(range(128)).decode())[::-1].encode(), np.uint8)
        takes = {s: np.isin(np.arange(256), np.frombuffer(s.encode(), np.uint8)) for p in patterns for s in p["sets"]}
        for b in pieces(batches):
            seqs = [(x or "").encode("ascii", "replace") for x in b.column(b.num_columns - 1).to_pylist()]
            circular = b.column(columns.index("topology")).to_pylist()
            size = np.array([len(x) for x in seqs])
            # a byte that no pattern takes ends each molecule
            hays = [x + (x * (-(-most // len(x))))[: most - 1] if c == "circular" and x else x for x, c in zip(seqs, circular, strict=True)]
            first = np.cumsum([0] + [len(x) + 1 for x in hays[:-1]])
            every = np.frombuffer(b"\0".join(hays) + b"\0" * most, np.uint8)
            for low in range(0, len(every) - most, PLACES):
                text = every[low : low + PLACES + most - 1]
                fits = {s: t[text] for s, t in takes.items()}
                for p in patterns:
                    w = len(p["sets"])
                    places = min(PLACES, len(text) - w + 1)
                    ok = np.ones(places, bool)
                    for i, s in enumerate(p["sets"]):
                        ok &= fits[s][i : i + places]
                    at = np.flatnonzero(ok)
                    row = np.searchsorted(first, at + low, "right") - 1
                    start = at + low - first[row]
                    own = (start < size[row]) & (shorter | (size[row] >= w))
                    at, row, start = at[own], row[own], start[own]
                    if len(at):
                        hit = np.lib.stride_tricks.sliding_window_view(text, w)[at]
                        hit = turn[hit[:, ::-1]] if p["strand"] == -1 else hit
                        hit = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * w), pa.py_buffer(hit.tobytes())])
                        rows = pa.array(row)
                        yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in range(len(columns))), *(pa.repeat(pa.scalar(p[c], arrow[t]), len(at)) for c, t in kinds.items()), pa.array(start, pa.int64()), hit], names=[*columns, *kinds, "start0", "hit"])

    schema = ", ".join([*(f"{c} {types[c]}" for c in columns), *(f"{c} {t}" for c, t in kinds.items()), "start0 bigint, hit string"])
    return docs.select(*columns, "seq").mapInArrow(run, schema)


def with_patterns(docs: DataFrame, patterns: list[dict], kinds: dict[str, str]) -> DataFrame:
    """docs x patterns: a constant array of structs, exploded; each docs row is read once. kinds: columns to take, with types."""
    rows = F.array(*[F.struct(*[F.lit(p[c]).cast(t).alias(c) for c, t in kinds.items()]) for p in patterns])
    return docs.withColumn("__p", F.explode(rows)).select(*docs.columns, *[F.col(f"__p.{c}").alias(c) for c in kinds])


def find_exact(docs: DataFrame, motifs: DataFrame, width: int, strands: tuple[int, ...] = (1, -1)) -> DataFrame:
    """(doc_id, item_id, strand, start0): exact occurrences of many motifs of one width, as an equi-join on k-mers.

    motifs (item_id, motif). Every position's k-mer is joined, so the cost doesn't depend on the number of motifs; a motif that
    is its own reverse complement is found on strand 1 only.
    """
    back = F.reverse(F.translate("motif", "ACGT", "TGCA"))
    both = motifs.select("item_id", F.lit(1).alias("strand"), F.col("motif").alias("kmer")).unionByName(motifs.filter(back != F.col("motif")).select("item_id", F.lit(-1).alias("strand"), back.alias("kmer"))).filter(F.col("strand").isin(*strands))
    hay = docs.select("doc_id", haystack(F.col("seq"), F.col("topology"), F.lit(width)).alias("hay"))
    at = F.sequence(F.lit(0), F.greatest(F.length("hay") - 1, F.lit(0)), F.lit(BLOCK))
    blocks = hay.withColumn("at", F.explode(at)).select("doc_id", "at", F.substr("hay", F.col("at") + 1, F.lit(BLOCK + width - 1)).alias("part"))
    # width shifted copies of a block, each cut in steps of width, hold every k-mer once, in time linear in the block
    shift = blocks.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    kmers = shift.select("doc_id", (F.col("at") + F.col("shift")).alias("base"), F.posexplode(F.regexp_extract_all(F.substr("part", F.col("shift") + 1), F.lit(f"(.{{{width}}})"), 1)).alias("k", "kmer"))
    kmers = kmers.select("doc_id", (F.col("base") + F.col("k") * width).cast("long").alias("start0"), "kmer")
    return kmers.join(both, "kmer").select("doc_id", "item_id", F.col("strand").cast("long").alias("strand"), "start0")


def find_motifs(docs: DataFrame, motifs: DataFrame, seed: int = 16) -> DataFrame:
    """(doc_id, n, item_id, strand, start0, width): exact occurrences of motifs (item_id, motif) of any widths on both strands.

    The first `seed` bases of a motif find candidates in one equi-join on k-mers; the rest is then compared with the sequence.
    Shorter motifs are found whole, one join for each of their widths (fewer than `seed`). A circular sequence is read on through
    its origin, by motifs no longer than itself; empty motifs are found nowhere.
    """
    back = F.reverse(F.translate("motif", "ACGT", "TGCA"))
    motifs = motifs.select("item_id", "motif")
    short = [r.w for r in motifs.select(F.length("motif").alias("w")).filter((F.col("w") > 0) & (F.col("w") < seed)).distinct().collect()]
    ahead = motifs.filter(F.length("motif") >= seed)
    both = ahead.withColumn("s", F.lit(1)).unionByName(ahead.filter(back != F.col("motif")).select("item_id", back.alias("motif"), F.lit(-1).alias("s")))
    # one strand at a time is a motif of its own here
    named = both.select(F.struct("item_id", "s", "motif").alias("item_id"), F.left("motif", F.lit(seed)).alias("motif"))
    at = find_exact(docs, named, seed, strands=(1,)).select("doc_id", "start0", "item_id.*")
    seqs = docs.select("doc_id", "topology", "n", "seq")
    width = F.length("motif")
    fits = (width <= F.col("n")) & (F.substr(F.when(F.col("topology") == "circular", F.concat("seq", "seq")).otherwise(F.col("seq")), F.col("start0").cast("int") + 1, width) == F.col("motif"))
    out = at.join(seqs, "doc_id").filter(fits).select("doc_id", "n", "item_id", F.col("s").cast("long").alias("strand"), "start0", width.alias("width"))
    for w in sorted(short):
        out = out.unionByName(find_exact(docs, motifs.filter(F.length("motif") == w), w).join(docs.select("doc_id", "n"), "doc_id").withColumn("width", F.lit(w)))
    return out
