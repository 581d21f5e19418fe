"""Substring dedup by hashing units of text: lines and paragraphs, and besides them pieces whose ends the content itself decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_join

#: Words from which a line or a paragraph (lines up to a blank one) is a unit that goes by itself where it repeats.
MIN_UNIT = 24
#: Pieces find passages inside longer lines. A piece starts at every mark and ends at the first one at least SPAN words on. In any
#: WINDOW successive word pairs there is a mark, and marks at least WINDOW words inside a passage are the same wherever it stands:
#: copies of a passage of 50 words share pieces that cover it but for fewer than WINDOW words at either end. Only runs of pieces
#: of at least MIN_RUN words go: more than the longest piece (SPAN + WINDOW + 1), so that one shared digest is never enough.
SPAN, WINDOW, MIN_RUN = 12, 10, 24

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 16


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_POW, _INV = _powers(_CHUNK, _BASE), _powers(_CHUNK, pow(_BASE, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, stop) of every word of the bytes, A-Z as a-z; a polynomial of its bytes, whichever place it stands at."""
    gap = _GAP[raw]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    starts, stops = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, stops
    low = _LOW[raw].astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(starts), np.uint64)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            at = starts[first]
            last = max(first + 1, int(np.searchsorted(stops, at + _CHUNK, "right")))
            n = int(stops[last - 1] - at)
            power, inverse = (_POW, _INV) if n <= _CHUNK else (_powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64)))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low[at : at + n] * power[:n], dtype=np.uint64)])
            s, e = starts[first:last] - at, stops[first:last] - at
            out[first:last] = (sums[e] - sums[s]) * inverse[s]
            first = last
    return _mix(out), starts, stops


def _digests(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit digest of words[begin:end] for each pair; equal for equal words, at whatever place and of whatever length."""
    n = len(words)
    power, inverse = (_POW, _INV) if n <= _CHUNK else (_powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64)))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:n], dtype=np.uint64)])
        return _mix((sums[end] - sums[begin]) * inverse[begin])


def units(text: str | None, pieces: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, begin, end) of the units, in words, in order of begin; whether a unit is a line or paragraph; start and stop of the
    words, in bytes. pieces: whether those that the content decides are made too."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    words, starts, stops = word_hashes(raw)
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < SPAN + 2:
        return none.astype(np.uint64), none, none, none.astype(bool), starts, stops
    begin = end = none
    if pieces:
        with np.errstate(over="ignore"):
            pairs = _mix(words[:-1] * np.uint64(3) + words[1:])
        width = min(WINDOW, len(pairs))
        least = np.lib.stride_tricks.sliding_window_view(pairs, width).argmin(1) + np.arange(len(pairs) - width + 1)
        marks = np.unique(least)
        to = np.searchsorted(marks, marks + SPAN)
        begin, end = marks[to < len(marks)], marks[to[to < len(marks)]] + 2
    line = np.searchsorted(np.flatnonzero(raw == 10), starts)
    step = np.diff(line, prepend=-2)
    first, top = np.flatnonzero(step), np.flatnonzero(step > 1)
    last, bottom = np.append(first[1:], n), np.append(top[1:], n)
    # a paragraph of one line is that line
    several = line[bottom - 1] > line[top]
    first, last = np.concatenate([first, top[several]]), np.concatenate([last, bottom[several]])
    long = last - first >= MIN_UNIT
    first, last = first[long], last[long]
    lines = _mix(_digests(words, first, last) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    digest = np.concatenate([_digests(words, begin, end), lines])
    begin, end = np.concatenate([begin, first]), np.concatenate([end, last])
    is_line = np.arange(len(digest)) >= len(digest) - len(lines)
    order = np.lexsort((-end, is_line, begin))
    return digest[order], begin[order], end[order], is_line[order], starts, stops


def _spans(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of [begin, end), given in order of begin, as disjoint spans."""
    out: list[tuple[int, int]] = []
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def cut(text: str | None, elsewhere: np.ndarray, pieces: bool = True) -> tuple[str, list[int], list[int]]:
    """(text kept, starts and stops of what goes, in code points of the original text).

    A unit goes if its digest is among `elsewhere` (an earlier document has it) or came before in this text: lines and paragraphs
    each by itself, pieces where they run to MIN_RUN words.
    """
    text = text or ""
    digest, begin, end, is_line, starts, stops = units(text, pieces)
    gone = np.isin(digest, elsewhere)
    seen = np.ones(len(digest), bool)
    seen[np.unique(digest, return_index=True)[1]] = False
    gone |= seen
    runs = [(b, e) for b, e in _spans(begin[gone & ~is_line], end[gone & ~is_line]) if e - b >= MIN_RUN]
    every = sorted(runs + list(zip(begin[gone & is_line].tolist(), end[gone & is_line].tolist(), strict=True)))
    runs = _spans(np.array([b for b, _ in every], np.int64), np.array([e for _, e in every], np.int64))
    if not runs:
        return text, [], []
    raw = text.encode()
    kept, at, begin_cp, end_cp, cp = [], 0, [], [], 0
    for b, e in runs:
        s, t = int(starts[b]), int(stops[e - 1])
        before, inside = raw[at:s].decode(), raw[s:t].decode()
        kept.append(before)
        begin_cp.append(cp + len(before))
        cp += len(before) + len(inside)
        end_cp.append(cp)
        at = t
    kept.append(raw[at:].decode())
    return "".join(kept), begin_cp, end_cp


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: bool = True) -> DataFrame:
    """Every row of docs with its text less the passages that an earlier document, or the text itself before, already has; and
    removed (array<struct<start,stop>>, code points of the original text) and n_removed (long, code points).

    Units are hashed and their digests grouped globally; the earliest by id, then by place, keeps each unit. Units are lines and
    paragraphs of at least MIN_UNIT words and, with pieces, content-defined pieces, as passages also repeat inside longer lines.
    Rows that repeat an id count as one document. A row with a null id is a document of its own, after all that have one and in
    the order of the rows, which must be the same whenever docs is read, as it is for a table. Null text counts as empty. Columns of docs named removed or n_removed are replaced; others pass
    through. Units are made once for the digests, and again only for texts that lose some.
    """
    own = {text_col.lower(), "removed", "n_removed"}
    scratch = Scratch(docs.sparkSession)
    ident, body = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    # rows of one id may differ in text: what goes belongs to the pair of id and text, or to the row where there is no id
    at = F.when(ident.isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(body)).alias("at")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), ident.alias("id"), body.alias("body"), at)

    def emit(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                digests = [units(t, pieces)[0] for t in part.column(2).to_pylist()]
                first = [np.unique(d).view(np.int64) for d in digests]
                # whether the text repeats itself
                again = [len(f) < len(d) for f, d in zip(first, digests, strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in first])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int64), *first])), pa.array(again, pa.bool_())], names=["id", "at", "digests", "again"])

    kind = dict(rows.dtypes)["id"]
    found, path = scratch.keep(rows.select("id", "at", "body").mapInArrow(emit, f"id {kind}, at long, digests array<long>, again boolean"))
    known = found.select("id", "at", F.explode("digests").alias("digest"))
    shared = known.groupBy("digest").agg(F.min("id").alias("keeper"), F.min(F.when(F.col("id").isNull(), F.col("at"))).alias("keeper_at"), F.count(F.lit(1)).alias("n"))
    shared = shared.filter("n > 1").select("digest", "keeper", "keeper_at", "n")
    mine = F.when(F.col("keeper").isNull(), F.col("at") == F.col("keeper_at")).otherwise(F.coalesce(F.col("id") == F.col("keeper"), F.lit(False)))
    late = salted_join(known, shared, "digest", "n", F.col("at")).filter(~mine).select("id", "at", "digest")
    late = late.unionByName(found.filter("again").select("id", "at", F.lit(None).cast("long").alias("digest")))
    marks, _ = scratch.keep(late.groupBy("id", "at").agg(F.collect_set("digest").alias("late")).select(F.col("id").alias("id_"), F.col("at").alias("at_"), "late"))
    scratch.drop(path)

    @F.pandas_udf("struct<kept:string,starts:array<int>,stops:array<int>>")
    def trim(texts, late):
        import pandas as pd

        got = [cut(t, np.asarray(d, np.int64).view(np.uint64), pieces) if d is not None else (t or "", [], []) for t, d in zip(texts, late, strict=True)]
        return pd.DataFrame(got, columns=["kept", "starts", "stops"])

    joined = rows.join(marks, F.col("id").eqNullSafe(F.col("id_")) & (F.col("at") == F.col("at_")), "left")
    # texts that stay whole don't go through Python
    done = joined.filter("late is not null").withColumn("t", trim("body", "late"))
    spans = F.arrays_zip(F.col("t.starts").alias("start"), F.col("t.stops").alias("stop"))

    def finish(df, kept, removed):
        keep = [F.col(f"row.`{c}`").alias(c) if c.lower() != text_col.lower() else kept.alias(c) for c in docs.columns if c.lower() not in own or c.lower() == text_col.lower()]
        return df.select(*keep, removed.cast("array<struct<start:int,stop:int>>").alias("removed")).withColumn("n_removed", F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"]))

    whole = finish(joined.filter("late is null"), F.coalesce("body", F.lit("")), F.array())
    return whole.unionByName(finish(done, F.col("t.kept"), spans))


def op10_substring_dedup(spark, sf_dir):
    from .common import table

    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
