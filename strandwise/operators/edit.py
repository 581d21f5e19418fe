"""Sequence edits with their effect on feature segments, and reports of what an edit touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nt import reverse_complement, rotate

_SEG = "array<struct<start0:bigint,end0:bigint>>"


def _seg(a: Column, b: Column) -> Column:
    return F.struct(a.cast("long").alias("start0"), b.cast("long").alias("end0"))


def insert_text(seq: Column, at: Column, text: Column) -> Column:
    return F.concat(F.substr(seq, F.lit(1), at), text, F.substr(seq, at + 1))


def delete_range(seq: Column, start: Column, end: Column) -> Column:
    """Without [start, end); if end < start, without the part through the origin."""
    return F.when(end < start, F.substr(seq, end + 1, start - end)).otherwise(F.concat(F.substr(seq, F.lit(1), start), F.substr(seq, end + 1)))


def replace_range(seq: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(F.substr(seq, F.lit(1), start), text, F.substr(seq, end + 1))


def invert_range(seq: Column, start: Column, end: Column) -> Column:
    return replace_range(seq, start, end, reverse_complement(F.substr(seq, start + 1, end - start)))


def rotate_origin(seq: Column, origin: Column) -> Column:
    return rotate(seq, origin)


def segments_after_insert(segments: Column, at: Column, size: Column) -> Column:
    """Segments that end by the place stay, those that begin there or beyond move, those around it grow."""
    return F.transform(segments, lambda s: _seg(F.when(s["start0"] >= at, s["start0"] + size).otherwise(s["start0"]), F.when(s["end0"] <= at, s["end0"]).otherwise(s["end0"] + size))).cast(_SEG)


def segments_after_delete(segments: Column, start: Column, end: Column) -> Column:
    """What is left of each segment outside [start, end), moved; segments inside it are gone. Wrapped ranges keep [end, start)."""
    size = end - start
    # a place beyond the deletion moves by its size, one inside it goes to its start
    moved = lambda x: F.when(x <= start, x).when(x >= end, x - size).otherwise(start)
    straight = F.filter(F.transform(segments, lambda s: _seg(moved(s["start0"]), moved(s["end0"]))), lambda s: s["start0"] < s["end0"])
    kept = F.filter(F.transform(segments, lambda s: _seg(F.greatest(s["start0"], end) - end, F.least(s["end0"], start) - end)), lambda s: s["start0"] < s["end0"])
    return F.when(end < start, kept).otherwise(straight).cast(_SEG)


def segments_after_replace(segments: Column, start: Column, end: Column, size: Column) -> Column:
    return segments_after_insert(segments_after_delete(segments, start, end), start, size)


def segments_after_invert(segments: Column, start: Column, end: Column) -> Column:
    """Turned round if all lie inside [start, end); else as they are."""
    inside = F.forall(segments, lambda s: (s["start0"] >= start) & (s["end0"] <= end))
    turned = F.sort_array(F.transform(segments, lambda s: _seg(start + end - s["end0"], start + end - s["start0"])))
    return F.when(inside, turned).otherwise(segments).cast(_SEG)


def merge_adjacent(segments: Column) -> Column:
    """Segments in order of start, those that meet or overlap made one."""

    def step(acc, s):
        last = F.element_at(acc, -1)
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end0"] >= s["start0"]), F.array_append(head, _seg(last["start0"], F.greatest(last["end0"], s["end0"])))).otherwise(F.array_append(acc, s))

    return F.aggregate(F.sort_array(segments), F.array().cast(_SEG), lambda acc, s: step(acc, s))


def segments_after_rotate(segments: Column, origin: Column, n: Column) -> Column:
    """Moved to the new origin; one that now runs through it is cut in two, and parts that meet are joined."""

    def parts(s):
        a = F.pmod(s["start0"] - origin, n)
        b = a + s["end0"] - s["start0"]
        return F.when(b <= n, F.array(_seg(a, b))).otherwise(F.array(_seg(a, n), _seg(F.lit(0), b - n)))

    return merge_adjacent(F.flatten(F.transform(segments, parts)).cast(_SEG))


def with_segments(feats: DataFrame, segments: Column) -> DataFrame:
    """feats with new segments; features that have none left are gone."""
    return feats.withColumn("segments", segments).filter(F.size("segments") > 0)


def changed_positions(before: Column, after: Column) -> Column:
    """0-based places where two texts of one length differ."""
    a, b = F.split(before, ""), F.split(after, "")
    pairs = F.zip_with(a, b, lambda x, y: x != y)
    return F.filter(F.transform(pairs, lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
