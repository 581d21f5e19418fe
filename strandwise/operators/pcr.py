"""Primer bindings, primer properties and in-silico PCR."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import pieces
from ..functions.nt import count_of, rc

# Enthalpy (kcal/mol) and entropy (cal/mol K) of the ten nearest-neighbour pairs of DNA (SantaLucia, 1998).
_STACKS = """
AA -7.9 -22.2
AT -7.2 -20.4
TA -7.2 -21.3
CA -8.5 -22.7
GT -8.4 -22.4
CT -7.8 -21.0
GA -8.2 -22.2
CG -10.6 -27.2
GC -9.8 -24.4
GG -8.0 -19.9
"""
STACKS = {}
for _line in _STACKS.split("\n"):
    if _line:
        _pair, _h, _s = _line.split()
        for _p in (_pair, _pair[::-1].translate(str.maketrans("ACGT", "TGCA"))):
            STACKS[_p] = (float(_h), float(_s))
#: Monovalent salt (mol/l) and primer (mol/l) of the melting temperature.
SALT, PRIMER = 0.05, 200e-9
#: Mass of a nucleotide in a strand; END is what the two ends lack.
MASS, END = {"A": 313.21, "C": 289.18, "G": 329.21, "T": 304.2}, -61.96
#: Products formed at a time.
FORMED = 1 << 17
_BOUND = ("direction", "primer_id", "five0", "width")


def gc_percent(primer: Column) -> Column:
    return F.floor(count_of(primer, "GC") * 1000.0 / F.length(primer) + 0.5) / 10


def wallace_tm(primer: Column) -> Column:
    """2 degrees for each A or T, 4 for each G or C."""
    return (count_of(primer, "AT") * 2 + count_of(primer, "GC") * 4).cast("double")


def nearest_neighbor_tm(primer: Column) -> Column:
    """Melting temperature by stacked pairs, with initiation by the end bases and a salt correction, to a tenth of a degree."""
    n = F.length(primer)
    ends = F.array(F.substr(primer, F.lit(1), F.lit(1)), F.substr(primer, n, F.lit(1)))
    start = F.aggregate(ends, F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("s")), lambda a, e: F.struct((a["h"] + F.when(e.isin("A", "T"), 2.3).otherwise(0.1)).alias("h"), (a["s"] + F.when(e.isin("A", "T"), 4.1).otherwise(-2.8)).alias("s")))
    value = lambda k, i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p, v in STACKS.items() for x in (p, v[i])]), k), F.lit(0.0))
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(primer, i, F.lit(2)))
    total = F.aggregate(pairs, start, lambda a, p: F.struct((a["h"] + value(p, 0)).alias("h"), (a["s"] + value(p, 1)).alias("s")))
    tm = total["h"] * 1000 / (total["s"] + 0.368 * (n - 1) * math.log(SALT) + 1.987 * math.log(PRIMER / 4)) - 273.15
    return F.floor(tm * 10 + 0.5) / 10


def molecular_weight(primer: Column) -> Column:
    # whole hundredths, so that sums don't depend on their order
    total = F.lit(round(END * 100))
    for base, mass in MASS.items():
        total = total + count_of(primer, base) * round(mass * 100)
    return F.floor(total / 10.0 + 0.5) / 10


def melting_temperature(primer: Column) -> Column:
    """Wallace from 14 to 20 bases, else nearest neighbours."""
    return F.when(F.length(primer).between(14, 20), wallace_tm(primer)).otherwise(nearest_neighbor_tm(primer))


def _starts(text: str, part: str):
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def own_bindings(docs: DataFrame) -> DataFrame:
    """As bindings, of docs (doc_id, topology, n, seq, primers): a molecule's primers (primer_id, primer) are in its row, so nothing is shuffled."""
    kinds = dict(docs.dtypes)
    primer = docs.schema["primers"].dataType.elementType["primer_id"].dataType.simpleString()

    def run(batches):
        for b in pieces(batches):
            rows, cols = [], ([], [], [], [])
            for k, (topology, n, seq, primers) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                for p in primers or []:
                    own, w = p["primer"], len(p["primer"] or "")
                    if seq is None or not own or n < w:
                        continue
                    hay = seq + seq[: w - 1] if topology == "circular" else seq
                    for direction, part in ((1, own), (-1, rc(own))):
                        for start in _starts(hay, part):
                            rows.append(k)
                            for c, x in zip(cols, (p["primer_id"], direction, start, w), strict=True):
                                c.append(x)
            take = pa.array(rows, pa.int64())
            ids = pa.array(cols[0], b.schema.field(4).type.value_type.field("primer_id").type)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in range(3)), ids, *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "topology", "n", "primer_id", "direction", "start0", "width"])

    schema = f"doc_id {kinds['doc_id']}, topology string, n {kinds['n']}, primer_id {primer}, direction bigint, start0 bigint, width bigint"
    hits = docs.select("doc_id", "topology", "n", "seq", F.transform("primers", lambda p: F.struct(p["primer_id"].alias("primer_id"), p["primer"].alias("primer"))).alias("primers")).mapInArrow(run, schema)
    last = F.pmod(F.col("start0") + F.col("width") - 1, F.col("n"))
    ahead, over = F.col("direction") == 1, F.col("start0") + F.col("width") > F.col("n")
    return hits.select(
        "doc_id", "topology", "n", "primer_id", F.when(ahead, "forward").otherwise("reverse").alias("orientation"), "direction", "start0", (last + 1).alias("end0"), F.when(ahead, F.col("start0")).otherwise(last).alias("five0"),
        F.when(ahead, last).otherwise(F.col("start0")).alias("three0"), over.alias("wraps"), "width",
    )


def bindings(docs: DataFrame, primers: DataFrame) -> DataFrame:
    """(doc_id, primer_id, orientation, direction, start0, end0, five0, three0, wraps, topology, n, width) of every binding.

    docs (doc_id, topology, seq, n); primers (doc_id, primer_id, primer) bind to their own document. A primer binds forward where
    the sequence holds it, reverse where it holds its reverse complement; palindromes bind both ways.
    """
    own = primers.groupBy("doc_id").agg(F.collect_list(F.struct("primer_id", "primer")).alias("primers"))
    return own_bindings(docs.select("doc_id", "topology", "n", "seq").join(own, "doc_id"))


def binder_class(primers: DataFrame, bound: DataFrame) -> DataFrame:
    """(doc_id, primer_id, n_bindings, binder): none, unique or multiple."""
    counts = bound.groupBy("doc_id", "primer_id").agg(F.count(F.lit(1)).alias("k"))
    j = primers.select("doc_id", "primer_id").join(counts, ["doc_id", "primer_id"], "left").withColumn("n_bindings", F.coalesce("k", F.lit(0)))
    return j.select("doc_id", "primer_id", "n_bindings", F.when(F.col("n_bindings") == 0, "none").when(F.col("n_bindings") == 1, "unique").otherwise("multiple").alias("binder"))


def _pairs(bound, n: int, circular: bool) -> list[tuple]:
    """(plus primer, minus primer, plus places, ends, least length) of each two primers of a molecule that may face each other.

    bound (direction, primer_id, five0, width); ends are the minus places, of a circle once more a turn later.
    """
    found = {}, {}
    for direction, primer, five0, width in bound:
        side, key = found[direction != 1], (primer, five0)
        side[key] = min(width, side.get(key, width))
    sides = {}, {}
    for side, own in zip(sides, found, strict=True):
        for (primer, five0), width in own.items():
            side.setdefault((primer, width), []).append(five0)
    plus, minus = ({k: np.array(sorted(v), np.int64) for k, v in side.items()} for side in sides)
    return [(p, m, a, np.concatenate([b, b + n]) if circular else b, max(pw, mw)) for (p, pw), a in plus.items() for (m, mw), b in minus.items() if p != m]


def _between(plus: np.ndarray, ends: np.ndarray, least: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For each plus place, of its products longer than `low`, up to `high`, the first one's end and their number."""
    first = np.searchsorted(ends, plus + max(least - 1, low))
    return first, np.maximum(np.searchsorted(ends, plus + high) - first, 0)


def _upto(pairs: list[tuple], high: int) -> int:
    """How many pairs of places make a product of at most `high` bases."""
    return sum(int(_between(plus, ends, least, 0, high)[1].sum()) for _, _, plus, ends, least in pairs)


def _ranges(pairs: list[tuple], n: int, most: int | None):
    """(low, high, before): ranges of the lengths over `low`, up to `high`, in order, with at most FORMED products or one length each.

    before counts the products that are shorter. Ranges after the first `most` products are left out; None: all are given.
    """
    before, todo = 0, [(0, n, _upto(pairs, n))]
    while todo and (most is None or before < most):
        low, high, till = todo.pop()
        if till - before <= FORMED or high - low == 1:
            if till > before:
                yield low, high, before
                before = till
        else:
            middle = (low + high) // 2
            todo += [(middle, high, till), (low, middle, _upto(pairs, middle))]


def _formed(pairs: list[tuple], n: int, circular: bool, low: int, high: int) -> list[np.ndarray]:
    """(plus_primer, minus_primer, start0, end0, length, wraps) of a molecule's products longer than `low`, up to `high`, in order."""
    names, parts = np.array(sorted({x for p in pairs for x in p[:2]})), []
    for p, m, plus, ends, least in pairs:
        first, count = _between(plus, ends, least, low, high)
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        start = np.repeat(plus, count)
        length = ends[at] - start + 1
        # a whole circle is one product, wherever it begins
        start = np.where(circular & (length == n), 0, start)
        parts.append([length, start, *(np.full(len(at), np.searchsorted(names, x)) for x in (p, m))])
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.lexsort(rows[::-1])]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
    length, start, p, m = rows[:, new]
    whole = circular & (length == n)
    end = np.where(circular & ~whole, (start + length) % n, start + length)
    return [names[p], names[m], start, end, length, whole | (circular & (start >= end))]


def _products(bound: list[dict], topology: str, n: int, most: int | None = None) -> list[tuple]:
    """(plus_primer, minus_primer, start0, end0, length, wraps) of one molecule's products in order: all, or the first `most` of them."""
    circular = topology == "circular"
    pairs = _pairs(([x[c] for c in _BOUND] for x in bound), n, circular)
    return [x for low, high, _ in _ranges(pairs, n, most) for x in zip(*(c.tolist() for c in _formed(pairs, n, circular, low, high)), strict=True)][:most]


def _own(bound: DataFrame, forward: str, reverse: str) -> DataFrame:
    """(doc_id, topology, n, own): the bindings of two primers to a molecule as one row."""
    return bound.filter(F.col("primer_id").isin(forward, reverse)).groupBy("doc_id").agg(F.first("topology").alias("topology"), F.first("n").alias("n"), F.collect_list(F.struct(*_BOUND)).alias("own"))


def _molecules(b: pa.RecordBatch):
    """(pairs, n, circular) of each row (doc_id, topology, n, own) of a batch."""
    own = b.column(3)
    cols, ends = [own.flatten().field(c).to_pylist() for c in _BOUND], [0, *np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False)).tolist()]
    for k, (topology, n) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
        circular = topology == "circular"
        yield _pairs(zip(*(c[ends[k] : ends[k + 1]] for c in cols), strict=True), n, circular), n, circular


def amplicons(bound: DataFrame, forward: str, reverse: str, most: int | None = 250) -> DataFrame:
    """(doc_id, plus_primer, minus_primer, start0, end0, length, wraps, product_no): products of two primers, either one as the plus one.

    A product runs from the 5' base of a binding that extends forward to that of one extending back, and holds both footprints.
    They are numbered in the order of length, start and primers; None gives all of them, a number the first `most` of each document.
    A molecule's bindings are one row for each range of lengths, so that tasks share the products of a repeat and hold few at a time.
    """
    own = _own(bound, forward, reverse)
    kinds = dict(own.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "topology", "n", "own"))

    def ranges(batches):
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("low", "high", "before")]))
        for b in pieces(batches):
            found = [[dict(zip(("low", "high", "before"), x, strict=True)) for x in _ranges(pairs, n, most)] for pairs, n, _ in _molecules(b)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "ranges"])

    def form(batches):
        for b in pieces(batches):
            owner, parts, size = [], [], 0
            for k, ((pairs, n, circular), low, high, before) in enumerate(zip(_molecules(b), *(b.column(c).to_pylist() for c in (4, 5, 6)), strict=True)):
                made = _formed(pairs, n, circular, low, high)
                count = len(made[0]) if most is None else min(len(made[0]), most - before)
                owner.append(np.full(count, k))
                parts.append([*(c[:count] for c in made), np.arange(before + 1, before + count + 1)])
                size += count
                if size >= FORMED or k == b.num_rows - 1:
                    cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(owner))), *(pa.array(c) for c in cols)], names=["doc_id", "plus_primer", "minus_primer", "start0", "end0", "length", "wraps", "product_no"])
                    owner, parts, size = [], [], 0

    cut = own.mapInArrow(ranges, f"{head}, ranges array<struct<low:bigint,high:bigint,before:bigint>>").select("doc_id", "topology", "n", "own", F.inline("ranges"))
    # a number keeps Spark from joining partitions, whose bindings are few but not their products
    tasks = int(bound.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(tasks, "doc_id", "low").mapInArrow(form, f"doc_id {kinds['doc_id']}, plus_primer string, minus_primer string, start0 bigint, end0 bigint, length bigint, wraps boolean, product_no bigint")


def product_lengths(bound: DataFrame, forward: str, reverse: str) -> DataFrame:
    """(doc_id, n_products, shortest, longest) of all products, as amplicons, of each document that has any: they are counted without being formed."""
    own = _own(bound, forward, reverse)

    def run(batches):
        for b in pieces(batches):
            rows = []
            for k, (pairs, n, circular) in enumerate(_molecules(b)):
                # a whole circle is one product of its primers, wherever it begins
                total = _upto(pairs, n - circular) + (len({(p, m) for p, m, plus, ends, least in pairs if _between(plus, ends, least, n - 1, n)[1].any()}) if circular else 0)
                if total:
                    found = [(plus[some], ends, first[some], count[some]) for _, _, plus, ends, least in pairs for first, count in [_between(plus, ends, least, 0, n)] for some in [count > 0] if some.any()]
                    rows.append((k, total, min(int((ends[first] - plus).min()) for plus, ends, first, _ in found) + 1, max(int((ends[first + count - 1] - plus).max()) for plus, ends, first, count in found) + 1))
            owner, *cols = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_products", "shortest", "longest"])

    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, n_products bigint, shortest bigint, longest bigint")
