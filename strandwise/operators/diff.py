"""Comparison of molecules: canonical rotations, edit scripts, global alignment, runs of differences, protein consequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.batches import pieces
from ..functions.nt import rc, translate_codons
from .align import aligned_groups, regrouped, score


def least_rotation(text: str) -> int:
    """Start of the least rotation, the smallest if several are equal; linear time by comparing two candidates."""
    n, i, j, k = len(text), 0, 1, 0
    while i < n and j < n and k < n:
        a, b = text[(i + k) % n], text[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i = max(i + k + 1, j)
            j = i + 1
        else:
            j = j + k + 1
        k = 0
    return min(i, j) if n else 0


def canonical(text: str) -> tuple[str, int, int]:
    """(sequence, strand, rotation): the lesser of the least rotations of a circular sequence and its reverse complement."""
    best = None
    for strand, t in ((1, text), (-1, rc(text))):
        r = least_rotation(t)
        cand = (t[r:] + t[:r], -strand, r)
        best = cand if best is None or cand < best else best
    return best[0], -best[1], best[2]


def canonical_forms(docs: DataFrame) -> DataFrame:
    """(doc_id, canonical, strand, rotation) of circular docs (doc_id, seq): a small helper row by row, without a shuffle."""

    def run(batches):
        for b in pieces(batches):
            got = [canonical(s or "") for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], names=["doc_id", "canonical", "strand", "rotation"])

    kind = docs.select("doc_id").dtypes[0][1]
    return docs.select("doc_id", "seq").mapInArrow(run, f"doc_id {kind}, canonical string, strand long, rotation long")


def to_original(start0: Column, end0: Column, strand: Column, rotation: Column, n: Column) -> Column:
    """Segments on the original molecule of [start0, end0) on its canonical form; two where they run through the origin."""
    a = F.pmod(F.when(strand == 1, start0 + rotation).otherwise(n - rotation - end0), n)
    b = a + end0 - start0
    seg = lambda x, y: F.struct(x.cast("long").alias("start0"), y.cast("long").alias("end0"))
    return F.when(b <= n, F.array(seg(a, b))).otherwise(F.array(seg(a, n), seg(F.lit(0), b - n)))


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _run(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common head of two arrays, looked at in growing steps."""
    at, step = 0, 64
    while True:
        w = min(len(x), len(y), at + step)
        unequal = np.flatnonzero(x[at:w] != y[at:w])
        if len(unequal):
            return at + int(unequal[0])
        if w < at + step:
            return w
        at, step = w, 4 * step


#: Edits up to which the diagonals of a step are gone through one by one; a few take less time so than as arrays.
FEW = 12


def _step(before: list[int], x: np.ndarray, y: np.ndarray, p: str, q: str) -> list[int]:
    """The furthest places in x (text p) on the diagonals of the step after `before`, or of the first one."""
    d, out, n, m = len(before), [], len(x), len(y)
    for t in range(d + 1):
        above, below, k = before[t] if t < d else -1, before[t - 1] if t else -1, 2 * t - d
        i = (above if below < above else below + 1) if d else 0
        till = min(i + 8, n, m + k)
        while i < till and p[i] == q[i - k]:
            i += 1
        if i == till and i < min(n, m + k):
            i += _run(x[i:], y[i - k :])
        out.append(i)
    return out


def edit_script(a: str, b: str, limit: int = 4096) -> list[tuple[str, int, int, str, str]] | None:
    """Shortest script of (kind, start in a, start in b, bases of a, bases of b) from a to b, or None above `limit` edits.

    Greedy furthest-reaching paths between the common ends, beyond FEW edits all diagonals of a step at once; a deletion and an insertion side by
    side are a substitution. A step keeps four bytes a diagonal: 34 MB at 4,096 edits.
    """
    x, y = _letters(a), _letters(b)
    head = _run(x, y)
    x, y = x[head:], y[head:]
    tail = _run(x[::-1], y[::-1])
    n, m = len(x) - tail, len(y) - tail
    x, y = x[:n], y[:m]
    trail: list = []
    p, q = a[head : head + n], b[head : head + m]
    for d in range(min(limit, n + m) + 1):
        if d <= FEW:
            trail.append(_step(trail[-1] if d else [], x, y, p, q))
            if any(i >= n and i - k >= m for i, k in zip(trail[-1], range(-d, d + 1, 2), strict=True)):
                return _runs(_walk(trail, n, m), p, q, head)
            continue
        k = np.arange(-d, d + 1, 2)
        # the diagonal above is reached by an insertion, the one below by a deletion
        above, below = np.append(trail[-1], np.int32(-1)), np.insert(trail[-1], 0, -1)
        i = np.where(below < above, above, below + 1)
        live = np.arange(len(k))
        for _ in range(16):
            live = live[(i[live] < n) & (i[live] - k[live] < m)]
            live = live[x[i[live]] == y[i[live] - k[live]]]
            if not len(live):
                break
            i[live] += 1
        for t in live.tolist():
            i[t] += _run(x[i[t] :], y[i[t] - k[t] :])
        trail.append(i)
        if ((i >= n) & (i - k >= m)).any():
            return _runs(_walk(trail, n, m), p, q, head)
    return None


def positional_script(a: str, b: str) -> list[tuple[str, int, int, str, str]]:
    """Place by place between the common ends: runs of unequal bases, then what the longer side has more. Not the shortest script."""
    x, y = _letters(a), _letters(b)
    head = _run(x, y)
    tail = _run(x[head:][::-1], y[head:][::-1])
    n, m = len(x) - head - tail, len(y) - head - tail
    both = min(n, m)
    at = np.flatnonzero(x[head : head + both] != y[head : head + both]) + head
    out = [("substitution", int(r[0]), int(r[0]), a[r[0] : r[-1] + 1], b[r[0] : r[-1] + 1]) for r in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(r)]
    end = head + both
    if n > both:
        out.append(("deletion", end, end, a[end : head + n], ""))
    if m > both:
        out.append(("insertion", end, end, "", b[end : head + m]))
    return out


def _walk(trail: list[np.ndarray], n: int, m: int) -> list[tuple[str, int, int]]:
    """Single steps, in order, of the path that the trail records."""
    steps, i, j = [], n, m
    for d in range(len(trail) - 1, 0, -1):
        before, t = trail[d - 1], (i - j + d) // 2
        inserted = t == 0 or (t != d and before[t - 1] < before[t])
        k = i - j + (1 if inserted else -1)
        i = int(before[t if inserted else t - 1])
        j = i - k
        steps.append(("insertion" if inserted else "deletion", i, j))
    return steps[::-1]


def _runs(steps: list[tuple[str, int, int]], x: str, y: str, head: int) -> list[tuple[str, int, int, str, str]]:
    out, k = [], 0
    while k < len(steps):
        i, j = steps[k][1], steps[k][2]
        i1, j1 = i, j
        while k < len(steps) and (steps[k][1], steps[k][2]) == (i1, j1):
            i1, j1 = (i1 + 1, j1) if steps[k][0] == "deletion" else (i1, j1 + 1)
            k += 1
        both = min(i1 - i, j1 - j)
        if both:
            out.append(("substitution", i + head, j + head, x[i : i + both], y[j : j + both]))
        if i1 - i > both:
            out.append(("deletion", i + both + head, j1 + head, x[i + both : i1], ""))
        if j1 - j > both:
            out.append(("insertion", i1 + head, j + both + head, "", y[j + both : j1]))
    return out


def differences(pairs: DataFrame, limit: int = 4096) -> DataFrame:
    """(doc_id, kind, ref_start0, qry_start0, ref_bases, qry_bases) of pairs (doc_id, reference, query); equal pairs stay in the JVM.

    Beyond `limit` edits the places are compared one by one between the common ends: all differences are there, but not the shortest
    script.
    """
    kind = pairs.select("doc_id").dtypes[0][1]

    def run(batches):
        for b in batches:
            rows = []
            for i, r, q in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                script = edit_script(r or "", q or "", limit)
                rows += [(i, *s) for s in (positional_script(r or "", q or "") if script is None else script)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [b.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "kind", "ref_start0", "qry_start0", "ref_bases", "qry_bases"])

    return pairs.filter("not (reference <=> query)").select("doc_id", "reference", "query").mapInArrow(run, f"doc_id {kind}, kind string, ref_start0 long, qry_start0 long, ref_bases string, qry_bases string")


def realigned_pairs(pairs: DataFrame, limit: int = 4096, gap: int = 12, most: int = 65_536, cells: int = 1 << 22, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, differences) and the columns of pairs that keep names: what differences() and align.realigned() find, as a list in the
    row of each pair (doc_id, reference, query), in order. Nothing is shuffled, and the texts are read once."""
    kinds = dict(pairs.dtypes)
    names = ["kind", "ref_start0", "qry_start0", "ref_bases", "qry_bases"]

    def run(batches):
        for b in pieces(batches):
            rows, todo = [[] for _ in range(b.num_rows)], []
            for i, (r, q) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2)), strict=True)):
                r, q = r or "", q or ""
                script = edit_script(r, q, limit) if r != q else []
                rows[i], groups = regrouped(positional_script(r, q) if script is None else script, gap, most)
                todo += [(i, ra, qa, r[ra:rb], q[qa:qb]) for ra, rb, qa, qb in groups]
            for i, *x in aligned_groups(todo, cells):
                rows[i].append(tuple(x))
            flat = [x for row in rows for x in sorted(row, key=lambda x: (x[1], x[2]))]
            cols = list(zip(*flat, strict=True)) if flat else [[]] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            found = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
            ends = np.cumsum([0] + [len(row) for row in rows]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, found), *(b.column(c) for c in range(3, b.num_columns))], names=["doc_id", "differences", *keep])

    kept = [F.col(c).alias(f"__{c}") for c in keep]
    schema = f"doc_id {kinds['doc_id']}, differences array<struct<kind: string, ref_start0: bigint, qry_start0: bigint, ref_bases: string, qry_bases: string>>"
    return pairs.select("doc_id", "reference", "query", *kept).mapInArrow(run, schema + "".join(f", {c} {kinds[c]}" for c in keep))


def alignment_scores(pairs: DataFrame) -> DataFrame:
    """(doc_id, score) of pairs (doc_id, reference, query) of any lengths; null counts as empty."""
    kind = pairs.select("doc_id").dtypes[0][1]

    def run(batches):
        for b in batches:
            got = [score(r or "", q or "") for r, q in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64())], names=["doc_id", "score"])

    return pairs.select("doc_id", "reference", "query").mapInArrow(run, f"doc_id {kind}, score long")


def difference_runs(pairs: DataFrame, block: int = 4096) -> DataFrame:
    """(doc_id, start0, end0, n, ref_bases, qry_bases): runs of differing places of pairs of one length.

    Blocks that are equal go first, by a comparison of texts; only unequal places of the others become rows.
    """
    cut = lambda c: F.regexp_extract_all(c, F.lit(f"(.{{1,{block}}})"), 1)
    b = pairs.select("doc_id", F.posexplode(F.arrays_zip(cut("reference").alias("r"), cut("query").alias("q"))).alias("k", "x")).filter("x.r <> x.q")
    cells = F.zip_with(F.split("x.r", ""), F.split("x.q", ""), lambda r, q: F.when(r != q, F.struct(r.alias("r"), q.alias("q"))))
    cells = F.filter(F.transform(cells, lambda x, i: F.when(x.isNotNull(), F.struct(i.alias("i"), x["r"].alias("r"), x["q"].alias("q")))), lambda x: x.isNotNull())
    p = b.select("doc_id", "k", F.explode(cells).alias("x")).select("doc_id", (F.col("k") * block + F.col("x.i")).alias("pos"), "x")
    p = p.withColumn("island", F.col("pos") - F.row_number().over(W.partitionBy("doc_id").orderBy("pos")))
    text = lambda f: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", f"x.{f}"))), lambda s: s[f]), "")
    g = p.groupBy("doc_id", "island").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count(F.lit(1)).alias("n"), text("r").alias("ref_bases"), text("q").alias("qry_bases"))
    return g.select("doc_id", F.col("a").cast("long").alias("start0"), (F.col("b") + 1).cast("long").alias("end0"), "n", "ref_bases", "qry_bases")


def consequence(before: Column, after: Column) -> Column:
    """What a change does to a coding sequence: by its length first, then start, stop and amino acids."""
    p, q = translate_codons(before), translate_codons(after)
    shift = F.length(after) - F.length(before)
    stop = lambda t: F.instr(t, "*")
    return (
        F.when(before == after, "none").when(shift % 3 != 0, "frameshift").when(shift > 0, "inframe_insertion").when(shift < 0, "inframe_deletion")
        .when((F.left(p, F.lit(1)) == "M") & (F.left(q, F.lit(1)) != "M"), "start_lost")
        .when((stop(q) > 0) & ((stop(p) == 0) | (stop(q) < stop(p))), "nonsense").when((stop(p) > 0) & ((stop(q) == 0) | (stop(q) > stop(p))), "stop_lost")
        .when(p == q, "synonymous").otherwise("missense")
    )


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text, as a long."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619) % F.lit(4294967296))


def best_rotation(a: str, b: str) -> int:
    """The rotation of a, the smallest if several are equal, that agrees with b at the most places; one correlation a letter."""
    x, y = _letters(a), _letters(b)
    agree = np.zeros(len(x))
    for c in np.unique(x):
        agree += np.fft.irfft(np.fft.rfft(x == c) * np.conj(np.fft.rfft(y == c)), len(x))
    return int(np.argmax(np.rint(agree)))


def _kmers(texts: list[np.ndarray], k: int) -> list[np.ndarray]:
    """A number for the k-mer at each place of circular texts, the same for the same k-mer in any of them."""
    letters, codes = np.unique(np.concatenate(texts), return_inverse=True)
    cuts = np.cumsum([len(x) for x in texts])[:-1]
    first, kinds = [x.astype(np.int64) for x in np.split(codes, cuts)], len(letters)
    out, most = first, kinds
    for step in range(1, k):
        if most * kinds >= 1 << 62:
            seen, codes = np.unique(np.concatenate(out), return_inverse=True)
            out, most = np.split(codes.astype(np.int64), cuts), len(seen)
        out, most = [x * kinds + np.roll(y, -step) for x, y in zip(out, first, strict=True)], most * kinds
    return out


def voted_rotation(a: str, b: str, k: int = 21) -> tuple[int, int] | None:
    """(rotation, votes) of circular b on circular a by the k-mers that a has once, the smallest rotation of those with most votes; None
    if there is no vote."""
    if len(a) < k or len(b) < k:
        return None
    x, y = _kmers([_letters(a), _letters(b)], k)
    once, at, count = np.unique(x, return_index=True, return_counts=True)
    once, at = once[count == 1], at[count == 1]
    if not len(once):
        return None
    place = np.minimum(np.searchsorted(once, y), len(once) - 1)
    hit = np.flatnonzero(once[place] == y)
    if not len(hit):
        return None
    votes = np.bincount((at[place[hit]] - hit) % len(a))
    best = int(votes.argmax())
    return best, int(votes[best])


def rotations(pairs: DataFrame, k: int = 21, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, rotation, votes) and the columns of pairs that keep names: where circular query begins on circular reference; null votes
    where it is the same but for that.

    pairs (doc_id, reference, query). Else k-mers vote that the reference has once, and the rotation with most votes wins, then the
    smallest. A pair without such k-mers (short ones, repeats) gets the rotation at which most places agree, if it has one length, else
    null. A pair is a row from begin to end: its k-mers are numbers in its task, and nothing is shuffled.
    """
    kinds = dict(pairs.dtypes)
    at = F.when(F.length("reference") == F.length("query"), F.expr("instr(concat(reference, reference), query)")).otherwise(0)

    def place(r: str | None, q: str | None, at: int | None) -> tuple[int | None, int | None]:
        if at:
            return at - 1, None
        if r is None or q is None:
            return None, None
        voted = voted_rotation(r, q, k)
        return voted or (best_rotation(r, q) if q and len(r) == len(q) else None, None)

    def run(batches):
        for b in batches:
            got = [place(*(b.column(c)[i].as_py() for c in (1, 2, 3))) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[c] for g in got], pa.int64()) for c in (0, 1)), *(b.column(c) for c in range(4, b.num_columns))], names=["doc_id", "rotation", "votes", *keep])

    kept = [F.col(c).alias(f"__{c}") for c in keep]
    schema = f"doc_id {kinds['doc_id']}, rotation bigint, votes bigint" + "".join(f", {c} {kinds[c]}" for c in keep)
    return pairs.select("doc_id", "reference", "query", at.cast("long").alias("at"), *kept).mapInArrow(run, schema)


def summary(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_differences, edit_distance, identity_percent) of every pair; gaps count in the aligned length."""
    size = F.greatest(F.length("ref_bases"), F.length("qry_bases"))
    d = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum(size).alias("e"), F.sum(F.length("qry_bases") - F.length("ref_bases") + F.greatest(F.length("ref_bases") - F.length("qry_bases"), F.lit(0))).alias("gaps"))
    j = pairs.select("doc_id", F.length("reference").alias("n")).join(d, "doc_id", "left")
    e, aligned = F.coalesce("e", F.lit(0)), F.col("n") + F.coalesce("gaps", F.lit(0))
    return j.select("doc_id", F.coalesce("k", F.lit(0)).alias("n_differences"), e.alias("edit_distance"), ((aligned - e) * 100.0 / aligned).alias("identity_percent"))
