"""Global alignment of whole molecules, and re-alignment of neighbouring differences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MATCH, MISMATCH, GAP = 2, -1, -2
#: Directions that are kept at a time, one byte a cell; a larger alignment is divided.
CELLS = 1 << 25
_NEVER = np.int32(-(1 << 29))
#: Steps of an alignment: both go on, only the reference, only the query.
BOTH, UP, LEFT = 0, 1, 2


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class _Band:
    """Rows of the score table between two diagonals lo <= column - row <= hi, outside of which nothing is reached."""

    def __init__(self, a: np.ndarray, b: np.ndarray, lo: int, hi: int):
        self.a, self.b, self.lo, self.hi = a, b, max(lo, -len(a)), min(hi, len(b))
        self.slope = np.arange(len(b) + 1, dtype=np.int32) * GAP
        letters, self.letter = np.unique(a, return_inverse=True)
        self.gain = [np.where(b == c, np.int32(MATCH), np.int32(MISMATCH)) for c in letters]

    def cells(self) -> int:
        return (len(self.a) + 1) * (self.hi - self.lo + 1)

    def last_row(self, directions: np.ndarray | None = None) -> np.ndarray:
        """The scores of the last row; directions (rows by diagonals) are filled in if given."""
        m = len(self.b)
        old, new = np.full(m + 2, _NEVER, np.int32), np.full(m + 2, _NEVER, np.int32)
        first = min(m, self.hi)
        old[: first + 1] = self.slope[: first + 1]
        if directions is not None:
            directions[0] = LEFT
        for i in range(1, len(self.a) + 1):
            l, h = max(0, i + self.lo), min(m, i + self.hi)
            s, w = max(l, 1), h + 1
            up = old[l:w] + np.int32(GAP)
            best = up.copy()
            both = old[s - 1 : h] + self.gain[self.letter[i - 1]][s - 1 : h]
            np.maximum(best[s - l :], both, out=best[s - l :])
            slope = self.slope[l:w]
            new[l:w] = np.maximum.accumulate(best - slope) + slope
            if w <= m:
                new[w] = _NEVER
            if directions is not None:
                row = np.where(new[l:w] == up, np.uint8(UP), np.uint8(LEFT))
                row[s - l :][new[s:w] == both] = BOTH
                directions[i, l - i - self.lo : w - i - self.lo] = row
            old, new = new, old
            if l > 0:
                # the next row may look one place to the left of this one's begin, where an older row still stands
                old[l - 1] = _NEVER
        return old[: m + 1]

    def walk(self) -> tuple[np.ndarray, int, int]:
        """The steps of the best way from the last corner to the first row or column, and where it meets it; of equal ones both before
        up before left, seen from the end."""
        i, j, steps = len(self.a), len(self.b), []
        if i and j:
            directions = np.zeros((len(self.a) + 1, self.hi - self.lo + 1), np.uint8)
            self.last_row(directions)
        while i and j:
            d = int(directions[i, j - i - self.lo])
            steps.append(d)
            i, j = i - (d != LEFT), j - (d != UP)
        return np.array(steps[::-1], np.uint8), i, j


def _band(a: np.ndarray, b: np.ndarray) -> tuple[_Band, int]:
    """A band that all best alignments stay in, and their score.

    A way that leaves a band has at least g gaps, thus a score of at most n + m - 3 g; the band grows until its own score is larger.
    """
    n, m, w = len(a), len(b), 64
    if not (n and m):
        return _Band(a, b, -n, m), GAP * (n + m)
    while True:
        band = _Band(a, b, min(0, m - n) - w, max(0, m - n) + w)
        score = int(band.last_row()[m])
        if score > n + m - 3 * (abs(m - n) + 2 * (w + 1)) or w > max(n, m):
            return band, score
        w *= 4


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """How many bases both begin with."""
    n = min(len(x), len(y))
    differ = x[:n] != y[:n]
    return int(differ.argmax()) if differ.any() else n


def score(a: str, b: str) -> int:
    """The best score of a global alignment, of texts of any length. Equal bases at either end are matched in some best one."""
    x, y = _codes(a), _codes(b)
    head = _same(x, y)
    x, y = x[head:], y[head:]
    tail = _same(x[::-1], y[::-1])
    return MATCH * (head + tail) + _band(x[: len(x) - tail], y[: len(y) - tail])[1]


def _divided(a: np.ndarray, b: np.ndarray, lo: int, hi: int, cells: int) -> list[np.ndarray]:
    """Steps through a band; one with more cells than are kept is divided where two half passes meet best."""
    band = _Band(a, b, lo, hi)
    if band.cells() <= cells or len(a) < 2:
        way, i, j = band.walk()
        return [np.full(i, UP, np.uint8), np.full(j, LEFT, np.uint8), way]
    n, m, half = len(a), len(b), len(a) // 2
    head = _Band(a[:half], b, lo, hi).last_row()
    tail = _Band(a[half:][::-1], b[::-1], m - n - hi, m - n - lo).last_row()[::-1]
    j = int(np.argmax(head.astype(np.int64) + tail))
    return [*_divided(a[:half], b[:j], lo, hi, cells), *_divided(a[half:], b[j:], lo - (j - half), hi - (j - half), cells)]


def _through_head(x: np.ndarray, y: np.ndarray, i: int, j: int) -> list[np.ndarray]:
    """The steps from a cell whose shorter side lies in what both begin with. There the best way has gaps only for the difference in
    length, so equal bases are always taken, and before unequal ones the longer side has a gap."""
    way = []
    while i != j and i and j:
        # equal bases, looked at in growing steps
        run, step = 0, 64
        while True:
            w = min(i, j, run + step)
            unequal = np.flatnonzero(x[i - w : i - run][::-1] != y[j - w : j - run][::-1])
            if len(unequal):
                run += int(unequal[0])
                break
            run, step = w, 4 * step
            if w == min(i, j):
                break
        way.append(np.full(run, BOTH, np.uint8))
        i, j = i - run, j - run
        if i and j:
            way.append(np.array([UP if i > j else LEFT], np.uint8))
            i, j = i - (i > j), j - (j > i)
    rest = [np.full(i, BOTH, np.uint8)] if i == j else [np.full(i, UP, np.uint8), np.full(j, LEFT, np.uint8)]
    return [*rest, *way[::-1]]


def steps(a: str, b: str, cells: int = CELLS) -> tuple[np.ndarray, int]:
    """The steps of a best global alignment, and its score.

    Seen from the end, both bases are taken before a gap: thus all that both end with. A table is made only of what lies between the
    bases that both begin and end with; a way that leaves it goes on through the common head, whose scores are known.
    """
    x, y = _codes(a), _codes(b)
    tail = _same(x[::-1], y[::-1])
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    head = _same(x, y)
    u, v = x[head:], y[head:]
    band, best = _band(u, v)
    if band.cells() <= cells or len(u) < 2:
        way, i, j = band.walk()
        ways = [*_through_head(x, y, head + i, head + j), way]
    else:
        ways = [np.full(head, BOTH, np.uint8), *_divided(u, v, band.lo, band.hi, cells)]
    return np.concatenate([*ways, np.full(tail, BOTH, np.uint8)]), best + MATCH * (head + tail)


def aligned(a: str, b: str, way: np.ndarray) -> tuple[str, str, int]:
    """Both texts with a dash for each gap, and the number of equal columns."""
    x, y = np.full(len(way), ord("-"), np.uint32), np.full(len(way), ord("-"), np.uint32)
    x[way != LEFT], y[way != UP] = _codes(a), _codes(b)
    text = lambda t: t.tobytes().decode("utf-32-le")
    return text(x), text(y), int(((x == y) & (way == BOTH)).sum())


def alignments(pairs: DataFrame, cells: int = CELLS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, aligned_reference, aligned_query, matches, score, identity_percent) of pairs (doc_id, reference, query), and what of
    the pairs' own columns keep names.

    A match scores 2, a mismatch -1, a gap -2 a base. Of several best alignments the one that, seen from the end, takes both bases
    before a gap in the query before one in the reference; texts of more than `cells` cells in their band (33 million) are divided
    where two half passes meet, which finds an alignment of the same score. Memory grows with the length alone. Null counts as empty.
    """
    kinds = dict(pairs.dtypes)
    names = ["doc_id", "aligned_reference", "aligned_query", "matches", "score", "identity_percent"]
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())

    def run(batches):
        for b in batches:
            rows, size, first = [], 0, 0
            for k in range(b.num_rows):
                r, q = (b.column(c)[k].as_py() or "" for c in (1, 2))
                way, best = steps(r, q, cells)
                x, y, same = aligned(r, q, way)
                rows.append((x, y, same, best, 100.0 * same / max(len(way), 1)))
                size += len(x) + len(y)
                if size > 1 << 22 or k + 1 == b.num_rows:
                    made = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows)), *made, *(b.column(c).slice(first, len(rows)) for c in range(3, b.num_columns))], names=names + list(keep))
                    rows, size, first = [], 0, k + 1

    schema = f"doc_id {kinds['doc_id']}, aligned_reference string, aligned_query string, matches bigint, score bigint, identity_percent double"
    kept = [F.col(c).alias(f"__{c}") for c in keep]
    return pairs.select("doc_id", "reference", "query", *kept).mapInArrow(run, schema + "".join(f", {c} {kinds[c]}" for c in keep))


def _least_edits(xs: list[np.ndarray], ys: list[np.ndarray]) -> list[np.ndarray]:
    """Steps of a shortest edit script of each pair of texts, substitutions before deletions before insertions seen from the end;
    all pairs go on by a row at once."""
    g, rows, cols = len(xs), max(map(len, xs)), max(map(len, ys))
    x, y = np.zeros((g, rows), np.uint32), np.full((g, cols), 1, np.uint32)
    for k in range(g):
        x[k, : len(xs[k])], y[k, : len(ys[k])] = xs[k], ys[k]
    place = np.arange(cols + 1, dtype=np.int32)
    old, directions = np.broadcast_to(place, (g, cols + 1)), np.full((rows + 1, g, cols + 1), LEFT, np.uint8)
    for r in range(1, rows + 1):
        both, up = old[:, :-1] + (x[:, r - 1 : r] != y), old[:, 1:] + 1
        best = np.concatenate([np.full((g, 1), r, np.int32), np.minimum(both, up)], 1)
        new = np.minimum.accumulate(best - place, 1) + place
        directions[r, :, 0] = UP
        directions[r, :, 1:] = np.where(new[:, 1:] == both, BOTH, np.where(new[:, 1:] == up, UP, LEFT))
        old = new
    i, j, every, way = np.array([len(t) for t in xs]), np.array([len(t) for t in ys]), np.arange(g), []
    while (live := (i > 0) | (j > 0)).any():
        d = np.where(live, directions[i, every, j], 3)
        way.append(d)
        i, j = i - ((d == BOTH) | (d == UP)), j - ((d == BOTH) | (d == LEFT))
    way = np.array(way[::-1], np.uint8).reshape(-1, g)
    return [way[way[:, k] != 3, k] for k in range(g)]


def runs(x: np.ndarray, y: np.ndarray, way: np.ndarray) -> list[tuple[str, int, int, int, int]]:
    """(kind, start in x, end in x, start in y, end in y) of the runs of differing columns of one kind."""
    i, j = np.cumsum(way != LEFT) - (way != LEFT), np.cumsum(way != UP) - (way != UP)
    kind = way.astype(np.int8) + 1
    both = np.flatnonzero(way == BOTH)
    kind[both[x[i[both]] == y[j[both]]]] = 0
    edges = np.flatnonzero(np.diff(kind, prepend=-1))
    ends = np.append(edges[1:], len(kind))
    names = {1: "substitution", 2: "deletion", 3: "insertion"}
    after = lambda p, k, moved: int(p[k - 1] + moved[k - 1])
    return [(names[int(kind[a])], int(i[a]), after(i, b, way != LEFT), int(j[a]), after(j, b, way != UP)) for a, b in zip(edges, ends, strict=True) if kind[a]]


def regrouped(script: list[tuple[str, int, int, str, str]], gap: int, most: int) -> tuple[list[tuple[str, int, int, str, str]], list[tuple[int, int, int, int]]]:
    """The differences of an ordered script that stay as they are, and of the groups to be aligned anew begin and end in both texts."""
    stay, new, at = [], [], 0
    while at < len(script):
        till = at + 1
        while till < len(script) and script[till][1] - script[till - 1][1] - len(script[till - 1][3]) <= gap:
            till += 1
        group = script[at:till]
        ra, rb, qa, qb = group[0][1], max(x[1] + len(x[3]) for x in group), min(x[2] for x in group), max(x[2] + len(x[4]) for x in group)
        if rb == ra or qb == qa or (rb - ra == 1 and qb - qa == 1) or (rb - ra) * (qb - qa) > most:
            stay += group
        else:
            new.append((ra, rb, qa, qb))
        at = till
    return stay, new


def aligned_groups(todo: list[tuple[int, int, int, str, str]], cells: int) -> list[tuple[int, str, int, int, str, str]]:
    """(owner, kind, start in reference, start in query, bases of both) of groups (owner, begin in reference, begin in query, texts)."""
    # like sizes go together, so that little is padded
    todo = sorted(todo, key=lambda t: (len(t[3]), len(t[4])))
    rows, at = [], 0
    while at < len(todo):
        till, wide = at, 0
        while till < len(todo):
            wide = max(wide, len(todo[till][4]) + 1)
            if till > at and (till + 1 - at) * (len(todo[till][3]) + 1) * wide > cells:
                break
            till += 1
        xs, ys = ([_codes(t[c]) for t in todo[at:till]] for c in (3, 4))
        for (k, ra, qa, rt, qt), x, y, way in zip(todo[at:till], xs, ys, _least_edits(xs, ys), strict=True):
            rows += [(k, name, ra + i, qa + j, rt[i:i1], qt[j:j1]) for name, i, i1, j, j1 in runs(x, y, way)]
        at = till
    return rows


def realigned(pairs: DataFrame, found: DataFrame, gap: int = 12, most: int = 65_536, cells: int = 1 << 22) -> DataFrame:
    """Differences (doc_id, kind, ref_start0, qry_start0, ref_bases, qry_bases) of pairs (doc_id, reference, query), those with at most
    `gap` equal bases between them aligned anew together, by the fewest edits.

    A shortest script of deletions and insertions may show a changed base between equal ones as a deletion and an insertion around
    a repeat; together they are a substitution again. Of several shortest ways the one that, seen from the end, takes both bases before
    a deletion before an insertion. Groups of more than `most` cells stay as they are, and so do those of one base or with bases on
    one side only. Differences find their neighbours by a window; a sequence moves once, to the groups of its pair.
    """
    order = W.partitionBy("doc_id").orderBy("ref_start0", "qry_start0")
    end = F.col("ref_start0") + F.length("ref_bases")
    d = found.withColumn("first", F.coalesce(F.col("ref_start0") - F.lag(end).over(order) > gap, F.lit(True)).cast("int"))
    d = d.withColumn("group", F.sum("first").over(order))
    g = d.groupBy("doc_id", "group").agg(F.min("ref_start0").alias("ra"), F.max(end).alias("rb"), F.min("qry_start0").alias("qa"), F.max(F.col("qry_start0") + F.length("qry_bases")).alias("qb"))
    alone = (F.col("rb") == F.col("ra")) | (F.col("qb") == F.col("qa")) | ((F.col("rb") - F.col("ra") == 1) & (F.col("qb") - F.col("qa") == 1))
    g = g.withColumn("same", alone | ((F.col("rb") - F.col("ra")) * (F.col("qb") - F.col("qa")) > most))
    stay = d.join(g.filter("same").select("doc_id", "group"), ["doc_id", "group"], "left_semi").select(found.columns)
    new = g.filter("not same").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ra", "rb", "qa", "qb"))).alias("groups")).join(pairs.select("doc_id", "reference", "query"), "doc_id")
    kind = pairs.select("doc_id").dtypes[0][1]
    names = ["doc_id", "kind", "ref_start0", "qry_start0", "ref_bases", "qry_bases"]

    def run(batches):
        for b in batches:
            todo = []
            for k, (groups, r, q) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                todo += [(k, x["ra"], x["qa"], r[x["ra"] : x["rb"]], q[x["qa"] : x["qb"]]) for x in groups]
            rows = aligned_groups(todo, cells)
            if rows:
                owner, *cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=names)

    made = new.select("doc_id", "groups", "reference", "query").mapInArrow(run, f"doc_id {kind}, kind string, ref_start0 bigint, qry_start0 bigint, ref_bases string, qry_bases string")
    return stay.select(names).unionByName(made)


def replaced(reference: Column, ds: Column) -> Column:
    """reference with the bases of an ordered list of differences (ref_start0, n: bases of the reference, qry_bases) in place of its own."""
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(ds, lambda x: x["ref_start0"] + x["n"]))
    pieces = F.zip_with(ds, F.slice(begins, F.lit(1), F.size(ds)), lambda x, b: F.concat(F.substr(reference, (b + 1).cast("int"), (x["ref_start0"] - b).cast("int")), x["qry_bases"]))
    return F.concat(F.array_join(pieces, ""), F.substr(reference, (F.element_at(begins, -1) + 1).cast("int")))


def rebuilt(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, query) from the references of pairs and the differences found: each one's query bases in place of the reference's."""
    d = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ref_start0", "qry_start0", F.length("ref_bases").cast("long").alias("n"), "qry_bases"))).alias("ds"))
    j = pairs.select("doc_id", "reference").join(d, "doc_id", "left").withColumn("ds", F.coalesce("ds", F.expr("array()").cast(dict(d.dtypes)["ds"])))
    return j.select("doc_id", replaced(F.col("reference"), F.col("ds")).alias("query"))


def rebuilt_pairs(found: DataFrame) -> DataFrame:
    """rebuilt of rows (doc_id, reference, differences) that hold their own differences in order."""
    ds = F.transform("differences", lambda x: F.struct(x["ref_start0"].alias("ref_start0"), F.length(x["ref_bases"]).cast("long").alias("n"), x["qry_bases"].alias("qry_bases")))
    return found.withColumn("query", replaced(F.col("reference"), ds))
