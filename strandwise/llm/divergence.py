"""Source divergence audit: how the words of each source of a language differ from the other sources' and from the language's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, salted_join

#: Terms are kept if this many documents of a language have them; parts of a whole that a probability is counted in; ranks of terms.
MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Bytes of text tokenized at a time, entries of a block of terms, sources of a block of sources.
BUFFER, ENTRIES, SOURCES = 4 << 20, 1 << 17, 256

#: Byte classes: letters and all that isn't ASCII make terms; A-Z are lower-cased.
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in a buffer, by a look-up of each byte."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], _TERM[buffer], [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def grouped(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(number of each slice's term, a slice of each term): slices meet by hash, and their bytes are compared.

    A slice that differs from the first of its hash gets a number by its bytes.
    """
    data = buffer.tobytes()
    hashes = np.fromiter(map(hasher, map(data.__getitem__, map(slice, starts.tolist(), ends.tolist()))), np.uint64, len(starts))
    _, first, numbers = np.unique(hashes, return_index=True, return_inverse=True)
    if not len(starts):
        return numbers, first
    size, like = ends - starts, first[numbers]
    same = size == size[like]
    k = np.flatnonzero(same)
    before = np.cumsum(size[k]) - size[k]
    step = np.arange(int(size[k].sum())) - np.repeat(before, size[k])
    equal = buffer[np.repeat(starts[k], size[k]) + step] == buffer[np.repeat(starts[like[k]], size[k]) + step]
    same[k] = np.logical_and.reduceat(equal, before)
    known: dict[bytes, int] = {}
    extra = []
    for i in np.flatnonzero(~same).tolist():
        term = data[starts[i] : ends[i]]
        if term not in known:
            known[term] = len(first) + len(extra)
            extra.append(i)
        numbers[i] = known[term]
    return numbers, np.concatenate([first, np.array(extra, first.dtype)])


def _counted(bodies: list[bytes], groups: list[int]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of a few texts, which a byte that is no term's parts in the buffer."""
    buffer = _LOWER[np.frombuffer(b"\0".join(bodies), np.uint8)]
    starts, ends = slices(buffer)
    numbers, first = grouped(buffer, starts, ends)
    sizes = np.array([len(b) + 1 for b in bodies])
    doc, n = np.searchsorted(np.cumsum(sizes), starts, "right"), max(len(first), 1)
    cells, times = np.unique(doc * n + numbers, return_counts=True)
    held, of = np.unique(np.array(groups)[cells // n] * n + cells % n, return_inverse=True)
    total, docs = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
    np.add.at(total, of, times)
    np.add.at(docs, of, 1)
    data = buffer.tobytes()
    return held // n, [data[starts[i] : ends[i]] for i in first[held % n].tolist()], total, docs


def _one_long(body: bytes) -> tuple[list[bytes], np.ndarray]:
    """(term, occurrences) of one text, cut where no term is."""
    total: dict[bytes, int] = {}
    at = 0
    while at < len(body):
        end, window = at + BUFFER, 1 << 12
        while end < len(body):
            outside = np.flatnonzero(~_TERM[np.frombuffer(body[end : end + window], np.uint8)])
            if len(outside):
                end += int(outside[0])
                break
            end, window = end + window, 2 * window
        _, terms, times, _ = _counted([body[at:end]], [0])
        for t, k in zip(terms, times.tolist(), strict=True):
            total[t] = total.get(t, 0) + k
        at = end
    return list(total), np.array(list(total.values()), np.int64)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs) with the terms (binary, lower-cased) of whole texts: occurrences, and documents that have them.

    Texts are counted buffer by buffer in their tasks; only counts meet in the shuffle.
    """

    def emit(names, g, terms, n, docs):
        lang, source = zip(*(names[i] for i in g), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(terms, pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        for b in batches:
            names, bodies, groups, size = [], [], [], 0
            number: dict[tuple[str, str], int] = {}
            lang, source, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())
            for k in range(b.num_rows):
                body = texts[k].as_py() or b""
                name = (lang[k], source[k])
                if len(body) > BUFFER:
                    terms, n = _one_long(body)
                    if terms:
                        yield emit([name], [0] * len(terms), terms, n, np.ones(len(terms), np.int64))
                elif body:
                    if name not in number:
                        number[name] = len(names)
                        names.append(name)
                    bodies.append(body)
                    groups.append(number[name])
                    size += len(body)
                if bodies and (size > BUFFER or k == b.num_rows - 1):
                    g, terms, n, held = _counted(bodies, groups)
                    if terms:
                        yield emit(names, g.tolist(), terms, n, held)
                    bodies, groups, size = [], [], 0

    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    d = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    parts = d.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / total), exact for any counts."""
    wide = lambda c: c.cast("decimal(19,0)")
    small = n < (1 << 62) // scale
    return 1 + F.when(small, _div(F.lit(scale) * F.when(small, n + 1), total)).otherwise(_div(F.lit(scale).cast("decimal(10,0)") * wide(n + 1), wide(total)))


def _f(p, q):
    return (p - q) * (p - q) // q


def pair_sums(t: pa.Table, a_block: int, b_block: int, sources: int) -> dict[str, list]:
    """Sums over the terms of a table that one of two sources has, for the sources of block a against those of block b.

    Rows without a term give each source's probability of a term it doesn't have; the others are the entries of a sparse matrix,
    sources by terms.
    """
    known = t["term"].combine_chunks()
    base = t.filter(pc.is_null(known)).sort_by("sid")
    sid, p0, names = base["sid"].to_numpy(), base["p"].to_numpy(), base["source"].to_pylist()
    e = t.filter(pc.is_valid(known))
    coded = e["term"].combine_chunks().dictionary_encode()
    col, row, p = coded.indices.to_numpy(), np.searchsorted(sid, e["sid"].to_numpy()), e["p"].to_numpy()
    order = np.argsort(row, kind="stable")
    col, row, p = col[order], row[order], p[order]
    ends = np.searchsorted(row, np.arange(len(sid) + 1))
    a_rows, b_rows = np.flatnonzero(sid // sources == a_block), np.flatnonzero(sid // sources == b_block)
    lo, hi = ends[a_rows[0]], ends[a_rows[-1] + 1]
    size = np.diff(ends)[a_rows]
    full = np.flatnonzero(size)
    heads, pa_, ca, ba = ends[a_rows[full]] - lo, p[lo:hi], col[lo:hi], p0[row[lo:hi]]
    out: dict[str, list] = {"source": [], "item": [], "base": [], "value": [], "either": []}
    for b in b_rows.tolist():
        own = slice(ends[b], ends[b + 1])
        q, has = np.full(len(coded.dictionary), p0[b]), np.zeros(len(coded.dictionary), bool)
        q[col[own]], has[col[own]] = p[own], True
        value, common = np.zeros(len(a_rows), np.int64), np.zeros(len(a_rows), np.int64)
        if len(full):
            qa, both = q[ca], has[ca]
            # terms of a, less what the next sum counts again for the terms of both
            value[full] = np.add.reduceat(_f(pa_, qa) - np.where(both, _f(ba, qa), 0), heads)
            common[full] = np.add.reduceat(both.astype(np.int64), heads)
        distinct, times = np.unique(p[own], return_counts=True)
        for at in range(0, len(distinct), 1 << 12):
            value += (_f(p0[a_rows][:, None], distinct[None, at : at + (1 << 12)]) * times[at : at + (1 << 12)]).sum(1)
        either = size + (own.stop - own.start) - common
        for i, a in enumerate(a_rows.tolist()):
            if a != b:
                for name, x in (("source", names[a]), ("item", names[b]), ("base", int(_f(p0[a], p0[b]))), ("value", int(value[i])), ("either", int(either[i]))):
                    out[name].append(x)
    return out


def divergences(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each source of a language against the others ("pair") and its own terms ("term").

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a language keeps the V terms that at least min_docs of
    its documents have. A group with count occurrences of a term and N of all kept terms gives it p = 1 + floor(scale * (count + 1) /
    (N + V)); f(p, q) = floor((p - q)^2 / q). A pair's value is the sum of f over all kept terms, those of neither source included. A
    term's value is f against the whole language, for terms that the source has more of; the `top` first are returned.

    Null language, source and text are ''. Every row is a document, repeated ones too; ids aren't looked at and other columns can't
    clash. Sources without kept terms have pairs; a language with one source has none. Values are exact, as long as (scale + V)^2 fits
    a long. An empty table gives no rows. Counts are written to the shared folder.

    Terms of a language are dealt to blocks of about 2^17 counts, sources to blocks of 256: a task holds one block of terms for two
    blocks of sources, however many a language has.
    """
    scratch = Scratch(docs.sparkSession)
    counts = term_counts(docs, lang_col, source_col, text_col)
    w = W.partitionBy("lang", "term")
    # one row a source that has the term: the language's counts come from at most as many rows as it has sources
    counts = counts.withColumn("held", F.sum("docs").over(w)).withColumn("lang_n", F.sum("n").over(w)).withColumn("one", F.min("source").over(w) == F.col("source"))
    kept, _ = scratch.keep(counts.filter(F.col("held") >= min_docs).select(F.struct("lang", "source").alias("g"), "term", "n", "lang_n", "one"))
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    groups = docs.select(F.struct(text(lang_col).alias("lang"), text(source_col).alias("source")).alias("g")).distinct()
    own = kept.groupBy("g").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"), F.count_if("one").alias("ones"))
    every, none = W.partitionBy("g.lang"), F.lit(0).cast("bigint")
    totals = groups.join(own, "g", "left").select("g", *[F.coalesce(c, none).alias(c) for c in ("total", "terms", "ones")])
    # a language's sources stand in one group here, once each; its result has a row for each two of them
    totals = totals.select("g", "terms", F.sum("ones").over(every).alias("v"), F.sum("total").over(every).alias("lang_total"), "total",
                           F.greatest(F.ceil(F.sum("terms").over(every) / ENTRIES), F.lit(1)).alias("blocks"),
                           (F.row_number().over(every.orderBy("g.source")) - 1).cast("long").alias("sid"), F.count(F.lit(1)).over(every).alias("sources"))
    totals, _ = scratch.keep(totals)
    e = salted_join(kept, totals.filter("terms > 0"), "g", "terms", F.col("term"))
    e = e.select("g.lang", "g.source", "term", share(F.col("n"), F.col("total") + F.col("v"), scale).alias("p"), share(F.col("lang_n"), F.col("lang_total") + F.col("v"), scale).alias("q"), "sid", "sources", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
    first = W.partitionBy("lang", "source")
    d = F.col("p") - F.col("q")
    terms = e.filter("p > q").select("lang", "source", F.col("term").alias("item"), _div(d * d, F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(first.orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)
    base = totals.select("g.lang", "g.source", F.lit(None).cast("binary").alias("term"), F.when(F.col("v") > 0, share(none, F.col("total") + F.col("v"), scale)).otherwise(1).alias("p"), "sid", "sources", F.explode(F.sequence(none, F.col("blocks") - 1)).alias("block"))
    cells = e.select(*base.columns).unionByName(base).filter("sources > 1")
    mine, last = F.floor(F.col("sid") / SOURCES), F.floor((F.col("sources") - 1) / SOURCES)
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    roles = F.array_union(F.transform(F.sequence(none, last), lambda y: pair(mine, y)), F.transform(F.sequence(none, last), lambda y: pair(y, mine)))
    cells = cells.select("lang", "source", "term", "p", "sid", "block", F.explode(roles).alias("r")).select("*", "r.a", "r.b").drop("r")

    def run(key, t):
        out = pair_sums(t, key[2].as_py(), key[3].as_py(), SOURCES)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        cols = {k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)}
        return pa.table({"lang": pa.array([key[0].as_py()] * len(out["source"]), pa.string()), **cols})

    sums = cells.groupBy("lang", "block", "a", "b").applyInArrow(run, "lang string, source string, item string, base bigint, value bigint, either bigint")
    v = totals.groupBy("g.lang").agg(F.max("v").alias("v"))
    sums = sums.groupBy("lang", "source", "item").agg(F.max("base").alias("base"), F.sum("value").alias("value"), F.sum("either").alias("either")).join(v, "lang")
    pairs = sums.select("lang", "source", "item", (F.col("value") + (F.col("v") - F.col("either")) * F.col("base")).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(first.orderBy(F.desc("value"), "item")))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), F.col("item").cast("string").alias("item"), "value", "rank")
    return part(pairs, "pair").unionByName(part(terms, "term"))


def op11_source_divergence(spark, sf_dir):
    from .common import table

    return divergences(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gt AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY ALL),
p AS (
  SELECT gt.lang, gt.source, k.term, coalesce(n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1) // (total + v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (lang_n + 1) // (lang_total + v) AS q
  FROM gt JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term
), x AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
u AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 200
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM u
"""
