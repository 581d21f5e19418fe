"""Benchmark decontamination: document words inside a window of benchmark words, found by a broadcast set of window hashes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, salted_join

#: Words a window, and the largest benchmark (bytes of text) whose windows are broadcast; a larger one is joined.
WIDTH, MAX_BYTES = 10, 8 << 20
#: Words once A-Z are lower-cased: digits, letters and all that isn't ASCII. Bytes of a text that are cut into words at a time.
WORD, PIECE = re.compile(rb"[0-9a-z\x80-\xff]+"), 1 << 20
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that a task gathers before it hands them on.
_OUT = 8 << 20
_SPANS = "array<struct<first:bigint,last:bigint>>"


def pieces(body: bytes, size: int = PIECE):
    """(offset, part) of a text, cut only where no word is."""
    start = 0
    while len(body) - start > size:
        m = _GAP.search(body, start + size)
        if not m:
            break
        yield start, body[start : m.start()]
        start = m.start()
    yield start, body[start:]


def words(body: bytes) -> list[bytes]:
    return WORD.findall(body.lower())


def window_hashes(x: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the `width` word numbers from each place of at; equal windows have equal hashes."""
    h = np.zeros(len(at), np.uint64)
    for j in range(width):
        h = (h + x[at + j].astype(np.uint64) + np.uint64(1)) * _FACTOR
        h ^= h >> np.uint64(29)
    return h


class WindowSet:
    """The distinct windows of a benchmark by width, in the order of their hashes, with their words and the items that hold them."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items if i is not None})
        number, found = {i: k for k, i in enumerate(self.items)}, {}
        for item, body in items:
            x = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(body)], np.int32)
            if len(x):
                k = min(width, len(x))
                rows = np.lib.stride_tricks.sliding_window_view(x, k)
                found.setdefault(k, []).append((rows, np.full(len(rows), -1 if item is None else number[item], np.int32)))
        self.by_width = {}
        for k, parts in sorted(found.items()):
            rows, inverse = np.unique(np.concatenate([r for r, _ in parts]), axis=0, return_inverse=True)
            h = window_hashes(rows.ravel(), np.arange(len(rows)) * k, k)
            order = np.argsort(h, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            # one row a window and item that holds it
            held = np.unique(np.stack([place[inverse.ravel()], np.concatenate([i for _, i in parts])], 1), axis=0)
            self.by_width[k] = (h[order], rows[order], np.searchsorted(held[:, 0], np.arange(len(order) + 1)), held[:, 1].astype(np.int32))

    def scan(self, body: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
        """(n_words, windows of hit words (place, width), items) of a whole text."""
        get = self.vocabulary.get
        x = np.concatenate([np.array([get(w, -1) for w in words(p)], np.int32) for _, p in pieces(body)])
        known, spans, items = np.concatenate([[0], np.cumsum(x >= 0)]), [], []
        for k, (hashes, rows, ends, held) in self.by_width.items():
            at = np.flatnonzero(known[k:] - known[:-k] == k) if len(x) >= k else np.zeros(0, np.int64)
            h = window_hashes(x, at, k)
            first = np.searchsorted(hashes, h)
            for step in range(len(hashes)):
                # windows of one hash stand side by side; each is compared word by word
                alive = np.flatnonzero(first + step < len(hashes))
                alive = alive[hashes[first[alive] + step] == h[alive]]
                if not len(alive):
                    break
                same = alive[(rows[first[alive] + step] == x[at[alive][:, None] + np.arange(k)]).all(1)]
                spans += [(int(i), k) for i in at[same]]
                items += [held[ends[g] : ends[g + 1]] for g in np.unique(first[same] + step)]
        own = np.unique(np.concatenate(items)) if items else np.zeros(0, np.int32)
        return len(x), spans, [self.items[i] for i in own if i >= 0]


def covered(n: int, spans) -> np.ndarray:
    """Which of n words lie in a window (place, width)."""
    edge = np.zeros(n + 1, np.int64)
    for i, k in spans:
        edge[i] += 1
        edge[i + k] -= 1
    return np.cumsum(edge[:n]) > 0


def char_spans(body: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as [first, last) in code points of the text."""
    if not hit.any():
        return []
    flips = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    starts, lasts = set(flips[::2].tolist()), set((flips[1::2] - 1).tolist())
    k, edges = 0, []
    for offset, part in pieces(body):
        for m in WORD.finditer(part.lower()):
            if k in starts:
                edges.append(offset + m.start())
            if k in lasts:
                edges.append(offset + m.end())
            k += 1
    before = np.concatenate([[0], np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)])
    at = before[edges].tolist()
    return list(zip(at[::2], at[1::2], strict=True))


def _cut(body: bytes, spans: list[tuple[int, int]]) -> str:
    text, out, at = body.decode("utf-8", "replace"), [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def _report(find, with_text: bool):
    """Arrow batches of (rest, body, ...) to (rest, n_words, n_hit, spans, items[, clean])."""

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string()), pa.string()]
    names = ["n_words", "n_hit", "spans", "items", "clean"][: 5 if with_text else 4]

    def run(batches):
        for b in batches:
            bodies, rows, first, size = b.column(1).cast(pa.binary()), [], 0, 0
            for k in range(b.num_rows):
                body = bodies[k].as_py() or b""
                n, windows, items = find(body, b, k)
                hit = covered(n, windows)
                spans = char_spans(body, hit)
                rows.append((n, int(hit.sum()), [{"first": x, "last": y} for x, y in spans], items, _cut(body, spans) if with_text else ""))
                size += len(body)
                # hand on what has gathered: a batch of long texts never stands in memory twice
                if size > _OUT or k == b.num_rows - 1:
                    cols = [pa.array(c, kind) for c, kind, _ in zip(zip(*rows, strict=True), kinds, names, strict=False)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(rows)), *cols], names=["rest", *names])
                    rows, first, size = [], k + 1, 0

    return run


def _counted(body: bytes) -> int:
    return sum(len(words(p)) for _, p in pieces(body))


def _windows(rows: DataFrame, width: int, short: bool) -> DataFrame:
    """(key, at, width, window) of rows (key, body, widths): every window of the widths; with `short`, the one of a shorter text too."""

    def run(batches):
        for b in batches:
            bodies, wanted = b.column(1).cast(pa.binary()), b.column(2)
            for k in range(b.num_rows):
                ws = [w for _, p in pieces(bodies[k].as_py() or b"") for w in words(p)]
                sizes = [min(width, len(ws))] if short else wanted[k].as_py()
                for n in sizes:
                    for first in range(0, len(ws) - n + 1 if n else 0, 1 << 14):
                        at = range(first, min(first + (1 << 14), len(ws) - n + 1))
                        key = pa.concat_arrays([b.column(0).slice(k, 1)] * len(at))
                        yield pa.RecordBatch.from_arrays([key, pa.array(at, pa.int64()), pa.array([n] * len(at), pa.int32()), pa.array([b" ".join(ws[i : i + n]) for i in at], pa.binary())], names=["key", "at", "width", "window"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "body", "widths").mapInArrow(run, f"key {kind}, at bigint, width int, window binary")


def _joined(rows: DataFrame, bench: DataFrame, width: int) -> DataFrame:
    """rows (rest, body, mark) with places (array of place and width) and items, from a join of windows by their words."""
    kept = bench.select(F.col("item").alias("key"), "body", F.lit(None).cast("array<int>").alias("widths"))
    wanted = _windows(kept, width, True).select("window", "width", F.col("key").alias("item")).distinct()
    # at most `width` different widths
    sizes = F.broadcast(wanted.agg(F.coalesce(F.collect_set("width"), F.expr("cast(array() as array<int>)")).alias("widths")))
    own = rows.select("mark", "body").dropDuplicates(["mark"]).crossJoin(sizes).select(F.col("mark").alias("key"), "body", "widths")
    have = _windows(own, width, False).select(F.col("key").alias("mark"), "at", "width", "window")
    # only windows that both sides have go on, with their number of places as the weight of a hot one
    both = have.groupBy("window").agg(F.count(F.lit(1)).alias("n")).join(wanted.select("window").distinct(), "window", "left_semi")
    hits = salted_join(have, both, "window", "n", F.struct("mark", "at"))
    places = hits.groupBy("mark").agg(F.collect_set(F.struct("at", "width")).alias("places"))
    held = wanted.filter("item is not null").join(hits.select("window", "mark").distinct(), "window")
    items = held.groupBy("mark").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return rows.join(places, "mark", "left").join(items, "mark", "left")


def _scan(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, width: int, most: int, with_text: bool) -> DataFrame:
    bench = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.encode(F.coalesce(F.col(f"`{item_text}`"), F.lit("")), "UTF-8").alias("body"))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(True).alias("__"))
    rows = docs.select(rest.alias("rest"), F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8").alias("body"))
    out = T.StructType([rows.schema["rest"], *T.StructType.fromDDL(f"n_words bigint, n_hit bigint, spans {_SPANS}, items array<string>" + (", clean string" if with_text else "")).fields])
    size = bench.agg(F.coalesce(F.sum(F.octet_length("body") + 32), F.lit(0)).alias("n")).first()["n"]
    if size <= most:
        # at most `most` bytes come to the driver
        held = docs.sparkSession.sparkContext.broadcast(WindowSet([(r["item"], bytes(r["body"])) for r in bench.collect()], width))
        return rows.mapInArrow(_report(lambda body, b, k: held.value.scan(body), with_text), out)
    rows = _joined(rows.withColumn("mark", F.unhex(F.sha2("body", 256))), bench, width).select("rest", "body", "places", "items")

    def known(body, b, k):
        return _counted(body), [(p["at"], p["width"]) for p in b.column(2)[k].as_py() or []], b.column(3)[k].as_py() or []

    return rows.mapInArrow(_report(known, with_text), out)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, most: int = MAX_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, spans and items of every row of docs.

    A window is `width` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A document word
    inside any occurrence of a window is hit. spans are the runs of hit words as [first, last) in code points, items the ids
    (strings, sorted) of the items with occurring windows.

    A benchmark of at most `most` bytes, 32 an item included, is broadcast as a set of window hashes, and every hit is verified word
    by word; documents don't move. A larger one is joined by the windows' words, hot windows dealt over salts. The rows are the same.
    Null or empty text has no words. An item without an id hits but isn't listed; rows that repeat an item's id are one item.
    Rows that repeat a document's id are reported each. Empty tables give no hits, or no rows. Other columns can't clash.
    """
    got = _scan(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), benchmark, "doc_id", "text", item_col, item_text, width, most, False)
    return got.select("rest.doc_id", "n_words", "n_hit", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", most_share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, most: int = MAX_BYTES) -> DataFrame:
    """docs, with their columns in order, less what the benchmark has.

    remove="spans" cuts the runs of hit words out of the text and drops documents of which more than most_share of the words is hit;
    remove="documents" drops every document with a hit word and leaves the others as they are. Nulls and ties as in find_leaks; the
    text of a row without a hit isn't changed, null included.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    was = free_name(docs, "was_null")
    d = docs.withColumn(was, F.col(f"`{text_col}`").isNull())
    got = _scan(d, benchmark, id_col, text_col, item_col, item_text, width, most, True)
    got = got.filter("n_hit = 0") if remove == "documents" else got.filter(F.col("n_hit") <= F.lit(most_share) * F.col("n_words"))
    text = F.when(~F.col(f"rest.`{was}`"), F.col("clean"))
    return got.select(*[text.alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def op13_decontamination(spark, sf_dir):
    from .common import table

    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), h AS (
  SELECT DISTINCT doc_id, k, i, win FROM dw WHERE win IN (SELECT win FROM bw)
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM h JOIN bw USING (win)) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
