"""Language-model scoring: corpus counts of all words, a recurrent model trained where the data is, scores of whole texts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import Scratch

#: The most frequent words that make up SHARE of all tokens are neural, LEAST of them at least, in HEADS word classes at least;
#: spelling classes for all other words, and hidden units.
SHARE, LEAST, HEADS, SHAPES, HIDDEN = 0.6, 512, 32, 32, 32
#: Lanes and steps of a training window and of a scoring window, passes into which training is cut, and their rates.
TRAIN, SCORE, RATES = (512, 16), (512, 16), (0.03, 0.02, 0.008)
#: Steps of a training window where few long texts are left; the state is carried through whole texts, as in scoring.
LONGEST = 128
#: Parameters in a block, the unit in which the tasks' parameters are added up, and first sums of each block.
BLOCK, FIRST = 1 << 12, 64
#: Words with at least 1/COMMON of all tokens, and END, are sent to every task: at most COMMON + 1 of them; the rest is joined.
COMMON = 1 << 20
#: Rows that are split into words at once.
ROWS = 10_000
#: The end mark among the words, which are never empty.
END = ""

_SHAPE = np.full(256, 31, np.int32)
_SHAPE[97:123] = np.arange(26)
_SHAPE[46], _SHAPE[44] = 26, 27
_SHAPE[48:58] = 28
_SHAPE[128:] = 29
for _c in b"#*$%&|<>!":
    _SHAPE[_c] = 30


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of an array of texts, A-Z lower-cased, and the number of words up to each row's end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, ends = lists.flatten(), lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
    # spaces at either end of a text leave empty strings
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full, min_count=0).as_py():
        ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[ends]
        flat = flat.filter(full)
    return flat, ends


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c): the count of every word and of END over all rows of texts (text), each batch handing on its own sums."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                part = b.column(0).slice(s, ROWS)
                got = split(part)[0].value_counts()
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([got.field(0), pa.array([END])]), pa.concat_arrays([got.field(1), pa.array([len(part)], pa.int64())])], names=["word", "c"])

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def shape_of(words: pa.Array) -> np.ndarray:
    """The spelling class of each word: that of its last byte; 31 for END."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    empty = offsets[1:] == offsets[:-1]
    out = _SHAPE[raw[np.maximum(offsets[1:] - 1, 0)]] if len(raw) else np.zeros(len(words), np.int32)
    return np.where(empty, 31, out)


class Coder:
    """Words to output ids: the most frequent ones have ids of their own in word classes, the others share ids by spelling."""

    def __init__(self, words: pa.Array, counts: np.ndarray, total: int | None = None):
        """Words and their counts, most frequent first. total: tokens of the corpus, if there are more than those."""
        sums = np.cumsum(counts)
        share = int(np.searchsorted(sums, SHARE * (total or (sums[-1] if len(sums) else 0)))) + 1
        own = min(len(words), max(LEAST, share))
        heads = max(HEADS, math.isqrt(own) // 2)
        width = max(LEAST // HEADS, -(-own // heads))
        self.heads, self.width = heads, width
        self.words = words
        self.log_count = np.log10(np.asarray(counts, np.float64) + 1)
        self.own = own
        self.spelled = heads * width
        #: of the common words, then of spelling class s at len(common) + s
        self.id = np.concatenate([np.arange(own), self.spelled + shape_of(words.slice(own)), self.spelled + np.arange(SHAPES)]).astype(np.int32)
        n = heads * width + SHAPES
        # frequent words are spread over the classes, so that each class has some of every frequency
        self.out_class = np.concatenate([np.arange(heads * width) % heads, heads + np.arange(SHAPES)]).astype(np.int32)
        self.out_slot = np.concatenate([np.arange(heads * width) // heads, np.full(SHAPES, -1)]).astype(np.int32)
        self.dims = gru.shapes(n, heads + SHAPES, heads, width, HIDDEN)
        end = words.index(END).as_py()
        self.end = end if end >= 0 else len(words) + 31
        self.first = int(self.id[self.end])

    def start(self, mass: np.ndarray) -> dict[str, np.ndarray]:
        """First parameters: small random weights, and biases from the counts (mass: that of each spelling class), so that the
        untrained model is about the unigram one."""
        p = gru.start(self.dims)
        counts = np.full(self.heads * self.width, 1e-6)
        counts[: self.own] = 10 ** self.log_count[: self.own]
        grid = counts.reshape(self.width, self.heads).T  # as out_class and out_slot have them
        p["ob"] = np.log(grid).astype(np.float32)
        p["cb"] = np.log(np.concatenate([grid.sum(1), np.maximum(mass, 1)])).astype(np.float32)
        p["cb"] -= p["cb"].max()
        return p

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Of all tokens of the texts, each text's end included: places among the common words (len(words) + spelling class for
        those elsewhere) and the texts' ends; then the words elsewhere, and how many of them there are up to each text's end."""
        flat, ends = split(texts)
        at = pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy().astype(np.int32)
        rare = at < 0
        others = flat.filter(pa.array(rare))
        at[rare] = len(self.words) + shape_of(others)
        stops = ends + np.arange(1, len(ends) + 1)
        places = np.full(len(at) + len(ends), self.end, np.int32)
        keep = np.ones(len(places), bool)
        keep[stops - 1] = False
        places[keep] = at
        return places, stops, others, np.concatenate([[0], np.cumsum(rare)])[ends]


def fit(texts: DataFrame, coder: Coder, mass: np.ndarray, key: Column) -> np.ndarray:
    """Parameters after len(RATES) passes, each over its own part of the texts by `key`, so that every text is used once.

    A pass has one text in len(RATES), and its tasks are fewer by as much: each holds about as many texts as a partition of the input.
    In a pass each task trains on its rows from the pass's first parameters; the new ones are the means, weighted by tokens.
    Sums of whole numbers make them the same whatever order tasks end in; they do depend on which rows share a task. Sums go
    through FIRST partial ones a block, so no task reads them from all tasks. What comes to the driver is one set of parameters.
    """
    params = gru.flatten(coder.start(mass))
    known = texts.sparkSession.sparkContext.broadcast(coder)
    last = texts.select(F.spark_partition_id().alias("task")).agg(F.max("task")).first()[0] or 0
    tasks = -(-(last + 1) // len(RATES))
    for r, rate in enumerate(RATES):
        frozen = params

        def run(batches, frozen=frozen, rate=rate):
            from pyspark import TaskContext

            coder = known.value
            model = gru.Model(gru.unflatten(frozen, coder.dims), coder.out_class, coder.out_slot)
            seen, adam = 0, {}
            for b in batches:
                places, stops, _, _ = coder.encode(b.column(0))
                ids = np.split(coder.id[places], stops[:-1]) if len(stops) else []
                seen += model.train(gru.Windows(ids, *TRAIN, coder.first, LONGEST), adam, rate, TRAIN[0] * TRAIN[1]) if ids else 0
            if seen:
                value = np.rint(gru.flatten(model.p) * 1e6).astype(np.int64) * seen
                blocks = [value[k : k + BLOCK].tobytes() for k in range(0, len(value), BLOCK)]
                n = len(blocks)
                first = TaskContext.get().partitionId() % FIRST
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([first] * n, pa.int32()), pa.array([seen] * n, pa.int64()), pa.array(blocks, pa.binary())], names=["block", "first", "seen", "value"])

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_buffer(), np.int64) for v in t.column("value"))
            return pa.table({"block": t.column("block")[:1], "first": t.column("first")[:1], "seen": pa.array([sum(t.column("seen").to_pylist())], pa.int64()), "value": pa.array([total.tobytes()], pa.binary())})

        schema = "block int, first int, seen long, value binary"
        part = texts.filter(F.pmod(key, F.lit(len(RATES))) == r).select("text").coalesce(tasks).mapInArrow(run, schema)
        sums = part.groupBy("block", "first").applyInArrow(add, schema)
        got = sums.groupBy("block").applyInArrow(add, schema).collect()
        if got:
            params = np.concatenate([np.frombuffer(x.value, np.int64) / (x.seen * 1e6) for x in sorted(got, key=lambda x: x.block)])
    known.unpersist()
    return params


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from rows not held out.

    Tokens are the words, A-Z lower-cased, and one end. base_score is the unigram log10 probability with one added to every
    count. score is the recurrent model's: the class of each token given all before it, then the word in its class: by the model
    for the most frequent words that make up SHARE of all tokens, by counts plus one for the words that share a spelling class, where words never
    seen count as zero. Null text counts as empty (its one token is the end). A null held_out counts as false. Without any
    training rows both scores come from empty counts and an untrained model. Repeated rows are scored and counted each. The
    model's parameters depend on which rows share a task, so another partitioning changes score a little, and nothing else.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    known = rows.filter(~F.col("held_out"))
    counts, _ = scratch.keep(word_counts(known.select("text")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    found = counts.filter((F.col("c") * COMMON >= total) | (F.col("word") == END)).toArrow() if total else pa.table({"word": pa.array([], pa.string()), "c": pa.array([], pa.int64())})
    found = found.sort_by([("c", "descending"), ("word", "ascending")])
    common, often = found.column("word").combine_chunks(), found.column("c").to_numpy()
    if isinstance(common, pa.ChunkedArray):
        common = pa.concat_arrays(common.chunks) if common.num_chunks else pa.array([], pa.string())
    common = common.cast(pa.string())
    coder = Coder(common, often, total)

    def by_shape(batches):
        for b in batches:
            mass = np.bincount(shape_of(b.column(0)), b.column(1).to_numpy() + 1, minlength=SHAPES).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES)), pa.array(mass)], names=["shape", "mass"])

    # words with ids of their own are no part of the spelling classes
    mass = 1 - np.bincount(shape_of(common.slice(0, coder.own)), often[: coder.own] + 1, minlength=SHAPES).astype(np.int64)
    for x in counts.mapInArrow(by_shape, "shape long, mass long").groupBy("shape").agg(F.sum("mass").alias("mass")).collect():
        mass[x["shape"]] += x["mass"]
    log_mass = np.log10(mass.astype(np.float64))
    params = fit(known, coder, mass, F.xxhash64("doc_id", "text"))
    sent = docs.sparkSession.sparkContext.broadcast((coder, params))

    def run(batches):
        coder, params = sent.value
        model = gru.Model(gru.unflatten(params, coder.dims), coder.out_class, coder.out_slot)
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                part = b.slice(s, ROWS)
                places, stops, others, ends = coder.encode(part.column(1))
                starts = np.concatenate([[0], stops[:-1]])
                out = coder.id[places]
                known = places < len(coder.words)
                log_count = np.where(known, coder.log_count[np.minimum(places, len(coder.words) - 1)] if len(coder.words) else 0.0, 0.0)
                spelled = out >= coder.spelled
                # the word within its spelling class, by counts; rare words' own counts are joined later
                inner = np.where(spelled, log_count - log_mass[np.maximum(out - coder.spelled, 0)], 0.0)
                # only sums by text are kept while the model runs
                n_known, base, inner = np.add.reduceat(known, starts, dtype=np.int64), np.add.reduceat(log_count, starts), np.add.reduceat(inner, starts)
                del places, known, log_count, spelled
                score = model.score(np.split(out, stops[:-1]), *SCORE, coder.first) / np.log(10) + inner
                rare = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), others)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + part.num_rows)), part.column(0), part.column(2), pa.array(stops - starts), pa.array(n_known), pa.array(base), pa.array(score), rare],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
                )
                row += part.num_rows

    kind = dict(rows.dtypes)["doc_id"]
    scored, _ = scratch.keep(rows.select("doc_id", "text", "held_out").mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<string>"))
    pairs = scored.select("row", F.explode("rare").alias("word"))
    # no word is frequent here, so partitions are even and counts need no sorting
    more = pairs.join(counts.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count(F.lit(1)).alias("more_known"))
    out = scored.drop("rare").join(more, "row", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("score") + extra).alias("score"),
    )


def op3_lm_scoring(spark, sf_dir):
    from .common import table

    return lm_scores(table(spark, sf_dir, "documents"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2)
