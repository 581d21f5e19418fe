"""Byte-level BPE with the tiktoken library and a local rank file: encoding of long texts in safe parts, raw-byte decoding."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts longer than this are encoded part by part.
PART_CHARS = 1 << 16
#: Ids that a task gathers before it hands them on.
BATCH_IDS = 1 << 19
#: Places where a match of the split pattern always ends, whatever follows: before a blank or line feed after an ASCII letter
#: or digit, and between an ASCII letter and a digit.
SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The encoding of a rank file, loaded once a worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART_CHARS):
    """text in order, cut at safe places only; a run without one stays whole."""
    start = 0
    while len(text) - start > size:
        m = SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def default_ranks() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every row: the ordinary tokens of the whole text, no special tokens.

    Null or empty text gives an empty array; a null id stays null; repeated rows are encoded each. The rank file's path must be
    valid on every executor. Work is per row, without a shuffle. The result has these two columns only, so other columns of
    docs can't clash.
    """
    own = default_ranks() if rank_file is None else (rank_file, pattern)

    def run(batches):
        enc = encoding(*own)
        for b in batches:
            held, first, size = [], 0, 0
            for k in range(b.num_rows):
                text = b.column(1)[k].as_py() or ""
                held.append(np.concatenate([np.zeros(0, np.uint32), *(enc.encode_to_numpy(p, disallowed_special=()) for p in parts(text))]).astype(np.int32))
                size += len(held[-1])
                # hand on what has gathered: a batch of long texts never stands in memory as ids
                if size > BATCH_IDS or k == b.num_rows - 1:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(held)), pa.ListArray.from_arrays(offsets, np.concatenate(held))], names=["doc_id", "ids"])
                    held, first, size = [], k + 1, 0

    kind = docs.select(F.col(f"`{id_col}`")).dtypes[0][1]
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(tokens: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """tokens (doc_id, ids) with a column decoded (binary): the bytes of the ids, not forced into UTF-8. Null ids give no bytes."""
    own = default_ranks() if rank_file is None else (rank_file, pattern)

    def run(batches):
        enc = encoding(*own)
        for b in batches:
            sizes = np.cumsum([len(x) if x.is_valid else 0 for x in b.column(1)])
            first = 0
            while first < b.num_rows:
                last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + BATCH_IDS, "right")))
                c = b.slice(first, last - first)
                out = [enc.decode_bytes(x.values.to_pylist()) if x.is_valid else b"" for x in c.column(1)]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])
                first = last

    kind = dict(tokens.dtypes)["doc_id"]
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def op5_bpe(spark, sf_dir):
    from .common import table

    t = decode_ids(encode_texts(table(spark, sf_dir, "documents")))
    return t.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
