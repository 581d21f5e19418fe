"""Token counts of a unigram vocabulary: pre-tokens share a trie, and each prefix is scored once."""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark of a word's begin in the vocabulary.
WORD = "▁"
#: Nodes at which a worker's trie starts anew, and the length from which a pre-token is scored outside the trie.
MAX_NODES, LONG = 1_000_000, 4_096


#: A piece of rank r has probability proportional to 1 / (r + SHIFT), the law that ranked words of natural language follow.
SHIFT = 2.7
#: Scores at or below this mark pieces without a rank of their own.
SENTINEL = -1e8


def rank_scores(n: int, shift: float = SHIFT) -> list[float]:
    """Natural log probabilities of n pieces by rank; their probabilities add up to one."""
    norm = math.log(math.fsum(1 / (r + shift) for r in range(n)))
    return [-math.log(r + shift) - norm for r in range(n)]


@lru_cache(maxsize=2)
def vocabulary(model_file: str, shift: float = SHIFT) -> dict[str, float]:
    """Piece to unigram log probability, for the pieces of a SentencePiece file without its control, unknown and byte pieces.

    The scores stored in a BPE file are merge ranks, not log probabilities, so only the order is taken from them: the table's
    order of merges, then of characters, is the frequency rank, and probabilities follow from the rank. Pieces with sentinel
    scores are runs of the word mark: the single mark ranks as the character it is, longer runs never occur in a pre-token.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    pieces = [sp.id_to_piece(i) for i in ids if sp.get_score(i) > SENTINEL or sp.id_to_piece(i) == WORD]
    return dict(zip(pieces, rank_scores(len(pieces), shift), strict=True))


class Trie:
    """Pre-tokens by character. A node holds the best score of its prefix and the number of tokens that give it; the terminals hold
    both for the whole words.

    The score of a prefix is the largest sum of piece scores over its splits into pieces (of equal sums, the one whose last
    piece is longest); a character that is no piece costs the least score less ten and counts as its UTF-8 bytes.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10
        self.terminal: dict[bytes, tuple[int, float]] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]
        self.terminal.clear()

    def _extend(self, text: str, to: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """Score and count of text[:to], given those of its prefixes: best[-k] is that of text[:to-k]."""
        top, n = float("-inf"), 0
        get = self.scores.get
        for k in range(min(self.longest, to, len(best)), 0, -1):
            s = get(text[to - k : to])
            if s is not None and best[-k] + s > top:
                top, n = best[-k] + s, count[-k] + 1
        if text[to - 1] not in self.scores and best[-1] + self.unknown > top:
            top, n = best[-1] + self.unknown, count[-1] + len(text[to - 1].encode())
        return top, n

    def tokens(self, word: bytes) -> int:
        """Number of tokens of a word."""
        return self.scored(word)[0]

    def scored(self, word: bytes) -> tuple[int, float]:
        """Number of tokens of a word, and their log probability."""
        known = self.terminal.get(word)
        if known is not None:
            return known
        text = WORD + word.decode()
        if len(text) > LONG:
            best, count = [0.0], [0]
            for to in range(1, len(text) + 1):
                b, c = self._extend(text, to, best, count)
                best, count = best[-self.longest :] + [b], count[-self.longest :] + [c]
            return count[-1], best[-1]
        if len(self.best) > MAX_NODES:
            self.clear()
        node, best, count = 0, [0.0], [0]
        for to, ch in enumerate(text, 1):
            key = node << 21 | ord(ch)
            node = self.child.get(key)
            if node is None:
                b, c = self._extend(text, to, best, count)
                node = self.child[key] = len(self.best)
                self.best.append(b)
                self.count.append(c)
            best.append(self.best[node])
            count.append(self.count[node])
        self.terminal[word] = count[-1], best[-1]
        return count[-1], best[-1]


def default_model() -> str:
    import public_tokenizers as p

    return p.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_distinct, n_tokens, log_prob) of every row: words, distinct words, unigram tokens of the whole
    text and the natural log probability of that split.

    Pre-tokens are the words [^\\x20\\x09-\\x0D]+, each after the mark of a word's begin. Null or empty texts have none. Tries live
    in the tasks and start anew at MAX_NODES nodes, which changes nothing but the time; there is no shuffle, so repeated rows
    and frequent words need nothing special. Only these columns are returned.
    """
    model_file = model_file or default_model()

    def run(batches):
        trie = Trie(vocabulary(model_file))
        for b in batches:
            out = []
            known = trie.terminal.get
            for text in b.column(1).to_pylist():
                words = Counter((text or "").encode().split())
                tokens, score = 0, 0.0
                for w, n in words.items():
                    t, s = known(w) or trie.scored(w)
                    tokens += n * t
                    score += n * s
                out.append((words.total(), len(words), tokens, score))
            cols = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_pretokens", "n_distinct", "n_tokens", "log_prob"])

    kind = docs.select(F.col(f"`{id_col}`")).dtypes[0][1]
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_distinct long, n_tokens long, log_prob double")


def op2_token_counts(spark, sf_dir):
    from .common import table

    return count_tokens(table(spark, sf_dir, "documents"))
