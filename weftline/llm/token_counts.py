"""Operator 1: token counts of texts under a unigram model, by dynamic programming on a trie of pre-tokens.

A pre-token's best segmentation has the highest sum of piece scores; its forward scores at each byte depend only on the
bytes before. So the distinct pre-tokens of a slice of texts form a trie that is walked depth-first, and every prefix that
several of them share is scored once. The node where a pre-token ends gives its count of pieces, which the worker keeps
up to a bounded number of pre-tokens; texts are neither shuffled nor cut.

Scores are those of a vocabulary in order of rank under Zipf's law, log p = -log(rank + 2), or any that are given.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import prepared, table

#: Terminal counts that a worker keeps, about 150 bytes each.
MOST_TOKENS = 600_000


def zipf_scores(pieces: Iterable[bytes]) -> dict[bytes, float]:
    """Scores of pieces in order of rank."""
    return {p: -math.log(k + 2) for k, p in enumerate(pieces)}


class PreTokenTrie:
    """Counts of pieces of pre-tokens, from one depth-first walk of the trie of those that are new.

    The walk keeps the forward scores of the current path alone: pre-tokens in byte order visit every shared prefix once.
    """

    def __init__(self, scores: dict[bytes, float], most_tokens: int = MOST_TOKENS):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0  # a byte that is no piece counts as one
        self.most_tokens = most_tokens
        self.terminal: dict[str, int] = {}

    def counts(self, tokens: list[str]) -> list[int]:
        """Pieces of each of some distinct pre-tokens."""
        if len(self.terminal) > self.most_tokens:
            self.terminal.clear()
        known = self.terminal
        self._walk(sorted(t.encode() for t in tokens if t not in known))
        return [known[t] for t in tokens]

    def _walk(self, tokens: list[bytes]) -> None:
        score, longest, unknown, terminal = self.scores.get, self.longest, self.unknown, self.terminal
        best, count, last = [0.0], [0], b""  # forward score and pieces at each depth of the path
        for token in tokens:
            depth = 0
            for a, b in zip(last, token):  # noqa: B905  the shorter of the two ends it
                if a != b:
                    break
                depth += 1
            del best[depth + 1 :], count[depth + 1 :]
            for end in range(depth + 1, len(token) + 1):
                top, pieces = best[-1] + unknown, count[-1] + 1
                for start in range(end - longest if end > longest else 0, end):
                    s = score(token[start:end])
                    if s is not None:
                        s += best[start]
                        if s > top or s == top and count[start] + 1 < pieces:
                            top, pieces = s, count[start] + 1
                best.append(top)
                count.append(pieces)
            terminal[token.decode()] = count[-1]
            last = token


#: Tries by vocabulary; a worker that is used again goes on with what it knows.
_TRIES: dict[str, tuple[PreTokenTrie, regex.Pattern]] = {}


def _counter(shared: Callable[[], tuple[dict[bytes, float], str]], key: str, most_tokens: int) -> Callable[[pa.Array], pa.Array]:
    def count(texts: pa.Array) -> pa.Array:
        if key not in _TRIES:
            scores, pattern = shared()
            _TRIES.clear()
            _TRIES[key] = PreTokenTrie(scores, most_tokens), regex.compile(pattern)
        trie, pattern = _TRIES[key]
        tokens, pre = [], []
        for group in _groups(texts.fill_null("").to_pylist()):
            found = [Counter(pattern.findall(x)) for x in group]
            distinct = list(set().union(*found))
            known = dict(zip(distinct, trie.counts(distinct), strict=True))
            tokens += [sum(known[t] * n for t, n in f.items()) for f in found]
            pre += [f.total() for f in found]
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(pre, pa.int64())], ["n_tokens", "n_pre_tokens"])

    return count


def _groups(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in groups of about so many characters."""
    group, size = [], 0
    for x in texts:
        group.append(x)
        size += len(x)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a rank file, by rank."""
    with open(path, "rb") as f:
        ranks = sorted((int(rank), base64.b64decode(piece)) for piece, rank in (line.split() for line in f))
    return [piece for _, piece in ranks]


def token_counts(spark: SparkSession, text: Column, scores: dict[bytes, float], pattern: str, most_tokens: int = MOST_TOKENS) -> Column:
    """A struct (n_tokens, n_pre_tokens) of a text; both are 0 for a null or empty one.

    Ties between segmentations go to the one of fewer pieces. Where no piece fits, a byte is a piece. Repeated rows have the same
    counts; an empty table gives an empty one. A very long pre-token is walked as any other, its path held for one slice only. The score table is
    as large as the vocabulary and is broadcast.
    """
    shared = spark.sparkContext.broadcast((scores, pattern))
    key = hashlib.sha256(repr((sorted(scores.items()), pattern, most_tokens)).encode()).hexdigest()
    return F.arrow_udf(_counter(lambda: shared.value, key, most_tokens), "n_tokens long, n_pre_tokens long")(text.cast("string"))


def count_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """The rows with n_tokens and n_pre_tokens, which replace columns of those names."""
    import public_tokenizers

    spark = prepared(docs.sparkSession)
    scores = zipf_scores(read_ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")))
    counted = docs.withColumn("_counted", token_counts(spark, F.col(text_col), scores, pattern or public_tokenizers.PATTERN))
    return counted.withColumns({"n_tokens": F.col("_counted.n_tokens"), "n_pre_tokens": F.col("_counted.n_pre_tokens")}).drop("_counted")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, by scores that are made from the ranks of the vocabulary."""
    return count_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {"op1_token_counts": op1_token_counts}
