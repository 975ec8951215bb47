"""Operator 3: rules on counts, then the hashed n-gram log-likelihood ratio of a trusted corpus against the raw one.

The first pass counts hashed unigrams and bigrams of all documents and of the trusted ones: every task sums its own rows and
sends a row a bucket. The second takes the counts of the rules and the mean log-ratio of each text's n-grams, its own left out of
the raw counts. There are more buckets for more text (bucket_bits), and so a larger broadcast table: 16 bytes a bucket, 256 kB for
64 MB of text, 2 MB for 30 GB and 32 MB for 100 TB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import prepared, table, text_bytes
from weftline.llm.kernels import SEPARATOR, chunks, combine, hashed_ngrams, mix, prefix_hash, row_means, rows_of, runs, span_hash

#: Buckets: 2 ** MIN_BITS at least, and twice as many for each eight times as many bytes of text.
MIN_BITS = 14
#: Below this mean log-ratio a text is not kept. A text like the raw corpus itself has 0.
THRESHOLD = -0.1
#: So many ids of trusted rows may be broadcast (8 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000

#: The signs that count as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))
_LEAD = np.array([not 0x80 <= b < 0xC0 for b in range(256)])
_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flags set in each row."""
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key's value came earlier in its row, and whether it comes twice or more there."""
    own = mix(keys ^ mix(row.astype(np.uint64) + np.uint64(1)))
    _, first, inverse, counts = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(own), bool)
    later[first] = False
    return later, counts[inverse] > 1


def base_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by the five counts of _FIELDS."""
    rows = len(offsets) - 1
    word = ~SEPARATOR[data]
    starts, ends = runs(word, offsets)
    bounds = rows_of(starts, offsets)
    sums = prefix_hash(data)
    out = np.zeros((rows, 5), np.int64)
    out[:, 0] = np.diff(bounds)
    out[:, 1] = _sums(word & _LEAD[data], offsets)
    out[:, 2] = _sums(_SYMBOL[data], offsets)

    line_starts, line_ends = runs((data != 0x0A), offsets)  # empty lines have no word
    words_in = np.r_[0, np.cumsum(word, dtype=np.int64)]
    with_word = words_in[line_ends] > words_in[line_starts]
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    line_row = np.searchsorted(offsets, line_starts, "right") - 1
    later, _ = _again(span_hash(sums, line_starts, line_ends), line_row)
    out[:, 3] = np.bincount(line_row[later], minlength=rows)

    word_row = np.searchsorted(offsets, starts, "right") - 1
    windows = combine(span_hash(sums, starts, ends), 3)
    whole = word_row[: len(windows)] == word_row[2:] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    _, twice = _again(windows[at], word_row[at])
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 3, -1)
    out[:, 4] = np.bincount(word_row[np.cumsum(cover[:-1]) > 0], minlength=rows)
    return out


def _count(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(trusted, text) to a row (bucket, raw, target) for each bucket that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            trusted = np.asarray(batch.column(0).fill_null(False).cast(pa.int8())).astype(bool)
            for row, data, offsets in chunks(batch.column(1)):
                found, bounds = hashed_ngrams(data, offsets, bits)
                raw += np.bincount(found, minlength=1 << bits)
                own = np.repeat(trusted[row : row + len(offsets) - 1], np.diff(bounds))
                target += np.bincount(found[own], minlength=1 << bits)
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(raw[met]), pa.array(target[met])], names=["bucket", "raw", "target"])

    return run


def bucket_bits(size: int) -> int:
    """Bits of a bucket's number for so many bytes of text. Texts repeat their words, so n-grams a bucket grow as well."""
    return max(MIN_BITS, 5 + -(-max(size - 1, 0).bit_length() // 3))


def corpus_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """N-grams by bucket of all rows and of the trusted ones, one added to each; bits follow the bytes of all texts if not given."""
    prepared(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    bits = bucket_bits(text_bytes(texts)) if bits is None else bits
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    few = F.broadcast if ids.count() <= MOST_BROADCAST else (lambda x: x)
    rows = texts.join(few(ids.withColumn("trusted", F.lit(True))), "_id", "left")
    counted = rows.select("trusted", "text").mapInArrow(_count(bits), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(1 << bits), np.ones(1 << bits)
    bucket, r, t = (c.to_numpy() for c in counted.toArrow().columns)  # 2 ** bits rows at most
    raw[bucket] += r
    target[bucket] += t
    return raw, target


def _log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    if target.sum() == len(target):
        return np.zeros(len(target))
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> np.ndarray:
    """log p_target - log p_raw by bucket over all rows, both with one added to each count. Without trusted rows all are 0."""
    return _log_ratios(*corpus_counts(docs, trusted, id_col, text_col, bits))


def mean_ratios(found: np.ndarray, bounds: np.ndarray, ratios: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The mean log-ratio of each row's n-grams, against a raw corpus without the row itself.

    A text in a small corpus makes up much of the counts of its own n-grams, which would speak against it.
    """
    bits, counts = len(raw).bit_length() - 1, np.diff(bounds)
    key = np.sort(np.repeat(np.arange(len(counts)), counts) << bits | found)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    own, bucket = np.diff(np.r_[first, len(key)]), key[first] & (len(raw) - 1)
    lost = own * np.log(np.maximum(raw[bucket] - own, 1.0) / raw[bucket])
    sums = np.zeros(len(counts))
    if counts.any():
        sums[counts > 0] = np.add.reduceat(lost, np.searchsorted(first, bounds[:-1][counts > 0]))
    return row_means(ratios[found], bounds) - sums / np.maximum(counts, 1) + np.log1p(-counts / raw.sum())


def _measures(spark: SparkSession, raw: np.ndarray, target: np.ndarray, text: Column) -> Column:
    ratios = _log_ratios(raw, target)
    kept = spark.sparkContext.broadcast((ratios, raw))
    bits, blind = len(ratios).bit_length() - 1, not ratios.any()

    def measure(texts: pa.Array) -> pa.Array:
        counts, score = np.zeros((len(texts), 5), np.int64), np.zeros(len(texts))
        for row, data, offsets in chunks(texts):
            own = slice(row, row + len(offsets) - 1)
            counts[own] = base_counts(data, offsets)
            if not blind:
                score[own] = mean_ratios(*hashed_ngrams(data, offsets, bits), *kept.value)
        return pa.StructArray.from_arrays([*(pa.array(np.ascontiguousarray(counts[:, k])) for k in range(5)), pa.array(score)], [*_FIELDS, "log_ratio"])

    return F.arrow_udf(measure, ", ".join(f"{f} long" for f in _FIELDS) + ", log_ratio double")(text)


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Id, counts, log_ratio, base_failed and kept of every row; trusted holds the ids of the target corpus.

    A null or wordless text has no words, a ratio of 0, and fails the base. Rows may repeat; other columns are not read. The ratio of
    every text leaves its own n-grams out of the raw corpus; a trusted text's stay in the target, which favours it. Without trusted
    rows all ratios are 0. An empty table gives an empty one, and a very long text is handled alone.
    """
    raw, target = corpus_counts(docs, trusted, id_col, text_col, bits)
    out = docs.select(F.col(id_col), _measures(docs.sparkSession, raw, target, F.col(text_col).cast("string")).alias("m")).select(id_col, "m.*")
    out = out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and ratios of all documents; the trusted ones are those with label 1."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules(table(spark, sf_dir, "documents"), trusted)


QUERIES = {"op3_quality_rules": op3_quality_rules}
