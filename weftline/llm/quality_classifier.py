"""Operator 9: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features are the counts of hashed unigrams and bigrams of a text, divided by their number: a score is one sparse dot
product. Labelled rows are turned into features where they lie; a bounded number of them, taken by a hash of the id,
meets in one task for the sequential updates. The weights (2 ** bits floats) are broadcast; scoring is one narrow pass.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import prepared, table
from weftline.llm.kernels import chunks, hashed_ngrams, row_means


@dataclass(frozen=True)
class Settings:
    """bits: of the hash; alpha, beta, l1, l2: of the updates; scale: of the features; max_rows: labelled rows that are used."""

    bits: int = 18
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    scale: float = 20.0
    max_rows: int = 10_000


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    settings: Settings


def _featurise(s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, label, text) to (key, label, buckets, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, values = [], []
            for _, data, offsets in chunks(batch.column(2)):
                found, bounds = hashed_ngrams(data, offsets, s.bits)
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    own, counts = np.unique(found[a:b], return_counts=True)
                    buckets.append(own.astype(np.uint32).tobytes())
                    values.append((counts * (s.scale / max(b - a, 1))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(buckets, pa.binary()), pa.array(values, pa.binary())], names=["key", "label", "buckets", "values"])

    return run


def _follow(s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass of FTRL-proximal updates over sorted feature rows, to one row with the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << s.bits) + 1  # the last is the bias
        z, n = np.zeros(size), np.zeros(size)

        def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
            return np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

        for batch in batches:
            for label, own, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                at = np.r_[np.frombuffer(own, np.uint32).astype(np.int64), size - 1]
                x = np.r_[np.frombuffer(x, np.float32).astype(np.float64), 1.0]
                w = weights(z[at], n[at])
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
                z[at] += g - sigma * w
                n[at] += g * g
        yield pa.RecordBatch.from_arrays([pa.array([weights(z, n).astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> Model:
    """A model of the labels 0 and 1. At most settings.max_rows labelled rows are used: the labels with the least hashes of
    their ids, and of the rows that have these ids all if they are so few. Of more, as when an id is repeated, those with the least hashes of
    id and text, each text once. Rows without a label, an id or a document do not count. Without any labelled row every score is 0.5. A
    null text has no features. A very long text is one row of features, one for each distinct bucket.
    """
    prepared(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    sample = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(settings.max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(sample), "_id")
    if rows.count() > settings.max_rows:
        rows = _fewest(rows, settings.max_rows)
    features = rows.select(F.xxhash64("_id").alias("key"), F.col("_label").alias("label"), F.col("_text").alias("text")).mapInArrow(_featurise(settings), "key long, label int, buckets binary, values binary")
    ordered = features.repartition(1).sortWithinPartitions("key", "label", "buckets", "values")
    made = ordered.mapInArrow(_follow(settings), "weights binary").first()  # no row if there is no partition
    weights = np.frombuffer(made[0], np.float32) if made else np.zeros((1 << settings.bits) + 1, np.float32)
    return Model(weights[:-1], float(weights[-1]), settings)


def _fewest(rows: DataFrame, most: int) -> DataFrame:
    """So many distinct rows of (_id, _label, _text) at most, whatever is repeated."""
    keyed = rows.withColumns({"_a": F.xxhash64("_id"), "_b": F.xxhash64("_text"), "_c": F.col("_label")})
    key = F.struct("_a", "_b", "_c")
    last = keyed.select("_a", "_b", "_c").distinct().orderBy("_a", "_b", "_c").limit(most).agg(F.max(key).alias("last")).first().last
    bound = F.struct(*(F.lit(x).cast(kind).alias(k) for k, x, kind in zip(("_a", "_b", "_c"), last, ("long", "long", "int"), strict=True)))
    return keyed.where(key <= bound).groupBy("_a", "_b", "_c").agg(*(F.min(c).alias(c) for c in ("_id", "_label", "_text"))).drop("_a", "_b", "_c")


def quality_score(spark: SparkSession, model: Model, text: Column) -> Column:
    """The model's score of a text, 0 to 1; a null or empty text has the score of the bias alone."""
    kept = spark.sparkContext.broadcast(pickle.dumps(model))
    cache: list[Model] = []

    def score(texts: pa.Array) -> pa.Array:
        if not cache:
            cache.append(pickle.loads(kept.value))
        m, s = cache[0], cache[0].settings
        out = np.zeros(len(texts))
        for row, data, offsets in chunks(texts):
            found, bounds = hashed_ngrams(data, offsets, s.bits)
            out[row : row + len(offsets) - 1] = row_means(m.weights[found], bounds)
        return pa.array(1 / (1 + np.exp(-np.clip(out * s.scale + m.bias, -35, 35))), pa.float64())

    return F.arrow_udf(score, "double")(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id's text modulo 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """fit_quality without the labels of held-out rows."""
    return fit_quality(docs, labels.where(~held_out()))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on_labels(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_score(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
