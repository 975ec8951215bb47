"""Documents to token ids: quality, near duplicates, secrets, mix, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns
of documents. Null texts are empty ones: the classifier scores them by its bias, they are no near duplicates of anything,
hold no secrets and encode to the begin and end ids. An empty table stays empty; more columns than those of documents are handed on
by all stages but the last, whatever their names are. Very long texts are rows as others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import prepared, table
from weftline.llm.mixing import mixed
from weftline.llm.ngram_join import ngram_jaccard_join
from weftline.llm.piece_codec import encode_documents
from weftline.llm.quality_classifier import fit_on_labels, quality_score
from weftline.llm.secrets import KINDS, found_secrets, labelled_samples, pair_ratios

#: So many ids of dropped documents may be broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Part of the tokens that the mix takes; no document is taken twice.
MIX_SHARE = 0.85


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from labels of rows that are not held out."""
    model = fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_score(spark, model, F.col("text")) >= 0.5)


def _few(rows: DataFrame) -> DataFrame:
    """The table, which is checkpointed, marked for a broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that of the least id, of equal ids that of the least text hash; null ids come last.

    A decision holds for an id and a text together, so of two texts with one id only the near copy goes. Rows that are alike in both are
    one document: the one whose columns have the least hash stays. Documents without words all stay.
    """
    key = ["no_id", "id", "text_hash"]
    named = ngram_jaccard_join(docs).where("component is not null")
    named = named.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash", "component").checkpoint()
    # of components of one row nothing goes; the others are stored, so that a large one is split where it is joined
    best = named.groupBy("component").agg(F.min(F.struct(*key)).alias("best"), F.count("*").alias("n")).where("n > 1").select("component", "best").checkpoint()
    keys = named.join(_few(best), "component").select(*key, (F.struct(*key) == F.col("best")).alias("stays")).groupBy(*key, "stays").count()
    keys = keys.where("not stays or count > 1").checkpoint()
    lost, repeated = keys.where("not stays").drop("stays", "count"), keys.where("stays").drop("stays", "count")

    text = F.col("text").cast("string")
    held = {"no_id": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "text_hash": F.xxhash64(text)}
    rows = docs.select(F.struct(*docs.columns).alias("row"), *(x.alias(k) for k, x in held.items()))
    rows = rows.join(_few(lost), key, "left_anti")
    if repeated.isEmpty():
        return rows.select("row.*")
    plain = [f"row.{c}" for c, kind in docs.dtypes if "map<" not in kind]
    few = _few(repeated)
    one = rows.join(few, key, "left_semi").groupBy(*key).agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return rows.join(few, key, "left_anti").select("row.*").union(one.select("row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark."""
    held = "_found"
    while held in docs.columns:
        held += "_"
    found = docs.withColumn(held, found_secrets(F.col("text"), pair_ratios(labelled_samples(docs)), "[SECRET]"))
    some = F.lit(False)
    for kind in KINDS:
        some = some | (F.size(f"{held}.{kind}") > 0)
    new = {"text": F.when(some, F.col(f"{held}.clean")).otherwise(F.col("text")), "n_chars": F.when(some, F.char_length(f"{held}.clean").cast("long")).otherwise(F.col("n_chars"))}
    return found.select([new.get(c, F.col(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A share of the tokens, dealt evenly to languages and then to sources as far as they reach."""
    return mixed(docs, MIX_SHARE, seed=11, epoch_col=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed as little-endian unsigned 32-bit integers, and their spans' ends in its UTF-8."""
    coded = encode_documents(docs)
    return coded.select("doc_id", "lang", "source", F.floor(F.octet_length("encoded.ids") / 4).alias("n_tokens"), F.col("encoded.ids").alias("ids"), F.col("encoded.ends").alias("ends"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents that all stages keep."""
    prepared(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
