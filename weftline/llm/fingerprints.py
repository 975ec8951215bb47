"""Operator 10: document fingerprints of closed syncmers, in DataFrame functions only.

Words are hashed in neighbouring pairs (the inner substrings, s = 2 words). A k-mer of k = 6 words is an anchor when
the least of its 5 inner hashes is the first or the last of them. That depends on the k-mer's own words alone, so an edit
moves no anchor outside the k words around it. k - 1 empty words stand before and after every text, so one rule gives anchors to
texts of all lengths. A fingerprint lists the anchors in the order of their positions; likeness counts the anchors that two
texts share in the same order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import prepared, table

#: Words of a k-mer; inner substrings have two.
K = 6
#: Bytes of text in a block of neighbouring documents, and so many blocks at most; beyond, blocks are larger.
BLOCK_BYTES = 8 << 20
MOST_BLOCKS = 100_000
#: So many rows are drawn for a bound between blocks; every so manieth of them is one.
DRAWN = 4
#: Bits of an anchor.
BITS = 40

_SPLIT = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text; null is the empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPLIT), lambda w: w != "")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value made once for each row however often `then` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def anchors(text: Column, k: int = K) -> Column:
    """Hashes (40 bits, as longs) of the closed syncmers of a text's words, by position.

    The empty words around the text make its first and its last word the end and the start of a k-mer that is always an anchor. So
    every text with words has anchors, and those of a few words are made as those of a million. A text without words has none.
    """
    width = k - 1  # inner hashes of a k-mer

    def edge(pairs: Column, i: Column) -> Column:
        inside = [F.get(pairs, i + d) for d in range(1, width - 1)]
        first, last = F.get(pairs, i), F.get(pairs, i + width - 1)
        at_first, at_last = first <= last, last <= first
        for x in inside:
            at_first, at_last = at_first & (first <= x), at_last & (last <= x)
        return at_first | at_last

    def picked(pairs: Column) -> Column:
        kept = F.filter(F.sequence(F.lit(0), F.size(pairs) - width), lambda i: edge(pairs, i))
        return F.transform(kept, lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(pairs, i + d) for d in range(0, width, 2))), 64 - BITS))

    def of_words(w: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i)))
        return F.when(F.size(w) > 0, _once(inner, picked)).otherwise(F.array().cast("array<long>"))

    around = F.array_repeat(F.lit(""), k - 1)
    return _once(_once(words(text), lambda w: F.when(F.size(w) > 0, F.concat(around, w, around)).otherwise(w)), of_words)


def fingerprint(found: Column) -> Column:
    """Anchors as text: 11 characters each (a 1 and ten hex digits), in order."""
    return F.array_join(F.transform(found, lambda x: F.hex(x + F.lit(1 << BITS))), "")


def shared_in_order(a: Column, b: Column) -> Column:
    """Distinct anchors that two lists share, less one for each break in their order.

    Both lists are cut to what they share, in their own orders; neighbours in one that are no neighbours in the other are a break. A
    passage that is moved costs a break or two, a shuffled text nearly all. Time and memory are linear in the lists.
    """

    def steps(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.xxhash64(F.get(c, i - 1), F.get(c, i)))

    def kept(x: Column) -> Column:
        return F.when(F.size(x["a"]) > 1, F.size(F.array_intersect(steps(x["a"]), steps(x["b"]))) + 1).otherwise(F.size(x["a"]))

    return _once(F.struct(F.array_intersect(a, b).alias("a"), F.array_intersect(b, a).alias("b")), kept)


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two lists of anchors, 0 to 1: twice those shared in order over both lists' distinct ones; two empty ones are alike."""
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * shared_in_order(a, b) / both)


def _bounds(rows: DataFrame) -> list:
    """(id, hash) of rows that begin a block, ascending: drawn with a chance in proportion to their bytes, whatever the ids are.

    MOST_BLOCKS at most. Rows that are alike in both are drawn one by one, so a bound that many of them share comes up as often as
    blocks are needed for them.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = max(BLOCK_BYTES, -(-size // MOST_BLOCKS))
    drawn = rows.where(F.rand(10) * block < DRAWN * F.octet_length("text").cast("double")).select(F.struct("id", "hash").alias("x"))
    every = F.filter(F.array_sort(F.collect_list("x")), lambda x, i: i % DRAWN == DRAWN - 1)
    return [(x.id, x.hash) for x in drawn.agg(every.alias("bounds")).first().bounds]


def _block(bounds: list) -> Column:
    """The number of bounds that are not above a row, by bisection; rows that equal a repeated bound are dealt to all of its blocks."""
    if not bounds:
        return F.lit(0)
    ids, hashes = (F.split(F.lit(",".join(str(x[k]) for x in bounds)), ",").cast("array<long>") for k in (0, 1))

    def halved(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        below = (F.get(ids, middle) < F.col("id")) | ((F.get(ids, middle) == F.col("id")) & (F.get(hashes, middle) <= F.col("hash")))
        return F.struct(
            F.when((acc["low"] < acc["high"]) & below, middle + 1).otherwise(acc["low"]).alias("low"),
            F.when((acc["low"] < acc["high"]) & ~below, middle).otherwise(acc["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), halved, lambda acc: acc["low"])
    if len(set(bounds)) == len(bounds):
        return found
    times = {x: bounds.count(x) for x in {a for a, b in zip(bounds, bounds[1:], strict=False) if a == b}}
    copies = F.split(F.lit(",".join(str(times.get(x, 1)) for x in bounds)), ",").cast("array<int>")
    alike = (F.get(ids, found - 1) == F.col("id")) & (F.get(hashes, found - 1) == F.col("hash"))
    dealt = F.pmod(F.monotonically_increasing_id(), F.get(copies, found - 1)).cast("int")
    return F.when(alike, found - dealt).otherwise(found)


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(own_id, id, text, hash, block, borrowed): blocks of neighbours by ascending id, each with the next block's first row as well.

    A block's borrowed row has borrowed = true and comes last in it; the last block borrows the very first row. So a
    window over a block sees each row's successor. Rows of one id are in the order of their texts' hashes. Texts are shuffled once.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("own_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    bounds = _bounds(rows)
    rows = rows.withColumn("block", _block(bounds))
    # a row for each block, MOST_BLOCKS at most: they may pass one window and be broadcast
    heads = rows.groupBy("block").agg(F.min(F.struct("id", "hash")).alias("head"))
    order = Window.orderBy("block")
    before = F.coalesce(F.lag("block").over(order), F.max("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("block", "head.*", before.alias("target"))
    first = rows.join(F.broadcast(heads), ["block", "id", "hash"]).groupBy("target").agg(F.min("id").alias("id"), F.min("text").alias("text"), F.min("hash").alias("hash"))
    borrowed = first.select(F.lit(None).cast(rows.schema["own_id"].dataType).alias("own_id"), "id", "text", "hash", F.col("target").alias("block"), F.lit(True).alias("borrowed"))
    both = rows.withColumn("borrowed", F.lit(False)).union(borrowed)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(bounds) + 1)
    return both.repartition(tasks, "block").sortWithinPartitions("block", "borrowed", "id", "hash")


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprint of every row's text, and its likeness to its edited text and to the next row's text.

    The edited text has its last floor(n / 2) code points replaced by as many first ones (or all) of the next text by
    ascending id; the last row's next is the first. A null text is empty, a null id comes first, equal ids follow
    the order of their texts' hashes. One row of result a row, so repeated rows stay; an empty table gives an empty one. Other columns are
    not read. A very long text is a row as any other, and its time is linear. The table must read the same twice (files, or a
    checkpoint).
    """
    prepared(docs.sparkSession)
    order = Window.partitionBy("block").orderBy("borrowed", "id", "hash")
    rows = with_neighbours(docs, id_col, text_col).withColumn("found", anchors(F.col("text"), k))
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_found", F.lead("found").over(order)).where("not borrowed")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", n - half), F.left(F.coalesce("next_text", "text"), half)))
    rows = rows.withColumn("edited_found", anchors(F.col("edited"), k))
    return rows.select(
        F.col("own_id").alias(id_col),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("found")).alias("fingerprint"),
        fingerprint(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
        likeness(F.col("found"), F.coalesce("next_found", "found")).alias("near_next"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_fingerprints of all documents."""
    return document_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op10_fingerprints": op10_fingerprints}
