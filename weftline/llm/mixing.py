"""Operator 5: mixing sources to target weights by hierarchical budgets.

Weights go down a tree of domains, languages and sources. A node's budget is dealt to its children by weight, no child
getting more than its documents can give in the allowed epochs: what one cannot take goes to its siblings, and only what
all of them cannot take was withheld from the node in favour of its own siblings. Each leaf then takes a prefix of its
documents in a seeded order: whole epochs first, then as many documents of one more as fit.

Only ids, leaves and token counts move. A leaf's prefix is found by sums over hash buckets of its order, so a leaf that
has a third of all rows is no task of its own; texts are filtered where they lie by one comparison with the leaf's bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import prepared, table

#: Buckets of a leaf's order. The one bucket that the bound falls into is ordered exactly.
BUCKETS = 4096
#: Ranges of capacity for a weight, for each doubling of it, by which the level of siblings is looked for.
RANGES = 64
#: A table of so many leaves or nodes is broadcast.
MOST_BROADCAST = 50_000

LEVELS = ("domain", "lang", "source")


def n_words(text: Column) -> Column:
    """Words of a text, the default token count; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def dealt(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds the share of each node (columns budget of its parent, weight, capacity) as `name`.

    Water-filling: of siblings in order of capacity for their weight (fill), those that the level reaches are filled; the others
    share what is left by weight. Equal fills are summed, and so are ranges of them: the range that the level lies in is found from
    sums, and its fills alone are walked in order. So no task has all children of a node.
    """
    keys = [*parents, "budget"]
    fill = F.when(F.col("weight") > 0, F.col("capacity") / F.when(F.col("weight") > 0, F.col("weight")))
    nodes = nodes.withColumn("fill", fill).checkpoint()  # read twice; a budget that is one number for all stays a column to join by
    fills = nodes.where("weight > 0").groupBy(*keys, "fill").agg(F.sum("capacity").alias("capacity"), F.sum("weight").alias("weight"))
    fills = fills.withColumn("range", F.coalesce(F.floor(F.log2("fill") * RANGES).cast("long"), F.lit(-(1 << 40)))).checkpoint()

    ranges = fills.groupBy(*keys, "range").agg(F.max("fill").alias("most"), F.sum("capacity").alias("capacity"), F.sum("weight").alias("weight"))
    order = Window.partitionBy(*keys).orderBy("range")
    below, above = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    ranges = ranges.withColumns({"gone": F.coalesce(F.sum("capacity").over(below), F.lit(0.0)), "beyond": F.coalesce(F.sum("weight").over(above), F.lit(0.0))})
    edge = ranges.where("gone + capacity + most * beyond > budget").groupBy(*keys).agg(F.min(F.struct("range", "gone", "beyond")).alias("edge"))

    inside = _equal_join(fills, _few(edge), keys, "inner").where("range = edge.range")
    order = Window.partitionBy(*keys).orderBy("fill")
    below, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.col("edge.gone") - F.coalesce(F.sum("capacity").over(below), F.lit(0.0))) / (F.sum("weight").over(rest) + F.col("edge.beyond"))
    inside = inside.withColumn("level", F.greatest(level, F.lit(0.0)))
    # the first fill that the level does not reach; if by rounding there is none, the level is at the end of the range
    first = F.coalesce(F.min(F.when(F.col("level") < F.col("fill"), F.struct("fill", "level"))), F.struct(F.max("fill").alias("fill"), F.max("fill").alias("level")))
    settled = inside.groupBy(*keys).agg(first.alias("settled"))
    full = F.col("settled").isNull() | (F.col("fill") < F.col("settled.fill"))
    share = F.when(F.col("weight") <= 0, F.lit(0.0)).when(full, F.col("capacity")).otherwise(F.least(F.col("weight") * F.col("settled.level"), F.col("capacity")))
    return _equal_join(nodes, _few(settled), keys, "left").withColumn(name, share).drop("fill", "settled")


def _few(rows: DataFrame) -> DataFrame:
    """The table, checkpointed, marked for a broadcast if it is small."""
    rows = rows.checkpoint()
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def leaf_budgets(leaves: DataFrame, weights: dict[str, DataFrame], budget: float, max_epochs: int) -> DataFrame:
    """Adds `share`, in tokens, to leaves (domain, lang, source, tokens).

    weights has for a level a table of the level's columns from the root on, and weight (not negative). A node that is
    missing, and every node of a level without a table, has weight 1. A node of weight 0 gets nothing, and its documents do not
    count for what its ancestors can take, so no budget is withheld from others for them.
    """
    below = leaves.select(*LEVELS, "tokens", (F.col("tokens") * max_epochs).cast("double").alias("capacity"))
    levels: list[DataFrame] = []  # from the leaves up
    for depth in range(len(LEVELS), 0, -1):
        keys = list(LEVELS[:depth])
        nodes = below.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        if LEVELS[depth - 1] in weights:
            own = weights[LEVELS[depth - 1]].select(*keys, F.col("weight").cast("double").alias("weight"))
            nodes = _equal_join(nodes, own, keys, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        else:
            nodes = nodes.withColumn("weight", F.lit(1.0))
        nodes = nodes.checkpoint()  # a row a node; read by the level above and on the way down
        levels.append(nodes)
        below = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0.0)))
    over: DataFrame | None = None
    for depth, nodes in enumerate(reversed(levels), 1):
        keys = list(LEVELS[:depth])
        nodes = nodes.withColumn("budget", F.lit(float(budget))) if over is None else _equal_join(nodes, over, keys[:-1], "inner")
        nodes = nodes.withColumns({k: F.lit(None).cast("string") for k in LEVELS[depth:]})
        over = dealt(nodes, keys[:-1], "share").select(*keys, "tokens", "share")
        if depth < len(LEVELS):
            over = over.select(*keys, F.col("share").alias("budget"))
    return over


def _equal_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys in which null meets null."""
    right = right.select([F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(right, condition, how).drop(*(f"_{k}" for k in keys))


def mixed(
    docs: DataFrame,
    budget_share: float,
    weights: dict[str, DataFrame] | None = None,
    domain: Column | None = None,
    tokens: Column | None = None,
    max_epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    epoch_col: str | None = "epoch",
) -> DataFrame:
    """The rows that a mix of budget_share times all tokens takes, once for each epoch (in epoch_col) that takes them.

    docs has lang and source; domain is a column of its own or, by default, one domain for all. Nulls are nodes like any
    other. Order in a leaf is by a hash of seed, epoch and id, then the id; equal ids are taken together or not at all, as
    one of their summed tokens. A document that does not fit ends its leaf's prefix. Rows of 0 tokens before that end are
    taken. Null ids are equal ids. A column named like epoch_col is replaced. An empty table gives an empty result.
    """
    spark = prepared(docs.sparkSession)
    domain = F.lit("all") if domain is None else domain
    count = n_words(F.col(text_col)) if tokens is None else tokens.cast("long")
    node = [domain.cast("string").alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]
    narrow = docs.select(*node, F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), count.alias("tokens")).groupBy(*LEVELS, "id").agg(F.sum("tokens").alias("tokens")).checkpoint()
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    shares = leaf_budgets(leaves, weights or {}, budget_share * total, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("share") / F.col("tokens") + F.lit(1e-9)), F.lit(max_epochs))).otherwise(F.lit(1)).cast("int")
    shares = shares.withColumn("whole", whole).withColumn("left", F.floor(F.col("share") - F.col("whole") * F.col("tokens") + F.lit(1e-6)).cast("long")).drop("tokens")
    shares = shares.checkpoint()
    n_leaves = shares.count()
    few = F.broadcast if n_leaves <= MOST_BROADCAST else (lambda x: x)

    def order(epoch: Column, ident: Column) -> Column:
        return F.xxhash64(F.lit(seed), epoch, ident)

    placed = _equal_join(narrow, few(shares), list(LEVELS), "inner").where((F.col("whole") < max_epochs) & (F.col("left") > 0))
    placed = placed.withColumn("at", order(F.col("whole"), F.col("id"))).withColumn("bucket", F.shiftright("at", 64 - (BUCKETS.bit_length() - 1)))
    sums = placed.groupBy(*LEVELS, "left", "bucket").agg(F.sum("tokens").alias("tokens"))
    through = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    edge = sums.withColumn("through", through).where("through > left").groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("left") - F.col("through") + F.col("tokens")).alias("fits"))).alias("edge"))
    inside = _equal_join(placed.drop("left"), few(edge), list(LEVELS), "inner").where("bucket = edge.bucket")
    running = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("at", "id"))
    # the first document that does not fit; a leaf without one takes its whole last epoch
    bound = inside.withColumn("running", running).where("running > edge.fits").groupBy(*LEVELS).agg(F.min(F.struct("at", "id")).alias("bound"))
    ends = _equal_join(shares.drop("share"), bound, list(LEVELS), "left").checkpoint()

    mark = "__mix_"  # names that no table has
    marked = docs.withColumns({mark + k: c for k, c in zip((*LEVELS, "id"), (*node, F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))), strict=True)})
    ends = ends.select([F.col(c).alias(f"{mark}of_{c}") for c in ends.columns])
    on = F.lit(True)
    for k in LEVELS:
        on = on & F.col(mark + k).eqNullSafe(F.col(f"{mark}of_{k}"))
    taken = marked.join(few(ends), on)
    whole, left, bound, ident = (F.col(mark + c) for c in ("of_whole", "of_left", "of_bound", "id"))
    more = (whole < max_epochs) & (left > 0) & (bound.isNull() | (F.struct(order(whole, ident).alias("at"), ident.alias("id")) < bound))
    taken = taken.withColumn(f"{mark}times", whole + more.cast("int")).where(F.col(f"{mark}times") > 0)
    epochs = F.explode(F.sequence(F.lit(0), F.col(f"{mark}times") - 1)) if max_epochs > 1 else F.lit(0)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != epoch_col]
    return taken.select(*kept, epochs.alias(epoch_col or f"{mark}epoch")).drop(f"{mark}epoch")


def source_domain(source: Column) -> Column:
    """A domain of a source name: numbered sources by their last digit, others alone."""
    digit = F.regexp_extract(source, r"([0-9])$", 1)
    return F.when(digit != "", F.concat(F.lit("d"), (digit.cast("int") % 4).cast("string"))).otherwise(source)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens; domains evenly, English three times the other languages, sources evenly; up to two epochs."""
    docs = table(spark, sf_dir, "documents")
    domain = source_domain(F.col("source"))
    langs = docs.select(domain.alias("domain"), "lang").distinct().withColumn("weight", F.when(F.col("lang") == "en", 3.0).otherwise(1.0))
    return mixed(docs, 0.5, {"lang": langs}, domain=domain, max_epochs=2, seed=5).select("doc_id", "lang", "source", "epoch", n_words(F.col("text")).alias("n_tokens"))


QUERIES = {"op5_mixing": op5_mixing}
