"""What the operators share: reading a table, sizing, checkpoints and components of a graph."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts may be long, so a batch stays small.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches that fit a worker's memory and with a checkpoint folder; both settings stay.

    The folder that the cluster names in spark.checkpoint.dir is used. Only a local session may leave that unset, as in
    tests, and gets a temporary one; elsewhere executors would not share it, so that is a RuntimeError.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; sizes the exchanges that follow."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Edges of a node beyond which it is a hub: fewer nodes than edges / HUB are.
HUB = 10_000
#: So many hubs may be broadcast (at most 60 bytes each).
MOST_HUBS = 1_000_000


def _with_least(both: DataFrame, edges: int) -> tuple[DataFrame, DataFrame]:
    """Of (u, v) in both directions: (u, m) for each node, m being the least of it and its neighbours, and (u, v, m) for each row.

    The rows of hubs get their m where they lie, so that no task has a hub; those of other nodes by a shuffle.
    """
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    if edges > HUB:
        hubs = least.where(F.col("n") > HUB).select("u", "m").checkpoint()
        if 0 < hubs.count() <= MOST_HUBS:
            rest = both.join(F.broadcast(hubs), "u", "left_anti").join(least.drop("n"), "u")
            return least.drop("n"), rest.union(both.join(F.broadcast(hubs), "u"))
    return least.drop("n"), both.join(least.drop("n"), "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (u, v), component being its smallest reachable node.

    Large-star and small-star rounds (Kiveris et al., 2014), each a minimum per node and a join, until no edge
    moves. Edges are kept by checkpoint(), so a lost executor costs one round. A hub's neighbours are pre-aggregated before
    the shuffle, and their rows are joined where they lie. A null end or a loop links nothing; repeated edges count once.
    """
    prepared(edges.sparkSession)

    def state(e: DataFrame) -> tuple:
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = edges.select("u", "v").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = state(e)
    for _ in range(most_rounds if before[0] else 0):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, told = _with_least(both, before[0])
        large = told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = small.select("e.*").where("u != v").distinct().checkpoint()
        now = state(e)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    star = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())
