"""Helpers that the training-data operators share: scratch tables, document
keys and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brook.session import scratch_path, ship_package

# Fixed value: the white space that separates words (and nothing else).
SPACE_CLASS = r"[\x20\x09-\x0D]+"

# Fixed value: stands in for a missing document id in join keys and orders
# (a missing id comes after every other id).
NO_ID = (1 << 63) - 1


def scratch(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the
    lineage, and a lost executor costs a re-read instead of a re-run."""
    spark = spark or df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ready(df: DataFrame) -> SparkSession:
    """The frame's session, with this package shipped to the executors."""
    ship_package(df.sparkSession)
    return df.sparkSession


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, one for each of ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def id_key(id_col: str = "doc_id") -> Column:
    """The document id as a long that can be joined on and ordered: a missing
    id becomes ``NO_ID``."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def text_key(text_col: str = "text") -> Column:
    """A hash of the text; together with ``id_key`` it names a document, so
    repeated rows share one verdict and different texts under one id do not."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull())


def partitions_for(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges``: two long columns ``a`` and ``b``, in any direction, repeats and
    self loops allowed.  Returns ``node, component`` for every node of an edge
    between two different nodes; ``component`` is the smallest node reachable.

    Each round contracts the graph: every node joins the neighbour (or itself)
    of the lowest random priority, and the edges are relabelled.  Priorities
    are hashes, so chains shrink by a constant factor a round and stars vanish
    in two.  Every aggregate combines map-side, so a hub with a third of all
    edges sends one row per task; the relabelling joins have a unique key on
    the other side and can be split by AQE.  Tables, never collected; each
    round ends in written tables, so lost executors cost no earlier round."""
    spark = edges.sparkSession
    e = scratch(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .distinct(), "cc-edges")
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        rank = F.xxhash64("v")
        low = both.groupBy("u").agg(F.min_by("v", rank).alias("v"), F.min(rank).alias("r"))
        step = scratch(low.select("u", F.when(F.col("r") < F.xxhash64("u"), F.col("v")).otherwise(F.col("u"))
                                  .alias("to")), "cc-step")
        if labels is None:
            labels = step.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            labels = labels.join(step, labels.root == step.u, "left").select(
                "node", F.coalesce("to", "root").alias("root"))
        labels = scratch(labels, "cc-labels")
        e = (e.join(step.select(F.col("u").alias("a"), F.col("to").alias("a2")), "a")
              .join(step.select(F.col("u").alias("b"), F.col("to").alias("b2")), "b")
              .where("a2 <> b2")
              .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        e = scratch(e, "cc-edges")
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")
