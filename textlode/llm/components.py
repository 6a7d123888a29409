"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.plans.storage import new_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node to the smallest of them and itself."""
    if large:
        pairs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if large:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return linked.where("u <> v").distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).head()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with an edge to another.

    ``edges`` has two columns of one orderable type.  Alternating large-star and
    small-star steps (Kiveris et al., 2014) run until nothing changes; each is
    an aggregation and a join, so a node of any degree is spread over tasks.
    No edges give no rows.
    """
    u, v = edges.columns
    edges = stored(
        edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "edges"
    )
    before = _signature(edges)
    while before[0]:
        edges = stored(_star(_star(edges, large=True), large=False), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
