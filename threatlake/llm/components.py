"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlake import session


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours; edges are (u, v)."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that is not the smallest of its component.

    Alternates large and small stars: each node hangs its larger neighbours, then its smaller
    ones, on the smallest it knows, until no edge moves; the number of rounds grows with the
    logarithm of the longest path.  Minima are combined before each shuffle, and the joins have
    one row per node on one side, so that a node with very many links can be split.  Every round
    is written to the shared folder.  Links with a null end, and of a node to itself, are left out.
    """
    now = session.land(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("real"))
        .filter("real").select("u", "v").distinct(), "links")
    before, state = None, _state(now)
    while state != before:
        both = now.union(now.select("v", "u"))
        large = both.join(_least_neighbour(both), "u").filter("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = _least_neighbour(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
        now = session.land(small.filter("u <> v").distinct(), "links")
        before, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def with_component(rows: DataFrame, node: str, found: DataFrame) -> DataFrame:
    """Adds the component of column `node`; a node without links is its own."""
    renamed = found.select(F.col("node").alias(node), "component")
    return rows.join(renamed, node, "left").withColumn("component", F.coalesce("component", node))
