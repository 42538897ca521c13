"""Connected components by alternating large and small stars: every step is an equi-join or an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, new_path, remove


def _star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(least, "a")
    small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of every node of ``edges`` (a, b: long).

    Loops and repeated edges change nothing; nodes without an edge to another
    node are left out. The edges in hand are written to the shared folder after
    each round, and the last round is known by its count and checksum.
    """
    spark = edges.sparkSession
    state = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).alias("s")
    current = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = new_path(spark, "edges")
    current = materialize(current, "edges", path)
    before = current.select(state).first().s
    while before.n:
        after_path = new_path(spark, "edges")
        following = materialize(_star(current), "edges", after_path)
        after = following.select(state).first().s
        remove(spark, path)
        current, path = following, after_path
        if after == before:
            break
        before = after
    stars = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())
