"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Work, cut, join_skewed


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every end of `edges` (columns a, b); root is the smallest node of the component.

    Large-star and small-star steps in turn, a number of rounds that grows with the logarithm of the
    graph; a node that holds a large part of all edges is dealt over several tasks. Only two numbers of each
    round, and nodes that hold over a HEAVY-th part of all edges, reach the driver. Empty edges give an empty table.
    """
    work = Work(edges.sparkSession)
    try:
        now = work.store(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "now-0")
        mark = None
        for i in range(max_rounds):
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = work.store(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")), "least")
            large = join_skewed(both, least, "a", "n").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = work.store(large.where(F.col("a") != F.col("b")).distinct(), "large")
            work.forget("least", f"now-{i}")
            least = work.store(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
            small = join_skewed(large, least, "a", "n").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
            now = work.store(small.where(F.col("a") != F.col("b")).distinct(), f"now-{i + 1}")
            work.forget("least", "large")
            after = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
            if mark == tuple(after):
                break
            mark = tuple(after)
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        return cut(roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
    finally:
        work.drop()
