"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between different ids → (id, root): the smallest id that each linked id can reach.

    Each step hangs neighbours on smaller ones; the steps end when the links form stars.
    All links stay distributed; the driver sees their number and a checksum.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        last, state = state, _state(edges)
        if state == last:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0L)")).first()
    return row[0], row[1]
