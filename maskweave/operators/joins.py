"""Join helpers that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# at most this many hot keys are split off and broadcast (a proven size bound)
MAX_HOT_KEYS = 10_000
HOT_KEY_ROWS = 100_000
MAX_BROADCAST_ROWS = 1_000_000


def hot_split_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    hot_rows: int = HOT_KEY_ROWS,
    max_hot: int = MAX_HOT_KEYS,
    parts: int | None = None,
) -> DataFrame:
    """``left ⋈ right`` on ``keys`` where ``right`` has at most one row per key.

    Keys that hold ``hot_rows`` or more left rows (at most ``max_hot`` of them, the
    largest first) are joined by broadcasting their few right rows, so a key that
    holds a third of all rows never lands in one task; the rest is an ordinary
    shuffled join (AQE may still split what remains skewed), over ``parts`` tasks if given.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") >= hot_rows).orderBy(F.col("_n").desc()).limit(max_hot).select(*keys)
    hot = F.broadcast(hot)
    left_hot = left.join(hot, keys, "left_semi")
    left_cold = left.join(hot, keys, "left_anti")
    right_hot = F.broadcast(right.join(hot, keys, "left_semi"))
    if parts is not None:
        left_cold, right = left_cold.repartition(parts, *keys), right.repartition(parts, *keys)
    return left_hot.join(right_hot, keys, how).unionByName(left_cold.join(right, keys, how))


def two_level_rank(df: DataFrame, group_cols: list[str], order_col: str, out: str = "rank") -> DataFrame:
    """Exact ``row_number() over (partition by group order by order_col)`` without
    putting a whole group into one task.

    Range-partition on (group, order), number rows inside each partition, count
    per (partition, group) – at most #partitions + #groups rows – and add the
    running count of the preceding partitions.  The numbered table is written to
    the checkpoint folder first so that partition ids and positions cannot change
    between the two uses (and survive a lost executor).  ``order_col`` must be
    unique within a group.
    """
    ranged = (
        df.repartitionByRange(*group_cols, order_col)
        .sortWithinPartitions(*group_cols, order_col)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    ranged = ranged.checkpoint(eager=True)
    ranged = ranged.withColumn("_li", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    blocks = ranged.groupBy("_pid", *group_cols).agg(
        F.min("_li").alias("_first"), F.count(F.lit(1)).alias("_cnt")
    )
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    # bounded by #partitions + #groups; many small groups (e.g. one scope per
    # session) make it large, so it is broadcast only behind a count
    blocks = blocks.checkpoint(eager=True)
    if blocks.count() <= MAX_BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    return (
        ranged.join(blocks, ["_pid", *group_cols])
        .withColumn(out, (F.col("_off") + F.col("_li") - F.col("_first") + 1).cast("long"))
        .drop("_pid", "_mid", "_li", "_first", "_cnt", "_off")
    )
