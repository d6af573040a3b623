"""Connected components by alternating large-star and small-star rounds.

Links never reach the driver: each round is two grouped minima and two joins,
and its result is checkpointed in the shared folder. Rounds end when the edge
set stops changing, which takes about log(longest path) of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm._shared import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Large: a node's larger neighbours go to its least neighbour; small: the smaller ones do."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("w"), "m")
        joined = edges.join(least, F.col("a") == F.col("w"))
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the least node reachable.

    ``edges`` has two long columns in any order and direction; loops and repeats
    are ignored, null ends are dropped. No links give an empty table.
    """
    x, y = edges.columns[:2]
    now = durable(
        edges.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y)))
        .select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
        .distinct()
    )
    state = None
    for _ in range(most_rounds):
        now = durable(_star(_star(now, large=True), large=False))
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = tuple(sums)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
