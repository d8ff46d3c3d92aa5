"""Connected components of a large edge table, by alternating large-star and small-star rounds (Kiveris et al. 2014).

Both kinds of round take a minimum per node, which Spark combines before the shuffle, and join it back to the edges, a
join that adaptive execution can split where one node has very many edges. Nothing is gathered on the driver but two
numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v, both long): root is the smallest node it is linked to, itself included.

    Loops and repeated edges do no harm; edges with a null end are left out; no edges give no rows.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    edges = written(edges.distinct())
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = written(small)
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
