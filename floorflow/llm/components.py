"""Connected components by alternating large-star and small-star.

Every round is two aggregations and joins on Spark; the edges are written to
the shared folder between rounds, so no lineage grows, nothing is collected to
the driver, and a lost executor costs one round's tasks at most.  A node with
very many neighbours is met by a map-side ``min`` and by a join that adaptive
execution may split, never by a list of its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MAX_ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ).distinct()


def _small(edges: DataFrame) -> DataFrame:
    # edges point from the larger node u to the smaller v
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: u, v (long).  Returns node, component (its smallest node) for
    every node with an edge.  Self links, nulls and repeated edges are ignored;
    an empty table gives an empty table."""
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    mark = None
    for _ in range(MAX_ROUNDS):
        last, now = now, materialize(_small(_large(now)), "edges")
        discard(last)
        row = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if mark == (row.n, row.h):
            break
        mark = (row.n, row.h)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
