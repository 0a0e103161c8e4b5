"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.store import materialize


def components(links: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, component): each node of ``links`` with the smallest node of its component.

    Alternating large-star and small-star steps: each is one grouping by node, so a hub's partners are never gathered
    in one task, and the number of rounds grows with the logarithm of the longest path. Rows with a null end are
    ignored; an empty table gives an empty result. Raises if ``rounds`` don't suffice.
    """
    edges = (
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .selectExpr("greatest(u, v) u", "least(u, v) v")
        .distinct()
    )
    edges = materialize(edges, "links")
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.distinct()
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low2, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        new = materialize(small, "links")
        changed = new.exceptAll(edges).limit(1).count() or edges.exceptAll(new).limit(1).count()
        edges = new
        if not changed:
            break
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
