"""Connected components of a distributed link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every end of links(a, b); ends share a root iff they are connected.

    Each round every vertex takes the neighbour (or itself) that is first in a random
    order and links are contracted to those; the order is drawn anew each round, so the
    number of vertices falls by a constant factor whatever the shape. Tables stay
    distributed and are checkpointed each round. Null ends are ignored.
    """
    links = links.select("a", "b").where("a <> b").distinct().checkpoint()
    placed = None
    seed = 0
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        to = both.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a"))).alias("m"))
        to = to.select(F.col("a").alias("v"), F.col("m.v").alias("root")).checkpoint()
        if placed is None:
            placed = to
        else:
            step = to.select(F.col("v").alias("root"), F.col("root").alias("next"))
            placed = placed.join(step, "root", "left").select("v", F.coalesce("next", "root").alias("root")).checkpoint()
        of = lambda c, out: to.select(F.col("v").alias(c), F.col("root").alias(out))  # noqa: E731, B023
        links = links.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y")
        links = links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().checkpoint()
        seed += 1
    return links.select(F.col("a").alias("v"), F.col("b").alias("root")) if placed is None else placed
