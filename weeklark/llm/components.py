"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to its smallest neighbour (or itself)."""
    both = links.union(links.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node ties its smaller neighbours, and itself, to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
    over = links.join(least, F.col("u") == F.col("n"))
    return over.select(F.col("v").alias("u"), F.col("m").alias("v")).union(over.select("u", F.col("m").alias("v"))).filter("u > v")


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (two bigint columns); component is the smallest node that it reaches.

    Each round is written to the shared folder, which cuts the lineage; only
    a count and a checksum reach the driver. The number of rounds grows with
    the logarithm of the number of nodes.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    kept = scratch.write(edges, f"{name}-0")
    state, n = None, 0
    while True:
        now = tuple(kept.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state or not now[0]:
            break
        state, n = now, n + 1
        after = scratch.write(_small_star(_large_star(kept).distinct()).distinct(), f"{name}-{n}")
        scratch.drop(f"{name}-{n - 1}")
        kept = after
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).union(kept.select("v", "v").distinct())
