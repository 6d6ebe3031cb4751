"""Connected components of an edge table, as alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` for every node that has an edge and is not itself a root; root = smallest node reachable.

    Each round is joins and grouped minima, written to the shared folder; only an edge count and a
    checksum reach the driver. Stars stay stars, so the number of rounds grows with the logarithm
    of a component's size. Null ends and self-loops are ignored.
    """
    now = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    before = None
    while (state := _state(now)) != before:
        now, before = saved(_small_star(_large_star(now)), "stars"), state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(mixed), F.sum(F.shiftright(mixed, 20))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # repeated edges are removed once, after the small star
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(rest).distinct()
