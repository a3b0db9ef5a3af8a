"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import Scratch, stage


# The smallest neighbour of every vertex is written before it is joined to the edges: then adaptive execution can split the
# edges of a vertex that has very many.
def _large_star(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = scratch.stage(both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low")), label)
    return both.filter("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """A vertex and its smaller neighbours are tied to the smallest of them. Edges run from large to small."""
    low = scratch.stage(edges.groupBy("src").agg(F.min("dst").alias("low")), label)
    moved = edges.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.filter("src <> dst").unionByName(low.withColumnRenamed("low", "dst")).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first())


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, component) of every vertex that has an edge; the component is its smallest vertex.

    ``edges`` has comparable columns src and dst; nulls, self-loops, repeats and direction do not
    matter. Rounds are written to the shared checkpoint folder, as is the result; only a count and a hash of
    the edges come to the driver. The number of rounds grows with the logarithm of the vertices.
    """
    with Scratch(edges.sparkSession) as scratch:
        return stage(_rounds(edges, scratch, label), f"{label}-components")


def _rounds(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    edges = scratch.stage(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
                  .filter("src <> dst").distinct(), label)
    now = _print(edges)
    while now[0]:
        large = scratch.stage(_large_star(edges, scratch, label), label)
        edges = scratch.stage(_small_star(large, scratch, label), label)
        before, now = now, _print(edges)
        if now == before:
            break
    # a star forest: each vertex has one edge, to its smallest
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(
        edges.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())
