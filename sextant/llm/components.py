"""Connected components of an edge table, as alternating star contractions.

Every round is two shuffles of narrow rows with map-side minima; no group of
neighbours is ever collected.  Rounds are written to the shared folder, so
lineage stays one round deep, and a round's table goes when the next is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import materialise, release

MAX_ROUNDS = 60


def _oriented(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to its smallest neighbour (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges (columns a and b) but the roots:
    root is the smallest node that can be reached.  Loops and repeated edges are
    allowed; no edges give no rows."""
    now = materialise(edges.filter(F.col("a") != F.col("b")).select(*_oriented(F.col("a"), F.col("b"))).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        last, now = now, materialise(_small_star(_large_star(now)), "stars")
        release(last)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or new[0] == 0:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out.__dict__["scratch_path"] = now.__dict__.pop("scratch_path")
            return out
        mark = new
    raise RuntimeError("components did not converge")
