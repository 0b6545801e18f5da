"""Connected components of a table of links, by large-star and small-star steps on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._store import released, settled

MOST_ROUNDS = 60


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets linked to the node's smallest neighbour (itself included)."""
    around = _both(links)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return around.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, get linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # the node itself hangs on m too, so that nothing falls apart
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b); label: the smallest node of its component.

    Null ends and links of a node to itself are left out. Each round's links are a table of the shared folder. An empty
    table gives no rows.
    """
    now = settled(links.select("a", "b").filter("a <> b").distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        last, now = now, settled(_small_star(_large_star(now)), "links")
        released(last)
        # when no step changes anything, each link joins a node with its label; sums that stay tell this
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"links did not settle in {MOST_ROUNDS} rounds")
    label = now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return label.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
