"""Connected components by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import keep


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Hangs neighbours on the smallest of them: those above a node (``both``: the node's
    links in both directions are looked at) or the node and all below it."""
    links = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        links = links.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    hung = links.join(least.withColumn("m", F.least("u", "m")), "u")
    if both:
        return hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    lower = hung.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(hung.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``node, root``: every node of ``edges`` (``a, b``) with the smallest of its component.

    Links of a node to itself, repeated links and an empty table are fine; a component of
    n nodes needs about log(n) rounds. Each round is written to the shared folder.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, before = keep(clean.distinct(), "edges"), None
    for _ in range(max_rounds):
        now = keep(_stars(_stars(now, True), False), "edges")
        found = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if found == before:
            break
        before = found
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
