"""Connected components of a link table, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.storage import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Stars are contracted in turns: first every node hands its larger neighbours to its smallest one, then
    its smaller neighbours, until nothing changes. Minima are aggregated before they are joined, so that a
    node with very many links is not gathered in one task. Each round is cut by a checkpoint.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = cut(links.select(u, v).where("u <> v").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = state(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle: raise most_rounds")
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def component_keys(prints: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """For each distinct ``fp`` of ``prints`` (``key``, ``fp``): the smallest key of its component by ``links`` between them."""
    fps = prints.groupBy("fp").agg(F.min(key).alias("own"))
    found = connected_components(links).select(F.col("node").alias("fp"), "component")
    labelled = fps.join(found, "fp", "left")
    best = labelled.where("component is not null").groupBy("component").agg(F.min("own").alias("best"))
    return labelled.join(best, "component", "left").select("fp", F.coalesce("best", "own").alias("component_id"))
