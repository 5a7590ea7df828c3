"""Sharding by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards, each with a weight. A row descends the tree: at each node every
child draws ``-ln(u) / weight`` from a hash of the row's key and the child's name, and the smallest draw
wins. A child is chosen in proportion to its weight, and a change of weights moves rows only into or out
of the subtrees whose weights changed. A shard that is added as a branch of its own takes rows only into
itself, so the law of the assignment is ``key``.

Edges: a null key hashes like any other value, so that its rows land together; a null text has no bytes
and the checksum of the empty string; an empty table gives an empty result; repeated rows get slots of
their own; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.storage import read


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def shard_tree(shards: int = 40, per_rack: int = 5, per_region: int = 20) -> list[Leaf]:
    """Shards 0 to shards - 1 in racks and regions of equal size."""
    return [Leaf(f"region{s // per_region}", f"rack{s // per_rack}", s) for s in range(shards)]


def add_shard(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a rack and region of its own: no other node's weight changes."""
    new = max((leaf.shard for leaf in tree), default=-1) + 1
    return [*tree, Leaf(f"region-of-shard{new}", f"rack-of-shard{new}", new, weight)]


def _winner(key: Column, children: Column) -> Column:
    """The name of the child (struct of name and weight) whose draw -ln(u) / weight is smallest."""

    def draw(child: Column) -> Column:
        # 52 bits of the hash, so that u lies strictly between 0 and 1.
        u = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["name"].alias("name"))

    return F.array_min(F.transform(children, draw))["name"]


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard of a key; the tree alone and the key decide. Leaves of weight 0 take nothing."""
    live = [leaf for leaf in tree if leaf.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for leaf in live:
        path = ["", leaf.region, f"{leaf.region}/{leaf.rack}", f"{leaf.region}/{leaf.rack}/{leaf.shard}"]
        for level, parent, child in zip(levels, path, path[1:], strict=False):
            own = level.setdefault(parent, {})
            own[child] = own.get(child, 0.0) + leaf.weight
    at = F.lit("")
    for level in levels:
        # Literals only: the optimizer folds each level's map into one constant.
        nodes = F.create_map(*(x for parent, own in level.items() for x in (F.lit(parent), F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in own.items())))))
        at = _winner(key, F.element_at(nodes, at))
    return F.substring_index(at, "/", -1).cast("int")


def assign_shards(df: DataFrame, key: str, tree: Sequence[Leaf], buckets: int | None = None) -> DataFrame:
    """Adds ``shard`` and ``slot``: the row's place in its shard, gapless from 0, by hash bucket and key.

    A shard may hold more rows than one task should sort, so that slots are counted in two steps:
    rows by (shard, bucket) from a scan of the key and number columns, then ranks inside a bucket. Buckets are
    of all these columns, so that the rows of one key (a null id) are sorted in many tasks, but for those equal in all of them.
    """
    buckets = buckets or max(1, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // len(tree))
    df = df.drop("shard", "slot", "_bucket", "_rank", "_start")
    shard = shard_of(F.col(key), tree)
    order = [F.col(key)] + [F.col(c) for c in df.columns if c != key and df.schema[c].dataType.simpleString() in ("bigint", "int")]
    bucket = F.pmod(F.xxhash64(F.lit("slot"), *order), F.lit(buckets)).cast("int")
    placed = df.withColumn("shard", shard).withColumn("_bucket", bucket)
    # At most shards * buckets rows, the bound under which it is broadcast.
    counts = df.select(shard.alias("shard"), bucket.alias("_bucket")).groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(*order))
    return (
        placed.withColumn("_rank", rank)
        .join(F.broadcast(starts), ["shard", "_bucket"])
        .withColumn("slot", F.col("_start") + F.col("_rank") - 1)
        .drop("_bucket", "_rank", "_start")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    tree = shard_tree(40)
    return (
        assign_shards(rows, "doc_id", tree)
        .withColumn("law", F.lit("key"))
        .withColumn("grown_shard", shard_of(F.col("doc_id"), add_shard(tree)))
        .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    )
