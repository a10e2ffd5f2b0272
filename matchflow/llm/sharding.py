"""Sharding by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards, and every inner node weighs what its shards weigh. A key descends from the root:
at each level every child draws -ln(u) / weight, where u is a hash of the key and the child's name, and the
least draw is taken. So a child is met in proportion to its weight; if its weight rises, keys come to it from its
siblings, if it falls, keys leave it for them, and no other two siblings exchange any. Below a node whose keys and children's
weights stay, nothing moves: movement is confined to the subtrees whose weights change, and to what they take in or give off.

A shard that is added alone becomes a region with one rack of its own (`grown`): as no other weight changes, it takes rows
only into itself. The first shards of `even_tree` fill SHARDS_A_RACK a rack and RACKS_A_REGION a region.

Slots number a shard's rows without gaps, in the order of a hash of their id, size and checksum. Rows are dealt to buckets of
that hash, whose counts are added up before them; rows that agree in everything are counted first and numbered together,
so no id, text or group of copies gathers in a task.

Results: a null text has size 1 and the checksum of an empty one; a null id draws as an empty one; repeated ids
share their shard and have a slot each; texts of any length are used whole; an empty table gives no rows; columns
beside doc_id and text are not read. Which of equal rows gets which of their slots makes no difference.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchflow.llm.common import texts

SHARDS_A_RACK, RACKS_A_REGION = 2, 2
#: Rows of one bucket of slots, and equal rows that are written out together.
BUCKET_ROWS, CHUNK_ROWS = 50_000, 10_000


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree."""

    number: int
    region: str
    rack: str
    weight: float = 1.0


def even_tree(shards: int) -> list[Shard]:
    """Shards of equal weight in full racks and regions."""
    return [Shard(k, f"r{k // (SHARDS_A_RACK * RACKS_A_REGION)}", f"k{k // SHARDS_A_RACK}") for k in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, a region of its own."""
    number = max((s.number for s in tree), default=-1) + 1
    return [*tree, Shard(number, f"own{number}", f"own{number}", weight)]


def children(tree: list[Shard]) -> dict[str, list[dict]]:
    """For each inner node's name its children's names, shard numbers and weights; the root's name is empty."""
    weights: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    numbers = {}
    for s in tree:
        region, rack, shard = s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.number}"
        for above, below in (("", region), (region, rack), (rack, shard)):
            weights[above][below] += s.weight
        numbers[shard] = s.number
    return {above: [{"node": n, "weight": w, "shard": numbers.get(n, -1)} for n, w in sorted(below.items())] for above, below in weights.items()}


def draw(key: Column, node: Column, weight: Column) -> Column:
    """-ln(u) / weight, u from 52 bits of the MD5 of key and node: exponential, the least of several is met by weight."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), node)), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / 2.0**52) / weight


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard number that a text key descends to."""
    if not tree or min(s.weight for s in tree) <= 0:
        raise ValueError("a tree has shards, all of a positive weight")
    below = F.from_json(F.lit(json.dumps(children(tree))), "map<string, array<struct<node: string, weight: double, shard: int>>>")
    least = lambda node: F.array_min(F.transform(below[node], lambda c: F.struct(draw(key, c.node, c.weight).alias("draw"), c.node.alias("node"), c.shard.alias("shard"))))
    region = least(F.lit("")).node
    return least(least(region).node).shard


def with_slots(rows: DataFrame, total: int) -> DataFrame:
    """rows with `slot`, gapless from 0 in each shard. Columns: doc_id, size, text_crc32, shard and others that doc_id decides."""
    buckets = max(1, -(-total // BUCKET_ROWS))
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size"))
    bucket = F.shiftright(F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") * buckets, 32).cast("int")
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n")).withColumn("__order", order).withColumn("__bucket", bucket)
    within = Window.partitionBy("shard", "__bucket").orderBy("__order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row for each bucket of a shard
    sums = counted.groupBy("shard", "__bucket").agg(F.sum("__n").alias("__of"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__of").over(before), F.lit(0))).drop("__of")
    placed = counted.withColumn("__to", F.sum("__n").over(within)).join(offsets, ["shard", "__bucket"]).withColumn("slot", F.col("__before") + F.col("__to") - F.col("__n"))
    alone = placed.filter("__n = 1").select(*rows.columns, "slot")
    chunks = placed.filter("__n > 1").select(*rows.columns, "slot", "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(CHUNK_ROWS).cast("long"))).alias("__from"))
    spread = chunks.repartition("slot", "__from").withColumn("__k", F.explode(F.sequence("__from", F.least(F.col("__from") + CHUNK_ROWS, F.col("__n")) - 1)))
    return alone.unionByName(spread.withColumn("slot", F.col("slot") + F.col("__k")).select(*rows.columns, "slot"))


def sharded(docs: DataFrame, tree: list[Shard]) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot, and grown_shard, the shard in the grown tree."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = texts(docs).select(
        "doc_id",
        (F.octet_length("text").cast("long") + 1).alias("size"),
        F.crc32("text").alias("text_crc32"),
        shard_of(key, tree).alias("shard"),
        shard_of(key, grown(tree)).alias("grown_shard"),
    )
    return with_slots(rows, docs.select("doc_id").count())
