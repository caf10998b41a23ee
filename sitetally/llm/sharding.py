"""Sharding by a hierarchical weighted hash tree.

Shards are the leaves of a tree of regions and racks. A document goes down from the root: at each node every child draws
an exponential arrival time from a hash of the document and the child, with the weight of all shards below as its rate, and
the earliest child is taken, so each with a chance in proportion to its weight. A child whose weight changes moves documents
between itself and its siblings only, and below a node whose children keep their weights nothing moves: movement is
confined to the subtrees whose weights change. A new shard in a subtree of its own (`grow`) only takes documents; put into
an old rack it also makes that rack and its region heavier, and documents that enter those may settle on its neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import number_within

#: Shards of a rack and racks of a region in the default tree.
RACK_SHARDS = 4
REGION_RACKS = 2


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    number: int
    weight: float = 1.0


def uniform_tree(shards: int, rack_shards: int = RACK_SHARDS, region_racks: int = REGION_RACKS) -> list[Shard]:
    """Shards 0 to shards - 1 of weight 1, racks and regions filled in order; one more shard leaves the others where they are."""
    return [Shard(n // (rack_shards * region_racks), n // rack_shards, n) for n in range(shards)]


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard in a region and a rack of its own: it takes documents from all others, and no other gets any."""
    return [*tree, Shard(max(s.region for s in tree) + 1, max(s.rack for s in tree) + 1, max(s.number for s in tree) + 1, weight)]


def _children(tree: list[Shard], parent: str, child: str) -> dict[int, dict[int, float]]:
    found: dict[int, dict[int, float]] = {}
    for s in tree:
        if s.weight > 0:
            below = found.setdefault(getattr(s, parent) if parent else 0, {})
            below[getattr(s, child)] = below.get(getattr(s, child), 0.0) + s.weight
    return found


def chance(key: Column, level: str, node: int) -> Column:
    """A uniform number in (0, 1) of a key at a node, from the leading 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"@{level}{node}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _earliest(weights: dict[int, float], drawn) -> Column:
    """The node with the earliest draw; the lower number of equals."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    return F.least(*(F.struct((-F.ln(drawn(n)) / F.lit(float(w))).alias("at"), F.lit(n).alias("node")) for n, w in sorted(weights.items())))["node"]


def _below(key: Column, tree: list[Shard], region: Column) -> Column:
    """The shard of a key whose region is known: the draws of that region's racks, then of the rack's shards."""
    racks, shards = _children(tree, "region", "rack"), _children(tree, "rack", "number")

    def shard(rack: Column, of: list[int]) -> Column:
        chosen = F.lit(None).cast("int")
        for r in of:
            chosen = F.when(rack == r, _earliest(shards[r], lambda n: chance(key, "shard", n))).otherwise(chosen)
        return chosen

    chosen = F.lit(None).cast("int")
    for g, weights in racks.items():
        chosen = F.when(region == g, shard(_earliest(weights, lambda n: chance(key, "rack", n)), list(weights))).otherwise(chosen)
    return chosen.cast("int")


def with_shard(df: DataFrame, key: str, tree: list[Shard], name: str, grown: list[Shard] | None = None, grown_name: str = "grown_shard") -> DataFrame:
    """df with the key's shard in the tree, and in a changed tree if there is one; rows without a key share one draw.

    Both trees use the same draws: a key that stays in a region where nothing changed isn't drawn for again. Uses a column _chances
    meanwhile. A key takes a digest per region, per rack of its region and per shard of its rack.
    """
    trees = [tree] if grown is None else [tree, grown]
    tops = [_children(t, "", "region")[0] for t in trees]
    every = sorted(set().union(*tops))
    drawn = df.withColumn("_chances", F.struct(*(chance(F.col(key), "region", r).alias(f"r{r}") for r in every)))
    regions = [_earliest(top, lambda r: F.col(f"_chances.r{r}")) for top in tops]
    out = drawn.withColumn("_region", regions[0]).withColumn(name, _below(F.col(key), tree, F.col("_region")))
    if grown is not None:
        of = lambda t, r: sorted((s.rack, s.number, s.weight) for s in t if s.region == r and s.weight > 0)
        same = [r for r in every if of(tree, r) == of(grown, r)]
        stays = (F.col("_region") == F.col("_grown")) & F.col("_region").isin(same) if same else F.lit(False)
        out = out.withColumn("_grown", regions[1]).withColumn(grown_name, F.when(stays, F.col(name)).otherwise(_below(F.col(key), grown, F.col("_grown")))).drop("_grown")
    return out.drop("_chances", "_region")


def shard_documents(docs: DataFrame, tree: list[Shard], grown: list[Shard] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) of every row.

    doc_id and the tree decide the shard, so repeated rows meet in one shard with slots of their own; slots are gapless
    from 0 in each shard, in the order of a hash of doc_id. size: UTF-8 bytes plus 1; a null text has none, and its
    checksum is that of the empty text. Rows with a null doc_id go to one shard. Other columns are not read.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = with_shard(rows, "doc_id", tree, "shard", grown)
    if grown is None:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    numbered = number_within(rows, ["shard"], F.xxhash64("doc_id"), ["doc_id", "size", "text_crc32"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")
