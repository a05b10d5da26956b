"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends the tree.  On each level every child draws from a hash of the row's key and
the child's own name; the draw is scaled by the child's weight (``-ln(u) / weight``) and the
smallest wins, so a child is chosen in proportion to its weight.  A draw depends on nothing
but the key, the child's name and its weight: when weights change below one node, rows move
only among that node's children and, if its total changes, between it and its siblings.
``grow`` adds a shard as a region of its own, so all that moves, moves into the new shard.

Only built-in column functions are used.  The tree is part of the expression, so it is for
trees of up to some hundred nodes; the rows may be any number.

Defined cases: a null key draws as the empty text; equal keys share a shard; null text has
size 1 and the checksum of no bytes; zero weights are never drawn; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.ranks import rank_in_key

RACKS, SHARDS_PER_RACK = 2, 2


@dataclass(frozen=True)
class Node:
    """An inner node has children; a leaf has a shard number."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = ()
    shard: int = -1

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight

    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]


def planned(shards: int, racks: int = RACKS, per_rack: int = SHARDS_PER_RACK) -> Node:
    """A tree of ``shards`` equal leaves in regions of ``racks`` x ``per_rack``."""
    regions: dict[int, dict[int, list[Node]]] = {}
    for s in range(shards):
        region, rest = divmod(s, racks * per_rack)
        regions.setdefault(region, {}).setdefault(rest // per_rack, []).append(Node(f"shard{s}", shard=s))
    return Node("root", children=tuple(
        Node(f"region{r}", children=tuple(Node(f"region{r}/rack{k}", children=tuple(v)) for k, v in ks.items()))
        for r, ks in regions.items()))


def grow(tree: Node, weight: float = 1.0) -> Node:
    """One more shard, in a region and rack of its own."""
    n = max(x.shard for x in tree.leaves()) + 1
    region = f"region+{n}"
    leaf = Node(f"shard{n}", weight, shard=n)
    return Node(tree.name, children=(*tree.children, Node(region, children=(Node(f"{region}/rack0", children=(leaf,)),))))


def _draw(key: Column, node: Node) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11).cast("double")
    u = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(node.total))


def shard_of(key: Column, tree: Node) -> Column:
    """Shard number of a key: one draw per child on the way down."""
    if not tree.children:
        return F.lit(tree.shard)
    live = [c for c in tree.children if c.total > 0]
    if len(live) == 1:
        return shard_of(key, live[0])
    if all(not c.children for c in live):
        draws = [F.struct(_draw(key, c).alias("d"), F.lit(c.shard).alias("s")) for c in live]
        return F.array_min(F.array(*draws)).getField("s")
    draws = [F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)]

    def below(won: Column) -> Column:
        out = F.when(won == 0, shard_of(key, live[0]))
        for i, c in enumerate(live[1:], 1):
            out = out.when(won == i, shard_of(key, c))
        return out
    return F.element_at(F.transform(F.array(F.array_min(F.array(*draws)).getField("i")), below), 1)


def assign(docs: DataFrame, tree: Node, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row."""
    return docs.withColumn(out, shard_of(F.coalesce(F.col(key).cast("string"), F.lit("")), tree).cast("int"))


def placed(docs: DataFrame, tree: Node) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, shard, slot, grown_shard.

    ``slot`` is the row's gapless place in its shard; texts are not shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = assign(assign(docs, tree), grow(tree), out="grown_shard").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        "shard", "grown_shard")
    share = -(-docs.count() // len(tree.leaves()))
    return rank_in_key(rows, ["shard"], F.coalesce("doc_id", F.lit(-1)), ["doc_id", "size", "text_crc32"], share, "slot")
