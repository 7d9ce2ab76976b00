"""Hierarchical weighted hash tree: region, rack and shard levels, all in DataFrame expressions.

A row descends from the root. At each level every child draws ``ln(u) / weight`` with ``u`` a hash of
the row's key and the child's name; the child with the largest draw wins. A child's draw depends on
its own weight alone, so a weight change moves rows only into or out of the subtrees it touches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered


@dataclass(frozen=True)
class Shard:
    """A leaf: shard number and weight (its share of the rows against other leaves)."""

    number: int
    weight: float = 1.0


#: region name -> rack name -> leaves
Tree = dict[str, dict[str, list[Shard]]]


def even_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> Tree:
    """Equal leaves filled into racks and regions in order of their number."""
    tree: Tree = {}
    for n in range(shards):
        rack = n // per_rack
        tree.setdefault(f"region{rack // racks_per_region}", {}).setdefault(f"rack{rack}", []).append(Shard(n))
    return tree


def grown_tree(tree: Tree, number: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, hung below the root as a region of its own.

    Every other subtree keeps its weight, so rows move into the new shard and nowhere else.
    """
    return {**tree, f"region+{number}": {f"rack+{number}": [Shard(number, weight)]}}


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.log(u) / F.lit(float(weight))


def _best(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the largest draw; equal draws go to the larger name."""
    if len(children) == 1:
        return children[0][2]
    draws = [F.struct(_draw(key, name, weight).alias("d"), F.lit(name).alias("n"), F.lit(i).alias("i")) for i, (name, weight, _) in enumerate(children)]
    win = F.greatest(*draws)["i"]
    out = F.when(win == 0, children[0][2])
    for i, child in enumerate(children[1:], 1):
        out = out.when(win == i, child[2])
    return out


def tree_shard(key: Column, tree: Tree) -> Column:
    """The shard number of a key. A null key draws like any other value."""
    regions = []
    for region, racks in tree.items():
        below = []
        for rack, leaves in racks.items():
            name = f"{region}/{rack}"
            leaf = _best(key, [(f"{name}/{x.number}", x.weight, F.lit(x.number)) for x in leaves if x.weight > 0])
            below.append((name, sum(x.weight for x in leaves), leaf))
        regions.append((region, sum(w for _, w, _ in below), _best(key, [c for c in below if c[1] > 0])))
    return _best(key, [c for c in regions if c[1] > 0])


def shard_documents(docs: DataFrame, tree: Tree, grown: Tree | None = None, rows_each: int = 1000) -> DataFrame:
    """Place every row of ``docs(doc_id, text)`` by the ``key`` law: doc_id and the tree decide.

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 1), text_crc32, law, shard,
    slot (gapless from 0 in each shard) and grown_shard (the place under ``grown``, null without it).
    Equal texts are placed by their own ids, wherever those lead. Null ids share one place. Repeated
    rows keep their multiplicity and get slots of their own. Other columns are not read. An empty
    table gives an empty result.
    """
    text = F.col("text").cast("binary")
    key = F.col("doc_id")
    rows = docs.select(
        key.cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"),
    )
    rows = rows.withColumn("shard", tree_shard(F.col("doc_id"), tree).cast("int"))
    rows = rows.withColumn("grown_shard", (tree_shard(F.col("doc_id"), grown) if grown else F.lit(None)).cast("int"))
    out = numbered(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot", rows_each)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
