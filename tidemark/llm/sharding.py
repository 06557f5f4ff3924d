"""Hierarchical weighted hash tree: documents descend region, rack and shard."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import ranked


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree; the weight of a rack or region is the sum of its leaves."""

    number: int
    rack: int
    region: int
    weight: float = 1.0


def regular(shards: int, per_rack: int = 2, racks: int = 2) -> list[Shard]:
    """Shards in racks of `per_rack` and regions of `racks` racks, each of weight 1.

    Where the last region is full, one more shard opens a region of its own, so rows only
    move into it. Inside a region that is not full, rows move within the subtrees whose
    weight changes.
    """
    return [Shard(n, n // per_rack, n // (per_rack * racks)) for n in range(shards)]


def _draw(key: Column, level: str, child: int, weight: float) -> Column:
    """Length of a child's straw: ln(u) / weight, u in (0, 1) from a hash of key and child."""
    u = (F.pmod(F.xxhash64(F.lit(f"{level}:{child}"), key), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    return F.log(u) / F.lit(float(weight))


def _longest(key: Column, level: str, weights: dict[int, float]) -> Column:
    """The child with the longest straw; ties go to the smaller number."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    straws = [F.struct(_draw(key, level, c, w).alias("d"), F.lit(-c).alias("c")) for c, w in sorted(weights.items())]
    return -F.greatest(*straws)["c"]


def _descend(key: Column, tree: list[Shard], levels: tuple[str, ...]) -> Column:
    level, rest = levels[0], levels[1:]
    weights: dict[int, float] = {}
    for leaf in tree:
        child = getattr(leaf, level)
        weights[child] = weights.get(child, 0.0) + leaf.weight
    if not rest:
        return _longest(key, level, weights)
    chosen = _longest(key, level, weights)
    out = None
    for child in sorted(weights):
        below = _descend(key, [x for x in tree if getattr(x, level) == child], rest)
        out = F.when(chosen == child, below) if out is None else out.when(chosen == child, below)
    return out


def placement(key: str | Column, tree: list[Shard]) -> Column:
    """Shard of a key. A null key goes where the text `null` goes.

    The draws at a level depend on the key, the child and the child's weight alone: a
    changed weight only moves keys to or from that child, never between its siblings.
    """
    if not tree or any(not (s.weight > 0 and math.isfinite(s.weight)) for s in tree):
        raise ValueError("shards need finite weights above 0")
    c = F.col(key) if isinstance(key, str) else key
    text = F.coalesce(c.cast("string"), F.lit("null"))
    return _descend(text, tree, ("region", "rack", "number")).cast("int")


def sharded(docs: DataFrame, tree: list[Shard], grown: list[Shard], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place rows by their id: size, CRC, shard, gapless slot, and shard in the grown tree.

    Null texts have size 1 and the CRC of nothing; rows with equal ids share a shard and
    take slots in any order; an empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        placement(id_col, tree).alias("shard"),
        placement(id_col, grown).alias("grown_shard"),
    )
    out = ranked(rows, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
