"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import kept_table


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b) of longs to (node, root): root is the smallest node reachable.

    Every round points each node to its smallest neighbour, follows the pointers two
    steps, and replaces the nodes of the remaining edges by what they point to. Edges
    inside one contracted node vanish, so the edge table shrinks until it is empty; stars
    of any size take one round. The minimum per node is pre-aggregated. Rows with a null
    end and self-links are ignored; repeated links are harmless; no links give no rows.
    """
    ends = edges.where("a <> b").select("a", "b")
    both = kept_table(ends.union(ends.select("b", "a")).distinct())
    maps: list[DataFrame] = []
    while not both.isEmpty():
        near = both.groupBy("a").agg(F.min("b").alias("_b"))
        first = kept_table(near.select(F.col("a").alias("node"), F.least("a", "_b").alias("up")))
        up = first.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
        for _ in range(2):
            first = first.join(up, first["up"] == up["_node"], "left").select(
                "node", F.coalesce("_up", "up").alias("up")
            )
        step = kept_table(first)
        maps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("up").alias("_a"))
        right = step.select(F.col("node").alias("b"), F.col("up").alias("_b"))
        moved = both.join(left, "a").join(right, "b").where("_a <> _b")
        both = kept_table(moved.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    if not maps:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0]
    for step in maps[1:]:
        nxt = step.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
        out = out.join(nxt, out["up"] == nxt["_node"], "left").select("node", F.coalesce("_up", "up").alias("up"))
    return kept_table(out.select("node", F.col("up").alias("root")))


STAR_ROUNDS = 2


def shared_buckets(entries: DataFrame) -> DataFrame:
    """Entries (bucket, node, ...) of the buckets that hold two nodes or more."""
    shared = entries.groupBy("bucket").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo < _hi")
    return entries.join(shared.select("bucket"), "bucket")


def bucket_components(entries: DataFrame, marks: list[str], close: str, confirmed: Callable[[DataFrame], DataFrame],
                      remaining: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of the links between nodes that share a bucket; unlinked nodes are left out.

    `entries` has bucket, node and the columns `marks`; `close` is SQL over a node's marks
    and another's (`other_<mark>`), symmetric and true for every link; `confirmed` keeps the
    rows of (a, b) that are links.

    A bucket is not expanded into all pairs. Its members are compared with one head (first
    the smallest node, then one by a hash that differs between buckets, then the one with
    the most links so far), unless already connected with it, and links merge components. What
    is still in different components after that and passes `close` is compared pair by
    pair, in one of the buckets a pair shares, so in the end every pair of a bucket is
    connected or known to be no link.
    """

    def other(rows: DataFrame, *extra: str) -> DataFrame:
        return rows.select("bucket", F.col("node").alias("other"), *[F.col(m).alias(f"other_{m}") for m in (*marks, *extra)])

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()

    picked = F.min(F.struct("node", *marks)).alias("_head")
    heads = other(entries.groupBy("bucket").agg(picked).select("bucket", "_head.*"))
    tried = kept_table(ends(entries.join(heads, "bucket").where("node <> other").where(close)))
    found = kept_table(confirmed(tried))
    roots = components(found)
    for turn in range(1, STAR_ROUNDS + 2):
        known = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = known.groupBy("bucket").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select("bucket")
        rest = kept_table(known.join(split, "bucket"))
        if turn <= STAR_ROUNDS:
            links = found.select(F.explode(F.array("a", "b")).alias("_of")).groupBy("_of").agg(F.count(F.lit(1)).alias("_links"))
            counted = rest.join(links, F.col("node") == F.col("_of"), "left")
            by_hash = F.xxhash64("node", "bucket")
            counted = counted.withColumn("_few", by_hash if turn == 1 else -F.coalesce("_links", F.lit(0)))
            picked = F.min(F.struct("_few", "node", "root", *marks)).alias("_head")
            heads = other(counted.groupBy("bucket").agg(picked).select("bucket", "_head.*"), "root")
            pairs = rest.join(heads, "bucket").where("root <> other_root").where(close)
        elif remaining:
            return components(found.union(kept_table(remaining(rest))))
        else:
            lists = rest.groupBy("node").agg(F.collect_list("bucket").alias("shares"))
            listed = rest.join(lists, "node")
            pairs = listed.join(other(listed, "root", "shares"), "bucket").where("node < other and root <> other_root")
            pairs = pairs.where(close).where("array_min(array_intersect(shares, other_shares)) = bucket")
        fresh = kept_table(ends(pairs).join(tried, ["a", "b"], "left_anti"))
        more = kept_table(confirmed(fresh))
        if not more.isEmpty():
            found = found.union(more)
            roots = components(found)
        tried = tried.union(fresh)
    return roots
