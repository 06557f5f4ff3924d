"""What text filters remove alone, together and in every order."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import kept_table

FILTERS = "ABCDE"
DUPLICATE = 16  # the bit of E
LEVELS = tuple(16 * 4**k for k in range(12))
RANGE_BYTES = 32 << 20
HELD_BYTES, HELD_ROWS = 48 << 20, 200_000

SIGNS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
NOT_FIRST = bytes(range(128, 192))  # bytes of a code point after its first

MASKED = "doc_id long, part string, mask int, n long, text binary, head binary, hashes array<long>"
FLAGGED = "doc_id long, part string, mask int, n long"


class RadixTrie:
    """Texts in a compressed trie; a terminal holds the smallest id of its text."""

    def __init__(self) -> None:
        self.labels: list[bytes] = [b""]
        self.children: list[dict[int, int]] = [{}]
        self.least: list[int | None] = [None]

    def _node(self, label: bytes, children: dict[int, int]) -> int:
        self.labels.append(label)
        self.children.append(children)
        self.least.append(None)
        return len(self.labels) - 1

    def insert(self, text: bytes, number: int) -> int:
        """The node of the text, the same for equal texts for as long as the trie lives."""
        node, at = 0, 0
        while at < len(text):
            child = self.children[node].get(text[at])
            if child is None:
                leaf = self._node(text[at:], {})
                self.children[node][text[at]] = leaf
                node = leaf
                break
            label = self.labels[child]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same, end = 0, min(len(label), len(text) - at)
            while same < end:
                middle = (same + end + 1) // 2
                if label[same:middle] == text[at + same : at + middle]:
                    same = middle
                else:
                    end = middle - 1
            # The lower part of the edge keeps its node, so nodes handed out stay right.
            upper = self._node(label[:same], {label[same]: child})
            self.labels[child] = label[same:]
            self.children[node][text[at]] = upper
            node, at = upper, at + same
        known = self.least[node]
        self.least[node] = number if known is None else min(known, number)
        return node


def failing(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, NOT_FIRST)))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    mask = 1 if len(words) < 200 else 0
    mask |= 2 if 100 * len(set(words)) < 50 * len(words) else 0
    mask |= 4 if 100 * capitals > 3 * points else 0
    return mask | (8 if len(text.translate(None, SIGNS)) < len(text) else 0)


def prefix_hashes(text: bytes) -> list[int]:
    """Hashes of the text's prefixes by `LEVELS`, up to the one that covers it."""
    out, at, value = [], 0, 0
    for level in LEVELS:
        value = zlib.crc32(text[at:level], value)
        out.append(value)
        at = level
        if level >= len(text):
            return out
    return [*out, zlib.crc32(text[at:], value)]


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of A to D per row; a text that recurs near by leaves with its smallest id only.

    Rows go through tries of some tens of megabytes. A row with a smaller id of its text in the
    same trie fails E already and leaves without its text; the rest goes on with it.
    """

    def done(rows: list[tuple], trie: RadixTrie, texts: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple, int] = {}
        out: list[tuple] = []
        for number, part, mask, node in rows:
            if number is None:
                out.append((None, part, mask, 1, None, None, None))
            elif number > trie.least[node]:
                out.append((number, part, mask | DUPLICATE, 1, None, None, None))
            else:
                first[part, node, mask] = first.get((part, node, mask), 0) + 1
        for (part, node, mask), n in first.items():
            text = texts[node]
            out.append((trie.least[node], part, mask, n, text, text[: LEVELS[0]], prefix_hashes(text)))
        for at in range(0, len(out), 2_000):
            columns = zip(*out[at : at + 2_000], strict=True)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            names = ["doc_id", "part", "mask", "n", "text", "head", "hashes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows, trie, texts, size = [], RadixTrie(), {}, 0
    for batch in batches:
        columns = (batch.column("doc_id"), batch.column("part"), batch.column("text"))
        for number, part, value in zip(*columns, strict=True):
            number, part, text = number.as_py(), part.as_py(), value.as_py() or b""
            mask, node = failing(text), None
            if number is not None:
                node = trie.insert(text, number)
                if node not in texts:
                    texts[node] = text
                    size += len(text)
            rows.append((number, part, mask, node))
            if size > HELD_BYTES or len(rows) >= HELD_ROWS:
                yield from done(rows, trie, texts)
                rows, trie, texts, size = [], RadixTrie(), {}, 0
    yield from done(rows, trie, texts)


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All texts of one range in one trie, then E by the ids at its terminals."""
    trie, kept = RadixTrie(), []
    for batch in batches:
        numbers = batch.column("doc_id").to_pylist()
        nodes = [trie.insert(text.as_py(), number) for text, number in zip(batch.column("text"), numbers, strict=True)]
        kept.append((numbers, nodes, batch.select(["part", "mask", "n"])))
    for numbers, nodes, rest in kept:
        mask = [m | (DUPLICATE if number > trie.least[node] else 0) for m, number, node in zip(rest.column("mask").to_pylist(), numbers, nodes, strict=True)]
        columns = [pa.array(numbers, pa.int64()), rest.column("part"), pa.array(mask, pa.int32()), rest.column("n")]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "mask", "n"])


def _in_prefix_ranges(texts: DataFrame) -> DataFrame:
    """Rows range-partitioned by their prefixes, each as long as its crowd asks for.

    A prefix is crowded if the texts under it hold more than an even share of a range; then the
    next longer one counts, up to the whole text. At most as many prefixes of a length
    are crowded as there are ranges, which bounds what is broadcast.
    """
    spark = texts.sparkSession
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / RANGE_BYTES))
    under = texts.select("head", F.length("text").alias("_bytes"), F.posexplode("hashes").alias("_level", "_hash"))
    sizes = under.groupBy("head", "_level", "_hash").agg(F.sum("_bytes").alias("_bytes"))
    crowded = kept_table(sizes.where(F.col("_bytes") > total / ranges).drop("_bytes"))
    deepest = crowded.agg(F.max("_level")).first()[0]
    depth = F.lit(0)
    for level in range(0 if deepest is None else deepest + 1):
        here = crowded.where(F.col("_level") == level).select("head", F.col("_hash").alias(f"_hash{level}"), F.lit(1).alias(f"_in{level}"))
        texts = texts.withColumn(f"_hash{level}", F.get("hashes", F.lit(level))).join(F.broadcast(here), ["head", f"_hash{level}"], "left")
        depth = depth + F.coalesce(F.col(f"_in{level}"), F.lit(0))
    key = F.get("hashes", F.least(depth, F.size("hashes") - 1))
    keyed = texts.select("doc_id", "part", "mask", "n", "text", "head", key.alias("_key"))
    return keyed.repartitionByRange(ranges, "head", "_key").drop("head", "_key")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): how many rows of an id and part fail which filters, bit 0 for A to bit 4 for E.

    E is found in radix tries: texts are first put together within a task, then
    range-partitioned by adaptive prefixes and inserted whole into one trie a range; a copy at
    a hand's reach never travels, and a text of any number of copies sends one row a task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("binary").alias("text"))
    met = kept_table(rows.mapInArrow(_masked, MASKED))
    flagged = _in_prefix_ranges(met.where("text is not null")).mapInArrow(_flagged, FLAGGED)
    return met.where("text is null").select("doc_id", "part", "mask", "n").union(flagged)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counts per part, filter order (all 120) and step (1 to 5).

    Filters: A under 200 words; B distinct words below half of the words; C more than
    3 capitals A-Z in 100 code points; D any of # $ % & * |; E a text that a smaller id has
    too. Returns part, filter_order, step, and counts of rows: kept (after the step), removed,
    redundant (failing, removed earlier), unique_fails (failing this filter only), good_lost
    and toxic_lost (removed, labelled 1), shapley (removed by the step's filter, summed over
    all orders).

    Null texts are empty, a null part is the empty string. A row without an id never fails E,
    makes none fail, and has no label; rows that repeat an id count each, and are
    no copies of each other. An id with several labels counts as 1 if any of them is. An empty
    table gives no rows; other columns are ignored.
    """
    found = masks(docs, id_col, text_col, part_col).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    one = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"_{c}") for c in ("quality", "toxic")]
    known = labels.select(F.col(id_col).cast("long").alias("_id"), "quality", "toxic").where("_id is not null").groupBy("_id").agg(*one)
    joined = found.join(known, F.col("doc_id") == F.col("_id"), "left")
    reduced = joined.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in ("quality", "toxic")]
    )
    # At most 32 rows a part from here on.
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = reduced.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    fails = {f: F.col("mask").bitwiseAND(1 << i) != 0 for i, f in enumerate(FILTERS)}
    first = F.least(*[F.when(fails[f], F.instr("filter_order", f)).otherwise(len(FILTERS) + 1) for f in FILTERS])
    rows = rows.withColumn("_first", first).withColumn("_filter", F.expr("substring(filter_order, step, 1)"))
    here = reduce(lambda a, b: a | b, [(F.col("_filter") == f) & fails[f] for f in FILTERS])
    many = F.bit_count("mask")
    removed = F.col("_first") == F.col("step")

    def total(of: str, cond) -> F.Column:
        return F.sum(F.when(cond, F.col(of)).otherwise(0))

    return rows.groupBy("part", "filter_order", "step").agg(
        total("n", F.col("_first") > F.col("step")).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", here & (F.col("_first") < F.col("step"))).alias("redundant"),
        total("n", here & (many == 1)).alias("unique_fails"),
        total("quality", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        # First of its k failing filters in 120 / k orders.
        F.sum(F.when(here, F.expr("n * (120 div bit_count(mask))")).otherwise(0)).alias("shapley"),
    ).withColumn("step", F.col("step").cast("int"))
