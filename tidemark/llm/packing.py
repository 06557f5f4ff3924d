"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import kept_table

END = 2
RANGE_ROWS = 100_000
CLASSES = 8  # of lengths: each is packed by rounds of its own, the longest first
CACHED_UNITS = 300_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# White space that needs the whole text: two in a row, at either end, or other than space and line feed.
_ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]|[ \n][ \n]|^[ \n]|[ \n]\Z")


class Encoder:
    """Ids of byte-level BPE as little-endian 32-bit bytes, cached by word.

    The ranks file holds the vocabulary and merges of the tokenizer's JSON file, so both
    give the same ids; the strings of special tokens are ordinary text. No token spans a
    single space or line feed and the character before it, so a text without odd white
    space is the sum of its words, each with the space before it.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        outer = self

        class Cache(dict):
            def __missing__(self, unit: str) -> bytes:
                ids = outer.whole(unit if unit[:1] == "\n" else " " + unit)
                if len(self) < CACHED_UNITS and len(unit) < 64:
                    self[unit] = ids
                return ids

        self.cache = Cache()

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text or _ODD_SPACE.search(text):
            return self.whole(text)
        units = text.replace("\n", " \n").split(" ")
        return self.whole(units[0]) + b"".join(map(self.cache.__getitem__, units[1:]))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, pattern)
    return _ENCODERS[key]


def pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts, add the end id, cut what is longer than `capacity`.

    All pieces but the first have `capacity` ids. A null text is empty: the end id alone.
    Repeated rows and null ids give pieces of their own; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks_path, pattern)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py() or "") + end)
                n = len(ids) // 4
                start, k = 0, 0
                stop = (n - 1) % capacity + 1
                while start < n:
                    for column, value in zip(out, (doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                        column.append(value)
                    start, stop, k = stop, stop + capacity, k + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES)


PLACED, LEFT, GAP = 0, 1, 2
STATE = "kind int, id long, length long, seq long, room long, ord long"


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of pieces and gaps, largest first: every piece takes the smallest gap before it that no later piece has taken.

    Gaps open and pieces close, so the matches are those of brackets: with the running depth as level, a
    gap and the piece that takes it are neighbours among the rows of their level. Pieces that find no gap
    here and gaps that no piece takes here leave with their number.
    """
    _ENCODERS.clear()  # a reused worker may still hold the vocabulary
    table = pa.Table.from_batches(list(batches), schema=pa.schema([("id", pa.int64()), ("length", pa.int64()), ("seq", pa.int64()), ("room", pa.int64())]))
    gap = table.column("id").is_null().to_numpy()
    depth = np.cumsum(np.where(gap, 1, -1))
    level = np.where(gap, depth, depth + 1)
    order = np.argsort(level, kind="stable")
    pair = (level[order][1:] == level[order][:-1]) & gap[order][:-1] & ~gap[order][1:] if len(order) else np.zeros(0, bool)
    opens, closes = order[:-1][pair], order[1:][pair]
    free = np.ones(len(gap), bool)
    free[opens] = free[closes] = False
    docs, gaps = np.flatnonzero(free & ~gap), np.flatnonzero(free & gap)
    at_doc, at_gap = np.concatenate([closes, docs]), np.concatenate([opens, gaps])
    n, d, g = len(closes), len(docs), len(gaps)

    def column(of: str, at: np.ndarray, before: int, after: int) -> pa.Array:
        found = table.column(of).take(pa.array(at)).combine_chunks()
        empty = pa.nulls(before, pa.int64()), pa.nulls(after, pa.int64())
        return pa.concat_arrays([*found.chunks, *empty] if isinstance(found, pa.ChunkedArray) else [found, *empty])

    def gap_column(of: str) -> pa.Array:
        values = column(of, at_gap, 0, 0)
        return pa.concat_arrays([values.slice(0, n), pa.nulls(d, pa.int64()), values.slice(n)])

    kinds = np.repeat(np.array([PLACED, LEFT, GAP], np.int32), [n, d, g])
    numbers = np.concatenate([np.zeros(n, np.int64), np.arange(d), np.arange(g)])
    columns = [pa.array(kinds), column("id", at_doc, 0, g), column("length", at_doc, 0, g), gap_column("seq"), gap_column("room"), pa.array(numbers)]
    yield pa.RecordBatch.from_arrays(columns, ["kind", "id", "length", "seq", "room", "ord"])


def carried(counts: dict[int, tuple[int, int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Which pieces left in one range take which gaps left in ranges before it, and how many take none.

    `counts` has pieces and gaps left per range, in order; it has a row per range, whatever the input. A run
    (range, first piece, end, range of the gaps or -1, number) says that its pieces take the gaps from that number
    downwards, or, without gaps, are numbered from it upwards. There are at most three runs a range.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    held: list[list[int]] = []  # [range, gaps left], the smallest gaps last
    alone = 0
    for part in sorted(counts):
        docs, gaps = counts[part]
        at = 0
        while at < docs and held:
            source, left = held[-1]
            n = min(docs - at, left)
            runs.append((part, at, at + n, source, left - 1))
            at += n
            held[-1][1] -= n
            if not held[-1][1]:
                held.pop()
        if at < docs:
            runs.append((part, at, docs, -1, alone))
            alone += docs - at
        if gaps:
            held.append([part, gaps])
    return runs, alone


def _round(docs: DataFrame, gaps: DataFrame, most: int) -> tuple[DataFrame, int, int]:
    """One bulk round: placed, left and gap rows, how many pieces were placed, and how many were left.

    Pieces and gaps are range-sorted by size, a gap before a piece of its size; each range is swept on its
    own, then what is left of the ranges is matched by rank. `ord` numbers the pieces left. There are at
    most `most` rows, and a range for every `RANGE_ROWS` of them.
    """
    spark = docs.sparkSession
    rows = docs.select("id", "length", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("room"), F.col("length").alias("_size"))
    rows = rows.unionByName(gaps.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("length"), "seq", "room", F.col("room").alias("_size")))
    order = [F.col("_size").desc(), F.col("id").isNotNull(), F.coalesce("id", "seq")]
    ranged = rows.repartitionByRange(max(2, -(-most // RANGE_ROWS)), *order).sortWithinPartitions(*order).select("id", "length", "seq", "room")
    swept = kept_table(ranged.mapInArrow(_swept, STATE).withColumn("part", F.spark_partition_id()))
    found = swept.groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n")).collect()  # three rows a range
    sizes = {(r["part"], r["kind"]): r["n"] for r in found}
    counts = {part: (sizes.get((part, LEFT), 0), sizes.get((part, GAP), 0)) for part in {r["part"] for r in found}}
    runs, alone = carried(counts)
    placed = sum(n for (_, kind), n in sizes.items() if kind == PLACED) + sum(end - first for _, first, end, source, _ in runs if source >= 0)
    if not runs:
        return swept.drop("part"), placed, 0
    table = spark.createDataFrame(runs, "_part int, _first long, _end long, _source int, _number long")
    here = (F.col("part") == F.col("_part")) & (F.col("ord") >= F.col("_first")) & (F.col("ord") < F.col("_end"))
    left = swept.where(F.col("kind") == LEFT).join(F.broadcast(table), here)
    step = F.col("ord") - F.col("_first")
    left = left.select("id", "length", "_source", F.when(F.col("_source") < 0, F.col("_number") + step).otherwise(F.col("_number") - step).alias("_number"))
    free = swept.where(F.col("kind") == GAP).select("seq", "room", F.col("part").alias("_at"), F.col("ord").alias("_ord"))
    met = left.join(free, (F.col("_source") == F.col("_at")) & (F.col("_number") == F.col("_ord")), "full")
    kind = F.when(F.col("id").isNull(), GAP).when(F.col("seq").isNull(), LEFT).otherwise(PLACED)
    resolved = met.select(kind.alias("kind"), "id", "length", "seq", "room", F.col("_number").alias("ord"))
    return kept_table(resolved.union(swept.where(F.col("kind") == PLACED).drop("part"))), placed, alone


def packed(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give every piece a sequence and an offset; adds `sequence_id` and `offset`.

    Pieces of `capacity` are sequences of their own. The others go by classes of lengths, the
    longest first, in bulk-synchronous rounds (`_round`): pieces of the class and all gaps are range-sorted, successor
    sweeps in all ranges match each piece with the smallest gap that holds it, a gap that several
    want goes to one by rank, the gaps shrink, and the round is repeated while pieces are left and some were placed. What finds
    no gap then opens sequences, dealt out evenly as many to each as the class allows. The driver sees
    counts per range only. An empty table gives no rows; equal pieces take any of their places.
    """
    spark = cut.sparkSession
    cut = kept_table(cut.withColumn("_id", F.monotonically_increasing_id()))
    width = max(1, capacity // CLASSES)
    short = cut.where(F.col("length") < capacity).select(F.col("_id").alias("id"), "length")
    classes = F.floor((F.lit(capacity - 1) - F.col("length")) / width).cast("int")
    classed = {r["class"]: (r["top"], r["n"]) for r in short.groupBy(classes.alias("class")).agg(F.max("length").alias("top"), F.count(F.lit(1)).alias("n")).collect()}
    gaps = spark.createDataFrame([], "seq long, room long")
    places: list[DataFrame] = []
    opened = 0
    for number, (top, left) in sorted(classed.items()):
        docs = short.where(classes == number)
        least = capacity - 1 - width * (number + 1)  # every piece of the class is longer
        while True:
            rows, placed, left = _round(docs, gaps.where(F.col("room") > least), left + opened)
            places.append(rows.where(F.col("kind") == PLACED).select("id", "seq", (F.lit(capacity) - F.col("room")).alias("offset")))
            shrunk = rows.where((F.col("kind") == GAP) | (F.col("room") > F.col("length"))).where(F.col("kind") != LEFT)
            gaps = gaps.where(F.col("room") <= least).unionByName(
                shrunk.select("seq", (F.col("room") - F.coalesce("length", F.lit(0))).alias("room"))
            )
            docs = rows.where(F.col("kind") == LEFT).select("id", "length", "ord")
            if not left or not placed or 2 * least >= capacity:
                break
        if left:
            each = capacity // top
            fresh = -(-left // each)
            dealt = docs.select("id", "length", (F.col("ord") % fresh + opened).alias("seq"), F.floor(F.col("ord") / fresh).alias("_k"))
            # At most `each` pieces a sequence.
            before = Window.partitionBy("seq").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
            dealt = dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)) if each > 1 else F.lit(0).cast("long"))
            dealt = kept_table(dealt.select("id", "length", "seq", "offset"))
            places.append(dealt.select("id", "seq", "offset"))
            room = dealt.groupBy("seq").agg((F.lit(capacity) - F.sum("length")).alias("room")) if each > 1 else dealt.select("seq", (F.lit(capacity) - F.col("length")).alias("room"))
            gaps = gaps.unionByName(room.where(F.col("room") > 0))
            opened += fresh
        gaps = kept_table(gaps)
    whole = cut.where(F.col("length") == capacity).select(
        *[c for c in cut.columns if c != "_id"], (F.monotonically_increasing_id() + F.lit(opened)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    if not places:
        return whole
    found = reduce(DataFrame.unionByName, places).select("id", F.col("seq").alias("sequence_id"), "offset")
    placed = cut.where(F.col("length") < capacity).join(found, F.col("_id") == F.col("id"))
    return placed.select(*[c for c in cut.columns if c != "_id"], "sequence_id", "offset").unionByName(whole)


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`pieces` then `packed`."""
    return packed(pieces(docs, ranks_path, pattern, capacity, id_col, text_col), capacity)
