"""Benchmark decontamination: size-partitioned MinHash containment search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import hashed_texts, shingles_in_order, shingle_hashes, word_hashes

HITS = "doc_id long, item_id long, n_found long, n_item long, containment double"
_SEED = np.random.default_rng(7)
_MULTIPLY = _SEED.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 16
_AT_ONCE = 1 << 18


def needed(size: int, percent: int) -> int:
    """Shingles of an item that make the containment reach `percent`."""
    return -(-size * percent // 100)


class Items:
    """A block of test items: shingle sets, and MinHash tables by size class.

    Class c holds the items of more than 2^(c-1) and at most 2^c shingles. Documents are
    cut for a class into windows of 2^(c+1) shingles that overlap by half, so a passage of
    up to 2^c shingles is inside one window, and the size of the window bounds what a
    containment means as a Jaccard similarity. With the bound s, 1 - (1 - s)^k is the
    chance that one of k minima agrees; k is taken per class so that it reaches `recall`.
    """

    def __init__(self, rows: list[tuple[int, np.ndarray]], percent: int, recall: float):
        self.percent = percent
        self.ids = [i for i, _ in rows]
        self.sets = [s for _, s in rows]
        self.classes: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        by_class: dict[int, list[int]] = {}
        for at, s in enumerate(self.sets):
            by_class.setdefault(max(4, math.ceil(math.log2(len(s)))), []).append(at)
        for c, members in sorted(by_class.items()):
            least = min(len(self.sets[m]) for m in members)
            found = needed(least, percent)
            bound = found / (2 ** (c + 1) + least - found)
            k = min(len(_MULTIPLY), math.ceil(math.log(1 - recall) / math.log(1 - bound)))
            values = np.stack([np.min(self.sets[m][:, None] * _MULTIPLY[:k], axis=0) for m in members])
            # The permutation is part of the value, so one sorted table serves all.
            flat = (values ^ np.arange(k, dtype=np.uint64)).ravel()
            owner = np.repeat(np.array(members), k)
            order = np.argsort(flat, kind="stable")
            self.classes.append((c, k, flat[order], owner[order]))
        self.most = max((k for _, k, _, _ in self.classes), default=0)

    def candidates(self, texts: list[np.ndarray]) -> set[tuple[int, int]]:
        """(Text, item) with an agreeing minimum in some window; shingles in text order."""
        out: set[tuple[int, int]] = set()
        overlap = 2 ** max(c for c, _, _, _ in self.classes)
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for text, shingles in enumerate(texts):
            at = 0
            while at < len(shingles):
                part = shingles[at : at + _AT_ONCE]
                if size + len(part) > _AT_ONCE:
                    self._search(held, out)
                    held, size = [], 0
                held.append((text, part))
                size += len(part)
                if at + len(part) == len(shingles):
                    break
                at += max(1, len(part) - overlap)
        if held:
            self._search(held, out)
        return out

    def _search(self, parts: list[tuple[int, np.ndarray]], out: set[tuple[int, int]]) -> None:
        # Every part fills whole blocks; windows that span two texts only cost a check.
        sizes = np.array([-(-len(p) // _BLOCK) for _, p in parts])
        ends = np.cumsum(sizes)
        blocks = np.empty((ends[-1], _BLOCK), np.uint64)
        flat_blocks = blocks.reshape(-1)
        for (_, p), end, n in zip(parts, ends, sizes, strict=True):
            begin = (end - n) * _BLOCK
            flat_blocks[begin : begin + len(p)] = p
            flat_blocks[begin + len(p) : end * _BLOCK] = p[-1]
        low = np.empty((self.most, len(blocks)), np.uint64)
        for p in range(self.most):
            np.min(blocks * _MULTIPLY[p], axis=1, out=low[p])
        for c, k, flat, owner in self.classes:
            step = 2**c // _BLOCK
            steps = np.minimum.reduceat(low[:k], np.arange(0, len(blocks), step), axis=1)
            windows = np.minimum(steps[:, :-1], steps[:, 1:]) if steps.shape[1] > 1 else steps
            values = windows ^ np.arange(k, dtype=np.uint64)[:, None]
            lo = np.searchsorted(flat, values, "left")
            rows, where = np.nonzero(flat[np.minimum(lo, len(flat) - 1)] == values)
            for row, window in zip(rows.tolist(), where.tolist(), strict=True):
                first = np.searchsorted(ends, window * step, "right")
                last = np.searchsorted(ends, min(len(blocks), (window + 2) * step) - 1, "right")
                at, value = lo[row, window], values[row, window]
                while at < len(flat) and flat[at] == value:
                    out.update((parts[d][0], int(owner[at])) for d in range(first, last + 1))
                    at += 1

    def matches(self, words: list[np.ndarray], n_words: int) -> Iterator[tuple[int, int, int, int]]:
        """(Text, item, shingles found, shingles of the item) of the confirmed candidates."""
        near = self.candidates([shingles_in_order(w, n_words) for w in words])
        last, distinct = -1, np.empty(0, np.uint64)
        for text, at in sorted(near):
            if text != last:
                last, distinct = text, shingle_hashes(words[text], n_words)
            n, size = self.verified(at, distinct), len(self.sets[at])
            if 100 * n >= self.percent * size:
                yield text, at, n, size

    def verified(self, at: int, distinct: np.ndarray) -> int:
        """Shingles of the item that the document has."""
        s = self.sets[at]
        pos = np.searchsorted(distinct, s)
        return int((distinct[np.minimum(pos, len(distinct) - 1)] == s).sum())


def item_blocks(bench: DataFrame, n_words: int, block: int, id_col: str, text_col: str, unnamed: bool = False) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items with their shingle sets, by blocks of at most `block` shingles (or one item), one block at a time.

    Items without an id are left out, unless `unnamed`.
    """
    rows = bench.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    if not unnamed:
        rows = rows.where("i is not null")
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for r in rows.toLocalIterator():
        s = shingle_hashes(word_hashes(r["t"].encode()), n_words)
        if held and size + len(s) > block:
            yield held
            held, size = [], 0
        if len(s):
            held.append((r["i"], s))
            size += len(s)
    if held:
        yield held


def contaminated(docs: DataFrame, bench: DataFrame, n_words: int = 5, percent: int = 80, recall: float = 0.9999, block: int = 1_000_000,
                 id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a test item of which the document holds `percent` of the shingles.

    Shingles are `n_words` lower-cased words (fewer words: all of them as one). Whole
    documents are searched by MinHash, size class by size class (`Items`), and candidates
    are counted exactly against the document's whole shingle set in the same task; no
    document text is shuffled. Items are sent to the tasks by blocks of at most `block`
    shingles, and each block reads the documents once, so the memory of a task does not grow
    with the benchmark; the driver shingles all items and holds all blocks until the job ends.

    Null or empty texts on either side match nothing; items without an id are left out;
    documents without one are reported with a null id. Repeated documents and items are
    reported each. Either table may be empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    out = spark.createDataFrame([], HITS)
    for held in item_blocks(bench, n_words, block, item_id_col, item_text_col):
        sent = spark.sparkContext.broadcast(held)
        out = out.unionByName(rows.mapInArrow(_search(sent, n_words, percent, recall), HITS))
    return out


def _search(sent, n_words: int, percent: int, recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value, percent, recall)
        for batch in batches:
            found: list[tuple] = []
            ids = batch.column(0).to_pylist()
            words = list(hashed_texts([t.as_py().encode() for t in batch.column(1)]))
            for text, at, n, size in items.matches(words, n_words):
                found.append((ids[text], items.ids[at], n, size, n / size))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            names = ["doc_id", "item_id", "n_found", "n_item", "containment"]
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def without_items(docs: DataFrame, bench: DataFrame, n_words: int = 5, percent: int = 80, recall: float = 0.9999, block: int = 1_000_000,
                  id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """`docs` without the contaminated documents, columns unchanged; null texts stay.

    A row is judged by its own text: rows pass through the search one block of items after
    the other, and those that match an item, with an id or without, do not come out.
    """
    spark = docs.sparkSession
    names = docs.columns
    kept = docs
    for held in item_blocks(bench, n_words, block, item_id_col, item_text_col, unnamed=True):
        sent = spark.sparkContext.broadcast(held)
        row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
        wrapped = kept.select(row.alias("c"), F.col(text_col).alias("text"))
        kind = wrapped.schema["c"].dataType.simpleString()
        passed = wrapped.mapInArrow(_passing(sent, n_words, percent, recall), f"c {kind}")
        kept = passed.select(*[F.col(f"c.c{i}").alias(n) for i, n in enumerate(names)])
    return kept


def _passing(sent, n_words: int, percent: int, recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value, percent, recall)
        for batch in batches:
            words = list(hashed_texts([(t.as_py() or "").encode() for t in batch.column(1)]))
            good = np.ones(len(batch), bool)
            for text, _, _, _ in items.matches(words, n_words):
                good[text] = False
            yield batch.select([0]).filter(pa.array(good))

    return run
