"""Near-duplicate documents by min-max hashing, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import bucket_components, shared_buckets
from tidemark.llm.shared import _BASE, bit_filter, hashed_texts, kept_table, maybe_in, mixed, shingle_hashes, text_keys

PERMUTATIONS, BAND = 40, 4
_SEED = np.random.default_rng(11)
_MULTIPLY = _SEED.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 2048
_PART = 512

SIGNED = "doc_id long, _k1 long, _k2 long, n_shingles long, _f1 long, _f2 long, bands array<long>"


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, interleaved.

    Minimum and maximum of one permutation agree between two sets with the probability of
    their Jaccard similarity each, so one hash evaluation gives two values.
    """
    low = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        values = shingles[at : at + _CHUNK, None] * _MULTIPLY
        np.minimum(low, values.min(axis=0), out=low)
        np.maximum(high, values.max(axis=0), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of `BAND` values."""
    rows = values.reshape(-1, BAND)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for i in range(BAND):
        key = mixed(key * np.uint64(_BASE) + rows[:, i])
    return key.view(np.int64)


def _signed(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, f1, f2, bands = [], [], [], []
            texts = [(t.as_py() or "").encode() for t in batch.column(3)]
            for words in hashed_texts(texts):
                s = shingle_hashes(words, n_words)
                sizes.append(len(s))
                # Order-free sums of two mixings: a 128-bit fingerprint of the set.
                f1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(mixed(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                bands.append(band_keys(signature(s)) if len(s) else np.empty(0, np.int64))
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()),
                       pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_k1", "_k2", "n_shingles", "_f1", "_f2", "bands"])

    return run


def _sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column(1)]
            sets = [shingle_hashes(w, n_words).view(np.int64) for w in hashed_texts(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of which the whole sets have `percent` of their union in common."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb")).cast("long")
    union = F.size("_sa") + F.size("_sb") - both
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * union).select("a", "b")


def _block_links(percent: int):
    """Links across components between the two sides of a block, as a spanning forest."""

    def run(block: pa.Table) -> pa.Table:
        nodes, roots = block.column("node").to_numpy(), block.column("root").to_numpy()
        side = block.column("side").to_numpy()
        sets = [v.values.to_numpy() for chunk in block.column("shingles").chunks for v in chunk]
        sizes = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            left, right = np.arange(0), np.arange(0)
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(column[-1]) + 1, _CHUNK):
            lo, hi = np.searchsorted(column, (at, at + _CHUNK))
            has = np.zeros((len(sets), _CHUNK), np.float32)
            has[row[lo:hi], column[lo:hi] - at] = 1
            both += has[left] @ has[right].T
        inter = both.astype(np.int64)
        union = sizes[left][:, None] + sizes[right][None] - inter
        links = (100 * inter >= percent * union) & (roots[left][:, None] != roots[right][None])
        i, j = np.nonzero(links)
        names, back = np.unique(np.concatenate([nodes[left], nodes[right]]), return_inverse=True)
        u, v = back[: len(left)][i], back[len(left) :][j]
        low = np.arange(len(names))
        while True:
            new = low.copy()
            np.minimum.at(new, u, low[v])
            np.minimum.at(new, v, low[u])
            new = new[new]
            if (new == low).all():
                break
            low = new
        moved = np.flatnonzero(low != np.arange(len(low)))
        return pa.table({"a": pa.array(names[moved], pa.int64()), "b": pa.array(names[low[moved]], pa.int64())})

    return run


def _remaining_links(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links in buckets that still hold several components, block by block.

    A bucket is cut into parts of about `_PART` nodes by a hash, every two parts are one
    task's block, and only links leave it: no pairs are emitted, and no bucket is gathered.
    """
    parts = rest.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / _PART).cast("int").alias("_p"))
    dealt = rest.join(parts, "bucket").withColumn("_of", F.pmod(F.xxhash64("node", "bucket"), "_p").cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("_with")
    rows = dealt.select("bucket", "node", "root", "_of", meets)
    first = rows.where("_of <= _with").select("bucket", "node", "root", F.col("_of").alias("_i"), F.col("_with").alias("_j"), F.lit(0).alias("side"))
    second = rows.where("_of >= _with").select("bucket", "node", "root", F.col("_with").alias("_i"), F.col("_of").alias("_j"), F.lit(1).alias("side"))
    blocks = first.union(second).join(sets, "node")
    return blocks.groupBy("bucket", "_i", "_j").applyInArrow(_block_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, n_words: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of `percent` or more.

    Returns a row per document: doc_id, n_shingles, component_id (the smallest id in reach),
    kept (doc_id = component_id), survives (exactly one row of each group), and the text
    keys `_k1`, `_k2` for joining back.

    Sets of words as in `shingle_hashes`. Documents with one and the same set are one node.
    Nodes that share a band of min-max values share a bucket; `bucket_components` compares
    what it must of a bucket with heads, what stays apart is compared by blocks
    (`_remaining_links`), and links are confirmed on whole sets.

    Null, empty and blank texts have no shingles and link with nothing. Rows without an id
    take part; a group without any id has a null component, and none of its rows is `kept`,
    while one `survives`. Repeated rows share a component; one of them survives. An empty
    table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = source.select("doc_id", *text_keys("text"), "text")
    signed = kept_table(keyed.mapInArrow(_signed(n_words), SIGNED).withColumn("_row", F.monotonically_increasing_id()))

    full = signed.where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row", "_k1", "_k2"))
    one_of = full.groupBy("_f1", "_f2", "n_shingles").agg(first.alias("_first"), F.first("bands").alias("bands"))
    nodes = kept_table(one_of.withColumn("node", F.col("_first._row")))

    entries = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    entries = kept_table(shared_buckets(entries))

    wanted = entries.select("node").distinct().join(nodes.select("node", "_first"), "node")
    wanted = wanted.select("node", F.col("_first.doc_id").alias("_id"), F.col("_first._k1").alias("_w1"), F.col("_first._k2").alias("_w2"))
    wanted = kept_table(wanted)
    here = maybe_in(keyed, "_k1", bit_filter(wanted, "_w1")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k1") == F.col("_w1")) & (F.col("_k2") == F.col("_w2")))
    sets = kept_table(here.select("node", "text").mapInArrow(_sets(n_words), "node long, shingles array<long>"))

    close = f"100 * least(n, other_n) >= {percent} * greatest(n, other_n)"
    roots = bucket_components(entries, ["n"], close, lambda pairs: _confirmed(pairs, sets, percent), lambda rest: _remaining_links(rest, sets, percent))
    named = nodes.select("_f1", "_f2", "n_shingles", "node", F.col("_first.n").alias("_null"), F.col("_first.doc_id").alias("_id"), F.col("_first._row").alias("_r"))
    placed = kept_table(named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    best = placed.groupBy("root").agg(F.min(F.struct("_null", "_id", "_r")).alias("_best"))
    groups = placed.join(best, "root").select("_f1", "_f2", F.col("n_shingles").alias("_n"), F.col("_best._id").alias("_cid"), F.col("_best._r").alias("_keeper"), F.lit(True).alias("_in"))
    same = (signed["_f1"] == groups["_f1"]) & (signed["_f2"] == groups["_f2"]) & (signed["n_shingles"] == groups["_n"])
    out = signed.join(groups, same, "left")
    cid = F.when(F.col("_in"), F.col("_cid")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        cid.alias("component_id"),
        F.coalesce(F.col("doc_id") == cid, F.lit(False)).alias("kept"),
        F.when(F.col("_in"), F.col("_row") == F.col("_keeper")).otherwise(True).alias("survives"),
        signed["_k1"],
        signed["_k2"],
    )


def one_of_each(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each group of near-duplicates, columns unchanged."""
    groups = near_duplicates(docs, n_words, percent, id_col, text_col)
    stay = groups.where("survives").select(F.col("doc_id").alias("_id"), F.col("_k1").alias("_s1"), F.col("_k2").alias("_s2"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_doc"), *text_keys(text_col))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_k1") == F.col("_s1")) & (F.col("_k2") == F.col("_s2"))
    kept = rows.join(stay, same, "left_semi")
    # Rows repeated with id and text come through together; their number is cut to one.
    window = Window.partitionBy("_doc", "_k1", "_k2").orderBy("_k1")
    return kept.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").select("_row.*")
