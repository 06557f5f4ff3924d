"""Shared folders, stable hashes of words, and row ranks without large groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one that driver and executors share."""
    root = spark.conf.get(SETTING, None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        root = context.getCheckpointDir()
        if not root:
            root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
            context.setCheckpointDir(root)
            root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def kept_table(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_keys(text: str | Column) -> list[Column]:
    """Two 64-bit keys of a text, as `_k1` and `_k2`."""
    c = F.col(text) if isinstance(text, str) else text
    return [F.xxhash64(c).alias("_k1"), F.xxhash64(F.lit(1), c).alias("_k2")]


FILTER_WORDS = 1 << 18


def bit_filter(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the hashed keys: at most `FILTER_WORDS` rows, whatever the input."""
    at = F.xxhash64(key)
    spread = keys.select(
        F.pmod(at, F.lit(FILTER_WORDS)).cast("int").alias("_word"), F.pmod(F.shiftright(at, 40), F.lit(64)).cast("int").alias("_bit")
    )
    return spread.groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))


def maybe_in(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """Rows whose key may be in the bitmap: all that are, and few others while it is sparse.

    It only saves shuffled rows; an exact join has to follow.
    """
    at = F.xxhash64(key)
    rows = rows.withColumn("_word", F.pmod(at, F.lit(FILTER_WORDS)).cast("int")).withColumn("_bit", F.pmod(F.shiftright(at, 40), F.lit(64)).cast("int"))
    hit = rows.join(F.broadcast(bitmap), "_word").where(F.expr("getbit(_bits, _bit) = 1"))
    return hit.drop("_word", "_bit", "_bits")


# ---- hashes of words ---------------------------------------------------------------------

_SEED = np.random.default_rng(20_240_229)
_BYTE = _SEED.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PIECE = 1 << 20


def _powers(base: int) -> np.ndarray:
    out = np.full(_PIECE + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ready() -> None:
    if not _POWER:
        _POWER["up"], _POWER["down"] = _powers(_BASE), _powers(_INVERSE)


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of at most `_PIECE` bytes."""
    _ready()
    b = np.frombuffer(data, np.uint8)
    word = np.zeros(len(b) + 2, np.int8)
    word[1:-1] = ~_SPACE[b]
    step = np.diff(word)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _POWER["up"][: len(b)], out=total[1:])
    return mixed((total[ends] - total[starts]) * _POWER["down"][starts]), starts


def _long_word(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """Hash and end of the word at `at`: its pieces add up, each shifted by the length before it."""
    _ready()
    total, shift = 0, 1
    while at < len(data):
        b = np.frombuffer(data, np.uint8, min(_PIECE, len(data) - at), at)
        space = _SPACE[b]
        stop = int(space.argmax()) if space.any() else len(b)
        total += shift * int(np.sum(_BYTE[b[:stop]] * _POWER["up"][:stop], dtype=np.uint64))
        shift = shift * pow(_BASE, stop, 2**64) % 2**64
        at += stop
        if stop < len(b):
            break
    return mixed(np.array([total % 2**64], np.uint64)), at


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of one text, A-Z lower-cased, in order.

    Works through the text by pieces of a megabyte, cut at white space; the hash of a word of
    more than a megabyte is carried over its pieces.
    """
    if len(data) <= _PIECE:
        return _hashed(data)[0]
    out, at = [], 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        if end < len(data):
            while end > at and not _SPACE[data[end - 1]]:
                end -= 1
            if end == at:
                word, at = _long_word(data, at)
                out.append(word)
                continue
        out.append(_hashed(data[at:end])[0])
        at = end
    return np.concatenate(out)


def hashed_texts(texts: list[bytes]) -> Iterator[np.ndarray]:
    """`word_hashes` of each text; short texts are hashed together."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) + 1 <= _PIECE:
            size += len(texts[end]) + 1
            end += 1
        if end == at:
            yield word_hashes(texts[at])
            at += 1
            continue
        hashes, starts = _hashed(b"\n".join(texts[at:end]))
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts[at:end]])
        cuts = np.searchsorted(starts, bounds)
        for k in range(end - at):
            yield hashes[cuts[k] : cuts[k + 1]]
        at = end


def shingles_in_order(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the `n`-word shingles in text order; fewer words make one shingle, none none."""
    if len(words) == 0:
        return words
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total = mixed(total * np.uint64(_BASE) + words[i : len(words) - k + 1 + i])
    return total


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct ones of `shingles_in_order`, sorted."""
    return np.unique(shingles_in_order(words, n))


# ---- ranks -------------------------------------------------------------------------------


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str, blocks: int = 1024) -> DataFrame:
    """Add `out`, a gapless number from 0 within `keys`, for groups of any size.

    A group is cut into `blocks` by a hash of `order`, numbered per block and shifted by
    the sizes of the blocks before, so no task holds a group. The order is (block, `order`).
    """
    from pyspark.sql import Window

    rows = df.withColumn("_ranked_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    sizes = rows.groupBy(*keys, "_ranked_block").agg(F.count(F.lit(1)).alias("_ranked_n"))
    before = Window.partitionBy(*keys).orderBy("_ranked_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(
        *[F.col(k).alias(f"_ranked_{k}") for k in keys],
        F.col("_ranked_block").alias("_ranked_at"),
        F.coalesce(F.sum("_ranked_n").over(before), F.lit(0)).alias("_ranked_shift"),
    )
    inside = Window.partitionBy(*keys, "_ranked_block").orderBy(*order)
    rows = rows.withColumn("_ranked_rank", F.row_number().over(inside) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_ranked_{k}")) for k in keys] + [F.col("_ranked_block") == F.col("_ranked_at")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return (
        rows.join(shift, cond)
        .withColumn(out, (F.col("_ranked_rank") + F.col("_ranked_shift")).cast("long"))
        .drop("_ranked_block", "_ranked_rank", "_ranked_at", "_ranked_shift", *[f"_ranked_{k}" for k in keys])
    )
