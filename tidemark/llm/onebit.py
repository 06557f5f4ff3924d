"""Randomly rotated one-bit codes of vectors, and searches for largest inner products over them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import kept_table

SAMPLE = 4_096  # rows that the centres are fitted to; every row is coded
CENTRES = 16
ROUNDS = 5
SEED_SHARE = 16  # one part in so many is searched first, for a floor of each question
TILE_ROWS, TILE_ASKS, TILE_NUMBERS = 8_192, 512, 1 << 20
STEP = 64
PAIRS = 1 << 12
AHEAD = 4  # so many times k rows of the best estimates are scored first
DENSE = 1 / 32
_SLACK = 1e-9

CODES = "centre int, code binary, norm double, along double, inner double"


# ---- codes -------------------------------------------------------------------------------


def _padded(dims: int) -> int:
    return 1 << max(0, dims - 1).bit_length()


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows turned by a fixed random rotation of their length, padded with zeros to a power of two.

    Three rounds of random signs and a Walsh-Hadamard transform: lengths and inner products stay.
    """
    n, dims = x.shape
    size = _padded(dims)
    signs = np.random.default_rng(size).choice([-1.0, 1.0], size=(3, size))
    out = np.zeros((n, size))
    out[:, :dims] = x
    for turn in signs:
        out *= turn
        h = 1
        while h < size:
            halves = out.reshape(n, size // (2 * h), 2, h)
            out = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], 2).reshape(n, size)
            h *= 2
        out /= math.sqrt(size)
    return out


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of flags packed into 64-bit words."""
    packed = np.packbits(bits, axis=1)
    room = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, room)))).view(np.uint64)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def coded(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nearest centre, code, distance to the centre, and the scalars that correct an estimate.

    A residual r = x - c is stored as the signs b of its rotation, a unit vector b / sqrt(P);
    `along` is the inner product of r with that code vector, `inner` that of r with c.
    """
    apart = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    near = np.where(np.isnan(apart), np.inf, apart).argmin(1)
    r = x - centres[near]
    turned = rotated(r)
    along = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
    return near, _words(turned > 0), np.sqrt((r * r).sum(1)), along, (r * centres[near]).sum(1)


class Planes:
    """Questions q against one centre c: the rotated q - c as `bits` planes of quantised numbers."""

    def __init__(self, q: np.ndarray, centre: np.ndarray, bits: int):
        rest = q - centre
        turned = rotated(rest)
        self.size = turned.shape[1]
        self.norm = np.sqrt((rest * rest).sum(1))
        self.offset = q @ centre
        low, top = turned.min(1), turned.max(1)
        self.low, self.step = low, np.maximum(top - low, 1e-300) / (2**bits - 1)
        levels = np.rint((turned - low[:, None]) / self.step[:, None])
        kept = low[:, None] + self.step[:, None] * levels
        self.total = kept.sum(1)
        # No inner product with a code vector moves by more than this through the rounding.
        self.rounding = np.abs(turned - kept).sum(1) / math.sqrt(self.size)
        levels = levels.astype(np.int64)
        self.words = [_words(levels >> j & 1 == 1) for j in range(bits)]

    def against(self, codes: np.ndarray) -> np.ndarray:
        """Inner products of the questions with the code vectors, by counting bits."""
        found = np.zeros((len(self.norm), len(codes)))
        for j, plane in enumerate(self.words):
            for w in range(codes.shape[1]):
                found += np.bitwise_count(plane[:, w, None] & codes[None, :, w]) * float(2**j)
        ones = np.bitwise_count(codes).sum(1)
        inside = self.low[:, None] * ones + self.step[:, None] * found
        return (2 * inside - self.total[:, None]) / math.sqrt(self.size)


Bounds = Callable[[Planes, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def certain(ask: Planes, t: np.ndarray, norm: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval that always holds the inner product of the residuals.

    r = along * b + e with e orthogonal to b, so <r, q> = along * <b, q> + <e, q>, and by
    Cauchy-Schwarz |<e, q>| is at most |e| times the length of q orthogonal to b.
    """
    err = ask.rounding[:, None]
    least = np.maximum(np.abs(t) - err, 0)
    beside = np.sqrt(np.maximum(norm**2 - along**2, 0)) * np.sqrt(np.maximum(ask.norm[:, None] ** 2 - least**2, 0))
    width = along * err + beside + _SLACK * (1 + norm * ask.norm[:, None])
    return along * t, width


def likely(deviations: float) -> Bounds:
    """Unbiased estimate norm^2 / along * <b, q>, and its error at so many deviations.

    Over random rotations the part of q orthogonal to the residual meets the code vector in a
    nearly normal number of deviation 1 / sqrt(P - 1).
    """

    def bounds(ask: Planes, t: np.ndarray, norm: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = np.minimum(along / np.maximum(norm, 1e-300), 1)
        scale = np.where(norm > 0, norm / np.maximum(part, 1e-300), 0)
        spread = scale * np.sqrt(1 - part**2) * deviations / math.sqrt(max(1, ask.size - 1))
        err = spread * ask.norm[:, None] + scale * ask.rounding[:, None] + _SLACK * (1 + norm * ask.norm[:, None])
        return scale * t, err

    return bounds


def fitted_centres(rows: DataFrame, total: int) -> dict[int, np.ndarray]:
    """Centres per length, from a sample of about `SAMPLE` rows (row, vec); other lengths have the origin."""
    share = min(1.0, SAMPLE / max(1, total))
    drawn = rows.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < math.ceil(1_000_000 * share)).select("vec").toArrow()
    lists = [v.values.to_numpy(zero_copy_only=False).astype(float) for v in drawn.column("vec")]
    rng, out = np.random.default_rng(41), {}
    for dims in {len(v) for v in lists}:
        x = np.stack([v for v in lists if len(v) == dims])
        centres = x[rng.choice(len(x), min(CENTRES, -(-len(x) // 64)), replace=False)].copy()
        for _ in range(ROUNDS):
            near = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
            for j in range(len(centres)):
                if (near == j).any():
                    centres[j] = x[near == j].mean(0)
        if np.isfinite(centres).all():
            out[dims] = centres
    return out


def with_codes(rows: DataFrame, centres) -> DataFrame:
    """Rows (row, id, label, dims, vec) with the columns of `CODES`; `centres` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1_024):
                batch = whole.slice(at, 1_024)
                dims = batch.column("dims").to_numpy()
                for d in np.unique(dims):
                    own = batch.filter(pa.array(dims == d))
                    near, code, norm, along, inner = coded(_matrix(own.column("vec")), centres.value.get(int(d), np.zeros((1, d))))
                    columns = [pa.array(near, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(along), pa.array(inner)]
                    yield pa.RecordBatch.from_arrays([*own.columns, *columns], [*own.schema.names, "centre", "code", "norm", "along", "inner"])

    vec = rows.schema["vec"].dataType.simpleString()
    return rows.select("row", "id", "label", "dims", "vec").mapInArrow(run, f"row long, id long, label int, dims int, vec {vec}, {CODES}")


# ---- searches ----------------------------------------------------------------------------


def _scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, whole: bool) -> np.ndarray:
    """Inner products of the pairs (i, j), the same for equal vectors wherever they stand.

    Integers are exact: beyond 2^53 they are summed as Python integers, and what no 64-bit
    integer can hold becomes the nearest one.
    """
    out = np.empty(len(i))
    exact = not whole or len(i) == 0 or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53
    for at in range(0, len(i) if exact else 0, PAIRS):
        left, right = a[i[at : at + PAIRS]], b[j[at : at + PAIRS]]
        left *= right
        # One number after the other: the order of a plain loop.
        out[at : at + PAIRS] = np.add.accumulate(left, axis=1, out=left)[:, -1]
    if exact:
        return out.astype(np.int64) if whole else out
    ia, ib = [[int(v) for v in r] for r in a], [[int(v) for v in r] for r in b]
    sums = (sum(x * y for x, y in zip(ia[p], ib[q], strict=True)) for p, q in zip(i, j, strict=True))
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)


def _best(ask: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first `k` per question: higher scores first, ties by id."""
    order = np.lexsort((ids, -score if score.dtype == float else np.invert(score), ask))
    begins = np.r_[True, ask[order][1:] != ask[order][:-1]] if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
    return order[rank < k]


def _in_reach(q: np.ndarray, x: np.ndarray, near: np.ndarray, width: np.ndarray, barred: np.ndarray, tops: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs to score: all of the `k` best in each window are among them.

    The rows of the best estimates are scored first, and the k-th of them raises the floor. Then
    the rows whose interval reaches into a window are scored without regard to the last digit,
    pair by pair where they are few and as one product where they are many.
    """
    first = min(AHEAD * k, len(x))
    slack = _SLACK * (1 + np.sqrt((q * q).sum(1)) * math.sqrt((x * x).sum(1).max()))[:, None]
    reach, spans = np.zeros(near.shape, bool), []
    for w in range(tops.shape[1]):
        top, floor = tops[:, w, None].astype(float), floors[:, w, None].astype(float)
        if len(x) > k:
            hoped = np.where(barred | ~(near <= top), -np.inf, near)
            ahead = np.argpartition(hoped, len(x) - first, axis=1)[:, len(x) - first :]
            score = np.einsum("id,ijd->ij", q, x[ahead])
            fits = ~np.take_along_axis(barred, ahead, 1) & (score <= top - slack) & (score >= floor)
            kth = np.partition(np.where(fits, score, -np.inf), first - k, axis=1)[:, first - k]
            floor = np.maximum(floor, kth[:, None])
        spans.append((floor - slack, top + slack))
        # Not-less-than keeps what overflow made undefined.
        reach |= ~(near + width < spans[-1][0]) & ~(near - width > spans[-1][1])
    reach &= ~barred
    if reach.mean() > DENSE:
        reach &= _in_spans(q @ x.T, spans)
        return np.nonzero(reach)
    i, j = np.nonzero(reach)
    rough = np.concatenate([np.einsum("pd,pd->p", q[i[at : at + PAIRS]], x[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)] or [np.empty(0)])
    kept = _in_spans(rough, [(low[i, 0], high[i, 0]) for low, high in spans])
    return i[kept], j[kept]


def _in_spans(score: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    inside = np.zeros(score.shape, bool)
    for low, high in spans:
        inside |= ~(score < low) & ~(score > high)
    return inside


def _searched(centres, k: int, bits: int, bounds: Bounds, rule: str, whole: bool):
    """One tile: up to `k` rows for each question and each of its windows (floor to top)."""
    number = np.int64 if whole else float

    def windows(asks: pa.Table, name: str) -> np.ndarray:
        return np.array(asks.column(name).to_pylist(), number).reshape(len(asks), -1)

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if len(rows) and len(asks):
            rows = rows.take(pa.array(np.argsort(rows.column("centre").to_numpy(), kind="stable")))
            x, q = _matrix(rows.column("vec")), _matrix(asks.column("vec"))
            own, ids, label, centre, norm, along, inner = (rows.column(c).to_numpy() for c in ("row", "id", "label", "centre", "norm", "along", "inner"))
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint64).reshape(len(x), -1)
            book = centres.value.get(x.shape[1], np.zeros((1, x.shape[1])))
            cuts = [(c, *np.searchsorted(centre, [c, c + 1])) for c in np.unique(centre)]
            ask, ask_label = asks.column("row").to_numpy(), asks.column("label").to_numpy()
            tops, floors = windows(asks, "tops"), windows(asks, "floors")
            for at in range(0, len(q), STEP):
                part = slice(at, at + STEP)
                near, width = np.empty((len(q[part]), len(x))), np.empty((len(q[part]), len(x)))
                for c, begin, end in cuts:
                    planes = Planes(q[part], book[c], bits)
                    here = slice(begin, end)
                    middle, width[:, here] = bounds(planes, planes.against(codes[here]), norm[here], along[here])
                    near[:, here] = middle + inner[here] + planes.offset[:, None]
                barred = own[None] == ask[part, None]
                if rule == "same":
                    barred |= label[None] != ask_label[part, None]
                elif rule == "other":
                    barred |= label[None] == ask_label[part, None]
                i, j = _in_reach(q[part], x, near, width, barred, tops[part], floors[part], k)
                score = _scores(q[part], x, i, j, whole)
                picked = np.zeros(len(i), bool)
                for w in range(tops.shape[1]):
                    fits = np.flatnonzero((score <= tops[part][i, w]) & (score >= floors[part][i, w]))
                    picked[fits[_best(i[fits], score[fits], ids[j[fits]], k)]] = True
                i, j, score = i[picked], j[picked], score[picked]
                found.append((ask[part][i], own[j], ids[j], score, np.full(len(i), 0)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0)] * 4
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64() if whole else pa.float64())
        return pa.Table.from_arrays([pa.array(c).cast(t) for c, t in zip(columns[:4], types, strict=True)], ["ask", "row", "id", "score"])

    return run


def best_in_windows(rows: DataFrame, asks: DataFrame, centres, k: int, bits: int, bounds: Bounds, rule: str = "any", whole: bool = False,
                    within: tuple[str, ...] = ("dims",)) -> DataFrame:
    """(ask, row, id, score): at least the `k` best rows in each window of each question.

    `rows` are coded rows; `asks` has row, label, dims, vec, and arrays `tops` and `floors`
    of one length throughout the table. Rows and questions that agree in `within` are cut
    into parts by a hash, and a task compares one part of either side by codes: what an
    interval cannot rule out is scored on the vectors themselves. A sixteenth of the parts
    goes first; its k-th best score in a window is the floor there for all others, so few
    rows leave a task however many parts there are.
    """
    kind = "long" if whole else "double"
    counts = rows.groupBy(*within).agg(F.count(F.lit(1)).alias("_m")).join(asks.groupBy(*within).agg(F.count(F.lit(1)).alias("_v")), list(within))
    numbers = F.least(F.lit(TILE_ROWS), F.greatest(F.lit(256), F.lit(TILE_NUMBERS) / F.col("dims"))) if "dims" in within else F.lit(TILE_ROWS)
    parts = kept_table(counts.select(*within, F.ceil(F.col("_m") / F.floor(numbers)).cast("int").alias("_m"), F.ceil(F.col("_v") / TILE_ASKS).cast("int").alias("_v")))
    keys = [*within, "_i", "_j"]
    first = F.ceil(F.col("_m") / SEED_SHARE).cast("int")

    def tiles(asked: DataFrame, seeds: bool) -> DataFrame:
        mine: Column = F.col("_i") < first if seeds else F.col("_i") >= first
        left = rows.join(parts, list(within)).withColumn("_i", F.pmod(F.xxhash64(F.lit(5), "row"), "_m").cast("int")).where(mine)
        left = left.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_v") - 1))).drop("_m", "_v")
        right = asked.join(parts, list(within)).withColumn("_j", F.pmod(F.xxhash64(F.lit(7), "row"), "_v").cast("int"))
        right = right.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).where(mine).drop("_m", "_v")
        grouped = left.groupBy(*keys).cogroup(right.groupBy(*keys))
        found = _searched(centres, k, bits, bounds, rule, whole)
        return grouped.applyInArrow(lambda a, b: found(a, b), f"ask long, row long, id long, score {kind}")

    asks = kept_table(asks)
    seeded = kept_table(tiles(asks, True))
    wins = asks.select(F.col("row").alias("ask"), F.posexplode(F.arrays_zip("tops", "floors")).alias("_w", "_span"))
    scored = wins.join(seeded, "ask").where("score <= _span.tops and score >= _span.floors")
    kth = first_per(scored, ["ask", "_w"], k).where(F.col("rank") == k).select("ask", "_w", F.col("score").alias("_kth"))
    raised = wins.join(kth, ["ask", "_w"], "left").groupBy("ask").agg(
        F.sort_array(F.collect_list(F.struct("_w", F.greatest("_span.floors", F.coalesce("_kth", "_span.floors")).alias("_floor")))).alias("_all")
    )
    again = asks.drop("floors").join(raised.select(F.col("ask").alias("row"), F.col("_all._floor").alias("floors")), "row")
    return kept_table(seeded.union(tiles(again, False)))


def first_per(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first `k` rows per `keys` by score and id, with `rank` from 1."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id"), F.col("row"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
