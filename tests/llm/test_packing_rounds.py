"""The rounds of the packing against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import packing  # noqa: E402

SCHEMA = pa.schema([("id", pa.int64()), ("length", pa.int64()), ("seq", pa.int64()), ("room", pa.int64())])


def by_size(docs, gaps):
    rows = [(d, 1, i, None) for i, d in docs] + [(g, 0, None, s) for s, g in gaps]
    return sorted(rows, key=lambda r: (-r[0], r[1], r[2] if r[2] is not None else r[3]))


def stacked(rows):
    """Each piece, largest first, takes the smallest gap before it that is free."""
    stack, placed, left = [], {}, []
    for size, kind, i, s in rows:
        if kind == 0:
            stack.append((s, size))
        elif stack:
            placed[i] = stack.pop()[0]
        else:
            left.append(i)
    return placed, left, {s for s, _ in stack}


@pytest.mark.parametrize("seed", range(20))
def test_sweeps_and_carries_equal_one_stack(seed):
    rng = random.Random(seed)
    docs = [(i, rng.randrange(1, 40)) for i in range(rng.randrange(0, 60))]
    gaps = [(i, rng.randrange(1, 40)) for i in range(rng.randrange(0, 60))]
    rows = by_size(docs, gaps)
    cuts = sorted(rng.randrange(0, len(rows) + 1) for _ in range(3))
    placed, free, lost = {}, {}, {}
    counts = {}
    for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        columns = list(zip(*[(i, size if kind else None, s, None if kind else size) for size, kind, i, s in rows[a:b]])) or [[], [], [], []]
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=SCHEMA)
        out = next(packing._swept(iter([batch])))
        for r in out.to_pylist():
            if r["kind"] == packing.PLACED:
                placed[r["id"]] = r["seq"]
            elif r["kind"] == packing.LEFT:
                lost[part, r["ord"]] = r["id"]
            else:
                free[part, r["ord"]] = r["seq"]
        counts[part] = (sum(k[0] == part for k in lost), sum(k[0] == part for k in free))
    runs, alone = packing.carried(counts)
    numbers = []
    for part, first, end, source, number in runs:
        for k in range(first, end):
            if source < 0:
                numbers.append(number + k - first)
                lost.pop((part, k))
            else:
                placed[lost.pop((part, k))] = free.pop((source, number - (k - first)))
    want, left, gaps_left = stacked(rows)
    assert placed == want and set(free.values()) == gaps_left and not lost
    assert alone == len(left) and numbers == list(range(alone))


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("capacity,low", [(1024, 1), (1024, 300), (20, 1)])
def test_rounds_use_hardly_more_sequences_than_best_fit(spark, monkeypatch, capacity, low):
    monkeypatch.setattr(packing, "RANGE_ROWS", 100)
    lengths = np.random.default_rng(capacity + low).integers(low, capacity + 1, 500).tolist()
    cut = spark.createDataFrame([(i % 7, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES)
    used = {}
    for r in packing.packed(cut, capacity).collect():
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(n for rows in used.values() for _, n in rows) == sorted(lengths)
    for rows in used.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(used) <= best_fit_decreasing(lengths, capacity) * 1.01 + 2
