"""Quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import labelled_sample
from tidemark.llm.shared import kept_table

SAMPLE = 4_000
PASSAGES = 200_000  # that training takes to the driver at most, 536 bytes each
PASSAGE = 600  # bytes, up to the next white space
BINS, SHAPES, HIDDEN, GATE = 128, 6, 32, 16
WIDTH = BINS + SHAPES
EPOCHS, RATE, BATCH = 12, 0.01, 64
_SEED = np.random.default_rng(17)
_M = _SEED.integers(0, 2**32, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_KIND = np.zeros(256, np.int8)
_KIND[65:91], _KIND[48:58], _KIND[97:123], _KIND[128:] = 1, 2, 3, 3
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
_AT_ONCE = 1 << 20


def _slice_encoded(b: np.ndarray) -> np.ndarray:
    n = len(b)
    spaces = np.flatnonzero(_SPACE[b])
    # A passage ends at the first white space after each multiple of its length.
    at = np.searchsorted(spaces, np.arange(PASSAGE, n, PASSAGE))
    cuts = np.unique(spaces[at[at < len(spaces)]]) + 1
    start = np.zeros(n, np.int64)
    start[cuts[cuts < n]] = 1
    passage = np.cumsum(start)
    count = int(passage[-1]) + 1
    size = np.bincount(passage, minlength=count).astype(float)
    out = np.zeros((count, WIDTH))
    if n >= 3:
        x = b.astype(np.uint64)
        key = ((x[:-2] * _M[0] + x[1:-1] * _M[1] + x[2:] * _M[2]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
        grams = np.bincount(passage[:-2] * BINS + key.astype(np.int64), minlength=count * BINS).reshape(count, BINS)
        out[:, :BINS] = np.sqrt(grams / np.maximum(1, size)[:, None])
    kinds = np.bincount(passage * 5 + _KIND[b], minlength=count * 5).reshape(count, 5) / size[:, None]
    out[:, BINS : BINS + 5] = kinds
    out[:, BINS + 5] = np.log1p(size) / 10
    return out


def encoded(text: str) -> np.ndarray:
    """A row per passage: hashed byte trigrams and shares of character kinds.

    An empty text is one passage of zeros. Very long texts are encoded by megabytes.
    """
    b = np.frombuffer(text.encode(), np.uint8)
    if not len(b):
        return np.zeros((1, WIDTH))
    return np.concatenate([_slice_encoded(b[i : i + _AT_ONCE]) for i in range(0, len(b), _AT_ONCE)])


@dataclass
class Network:
    """Passage encoder, gated attention and output; `weights` by name."""

    weights: dict[str, np.ndarray]
    constant: float | None = None

    @classmethod
    def fresh(cls) -> Network:
        r = np.random.default_rng(19)
        return cls({
            "w": r.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)) * 3, "b": np.zeros(HIDDEN),
            "v": r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)), "u": r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
            "a": np.zeros(GATE), "c": r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1),
        })

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores of the bags that begin at `starts` in the passages `x`."""
        k = self.weights
        h = np.tanh(x @ k["w"] + k["b"])
        t, g = np.tanh(h @ k["v"]), _sigmoid(h @ k["u"])
        e = (t * g) @ k["a"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        attention = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(h * attention[:, None], starts, axis=0)
        return _sigmoid(z @ k["c"] + k["d"]), (h, t, g, attention, bag, z)

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the bags."""
        k = self.weights
        p, (h, t, g, attention, bag, z) = self.forward(x, starts)
        delta = (p - y) / len(y)
        dz = delta[:, None] * k["c"]
        dh = attention[:, None] * dz[bag]
        da = (h * dz[bag]).sum(axis=1)
        de = attention * (da - np.add.reduceat(attention * da, starts)[bag])
        dtg = de[:, None] * k["a"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (dh + dt @ k["v"].T + dg @ k["u"].T) * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ delta, "d": delta.sum(keepdims=True)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def trained(bags: list[np.ndarray], labels: np.ndarray) -> Network:
    """Adam over shuffled batches of bags; one class alone gives a constant score."""
    if not len(labels) or labels.min() == labels.max():
        return Network({}, float(labels.mean()) if len(labels) else 0.5)
    net, order = Network.fresh(), np.random.default_rng(23)
    first = {n: np.zeros_like(w) for n, w in net.weights.items()}
    second = {n: np.zeros_like(w) for n, w in net.weights.items()}
    step = 0
    epochs = max(EPOCHS, min(60, 20_000 // len(labels)))
    for _ in range(epochs):
        shuffled = order.permutation(len(labels))
        for at in range(0, len(shuffled), BATCH):
            chosen = shuffled[at : at + BATCH]
            x = np.concatenate([bags[i] for i in chosen])
            starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])[:-1]]).astype(np.int64)
            step += 1
            for n, grad in net.gradients(x, starts, labels[chosen]).items():
                first[n] = 0.9 * first[n] + 0.1 * grad
                second[n] = 0.999 * second[n] + 0.001 * grad * grad
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                net.weights[n] = net.weights[n] - rate * first[n] / (np.sqrt(second[n]) + 1e-8)
    return net


def _encoded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [encoded(t.as_py() or "").astype("<f4").tobytes() for t in batch.column(0)]
        sizes = pa.array([len(b) // (4 * WIDTH) for b in bags], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), batch.column(1), batch.column(2), sizes], ["bag", "label", "doc_id", "n"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Train on about `SAMPLE` labelled rows at most, which `usable` (over `doc_id`) admits.

    Passages are encoded and stored on the executors. Rows, one per id, are taken whole in the order of a
    hash of the id for as long as they hold no more than `PASSAGES` passages together, so that no more leave
    for the driver; one that would not fit in what is left is no row of the sample.
    """
    sample = labelled_sample(docs, labels, label, usable, SAMPLE, id_col, text_col)
    bagged = kept_table(sample.select("text", "label", "doc_id").mapInArrow(_encoded_rows, "bag binary, label int, doc_id long, n long"))
    drawn, room = [], PASSAGES
    for r in sorted(bagged.select("doc_id", "n", F.xxhash64(F.lit("taken"), "doc_id").alias("at")).collect(), key=lambda r: r["at"]):  # about `SAMPLE` at most
        if r["n"] <= room:
            drawn.append(r["doc_id"])
            room -= r["n"]
    table = bagged.where(F.col("doc_id").isin(drawn)).drop("n").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(b.as_py(), "<f4").reshape(-1, WIDTH) for b in table.column("bag")]
    return trained(bags, table.column("label").to_numpy().astype(float))


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            scores: list[float] = []
            held: list[np.ndarray] = []

            def flush(held: list[np.ndarray] = held, scores: list[float] = scores) -> None:
                if held:
                    starts = np.concatenate([[0], np.cumsum([len(x) for x in held])[:-1]]).astype(np.int64)
                    scores.extend(net.forward(np.concatenate(held), starts)[0].tolist())
                    held.clear()

            size = 0
            for t in batch.column(1):
                x = encoded(t.as_py() or "")
                held.append(x)
                size += len(x)
                if size > 2000:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def scored(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text, from its attention-weighted passages.

    Null texts are empty and have the score of one empty passage; null and repeated ids
    keep their rows; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if net.constant is not None:
        return rows.select("doc_id", F.lit(net.constant).alias("score"))
    return rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(net)), "doc_id long, score double")
