"""Words of any length through the lattice, and bounded training samples that are whole."""

import math
import time

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import lattice, quality  # noqa: E402


@pytest.fixture(scope="module")
def known():
    v = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return lattice.Lattice(v, np.log(v.prior))


def test_long_words_walk_to_the_same_sums(known, monkeypatch):
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 10, 150, 700)] + ["déjà-vu".encode() * 40, b"\x00\xff" * 30]
    counts = np.arange(1.0, len(words) + 1)
    together, uses = known.marginals(words), known.expected(words, counts)
    monkeypatch.setattr(lattice, "LONG", 0)
    monkeypatch.setattr(lattice, "LONG_BLOCK", 64)
    assert np.allclose(known.marginals(words), together, rtol=1e-12)
    assert np.allclose(known.expected(words, counts), uses, atol=1e-8)


def test_one_short_word_by_all_its_segmentations(known, monkeypatch):
    monkeypatch.setattr(lattice, "LONG", 0)
    piece = {p: known.log_p[i] for i, p in enumerate(known.vocabulary.pieces)}
    text, total = b" banana", 0.0
    for cuts in range(1 << (len(text) - 1)):
        at = [0, *[i + 1 for i in range(len(text) - 1) if cuts >> i & 1], len(text)]
        parts = [text[a:b] for a, b in zip(at, at[1:])]
        if all(p in piece for p in parts):
            total += math.exp(sum(piece[p] for p in parts))
    assert math.isclose(known.marginals([b"banana"])[0], math.log(total), rel_tol=1e-12)


def test_a_word_of_a_megabyte_takes_seconds(known):
    word = bytes(np.random.default_rng(2).integers(97, 123, 1 << 20).astype(np.uint8))
    begin = time.process_time()
    assert math.isfinite(known.marginals([word])[0])
    assert time.process_time() - begin < 30


def test_training_takes_whole_rows_up_to_its_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} " * (2_000 if i == 3 else 60)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "trained", lambda bags, y: seen.append([len(b) for b in bags]))
    quality.fit(docs, labels, F.lit(True))
    quality_all = seen[-1]
    assert len(quality_all) == 60
    monkeypatch.setattr(quality, "PASSAGES", 20)
    quality.fit(docs, labels, F.lit(True))
    # The document of many passages does not fit in and is left out; the others are whole.
    assert sum(seen[-1]) <= 20 and len(seen[-1]) >= 15 and set(seen[-1]) <= set(quality_all) - {max(quality_all)}
