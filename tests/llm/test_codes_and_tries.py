"""One-bit codes, searches over them, and the filter audit, against brute force and on odd rows."""

import itertools
from functools import reduce

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import audit, negatives, neighbours, onebit  # noqa: E402

VECTORS = "vec_id long, embedding array<double>, label int, row string, ask int, dims int, _m int"


def vectors(seed, n, dims, crowd=0):
    """Random vectors, the first `crowd` of them near or exact copies of one."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x[:crowd] = x[0] + rng.normal(size=(crowd, dims)) * (rng.random((crowd, 1)) < 0.5) * 0.01
    return x


def frame(spark, x, labels=None, first=0):
    rows = [(first + i, [float(a) for a in v], int(labels[i]) if labels is not None else 0, "r", 1, 2, 3) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, VECTORS)


def odd_vectors(spark):
    bad = [None, [], [0.0] * 8, [1.0, None] + [1.0] * 6, [float("nan")] * 8, [float("inf")] * 8]
    return spark.createDataFrame([(10_000 + i * 100, v, 1, None, None, None, None) for i, v in enumerate(bad)] + [(None, [1.0] * 8, 1, None, None, None, None)], VECTORS)


def test_rotation_keeps_lengths_and_products():
    x = vectors(1, 20, 24)
    turned = onebit.rotated(x)
    assert turned.shape == (20, 32)
    assert np.allclose(turned @ turned.T, x @ x.T)


@pytest.mark.parametrize("dims", [1, 3, 64, 130])
def test_bit_counts_and_certain_intervals(dims):
    x, q = vectors(2, 300, dims, 50), vectors(3, 40, dims)
    centres = x[:5] * 0.5
    near, code, norm, along, inner = onebit.coded(x, centres)
    for c in range(5):
        at = near == c
        ask = onebit.Planes(q, centres[c], 6)
        t = ask.against(code[at])
        signs = np.where(onebit.rotated(x[at] - centres[c]) > 0, 1, -1) / np.sqrt(ask.size)
        assert (np.abs(t - onebit.rotated(q - centres[c]) @ signs.T) <= ask.rounding[:, None] + 1e-9).all()
        middle, width = onebit.certain(ask, t, norm[at], along[at])
        exact = (q @ x[at].T) - inner[at] - ask.offset[:, None]
        assert (np.abs(middle - exact) <= width + 1e-9).all()


def test_likely_intervals_hold_nearly_always():
    x, q = vectors(4, 2_000, 64), vectors(5, 50, 64)
    centres = np.zeros((1, 64))
    _, code, norm, along, inner = onebit.coded(x, centres)
    ask = onebit.Planes(q, centres[0], 4)
    middle, width = onebit.likely(3.0)(ask, ask.against(code), norm, along)
    assert (np.abs(middle - q @ x.T) <= width).mean() > 0.995


def nearest_by_brute_force(ids, x, k, asked):
    out = {}
    for a in np.flatnonzero(asked(ids)):
        # Added up one after the other: sum() would compensate.
        score = np.array([reduce(lambda t, pq: t + pq[0] * pq[1], zip(x[a].tolist(), v.tolist()), 0.0) for v in x])
        order = [j for j in np.lexsort((ids, -score)) if j != a][:k]
        out[int(ids[a])] = [(int(ids[j]), score[j]) for j in order]
    return out


@pytest.mark.parametrize("crowd", [0, 400])
def test_nearest_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(onebit, "TILE_ROWS", 256)
    monkeypatch.setattr(onebit, "TILE_ASKS", 16)
    x = vectors(6, 1_200, 32, crowd)
    got = neighbours.nearest(frame(spark, x).union(odd_vectors(spark)), F.col("vec_id") % 20 == 0).collect()
    want = nearest_by_brute_force(np.arange(1_200), x, 20, lambda i: i % 20 == 0)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(want) and all(len(v) == 20 for v in found.values())
    hits = sum(len(set(found[a]) & set(want[a])) for a in want)
    assert hits / (20 * len(want)) >= 0.99
    assert all(dict(found[a])[i] == s for a in want for i, s in want[a] if i in dict(found[a]))


def test_nearest_of_few_repeated_and_mixed_lengths(spark):
    x = vectors(7, 6, 5)
    df = frame(spark, x).union(frame(spark, x[:1])).union(frame(spark, vectors(8, 3, 2), first=20))
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    by = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got)
    # Id 0 stands twice: either row is a question, and a neighbour of the other.
    assert [b[0] for b in by].count(0) == 2 * 6 and [b[0] for b in by].count(20) == 2
    assert sum(b[2] == 0 for b in by if b[0] == 0) == 2
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def hard_by_brute_force(ids, x, label, anchors):
    y = [[int(np.floor(256 * a)) for a in v] for v in x]
    out = []
    for a in np.flatnonzero(anchors(ids)):
        score = [sum(p * q for p, q in zip(y[a], v)) for v in y]
        order = sorted((j for j in range(len(y)) if j != a), key=lambda j: (-score[j], ids[j]))
        for p in [j for j in order if label[j] == label[a]][:5]:
            fits = [n for n in order if label[n] != label[a] and 80 * score[p] <= 100 * score[n] <= 100 * score[p]][:5]
            out += [(int(ids[a]), int(ids[p]), i + 1, int(ids[n]), score[p], score[n]) for i, n in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("crowd,scale", [(0, 1), (300, 1), (40, 1e6)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, crowd, scale):
    monkeypatch.setattr(onebit, "TILE_ROWS", 128)
    monkeypatch.setattr(onebit, "TILE_ASKS", 4)
    x, label = vectors(9, 700, 16, crowd) * scale, np.random.default_rng(10).integers(0, 4, 700)
    label[:crowd] = np.arange(crowd) % 2
    df = frame(spark, x, label).union(odd_vectors(spark).where("vec_id is null or size(embedding) < 1 or exists(embedding, v -> v is null or isnan(v) or v > 1e300)"))
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, F.col("label"))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = hard_by_brute_force(np.arange(700), x, label, lambda i: i % 50 == 0)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == want
    assert len(want) > 20


def test_hard_negatives_of_nothing(spark):
    df = frame(spark, vectors(11, 3, 4), [1, 1, 1])
    assert negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    assert negatives.hard_negatives(df.withColumn("label", F.lit(None).cast("int")), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


# ---- the filter audit --------------------------------------------------------------------


def test_trie_holds_the_smallest_id_of_each_text():
    texts = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"abc" * 50, b"abc" * 50 + b"x", bytes([255, 0]), b"ab"]
    trie = audit.RadixTrie()
    nodes = {}
    for number, text in zip([5, 9, 7, 3, 8, 1, 4, 6, 2, 0], texts):
        nodes.setdefault(text, set()).add(trie.insert(text, number))
    # A node handed out stays the node of its text, whatever is inserted later.
    assert all(len(n) == 1 for n in nodes.values())
    assert len({next(iter(n)) for n in nodes.values()}) == len(nodes)
    assert {t: trie.least[next(iter(n))] for t, n in nodes.items()} == {
        b"": 5, b"a": 9, b"ab": 0, b"abc": 3, b"abd": 8, b"b": 1, b"abc" * 50: 4, b"abc" * 50 + b"x": 6, bytes([255, 0]): 2,
    }


LONG = " ".join(f"w{i}" for i in range(400_000))
TEXTS = [
    None, "", "", " ", "a", "a", "x " * 300, "A" * 10, "ÀÉ" * 40 + "A", "cost $5", LONG, LONG, LONG + "!", " ".join(f"u{i}" for i in range(250)),
    "é ü " * 210, "tab\x0bver\x1ctical " * 120, "|",
]


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mask int, part string, n int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(docs, known).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got}


def audit_by_brute_force(rows, labels):
    ids = {}
    for i, text, *_ in rows:
        if i is not None:
            ids.setdefault(text or "", set()).add(i)
    fails = []
    for i, text, lang, *_ in rows:
        t = text or ""
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
        f = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and min(ids[t]) < i,
        }
        mine = [x for x in labels if x[0] == i and i is not None]
        fails.append((lang or "", {k for k, v in f.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {f[0] for f in fails}:
        mine, removed_by = [f for f in fails if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, stay = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                removed_by[f] += len(gone)
                failing = sum(f in x[1] for x in mine)
                out[part, "".join(order), step] = [
                    len(stay), len(gone), failing - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone), f,
                ]
                left = stay
        for key, row in out.items():
            if key[0] == part:
                row[-1] = removed_by[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(audit, "RANGE_BYTES", 1 << 16)
    rows = [(i, t, ("en", None, "", "fr")[i % 4], 1, "p", 2) for i, t in enumerate(TEXTS)]
    rows += [(None, "a", "en", None, None, None), (4, "a", "en", None, None, None), (40, "", "en", None, None, None), (3, "cost $5", "fr", None, None, None)]
    labels = [(i, i % 2, i % 3 == 0 and 1 or None) for i in range(12)] + [(4, 1, 1), (None, 1, 1)]
    want = audit_by_brute_force(rows, labels)
    assert audited(spark, rows, labels) == want
    assert len(want) == 600 * 3
    # Held in tries of a row or two, the rest meets in the ranges.
    monkeypatch.setattr(audit, "HELD_BYTES", 0)
    assert audited(spark, rows, labels) == want


def test_audit_of_a_crowd_and_of_nothing(spark):
    head = "the same beginning of many texts " * 20
    rows = [(i, head + ("" if i % 3 else str(i // 6)), "en", 1, "p", 2) for i in range(900, 0, -1)]
    assert audited(spark, rows, []) == audit_by_brute_force(rows, [])
    assert audited(spark, [], []) == {}
