"""The training-data operators against brute force, and on null, empty, repeated and clashing rows."""

import collections
import math
import zlib

import numpy as np
import pytest

from conftest import SF

pytest.importorskip("tidemark.llm")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from tidemark.llm import decontam, html, labelled, lattice, lines, minhash, multiindex, packing, quality, queries, shared, sharding, toxicity  # noqa: E402

WORDS = "red blue green stone river cloud maple train paper light window garden silver".split()
LONG = " ".join(WORDS[(i * 7 + i // 5) % len(WORDS)] + str(i % 97) for i in range(4000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, bucket int"


def prose(seed, n):
    return " ".join(WORDS[(seed * 31 + i * (seed + 3)) % len(WORDS)] + str((seed * i) % 53) for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, ties, a very long text, and columns that clash with inner names."""
    texts = [None, "", "   \n\t", "one", LONG, LONG, prose(1, 60), prose(1, 60), prose(2, 80), "<|endoftext|> x  y\n\n z"]
    rows = [(i, t, None, None, None, "k", 1) for i, t in enumerate(texts)]
    rows += [(None, prose(1, 60), None, None, 3, "k", 1), (6, prose(1, 60), None, None, None, "k", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def smallest_reachable(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_html_blocks_and_boilerplate():
    page = (
        "<html><body><nav>menu</nav><div class='cookie-notice'>ok</div><article><h1>A &amp; B</h1><p>x <b>y</b>\n z<p>q<br>r</article>"
        "<div id=comments><p>long reader comment, longer than all the rest of the page together</p></div><footer>f</footer></body></html>"
    )
    assert html.main_text(page) == "A & B\n\nx y z\n\nq r"
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x</script>") == ""
    assert html.main_text("<div>" * 3000 + "deep") == "deep"


def test_html_bare_text_beside_the_densest_block():
    one, two, three, items = ("abcd " * 75).strip(), ("efgh " * 75).strip(), ("ijkl " * 75).strip(), ["mnop " * 25] * 10
    listed = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    want = [x.strip() for x in items]
    blocks = html.main_text(f"<body><div>{one}<br><br>{two}{listed}</div></body>").split("\n\n")
    assert blocks == [f"{one} {two}", *want]
    page = f"<body>{one} <b>bold</b> end<div>{listed}{two}</div>by <a href=x>me</a><p>x</p>{three}<a href=y>{'q' * 900}</a></body>"
    assert html.main_text(page).split("\n\n") == [f"{one} bold end", *want, two, three]
    poem = "<br>".join(["a line of verse of forty letters, or so"] * 60)
    assert html.main_text(f"<body><div>{poem}{listed}</div></body>").split("\n\n") == [poem.replace("<br>", " "), *want]


def test_html_boilerplate_is_no_matter_of_size():
    text = "A short article that has a single paragraph, and no more than some hundred letters in it."
    side = "".join(f"<p>Sidebar text {i}, which is long and goes on, and has no links, {'word ' * 60}</p>" for i in range(30))
    script = f"<script>{'var x = 1; ' * 5000}</script>"
    for more in ("", script):
        for name in ("sidebar", "ad", "popup", "cookie-notice", "menu"):
            page = f"<html><head><title>t</title></head><body>{more}<div id=c><p>{text}</p></div><div class='{name}'>{side}</div></body></html>"
            assert html.main_text(page) == text
            assert html.main_text(page.replace("<div id=c>", "<div class=content>")) == text
        tail = "<p>About</p><div class='cookie-notice'>We use cookies.</div><div>All rights reserved.</div>"
        for name in ("post search", "widget"):
            page = f"<body>{more}<div>Home</div><div class='{name}'><h1>T</h1><p>{text}</p><p>{text}</p><div class='share'>Tell your friends</div></div>{tail}</body>"
            got = html.main_text(page)
            assert got.count(text) == 2 and "cookies" not in got and "friends" not in got
        page = f"<body>{more}<article><h1>T</h1><p>Short.</p></article><div class=ad>{side}</div></body>"
        assert html.main_text(page) == "T\n\nShort."
        page = f"<body>{more}<div class='post search'><p>{text}</p></div><div class=sidebar>{side}</div></body>"
        assert html.main_text(page) == text


def test_html_query_keeps_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html.extracted(pages).collect()
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extracted(pages.limit(0)).count() == 0


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + rng.normal(size=16) * (0.02 if i < 200 else 0.12)], i % 2) for i in range(400)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([r[1] for r in rows[:400]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows[:400]])
    linked = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    low = smallest_reachable(range(400), np.argwhere(linked).tolist())
    got = {r["vec_id"]: r for r in multiindex.near_vectors(df).collect()}
    assert len(got) == 405 and all(got[i]["n_links"] == 0 for i in range(900, 905))
    found = sum(got[i]["n_links"] for i in range(400))
    assert 0.99 * linked.sum() <= found <= linked.sum()
    assert np.mean([got[i]["component_id"] == low[i] for i in range(400)]) > 0.98
    assert multiindex.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_every_length_and_repeated_ids(spark):
    a, b = [1.0, 0.5, 0.2, 0.9], [0.3, -1.0, 0.8]
    rows = [(10, a, 0), (10, a, 0), (11, a, 0), (12, a, 1), (20, b, 0), (21, b, 0), (30, [2.0], 0), (31, [0.5], 0), (32, [-1.0], 0), (40, a[:3], 0)]
    got = multiindex.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = [(10, 2, 10)] * 2 + [(11, 2, 10), (12, 0, 12), (20, 1, 20), (21, 1, 20), (30, 1, 30), (31, 1, 30), (32, 0, 32), (40, 0, 40)]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want


def test_contaminated_matches_brute_force(spark, docs, texts, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: shingles(r["text"], 5) for r in bench.collect()}
    own = {d: shingles(t, 5) for d, t in texts.items()}
    want = {(d, i) for d, s in own.items() for i, q in items.items() if 100 * len(q & s) >= 80 * len(q)}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert got == want and want
    few = decontam.contaminated(docs, bench, block=100)
    assert {(r["doc_id"], r["item_id"]) for r in few.collect()} == want
    assert {r["doc_id"] for r in decontam.without_items(docs, bench).collect()} == set(texts) - {d for d, _ in want}
    assert decontam.without_items(odd, bench).count() == odd.count()
    assert decontam.contaminated(odd, bench.limit(0)).count() == 0


def test_items_without_an_id_count_in_the_pipeline(spark):
    docs = spark.createDataFrame([(1, prose(5, 80)), (2, prose(8, 80)), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, prose(5, 40)), (4, None)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.without_items(docs, bench).collect()) == [2, 3]


def test_words_of_any_length_have_one_hash(monkeypatch):
    blob = b"x" * (5 << 20)
    assert len(shared.word_hashes(blob)) == 1 and len(shared.word_hashes(b"a " + blob + b"\nb " + blob)) == 4
    other = blob[: 3 << 20] + b"y" + blob[(3 << 20) + 1 :]
    assert shared.word_hashes(blob)[0] != shared.word_hashes(other)[0]
    text = " ".join("w" * n + str(n) for n in (1, 5, 30, 15, 16, 17, 64, 2, 2, 33, 14)).encode() + b" \n end"
    want = shared.word_hashes(text).tolist()
    for size in (1, 7, 16, 40):
        monkeypatch.setattr(shared, "_PIECE", size)
        assert shared.word_hashes(text).tolist() == want


def test_near_documents_match_brute_force(docs, texts, odd):
    own = {d: shingles(t, 3) for d, t in texts.items()}
    ids = sorted(own)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if own[a] and 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])]
    low = smallest_reachable(ids, pairs)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == low
    assert all(got[d]["n_shingles"] == len(own[d]) for d in ids)
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == 12 and sum(r["survives"] for r in rows) == 8
    assert all(r["component_id"] == 6 for r in rows if r["doc_id"] in (None, 6, 7))
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 9]
    assert minhash.one_of_each(odd.limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bit_parallel_edit_distance_and_keys(spark):
    rng = np.random.default_rng(4)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice(list("abé"), rng.integers(8, 60)))
        b = list(a)
        for _ in range(rng.integers(0, 5)):
            b[rng.integers(0, len(b))] = rng.choice(["", "x", "ab"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").where("length(b) > 5")
    for row in df.select("*", lines.within_edits("a", "b", 2).alias("near"), lines.segment_keys("a", "length(a)", 2).alias("ka"), lines.segment_keys("b", "length(b)", 2).alias("kb")).collect():
        near = edits(row["a"], row["b"]) <= 2
        assert row["near"] == near
        assert not near or set(row["ka"]) & set(row["kb"])


def test_lines_keep_the_first_of_each_class(spark):
    line = "the quick brown fox jumps over the lazy dog again"
    rows = [(1, f"{line}\nshort\nsomething else entirely that stays here, once"), (2, f"{line.replace('quick', 'quack')}\nshort"), (3, line), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _text string")
    got = {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"], r["kept"], r["near"]) for r in lines.near_lines(df).collect()}
    assert got == {(1, 0): (1, 0, True, False), (1, 2): (1, 2, True, False), (2, 0): (1, 0, False, True), (3, 0): (1, 0, False, False)}
    left = {r["doc_id"]: r["text"] for r in lines.without_repeats(df).collect()}
    assert left == {1: rows[0][1], 2: "short", 4: None, 5: ""}
    assert lines.near_lines(df.limit(0)).count() == 0


def test_short_lines_match_brute_force(spark):
    rng = np.random.default_rng(6)
    short = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(150)]
    short += ["Released under the MIT License.", "Released under the MIT Licence", "All rights reserved.", "All rights reserved.", "ab", "ab", "ad"]
    rows = [(i, f"\n {'' if i % 2 else chr(9)}\n{t}") for i, t in enumerate(short)]
    linked = [(i, k) for i, a in enumerate(short) for k, b in enumerate(short[:i]) if a == b or (min(len(a), len(b)) > 2 and edits(a, b) <= 2)]
    low = smallest_reachable(range(len(short)), linked)
    got = lines.near_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=1).collect()
    assert {(r["doc_id"], r["line_no"]): r["class_doc"] for r in got} == {(i, 2): c for i, c in low.items()}


def test_line_query_and_pipeline_take_every_length(spark, docs, texts):
    want = {(d, i) for d, t in texts.items() for i, line in enumerate((t or "").split("\n")) if line.strip()}
    got = {(r["doc_id"], r["line_no"]): r for r in queries.op8_line_dedup(spark, SF).collect()}
    assert set(got) == want and any(r["n_chars"] < 32 and not r["kept"] for r in got.values())
    left = corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()
    assert sum(bool(x.strip()) for r in left for x in (r["text"] or "").split("\n")) == sum(r["kept"] for r in got.values())


def test_packing_round_trip(spark, docs, texts, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ranks = queries.tokenizer_file("byte_bpe_50k.tiktoken")
    for table, own in ((docs, texts), (odd.where("doc_id is not null").dropDuplicates(["doc_id"]), None)):
        own = own or {r["doc_id"]: r["text"] for r in table.collect()}
        rows = packing.pack(table, ranks, public_tokenizers.PATTERN).collect()
        used = collections.defaultdict(list)
        pieces = collections.defaultdict(list)
        for r in rows:
            used[r["sequence_id"]].append((r["offset"], r["length"]))
            pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 1024
        for doc, text in own.items():
            ids, at = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4"), 0
            for start, length, crc in sorted(pieces[doc]):
                assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes())
                at += length
            assert at == len(ids)
        assert len(used) <= 1.05 * math.ceil(sum(r["length"] for r in rows) / 1024) + 1
    assert packing.pack(odd.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_lattice_sums_all_segmentations():
    words = [b"the", b"tion", b"zq9"]
    vocabulary = lattice.vocabulary(queries.tokenizer_file("piece_bpe_32k.model"))
    prob = dict(zip(vocabulary.pieces, vocabulary.prior, strict=True))

    def total(rest):
        return 1.0 if not rest else sum(prob.get(rest[:k], 0.0) * total(rest[k:]) for k in range(1, len(rest) + 1))

    got = lattice.Lattice(vocabulary, np.log(vocabulary.prior)).marginals(words)
    assert np.allclose(np.exp(got), [total(b" " + w) for w in words])


def test_lm_scores(docs, texts, odd):
    out = {r["doc_id"]: r for r in lattice.scored(docs, queries.tokenizer_file("piece_bpe_32k.model"), queries.fold(7, 2)).collect()}
    seen = collections.Counter()
    train = [t for d, t in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    for t in train:
        seen.update(lattice.tokens(t))
    total, kinds = sum(seen.values()) + len(train), len(seen) + 1
    for d, t in texts.items():
        w = lattice.tokens(t)
        base = sum(math.log10((c + 1) / (total + kinds + 1)) for c in [*(seen[x] for x in w), len(train)])
        assert out[d]["base_score"] == pytest.approx(base) and out[d]["n_tokens"] == len(w) + 1 and out[d]["train_tokens"] == total
        assert out[d]["n_known"] == 1 + sum(seen[x] > 0 for x in w) and out[d]["score"] < 0
    assert lattice.scored(odd, queries.tokenizer_file("piece_bpe_32k.model"), queries.fold(7, 2)).count() == 12


def test_sharding_law(docs, odd):
    rows = sharding.sharded(docs, sharding.regular(8), sharding.regular(9)).collect()
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    for shard in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    got = sharding.sharded(odd, sharding.regular(8), sharding.regular(9)).collect()
    assert len(got) == 12 and {r["size"] for r in got if r["doc_id"] in (0, 1)} == {1}


@pytest.mark.parametrize("op", [toxicity, quality])
def test_classifiers_score_every_row(spark, docs, odd, op):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = op.fit(docs, labels, F.lit(True))
    for rows in (docs, odd):
        got = op.scored(rows, model).collect()
        assert len(got) == rows.count() and all(0 <= r["score"] <= 1 for r in got)
    bare = op.fit(docs, labels.limit(0), F.lit(True))
    assert op.scored(odd, bare).count() == 12


def test_training_sample_is_bounded(spark, monkeypatch):
    rows = [(i % 10, f"{prose(i, 2000)} {i}") for i in range(60)] + [(3, None), (77, "unlabelled")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    sample = labelled.labelled_sample(docs, labels, "quality", F.lit(True), 100).collect()
    assert sorted(r["doc_id"] for r in sample) == list(range(10))
    seen = []
    monkeypatch.setattr(quality, "trained", lambda bags, y: seen.append([len(b) for b in bags]))
    quality.fit(docs, labels, F.lit(True))
    monkeypatch.setattr(quality, "PASSAGES", 100)
    quality.fit(docs, labels, F.lit(True))
    assert len(seen[0]) == 10 and sum(seen[0]) > 100 and seen[1] == [min(10, n) for n in seen[0]]


def test_attention_gradients():
    rng = np.random.default_rng(5)
    net = quality.Network.fresh()
    net.weights["a"] = rng.normal(size=quality.GATE)
    x, starts, y = rng.random((7, quality.WIDTH)), np.array([0, 3]), np.array([1.0, 0.0])
    got = net.gradients(x, starts, y)
    for name in net.weights:
        at = tuple(rng.integers(0, n) for n in net.weights[name].shape)
        costs = []
        for step in (1e-5, -1e-5):
            net.weights[name][at] += step
            p, _ = net.forward(x, starts)
            costs.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
            net.weights[name][at] -= step
        assert got[name][at] == pytest.approx((costs[0] - costs[1]) / 2e-5, abs=1e-6)


def test_pipeline_keeps_columns(spark, docs):
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, at, SF).count() >= at.count()
