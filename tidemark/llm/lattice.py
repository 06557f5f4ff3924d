"""Subword lattice likelihood: all segmentations of a word weighted by unigram scores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import kept_table

FREQUENT = 200_000
FLUSH = 300_000
GATHERED = 60_000
ROUNDS = 2
_LN10 = math.log(10)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_SLOT_BITS = 20
_BYTE = np.random.default_rng(13).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)


class Vocabulary:
    """The pieces of an existing subword vocabulary, as bytes, with a prior from its scores.

    The mark of a word's start is a space. Pieces that lower-cased words cannot hold are
    left out, and every single byte is a piece, so each word has a segmentation. The prior
    weight falls with the rank of the piece's score; single bytes share the last rank.
    """

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.prior = 1.0 / (np.arange(len(pieces)) + 10.0)
        self.prior /= self.prior.sum()
        self.longest = max(map(len, pieces))
        keys = np.array([_hash(p) for p in pieces], np.uint64)
        self.keys = np.append(keys, np.zeros(1, np.uint64))
        # One slot per piece; pieces that meet in a slot are marked and found by search.
        slots = self._slots(keys)
        self.table = np.full(1 << _SLOT_BITS, len(pieces), np.int32)
        self.table[slots] = np.arange(len(pieces))
        met = np.flatnonzero(np.bincount(slots, minlength=len(self.table))[slots] > 1)
        self.table[slots[met]] = len(pieces) + 1
        order = np.argsort(keys[met])
        self.met_keys, self.met = keys[met][order], met[order]

    @classmethod
    def load(cls, model_path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        scored: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i):
                continue
            piece = sp.id_to_piece(i).replace("▁", " ").encode()
            if piece == piece.lower() and not piece[1:].count(b" ") and not any(c in piece for c in b"\t\n\v\f\r"):
                scored[piece] = max(sp.get_score(i), scored.get(piece, -math.inf))
        ranked = sorted(scored, key=lambda p: (-scored[p], p))
        return cls(ranked + [bytes([b]) for b in range(256) if bytes([b]) not in scored])

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, by position, and the numbers of those pieces."""
        none = len(self.pieces)
        at = self.table[self._slots(keys)]
        where = np.flatnonzero(at != none)
        found = at[where]
        crowded = np.flatnonzero(found > none)
        if len(crowded):
            pos = np.searchsorted(self.met_keys, keys[where[crowded]])
            found[crowded] = self.met[np.minimum(pos, len(self.met) - 1)]
        right = self.keys[found] == keys[where]
        return where[right], found[right]


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_BASE) + int(_BYTE[b])) % 2**64
    return h


LONG, LONG_BLOCK = 2_000, 1 << 14  # bytes from which on a word is walked alone, and how many places at a time


class Lattice:
    """Marginals and expected piece counts of words under `log_p` (natural logarithms)."""

    def __init__(self, vocabulary: Vocabulary, log_p: np.ndarray):
        self.vocabulary = vocabulary
        self.log_p = log_p

    def _arcs(self, words: list[bytes]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """By (start, end): the words whose substring is a piece, and the piece of each."""
        grid = np.frombuffer(b"".join(b" " + w for w in words), np.uint8).reshape(len(words), -1)
        coded, n = np.ascontiguousarray(_BYTE[grid].T), grid.shape[1]
        arcs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for start in range(n):
            key = np.zeros(len(words), np.uint64)
            for end in range(start + 1, min(n, start + self.vocabulary.longest) + 1):
                key = key * _BASE + coded[end - 1]
                where, found = self.vocabulary.find(key)
                if len(where):
                    arcs[start, end] = (where, found)
        return arcs

    def _summed(self, arcs: dict, size: int, n: int, forward: bool) -> np.ndarray:
        """Log of the summed probabilities of all ways to (or from) each place."""
        out = np.full((n + 1, size), -np.inf)
        out[0 if forward else n] = 0.0
        # Ends (or starts) in order: what a place is reached from is complete before it.
        for start, end in sorted(arcs, key=lambda a: (a[1], a[0]) if forward else (-a[0], a[1])):
            where, found = arcs[start, end]
            source, target = (start, end) if forward else (end, start)
            more = out[source, where] + self.log_p[found]
            out[target, where] = np.logaddexp(out[target, where], more)
        return out

    @staticmethod
    def _long(words: list[bytes]) -> list[int]:
        return [i for i, w in enumerate(words) if len(w) > LONG]

    def groups(self, words: list[bytes]) -> Iterator[np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes[sizes <= LONG]):
            at = np.flatnonzero(sizes == n)
            most = max(1, 40_000 // (int(n) + 1))
            for k in range(0, len(at), most):
                yield at[k : k + most]

    def _steps(self, coded: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """For the places `a` to `b` of a word: the piece of each length that begins there (or -1), and its log probability."""
        reach = self.vocabulary.longest
        piece = np.full((b - a, reach), -1, np.int64)
        key = np.zeros(b - a, np.uint64)
        for k in range(reach):
            inside = min(b, len(coded) - k) - a
            if inside <= 0:
                break
            key = key[:inside] * _BASE + coded[a + k : a + k + inside]
            where, found = self.vocabulary.find(key)
            piece[where, k] = found
        return piece, np.where(piece >= 0, self.log_p[piece], -np.inf)

    def _forward(self, coded: np.ndarray) -> np.ndarray:
        """Of a long word, place by place: the log of the summed probabilities of all ways there."""
        reach, n = self.vocabulary.longest, len(coded)
        out = np.full(n + reach + 1, -np.inf)
        out[0] = 0.0
        for a in range(0, n, LONG_BLOCK):
            for s, step in enumerate(self._steps(coded, a, min(n, a + LONG_BLOCK))[1], a):
                ahead = out[s + 1 : s + 1 + reach]
                np.logaddexp(ahead, out[s] + step, out=ahead)
        return out[: n + 1]

    def _long_uses(self, word: bytes, count: float) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of the pieces of one long word, block by block from its end."""
        coded = _BYTE[np.frombuffer(b" " + word, np.uint8)]
        reach, n = self.vocabulary.longest, len(coded)
        alpha = self._forward(coded)
        beta = np.full(n + reach + 1, -np.inf)
        beta[n] = 0.0
        total = np.zeros(len(self.log_p))
        for a in range((n - 1) // LONG_BLOCK * LONG_BLOCK, -1, -LONG_BLOCK):
            b = min(n, a + LONG_BLOCK)
            piece, step = self._steps(coded, a, b)
            for s in range(b - 1, a - 1, -1):
                beta[s] = np.logaddexp.reduce(step[s - a] + beta[s + 1 : s + 1 + reach])
            ends = np.arange(a, b)[:, None] + np.arange(1, reach + 1)
            used = piece >= 0
            p = np.exp((alpha[a:b, None] + step + beta[ends])[used] - alpha[n]) * count
            total += np.bincount(piece[used], p, len(total))
        found = np.flatnonzero(total)
        return found, total[found]

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word, summed over all its segmentations.

        Words of more than `LONG` bytes are walked place by place with a window of the longest piece;
        the others together, by their length.
        """
        out = np.empty(len(words))
        for i in self._long(words):
            out[i] = self._forward(_BYTE[np.frombuffer(b" " + words[i], np.uint8)])[-1]
        for at in self.groups(words):
            part = [words[i] for i in at]
            n = len(part[0]) + 1
            out[at] = self._summed(self._arcs(part), len(part), n, True)[n]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is used, over all segmentations by their probability."""
        pieces, uses = [], []
        for i in self._long(words):
            found, used = self._long_uses(words[i], float(counts[i]))
            pieces.append(found)
            uses.append(used)
        for at in self.groups(words):
            part = [words[i] for i in at]
            n = len(part[0]) + 1
            arcs = self._arcs(part)
            alpha, beta = self._summed(arcs, len(part), n, True), self._summed(arcs, len(part), n, False)
            rest = beta - alpha[n]
            weight = counts[at]
            for (start, end), (where, found) in arcs.items():
                p = np.exp(alpha[start, where] + self.log_p[found] + rest[end, where]) * weight[where]
                pieces.append(found)
                uses.append(p)
        if not pieces:
            return np.zeros(len(self.log_p))
        return np.bincount(np.concatenate(pieces), np.concatenate(uses), len(self.log_p))


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(model_path: str) -> Vocabulary:
    if model_path not in _VOCABULARIES:
        _VOCABULARIES[model_path] = Vocabulary.load(model_path)
    return _VOCABULARIES[model_path]


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

    for batch in batches:
        for text in batch.column(0):
            held.update(tokens(text.as_py()))
            if len(held) > FLUSH:
                yield out()
                held.clear()
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """`text` to (word, c); words are added up in the task before the shuffle."""
    return docs.select("text").mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """Batches joined to at least `rows` rows: numpy works by word length, on long arrays."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= rows:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _expected(model_path: str, log_p):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(model_path), log_p.value)
        total = np.zeros(len(log_p.value))
        for batch in _gathered(batches):
            total += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["piece", "n"])

    return run


def fitted(counts: DataFrame, documents: int, model_path: str) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of a text's end, by `ROUNDS` of expectation-maximisation.

    Every round reads all distinct words; what comes to the driver is one number per piece
    of the vocabulary, whatever the corpus. The prior counts as one more use of a piece in
    ten on average, so no piece has probability 0. The end of a text is one more symbol,
    seen once per document.
    """
    spark = counts.sparkSession
    prior = vocabulary(model_path).prior
    log_p, log_end = np.log(prior), math.log(0.5)
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(log_p)
        rows = counts.select("word", "c").mapInArrow(_expected(model_path, sent), "piece int, n double")
        used = rows.groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = 0.1 * len(prior) * prior
        for r in used:
            n[r["piece"]] += r["n"]
        total = n.sum() + documents + 1
        log_p, log_end = np.log(n / total), math.log((documents + 1) / total)
    return log_p, log_end


def _frequent(counts: DataFrame) -> pa.Table:
    """The most frequent words, `FREQUENT` at most; a whole class of counts is in or out."""
    step = F.floor(F.log2(F.col("c")) * 8).cast("int")
    sizes = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = 1 << 20, 0
    for r in sorted(sizes, key=lambda r: -r["s"]):
        total += r["n"]
        if total > FREQUENT:
            break
        least = r["s"]
    return counts.where(step >= least).select("word", "c").toArrow()


PARTS = "doc_id long, held_out boolean, n_tokens long, n_top long, base_top double, score_top double, tail array<struct<word: binary, n: int>>"


def _parts(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base, score, end = sent.value
        at = {w: i for i, w in enumerate(words)}
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            offsets, tail_words, tail_n = [0], [], []
            for text in batch.column(2):
                counted = Counter(tokens(text.as_py()))
                n_tokens, n_top, b, s = 1, 0, end[0], end[1]
                for word, n in counted.items():
                    n_tokens += n
                    i = at.get(word)
                    if i is None:
                        tail_words.append(word)
                        tail_n.append(n)
                    else:
                        n_top += n
                        b += n * base[i]
                        s += n * score[i]
                offsets.append(len(tail_words))
                for column, value in zip(rows, (n_tokens, n_top, b, s), strict=False):
                    column.append(value)
            entries = pa.StructArray.from_arrays([pa.array(tail_words, pa.binary()), pa.array(tail_n, pa.int32())], ["word", "n"])
            tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.float64()), tail],
                ["doc_id", "held_out", "n_tokens", "n_top", "base_top", "score_top", "tail"],
            )

    return run


def _tail_scores(sent, model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p, types, denominator, total = sent.value
        lattice = Lattice(vocabulary(model_path), log_p)
        for batch in _gathered(batches):
            encoded = batch.column(1).dictionary_encode()
            words = lattice.marginals(encoded.dictionary.to_pylist()) if len(encoded) else np.empty(0)
            n, c = batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy().astype(float)
            score = _word_score(words[encoded.indices.to_numpy()], c, types, total)
            base = np.log10((c + 1) / denominator)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n * base), pa.array(n * score), pa.array(np.where(c > 0, n, 0).astype(np.int64))], ["_row", "b", "s", "k"]
            )

    return run


def _word_score(marginal: np.ndarray, c: np.ndarray, types: int, total: int) -> np.ndarray:
    """log10 of a token's probability: its own arc and the lattice's, see `scored`."""
    with np.errstate(divide="ignore"):
        arc = np.log(c)
    return (np.logaddexp(arc, math.log(types) + marginal) - math.log(total + types)) / _LN10


def scored(docs: DataFrame, model_path: str, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probability of every whole text, by a lattice fitted to the rows not `held_out`.

    A word is generated piece by piece, its first piece after the mark of a word's start;
    its probability is the sum over all segmentations into pieces of the existing
    vocabulary (log-space forward recursion). Piece probabilities start from the vocabulary's
    scores and are fitted to the counts of all training words. A word seen in training has
    one more segmentation, itself: with N training tokens of V kinds, a token of count c has
    probability (c + V * lattice) / (N + V), which sums to one over all words and the end.
    A text's probability is the product over its words and its end. Also returned: tokens (words and the end), tokens seen in
    training, training tokens, and the add-one unigram score over tokens.

    Frequent words (at most `FREQUENT`, a bounded broadcast) are looked up in the task; the
    others are counted per document, joined with the counts by word and summed per row.

    Null texts are empty: the end alone. Rows whose `held_out` is null are held out; ids may
    be null or repeated, each row has its own result; without training rows all words are
    unseen; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    train = rows.where(~F.col("held_out"))
    counts = kept_table(word_counts(train))
    documents = train.count()
    seen = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    total, distinct = seen["n"] + documents, seen["v"] + (documents > 0)
    denominator = float(total + distinct + 1)
    log_p, log_end = fitted(counts, documents, model_path)
    types = max(1, distinct)

    top = _frequent(counts)
    words, c = top.column("word").to_pylist(), top.column("c").to_numpy().astype(float)
    marginal = Lattice(vocabulary(model_path), log_p).marginals(words)
    # The lattice generates words or the end: what starts a word, against the end.
    starts = np.exp(log_p[[p[:1] == b" " for p in vocabulary(model_path).pieces]]).sum()
    lattice_end = math.exp(log_end) / (math.exp(log_end) + starts)
    end = (math.log10((documents + 1) / denominator), math.log10((documents + types * lattice_end) / (total + types)))
    sent = spark.sparkContext.broadcast((words, np.log10((c + 1) / denominator).tolist(), _word_score(marginal, c, types, total).tolist(), end))
    parts = kept_table(rows.mapInArrow(_parts(sent), PARTS).withColumn("_row", F.monotonically_increasing_id()))

    tail = parts.select("_row", F.explode("tail").alias("_t")).select("_row", F.col("_t.word").alias("word"), F.col("_t.n").alias("n"))
    known = tail.join(counts, "word", "left").select("_row", "word", "n", F.coalesce("c", F.lit(0)).alias("c"))
    model = spark.sparkContext.broadcast((log_p, types, denominator, total))
    each = known.mapInArrow(_tail_scores(model, model_path), "_row long, b double, s double, k long")
    sums = each.groupBy(F.col("_row").alias("_r")).agg(F.sum("b").alias("_b"), F.sum("s").alias("_s"), F.sum("k").alias("_k"))
    zero = F.lit(0)
    known_end = 1 if documents else 0
    return parts.join(sums, F.col("_row") == F.col("_r"), "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_top") + known_end + F.coalesce("_k", zero)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_top") + F.coalesce("_b", F.lit(0.0))).alias("base_score"),
        (F.col("score_top") + F.coalesce("_s", F.lit(0.0))).alias("score"),
    )
