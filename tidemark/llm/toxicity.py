"""Toxicity: boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import labelled_sample
from tidemark.llm.shared import kept_table

SAMPLE = 20_000
WORDS = 5_000
STEMS = (4, 5)
NEAR = 5

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()
)
# Characters written in place of letters.
LOOKALIKES = str.maketrans("013457@$", "oieastas")

_PUNCTUATION = dict.fromkeys(map(ord, "\"'()[]{}.,;:!?«»“”‘’|#%&*-_/\\<>=+~^`"), None)
_MASKED = re.compile(r"[^\W\d_][*@$0-9#%&]+[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_SYMBOLS = re.compile(r"[*#%&$@|]")

FEATURES = 16


@dataclass(frozen=True)
class Lexicon:
    """Words and word beginnings that labelled texts show to be toxic, with their log odds."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


def _units(text: str) -> set[str]:
    words = set(text.lower().translate(_PUNCTUATION).split())
    return {f"w{w}" for w in words} | {f"s{w[:n]}" for w in words for n in STEMS if len(w) > n}


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units: list[str] = []
        labels: list[int] = []
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            own = _units(text.as_py() or "")
            units += own
            labels += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(labels, pa.int32())], ["unit", "label"])


def learned_lexicon(sample: DataFrame) -> Lexicon:
    """The `WORDS` units of each kind with the highest log odds, from document counts.

    A unit needs two toxic documents and log odds above 2, smoothed by half a document.
    """
    sizes = sample.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = sizes["t"] + 1.0, sizes["n"] - sizes["t"] + 1.0
    rows = sample.select("text", "label").mapInArrow(_unit_rows, "unit string, label int")
    counts = rows.groupBy("unit").agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n")).where("t >= 2")
    odds = F.log((F.col("t") + 0.5) / toxic) - F.log((F.col("n") - F.col("t") + 0.5) / clean)
    counts = counts.withColumn("odds", odds).where("odds > 2")
    out: dict[str, dict[str, float]] = {}
    for kind in "ws":
        best = counts.where(F.col("unit").startswith(kind)).orderBy(F.desc("odds"), "unit").limit(WORDS)
        out[kind] = {r["unit"][1:]: r["odds"] for r in best.collect()}
    return Lexicon(out["w"], out["s"])


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Dense features of a whole text; of an empty one all zero."""
    words = text.lower().translate(_PUNCTUATION).split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    listed, stems = lexicon.words, lexicon.stems
    s1, s2 = STEMS
    hits = [i for i, w in enumerate(words) if w in listed]
    stem_hits = [w for w in words if w[:s1] in stems or w[:s2] in stems]
    weight = sum(listed[words[i]] for i in hits)
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    for i in hits:
        at = bisect.bisect_left(second, i - NEAR)
        near += at < len(second) and second[at] <= i + NEAR
    masked = _MASKED.findall(text)
    unmasked = 0
    if masked:
        for raw in text.lower().split():
            if any(c in "013457@$*" for c in raw):
                plain = raw.translate(LOOKALIKES).translate(_PUNCTUATION)
                unmasked += plain in listed and raw.translate(_PUNCTUATION) not in listed
    chars = len(text)
    return [
        math.log1p(n),
        len(hits) / n,
        len({words[i] for i in hits}),
        weight / n,
        math.log1p(weight),
        len(stem_hits) / n,
        math.log1p(len(stem_hits)),
        len({w[:s1] for w in stem_hits}),
        near / n,
        len(second) / n,
        len(_UPPER.findall(text)) / chars,
        len(_SHOUTED.findall(text)) / n,
        (text.count("!") + text.count("?")) / n,
        len(_SYMBOLS.findall(text)) / chars,
        (len(masked) + len(_STRETCHED.findall(text))) / n,
        unmasked / n,
    ]


def _featured(sent, keep: int):
    names = [f"c{i}" for i in range(keep)] + ["features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = sent.value
        for batch in batches:
            rows = [features(t.as_py() or "", lexicon) for t in batch.column(keep)]
            values = pa.array(np.array(rows, float).reshape(-1))
            offsets = pa.array(np.arange(len(rows) + 1) * FEATURES, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.ListArray.from_arrays(offsets, values)], names)

    return run


@dataclass(frozen=True)
class Model:
    """Lexicon, trees and the steps of the calibration; without trees a constant score."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    steps: list[tuple[float, float]]
    constant: float


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on about `SAMPLE` labelled rows at most, which `usable` (over `doc_id`) admits.

    Half of the sample gives the lexicon, three tenths the trees, and the rest the
    calibration, so that none judges its own rows. If a part lacks a class, the score is
    the sample's share of toxic rows (0 without labels).
    """
    spark = docs.sparkSession
    sample = kept_table(labelled_sample(docs, labels, label, usable, SAMPLE, id_col, text_col))
    lexicon = learned_lexicon(sample.where("pick < 50"))
    sent = spark.sparkContext.broadcast(lexicon)
    rows = sample.where("pick >= 50").select("label", "pick", "text").mapInArrow(_featured(sent, 2), "label int, pick int, features array<double>")
    rows = kept_table(rows).select(F.col("label").cast("double").alias("label"), "pick", array_to_vector("features").alias("features"))
    kinds = {(r["late"], r["label"]): r["n"] for r in rows.groupBy((F.col("pick") >= 80).alias("late"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sample.agg(F.avg("label")).first()[0] or 0.0
    if len(kinds) < 4:
        return Model(lexicon, None, [], float(share))
    trees = GBTClassifier(maxIter=20, maxDepth=3, maxBins=64, stepSize=0.2, seed=7, cacheNodeIds=False).fit(rows.where("pick < 80"))
    late = trees.transform(rows.where("pick >= 80")).select("label", vector_to_array("probability")[1].alias("p"))
    curve = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="s").fit(kept_table(late))
    steps = list(zip(curve.boundaries.tolist(), curve.predictions.tolist(), strict=True))
    return Model(lexicon, trees, steps, float(share))


def _calibrated(p: Column, steps: list[tuple[float, float]]) -> Column:
    """The isotonic curve, linear between its points; a hundredth of `p` orders its flats."""
    out = F.lit(steps[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(steps, steps[1:], strict=False))):
        line = F.lit(y0) + (p - x0) * ((y1 - y0) / (x1 - x0)) if x1 > x0 else F.lit(y1)
        out = F.when(p < x1, line).otherwise(out)
    out = F.when(p <= steps[0][0], F.lit(steps[0][1])).otherwise(out)
    return 0.99 * out + 0.01 * p


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; the score is a calibrated probability.

    Null texts are empty and have the score of an empty text; null and repeated ids keep
    their rows; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model.trees is None:
        return rows.select("doc_id", F.lit(model.constant).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model.lexicon)
    made = rows.mapInArrow(_featured(sent, 1), "doc_id long, features array<double>")
    made = made.select("doc_id", array_to_vector("features").alias("features"))
    p = vector_to_array("probability")[1]
    judged = model.trees.transform(made).select("doc_id", p.alias("_p"))
    return judged.select("doc_id", _calibrated(F.col("_p"), model.steps).alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, usable: Column, limit: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the documents of a score of `limit` or more, columns unchanged."""
    model = fit(docs, labels, usable, "toxic", id_col, text_col)
    if model.trees is None:
        return docs if model.constant < limit else docs.where(F.lit(False))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model.lexicon)
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    wrapped = docs.select(row.alias("c0"), F.col(text_col).alias("text"))
    kind = wrapped.schema["c0"].dataType.simpleString()
    made = wrapped.mapInArrow(_featured(sent, 1), f"c0 {kind}, features array<double>")
    made = made.withColumn("features", array_to_vector("features"))
    p = vector_to_array("probability")[1]
    judged = model.trees.transform(made).where(_calibrated(p, model.steps) < limit)
    return judged.select(*[F.col(f"c0.c{i}").alias(c) for i, c in enumerate(names)])
