"""Operator 9: language identification with string kernels.

A text's features are the character n-grams of length 1 to ``spectrum`` that it holds (presence, not counts), blended in
one set and hashed to ``DIMENSIONS`` places. The kernel of two texts is the size of their sets' intersection over the
root of the product of their sizes. Nyström landmarks (``per_language`` texts of each language at most) span the feature
space; kernel ridge regression, one language against the rest, gives a weight to each landmark. Because the kernel is a
product of presence vectors, landmarks and weights fold into one matrix of n-grams by languages, and a batch of texts is
scored as presence matrix times that matrix, divided by the root of each text's number of n-grams.

Training uses a bounded sample of labelled rows: about ``SAMPLE`` rows of each language, chosen by a hash of the id and the
text, and fewer where there are many languages, so that a model learns from ``ROWS`` rows and ``MARKS`` landmarks at most.
Of a chosen text its distinct n-grams, which tasks extract from the whole of it, reach the driver: at most ``DIMENSIONS``
numbers each. Prediction sees the text alone, and all of it.

Nulls and ties: a null text, or one without any letter, is ``und`` with score 0; so is every text if no labelled row
has a text. Languages that tie go to the first by name. An empty table gives an empty result. Other columns of the
input pass through ``predict`` untouched, except that its own two columns, ``lang_pred`` and ``score`` or as ``names``
says, replace any of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 15
SAMPLE = 500
LABELS = 1000
ROWS = 20_000
PER_LANGUAGE = 48
MARKS = 2_000
RIDGE = 0.05


def has_letter(text: str | None) -> bool:
    """Whether a text holds a character of a letter category."""
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str, spectrum: int = 3) -> np.ndarray:
    """The places of the n-grams of ``text``, each once."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found = np.zeros(DIMENSIONS, bool)
    code = np.zeros(len(points), np.uint64)
    for n in range(1, spectrum + 1):
        if len(points) < n:
            break
        code = code[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        found[((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)] = True
    return np.flatnonzero(found)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # DIMENSIONS x languages


def presence(places: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(places), DIMENSIONS), np.float32)
    for row, at in zip(out, places):
        row[at] = 1
    return out


def fit(places: list[np.ndarray], languages: list[str], per_language: int = PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Nyström kernel ridge regression on the n-grams of texts; the first ``per_language`` texts of each language are
    landmarks, fewer where there are more than MARKS / ``per_language`` languages."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32))
    per_language = max(1, min(per_language, MARKS // len(names)))
    seen: dict[str, int] = {}
    marks = []
    for k, lang in enumerate(languages):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= per_language and len(places[k]):
            marks.append(k)
    landmarks = presence([places[k] for k in marks])
    landmarks /= np.sqrt(np.maximum(1, landmarks.sum(1, keepdims=True)))
    kernel = []
    for at in range(0, len(places), 128):
        block = presence(places[at : at + 128])
        kernel.append((block @ landmarks.T) / np.sqrt(np.maximum(1, block.sum(1, keepdims=True))))
    rows = np.concatenate(kernel).astype(np.float64)
    own, turn = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    root = turn / np.sqrt(np.maximum(own, 1e-6 * own.max()))  # kernel of landmarks to the power -1/2
    features = rows @ root
    goal = np.where(np.array(languages)[:, None] == np.array(names)[None], 1.0, -1.0)
    balance = 1 / (goal > 0).sum(0)[[names.index(x) for x in languages]]
    balance *= len(languages) / balance.sum()
    left = (features * balance[:, None]).T @ features + ridge * np.eye(features.shape[1])
    weights = root @ np.linalg.solve(left, (features * balance[:, None]).T @ goal)
    return Model(names, (landmarks.T.astype(np.float64) @ weights).astype(np.float32))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE) -> DataFrame:
    """(_place, _id, _text, _lang) of about ``rows`` labelled rows of each language, by a hash; all of a language with fewer.

    With many languages there are fewer of each, ROWS in all. More than LABELS languages are an error."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = labelled.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("_n"))
    found = counts.limit(LABELS + 1).collect()
    if len(found) > LABELS:
        raise ValueError(f"more than {LABELS} languages are labelled")
    rows = min(rows, ROWS // max(1, len(found)))
    place = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(9)), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = labelled.select(place.alias("_place"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    return chosen.join(F.broadcast(docs.sparkSession.createDataFrame(found, counts.schema)), "_lang").where(F.col("_place") * F.col("_n") < rows)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the labelled rows of ``docs``; what reaches the driver is bounded by ROWS times DIMENSIONS."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keep = [k for k, t in enumerate(texts) if has_letter(t)]
            found = pa.array([grams(texts[k]).astype("<u2").tobytes() for k in keep], pa.binary())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), found], names=["place", "lang", "grams"])

    rows = sample(docs, id_col, text_col, lang_col).select("_place", "_text", "_lang").mapInArrow(task, "place double, lang string, grams binary").collect()
    rows.sort(key=lambda r: (r["place"], r["lang"], bytes(r["grams"])))
    return fit([np.frombuffer(bytes(r["grams"]), "<u2").astype(np.int64) for r in rows], [r["lang"] for r in rows])


def score(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """The best language of each text and a score from 0 to 1."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return names, scores
    asked = [k for k, t in enumerate(texts) if has_letter(t)]
    for at in range(0, len(asked), 64):
        part = asked[at : at + 64]
        block = presence([grams(texts[k]) for k in part])
        margins = (block @ model.weights) / np.sqrt(np.maximum(1, block.sum(1, keepdims=True)))
        for k, best, margin in zip(part, margins.argmax(1), margins.max(1)):
            names[k], scores[k] = model.languages[best], float(min(1.0, max(0.0, (margin + 1) / 2)))
    return names, scores


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two more columns: the language and its score."""
    kept = [c for c in docs.columns if c not in names]
    fields = [f for f in docs.schema.fields if f.name in kept]
    where = kept.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = score(batch.column(where).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*kept, *names])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return docs.select(*kept).mapInArrow(task, StructType([*fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))
