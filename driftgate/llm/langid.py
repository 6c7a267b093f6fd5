"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BITS = 17  # of the hashed feature space
LONGEST = 3  # characters of an n-gram
_CHUNK = 1 << 20  # places whose n-grams are hashed at a time
_MOST_LANGUAGES = 1000
_OTHER = re.compile(r"[\W\d_]+")


def _points(text: str) -> np.ndarray:
    """Code points of the text with letters lower-cased and everything between them one blank, a blank at either end."""
    return np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), "<u4")


def _grams(points: np.ndarray, starts: int) -> np.ndarray:
    """Hashed features of the n-grams that begin at one of the first ``starts`` places."""
    points = points.astype(np.uint64)
    found = []
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        m = max(min(len(points) - n + 1, starts), 0)
        rolled = rolled[:m] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 : n - 1 + m] + np.uint64(n)
        found.append((rolled * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(found)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and how often each occurs in the whole text."""
    points = _points(text)
    if len(points) <= _CHUNK:
        return np.unique(_grams(points, len(points)), return_counts=True)
    total = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(points), _CHUNK):  # each n-gram counts where it begins, and may reach across the cut
        total += np.bincount(_grams(points[at : at + _CHUNK + LONGEST - 1], _CHUNK), minlength=1 << BITS)
    index = np.flatnonzero(total)
    return index.astype(np.int32), total[index]


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    rows: np.ndarray  # of weights by feature, -1 where the penalty has left none
    weights: np.ndarray  # (features with weights, languages)
    temperature: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        index, counts = features(text)
        values = (1 + np.log(counts)) * self.idf[index]
        return index, values / max(np.linalg.norm(values), 1e-12)

    def logits(self, text: str) -> np.ndarray:
        index, values = self.vector(text)
        row = self.rows[index]
        on = row >= 0
        return values[on] @ self.weights[row[on]]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability; ``und`` and 0 for a text that is null or has no letter."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(vectors: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, n_classes: int, epochs: int = 4, alpha: float = 2.0,
          beta: float = 1.0, l1: float = 0.01, l2: float = 0.01, seed: int = 7) -> np.ndarray:
    """Weights (features, classes) by follow-the-regularised-leader with per-coordinate rates and both penalties."""
    z = np.zeros((1 << BITS, n_classes))
    n = np.zeros((1 << BITS, n_classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(vectors)):
            index, values = vectors[i]
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            error = _softmax(values @ w)
            error[classes[i]] -= 1
            gradient = values[:, None] * error
            squared = ni + gradient**2
            z[index] = zi + gradient - (np.sqrt(squared) - np.sqrt(ni)) / alpha * w
            n[index] = squared
    return weights(z, n)


def _temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The one divisor of all logits that makes the held-back rows likeliest, on a fine grid."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    loss = [-np.log(_softmax(logits / t)[np.arange(len(classes)), classes].clip(1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """How many of all rows of the text column hold each feature; a vector of fixed length comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                counts[features(value.as_py())[0]] += 1
            rows += batch.num_rows
        on = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, -1)), pa.array(np.append(counts[on], rows))], names=["feature", "df"])

    found = texts.mapInArrow(run, "feature bigint, df bigint").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    frequencies = np.zeros(1 << BITS, np.int64)
    known = found[found["feature"] >= 0]
    frequencies[known["feature"].to_numpy()] = known["df"].to_numpy()
    return int(found.loc[found["feature"] < 0, "df"].sum()), frequencies


def fit(docs: DataFrame, rows_per_language: int = 1000, most_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> LanguageModel:
    """A model of the languages named in ``docs``.

    Document frequencies are of all texts. The weights are fitted to about ``rows_per_language`` texts of each language,
    the ones whose hash falls under that share, never more than twice as many in all, and only texts of at most
    ``most_chars`` code points; these bounds are of the fit alone. Every fifth of them sets the temperature. Rows with a
    null text or language and texts without a letter are not learned from; without any, everything is ``und``.
    """
    known = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), docs[lang_col].alias("_lang"))
    known = known.where(F.col("_text").isNotNull() & F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}"))
    short = known.where(F.length("_text") <= most_chars)
    sizes = {r[0]: r[1] for r in short.groupBy("_lang").count().limit(_MOST_LANGUAGES + 1).collect()}
    if len(sizes) > _MOST_LANGUAGES:
        raise ValueError(f"more than {_MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(1 << BITS), np.full(1 << BITS, -1), np.zeros((0, 0)), 1.0)
    draw = F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for language, size in sizes.items():
        share = F.when(F.col("_lang") == language, F.lit(min(1.0, rows_per_language / size))).otherwise(share)
    sample = short.withColumn("_draw", draw).where(F.col("_draw") < share)
    sample = sample.select("_id", "_text", "_lang", "_draw").orderBy("_draw", "_id").limit(2 * rows_per_language * len(languages)).toPandas()

    total, frequencies = document_frequencies(known.select("_text"))
    idf = np.log((1 + total) / (1 + frequencies)) + 1
    blank = LanguageModel(languages, idf, np.full(1 << BITS, -1), np.zeros((0, len(languages))), 1.0)
    vectors = [blank.vector(t) for t in sample["_text"]]
    classes = sample["_lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    held = sample.groupby("_lang").cumcount().to_numpy() % 5 == 4
    learned = [v for v, h in zip(vectors, held, strict=True) if not h]
    weights = train(learned, classes[~held], len(languages))
    on = np.flatnonzero(np.abs(weights).sum(axis=1))
    rows = np.full(1 << BITS, -1, np.int32)
    rows[on] = np.arange(len(on))
    model = LanguageModel(languages, idf, rows, weights[on], 1.0)
    calibration = held if held.any() else ~held
    logits = np.array([model.logits(t) for t, c in zip(sample["_text"], calibration, strict=True) if c])
    return LanguageModel(languages, idf, rows, weights[on], _temperature(logits, classes[calibration]))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row, from the whole text; repeated rows stay repeated, a null id stays null."""
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.predict(value.as_py()) for value in batch.column(1)]
            columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "lang_pred", "score"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema['_id'].dataType.simpleString()}, lang_pred string, score double")
