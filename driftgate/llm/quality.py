"""Quality classifier: which of two zstandard dictionaries compresses a text better, as a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from driftgate.llm.common import fresh

BLOCK = 512  # bytes compressed at a time, so that a dictionary weighs the same at every place of a long text
PIECE = 1024  # bytes of a text that count as one sample for a dictionary
_LEAST_PIECES = 64  # below that, zstandard can't train: the texts themselves are the dictionary


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries of good and bad text, and the logistic curve from the size difference to a probability."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        options = {"level": 3, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        return tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x), **options) for x in (self.good, self.bad))

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.offset, -700, 700)))


def size_difference(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """Compressed bytes with the bad dictionary less those with the good one, by byte of text; 0 for no text."""
    raw = (text or "").encode()
    difference = 0
    for begin in range(0, len(raw), BLOCK):
        block = raw[begin : begin + BLOCK]
        difference += len(bad.compress(block)) - len(good.compress(block))
    return difference / max(len(raw), 1)


def _dictionary(texts: list[str], size: int, most_pieces: int) -> bytes:
    raw = [t.encode() for t in texts]
    # round by round, so that a long text does not take the place of many
    longest = max(map(len, raw), default=0)
    pieces = [t[i : i + PIECE] for i in range(0, longest, PIECE) for t in raw if i < len(t)][:most_pieces]
    if len(pieces) >= _LEAST_PIECES and sum(map(len, pieces)) > 2 * size:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    return b"\n".join(pieces)[-size:] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's calibration: smoothed targets, Newton steps with a slight penalty on the slope."""
    good, bad = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = float(np.abs(x).mean()) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    weights = np.zeros(2)
    penalty = np.diag([1e-3, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - target) + penalty @ weights
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(hessian, gradient)
        weights -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0] / scale), float(weights[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = 8000, most_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", dictionary_bytes: int = 112_640, most_pieces: int = 20_000) -> QualityModel | float:
    """A model from at most ``rows`` labelled texts of at most ``most_chars`` code points.

    A dictionary has at most ``dictionary_bytes`` and is trained on the first ``most_pieces`` samples of 1 024 bytes, first
    ones of all texts before second ones; texts too few to train on are themselves the dictionary, the last
    ``dictionary_bytes`` of their samples. All four bounds are of the fit alone: scores cover whole texts. The rows are
    those with the smallest hash of their id; every second one goes to the dictionaries, the others to the calibration.
    ``labels`` has 0 or 1 by id; rows with a null id, null or any other label, and ids with both labels are not used. Of
    different texts of one id the smallest is learned from. Without texts of both labels there is
    nothing to tell apart: the share of label 1 comes back (0.5 without any), and is everyone's score.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    known = known.agg(F.min(label_col).alias("_label"), F.max(label_col).alias("_most")).where("_label = _most")
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows).select("_id", "_label")
    # at most `rows` narrow rows, so small enough to be sent to every task
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).where(F.length("_text").between(1, most_chars))
    # one row an id before anything leaves the tasks, however often an id repeats
    sample = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    sample = sample.select("_id", "_text", "_label").toPandas().sort_values("_id", ignore_index=True)
    good = sample["_label"] == 1
    if good.all() or not good.any():
        return float(good.mean()) if len(sample) else 0.5
    # every second one of either label, so that both halves have both where there are two
    turn = sample.groupby("_label").cumcount() % 2 == 0
    dictionaries = sample[turn]
    model = QualityModel(
        *(_dictionary(dictionaries["_text"][which].tolist(), dictionary_bytes, most_pieces) for which in (good, ~good)), 0.0, 0.0
    )
    rest = sample[~turn] if sample[~turn]["_label"].nunique() == 2 else sample
    pair = model.compressors()
    x = np.array([size_difference(t, *pair) for t in rest["_text"]])
    return QualityModel(model.good, model.bad, *_logistic(x, rest["_label"].to_numpy()))


def score(text: Column, model: QualityModel | float) -> Column:
    """Probability that a text is of label 1, from the whole text. Null and empty texts show nothing: their difference is 0."""
    if isinstance(model, float):
        return F.lit(model)

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pair = model.compressors()
        for texts in batches:
            yield pd.Series(model.probability(np.fromiter((size_difference(t, *pair) for t in texts), np.float64, len(texts))))

    return scored(text)


def scores(docs: DataFrame, model: QualityModel | float, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) per row; predicted is 1 from ``threshold`` on. Repeated rows stay repeated, a null id stays null."""
    found = docs.select(docs[id_col], score(docs[text_col], model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: QualityModel | float, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, without the rows whose score is below ``threshold``."""
    (name,) = fresh(docs, "score")
    return docs.withColumn(name, score(docs[text_col], model)).where(F.col(name) >= threshold).select(*docs.columns)
