"""Quality by compression: zstandard dictionaries of good and bad text, and a calibrated size difference."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, held_out, training_sample


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries (None where a class is missing) and the logistic calibration of the size features."""

    good: bytes | None
    bad: bytes | None
    weights: tuple[float, ...]
    prior: float
    level: int = 3


class Scorer:
    def __init__(self, model: QualityModel):
        self.model = model
        self.usable = model.good is not None and model.bad is not None
        if self.usable:
            self.pair = [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), 5))
        for i, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "replace")
            g, b = (len(c.compress(raw)) for c in self.pair)
            size = np.log1p(len(raw))
            diff = (g - b) / max(g, b)
            out[i] = 1.0, diff, diff * size, size, g / (len(raw) + 16.0)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.usable or not self.model.weights:
            return np.full(len(texts), self.model.prior)
        z = self.features(texts) @ np.array(self.model.weights)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (y - p)) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_bytes: int = 20_000, dict_bytes: int = 65_536) -> QualityModel:
    """Learns from at most ``per_class`` labelled rows of each class (texts up to ``max_bytes`` bytes).

    Two thirds of each class train its dictionary, the rest the calibration. Dictionaries that can't be
    trained (too little text) are made of the text itself. With one class only, every score is its share. Null labels, null
    ids, null and empty texts teach nothing; equal texts of one class count once; empty tables give a score of 0.5.
    """
    n = {r["y"]: r["n"] for r in labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("quality").cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    rows = sorted({(r["text"], r["y"]) for r in training_sample(docs, labels, "quality", per_class, max_bytes).collect()}, key=lambda r: (zlib_crc(r[0]), r[0], r[1]))
    texts = {y: [t for t, own in rows if own == y] for y in (0, 1)}
    total = sum(n.values())
    prior = n.get(1, 0) / total if total else 0.5
    if min(map(len, texts.values())) < 3:
        return QualityModel(None, None, (), prior)
    part = {y: t[: 2 * len(t) // 3] for y, t in texts.items()}
    dicts = {}
    for y, own in part.items():
        samples = [t.encode("utf-8", "replace") for t in own]
        pieces = [s[i : i + 4096] for s in samples for i in range(0, len(s), 4096)]
        try:
            dicts[y] = zstandard.train_dictionary(dict_bytes, pieces).as_bytes()
        except zstandard.ZstdError:
            dicts[y] = b"".join(samples)[-dict_bytes:]
    rest = [(t, y) for y in (0, 1) for t in texts[y][len(part[y]) :]]
    scorer = Scorer(QualityModel(dicts[1], dicts[0], (), prior))
    x, y = scorer.features([t for t, _ in rest]), np.array([y for _, y in rest], dtype=float)
    share = np.where(y == 1, n[1] / max(1, (y == 1).sum()), n[0] / max(1, (y == 0).sum()))
    weights = _logistic(x, y, share * len(y) / share.sum())
    return QualityModel(dicts[1], dicts[0], tuple(map(float, weights)), prior)


def zlib_crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (P(good), 0 to 1) and predicted (score >= threshold) of every whole text.

    Null and empty texts get the score of the empty text; long ones are compressed whole. Repeated rows are scored alike;
    other columns are not read; an empty table gives no rows.
    """

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")

    def factory():
        scorer = Scorer(model)
        return lambda texts: {"score": scorer.scores(texts).tolist()}

    scored = add_columns(own, "text", "score double", factory)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
