"""Quality classifier: compressed sizes under dictionaries of good and of bad text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, sample, table, text_batches, utf8

#: The fit takes at most so many labelled rows of each label, those of the least hash.
SAMPLE_ROWS = 1500
DICT_BYTES = 64 << 10
#: Each chunk is compressed by itself, so that a long text's own history doesn't replace
#: the dictionary.
CHUNK = 512


class QualityModel:
    """Two zstandard dictionaries and a logistic curve over the size difference."""

    def __init__(self, good: list[bytes], bad: list[bytes], level: int = 1):
        self.level, self.dicts = level, [self._dictionary(good, 0), self._dictionary(bad, 1)]
        self.curve = (0.0, 0.0)
        self._zip = None

    @staticmethod
    def _dictionary(texts: list[bytes], side: int) -> bytes:
        chunks = [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
        held = sum(map(len, chunks))
        try:
            return zstandard.train_dictionary(min(DICT_BYTES, max(1024, held // 8)), chunks).as_bytes()
        except zstandard.ZstdError:  # too little text: its own bytes serve as a raw dictionary
            return b"".join(chunks) or (b"good text", b"bad text")[side]

    def __getstate__(self):
        return {**self.__dict__, "_zip": None}

    def difference(self, text: bytes) -> float:
        """(size under the bad dictionary - size under the good one) / their sum."""
        if self._zip is None:
            self._zip = [zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress for d in self.dicts]
        good, bad = self._zip
        g = b = 0
        for at in range(0, len(text), CHUNK):
            part = text[at : at + CHUNK]
            g += len(good(part))
            b += len(bad(part))
        return (b - g) / (b + g) if b + g else 0.0

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> None:
        """Logistic fit of the label on the difference by Newton steps: slope (with a small
        ridge, so that labels told apart without fault have a curve too) and intercept. weight:
        how many labelled rows a row of the sample stands for."""
        if not len(x) or y.min() == y.max():
            self.curve = (0.0, 4.0 if not len(y) or y.max() else -4.0)
            return
        mean, std = float(x.mean()), float(x.std() or 1.0)
        z = np.stack([(x - mean) / std, np.ones_like(x)], 1)
        weight, ridge = np.ones(len(x)) if weight is None else weight * len(x) / weight.sum(), np.array([0.05, 1e-9])
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (weight * (p - y)) + ridge * w
            hess = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
            w -= np.linalg.solve(hess, grad)
        slope = max(float(w[0]), 1e-3) / std
        self.curve = (slope, float(w[1]) - slope * mean)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] * self.difference(text) + self.curve[1], -30, 30))))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fits on labelled rows whose crc32(doc_id as text) mod 4 is not 2: at most
    `sample_rows` of each label, those of the least hash of the id, with their whole texts: a documented
    bound that lets the driver hold them. Two thirds make the dictionaries, the rest the
    curve, in which each row weighs as many usable labels as it stands for."""
    got = sample(docs, labels, "quality", remainder(F.col("doc_id"), 4) != 2, {0: sample_rows, 1: sample_rows})
    sides = {side: [t.encode() for s, t in got if s == side] for side in (0, 1)}
    parts = {s: ([t for i, t in enumerate(v) if i % 3], [t for i, t in enumerate(v) if i % 3 == 0]) for s, v in sides.items()}
    model = QualityModel(parts[1][0], parts[0][0])
    held = [(model.difference(t), s) for s in (0, 1) for t in parts[s][1] if t]
    usable = labels.where(remainder(F.col("doc_id"), 4) != 2).groupBy("quality").count().collect()
    stands = {r["quality"]: r["count"] / max(1, len(sides[r["quality"]])) for r in usable if r["quality"] in sides}
    model.calibrate(np.array([x for x, _ in held]), np.array([y for _, y in held]), np.array([stands.get(y, 1.0) for _, y in held]))
    return model


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.7, keep_only: bool = False, text_col: str = "text") -> DataFrame:
    """`docs` with score double (0 to 1, higher: better) and predicted int (score >=
    threshold); keep_only: the rows of `docs` with predicted 1, unchanged.

    Scores take whole texts. Null and empty texts have difference 0 and the curve's score
    there. Every row is scored by itself: repeated rows, ties and other columns need no
    rule; columns that are already named score or predicted are replaced. One map over Arrow batches, no shuffle; the model is at most two dictionaries.
    """
    text_batches(docs.sparkSession)
    docs = docs if keep_only else docs.drop("score", "predicted")
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            score = np.array([shared.value.score(t) for t in utf8(b.column(at))], np.float64)
            if keep_only:
                yield b.filter(pa.array(score >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    if keep_only:
        return docs.mapInArrow(run, docs.schema)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_quality over all of `documents`, fitted on `labels` outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
