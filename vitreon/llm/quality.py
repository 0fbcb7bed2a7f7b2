"""Quality by compression: zstandard dictionaries of good and of bad text compete for each document.

Two dictionaries are built from a bounded sample of labelled texts. A document is compressed in blocks with
either; the difference of the two sizes, relative to their sum, is the feature. Texts whose own repetition makes
either dictionary useless are told apart by the ratio of compressed to plain size. A logistic curve, fitted on
labelled texts that built no dictionary, turns both into a calibrated score. The model has a fixed size and is broadcast;
scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy
from .samples import fold, labelled

#: Labelled documents of each label that training reads at most.
PER_CLASS = 2500
#: Bytes of either dictionary, and of the blocks that are compressed on their own.
DICT_BYTES = 112 << 10
BLOCK = 4 << 10
LEVEL = 3
FOLDS = 3
HELD = 1


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of these texts; too few of them to train one serve as they are, up to its size."""
    import zstandard

    pieces = [p[i : i + 1024] for t in texts for p in _blocks(t) for i in range(0, len(p), 1024)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:DICT_BYTES]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def one(d: bytes):
            kind = zstandard.ZstdCompressionDict(d) if d else None
            if kind is not None:
                kind.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.good, self.bad = one(good), one(bad)

    def features(self, text: bytes) -> tuple[float, float, float]:
        """1, the normalised difference of sizes, and compressed to plain size; an empty text has (1, 0, 0)."""
        if not text:
            return 1.0, 0.0, 0.0
        g = b = 0
        for p in _blocks(text):
            g += len(self.good(p))
            b += len(self.bad(p))
        return 1.0, (b - g) / (b + g), min(2.0, min(g, b) / len(text))


_BASIS = 6


def _expand(f: np.ndarray) -> np.ndarray:
    d, r = f[:, 1] * 10, f[:, 2]
    return np.stack([f[:, 0], d, r, d * r, r * r, d * d], 1)


def calibrate(f: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps, both labels weighing alike."""
    x, beta = _expand(f), np.zeros(_BASIS)
    w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (p - y)) + ridge * 1e-2 * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * 1e-2 * np.eye(_BASIS)
        step = np.linalg.solve(h, g)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def train(samples: list[tuple[bytes, int]]) -> tuple[bytes, bytes, np.ndarray]:
    """Both dictionaries and the curve: every second text of a label builds, the others calibrate."""
    good, bad = [t for t, y in samples if y == 1], [t for t, y in samples if y == 0]
    dg, db = dictionary(good[::2]), dictionary(bad[::2])
    rest = [(t, 1) for t in good[1::2]] + [(t, 0) for t in bad[1::2]]
    y = np.array([y for _, y in rest], float)
    if len(set(y.tolist())) < 2:
        beta = np.zeros(_BASIS)
        beta[0] = 0.0 if not samples else (3.0 if good else -3.0)
        return dg, db, beta
    c = Compressors(dg, db)
    return dg, db, calibrate(np.array([c.features(t) for t, _ in rest]), y)


_made: dict[int, Compressors] = {}


def score(docs: DataFrame, model: tuple[bytes, bytes, np.ndarray]) -> DataFrame:
    """doc_id, score (1: good), predicted, difference, ratio. A null text scores as the empty one; rows pass one
    by one, repeated or not, a null doc_id included; other columns are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dg, db, beta = shared.value
        key = hash((dg, db))
        if key not in _made:
            _made.clear()
            _made[key] = Compressors(dg, db)
        c = _made[key]
        for b in batches:
            f = np.array([c.features(t.as_py() or b"") for t in b.column(1)]).reshape(-1, 3)
            s = 1 / (1 + np.exp(-np.clip(_expand(f) @ beta, -30, 30)))
            yield pa.record_batch([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(f[:, 1]), pa.array(f[:, 2])], ["doc_id", "score", "predicted", "difference", "ratio"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, difference double, ratio double")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, **bounds: int) -> tuple[bytes, bytes, np.ndarray]:
    """The model of the labelled rows outside the held-out fold; bounds: text_bytes and label_bytes of samples.labelled."""
    return train(labelled(docs, labels, "quality", fold(F.col("doc_id"), FOLDS) != HELD, per_class, **bounds))


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", "predicted", "difference", "ratio")
