"""Toxicity by multiple-instance learning: sentences are scored, documents combine them by noisy-or.

A sentence's logit is a bias plus the weights of the hashed words and word beginnings it holds; its probability p
enters the document's 1 - prod(1 - p). The weights are learnt from document labels alone, on a bounded sample, by
proximal gradient steps (L1) on the documents' log loss, whose gradient gives each sentence its responsibility.
The model is one array of fixed size, broadcast; scoring is a single pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, BASE, BASE_INV, mix, powers, prefix_hash, release, spans, texts, tidy, trim, word_bounds
from .samples import fold, labelled

#: Hash buckets of the features.
BUCKETS = 1 << 19
#: Beginnings of words, in bytes, that are features beside the whole word.
STARTS = (4, 5, 6)
#: Documents of each label that training reads at most.
PER_CLASS = 1200
STEPS = 120
FOLDS = 5
SLICE = 1 << 20

_ENDS = np.zeros(256, bool)
_ENDS[[*b".!?\n"]] = True
_STRIP = np.zeros(256, bool)
_STRIP[[*b".,;:!?\"'()[]{}|*#%&$"]] = True


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets (words x features), each word's sentence, each sentence's row, first byte and end.

    Sentences end at . ! ? or a line's end and never cross rows.
    """
    n = len(off) - 1
    gaps = np.arange(n, dtype=np.int64)
    flat = np.full(len(data) + n, 0x0A, np.uint8)
    flat[np.arange(len(data)) + np.repeat(gaps, np.diff(off))] = _LOWER[data]
    bare = np.where(_STRIP[flat], np.uint8(0x20), flat)
    start, end = word_bounds(bare)
    p = prefix_hash(bare)
    stops = np.concatenate([np.zeros(1, np.int64), np.cumsum(_ENDS[flat])])
    raw = stops[start] if len(start) else np.zeros(0, np.int64)
    first = np.ones(len(raw), bool)
    first[1:] = raw[1:] != raw[:-1]
    sent = np.cumsum(first) - 1
    row = np.searchsorted(off[1:] + gaps + 1, start[first], "right")
    at = np.flatnonzero(first)
    last = np.concatenate([at[1:] - 1, [len(start) - 1]]) if len(at) else at
    inv = powers(len(p), BASE_INV)
    cols = []
    with np.errstate(over="ignore"):
        for k in (0, *STARTS):
            stop = end if k == 0 else np.minimum(start + k, end)
            h = mix((p[stop] - p[start]) * inv[start] + np.uint64(k))
            cols.append((h >> np.uint64(64 - int(BUCKETS).bit_length() + 1)).astype(np.int32))
    return np.stack(cols, 1) if cols else np.zeros((0, 1), np.int32), sent, row, np.stack([start[at] - row, end[last] - row], 1) if len(at) else np.zeros((0, 2), np.int64)


def sentence_logits(x: np.ndarray, sent: np.ndarray, n: int, w: np.ndarray, bias: float) -> np.ndarray:
    return bias + np.bincount(sent, sum(w[x[:, c]] for c in range(x.shape[1])), minlength=n)


def noisy_or(z: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Documents' log(1 - P): minus the sum of softplus of their sentences' logits."""
    return -np.bincount(row, np.logaddexp(0, z), minlength=n)


def train(samples: list[tuple[bytes, int]], steps: int = STEPS, l1: float = 4e-6, rate: float = 0.08) -> tuple[np.ndarray, float]:
    """Weights and bias. Without samples of both labels everything scores by a constant."""
    y = np.array([s[1] for s in samples], float)
    w = np.zeros(BUCKETS, np.float64)
    if len(set(y.tolist())) < 2:
        return w.astype(np.float32), -20.0 if not y.sum() else 2.0
    data = np.frombuffer(b"".join(s[0] for s in samples), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(s[0]) for s in samples])]).astype(np.int64)
    pieces, n_sent = [], 0
    for i, j in spans(off, SLICE):  # as when scoring, so that the arrays of positions stay small
        fx, fs, fr, _ = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
        pieces.append((fx, (fs + n_sent).astype(np.int32), (fr + i).astype(np.int32)))
        n_sent += len(fr)
    x, sent, row = (np.concatenate(c) for c in zip(*pieces, strict=True))
    del pieces
    # Start: how much likelier a feature's presence makes the label, damped; noisy-or needs a start off zero
    doc = row[sent]
    pres = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for j in range(x.shape[1]):
        pair = np.unique(doc.astype(np.int64) * BUCKETS + x[:, j])
        for c in (0, 1):
            pres[c] += np.bincount((pair % BUCKETS)[y[pair // BUCKETS] == c], minlength=BUCKETS)
    pos, neg = max(y.sum(), 1), max((1 - y).sum(), 1)
    odds = np.log((pres[1] / pos + 2 / pos) / (pres[0] / neg + 2 / neg))
    w = np.where(pres[1] + pres[0] >= 3, np.clip(odds, 0, 4) * (odds > 1.5), 0.0)
    bias = -6.0
    used = np.flatnonzero(np.bincount(x.ravel(), minlength=BUCKETS))
    number = np.zeros(BUCKETS, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    # words repeat: a step works on the distinct ones and spreads their sums
    key = np.zeros(len(x), np.uint64)
    with np.errstate(over="ignore"):
        for c in range(x.shape[1]):
            key = (key + x[:, c].astype(np.uint64) + np.uint64(1)) * BASE
    _, at, which = np.unique(key, return_index=True, return_inverse=True)
    words, which = number[x[at]], which.astype(np.int32)
    del x, key
    w = w[used]
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    ns, nd = len(row), len(y)
    for t in range(1, steps + 1):
        z = bias + np.bincount(sent, sum(w[words[:, c]] for c in range(words.shape[1]))[which], minlength=ns)
        log_not = noisy_or(z, row, nd)
        p = -np.expm1(log_not)
        # d loss / d log(1 - P): -1 without the label, (1 - P) / P with it; times d / dz = -sigmoid(z)
        g_doc = np.where(y == 1, np.exp(log_not) / np.maximum(p, 1e-9), -1.0) * weight
        gz = -g_doc[row] / (1 + np.exp(-np.clip(z, -60, 60)))
        of_word = np.bincount(which, gz[sent], minlength=len(words))
        gw = sum(np.bincount(words[:, c], of_word, minlength=len(used)) for c in range(words.shape[1]))
        gb = gz.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= a * m / (np.sqrt(v) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - a * l1 / (np.sqrt(v) + 1e-6), 0)
        bias -= a * mb / (np.sqrt(vb) + 1e-6)
    out = np.zeros(BUCKETS, np.float32)
    out[used] = w
    return out, float(bias)


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score, predicted, and the likeliest sentence: its score, first byte and end in the text's UTF-8.

    A null or blank text has no sentence: score 0 and null positions. Rows pass one by one, repeated or not, a null doc_id
    included; other columns are ignored; an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = model.value
        for b in batches:
            data, off = texts(b)
            for i, j in spans(off, SLICE):
                n, base = j - i, off[i]
                x, sent, row, where = features(data[base : off[j]], off[i : j + 1] - base)
                z = sentence_logits(x, sent, len(row), w, b0)
                s = -np.expm1(noisy_or(z, row, n))
                worst = np.full(n, -1)
                order = np.argsort(z, kind="stable")
                worst[row[order]] = order
                has = worst >= 0
                at = np.where(has[:, None], where[worst] if len(where) else 0, 0) - (off[i:j] - base)[:, None] * has[:, None]
                p = np.where(has, 1 / (1 + np.exp(-np.clip(z[worst], -60, 60))) if len(z) else 0.0, 0.0)
                yield pa.record_batch(
                    [b.column(0).slice(i, n), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(p, mask=~has), pa.array(at[:, 0], mask=~has), pa.array(at[:, 1], mask=~has)],
                    ["doc_id", "score", "predicted", "sentence_score", "sentence_start", "sentence_end"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, predicted int, sentence_score double, sentence_start bigint, sentence_end bigint"
    )


def clean(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """The rows of docs whose score is below 0.5, with all their columns (null and blank texts stay)."""
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = model.value
        for b in batches:
            data, off = texts(b)
            for i, j in spans(off, SLICE):
                x, sent, row, _ = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                p = -np.expm1(noisy_or(sentence_logits(x, sent, len(row), w, b0), row, j - i))
                yield b.slice(i, j - i).filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, **bounds: int) -> tuple[np.ndarray, float]:
    """The model of the labelled rows outside the held-out fold; bounds: text_bytes and label_bytes of samples.labelled."""
    model = train(labelled(docs, labels, "toxic", fold(F.col("doc_id"), FOLDS) != 0, per_class, **bounds))
    trim()
    release(docs.sparkSession)
    return model


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, *fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", "predicted", "sentence_score", "sentence_start", "sentence_end")
