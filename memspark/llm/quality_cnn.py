"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover it whole (the last one reaches back
so that it is full). Learned filters run over windows of eight bytes, every four bytes;
each filter's activations are max-pooled within a chunk, and the chunks' pooled vectors
are combined, by mean and by maximum, into one logistic probability. As a filter is linear in
the embedded bytes, its value is a sum of four look-ups by byte pair.

Training runs on the driver over a bounded sample of labelled rows outside the
held-out fold (``EACH`` of each class at most, so scores are odds between classes of
equal weight); scoring is one pass over all rows.

Defined cases: a null or empty text is one chunk of zero bytes; texts of any length are
scored whole; repeated rows get the same score; without labels of both kinds all scores are the
prior; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import pieces, two_columns
from .labels import fold, sample

#: Training rows of each class, at most.
EACH = 1000
EMBED, FILTERS, WIDTH, STEP, WINDOWS = 6, 16, 8, 4, 256
CHUNK = STEP * WINDOWS + WIDTH - STEP
THRESHOLD = 0.3


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all chunks, index of each text's first chunk)."""
    parts, first = [], []
    for x in texts:
        first.append(len(parts))
        if len(x) <= CHUNK:
            parts.append(x.ljust(CHUNK, b"\0"))
        else:
            parts += [x[i:i + CHUNK] for i in range(0, len(x) - CHUNK, STEP * WINDOWS)]
            parts.append(x[-CHUNK:])
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, CHUNK), np.array(first, np.int64)


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 1, (256, EMBED)).astype(np.float32), "filters": r.normal(0, 0.2, (WIDTH, EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32), "out": r.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "shift": np.zeros(1, np.float32),
        }

    def tables(self) -> list[np.ndarray]:
        """Filter values by byte pair, for the four pairs of a window."""
        by_byte = self.p["embed"] @ self.p["filters"]
        # the first byte of a pair is the low half of its number
        return [(by_byte[o][None, :, :] + by_byte[o + 1][:, None, :]).reshape(1 << 16, FILTERS) for o in range(0, WIDTH, 2)]

    def responses(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """(chunk, window, filter) values."""
        pairs = x.view("<u2")
        h = tables[0].take(pairs[:, 0:2 * WINDOWS:2], axis=0)
        for k in range(1, WIDTH // 2):
            h += tables[k].take(pairs[:, k:k + 2 * WINDOWS:2], axis=0)
        return h

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, log odds) of each text."""
        z = np.maximum(pooled + self.p["bias"], 0)
        n = np.diff(np.append(first, len(z)))[:, None]
        features = np.hstack([np.add.reduceat(z, first) / n, np.maximum.reduceat(z, first)])
        return features, features @ self.p["out"] + self.p["shift"][0]

    def score(self, texts: list[bytes], tables: list[np.ndarray], at_once: int = 512) -> np.ndarray:
        x, first = chunks(texts)
        pooled = np.concatenate([self.responses(x[i:i + at_once], tables).max(axis=1) for i in range(0, len(x), at_once)])
        return 1 / (1 + np.exp(-self.combine(pooled, first)[1].astype(np.float64)))

    def train(self, texts: list[bytes], labels: list[int], epochs: int = 5, batch: int = 64, rate: float = 0.01) -> None:
        """Adam on the logistic loss; only the window that gave a chunk's maximum learns."""
        y, r = np.array(labels, np.float32), np.random.default_rng(11)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for s in range(0, len(order), batch):
                some = order[s:s + batch]
                x, first = chunks([texts[i] for i in some])
                h = self.responses(x, self.tables())
                best = h.argmax(axis=1)
                pooled = np.take_along_axis(h, best[:, None, :], 1)[:, 0, :]
                features, odds = self.combine(pooled, first)
                error = (1 / (1 + np.exp(-odds)) - y[some]) / len(some)
                n = np.diff(np.append(first, len(x)))
                of = np.repeat(np.arange(len(some)), n)
                z = np.maximum(pooled + self.p["bias"], 0)
                is_max = z == features[of, FILTERS:]
                back = error[of][:, None] * (self.p["out"][:FILTERS] / n[of][:, None] + self.p["out"][FILTERS:] * is_max) * (z > 0)
                grad = {"out": features.T @ error, "shift": error.sum(keepdims=True), "bias": back.sum(0), "embed": np.zeros_like(self.p["embed"]), "filters": np.zeros_like(self.p["filters"])}
                rows = np.arange(len(x))[:, None]
                for o in range(WIDTH):
                    at = x[rows, STEP * best + o].astype(np.int64) * FILTERS + np.arange(FILTERS)
                    by_byte = np.bincount(at.ravel(), weights=back.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
                    grad["embed"] += by_byte @ self.p["filters"][o].T
                    grad["filters"][o] = self.p["embed"].T @ by_byte
                t += 1
                for k, g in grad.items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.p[k] -= (rate * (mean[k] / (1 - 0.9 ** t)) / (np.sqrt(square[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 5, held: int = 0, each: int = EACH) -> Network:
    texts, y, counts = sample(docs, labels, target, folds, held, each)
    net = Network()
    if 0 < sum(y) < len(y):
        net.train(texts, y)
    else:
        net.p["out"][:] = 0
        net.p["shift"][:] = np.log((counts[1] + 1) / (counts[0] + 1))
    return net


def score(docs: DataFrame, net: Network, folds: int = 5, held: int = 0, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for rows, texts in pieces(batches, "text", 1 << 20):
            p = net.score(texts, tables)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = two_columns(docs, id_col, text_col).withColumn("held_out", fold(F.col("doc_id"), folds, held))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
