"""Hashed word features and the choice of those that tell labels apart."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dockflow.llm.shared import stage, summed

BITS, BEGINNINGS = 18, (4, 5, 6)
CACHE_WORDS = 400_000
# Likelihood ratio that a feature must reach to be used: about one in 10,000 features does so by chance.
LEAST_RATIO = 15.0

# lower case for A-Z, sentence ends as full stops, other signs and blanks as blanks; bytes of other letters stay
_TO = bytearray(range(256))
for _c in range(128):
    _ch = chr(_c)
    _TO[_c] = ord(".") if _ch in ".!?\n\r" else ord(_ch.lower()) if _ch.isalnum() else ord(" ")
PLAIN = bytes(_TO)


def features(word: bytes) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(b"w" + word) & mask] + [zlib.crc32(b"p" + word[:n]) & mask for n in BEGINNINGS if len(word) >= n]


class Words(dict):
    """Sum of a word's weights, remembered; cleared when it has grown to its bound. ``weights``: feature to weight."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        v = sum([self.weights.get(f, 0.0) for f in features(word)])
        if len(word) <= 64:
            self[word] = v
        return v


class Known(dict):
    """Features of words, remembered."""

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        v = self[word] = features(word)
        return v


def _ratio(a: np.ndarray, c: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Likelihood ratio (G squared) of a feature in ``a`` of ``n1`` positive and ``c`` of ``n0`` other documents."""
    def part(x, expected):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    f, n = a + c, max(n1 + n0, 1.0)
    return 2 * (part(a, f * n1 / n) + part(c, f * n0 / n) + part(n1 - a, (n - f) * n1 / n) + part(n0 - c, (n - f) * n0 / n))


def informative(examples: DataFrame, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, log odds): the features whose documents differ in y >= k for some k from 1 to ``top``, y and ids being columns 0 and 1.

    Tasks sum document counts per hashed feature, so what is gathered has a fixed size.
    """
    size = 1 << BITS

    def counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((top + 1, size + 1))
        for b in batches:
            for y, ids in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.unique(np.asarray(ids.values))
                for k in range(y + 1):  # row k counts documents with y >= k
                    out[k, ids] += 1
                    out[k, size] += 1
        return out.ravel()

    total = summed(examples.select("y", "ids"), counts)
    if total is None:
        return np.zeros(0, int), np.zeros(0)
    total = total.reshape(top + 1, size + 1)
    every, n = total[0, :size], total[0, size]
    best = np.zeros(size)
    for k in range(1, top + 1):
        best = np.maximum(best, _ratio(total[k, :size], every - total[k, :size], total[k, size], n - total[k, size]))
    ids = np.flatnonzero(best >= LEAST_RATIO)
    share = total[top, size] / max(n, 1.0)
    a, c = total[top, ids], every[ids] - total[top, ids]
    odds = np.log((a + 10 * share + 0.1) / (c + 10 * (1 - share) + 0.1)) - np.log((share + 1e-3) / (1 - share + 1e-3))
    return ids, odds


def reduced(examples: DataFrame, ids: np.ndarray, name: str) -> DataFrame:
    """The examples with only the chosen features, numbered in order; ``at`` is the position (sentence) of each."""
    def run(batches: Iterator[pa.RecordBatch]):
        number = np.full(1 << BITS, -1, np.int32)
        number[ids] = np.arange(len(ids))
        for b in batches:
            new_ids, new_at = [], []
            for x, s in zip(b.column("ids"), b.column("at")):
                x = number[np.asarray(x.values)]
                new_ids.append(x[x >= 0])
                new_at.append(np.asarray(s.values)[x >= 0])
            yield pa.RecordBatch.from_arrays([pa.array(new_ids, pa.list_(pa.int32())) if c == "ids" else pa.array(new_at, pa.list_(pa.int32())) if c == "at" else b.column(c)
                                              for c in b.schema.names], names=b.schema.names)

    return stage(examples.mapInArrow(run, examples.schema), name)
