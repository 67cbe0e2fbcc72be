"""Quality classifier: cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its value into grades:
P(grade <= k) = sigmoid(threshold_k - value). It gives the expected grade and the chance of each grade or better.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.hashing import PLAIN, Known, Words, informative, reduced
from dockflow.llm.shared import bytes_of, descend, labelled_sample, stage

SHAPES = 64  # places for the text's shape, before those of the chosen features
SAMPLE_DOCS, STEPS, RATE, L2 = 5_000, 30, 0.15, 1e-4
# Features with their weights, weights of the shape, thresholds.
Model = tuple[dict[int, float], np.ndarray, np.ndarray]
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,")
CAPITALS = bytes(range(65, 91))


def shape(text: bytes, words: list[bytes], distinct: int) -> list[int]:
    """Places of the text's shape, eight steps each: share of signs, of capitals, of distinct words, of words equal to the one before."""
    n, k = max(len(text), 1), max(len(words), 1)
    same = sum(map(bytes.__eq__, words, words[1:]))
    shares = ((n - len(text.translate(None, MARKS))) / n * 4, (n - len(text.translate(None, CAPITALS))) / n * 2, distinct / k, same / k * 2)
    return [8 * i + min(7, int(8 * s)) for i, s in enumerate(shares)] + [32 + min(31, len(words).bit_length())]


def split(text: bytes) -> tuple[list[bytes], set[bytes]]:
    words = text.translate(PLAIN).replace(b".", b" ").split()
    return words, set(words)


def value_of(text: bytes, values: Words, forms: np.ndarray) -> float:
    """The shared linear value: mean weight of the distinct words times the root of their number, plus the shape's weights."""
    words, distinct = split(text)
    root = max(len(distinct), 1) ** 0.5
    return sum([values[w] for w in distinct]) / root + float(forms[shape(text, words, len(distinct))].sum())


def thresholds(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free numbers: the first, then positive steps."""
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def gradient_for(grades: int):
    def gradient(weights: np.ndarray, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        w, raw = weights[:-(grades - 1)], weights[-(grades - 1):]
        cuts = np.concatenate([[-1e9], thresholds(raw), [1e9]])
        g = np.zeros(len(weights) + 1)
        for b in batches:
            y, root = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "root"))
            ids, forms = b.column("ids").flatten().to_numpy() + SHAPES, b.column("forms").flatten().to_numpy()
            doc = np.repeat(np.arange(len(y)), np.diff(b.column("ids").offsets.to_numpy()))
            form_doc = np.repeat(np.arange(len(y)), np.diff(b.column("forms").offsets.to_numpy()))
            eta = np.bincount(doc, w[ids], len(y)) / root + np.bincount(form_doc, w[forms], len(y))
            upper, lower = (1 / (1 + np.exp(-np.clip(cuts[y + k] - eta, -50, 50))) for k in (1, 0))
            p = np.maximum(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            d = du - dl  # d loss / d value
            g[:len(w)] += np.bincount(ids, (d / root)[doc], len(w)) + np.bincount(forms, d[form_doc], len(w))
            t = (np.bincount(y, dl, grades + 1) - np.bincount(y + 1, du, grades + 1))[1:-1]  # d loss / d thresholds
            g[len(w)] += t.sum()
            for j, step in enumerate(np.exp(raw[1:]), 1):
                g[len(w) + j] += t[j:].sum() * step
            g[-1] += len(y)
        return g

    return gradient


def train(docs: DataFrame, ratings: DataFrame, grades: int, key: str = "doc_id", text: str = "text", grade: str = "grade", bound: int = SAMPLE_DOCS) -> Model:
    """Weights and thresholds from at most ``bound`` rated documents (grades 0 .. grades - 1, two at least); without ratings the start values."""
    ok = F.col(grade).between(0, grades - 1)
    few = labelled_sample(docs.select(key, F.col(text).cast("binary").alias("t")), ratings.where(ok).select(key, F.col(grade).cast("int").alias("y")), key, bound)

    def run(batches: Iterator[pa.RecordBatch]):
        known = Known()
        for b in batches:
            out = {"root": [], "ids": [], "forms": []}
            for t in bytes_of(b.column(1)):
                words, distinct = split(t)
                out["root"].append(max(len(distinct), 1) ** 0.5)
                out["ids"].append([f for w in distinct for f in known[w]])
                out["forms"].append(shape(t, words, len(distinct)))
            ints = pa.list_(pa.int32())
            ids = pa.array(out["ids"], ints)
            yield pa.RecordBatch.from_pydict({"y": b.column(0), "ids": ids, "at": ids, "root": pa.array(out["root"], pa.float64()), "forms": pa.array(out["forms"], ints)})

    data = stage(few.select("y", "t").mapInArrow(run, "y int, ids array<int>, at array<int>, root double, forms array<int>"), "ordinal-examples")
    ids, _ = informative(data, grades - 1)
    start = np.zeros(SHAPES + len(ids) + grades - 1)
    start[-(grades - 1)] = -1.0
    w = descend(reduced(data, ids, "ordinal-reduced"), gradient_for(grades), start, STEPS, RATE, L2)
    return dict(zip(ids.tolist(), w[SHAPES:-(grades - 1)].tolist())), w[:SHAPES], thresholds(w[-(grades - 1):])


def rate(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, value, expected_grade, tails array<double>): tails[k - 1] is the chance of grade k or better, k from 1.

    Null and empty texts are rated by their shape alone; a text of any length is rated as a whole. Repeated rows stay; other columns are
    left out, whatever their names; an empty table gives no rows. Equal texts have equal values.
    """
    kind, share = docs.schema[key].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        weights, forms, cuts = share.value
        values = Words(weights)
        for b in batches:
            eta = np.array([value_of(t, values, forms) for t in bytes_of(b.column(1))]).reshape(-1, 1)
            tails = 1 / (1 + np.exp(-np.clip(eta - cuts[None, :], -50, 50)))
            yield pa.RecordBatch.from_pydict({key: b.column(0), "value": pa.array(eta.ravel(), pa.float64()), "expected_grade": pa.array(tails.sum(axis=1)), "tails": pa.array(list(tails), pa.list_(pa.float64()))})

    return docs.select(F.col(key), F.col(text).cast("binary")).mapInArrow(run, f"`{key}` {kind}, value double, expected_grade double, tails array<double>")
