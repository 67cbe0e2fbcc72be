"""Toxicity by multiple-instance learning: a document is toxic if a sentence is.

Each sentence has a logistic score over hashed words and word beginnings; the document's score is their noisy-or, and only document
labels are needed to train it. Scores of single sentences then show where the offence is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.hashing import PLAIN, Known, Words, informative, reduced
from dockflow.llm.shared import bytes_of, descend, labelled_sample, stage

SAMPLE_DOCS, STEPS, RATE, L2, START_BIAS = 6_000, 25, 0.15, 1e-4, -5.0
# Features with their weights, and the bias of a sentence.
Model = tuple[dict[int, float], float]

SENTENCE = re.compile(r"[^.!?\n\r]+")


def sentences(text: bytes) -> list[set[bytes]]:
    """The distinct words of each sentence that has one."""
    out = [set(s.split()) for s in text.translate(PLAIN).split(b".")]
    return [s for s in out if s]


def sentence_logits(text: bytes, words: Words, bias: float) -> list[float]:
    return [bias + sum([words[w] for w in s]) for s in sentences(text)]


def noisy_or(logits: list[float]) -> float:
    """1 - prod(1 - p): no sentence gives 0."""
    return float(-np.expm1(-np.logaddexp(0.0, logits).sum())) if logits else 0.0


def examples(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, bound: int) -> DataFrame:
    """The bounded sample as (y, ids, at, n): features of all sentences, the sentence of each, and the number of sentences."""
    few = labelled_sample(docs.select(key, F.col(text).cast("binary").alias("t")), labels.where(F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("y")), key, bound)

    def run(batches: Iterator[pa.RecordBatch]):
        known = Known()
        for b in batches:
            ids, at, n = [], [], []
            for t in bytes_of(b.column(1)):
                ss = [[f for w in s for f in known[w]] for s in sentences(t)]
                ids.append([f for s in ss for f in s])
                at.append(np.repeat(np.arange(len(ss), dtype=np.int32), [len(s) for s in ss]))
                n.append(len(ss))
            yield pa.RecordBatch.from_pydict({"y": b.column(0), "ids": pa.array(ids, pa.list_(pa.int32())), "at": pa.array(at, pa.list_(pa.int32())), "n": pa.array(n, pa.int32())})

    return stage(few.select("y", "t").mapInArrow(run, "y int, ids array<int>, at array<int>, n int"), "toxicity-examples")


def gradient(weights: np.ndarray, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """Summed gradient of the documents' log loss; last the number of documents."""
    w, bias = weights[:-1], weights[-1]
    g = np.zeros(len(weights) + 1)
    for b in batches:
        y, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "n"))
        ids, at = b.column("ids").flatten().to_numpy(), b.column("at").flatten().to_numpy()
        first = np.concatenate([[0], np.cumsum(n)])
        doc = np.repeat(np.arange(len(y)), n)  # of each sentence
        sentence = at + np.repeat(first[:-1], np.diff(b.column("ids").offsets.to_numpy()))
        z = bias + np.bincount(sentence, w[ids], first[-1])
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        s = np.clip(np.bincount(doc, np.logaddexp(0.0, z), len(y)), 1e-12, 50.0)
        d = np.where(y == 1, -1 / np.expm1(s), 1.0)[doc] * p  # d loss / d z of each sentence
        g[-2] += d.sum()
        g[:len(w)] += np.bincount(ids, d[sentence], len(w))
        g[-1] += len(y)
    return g


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = SAMPLE_DOCS) -> Model:
    """Weights of the telling features and the bias, learned from the labels of at most ``bound`` documents; without labels nothing is toxic."""
    data = examples(docs, labels, key, text, label, bound)
    ids, odds = informative(data, 1)
    w = descend(reduced(data, ids, "toxicity-reduced"), gradient, np.append(odds, START_BIAS), STEPS, RATE, L2)
    return dict(zip(ids.tolist(), w[:-1].tolist())), float(w[-1])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, n_sentences, worst): noisy-or of the whole text's sentences, their number and the largest sentence score.

    Null and empty texts score 0; a text of any length is scored as a whole. Repeated rows stay; other columns are left out, whatever their
    names; an empty table gives no rows. Equally bad sentences are told by their score only.
    """
    kind, share = docs.schema[key].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        words, bias = Words(share.value[0]), share.value[1]
        for b in batches:
            logits = [sentence_logits(t, words, bias) for t in bytes_of(b.column(1))]
            yield pa.RecordBatch.from_pydict({
                key: b.column(0), "score": pa.array([noisy_or(z) for z in logits], pa.float64()), "n_sentences": pa.array([len(z) for z in logits], pa.int64()),
                "worst": pa.array([1 / (1 + np.exp(-max(z))) if z else 0.0 for z in logits], pa.float64())})

    return docs.select(F.col(key), F.col(text).cast("binary")).mapInArrow(run, f"`{key}` {kind}, score double, n_sentences long, worst double")


def locate(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The offending sentences: one row each with (key, start, end, sentence, score), code points, for sentence scores of at least ``least``."""
    kind, share = docs.schema[key].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        words, bias = Words(share.value[0]), share.value[1]
        for b in batches:
            rows = {key: [], "start": [], "end": [], "sentence": [], "score": []}
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for m in SENTENCE.finditer(t or ""):
                    z = sentence_logits(m[0].encode(), words, bias)
                    p = 1 / (1 + np.exp(-z[0])) if z else 0.0
                    if z and p >= least:
                        for name, v in zip(rows, (k, m.start(), m.end(), m[0], float(p))):
                            rows[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[key], b.column(0).type), pa.array(rows["start"], pa.int64()), pa.array(rows["end"], pa.int64()), pa.array(rows["sentence"], pa.string()), pa.array(rows["score"], pa.float64())], names=list(rows))

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, end long, sentence string, score double")
