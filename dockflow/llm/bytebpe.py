"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Texts are cut where a run of non-space characters (with one blank before it) begins, which is always a border of the pattern's
matches too. The library sees each distinct piece once per cache; most pieces repeat.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dockflow.llm.shared import bytes_of

# Unicode's White_Space; Python's own \s has four separators more.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD = re.compile(f" [^{SPACE}]")
# Pieces of each of the two generations that a worker remembers, and the longest that is worth it.
CACHE_PIECES, CACHE_CHARS = 300_000, 48
JOINED = 200  # words that the library gets as one text


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    rest = [b for b in range(256) if b not in out]
    out.update({b: chr(0x100 + i) for i, b in enumerate(rest)})
    return [out[b] for b in range(256)]


def byte_table(tokenizer: Tokenizer) -> np.ndarray:
    """The bytes of every id, as objects: the byte table backwards. Special tokens stand for their own text."""
    back = {c: b for b, c in enumerate(byte_characters())}
    table = np.full(max(tokenizer.get_vocab().values(), default=-1) + 1, b"", object)
    for token, i in tokenizer.get_vocab().items():
        table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return table


def decode_bytes(ids, table: np.ndarray) -> bytes:
    return b"".join(table[np.asarray(ids, np.intp)].tolist())


class Encoder:
    """A tokenizer with the remembered ids of pieces; ids are little-endian unsigned 32-bit integers.

    When the remembered pieces are too many, those that come again are taken over from the generation before, the others are forgotten.
    """

    def __init__(self, model: str):
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        self.table = byte_table(self.tokenizer)
        self.lengths = np.array([len(x) for x in self.table], np.int64)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [PIECES.findall(t) for t in texts]
        pieces = set().union(*cut)
        fresh = pieces.difference(self.known)
        if len(self.known) + len(fresh) > CACHE_PIECES:
            self.known, self.before, fresh = {}, self.known, pieces
        ask = []
        for piece in fresh:
            ids = self.before.get(piece)
            if ids is None:
                ask.append(piece)
            else:
                self.known[piece] = ids
        self.learn(ask)
        out = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        for piece in ask:
            if len(piece) > CACHE_CHARS:
                del self.known[piece]
        return out

    def learn(self, pieces: list[str]) -> None:
        """Remembers the ids of pieces.

        Words with their blank are asked for in rows: where one ends, matches of the pattern end, so the ids
        of a row are those of its words, and the tokens' bytes tell them apart.
        """
        words, others = [], []
        for p in pieces:
            (words if WORD.match(p) else others).append(p)
        rows = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        for row, e in zip(rows, self.tokenizer.encode_batch_fast(["".join(r) for r in rows], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.cumsum([len(p.encode()) for p in row])
            stops = (4 * (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1)).tolist()
            raw, start = ids.tobytes(), 0
            for piece, stop in zip(row, stops):
                self.known[piece], start = raw[start:stop], stop
        for piece, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            self.known[piece] = np.array(e.ids, "<u4").tobytes()


def _model(path: str) -> str:
    with open(path, encoding="utf-8") as f:  # a small public file of the machine that states the plan; its text travels with the tasks
        return f.read()


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """Token ids of whole texts: (key, ids array<int>), with ``offsets`` also (starts, ends) in code points.

    A null or empty text has no ids. A character that is split over tokens gives each of them its own span. Special tokens' strings
    are ordinary text. Repeated rows stay; other columns are left out.
    """
    model = docs.sparkSession.sparkContext.broadcast(_model(vocabulary))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        enc = Encoder(model.value)
        for b in batches:
            texts = [x.decode("utf-8", "replace") for x in bytes_of(b.column(1))]
            cols = {key: b.column(0)}
            if offsets:
                es = [enc.tokenizer.encode(t, add_special_tokens=False) for t in texts]
                cols["ids"] = pa.array([e.ids for e in es], pa.list_(pa.int32()))
                cols["starts"] = pa.array([[o[0] for o in e.offsets] for e in es], pa.list_(pa.int32()))
                cols["ends"] = pa.array([[o[1] for o in e.offsets] for e in es], pa.list_(pa.int32()))
            else:
                cols["ids"] = pa.array([np.frombuffer(x, "<i4") for x in enc.encode(texts)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    extra = ", starts array<int>, ends array<int>" if offsets else ""
    return docs.select(F.col(key), F.col(text).cast("binary")).mapInArrow(run, f"`{key}` {kind}, ids array<int>{extra}")


def decode(tokens: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """(key, data binary): the bytes of ``ids``; split characters come together again. Null ids give no bytes; an unknown id is an error."""
    model = tokens.sparkSession.sparkContext.broadcast(_model(vocabulary))
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        t = byte_table(Tokenizer.from_str(model.value))
        for b in batches:
            yield pa.RecordBatch.from_pydict({key: b.column(0), "data": pa.array([decode_bytes(x or (), t) for x in b.column(1).to_pylist()], pa.binary())})

    return tokens.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, data binary")


def round_trip_digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of whole texts, without keeping ids: encode and decode in one pass."""
    model = docs.sparkSession.sparkContext.broadcast(_model(vocabulary))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        enc = Encoder(model.value)
        for b in batches:
            ids = enc.encode([x.decode("utf-8", "replace") for x in bytes_of(b.column(1))])
            yield pa.RecordBatch.from_pydict({
                key: b.column(0),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(decode_bytes(np.frombuffer(x, "<u4"), enc.table)).hexdigest() for x in ids],
            })

    return docs.select(F.col(key), F.col(text).cast("binary")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
