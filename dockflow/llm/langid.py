"""Language identification by unigram piece models that sum over all segmentations.

Each language has probabilities for the pieces of one fixed public vocabulary, fitted by expectation maximisation. A word's
probability is the sum over all its segmentations (forward algorithm); a text's is the product over its words, since no piece crosses
a border between words. The score is the posterior of the best language.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.shared import bytes_of, labelled_sample, stage, summed

WORD_START = "▁"
# Bound of the labelled sample (so there are at most as many languages); the floor is what an unseen piece or an unknown character gets.
SAMPLE_DOCS, FLOOR, ROUNDS = 2_000, 1e-7, 3
# Every character counts this much more, in all languages alike, so that long words stay within the range of doubles.
PER_CHAR = 12.0
LONG_WORD, CACHE_WORDS, CACHE_BYTES = 48, 600_000, 32 << 20  # characters; words that a worker remembers, and bytes of their scores
# Languages in order, pieces and their probabilities (piece, language); the last row is that of unknown characters.
Model = tuple[list[str], list[str], np.ndarray]


def pieces_of(vocabulary: str) -> list[str]:
    """All ordinary pieces of a sentencepiece model file, of any length, in lower case like the words."""
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    ordinary = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return sorted({sp.id_to_piece(i).lower() for i in ordinary} - {""})


class Pieces:
    """A piece list as a hash table that numpy looks substrings up in; index ``n`` is an unknown character, ``n + 1`` no piece."""

    BASE, MIX, BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), 20

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.sizes = np.array([len(p) for p in pieces] + [1, 1])
        size = 1 << self.BITS
        self.keys, self.ids, self.probes = np.zeros(size, np.uint64), np.full(size, self.n + 1, np.int32), 1
        taken = set()
        with np.errstate(over="ignore"):
            for n, at in by_length(pieces):
                keys = self._finish(self._hash(self.codes([pieces[i] for i in at]), n)[:, 0], n)
                for i, key, slot in zip(at, keys, (keys >> np.uint64(64 - self.BITS)).tolist()):
                    tries = 1
                    while slot in taken:
                        slot, tries = (slot + 1) % size, tries + 1
                    taken.add(slot)
                    self.keys[slot], self.ids[slot], self.probes = key, i, max(self.probes, tries)

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        """Code points of words of one length, a row each."""
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64)

    def _hash(self, codes: np.ndarray, size: int, before: np.ndarray | None = None) -> np.ndarray:
        """Hashes of all substrings of a size, from those of one character less if given."""
        if before is None:
            before = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
            for k in range(1, size):
                before = before[:, :-1] * self.BASE + codes[:, k - 1:]
        return before[:, :-1] * self.BASE + codes[:, size - 1:]

    def _finish(self, h, size: int):
        return (h ^ (h >> np.uint64(29))) * self.MIX + np.uint64(2 * size + 1)

    def found(self, words: list[str]) -> list[np.ndarray]:
        """For each size from 1 the piece at every start, of words of one length."""
        codes, h, out = self.codes(words), None, []
        mask = np.uint64((1 << self.BITS) - 1)
        with np.errstate(over="ignore"):
            for size in range(1, min(self.longest, codes.shape[1]) + 1):
                h = self._hash(codes, size, h)
                key = self._finish(h, size)
                at, ids = key >> np.uint64(64 - self.BITS), np.full(h.shape, self.n + 1, np.int32)
                for k in range(self.probes):
                    slot = (at + np.uint64(k)) & mask
                    ids = np.where(self.keys[slot] == key, self.ids[slot], ids)
                out.append(np.where(ids > self.n, self.n, ids) if size == 1 else ids)
        return out


def scaled(table: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The probabilities with PER_CHAR for each character; the last row, no piece, is 0."""
    return np.vstack([table, np.zeros(table.shape[1])]) * PER_CHAR ** sizes[:, None]


def by_length(words: list[str]) -> list[tuple[int, list[int]]]:
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    return sorted(groups.items())


def forward(found: list[np.ndarray], n: int, table: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations, per word and language, for words of length ``n``; long ones are rescaled on the way."""
    rows, k = len(found[0]), table.shape[1]
    last = np.zeros((len(found), rows, k))  # sums of the last prefixes, that of end e at e modulo the number of sizes
    log = np.zeros((rows, k))
    last[0] = 1.0
    for end in range(1, n + 1):
        now = np.zeros((rows, k))
        for size in range(1, min(len(found), end) + 1):
            now += last[(end - size) % len(found)] * table[found[size - 1][:, end - size]]
        last[end % len(found)] = now
        if n > LONG_WORD:
            top = last.max(axis=0)
            last /= top
            log += np.log(top)
    return log + np.log(last[n % len(found)])


def word_scores(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log probability of each word per language, up to the same amount per character."""
    out = np.zeros((len(words), table.shape[1]))
    for n, at in by_length(words):
        out[at] = forward(pieces.found([words[i] for i in at]), n, table)
    return out


def expected_counts(words: list[str], lang: np.ndarray, count: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """How often each piece is used by the words of each language, over all segmentations: forward and backward sums."""
    k = table.shape[1]
    out = np.zeros(table.size)
    for n, at in by_length(words):
        found, of = pieces.found([words[i] for i in at]), lang[at]
        p = [table[f, of[:, None]] for f in found]
        alpha, beta = np.zeros((n + 1, len(at))), np.zeros((n + 1, len(at)))
        alpha[0] = beta[n] = 1.0
        for end in range(1, n + 1):
            for size in range(1, min(len(found), end) + 1):
                alpha[end] += alpha[end - size] * p[size - 1][:, end - size]
        for start in range(n - 1, -1, -1):
            for size in range(1, min(len(found), n - start) + 1):
                beta[start] += beta[start + size] * p[size - 1][:, start]
        share = count[at] / alpha[n]
        for size, f in enumerate(found, 1):
            used = alpha[:n - size + 1].T * p[size - 1] * beta[size:].T * share[:, None]
            out += np.bincount((f * k + of[:, None]).ravel(), used.ravel(), minlength=out.size)
    return out.reshape(table.shape)


def words_of(text: bytes) -> list[str]:
    return [WORD_START + w for w in text.decode("utf-8", "replace").lower().split()]


def train(docs: DataFrame, labels: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = SAMPLE_DOCS) -> Model:
    """Fit the piece probabilities on at most ``bound`` labelled documents; ``labels`` has (key, lang) of the rows that may be learned from.

    Word counts per language are made by Spark; each round, tasks sum the expected counts of their words. No label at all gives a model
    without languages.
    """
    names = pieces_of(vocabulary)
    few = labelled_sample(docs.select(key, F.col(text).alias("t")), labels.where(F.col(lang).isNotNull()).select(key, F.col(lang).alias("l")), key, bound)
    kind = few.schema["l"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            found = Counter((x, w) for x, t in zip(b.column(0).to_pylist(), bytes_of(b.column(1))) for w in words_of(t) if len(w) <= LONG_WORD)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], b.column(0).type), pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.float64())], names=["l", "w", "c"])

    words = few.select("l", F.col("t").cast("binary")).mapInArrow(cut, f"l {kind}, w string, c double")
    counts = stage(words.groupBy("l", "w").agg(F.sum("c").alias("c")), "langid-words")
    languages = sorted(r.l for r in counts.select("l").distinct().collect())
    k, n, at = len(languages), len(names) + 1, {x: i for i, x in enumerate(languages)}
    probabilities = np.full((n, k), 1.0 / n)
    share = docs.sparkSession.sparkContext.broadcast(names)
    for _ in range(ROUNDS if k else 0):
        def expected(batches: Iterator[pa.RecordBatch], probabilities=probabilities) -> np.ndarray:
            pieces = Pieces(share.value)
            table = scaled(probabilities, pieces.sizes)
            out = np.zeros(table.shape)
            for b in batches:
                words = b.column("w").to_pylist()
                lang = np.array([at[x] for x in b.column("l").to_pylist()], int)
                out += expected_counts(words, lang, b.column("c").to_numpy(zero_copy_only=False), pieces, table)
            return out[:-1].ravel()

        used = summed(counts, expected).reshape(n, k)
        probabilities = np.maximum(used / np.maximum(used.sum(axis=0), 1e-300), FLOOR)
    return languages, names, probabilities


class Scorer:
    """Scores texts and remembers words; what it remembers is bounded."""

    def __init__(self, model: Model):
        self.languages, names, table = model
        self.pieces = Pieces(names)
        self.table = scaled(table, self.pieces.sizes)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((min(CACHE_WORDS, CACHE_BYTES // 8 // max(1, len(self.languages))), len(self.languages)))

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        cut = [words_of(t) for t in texts]
        fresh = list({w for ws in cut for w in ws}.difference(self.known))
        if len(self.known) + len(fresh) > len(self.rows):
            fresh = list({w for ws in cut for w in ws})
            self.known, self.rows = {}, self.rows if len(fresh) <= len(self.rows) else np.zeros((len(fresh), len(self.languages)))
        if fresh and self.languages:
            self.rows[len(self.known):len(self.known) + len(fresh)] = word_scores(fresh, self.pieces, self.table)
        self.known.update({w: len(self.known) + i for i, w in enumerate(fresh)})
        names, scores = [], np.zeros(len(texts))
        for i, (t, ws) in enumerate(zip(texts, cut)):
            if not self.languages or not any(c.isalpha() for w in ws for c in w[1:]):
                names.append("und")
                continue
            log = self.rows[[self.known[w] for w in ws]].sum(axis=0)
            post = np.exp(log - log.max())
            names.append(self.languages[int(post.argmax())])
            scores[i] = post.max() / post.sum()
        if any(len(w) > 256 for w in fresh):  # very long words aren't worth their memory
            self.known = {}
        return names, scores


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of whole texts. A text that is null or has no letter is ``und`` with score 0, as is every text if nothing
    was learned; at a tie the first language by name wins. Repeated rows stay; other columns are left out."""
    kind, share = docs.schema[key].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        scorer = Scorer(share.value)
        for b in batches:
            names, scores = scorer.predict(bytes_of(b.column(1)))
            yield pa.RecordBatch.from_pydict({key: b.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)})

    return docs.select(F.col(key), F.col(text).cast("binary")).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is found with a posterior of at least ``least``.

    Null texts and texts without a letter go; repeated rows stay or go together; an empty table gives no rows.
    """
    at, share = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        scorer = Scorer(share.value)
        for b in batches:
            texts = [b"" if x is None else x.encode() for x in b.column(at).to_pylist()]
            names, scores = scorer.predict(texts)
            yield b.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
