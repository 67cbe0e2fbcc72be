"""Quality rules with line sequence labelling: a linear-chain conditional random field marks lines as content or boilerplate.

The Viterbi path of a text's lines gives the share of word characters that is content, which decides retention. Only documents are rated,
so the lines' labels are latent: a rating bounds the expected share of boilerplate among the document's lines, from above in a good
document and from below in a poor one. Training alternates between the label distribution nearest to the field that keeps the bounds and
the field nearest to that distribution, so which lines of a document are boilerplate is found by what they look like and by their neighbours, and
a document may have both kinds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.shared import bytes_of, descend, labelled_sample, stage

SAMPLE_DOCS, STEPS, RATE, L2 = 4_000, 40, 0.25, 1e-3
LEAST_CONTENT = 0.5
MOST_IN_GOOD, LEAST_IN_POOR = 0.15, 0.7  # expected share of boilerplate among the lines of a good and of a poor document
HALVINGS, WIDEST = 9, 16.0  # steps and range of the search for a document's shift that keeps its bound
# Fixed values of the contract.
BLANKS, SYMBOLS, LEAST_WORDS, WINDOW, MOST_REPEATED = b" \t\n\x0b\x0c\r", b"#*$%&|<>", 10, 5, 20

SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,")
CAPITALS, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
STEPS_OF = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])  # borders of the eight steps of a share
N_SHARES, N_FEATURES = 5, 5 * 8 + 2 * 2 + 16
# Weights of the features (for boilerplate), then of the transitions content-boilerplate, boilerplate-content and staying boilerplate.
N_WEIGHTS = N_FEATURES + 3


def step(x: float) -> int:
    return int(np.searchsorted(STEPS_OF, x))


_STEP = [step(i / 1000) for i in range(1001)]


def line_features(line: bytes, words: list[bytes], repeated: bool) -> list[int]:
    """Active features: steps of the shares of signs, capitals, digits, neighbouring equal words and repeated words; how the line ends,
    whether it came before, and its number of words."""
    n, k = len(line), len(words)
    shares = ((n - len(line.translate(None, SIGNS))) / n, (n - len(line.translate(None, CAPITALS))) / n, (n - len(line.translate(None, DIGITS))) / n,
              sum(map(bytes.__eq__, words, words[1:])) / k, 1 - len(set(words)) / k)
    return [8 * i + _STEP[int(1000 * s)] for i, s in enumerate(shares)] + [40 + (words[-1][-1:] in b".!?\"'"), 42 + repeated, 44 + min(15, k.bit_length())]


def lines_of(text: bytes) -> tuple[list[list[int]], list[int], int]:
    """(features, word bytes) of the lines with a word, and how many of them equal an earlier line."""
    seen, feats, size, dup = set(), [], [], 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            dup += again
            seen.add(line)
            feats.append(line_features(line, words, again))
            size.append(sum(map(len, words)))
    return feats, size, dup


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five words that are found twice or more, the first time included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    d = len(ids)
    if d == n:
        return 0
    if d ** WINDOW < 2**62:
        code = w[:n - 4]
        for k in range(1, WINDOW):
            code = code * d + w[k:n - 4 + k]
    else:  # number pairs, then pairs of pairs, so that codes stay exact
        pair = np.unique(w[:-1] * d + w[1:], return_inverse=True)[1]
        four = np.unique(pair[:-2] * n + pair[2:], return_inverse=True)[1]
        code = four[:n - 4] * d + w[4:]
    _, back, count = np.unique(code, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[back] > 1)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + WINDOW, -1)
    return int((np.cumsum(mark)[:n] > 0).sum())


def viterbi(emit: list[float], transitions: tuple[float, float, float]) -> list[bool]:
    """The best path, true for boilerplate; content wins ties. ``emit``: a line's score for boilerplate against content."""
    enter, leave, stay = transitions
    content, boiler, back = 0.0, emit[0] if emit else 0.0, []
    for e in emit[1:]:
        from_b, to_b = boiler + leave > content, boiler + stay > content + enter
        back.append((from_b, to_b))
        content, boiler = (boiler + leave if from_b else content), (boiler + stay if to_b else content + enter) + e
    state = boiler > content
    path = [state]
    for from_b, to_b in reversed(back):
        state = to_b if state else from_b
        path.append(state)
    return path[::-1][:len(emit)]


def judge(text: bytes, weights: list[float]) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept) of a text."""
    words = text.split()
    feats, size, dup = lines_of(text)
    solid = text.translate(None, BLANKS)
    chars = len(solid.decode("utf-8", "replace"))
    repeat = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeat > MOST_REPEATED * len(words)
    path = viterbi([sum([weights[f] for f in x]) for x in feats], tuple(weights[N_FEATURES:]))
    total = sum(size)
    share = sum(n for n, b in zip(size, path) if not b) / total if total else 0.0
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), dup, repeat, failed, share, not failed and share >= LEAST_CONTENT


class Chains:
    """The lines of several texts as chains, the longest first: at each position the texts that have a line there are the first ones."""

    def __init__(self, n: np.ndarray):
        self.order = np.argsort(-n, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(n)])[:-1][self.order]
        self.n = n[self.order]
        self.alive = [int(x) for x in len(n) - np.searchsorted(np.sort(n), np.arange(int(n.max(initial=0))), side="right")]

    def marginals(self, score: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of boilerplate of every line, and expected numbers of the transitions to, from and within boilerplate, by forward and
        backward sums. ``score``: a line's score for boilerplate against content."""
        alpha, log_z, p, pairs = [], np.zeros(len(self.n)), np.zeros(len(score)), np.zeros(3)
        for i, k in enumerate(self.alive):
            now = np.stack([np.zeros(k), score[self.first[:k] + i]], axis=1)
            if i:
                now = now + np.logaddexp(alpha[-1][:k, 0, None] + move[0], alpha[-1][:k, 1, None] + move[1])
            alpha.append(now)
        beta = np.zeros((0, 2))
        for i in range(len(self.alive) - 1, -1, -1):
            k, m, cur = self.alive[i], len(beta), np.zeros((self.alive[i], 2))
            log_z[m:k] = np.logaddexp(alpha[i][m:, 0], alpha[i][m:, 1])  # texts that end here
            if m:
                after = beta + np.stack([np.zeros(m), score[self.first[:m] + i + 1]], axis=1)
                cur[:m] = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
                both = np.exp(alpha[i][:m, :, None] + move[None] + after[:, None, :] - log_z[:m, None, None])
                pairs += [both[:, 0, 1].sum(), both[:, 1, 0].sum(), both[:, 1, 1].sum()]
            p[self.first[:k] + i] = np.exp(alpha[i][:, 1] + cur[:, 1] - log_z[:k])
            beta = cur
        return p, pairs


def gradient(weights: np.ndarray, batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """Summed gradient of the divergence of the field from the nearest label distributions that keep the ratings' bounds; last the number of lines.

    That distribution is the field with one shift of all line scores of a document, found by halving; it is zero where the bound holds.
    The gradient is what the field expects of each feature less what the bounded distribution expects.
    """
    w, (enter, leave, stay) = weights[:N_FEATURES], weights[N_FEATURES:]
    move = np.array([[0.0, enter], [leave, stay]])
    g = np.zeros(N_WEIGHTS + 1)
    for b in batches:
        y, n = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "n"))
        ids = b.column("ids").flatten().to_numpy().reshape(-1, 8)
        g[-1] += len(ids)
        y, n = y[n > 0], n[n > 0]
        if not len(n):
            continue
        score, doc = w[ids].sum(axis=1), np.repeat(np.arange(len(n)), n)
        share = np.bincount(doc, Chains(n).marginals(score, move)[0]) / n
        off = np.where(y == 1, share < LEAST_IN_POOR, share > MOST_IN_GOOD)
        if not off.any():
            continue
        lines, y, n = off[doc], y[off], n[off]
        score, ids, doc = score[lines], ids[lines], np.repeat(np.arange(len(n)), n)
        chains, bound = Chains(n), np.where(y == 1, LEAST_IN_POOR, MOST_IN_GOOD)
        low, high = np.where(y == 1, 0.0, -WIDEST), np.where(y == 1, WIDEST, 0.0)
        for _ in range(HALVINGS):
            middle = (low + high) / 2
            below = np.bincount(doc, chains.marginals(score + middle[doc], move)[0]) / n < bound
            low, high = np.where(below, middle, low), np.where(below, high, middle)
        p, moves = chains.marginals(score, move)
        q, wanted = chains.marginals(score + ((low + high) / 2)[doc], move)
        np.add.at(g, ids.ravel(), np.repeat(p - q, 8))
        g[N_FEATURES:N_FEATURES + 3] += moves - wanted
    return g


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", bound: int = SAMPLE_DOCS) -> list[float]:
    """Weights of the field from at most ``bound`` rated documents (quality 1 good, 0 poor); without ratings all lines are content."""
    few = labelled_sample(docs.select(key, F.col(text).cast("binary").alias("t")), labels.where(F.col(quality).isin(0, 1)).select(key, (1 - F.col(quality)).cast("int").alias("y")), key, bound)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            feats = [lines_of(t)[0] for t in bytes_of(b.column(1))]
            yield pa.RecordBatch.from_pydict({"y": b.column(0), "n": pa.array([len(x) for x in feats], pa.int32()), "ids": pa.array([[f for x in fs for f in x] for fs in feats], pa.list_(pa.int32()))})

    data = stage(few.select("y", "t").mapInArrow(run, "y int, n int, ids array<int>"), "linecrf-examples")
    return descend(data.coalesce(8), gradient, np.zeros(N_WEIGHTS), STEPS, RATE, L2).tolist()


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def rules(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts, base_failed, content_share, kept) of whole texts; null is a text without words, which fails.

    Repeated rows stay; other columns are left out; an empty table gives no rows. A tie between labels is content. A text of any length is
    judged as a whole.
    """
    kind, names = docs.schema[key].dataType.simpleString(), [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = [judge(t, weights) for t in bytes_of(b.column(1))]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(list(c), pa.bool_() if n in ("base_failed", "kept") else pa.float64() if n == "content_share" else pa.int64()) for n, c in zip(names, cols)], names=[key, *names])

    return docs.select(F.col(key), F.col(text).cast("binary")).mapInArrow(run, f"`{key}` {kind}, {COLUMNS}")


def keep_good(docs: DataFrame, weights: list[float], text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep; null texts go, repeated rows stay or go together."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts = [b"" if x is None else x.encode() for x in b.column(at).to_pylist()]
            yield b.filter(pa.array([judge(t, weights)[-1] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
