"""Spelling variants by pivotal grams: words that differ by one inserted, deleted or replaced code point.

Bigrams have one common order, rare ones first. A word's prefix is its first three bigrams in that order (with every further place of
the last of them). One edit touches at most one of two disjoint bigrams, so of two near words the one whose prefix ends first keeps one
of its two pivots in the other's prefix. The pivots are the disjoint bigrams of the prefix with the least total frequency, chosen by
dynamic programming; they are looked up in an index of prefixes, and what is found is verified.

Position limits make the lookups selective. The edit lies behind the first pivot, then what precedes the pivot and its place from the start
are unchanged; or it lies before the second, then what follows and its place from the end are. Where that fixes only few letters the
edit lies in one half of the rest and the other half is unchanged too. The unchanged parts are the key of the index, so an entry is
compared with the few words that agree in all of it. No pair is lost by this: each near pair agrees in one of these keys.

Words of more than LONGEST code points, in which bigrams are repeated so often that prefixes aren't short, are found by their halves: the
edit lies in one, the other is the key.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.shared import stage

LEAST_LENGTH, LEAST_COUNT, LEAST_TIMES = 7, 2, 10
ERASED = 31  # of so many pairs of document and run, one loses a code point
GRAM, EDITS = 2, 1
LONG = 6  # an unchanged part of so many code points is a key of its own
LONGEST = 64  # code points of a word that is found by its pivots
FLUSH_WORDS = 200_000  # distinct words that a task holds before it hands on partial counts

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def erased(doc: str, run: str) -> str:
    """The run, without one code point if 31 divides the hash of document and run."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    return run if h % ERASED else run[:h % len(run)] + run[h % len(run) + 1:]


def ascii_lower(text: str) -> str:
    return text.encode().lower().decode()  # bytes.lower changes A-Z only


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all whole texts with their numbers of occurrences, of at least the least length and number.

    A null text has no words, a null key is an empty string. Tasks add up before the shuffle, so a very frequent word is one row of
    each task.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        found: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})
            found.clear()
            return batch

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r, n in Counter(RUN.findall(ascii_lower(t))).items():
                    if len(r) >= LEAST_LENGTH:
                        w = erased(doc, r)
                        if len(w) >= LEAST_LENGTH:
                            found[w] += n
                if len(found) >= FLUSH_WORDS:
                    yield out()
        yield out()

    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def gram_order(words: DataFrame) -> dict[str, int]:
    """The place of every bigram in the common order: by number of words' places, then by itself. There are at most as many as pairs of
    letters of the word pattern, some thousands, whatever the number of words."""
    def run(batches: Iterator[pa.RecordBatch]):
        found: Counter = Counter()
        for b in batches:
            for w in b.column(0).to_pylist():
                found.update(w[i:i + GRAM] for i in range(len(w) - GRAM + 1))
        yield pa.RecordBatch.from_pydict({"g": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    counts = words.select("word").mapInArrow(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    return {r.g: k for k, r in enumerate(sorted(counts, key=lambda r: (r.n, r.g)))}


def prefix(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """(place in the order, position) of the word's first bigrams, by order; every place of the last of them belongs to it."""
    every = sorted((order[word[i:i + GRAM]], i) for i in range(len(word) - GRAM + 1))
    last = every[GRAM * EDITS][0]
    return [x for x in every if x[0] <= last]


def pivots(grams: list[tuple[int, int]], count: int = EDITS + 1) -> list[int]:
    """Positions of ``count`` disjoint bigrams of least total cost, by dynamic programming over the positions.

    ``best[j][k]`` is the least cost of k disjoint bigrams among the first j; the j-th is left out, or taken after the last one that
    ends before it. Ties go to the earlier positions.
    """
    at = sorted((i, cost) for cost, i in grams)
    best = [[(0, ())] + [None] * count]
    for j, (i, cost) in enumerate(at):
        before = sum(1 for p, _ in at[:j] if p + GRAM <= i)
        row = list(best[j])
        for k in range(1, count + 1):
            if (got := best[before][k - 1]) is not None:
                new = (got[0] + cost, (*got[1], i))
                row[k] = min(row[k], new) if row[k] is not None else new
        best.append(row)
    return list(best[-1][count][1])


def _halves(size: int) -> set[tuple[int, int]]:
    """How the other word's part may have been halved, its size being one less, equal or one more."""
    return {(s // 2, s - s // 2) for s in (size - 1, size, size + 1) if s >= 0}


def keys(word: str, i: int, behind: bool, own: bool) -> Iterator[str]:
    """The keys of the bigram at ``i``, the edit lying behind it or before it. ``own``: the pivots' keys; else those that any near word may ask for."""
    fixed, rest, side = (word[:i + GRAM], word[i + GRAM:], "<") if behind else (word[i:], word[:i], ">")
    if len(fixed) >= LONG:
        yield f"{side}{fixed}"
        return
    m = len(rest)
    ways = {(m // 2, m - m // 2)} if own else _halves(m)
    for a in {a for a, _ in ways if a <= m}:
        yield f"{side}{fixed}<{a}{rest[:a]}"
    for b in {b for _, b in ways if b <= m}:
        yield f"{side}{fixed}>{b}{rest[m - b:]}"


def half_keys(word: str, own: bool) -> Iterator[str]:
    """The halves of a long word, or what may be the halves of a near word."""
    for a, b in {(len(word) // 2, len(word) - len(word) // 2)} if own else _halves(len(word)):
        yield f"[{a} {word[:a]}"
        yield f"]{b} {word[len(word) - b:]}"


def index_rows(word: str, order: dict[str, int]) -> list[tuple[bool, int, set[str]]]:
    """(asks, end of the prefix in the order, keys) of a word. Words next to the longest length are in both indexes."""
    out = []
    if len(word) <= LONGEST:
        p = prefix(word, order)
        first, second = pivots(p)
        out.append((True, p[-1][0], {*keys(word, first, True, True), *keys(word, second, False, True)}))
        out.append((False, p[-1][0], {x for _, i in p for side in (True, False) for x in keys(word, i, side, False)}))
    if len(word) >= LONGEST:
        out += [(own, 0, set(half_keys(word, own))) for own in (True, False)]
    return out


def index(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """(key, asks, last, word, n): the pivots' keys (asks) and the prefixes' keys of every word, as 64-bit hashes."""
    share = words.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]):
        order = share.value
        for b in batches:
            at, asks, last, hashes = [], [], [], []
            for k, w in enumerate(b.column(0).to_pylist()):
                for own, end, found in index_rows(w, order):
                    hashes += [xxhash.xxh64_intdigest(x) - (1 << 63) for x in found]
                    asks += [own] * len(found)
                    at += [k] * len(found)
                    last += [end] * len(found)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(asks, pa.bool_()), pa.array(last, pa.int32()), b.column(0).take(rows), b.column(1).take(rows)],
                                             names=["key", "asks", "last", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, asks boolean, last int, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a before b: all pairs of words at one edit, each once. ``words`` (word, n) are distinct, of seven code points or more.

    Equal hashes of different keys cost a comparison only. An index entry that few words ask for is joined by equality; adaptive
    execution splits a key that very many share.
    """
    x = stage(index(words, gram_order(words)), "spelling-index")
    asking = x.where("asks").select("key", F.col("last").alias("p_last"), F.col("word").alias("p"), F.col("n").alias("p_n"))
    asked = x.where("not asks").select("key", F.col("last").alias("q_last"), F.col("word").alias("q"), F.col("n").alias("q_n"))
    near = asking.join(asked, "key").where("p_last <= q_last and p <> q and abs(length(p) - length(q)) <= 1").where(F.levenshtein("p", "q", EDITS) == EDITS)
    p, q = (F.struct(F.col(x).alias("w"), F.col(f"{x}_n").alias("n")) for x in "pq")
    pairs = near.select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    return pairs.select(F.col("a.w").alias("a"), F.col("a.n").alias("a_n"), F.col("b.w").alias("b"), F.col("b.n").alias("b_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the end of the chain of forms. Counts grow tenfold along it, so doubling the steps ends after few rounds."""
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not now.where("moved").head(1):
            return now.select("word", "root")
        now = now.drop("moved")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = LEAST_TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that is at least ``times`` its own n; its
    root is the end of the chain of forms. Null texts have no words; repeated rows count each; other columns are left out; an empty
    table gives no rows.
    """
    words = stage(word_counts(docs, key, text), "spelling-words")
    pairs = stage(near_pairs(words), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    of = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    fits = F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))
    of = stage(of.withColumns({"form": F.when(fits, F.col("form")), "form_n": F.when(fits, F.col("form_n"))}), "spelling-forms")
    ends = roots(of.where("form is not null"))
    return of.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
