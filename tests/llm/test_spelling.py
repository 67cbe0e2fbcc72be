"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from dockflow.llm import spelling
from dockflow.llm.queries import QUERIES
from dockflow.llm.shared import table


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counts(docs):
    """Words of (doc_id, text) rows."""
    out = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def forms(words):
    """(word, form, root, n, n_near, form_n) by comparing words that share a piece with one code point left out."""
    pieces = {}
    for w in words:
        for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            pieces.setdefault(x, []).append(w)
    links = {w: set() for w in words}
    for group in pieces.values():
        for a in group:
            links[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(links[w]), None if form[w] is None else words[form[w]]) for w in words}


def test_query_by_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    assert {tuple(r) for r in QUERIES["op13_pivotal_variants"](spark, folder).collect()} == forms(counts(docs))


def test_pairs_of_dense_words(spark):
    """Few letters, so nearly all bigrams are common to all words: prefixes with ties, repeated bigrams, both ends edited."""
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(7, 12))) for _ in range(1500)} | {"a" * 7, "a" * 8, "a" * 9, "b" + "a" * 7, "aaaabaaa", "xaaaaaaa", "aaaaaaax", "abababab", "babababab"}
    got = spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()
    want = {(a, b) for a in words for b in words if a < b and near(a, b)}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_long_words(spark):
    """Words around the longest length that is found by pivots, edited anywhere."""
    rng, words = random.Random(4), set()
    for n in (62, 63, 64, 65, 66, 300):
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz"):
            w = "".join(rng.choice(letters) for _ in range(n))
            words.add(w)
            for i in {0, 1, n // 2 - 1, n // 2, n // 2 + 1, n - 1}:
                words |= {w[:i] + w[i + 1:], w[:i] + "z" + w[i:], w[:i] + "y" + w[i + 1:]}
    got = spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()
    assert sorted((r.a, r.b) for r in got) == sorted((a, b) for a in words for b in words if a < b and near(a, b))


def test_pivots():
    rng = random.Random(3)
    for _ in range(300):
        at = rng.sample(range(12), rng.randrange(3, 8))
        grams = [(rng.randrange(20), i) for i in at]
        cost = dict((i, c) for c, i in grams)
        best = min(cost[a] + cost[b] for a in at for b in at if a + 2 <= b)
        a, b = spelling.pivots(grams)
        assert a + 2 <= b and cost[a] + cost[b] == best


def test_cases(spark):
    schema = "doc_id long, text string, word string, n int"
    word = "corresponding"
    rows = [(1, f"{word} " * 200 + f"corespondng {word[:-1]} corespondng " + "short words ÀÉÇÈÊËÌ×÷ 1234567 " * 3), (2, f"{word[:-1]} {word.upper()}x " * 12), (3, None), (4, ""),
            (None, f"corespondng {word}x"), (None, f"corespondng {word}x"), (1, f"{word} "), (5, "Straße STRASSE naïvetés naïvetéß " * 2), (6, "p" * 100_000 + " " + "p" * 100_000)]
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame([(*r, "x", 1) for r in rows], schema)).collect()}
    assert got == forms(counts(rows)) and any(r[1] for r in got)
    assert spelling.variants(spark.createDataFrame([], schema)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None, "", 1)], schema)).count() == 0


def test_roots(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w3"), ("y", "z")], "word string, form string")
    got = {r.word: r.root for r in spelling.roots(chain).collect()}
    assert got == {**{f"w{i}": "w11" for i in range(11)}, "x": "w11", "y": "z"}
