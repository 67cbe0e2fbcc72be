"""License scans against a search for phrases and planted copies."""

import random
import re

from dockflow.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, labels string, n_words string, template int, pos int"


def base(text):
    w, at, labels = WORD.findall((text or "").encode().lower().decode()), [], set()
    for phrase, label in licences.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def scanned(spark, texts, **more):
    rows = [(i, t, "x", "y", 0, 0) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, SCHEMA), **more).collect()}


def test_base_by_force(spark):
    rng, parts = random.Random(5), ["under", "the", "MIT", "License", "apache", "version", "2", "cc", "BY", "nc", "é", "ÉÀ", "K", "x9", "字", "\U0001F642"]
    marks = [" ", "  ", "-", ", ", "\n", "\x00", "\x7f", "_", " "]
    texts = ["".join(rng.choice(parts) + rng.choice(marks) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    texts += [None, "", "  \n\t ", "under the mit license", "Under the MIT License under the mit license. CC-BY-NC cc by nc", "cc by", "Kelvin cc by nc", "...cc by nc...",
              "word " * 200_000 + "Apache License, Version 2", "cc by nc " * 3000, "a", "a b", "under the mit", "under the mit licenses", "xcc by nc"]
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), t and t[:80]
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""}


def test_copies(spark):
    notice, label = next((t, x) for t, x in licences.TEMPLATES if x == "isc")
    w, rng = notice.split(), random.Random(1)
    other = [f"w{rng.randrange(500)}" for _ in range(400)]
    edited = [x for i, x in enumerate(w) if i not in (6, 20)]  # words left out
    longer = w[:10] + ["very", "new"] + w[10:25] + ["too"] + w[25:]  # words put in
    texts = [" ".join(other[:100] + part + other[100:]) for part in (w, edited, longer, w[:8])] + [" ".join(other), notice.upper().replace(" ", ", ")]
    scattered = [x for i in range(len(w) - 2) for x in (*w[i:i + 3], *other[:30])]  # all grams, but far apart
    got = scanned(spark, [*texts, " ".join(scattered)])
    assert [got[i].labels for i in range(7)] == [label, label, label, "", "", label, ""]
    assert got[0].score == 1.0 and 0.7 <= got[1].score < 1 and 0.7 <= got[2].score < 1 and got[3].score < 0.7 and got[4].score == 0
    assert all(got[i].n_base == 0 for i in got)


def test_cases(spark):
    rows = [(1, "cc by nc", "x", "y", 0, 0)] * 3 + [(None, "cc by nc", "x", "y", 0, 0), (None, None, None, None, None, None)]
    got = sorted((str(r.doc_id), r.n_words, r.labels) for r in licences.scan(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", 3, "cc-by-nc")] * 3 + [("None", 0, ""), ("None", 3, "cc-by-nc")]
    assert licences.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    plan = licences.hits(spark.createDataFrame(rows, SCHEMA), licences.TEMPLATES, "doc_id", "text")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
