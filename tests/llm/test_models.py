"""Packing, tokenizer, language, quality, toxicity and rating operators against brute force, round trips and held-out labels."""

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dockflow.llm import bytebpe, hashing, langid, linecrf, ordinal, packing, toxicity
from dockflow.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   \n\t ", "a", "Ab1 " * 5, "x" * 70_000, "word " * 3000, "é ñ 漢字 🙂    z", "same", "same"]


def odd(spark, **extra):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names the operators use."""
    rows = [(i if i != 3 else None, t, None, None, None) for i, t in enumerate(ODD)] + [(9, "same", None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("k", "t", "n", "cls", "ids", "score", "base", "spans", "kept", "length", "shard")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------------------------------------------ packing

@given(st.lists(st.integers(0, 40), max_size=60), st.sets(st.integers(1, 40), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_pack_rules(lengths, sizes):
    sizes = sorted(sizes)
    lengths = np.array([x for x in lengths if x <= sizes[-1]], int)
    costs = [packing.cost_of(s, 3, 50) for s in sizes]
    where, offset, size, fill = packing.pack(lengths, sizes, costs)
    for b in range(len(size)):
        spans = sorted((o, o + n) for o, n in zip(offset[where == b], lengths[where == b]))
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] <= fill[b] <= size[b]
        assert costs[sizes.index(size[b])] == min(c for c, s in zip(costs, sizes) if s >= fill[b])  # cut down to the contents
    assert lengths.sum() == fill.sum()


def test_pack_is_best_fit():
    """Against the same rule written with a plain search of all open bins; of equally tight ones, that which changed last."""
    rng = random.Random(4)
    for _ in range(30):
        lengths = np.array([rng.randint(0, 30) for _ in range(80)])
        sizes, costs = [8, 16, 32], [9.0, 17.0, 35.0]
        bins = []
        for step, n in enumerate(sorted(lengths.tolist(), reverse=True)):
            open_ = [b for b in bins if b[0] - b[1] >= n and b[0] > b[1]]
            if open_:
                b = min(open_, key=lambda b: (b[0] - b[1], -b[2]))
                b[1:] = b[1] + n, step
            else:
                s = min((s for s in sizes if s >= n), key=lambda s: costs[sizes.index(s)] / s)
                bins.append([s, n, step])
        assert sorted(packing.pack(lengths, sizes, costs)[3].tolist()) == sorted(b[1] for b in bins)


def test_best_fit_keeps_everything(spark):
    docs = odd(spark)
    out = packing.best_fit(packing.word_lengths(docs), lengths=(16, 64), shard_rows=4).collect()
    assert sum(r.length for r in out) == sum(len((t or "").encode().split()) + 1 for t in [*ODD, "same"])
    assert all(r.length <= 64 and r.bin_offset + r.length <= r.bin_fill <= r.bin_size for r in out)
    assert sorted(r.piece for r in out if r.doc_id == 6) == list(range(-(-3001 // 64)))
    assert packing.best_fit(packing.word_lengths(empty(spark))).count() == 0


# ------------------------------------------------------------------------------------------------------ tokenizer

RANKS = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}, special_tokens={})
MODEL = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
ENCODER = bytebpe.Encoder(MODEL)


@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from([" ", "  ", "\n", " ", "\x1c", "\x85", "'s", "the", "<|endoftext|>", "123", "é"])), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_ids_are_those_of_the_ranks(text):
    ids = np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist()
    assert ids == RANKS.encode_ordinary(text)
    assert bytebpe.decode_bytes(ids, ENCODER.table) == text.encode()


class Asked:
    """The tokenizer with the texts that it was asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_library_is_asked_for_rows_of_words_once(monkeypatch):
    """Words go to the library in rows, and those that come again aren't asked for when others are forgotten."""
    monkeypatch.setattr(bytebpe, "CACHE_PIECES", 900)
    e = bytebpe.Encoder(MODEL)
    e.tokenizer = asked = Asked(e.tokenizer)
    often = "".join(f" often{i} é{i}漢\u200b it's" for i in range(100))
    for k in range(5):
        text = f"start{often}" + "".join(f" word{k}x{i}\n \n" for i in range(300)) + " " + "z" * 100
        asked.texts.clear()
        assert np.frombuffer(e.encode([text, ""])[0], "<u4").tolist() == RANKS.encode_ordinary(text)
        assert len(asked.texts) < 10 and any("often" in t for t in asked.texts) == (k == 0) and sum(len(t) for t in asked.texts) > 2000
    assert e.before and len(e.known) <= 900


def test_bpe_tables(spark):
    path, docs = P.path("byte_bpe_50k.json"), odd(spark)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.round_trip_digests(docs, path).collect()}
    want = set()
    for i, t in enumerate(ODD):
        ids = RANKS.encode_ordinary(t or "")
        want.add((i if i != 3 else None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    tokens = bytebpe.encode(docs, path, offsets=True)
    rows = {r.doc_id: r for r in tokens.collect()}
    r, t = rows[7], ODD[7]
    assert r.starts[0] == 0 and r.ends[-1] == len(t) and len(r.ids) == len(r.starts)
    assert {(a, b) for a, b in zip(r.starts, r.ends) if b - a == 1} and sum(1 for a, b in zip(r.starts, r.ends) if t[a:b].strip() == "漢") >= 2  # a split character
    assert {d.doc_id: bytes(d.data).decode() for d in bytebpe.decode(tokens, path).collect()}[7] == t
    assert bytebpe.encode(empty(spark), path).count() == 0


# ------------------------------------------------------------------------------------------------------ language

def test_forward_sums_all_segmentations():
    names = ["▁", "a", "b", "ab", "▁a", "ba", "aba"]
    pieces = langid.Pieces(names)
    table = langid.scaled(np.random.default_rng(1).random((8, 2)), pieces.sizes)

    def brute(w):
        if not w:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, len(w) + 1):
            i = names.index(w[:k]) if w[:k] in names else 7 if k == 1 else None
            if i is not None:
                total = total + table[i] * brute(w[k:])
        return total

    for w in ("▁aba", "▁xabab", "▁" + "ab" * 5):
        assert np.allclose(langid.word_scores([w], pieces, table)[0], np.log(brute(w)))
    long = "▁" + "ab" * 200
    assert np.isfinite(langid.word_scores([long], pieces, table)).all()
    both = langid.word_scores(["▁" + "ab" * 30], pieces, table)
    old, langid.LONG_WORD = langid.LONG_WORD, 1000
    try:
        assert np.allclose(both, langid.word_scores(["▁" + "ab" * 30], pieces, table))
    finally:
        langid.LONG_WORD = old


def test_expected_counts_cover_the_word():
    names = ["▁", "a", "b", "ab", "▁a"]
    pieces = langid.Pieces(names)
    table = langid.scaled(np.random.default_rng(2).random((6, 1)), pieces.sizes)
    used = langid.expected_counts(["▁ab", "▁bb"], np.array([0, 0]), np.array([2.0, 1.0]), pieces, table)
    assert np.isclose((used[:, 0] * np.append(pieces.sizes, 0)[:len(used)]).sum(), 2 * 3 + 3)


def test_language_cases(spark):
    docs = odd(spark)
    none = langid.train(docs, docs.select("doc_id", "lang"), P.path("piece_bpe_32k.model"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    rows = [(i, "der die das und nicht ein " * 8, "de", None, None) for i in range(20)] + [(i + 50, "the and of to in that is " * 8, "en", None, None) for i in range(20)]
    learn = spark.createDataFrame(rows, DOCS)
    model = langid.train(learn, learn.select("doc_id", "lang"), P.path("piece_bpe_32k.model"))
    probe = spark.createDataFrame([(1, "und nicht das"), (2, "that is the"), (3, None), (4, "12 34 --"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(probe, model).collect()}
    assert got[1][0] == "de" and got[2][0] == "en" and got[3] == got[4] == got[5] == ("und", 0.0)
    assert sorted(r.doc_id for r in langid.keep_known(probe.withColumn("score", F.lit(0)), model).collect()) == [1, 2]
    assert langid.predict(empty(spark), model).count() == 0


@pytest.mark.parametrize("name,least", [("op3_language_id", 0.97)])
def test_language_held_out(spark, name, least):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES[name](spark, "/root/testdata/sf0.01")
    right = got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got.count() == docs.count() and right >= least


# ------------------------------------------------------------------------------------------------------ quality rules

def base_rules(text):
    """The contract's counts in plain Python."""
    words = (text or "").encode().split()
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    mark = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    chars = sum(c not in " \t\n\x0b\x0c\r" for c in text or "")
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), dup, len(mark)


@given(st.lists(st.sampled_from(["a", "b", "cc", "é#", " ", "  ", "\n", " ", "|x"]), max_size=80).map(lambda x: " ".join(x)))
@settings(max_examples=200, deadline=None)
def test_base_counts(text):
    assert linecrf.judge(text.encode(), [0.0] * linecrf.N_WEIGHTS)[:5] == base_rules(text)


def test_repeated_words_with_many_distinct_words():
    rng = random.Random(1)
    words = [f"w{rng.randrange(9000)}" for _ in range(20_000)] + ["a", "b", "c", "d", "e"] * 2
    assert linecrf.repeated_words([w.encode() for w in words]) == base_rules(" ".join(words))[4]


def test_viterbi_is_the_best_path():
    rng = random.Random(3)
    for _ in range(200):
        emit, move = [rng.uniform(-2, 2) for _ in range(rng.randint(1, 7))], tuple(rng.uniform(-1, 1) for _ in range(3))

        def value(path):
            trans = {(0, 0): 0.0, (0, 1): move[0], (1, 0): move[1], (1, 1): move[2]}
            return sum(e for e, s in zip(emit, path) if s) + sum(trans[p] for p in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=len(emit)), key=value)
        assert [int(x) for x in linecrf.viterbi(emit, move)] == list(best)


def test_crf_gradient_by_differences():
    """The divergence from the nearest bounded distribution, found by a fine search, with all label sequences written out."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    n, ys = [3, 1, 4, 0, 5], [1, 0, 1, 0, 0]
    ids = [rng.integers(0, linecrf.N_FEATURES, 8 * k).astype(np.int32) for k in n]
    batch = pa.RecordBatch.from_pydict({"y": pa.array(ys, pa.int32()), "n": pa.array(n, pa.int32()), "ids": pa.array(ids, pa.list_(pa.int32()))})
    w = rng.normal(size=linecrf.N_WEIGHTS) * 0.3

    def loss(w):
        total = 0.0
        move = np.array([[0.0, w[-3]], [w[-2], w[-1]]])
        for y, k, x in zip(ys, n, ids):
            if k:
                e, paths = w[x.reshape(-1, 8)].sum(axis=1), np.array(list(itertools.product((0, 1), repeat=k)))
                score = np.array([e @ p + sum(move[a, b] for a, b in zip(p, p[1:])) for p in paths])
                share = paths.mean(axis=1)

                def at(shift):
                    q = score + shift * share * k
                    return np.exp(q - np.logaddexp.reduce(q))

                p, bound = at(0.0), linecrf.LEAST_IN_POOR if y else linecrf.MOST_IN_GOOD
                if (p @ share < bound) if y else (p @ share > bound):
                    low, high = -30.0, 30.0
                    for _ in range(80):
                        low, high = ((low + high) / 2, high) if at((low + high) / 2) @ share < bound else (low, (low + high) / 2)
                    q = at(low)
                    total += q @ np.log(q / p)
        return total

    old, linecrf.HALVINGS = linecrf.HALVINGS, 45
    try:
        g = linecrf.gradient(w, [batch])
    finally:
        linecrf.HALVINGS = old
    assert g[-1] == sum(n) and np.abs(g[:-1]).max() > 0.1
    for i in [*ids[0][:5], *ids[4][:5], linecrf.N_WEIGHTS - 3, linecrf.N_WEIGHTS - 2, linecrf.N_WEIGHTS - 1]:
        d = np.zeros_like(w)
        d[i] = 1e-5
        assert np.isclose(g[i], (loss(w + d) - loss(w - d)) / 2e-5, atol=1e-4)


def test_lines_of_one_text_get_both_labels(spark):
    """Boilerplate lines planted into clean documents of the given tables: they are marked, the clean lines aren't."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    weights = linecrf.train(docs, labels)
    assert weights[-1] > 0  # neighbours share labels
    rated = docs.join(labels, "doc_id").where("text is not null").select("doc_id", "text", "quality").collect()
    clean = [[x for x in r.text.split("\n") if len(x.split()) > 8] for r in rated if r.quality == 1]
    poor = [x for r in rated if r.quality == 0 for x in r.text.split("\n") if len(x.split()) > 3]
    judged = [linecrf.judge("\n".join(lines[:6]).encode(), weights)[6] for lines in clean if len(lines) >= 4]
    assert len(judged) > 20 and np.mean(judged) > 0.9
    mixed, right, lines_in = 0, 0, 0
    for k, lines in enumerate(x[:6] for x in clean if len(x) >= 4):
        junk = [poor[(7 * k + j) % len(poor)] for j in range(5)]
        feats, size, _ = linecrf.lines_of("\n".join(lines + junk).encode())
        path = linecrf.viterbi([sum(weights[f] for f in x) for x in feats], tuple(weights[linecrf.N_FEATURES:]))
        mixed += 0 < sum(n for n, b in zip(size, path) if not b) / sum(size) < 1
        right += sum(not b for b in path[:len(lines)]) + sum(path[len(lines):])
        lines_in += len(path)
    assert mixed > 0.6 * len(judged) and right > 0.8 * lines_in


def test_quality_cases(spark):
    docs = odd(spark)
    rows = linecrf.rules(docs, [0.0] * linecrf.N_WEIGHTS).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_rules(ODD[r.doc_id])
    assert not any(r.kept for r in rows if r.base_failed)
    weights = linecrf.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert not any(weights)
    good = spark.createDataFrame([(1, "One two three four five six seven eight nine ten eleven."), (2, "no"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in linecrf.keep_good(good.withColumn("kept", F.lit(0)), weights).collect()] == [1]
    assert linecrf.rules(empty(spark), weights).count() == 0


def test_quality_keeps_clean_documents(spark):
    got = QUERIES["op4_line_field_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    shares = {r.quality: r.s for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert shares[1] > 0.98 and shares[0] < 0.2


# ------------------------------------------------------------------------------------------------------ toxicity and ratings

def test_noisy_or_and_gradient():
    import pyarrow as pa
    assert np.isclose(toxicity.noisy_or([0.3, -1.0]), 1 - (1 - 1 / (1 + np.exp(-0.3))) * (1 - 1 / (1 + np.exp(1.0)))) and toxicity.noisy_or([]) == 0.0
    batch = pa.RecordBatch.from_pydict({"y": pa.array([1, 0, 1], pa.int32()), "ids": pa.array([[0, 1, 2], [1], []], pa.list_(pa.int32())),
                                        "at": pa.array([[0, 0, 2], [1], []], pa.list_(pa.int32())), "n": pa.array([3, 2, 1], pa.int32())})
    w = np.array([0.4, -0.2, 0.1, -0.5])

    def loss(w):
        total = 0.0
        for y, zs in ((1, [w[0] + w[1], 0, w[2]]), (0, [0, w[1]]), (1, [0])):
            p = toxicity.noisy_or([z + w[3] for z in zs])
            total -= np.log(p if y else 1 - p)
        return total

    g = toxicity.gradient(w, [batch])
    for i in range(4):
        d = np.eye(4)[i] * 1e-6
        assert np.isclose(g[i], (loss(w + d) - loss(w - d)) / 2e-6, atol=1e-5)
    assert g[-1] == 3


def test_toxicity_cases(spark):
    docs = odd(spark)
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none[0] == {} and {r.score >= 0.5 for r in toxicity.score(docs.where("doc_id < 3"), none).collect()} == {False}
    model = ({f: 8.0 for f in hashing.features(b"idiot")[:1]}, -5.0)
    probe = spark.createDataFrame([(1, "You are fine. What an idiot! Bye"), (2, "fine"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert got[1] > 0.9 and got[2] < 0.1 and got[3] == 0.0
    assert [(r.doc_id, r.sentence, r.start, r.end) for r in toxicity.locate(probe, model).collect()] == [(1, " What an idiot", 13, 27)]
    assert toxicity.score(empty(spark), model).count() == 0


def test_toxicity_held_out(spark):
    got = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    shares = {r.toxic: r.s for r in got.groupBy("toxic").agg(F.avg("predicted").alias("s")).collect()}
    assert shares[1] > 0.85 and shares[0] < 0.02


def test_ordinal_gradient():
    import pyarrow as pa
    rng = np.random.default_rng(2)
    k = ordinal.SHAPES
    batch = pa.RecordBatch.from_pydict({"y": pa.array([0, 1, 2, 2], pa.int32()), "ids": pa.array([[0, 1], [1], [], [2, 2]], pa.list_(pa.int32())),
                                        "root": pa.array([1.4, 1.0, 1.0, 2.0]), "forms": pa.array([[0], [1, 2], [3], [0]], pa.list_(pa.int32()))})
    w = np.concatenate([rng.normal(size=k + 3) * 0.5, [-0.7, 0.2]])

    def loss(w):
        cuts = np.concatenate([[-1e9], ordinal.thresholds(w[-2:]), [1e9]])
        s = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
        total = 0.0
        for y, ids, root, forms in zip([0, 1, 2, 2], [[0, 1], [1], [], [2, 2]], [1.4, 1.0, 1.0, 2.0], [[0], [1, 2], [3], [0]]):
            eta = sum(w[k + i] for i in ids) / root + sum(w[f] for f in forms)
            total -= np.log(s(cuts[y + 1] - eta) - s(cuts[y] - eta))
        return total

    g = ordinal.gradient_for(3)(w, [batch])
    for i in (0, 1, 2, 3, k, k + 1, k + 2, len(w) - 2, len(w) - 1):
        d = np.zeros_like(w)
        d[i] = 1e-6
        assert np.isclose(g[i], (loss(w + d) - loss(w - d)) / 2e-6, atol=1e-4)


def test_ratings(spark):
    docs = odd(spark)
    model = ordinal.train(docs, spark.createDataFrame([], "doc_id long, grade int"), 3)
    rows = ordinal.rate(docs, model).collect()
    assert len(rows) == len(ODD) + 1 and all(r.tails[0] >= r.tails[1] and np.isclose(r.expected_grade, sum(r.tails)) for r in rows)
    assert ordinal.rate(empty(spark), model).count() == 0
    got = QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    shares = {r.quality: r.s for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert shares[1] > 0.97 and shares[0] < 0.5


def plain_features(word):
    """Hashes of a word and of its beginnings."""
    mask = (1 << hashing.BITS) - 1
    return [zlib.crc32(b"w" + word) & mask] + [zlib.crc32(b"p" + word[:n]) & mask for n in (4, 5, 6) if len(word) >= n]


def plain_sentences(text):
    """Words of each sentence, other signs being blanks."""
    out = [""]
    for c in text:
        if c in ".!?\n\r":
            out.append("")
        else:
            out[-1] += c.lower() if c < "\x80" and c.isalnum() else c if c >= "\x80" else " "
    return [{w.encode() for w in s.split(" ") if w} for s in out if s.strip(" ")]


def test_toxicity_query_by_force(spark):
    """All scores of the query from the learned weights, sentence by sentence."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    weights, bias = toxicity.train(docs, labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = QUERIES["op5_toxicity"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        clean = 1.0
        for words in plain_sentences(texts[r.doc_id]):
            z = bias + sum(weights.get(f, 0.0) for w in words for f in plain_features(w))
            clean *= 1 / (1 + np.exp(z))
        assert np.isclose(r.score, 1 - clean, rtol=1e-6, atol=1e-9) and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_query_by_force(spark):
    """All chances and expected grades of the query from the learned weights and thresholds."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    rated = labels.select("doc_id", grade.alias("grade")).where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    weights, forms, cuts = ordinal.train(docs, rated, 3)
    assert (np.diff(cuts) > 0).all()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = QUERIES["op10_quality_classifier"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        words = [w for s in plain_sentences(t.decode()) for w in s]
        distinct = set(words)
        every, _ = ordinal.split(t)
        value = sum(weights.get(f, 0.0) for w in distinct for f in plain_features(w)) / max(len(distinct), 1) ** 0.5 + sum(forms[i] for i in ordinal.shape(t, every, len(distinct)))
        tails = [1 / (1 + np.exp(c - value)) for c in cuts]
        assert np.allclose([r.p_usable, r.p_best, r.expected_grade], [*tails, sum(tails)], rtol=1e-6, atol=1e-9) and r.kept == (r.p_usable >= 0.5)


def test_equal_items_fill_many_shards(spark):
    """40,000 equal rows, of a null key at that, are dealt out and none is lost."""
    items = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(100).alias("length"))
    out = packing.best_fit(items, shard_rows=4000)
    got = out.groupBy(F.shiftright("bin_id", 32).alias("shard")).agg(F.count("*").alias("n"), F.sum("length").alias("s")).collect()
    assert sum(r.n for r in got) == 40_000 and sum(r.s for r in got) == 4_000_000 and len(got) >= 8 and max(r.n for r in got) < 8000


def test_pieces_of_all_lengths():
    names = langid.pieces_of(P.path("piece_bpe_32k.model"))
    assert max(map(len, names)) >= 16 and all(n == n.lower() for n in names)
    pieces = langid.Pieces(names)
    long = max(names, key=len)
    found = pieces.found([long])
    assert len(found) == len(long) and names[found[-1][0, 0]] == long
