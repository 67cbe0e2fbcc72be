"""Exact Jaccard self-join of texts' word shingles with a token-group matrix.

Equal sets are folded into classes first. Classes are partitioned into small groups of similar sets by minimum hashes. A matrix of
tokens and groups keeps each group's token union; a set can only be similar to a member of a group if it shares enough tokens with the
union, so only groups that pass this bound are opened and their members compared exactly.

Which groups are bounded at all is found through prefixes: in one common order of all tokens, frequent ones last, two similar sets
share a token among the first few of each. Groups are linked inside before they meet others, and groups of one component don't meet, so
many near copies of one text give few rows. Groups that met are bounded by the tokens that both unions have, first those of the
prefixes, then all; a pair that passes is opened, and all members of both are compared by one product of their matrices. Nothing
is capped: every pair of classes is either in a component already, ruled out by a bound, or compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.llm.shared import bitmap, bytes_of, components, in_bitmap, stage

WORDS, SIMILAR = 4, 85  # words of a shingle, percent of the union that must be common
GROUP_SETS = 32  # sets of a group; a larger one is dealt out by hash
HOT_DOCS = 24  # a token of more prefixes than this comes last in the order
HOT_BITS, SHARED_BITS, WANTED_BITS = 24, 26, 24  # sizes of the bitmaps (2, 8 and 2 MB), whatever the input
CACHE_WORDS = 200_000  # of a worker; about 35 MB

_A, _B, _C, _D, _M, _N = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        v = xxhash.xxh64_intdigest(word) - (1 << 63)  # signed: numpy takes those faster
        if len(word) <= 64:
            self[word] = v
        return v


def shingle_set(text: bytes, words: WordHashes, size: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; fewer words than ``size`` are one shingle, no word is none."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed=len(parts))], np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.int64, len(parts)).view(np.uint64)
    n, out = len(h) - size + 1, np.zeros(len(h) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out ^= out >> _SHIFT
            out *= _A
            out += h[k:k + n]
        out ^= out >> _SHIFT
        out *= _M
    out ^= out >> _SHIFT
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


_SHIFT = np.uint64(31)
LOW = np.uint64(int(0.25 * 2**64))  # a quarter of all tokens is compared before matrices are sent


def class_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def prefix_length(n: int, similar: int = SIMILAR) -> int:
    """So many first tokens of a set of ``n`` that any similar set has one of them among its own."""
    return n + (-similar * n) // 100 + 1


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketches(docs: DataFrame, similar: int) -> DataFrame:
    """(doc_id, n, cls, m1, m2, prefix) of each text: its set's size and digest, two minimum hashes, and its lowest tokens."""
    def run(batches: Iterator[pa.RecordBatch]):
        words = WordHashes()
        for b in batches:
            sets = [shingle_set(t, words) for t in bytes_of(b.column(1))]
            with np.errstate(over="ignore"):
                second = [int(_long((t * _D ^ (t >> _SHIFT) * _C)).min()) if len(t) else 0 for t in sets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0), "n": pa.array([len(t) for t in sets], pa.int64()), "cls": pa.array([class_of(t) for t in sets], pa.binary()),
                "m1": pa.array([int(_long(t)[0]) if len(t) else 0 for t in sets], pa.int64()), "m2": pa.array(second, pa.int64()),
                "prefix": pa.array([_long(t[:prefix_length(len(t), similar)]) if len(t) else [] for t in sets], pa.list_(pa.int64()))})

    return docs.mapInArrow(run, "doc_id long, n long, cls binary, m1 long, m2 long, prefix array<long>")


def prefixes(docs: DataFrame, ids: DataFrame, hot: np.ndarray, similar: int) -> DataFrame:
    """(doc_id, cls, prefix) of ``ids``: the first tokens in the common order, tokens marked as hot last; only of texts where that changes them."""
    share = docs.sparkSession.sparkContext.broadcast(hot)

    def make(batches: Iterator[pa.RecordBatch]):
        words = WordHashes()
        for b in batches:
            sets = [shingle_set(t, words) for t in bytes_of(b.column(1))]
            at, out, cls = [], [], []
            for i, t in enumerate(sets):
                k = prefix_length(len(t), similar)
                if len(t) and in_bitmap(share.value, t[:k], HOT_BITS).any():
                    late = in_bitmap(share.value, t, HOT_BITS)
                    at.append(i)
                    out.append(_long(np.concatenate([t[~late], t[late]])[:k]))
                    cls.append(class_of(t))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).take(pa.array(at, pa.int64())), "cls": pa.array(cls, pa.binary()), "prefix": pa.array(out, pa.list_(pa.int64()))})

    return of_some(docs, ids, make, "doc_id long, cls binary, prefix array<long>")


def cold_prefixes(s: DataFrame, hot: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Of the sketches: those whose lowest tokens have no hot one among them, which are their prefix already, and the ids of the others."""
    share = s.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            late = in_bitmap(share.value, b.column("prefix").flatten().to_numpy(), HOT_BITS)
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column("prefix").offsets.to_numpy()))
            some = np.bincount(row[late], minlength=b.num_rows) > 0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "cls")), pa.array([None if x else p for x, p in zip(some, b.column("prefix"))], pa.list_(pa.int64()))], names=["doc_id", "cls", "prefix"])

    out = stage(s.select("doc_id", "cls", "prefix").mapInArrow(run, "doc_id long, cls binary, prefix array<long>"), "setjoin-cold")
    return out.where("prefix is not null"), out.where("prefix is null").select("doc_id")


def of_some(docs: DataFrame, ids: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``make`` over the batches of documents (doc_id, t) whose id is, by its bit in a bitmap, probably one of ``ids``; in one Python worker."""
    share = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("doc_id").alias("h")), "h", WANTED_BITS))

    def run(batches: Iterator[pa.RecordBatch]):
        few = (b.filter(pa.array(in_bitmap(share.value, b.column(2).to_numpy(zero_copy_only=False).astype(np.int64), WANTED_BITS))) for b in batches)
        yield from make(b for b in few if b.num_rows)

    return docs.withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, schema)


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rep, cls, ...) with the text ``t`` of each; texts are smaller than sets of hashes, which tasks make again.

    A bitmap of the wanted ids spares most other texts; the join decides.
    """
    def make(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            cls = pa.array([class_of(shingle_set(t, _words)) for t in bytes_of(b.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), cls, b.column(1)], names=["rep", "cls", "t"])

    found = of_some(docs, wanted.select(F.col("rep").alias("doc_id")), make, "rep long, cls binary, t binary")
    return found.groupBy("rep", "cls").agg(F.first("t").alias("t")).join(wanted, ["rep", "cls"])


_words = WordHashes()  # of a worker, for functions that see few texts at a time


def _tokens(text: bytes) -> np.ndarray:
    return shingle_set(bytes(text), _words)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _similar(a: np.ndarray, b: np.ndarray, similar: int) -> bool:
    if 100 * min(len(a), len(b)) < similar * max(len(a), len(b)):
        return False
    common = _common(a, b)
    return 100 * common >= similar * (len(a) + len(b) - common)


def groups_of(classes: DataFrame) -> DataFrame:
    """(rep, cls, n, kind, k, salt, gid): the group of each class. Classes that agree on both minimum hashes are of one kind; of those that
    don't share both with any, many with the same first hash, then many with the same second; the others are of a kind of their own.

    Kinds of more than GROUP_SETS classes are dealt out by hash. Few groups for many near copies keep the matrix of tokens and groups small.
    """
    left, out = classes.select("rep", "cls", "n", "m1", "m2"), None
    for i, key in enumerate((["m1", "m2"], ["m1"], ["m2"])):
        many = left.groupBy(*key).agg(F.count("*").alias("k"))
        counted = stage(left.join(many, key), "setjoin-kinds")
        least = GROUP_SETS if i else 1  # sets that share one hash only are less alike: it takes many of them to be worth a looser union
        found = counted.where(F.col("k") > least).select("rep", "cls", "n", F.xxhash64(F.lit(i), *key).alias("kind"), "k")
        out = found if out is None else out.unionByName(found)
        left = counted.where(F.col("k") <= least).drop("k")
    out = out.unionByName(left.select("rep", "cls", "n", F.xxhash64(F.lit(3), "rep").alias("kind"), F.lit(1).cast("long").alias("k")))
    salt = F.pmod(F.xxhash64("cls"), F.ceil(F.col("k") / GROUP_SETS)).cast("int")
    return out.withColumn("salt", salt).withColumn("gid", F.xxhash64("kind", "salt"))


def inside_links(sets: DataFrame, similar: int) -> DataFrame:
    """(a, b): links that connect what is connected inside each group; members in one component already aren't compared again."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids, sets, root, out = g["rep"].tolist(), [_tokens(x) for x in g["t"]], list(range(len(g))), []

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(ids)):
            for j in range(i):
                if top(i) != top(j) and _similar(sets[i], sets[j], similar):
                    root[max(top(i), top(j))] = min(top(i), top(j))
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return sets.groupBy("gid").applyInPandas(run, "a long, b long")


def similar_pairs(pairs: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose texts s and t are similar."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield b.select(["a", "b"]).filter(pa.array([_similar(_tokens(s), _tokens(t), similar) for s, t in zip(b.column("s").to_pylist(), b.column("t").to_pylist())], pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def leader_links(sets: DataFrame, similar: int) -> DataFrame:
    """Links between the first members of the parts of one dealt-out group and that of its part 0."""
    first = sets.groupBy("kind", "salt").agg(F.min_by(F.struct("rep", "t"), "rep").alias("x"))
    base = first.where("salt = 0").select("kind", F.col("x").alias("y"))
    pairs = first.where("salt > 0").join(base, "kind").select(F.col("x.rep").alias("a"), F.col("x.t").alias("s"), F.col("y.rep").alias("b"), F.col("y.t").alias("t"))

    return similar_pairs(pairs, similar)


def matrices(sets: DataFrame) -> DataFrame:
    """The matrix of each group: (gid, tokens of the union, members, their components, one row of bits for each member)."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        each = [_tokens(x) for x in g["t"]]
        union = np.unique(np.concatenate(each))
        bits = np.zeros((len(each), len(union)), bool)
        for k, s in enumerate(each):
            bits[k, np.searchsorted(union, s)] = True
        return pd.DataFrame({"gid": g["gid"].iloc[:1], "tokens": [union.tobytes()], "members": [g["rep"].tolist()], "comps": [g["comp"].tolist()], "bits": [np.packbits(bits, axis=1).tobytes()]})

    return sets.groupBy("gid").applyInPandas(run, "gid long, tokens binary, members array<long>, comps array<long>, bits binary")


def opened(pairs: DataFrame, similar: int) -> DataFrame:
    """(a, b): links between members of two groups with their matrices; a pair opens only if the unions have enough tokens in common.

    All members of both are compared by one product of the matrices' common columns. One link between two components is enough.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own, union = np.frombuffer(r["own_tokens"], np.uint64), np.frombuffer(r["tokens"], np.uint64)
                at = np.minimum(np.searchsorted(union, own), len(union) - 1)
                hit = np.flatnonzero(union[at] == own)
                p, q = (_rows(r[f"{side}bits"], len(r[f"{side}members"]), len(t)) for side, t in (("own_", own), ("", union)))
                p_size, q_size = p.sum(axis=1, dtype=np.int64), q.sum(axis=1, dtype=np.int64)
                if (100 + similar) * len(hit) < similar * (p_size.min() + q_size.min()):
                    continue  # the bound: no two members can be similar
                common = _products(p[:, hit], q[:, at[hit]])
                linked = set()
                for i, j in np.argwhere((100 + similar) * common >= similar * (p_size[:, None] + q_size[None])).tolist():
                    ends = r["own_comps"][i], r["comps"][j]
                    if ends[0] != ends[1] and ends not in linked:
                        linked.add(ends)
                        out.append((r["own_members"][i], r["members"][j]))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return pairs.mapInArrow(run, "a long, b long")


def opened_links(docs: DataFrame, pairs: DataFrame, info: DataFrame, similar: int) -> DataFrame:
    """(a, b): links between the members of the groups ``gid`` and ``other``. Only the texts of these groups are read again, each once, and
    of a pair the smaller matrix goes to the larger one."""
    groups = pairs.select("gid").unionByName(pairs.select(F.col("other").alias("gid"))).distinct()
    sets = texts_of(docs, info.join(groups, "gid", "left_semi").select("rep", "cls", "gid", "comp")).select("gid", "rep", "comp", "t")
    matrix = stage(matrices(sets), "setjoin-matrices")
    sized = plausible(pairs, matrix, similar)
    small, large = (F.when(F.col("own_size") <= F.col("size"), F.col(x)).otherwise(F.col(y)) for x, y in (("gid", "other"), ("other", "gid")))
    return opened(both_sides(sized.select(small.alias("gid"), large.alias("other")), matrix).drop("gid", "other"), similar)


def plausible(pairs: DataFrame, matrix: DataFrame, similar: int) -> DataFrame:
    """(gid, other, own_size, size): the pairs with two members of different components that have enough tokens in common among those with
    the lowest hashes, a fixed share of all.

    Two members have no more in common than they have there and the one with fewer tokens elsewhere has there, so no similar pair is lost;
    the matrices of the others needn't be sent.
    """
    def light(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = {"low": [], "bits": [], "sizes": [], "rest": [], "size": []}
            for tokens, bits, members in zip(b.column("tokens").to_pylist(), b.column("bits").to_pylist(), b.column("members").to_pylist()):
                t = np.frombuffer(tokens, np.uint64)
                rows = _rows(bits, len(members), len(t))
                k = int(np.searchsorted(t, LOW))
                out["low"].append(tokens[:8 * k])
                out["bits"].append(np.packbits(rows[:, :k], axis=1).tobytes())
                out["sizes"].append(rows.sum(axis=1, dtype=np.int64))
                out["rest"].append(rows[:, k:].sum(axis=1, dtype=np.int64))
                out["size"].append(len(tokens) + len(bits))
            kinds = {"low": pa.binary(), "bits": pa.binary(), "sizes": pa.list_(pa.int64()), "rest": pa.list_(pa.int64()), "size": pa.int64()}
            yield pa.RecordBatch.from_pydict({"gid": b.column("gid"), "comps": b.column("comps"), **{c: pa.array(out[c], kind) for c, kind in kinds.items()}})

    def could(r: dict) -> bool:
        low, own = np.frombuffer(r["low"], np.uint64), np.frombuffer(r["own_low"], np.uint64)
        _, at, own_at = np.intersect1d(low, own, assume_unique=True, return_indices=True)
        p, q = _rows(r["own_bits"], len(r["own_comps"]), len(own))[:, own_at], _rows(r["bits"], len(r["comps"]), len(low))[:, at]
        sizes, rest = np.add.outer(r["own_sizes"], r["sizes"]), np.minimum.outer(r["own_rest"], r["rest"])
        apart = np.not_equal.outer(r["own_comps"], r["comps"])
        return bool((apart & ((100 + similar) * (_products(p, q) + rest) >= similar * sizes)).any())

    def bound(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield b.select(["gid", "other", "own_size", "size"]).filter(pa.array([could(r) for r in b.to_pylist()], pa.bool_()))

    kinds = "gid long, comps array<long>, low binary, bits binary, sizes array<long>, rest array<long>, size long"
    lights = stage(matrix.select("gid", "tokens", "bits", "members", "comps").mapInArrow(light, kinds), "setjoin-lights")
    return stage(both_sides(pairs, lights).mapInArrow(bound, "gid long, other long, own_size long, size long"), "setjoin-plausible")


def _rows(bits: bytes, members: int, tokens: int) -> np.ndarray:
    """The rows of zeros and ones of a matrix."""
    return np.unpackbits(np.frombuffer(bits, np.uint8).reshape(members, -1), axis=1, count=tokens)


def _products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many ones each row of ``p`` has in common with each of ``q``."""
    return np.rint(p.astype(np.float32) @ q.astype(np.float32).T).astype(np.int64)


def similar_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: texts link if ``similar`` percent of the union of their sets are common.

    ``key`` is a whole number. Texts without words (null, empty, blanks) link with nothing; a row without a key isn't linked and has no
    component. Rows with equal keys count as one document: what links to one of them is in the component of all. Repeated rows stay,
    other columns are left out. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    known = rows.where("doc_id is not null")
    s = stage(sketches(rows, similar), "setjoin-sketches")
    real = s.where("n > 0 and doc_id is not null")
    c = stage(real.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("m1").alias("m1"), F.min("m2").alias("m2")), "setjoin-classes")
    grouped = stage(groups_of(c), "setjoin-groups")
    inside = stage(texts_of(known, grouped.where("k > 1").select("rep", "cls", "gid", "kind", "salt", "k")), "setjoin-inside")
    near = stage(inside_links(inside.select("gid", "rep", "t"), similar).unionByName(leader_links(inside.where(f"k > {GROUP_SETS}"), similar)), "setjoin-near")
    linked = components(near, "setjoin-first")
    info = grouped.join(linked.select(F.col("node").alias("rep"), F.col("component")), "rep", "left").select("rep", "cls", "n", "gid", F.coalesce("component", "rep").alias("comp"))
    info = stage(info, "setjoin-info")
    # the matrix of prefix tokens and groups, without tokens of a single component
    hot = bitmap(real.select(F.explode("prefix").alias("token")).groupBy("token").count().where(F.col("count") > HOT_DOCS), "token", HOT_BITS)
    cold, warm = cold_prefixes(real, hot)
    first = cold.unionByName(prefixes(known, warm, hot, similar)).dropDuplicates(["doc_id", "cls"])
    first = stage(first.join(info.withColumnRenamed("rep", "doc_id"), ["doc_id", "cls"]).drop("cls"), "setjoin-prefixes")
    tokens = first.select("comp", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    x = stage(explode_shared(first, bitmap(tokens, "token", SHARED_BITS)), "setjoin-shared")
    g = stage(x.groupBy("token", "gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"),
                                           F.max((100 * F.col("n") - (100 + similar) * F.col("pos"))).alias("room")), "setjoin-unions")
    pairs = stage(group_pairs(g, similar), "setjoin-pairs")
    all_links = stage(opened_links(known, pairs, info, similar).unionByName(near), "setjoin-links")
    whole = stage(components(all_links, "setjoin-second").select(F.col("node").alias("rep"), F.col("component").alias("component_id")), "setjoin-components")
    of_class = c.select("cls", "rep").join(whole, "rep", "left").select("cls", F.coalesce("component_id", "rep").alias("component_id"))
    return (s.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("cls")).alias("cls")).join(stage(of_class, "setjoin-result"), "cls", "left")
            .select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def group_pairs(unions: DataFrame, similar: int) -> DataFrame:
    """(gid, other): pairs of groups that may have similar members of different components.

    ``unions`` has a row for each token of a group's prefixes. Two similar sets have similar / (100 + similar) of their sizes' sum in common, so
    they already share one of the tokens before which each has no more than it may have for itself: its place is at most its size
    less that. ``room`` is the largest size times 100 less place times 100 + similar of a group's members with the token. Groups meet by
    such tokens only, which spares the frequent ones at the prefixes' ends; those that met stay if the tokens that both unions have
    reach the bound.
    """
    columns = ["lo", "hi", "n_lo", "n_hi", "room"]
    own, its = unions.alias("own"), unions.alias("its")
    apart = F.expr("its.lo <> own.lo or its.hi <> own.hi or its.lo <> its.hi")
    could = F.expr(f"own.gid < its.gid and 100 * its.n_hi >= {similar} * own.n_lo and {similar} * its.n_lo <= 100 * own.n_hi") & apart
    early = F.expr(f"own.room >= {similar} * its.n_lo and its.room >= {similar} * own.n_lo")
    met = own.join(its, F.expr("own.token = its.token")).where(could & early).select(F.col("own.gid").alias("gid"), F.col("its.gid").alias("other")).distinct()
    of = stage(unions.groupBy("gid").agg(F.collect_set("token").alias("tokens"), *[f(c).alias(c) for f, c in zip((F.min, F.max), columns[2:4])]), "setjoin-group-unions")
    both = both_sides(met, of)
    return both.withColumn("shared", F.size(F.array_intersect("own_tokens", "tokens"))).where(within_bound(similar)).select("gid", "other")


def both_sides(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs (gid, other) with the columns of ``of`` for ``other`` and, named own_..., for ``gid``.

    Columns get their names after the joins, so that both read the same shuffle of ``of``, which is written once.
    """
    columns = [c for c in of.columns if c != "gid"]
    joined = pairs.alias("pairs").join(of.alias("own"), F.expr("pairs.gid = own.gid")).join(of.alias("its"), F.expr("pairs.other = its.gid"))
    return joined.select("pairs.*", *[F.col(f"own.{c}").alias(f"own_{c}") for c in columns], *[F.col(f"its.{c}").alias(c) for c in columns])


def within_bound(similar: int) -> Column:
    """Whether members of two groups can be similar whose unions of prefixes have ``shared`` tokens in common.

    Of two sets' common tokens those up to the end of the prefix that ends first are in both prefixes, the others are among what that set
    has behind it, less than ``similar`` percent of its size. So the common tokens are fewer than shared + similar% of the larger size,
    and they have to be similar / (100 + similar) of both sizes' sum. This is loosest for the largest size on one side and the
    smallest on the other that can be similar to it at all.
    """
    def loosest(most: str, least: str) -> Column:
        larger, smaller = F.least(F.col(most), 100 * F.col(least) / similar), F.col(least)
        return (larger >= smaller) & ((F.col("shared") * 100 + similar * larger) * (100 + similar) >= 100 * similar * (larger + smaller))

    return loosest("own_n_hi", "n_lo") | loosest("n_hi", "own_n_lo")


def explode_shared(first: DataFrame, shared: np.ndarray) -> DataFrame:
    """(token, doc_id, gid, comp, n, pos) of the prefix tokens whose bit is set; ``pos`` is the token's place in the prefix."""
    share = first.sparkSession.sparkContext.broadcast(shared)
    cols = ["doc_id", "gid", "comp", "n"]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            token, sizes = b.column("prefix").flatten(), np.diff(b.column("prefix").offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), sizes)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = in_bitmap(share.value, token.to_numpy(), SHARED_BITS)
            at = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([token.filter(pa.array(keep))] + [b.column(c).take(at) for c in cols] + [pa.array(pos[keep])], names=["token", *cols, "pos"])

    return first.select("prefix", *cols).mapInArrow(run, "token long, doc_id long, gid long, comp long, n long, pos long")
