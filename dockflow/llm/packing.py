"""Best-fit packing into bins of several permitted lengths.

Items are dealt to shards by a hash of their row, whatever their source, and each shard is packed on its own: best fit, longest first.
An item that fits no open bin opens one of the size with the least cost per place that holds it; at the end each bin is cut down to
the smallest permitted length that holds its contents. Shards have about ``shard_rows`` rows at every input size, so the waste of a
shard's last bins stays in proportion and no task grows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTHS = (512, 1024, 2048, 4096, 8192)
SHARD_ROWS, COPIES = 4096, 256  # rows of a shard on average; equal rows that go to a shard together at most


def cost_of(length: int, fixed: float = 256.0, quadratic: float = 65536.0) -> float:
    """Cost of a sequence: its places, a fixed share per sequence and attention that grows with the square."""
    return length + fixed + length * length / quadratic


def pack(lengths: np.ndarray, sizes: Sequence[int], costs: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: (bin, offset) of each item, (size, fill) of each bin. No item is longer than the largest size.

    Of equally tight bins that takes the item which changed last; items of equal length keep their order.
    """
    sizes, costs = np.asarray(sizes), np.asarray(costs, float)
    order = np.argsort(-lengths, kind="stable")
    per_place = costs / sizes
    # for each item length the size to open: the least cost per place among those that hold it, the smaller at a tie
    opens = {}
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    room: list[list[int]] = [[] for _ in range(int(sizes[-1]) + 1)]  # open bins by what is left in them
    mask = 0  # bit r is set if a bin has r places left
    for i in order.tolist():
        n = int(lengths[i])
        at = mask >> n
        if at:
            left = n + (at & -at).bit_length() - 1  # the tightest bin
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            if n not in opens:
                fits = np.flatnonzero(sizes >= n)
                opens[n] = int(sizes[fits[np.argmin(per_place[fits])]])
            left, b = opens[n], len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        if left > n:
            room[left - n].append(b)
            mask |= 1 << (left - n)
    filled = np.array(fill, np.int64)
    # the cheapest size that still holds the contents
    best = [min((c, s) for s, c in zip(sizes.tolist(), costs.tolist()) if s >= f)[1] for f in fill]
    return where, offset, np.array(best, np.int64), filled


def best_fit(items: DataFrame, key: str = "doc_id", length: str = "length", lengths: Sequence[int] = LENGTHS, costs: Sequence[float] | None = None,
             shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pack items: one row per piece with (key, piece, start, length, bin_id, bin_offset, bin_size, bin_fill).

    Items longer than the largest size are cut: whole bins of that size and a remainder, as pieces 0, 1, ...; nothing is dropped. Null
    and negative lengths count as 0; an item of no length is one piece of no length in some bin. Items with equal keys, and null keys,
    are items of their own. Other columns are left out. An empty table gives no rows.
    """
    sizes = sorted(set(lengths))
    if not sizes or sizes[0] < 1:
        raise ValueError("permitted lengths are positive")
    price = [float(c) for c in costs] if costs else [cost_of(s) for s in sizes]
    if len(price) != len(sizes):
        raise ValueError("one cost for each permitted length, in ascending order")
    top = sizes[-1]
    rows = items.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    pieces = rows.select("k", "n", F.explode(F.expr(f"sequence(0, greatest(0, cast(ceil(n / {top}) as int) - 1))")).alias("piece"))
    pieces = pieces.select("k", "piece", (F.col("piece").cast("long") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece").cast("long") * top).alias("n"))
    shards = max(1, -(-rows.count() // shard_rows))
    kind = items.schema[key].dataType.simpleString()
    # equal rows are counted first and dealt out COPIES at a time, so a row that a third of the table repeats fills many shards
    equal = pieces.groupBy("k", "piece", "start", "n").agg(F.count("*").alias("c"))
    dealt = equal.withColumn("part", F.explode(F.expr(f"sequence(0L, (c - 1) div {COPIES})")))
    dealt = dealt.select("k", "piece", "start", "n", F.least(F.lit(COPIES), F.col("c") - F.col("part") * COPIES).alias("copies"), F.pmod(F.xxhash64("k", "piece", "n", "part"), F.lit(shards)).cast("int").alias("shard"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.loc[g.index.repeat(g["copies"])].sort_values(["n", "k", "piece"], ascending=[False, True, True], kind="stable")
        b, off, size, fill = pack(g["n"].to_numpy(np.int64), sizes, price)
        return pd.DataFrame({key: g["k"], "piece": g["piece"], "start": g["start"], "length": g["n"], "bin_id": (g["shard"].to_numpy(np.int64) << 32) + b,
                             "bin_offset": off, "bin_size": size[b], "bin_fill": fill[b]})

    return dealt.groupBy("shard").applyInPandas(run, f"`{key}` {kind}, piece int, start long, length long, bin_id long, bin_offset long, bin_size long, bin_fill long")


def word_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, length): words of the whole text plus one end mark, so every document has a length."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col(key), (words + 1).cast("long").alias("length"))
