"""Secret scans: base patterns, and two character Markov models compared by log-likelihood ratio; DataFrame functions only.

One model is of random strings, the other of ordinary identifiers; both are tables of character transitions, counted by Spark from
labelled samples. A run of key characters is a secret if the random model explains it so much better per character.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Fixed values of the contract: kinds in their order, with their patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
# A shorter hex run fails in any case, so it needn't be matched; the runs that remain are the same.
LONG_HEX = r"[0-9a-f]{32,}"
# Runs that the models judge: as long as possible, of key characters.
RUN = r"[A-Za-z0-9+/_=-]{16,}"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(SYMBOLS) + 1  # 0 is the start
SAMPLE_DOCS, SMOOTHING, LEAST_PER_CHAR = 5_000, 0.5, 0.6
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"
REDACTED = "[SECRET]"


def matches(hits: str, text: Column, pattern: str, kind: str) -> Column:
    """Spans of the matches in column ``hits``: what lies between them gives their places."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    order = KINDS.index(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("value"))
        return F.struct(end.alias("pos"), F.array_append(acc["out"], span).cast(SPAN).alias("out"))

    pairs = F.zip_with(F.col(hits), gaps, lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast(SPAN))


def with_base(docs: DataFrame, text: str = "t") -> DataFrame:
    """Adds ``base``: the spans of the base patterns, in order."""
    t = F.col(text)
    d = docs.withColumns({"_assign": F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(0)), "_access": F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)), "_hex": F.regexp_extract_all(t, F.lit(LONG_HEX), F.lit(0))})
    d = d.withColumns({
        "_assign": F.filter(matches("_assign", t, ASSIGN, "assign"), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= 8),
        "_access": F.filter(matches("_access", t, ACCESS, "access"), lambda x: F.length(x["value"]) >= 16),
        "_hex": matches("_hex", t, LONG_HEX, "hex")})
    return d.withColumn("base", F.sort_array(F.concat("_assign", "_access", "_hex"))).drop("_assign", "_access", "_hex")


def states(value: Column) -> Column:
    """The symbols' numbers, from 1; other characters have 0."""
    return F.transform(F.split(value, ""), lambda c: F.expr("0") + F.instr(F.lit(SYMBOLS), c))


def labelled_strings(docs: DataFrame, key: str, text: str, bound: int) -> DataFrame:
    """(value, random): labelled samples of at most ``bound`` documents, those of the lowest hash.

    Random are what the base patterns found there and, so that every input has some, digests of the documents' keys in hexadecimal,
    base 64 and upper case; ordinary are the words of documents without a find, and plain numbers.
    """
    few = docs.select(F.col(key).alias("k")).where("k is not null").distinct().orderBy(F.xxhash64("k", F.lit(11)), "k").limit(bound)
    d = with_base(docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(few), "k"))
    values = F.transform("base", lambda x: F.when(x["kind"] == "assign", F.regexp_extract(x["value"], ASSIGN, 2)).otherwise(x["value"]))
    digest = F.sha2(F.col("k").cast("string"), 256)
    made = F.array(F.substring(digest, 1, 40), F.substring(F.base64(F.unhex(digest)), 1, 40), F.translate(F.upper(F.substring(F.base64(F.unhex(digest)), 5, 24)), "+/=", "QXZ"))
    found = d.select(F.explode(F.concat(values, made)).alias("value"), F.lit(1).alias("random"))
    words = F.regexp_extract_all("t", F.lit(r"[A-Za-z_][A-Za-z0-9_-]{5,}"), F.lit(0))
    numbers = F.array(*[F.substring(F.abs(F.xxhash64("k", F.lit(i))).cast("string"), 1, 16) for i in range(4)])
    ordinary = d.where(F.size("base") == 0).select(F.explode(F.concat(words, numbers)).alias("value"), F.lit(0).alias("random"))
    return found.unionByName(ordinary)


def train(strings: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, a table of STATES x STATES: counts by Spark, smoothed. Without samples all are 0."""
    one = F.aggregate(states(F.col("value")), F.struct(F.lit(0).alias("prev"), F.array().cast("array<int>").alias("out")),
                      lambda acc, x: F.struct(x.cast("int").alias("prev"), F.array_append(acc["out"], acc["prev"] * STATES + x).cast("array<int>").alias("out")), lambda acc: acc["out"])
    counts = (strings.where(F.length("value") <= 512).groupBy("value", "random").agg(F.count("*").alias("n")).select("random", "n", F.explode(one).alias("pair"))
              .groupBy("random", "pair").agg(F.sum("n").alias("n")).collect())  # STATES * STATES pairs for each label at most
    n = {(r.random, r.pair): r.n for r in counts}
    out = []
    for a in range(STATES):
        row = {x: sum(n.get((x, a * STATES + b), 0) for b in range(STATES)) for x in (0, 1)}
        out += [math.log((n.get((1, a * STATES + b), 0) + SMOOTHING) / (row[1] + SMOOTHING * STATES)) - math.log((n.get((0, a * STATES + b), 0) + SMOOTHING) / (row[0] + SMOOTHING * STATES))
                for b in range(STATES)]
    return out


def ratio(value: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string: random against ordinary. The table is one constant of the plan."""
    t = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")
    start = F.struct(F.lit(0).alias("prev"), F.lit(0.0).alias("sum"))
    return F.aggregate(states(value), start, lambda acc, x: F.struct(x.cast("int").alias("prev"), (acc["sum"] + F.get(t, acc["prev"] * STATES + x)).alias("sum")), lambda acc: acc["sum"])


def with_spans(docs: DataFrame, table: list[float], text: str = "t") -> DataFrame:
    """Adds ``base`` and ``spans``: the base spans and the runs that look random and overlap none of them."""
    d = with_base(docs, text).withColumn("_run", F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0)))
    d = d.withColumn("_run", F.when(F.exists("_run", lambda v: ratio(v, table) >= LEAST_PER_CHAR * F.length(v)), F.col("_run")).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("_run", matches("_run", F.col(text), RUN, "random"))
    added = F.filter("_run", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])) & (ratio(x["value"], table) >= LEAST_PER_CHAR * F.length(x["value"])))
    return d.withColumn("spans", F.sort_array(F.concat("base", added))).drop("_run")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, table: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans): spans of the whole text as (start, ord, end, kind, value), code points, by start and kind.

    A null text is empty. Repeated rows stay; other columns are left out, whatever their names.
    """
    d = with_spans(docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")), table)
    return d.select(F.col("k").alias(key), "base", "spans")


def redact(docs: DataFrame, table: list[float], text: str = "text") -> DataFrame:
    """The same rows and columns with every span replaced by a mark; null texts stay null, repeated rows stay, overlapping spans get one mark
    each where they begin, an empty table gives no rows."""
    d = with_spans(docs.select(F.struct(*docs.columns).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t")), table)

    def step(acc: Column, x: Column) -> Column:
        between = F.substring("t", acc["pos"] + 1, F.greatest(F.lit(0), x["start"] - acc["pos"]))
        mark = F.when(x["start"] >= acc["pos"], F.lit(REDACTED)).otherwise("")
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.concat(acc["out"], between, mark).alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("t"), acc["pos"] + 1, F.length("t"))))
    new = F.when(F.col(f"r.`{text}`").isNull() | (F.size("spans") == 0), F.col(f"r.`{text}`")).otherwise(clean)
    return d.select(*[new.alias(c) if c == text else F.col(f"r.`{c}`").alias(c) for c in docs.columns])


def model_of(docs: DataFrame, key: str = "doc_id", text: str = "text", bound: int = SAMPLE_DOCS) -> list[float]:
    return train(labelled_strings(docs, key, text, bound))
