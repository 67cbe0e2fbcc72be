"""One query for each operator, over its whole table, with check SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.llm import bytebpe, capdedup, langid, licences, linecrf, ordinal, packing, secrets, setjoin, spelling, toxicity, warc, whitening
from dockflow.llm.shared import stage_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def fold(parts: int) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))


@query
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's words and an end mark, packed into the permitted lengths."""
    return packing.best_fit(packing.word_lengths(table(spark, folder, "documents")))


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from all folds but the held-out one."""
    return langid.train(docs, docs.where(fold(4) != 2).select("doc_id", "lang"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_cap_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return capdedup.near_vectors(table(spark, folder, "embeddings"))


CHECKS["op2_cap_near_dedup"] = """
    with recursive v as (select vec_id, label, embedding::double[] e from embeddings),
    links as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.93e0),
    reach as (select vec_id node, vec_id seen from v union select node, b from reach join links on seen = a)
    select vec_id, n_links, component_id, vec_id = component_id kept from
      (select node vec_id, min(seen) component_id from reach group by 1) join (select vec_id, count(b) n_links from v left join links on vec_id = a group by 1) using (vec_id)"""


@query
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.predict(docs, language_model(docs)).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op4_line_field_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return linecrf.rules(docs, linecrf.train(docs, table(spark, folder, "labels")))


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels.where(fold(5) != 0))
    return toxicity.score(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "worst")


@query
def op6_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    """Archives are written to the shared folder and read back; what the result says comes from the archives."""
    planned = warc.plan(table(spark, folder, "pages"))
    rows = warc.read(warc.write(planned, stage_path(spark, "warc")), payload=False).where("gap is null")
    return rows.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), warc.page_of("refers_to").alias("refers_to"))


@query
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secrets.scan(docs, secrets.model_of(docs))
    kinds = F.transform("base", lambda x: x["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *count, F.sha2(secrets.joined("base").cast("binary"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


@query
def op8_token_group_join(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.similar_classes(table(spark, folder, "documents"))


CHECKS["op8_token_group_join"] = """
    with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
    s as (select distinct doc_id, unnest(case when len(w) = 0 then cast([] as varchar[]) when len(w) < 4 then [array_to_string(w, ' ')]
                                         else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]) end) s from w),
    n as (select doc_id, count(*) n from s group by 1),
    p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
    links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
    reach as (select doc_id node, doc_id seen from documents union select node, b from reach join links on seen = a)
    select doc_id, coalesce(n, 0) n_shingles, component_id from (select node doc_id, min(seen) component_id from reach group by 1) left join n using (doc_id)"""


@query
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary of the contract's rank file, in the library's own format."""
    return bytebpe.round_trip_digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Grades: 0 for low quality, 1 for toxic, 2 for neither; a document is kept if grade 1 or better is likelier than not."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    ratings = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))
    model = ordinal.train(docs, ratings.where(fold(5) != 0), 3)
    rated = ordinal.rate(docs, model)
    return rated.select("doc_id", (fold(5) == 0).alias("held_out"), "expected_grade", F.col("tails")[0].alias("p_usable"), F.col("tails")[1].alias("p_best"), (F.col("tails")[0] >= 0.5).alias("kept"))


@query
def op11_spectrum_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def _templates() -> str:
    every = (*licences.PHRASES, *licences.TEMPLATES)
    return ", ".join(f"({i}, '{t}', '{label}', {str(i < len(licences.PHRASES)).lower()})" for i, (t, label) in enumerate(every))


CHECKS["op12_license_scan"] = f"""
    with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
    t(template, txt, label, base) as (values {_templates()}),
    tg as (select template, label, base, len(tw) size, len(tw) - 2 grams, unnest(range(1, len(tw) - 1)) p, tw from (select *, string_split(txt, ' ') tw from t)),
    hits as (select r, template, label, base, size, grams, tg.p - 1 tpos, x.p - tg.p diagonal from (select r, w, unnest(range(1, len(w) - 1)) p from d) x
             join tg on w[x.p] = tw[tg.p] and w[x.p + 1] = tw[tg.p + 1] and w[x.p + 2] = tw[tg.p + 2]),
    votes as (select r, template, diagonal, count(*) n, min(tpos) lo, max(tpos) hi, lag(diagonal) over (partition by r, template order by diagonal) prev from hits group by 1, 2, 3),
    parts as (select *, sum(case when diagonal - prev <= {licences.NEAR} then 0 else 1 end) over (partition by r, template order by diagonal) part from votes),
    spans as (select r, template, part, max(diagonal + hi) + 3 - min(diagonal + lo) length from parts group by 1, 2, 3),
    merged as (select r, template, part, label, base, size, grams, count(distinct tpos) n from hits join parts using (r, template, diagonal) group by all),
    copies as (select r, label, base, case when length <= {licences.LONGEST}e0 * size then n / grams::double else 0e0 end share from merged join spans using (r, template, part)),
    places as (select r, label, diagonal from parts join t using (template) join (select distinct template, grams from tg) using (template) where base and n = grams),
    of_base as (select r, count(*) n_base, min(diagonal) first_word, max(diagonal) last_word, string_agg(distinct label, ',' order by label) base_labels from places group by 1),
    found as (select r, label from places union select r, label from copies where not base and share >= {licences.LEAST_SHARE}e0),
    of_all as (select r, string_agg(distinct label, ',' order by label) labels from found group by 1),
    best as (select r, max(share) score from copies group by 1)
    select doc_id, len(w) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0e0) score
    from d left join of_base using (r) left join of_all using (r) left join best using (r)"""


@query
def op13_pivotal_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))
