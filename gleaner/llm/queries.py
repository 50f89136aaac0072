"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, hard_negatives, html_text, langid, lm_score, ngram_join, packing, periodic, secret_scan, token_store, topk, url_filter, warc
from gleaner.llm.scratch import Scratch
from gleaner.llm.tokens import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that language identification must not learn from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def span_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(spark, vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(spark, _table(spark, sf_dir, "documents"), Scratch(spark, "ledger").path("ledger"))
    base = F.filter("findings", lambda f: f["kind"].isin("assign", "access", "hex"))
    counts = [count_of(k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("findings")).alias("spans"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark, _table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learned = langid.build_dictionaries(docs.where(~held_out()))
    judged = langid.identify_language(spark, docs, learned)
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spark, _table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "warc").path("archives")
    index = warc.write_archives(spark, _table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(spark, _table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    sha = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (hit > 0).alias("contaminated"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_power_of_two(spark, _table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), with_ids=False)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "token-store").path("ids")
    index = token_store.write_tokens(spark, _table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), folder)
    return token_store.read_tokens(index, folder, with_ids=False)


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    held = F.pmod(F.crc32(text_id), F.lit(7)) == 2
    found = lm_score.score_texts(spark, docs, train=~held, order=2)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def with_repeats(docs: DataFrame) -> DataFrame:
    """The texts of op12: of a tenth of the ids the words from some place on repeat with some period."""

    @F.pandas_udf("string")
    def repeat(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        def one(text: str | None, g: int) -> str | None:
            words = (text or "").encode("utf-8", "surrogatepass").split()
            n = len(words)
            if not n:
                return text
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            tail = (words[a : a + p] * (-(-(n - a) // p)))[: n - a]
            return b" ".join(words[:a] + tail).decode("utf-8", "surrogatepass")

        return pd.Series([one(t, int(g)) for t, g in zip(texts, numbers, strict=True)], dtype=object)

    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    chosen = h % 10 == 0
    repeated = repeat(F.when(chosen, F.col("text")), F.when(chosen, F.floor(h / 10)).otherwise(F.lit(0)).cast("long"))
    return docs.select("doc_id", F.when(chosen, repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(spark, with_repeats(_table(spark, sf_dir, "documents")))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("first"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    longest = [F.col("first.start").alias("start"), (-F.col("first.length")).alias("length"), F.col("first.period").alias("period"), F.expr("(-first.length * 1000) div first.period").alias("exponent_milli")]
    return found.select("doc_id", "n_runs", *longest, "runs_sha256", "collapsed_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", changed)
    return hard_negatives.mine_hard_negatives(spark, vectors, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_top_k, op2_secret_scan, op3_url_filter, op4_language_id, op5_ngram_join, op6_warc, op7_html_text, op8_decontaminate, op9_packing, op10_token_store, op11_lm_score, op12_periodic_runs, op13_hard_negatives)
}

#: What is plain enough for SQL over whole tables; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_top_k": """
with ints as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from ints q join ints c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scores
)
select query_id, rank, vec_id, score from ranked where rank <= 20
""",
    "op6_warc": """
with p as (
  select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages
), f as (
  select digest, min(page_id) as first from p where n >= 100 group by digest
)
select page_id, cast(n as bigint) as payload_bytes, p.digest as payload_digest,
  case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type, case when n >= 100 and page_id <> first then first end as refers_to
from p left join f on p.digest = f.digest
""",
    "op8_decontaminate": """
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
), sized as (
  select item_id, w, least(10, len(w)) as n from b where len(w) > 0
), windows as (
  select distinct item_id, n, array_to_string(w[i + 1 : i + n], ' ') as k from (select *, unnest(range(len(w) - n + 1)) as i from sized)
), places as (
  select doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') as k
  from (select doc_id, w, n, unnest(range(len(w) - n + 1)) as i from d, (select distinct n from windows) where len(w) >= n)
), found as (
  select doc_id, i, places.n, item_id from places join windows on places.k = windows.k and places.n = windows.n
), hit as (
  select doc_id, count(distinct i + j) as n from (select doc_id, i, unnest(range(n)) as j from found) group by doc_id
), named as (
  select doc_id, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hit.n, 0) as bigint) as n_hit, cast(coalesce(named.n, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit on d.doc_id = hit.doc_id left join named on d.doc_id = named.doc_id
""",
    "op13_hard_negatives": """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as alike, cast(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from rows a join rows c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), ranked as (
  select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
  from positives join scores using (anchor_id) where not alike and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
)
select * from ranked where rank <= 3
""",
}
