"""A corpus pipeline of five stages over ``documents``.

Every stage reads what its predecessor wrote; ``run`` writes each stage's rows as Parquet in the
shared folder and rereads them. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, langid, ngram_join, packing, secret_scan
from gleaner.llm.queries import held_out
from gleaner.llm.scratch import Scratch
from gleaner.llm.tokens import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go; the others take the language it found.

    A null or empty text, and one without letters, is rejected; a text of any length is judged as a whole. Repeated
    rows, and rows without an id, are judged each. lang of the documents teaches, its nulls don't. Other columns are
    ignored, whatever their names; no rows give no rows, and where nothing teaches all rows go.
    """
    learned = langid.build_dictionaries(docs.where(~held_out()))
    judged = langid.identify_language(spark, docs, learned, carry=("text", "source", "n_chars"))
    return judged.where(~F.col("rejected")).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays.

    A row with a null id is a document of its own and takes part, after all ids: it stays unless its
    component has an id or another such row before it. Of rows equal in all columns one stays; rows
    that repeat an id with other contents are one document and stay or go together.
    """
    work = Scratch(spark, "ngram-stage")
    docs = docs.select(*COLUMNS)
    top = docs.agg(F.max("doc_id").alias("top")).first()["top"]
    after = F.lit(-1 if top is None else top).cast("long") + 1 + F.monotonically_increasing_id()
    # written, so that the numbers stay the same
    nameless = work.table("nameless", docs.where("doc_id is null").dropDuplicates().withColumn("_id", after))
    named = docs.where("doc_id is not null").withColumn("_id", F.col("doc_id").cast("long")).unionByName(nameless)
    found = ngram_join.jaccard_components(spark, named, id_col="_id")
    gone = work.table("gone", found.where("_id <> component_id").select("_id").distinct())
    several = work.table("several", named.groupBy("_id").agg(F.count("*").alias("rows")).where("rows > 1").select("_id"))
    kept = named.join(small(gone), "_id", "left_anti")
    if not several.limit(1).count():
        return kept.select(*COLUMNS)
    once = kept.join(small(several), "_id", "left_anti").select(*COLUMNS)
    return once.unionByName(kept.join(small(several), "_id", "left_semi").select(*COLUMNS).dropDuplicates())


def small(ids: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of ids, to be broadcast if it has no more than ``rows``."""
    return F.broadcast(ids) if ids.count() <= rows else ids


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words hit by a benchmark passage leave the text; a document without a hit is unchanged, and
    one of which no word is left goes.

    A null or empty text has no words and stays. A text of any length is searched as a whole. Repeated rows, and rows
    without an id, stay. Other columns are ignored, whatever their names; no rows or no benchmark change nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(spark, docs, benchmark, carry=("lang", "source"), cleaned=True)
    kept = found.where((F.size("spans") == 0) | (hit_words(F.col("spans")) < F.col("n_words")))
    return kept.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.length("cleaned").cast("long").alias("n_chars"))


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; all documents stay.

    A null text stays null, an empty one empty. A text of any length is scanned as a whole, with time in proportion.
    Rows that repeat an id have their own findings each; rows without an id stay. Other columns are ignored, whatever
    their names; no rows give no rows.
    """
    found = secret_scan.scan_secrets(spark, docs, Scratch(spark, "ledger").path("ledger"))
    return secret_scan.redact(docs.select(*COLUMNS), found).withColumn("n_chars", F.length("text").cast("long"))


def power_of_two_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece and sequence, the columns of ``packing.pack_power_of_two``.

    A null or empty text is the end id alone. A text of any length is encoded and cut as a whole. Repeated rows, and
    rows without an id, are packed each. Other columns are ignored, whatever their names; no rows give no rows.
    """
    return packing.pack_power_of_two(spark, docs, vocabulary("byte_bpe_50k.json"), with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("packing", power_of_two_packing),
]

#: Compression, tokenizers and components are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.table(str(k), stage(spark, docs, sf_dir))
        if k:
            work.drop(str(k - 1))
    return docs
