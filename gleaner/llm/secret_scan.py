"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed. The ledger holds one row for each pair of blob
and rule version that was ever scanned, with what was found; a run scans only pairs that the
ledger lacks, appends them, and joins findings back to all paths that hold the blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch
from gleaner.llm.tokens import release

# The kinds in the order that decides ties, each with its pattern, the group that is
# measured and the fewest characters of it. Runs are maximal, so a length bound inside the pattern
# of access and hex accepts the same runs as a check afterwards. A web token begins where a run of its
# signs begins, and its parts take all of theirs, so each run is read once.
ASSIGN = (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)
ACCESS = (r"AKIA[A-Z0-9]{16,}", 0, 20)
HEX = (r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24)
KEY_BLOCK = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 1)
WEB_TOKEN = (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", 0, 1)
URL_LOGIN = (r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{6,128}@", 0, 1)

#: rule version -> kind -> rule. A changed rule needs a new version name, so that old blobs are scanned anew.
RULES: dict[str, dict[str, tuple[str, int, int]]] = {
    "base-1": {"assign": ASSIGN, "access": ACCESS, "hex": HEX},
    "more-2": {"key_block": KEY_BLOCK, "web_token": WEB_TOKEN, "url_login": URL_LOGIN},
}
KIND_ORDER = [kind for rules in RULES.values() for kind in rules]
FINDINGS = "array<struct<kind:string,start:int,end:int>>"
SEEN_BLOBS = 100_000
LEDGER_SCHEMA = f"blob string, rule_version string, findings {FINDINGS}"


def find_secrets(text: str, rules: list[tuple[str, re.Pattern, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by the order of ``rules``."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows; none if nothing was written there yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def scan_new_blobs(spark: SparkSession, versions: DataFrame, ledger: str, path_col: str, text_col: str, rules: dict[str, dict]) -> DataFrame:
    """Scan what the ledger lacks, append it there, and return (``path_col``, blob) of all versions."""
    work = Scratch(spark, "secrets")
    versions = versions.select(path_col, text_col)
    held = work.table("held", versions.select(path_col, blob_of(F.col(text_col)).alias("blob")))
    blobs = held.groupBy("blob").agg(F.min(path_col).alias("_at")).select("blob", "_at", F.explode(F.array(*map(F.lit, rules))).alias("rule_version"))
    unseen = blobs.join(read_ledger(spark, ledger).select("blob", "rule_version").distinct(), ["blob", "rule_version"], "left_anti")
    todo = unseen.groupBy("blob", "_at").agg(F.sort_array(F.collect_list("rule_version")).alias("versions"))
    # the small side is built in memory, so that the texts stream past it unsorted
    texts = versions.select(F.col(path_col).alias("_path"), F.coalesce(text_col, F.lit("")).alias("_text"))
    contents = texts.join(todo.hint("shuffle_hash"), F.col("_path").eqNullSafe(F.col("_at")) & (blob_of(F.col("_text")) == F.col("blob")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        compiled = {v: [(k, re.compile(p), g, n) for k, (p, g, n) in kinds.items()] for v, kinds in rules.items()}
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        seen: set[str] = set()  # of repeated rows within a batch run
        for batch in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for text, blob, names in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if blob not in seen:
                    if len(seen) >= SEEN_BLOBS:  # one that comes again is scanned again, and the ledger's reader takes one
                        seen.clear()
                    seen.add(blob)
                    for name in names:
                        found = [{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(text, compiled[name])]
                        for col, value in zip(rows, (blob, name, found), strict=True):
                            col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.list_(kind))], ["blob", "rule_version", "findings"])

    contents.select("_text", "blob", "versions").mapInArrow(scan, LEDGER_SCHEMA).write.mode("append").parquet(ledger)
    return held


def scan_secrets(
    spark: SparkSession,
    versions: DataFrame,
    ledger: str,
    path_col: str = "doc_id",
    text_col: str = "text",
    rules: dict[str, dict] = RULES,
) -> DataFrame:
    """One row per row of ``versions``: ``path_col``, blob, findings of all its rule versions.

    Findings are sorted by start, then by kind in the order of ``rules``; starts and ends count
    code points of the whole text. A null text is scanned as an empty one. Versions with equal
    text share a blob and are scanned once. Repeated rows give repeated rows; null paths are kept.
    Other columns are ignored. No rows give no rows, and leave the ledger as it was.

    Only blobs with findings are joined back, from a written table, so that Spark can split a blob
    that very many paths hold.
    """
    work = Scratch(spark, "findings")
    held = scan_new_blobs(spark, versions, ledger, path_col, text_col, rules)
    order = F.create_map(*(x for i, k in enumerate(k for kinds in rules.values() for k in kinds) for x in (F.lit(k), F.lit(i))))
    known = read_ledger(spark, ledger).where(F.col("rule_version").isin(*rules) & (F.size("findings") > 0)).dropDuplicates(["blob", "rule_version"])
    merged = known.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    ranked = F.array_sort(F.transform("findings", lambda f: F.struct(f["start"].alias("start"), order[f["kind"]].alias("order"), f["kind"].alias("kind"), f["end"].alias("end"))))
    merged = work.table("merged", merged.select("blob", F.transform(ranked, lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))).alias("findings")))
    return held.join(merged, "blob", "left").select(path_col, "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def masked(text: str, findings: list[dict], mark: str) -> str:
    """The text with ``mark`` for each span; spans that overlap become one."""
    out, at = [], 0
    for f in sorted(findings, key=lambda f: f["start"]):
        if f["end"] > at:
            out += [text[at : f["start"]], mark] if f["start"] >= at else []
            at = f["end"]
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of ``text_col`` replaced by ``mark``; overlapping spans become one.

    Joined by id and by the text's own hash, so rows that share an id keep their own findings. Null ids match each
    other, null and empty texts have no findings, repeated rows stay, and so do all columns of ``docs``, whatever
    their names; no rows give no rows. Only texts with findings go to Python, each put together once.
    """

    @F.pandas_udf("string")
    def cover(texts: pd.Series, findings: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, f, mark) for t, f in zip(texts, findings, strict=True)], dtype=object)


    hits = found.where(F.size("findings") > 0).select(F.col(id_col).alias("_id"), F.col("blob").alias("_blob"), F.col("findings").alias("_found")).dropDuplicates(["_id", "_blob"])
    own, kept = docs.alias("own"), [F.col(f"own.{c}") for c in docs.columns]
    text = F.col(f"own.{text_col}")
    met = own.join(hits.alias("hit"), F.col(f"own.{id_col}").eqNullSafe(F.col("hit._id")) & (blob_of(text) == F.col("hit._blob")), "left")
    hit = F.size("hit._found") > 0
    new = F.when(hit, cover(F.when(hit, text), F.when(hit, F.col("hit._found")))).otherwise(text)
    return met.select(*(new.alias(c) if c == text_col else k for c, k in zip(docs.columns, kept, strict=True)))
