"""Reports: text lines, the command-line form, actions to take, reputation verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from gleaner.functions import needles as N
from gleaner.functions.text import json_leaf_paths, variant_leaf_paths
from gleaner.operators.analysis import readable, token_features
from gleaner.operators.hashes import drop_whitelisted, flag_blacklisted, mark_duplicates
from gleaner.operators.selection import filter_patterns
from gleaner.sources.tables import written


def one_decimal(value: Column) -> Column:
    """The number with one decimal, halves away from zero; null stays null."""
    tenths = F.floor(F.abs(value.cast("double")) * 10 + 0.5).cast("long")
    sign = F.when((value < 0) & (tenths > 0), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def report_lines(scored: DataFrame) -> DataFrame:
    """One text line per row: path, class, and for readable rows the measures."""
    kind = (
        F.when(F.col("is_unreadable"), "NOT_READABLE").when(F.col("is_blacklisted"), "BLACKLIST").when(F.col("is_htaccess"), "HTACCESS")
        .when(F.col("duplicate_of").isNotNull(), F.col("duplicate_of")).when(F.size("matched_tokens") > 0, F.array_join("matched_tokens", ", "))
    )
    head = F.concat(F.col("path"), F.coalesce(F.concat(F.lit(" ("), kind, F.lit(")")), F.lit("")))
    measures = F.format_string(
        " | %s | Size: %s KB | ThreatScore: %s | Tokens: %d | Suspicious: %d | Z-Susp: %s",
        "date", one_decimal(F.col("size") / 1024), one_decimal(F.col("threat_score")), "total_tokens", "susp_count", one_decimal(F.col("z.susp")),
    )
    md5 = F.when(F.col("md5") != "N/A", F.concat(F.lit(" | MD5: "), F.col("md5"))).otherwise("")
    tail = F.when(~F.col("is_unreadable") & F.col("size").isNotNull(), F.concat(measures, md5)).otherwise(F.concat(F.lit(" | "), F.col("date")))
    return scored.select("path", F.concat(head, tail).alias("line"))


def cli_report(files: DataFrame, white: DataFrame, black: DataFrame, reputation: DataFrame | None = None) -> DataFrame:
    """(path, class, line): known bad files leave first, then copies, then files whose hash has a verdict
    in ``reputation``, then files with matched tokens; a file without any gives no row."""
    kept = filter_patterns(files, N.CLI_PATTERNS).where(readable())
    rows = drop_whitelisted(written(token_features(kept, needles=N.CLI, emit="token"), "cli"), white)
    rows = flag_blacklisted(rows, black)
    marked = mark_duplicates(rows.where("not is_blacklisted"))
    told = marked.withColumn("verdict", F.lit(None).cast("string")) if reputation is None else apply_reputation(marked, reputation)
    kind = F.when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("verdict").isNotNull(), F.col("verdict")).when(F.size("matched_tokens") > 0, "matched")
    line = (
        F.when(F.col("class") == "duplicate", F.format_string("%s -> %s(%s)", "path", "duplicate_of", "md5"))
        .when(F.col("class") == "webshell", F.format_string("[!] %s (VTotal Webshell) (%s)", "path", "md5"))
        .when(F.col("class") == "malicious", F.format_string("[!] %s (VTotal Malicious) (%s)", "path", "md5"))
        .otherwise(F.format_string("%s (%s)", F.col("path"), F.array_join("matched_tokens", ", ")))
    )
    found = told.withColumn("class", kind).where(F.col("class").isNotNull()).select("path", "class", line.alias("line"))
    return rows.where("is_blacklisted").select("path", F.lit("blacklist").alias("class"), F.format_string("%s (Blacklist)(%s)", "path", "md5").alias("line")).unionByName(found)


def quarantine_list(features: DataFrame) -> DataFrame:
    """What to do about known bad files; nothing is moved or removed here."""
    return features.where("is_blacklisted").select("path", "md5", F.lit("quarantine").alias("action"), F.lit("hash is blacklisted").alias("reason"))


def write_features(features: DataFrame, path: str, form: str = "json") -> None:
    """Feature rows partitioned by day."""
    features.withColumn("day", F.to_date(F.timestamp_seconds("mtime"))).write.partitionBy("day").format(form).save(path)


def read_features(spark: SparkSession, path: str, schema: StructType, low: int, high: int, form: str = "json") -> DataFrame:
    """Rows of ``write_features`` whose time lies from ``low`` to ``high``, both ends in and not 0; only the folders
    of those days are read, which the session's time zone decides as it did when they were written."""
    kept = StructType([f for f in schema.fields if f.name != "day"])
    rows = spark.read.schema(StructType([*kept.fields, StructField("day", DateType())])).format(form).load(path)
    first, last = (F.to_date(F.timestamp_seconds(F.lit(t))) for t in (low, high))
    return rows.where(F.col("day").between(first, last) & F.col("mtime").between(low, high) & (F.col("mtime") != 0))


def apply_reputation(files: DataFrame, reputation: DataFrame, variant: bool = False) -> DataFrame:
    """Adds verdict: webshell if any string of the reply is 'malicious', malicious if it counts votes for
    that, else null; a reply without data has none. Of several replies to one hash the worst counts. With
    ``variant`` the strings are searched without Python, see ``variant_leaf_paths``."""
    votes = F.get_json_object("reply", "$.data.attributes.total_votes.malicious").try_cast("double")
    held = F.get_json_object("reply", "$.data").isNotNull()
    voted = F.coalesce(votes > 0, F.lit(False)).alias("voted")
    if variant:
        found = variant_leaf_paths(reputation.where(held), "malicious", "md5").where(F.size("paths") > 0).select("md5", F.lit(True).alias("named"))
        told = reputation.where(held).select("md5", F.lit(False).alias("named"), voted).unionByName(found.withColumn("voted", F.lit(False)))
    else:
        told = reputation.where(held).select("md5", (F.size(json_leaf_paths(F.col("reply"), "malicious")) > 0).alias("named"), voted)
    told = told.groupBy("md5").agg(F.max("named").alias("_named"), F.max("voted").alias("_voted"))
    verdict = F.when(F.col("_named"), "webshell").when(F.col("_voted"), "malicious")
    return files.join(told, "md5", "left").withColumn("verdict", verdict).drop("_named", "_voted")
