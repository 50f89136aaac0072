"""A whole scan from the command line: a tree and two hash lists in, features, report and summaries out.

    python -m gleaner.jobs.scan file:///srv/www --out file:///data/scan --white white.txt --black black.txt --tokens lexer

``out`` gets features (JSON by day), report (text lines in the chosen order), quarantine, warnings, insights, timeline
and quadrants; with ``--profile cli`` the lines of the command-line form instead. Nothing of the tree is changed.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import needles as N
from gleaner.operators import analysis, dashboard, report, selection
from gleaner.sources import files as sources
from gleaner.sources import tree
from gleaner.sources.tables import count_written, drop_written, written


def hash_list(spark: SparkSession, path: str | None) -> DataFrame:
    return sources.load_hashes(spark, path) if path else spark.createDataFrame([], "md5 string")


def scan(
    spark: SparkSession, uri: str, out: str, white: str | None = None, black: str | None = None, profile: str = "web", tokens: str = "words", entropy: str = "tokens",
    z_threshold: float = 3.5, order: str = "threat", needles: str | None = None, max_file_bytes: int = 256 << 20,
) -> None:
    """Scan the tree at ``uri`` and write what was found below ``out``. ``needles`` is a CSV file with the columns of
    ``sources.files.NEEDLES``. Tables that the scan wrote for itself are removed."""
    before = count_written()
    patterns = N.PATTERNS if profile == "web" else N.CLI_PATTERNS
    files = tree.read_tree(spark, uri, patterns="|".join(patterns), maxFileBytes=max_file_bytes).where("is_script")
    lists = [hash_list(spark, p) for p in (white, black)]
    if profile == "cli":
        report.cli_report(files, *lists).select("line").write.text(f"{out}/report")
        drop_written(spark, before)
        return
    table = spark.read.csv(needles, schema=sources.NEEDLES, header=True) if needles else None
    feats = analysis.features(files, *lists, table=table, mode=tokens, **({"entropy_source": entropy} if table is None else {}))
    report.write_features(feats.drop(analysis.WEIGHED), f"{out}/features")
    scored = written(analysis.analyse(feats, z_threshold), "scored")
    report.report_lines(selection.sort_rows(scored, order)).select("line").write.text(f"{out}/report")
    for name, rows in {
        "quarantine": report.quarantine_list(feats), "warnings": selection.warnings(feats), "insights": dashboard.insights(scored),
        "timeline": dashboard.timeline(scored).orderBy("bucket"), "quadrants": dashboard.quadrants(scored),
        "labels": scored.select("path", selection.severity().alias("severity"), selection.status().alias("status")).where(F.col("severity").isNotNull()),
    }.items():
        rows.write.json(f"{out}/{name}")
    drop_written(spark, before)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("tree")
    p.add_argument("--out", required=True)
    p.add_argument("--white")
    p.add_argument("--black")
    p.add_argument("--profile", choices=["web", "cli"], default="web")
    p.add_argument("--tokens", choices=["words", "lexer"], default="words")
    p.add_argument("--entropy", choices=["tokens", "content"], default="tokens")
    p.add_argument("--z-threshold", type=float, default=3.5)
    p.add_argument("--order", choices=selection.SORT_MODES, default="threat")
    p.add_argument("--needles")
    p.add_argument("--max-file-bytes", type=int, default=256 << 20)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("gleaner-scan").getOrCreate()
    scan(spark, a.tree, a.out, a.white, a.black, a.profile, a.tokens, a.entropy, a.z_threshold, a.order, a.needles, a.max_file_bytes)


if __name__ == "__main__":
    main()
