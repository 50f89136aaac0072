"""Count, mean and sum of squared deviations of each measure: kept for a chunk or a group, and merged.

Merging takes means and deviations of the parts (Chan's form), never sums of squares, which would cancel on epoch
seconds. Merged rows have the form of their parts, so that they merge again: chunks to days, days to all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The measures of a file and the columns that hold them.
STATS = {"size": "size", "mtime": "mtime", "tokens": "total_tokens", "susp": "susp_count", "entropy": "entropy"}


def measures(feats: DataFrame) -> DataFrame:
    """Readable rows with susp_count; NaN counts as null."""
    rows = feats.where("not is_unreadable").withColumn("susp_count", F.size("matched_tokens").cast("long"))
    return rows.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in STATS.values()})


def moments(feats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n_, mean_ and m2_ of each measure) over readable rows; without ``by`` one row, with or without rows.

    Rows are added up before the shuffle, so that a group that owns most rows is one row of each task there.
    """
    aggs = []
    for name, col in STATS.items():
        n = F.count(col)
        aggs += [n.alias(f"n_{name}"), F.coalesce(F.avg(col), F.lit(0.0)).alias(f"mean_{name}"), F.coalesce(F.var_pop(col) * n, F.lit(0.0)).alias(f"m2_{name}")]
    return measures(feats).groupBy(*(by or [])).agg(*aggs)


def equal_keys(left: str, right: str, keys: list[str]) -> Column:
    """The condition that two aliases have equal keys; null equals null."""
    same = F.col(f"{left}.{keys[0]}").eqNullSafe(F.col(f"{right}.{keys[0]}"))
    for k in keys[1:]:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def merged(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The moments of the union of the rows of ``parts``, for each group of ``by``."""
    keys = by or []
    means = parts.groupBy(*keys).agg(*(
        F.coalesce(F.sum(F.col(f"n_{m}") * F.col(f"mean_{m}")) / F.nullif(F.sum(f"n_{m}"), F.lit(0)), F.lit(0.0)).alias(f"all_{m}") for m in STATS
    ))
    if keys:
        beside = parts.alias("p").join(means.alias("a"), equal_keys("p", "a", keys)).select("p.*", *(f"a.all_{m}" for m in STATS))
    else:
        beside = parts.crossJoin(F.broadcast(means))
    aggs: list[Column] = []
    for m in STATS:
        apart = F.col(f"mean_{m}") - F.col(f"all_{m}")
        aggs += [F.coalesce(F.sum(f"n_{m}"), F.lit(0)).alias(f"n_{m}"), F.coalesce(F.max(f"all_{m}"), F.lit(0.0)).alias(f"mean_{m}")]
        aggs.append(F.coalesce(F.sum(F.col(f"m2_{m}") + F.col(f"n_{m}") * apart * apart), F.lit(0.0)).alias(f"m2_{m}"))
    return beside.groupBy(*keys).agg(*aggs)


def stats(kept: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, mean and population deviation of each measure, ratio of matched tokens to tokens) of moments."""
    out = [F.col(k) for k in by or []]
    for m in STATS:
        out += [F.col(f"mean_{m}").alias(f"{m}_mean"), F.when(F.col(f"n_{m}") > 0, F.sqrt(F.col(f"m2_{m}") / F.col(f"n_{m}"))).otherwise(F.lit(0.0)).alias(f"{m}_std")]
    return kept.select(*out).withColumn("ratio", F.col("susp_mean") / F.greatest(F.lit(1.0), F.col("tokens_mean")))
