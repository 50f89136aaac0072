"""Summaries of analysed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.selection import sort_order
from gleaner.sources.tables import written


def insights(scored: DataFrame) -> DataFrame:
    """One row of counts and ranges; ranges are over readable rows with a size, 0 without any."""
    sized = ~F.col("is_unreadable") & F.col("size").isNotNull()
    over = lambda f, c: F.coalesce(f(F.when(sized, F.col(c))), F.lit(0))
    return scored.agg(
        F.count("*").alias("total"), F.count_if(~F.col("is_unreadable")).alias("readable"), F.count_if("is_unreadable").alias("unreadable"),
        F.count_if("is_blacklisted").alias("blacklisted"), F.count("duplicate_of").alias("duplicates"), F.count_if("is_htaccess").alias("htaccess"),
        F.count_if("is_anomaly").alias("anomalies"), F.count_if((F.col("threat_score") >= 10) | F.col("is_blacklisted")).alias("critical"),
        over(F.avg, "size").alias("avg_size"), over(F.min, "size").alias("min_size"), over(F.max, "size").alias("max_size"),
        over(F.avg, "total_tokens").alias("avg_tokens"), over(F.min, "total_tokens").alias("min_tokens"), over(F.max, "total_tokens").alias("max_tokens"),
        over(F.min, "mtime").alias("min_mtime"), over(F.max, "mtime").alias("max_mtime"),
    )


def suspicious_ratio() -> Column:
    return F.when(F.col("total_tokens") > 0, F.col("susp_count") / F.col("total_tokens")).otherwise(F.lit(0.0))


def quadrant() -> Column:
    dense, high = suspicious_ratio() >= 0.15, F.col("threat_score") >= 8
    return F.when(dense & high, "OBFUSCATED WEBSHELL").when(high, "RCE SCRIPT").when(dense, "DENSE NORMAL").otherwise("BENIGN")


def quadrants(scored: DataFrame) -> DataFrame:
    return scored.where("not is_unreadable").groupBy(quadrant().alias("quadrant")).agg(F.count("*").alias("n"))


def score_band(score: Column) -> Column:
    return F.when(score >= 10, "high").when(score >= 5, "medium").otherwise("low")


def entropy_band() -> Column:
    return F.when(F.col("threat_score") >= 15, "critical").when(F.col("threat_score") >= 8, "high").when(F.col("entropy") > 5.8, "dense").otherwise("normal")


def timeline(rows: DataFrame, buckets: int = 20, time: str = "mtime", score: str = "threat_score") -> DataFrame:
    """``buckets`` equal spans from the first to the last time above 0: how many rows, the highest
    score (0 at least), its band and the height beside the fullest; empty ones stay."""
    # two columns are written, so that rows are analysed once for the ends and the counts
    timed = written(rows.where(F.col(time) > 0).select(F.col(time).alias("t"), F.col(score).cast("double").alias("s")), "times")
    ends = timed.agg(F.min("t").alias("first"), F.greatest(F.lit(1), F.max("t") - F.min("t")).alias("span")).where("first is not null")
    place = F.least(F.lit(buckets - 1), F.floor((F.col("t") - F.col("first")) / (F.col("span") / buckets)))
    counts = timed.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.greatest(F.max("s"), F.lit(0.0)).alias("max_threat"))
    spans = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).crossJoin(F.broadcast(ends))
    full = spans.join(F.broadcast(counts), "bucket", "left").na.fill(0, ["n", "max_threat"])  # ``buckets`` rows
    most = F.greatest(F.lit(1), F.max("n").over(Window.partitionBy(F.lit(0))))  # over ``buckets`` rows
    start = F.col("first") + F.col("bucket") * F.col("span") / buckets
    return full.select("bucket", start.alias("start"), "n", "max_threat", score_band(F.col("max_threat")).alias("band"), (F.col("n") / most).alias("height"))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds place, from 0, in the given order of all rows.

    Rows are dealt over partitions by ranges and sorted there; each row's partition and place in it
    are written with it, so that they are the same for the counts and for the rows.
    """
    place = F.monotonically_increasing_id()  # low 33 bits: place in the partition; the rest: the partition
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(dealt.select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "numbered")
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return kept.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def _value_counts(rows: DataFrame, col: str) -> DataFrame:
    """Counts of each value with the number of rows below it. The running sum is over partitions
    of values in order: first within, then what came before by partition."""
    counts = rows.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    dealt = written(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "values")
    before = dealt.groupBy("part").agg(F.sum("n").alias("m")).select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("base"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("value")) - F.col("n")
    return dealt.withColumn("within", within).join(F.broadcast(before), "part").select("value", "n", (F.col("base") + F.col("within")).alias("below"))


def order_stats(rows: DataFrame, col: str = "entropy", qs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(q, value): the element at place floor(n * q), from 0, of the sorted values; 0 without any."""
    counts = _value_counts(rows.where(F.col(col).isNotNull()), col)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    asked = rows.sparkSession.createDataFrame([(q,) for q in qs], "q double").crossJoin(F.broadcast(total)).withColumn("at", F.floor(F.col("total") * F.col("q")))
    hit = (F.col("below") <= F.col("at")) & (F.col("at") < F.col("below") + F.col("n"))
    return counts.join(F.broadcast(asked), hit, "right").select("q", F.coalesce("value", F.lit(0.0)).alias("value"))


def entropy_rank(scored: DataFrame) -> DataFrame:
    """(path, entropy, rank): each readable file's place by entropy, then newest first and path, from 0 to 1."""
    rows = numbered(scored.where("not is_unreadable").select("path", "mtime", "entropy"), [F.col("entropy"), F.col("mtime").desc(), F.col("path")])
    total = rows.agg(F.count("*").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("path", "entropy", (F.col("place") / F.greatest(F.lit(1), F.col("total") - 1)).alias("rank"))


def ranked_rows(scored: DataFrame, mode: str = "threat") -> DataFrame:
    """Adds place, from 0, by one of the result orders."""
    return numbered(scored, sort_order(mode))
