"""Features, scores and anomaly flags."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import needles as N
from gleaner.functions.text import ascii_lower, entropy, entropy_bytes, tokens
from gleaner.operators.hashes import drop_whitelisted, flag_blacklisted, mark_duplicates
from gleaner.operators.selection import filter_patterns, is_htaccess, match_needles
from gleaner.operators.moments import STATS, equal_keys, moments, stats as stats_of
from gleaner.sources.tables import written

FEATURES = ["path", "size", "mtime", "total_tokens", "matched_tokens", "md5", "is_blacklisted", "is_htaccess", "duplicate_of", "error", "is_unreadable", "entropy"]


def readable() -> Column:
    return F.coalesce("is_readable", F.lit(False))


def unreadable_features(files: DataFrame) -> DataFrame:
    no = F.lit(False)
    return files.where(~readable()).select(
        "path", F.lit(None).cast("long").alias("size"), F.coalesce("mtime", F.lit(0)).cast("long").alias("mtime"), F.lit(None).cast("long").alias("total_tokens"),
        F.array(F.lit("NOT_READABLE")).alias("matched_tokens"), F.lit("N/A").alias("md5"), no.alias("is_blacklisted"), no.alias("is_htaccess"),
        F.lit(None).cast("string").alias("duplicate_of"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("is_unreadable"), F.lit(0.0).alias("entropy"),
    )


def token_features(
    files: DataFrame, mode: str = "words", needles: list[tuple[str, float | None]] = N.WEB, emit: str = "needle", entropy_source: str = "tokens", naming: int = 8, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(path, size, mtime, md5, total_tokens, matched_tokens, entropy, columns of ``carry``) of each file, made where
    the file lies: content goes through no shuffle."""
    found = files.select("path", "size", "mtime", "content", *carry, F.md5(F.col("content").cast("binary")).alias("md5"), tokens(F.col("content"), mode, naming).alias("tokens"))
    found = found.withColumn("matched_tokens", match_needles(F.col("tokens"), needles, emit))
    measure = entropy(F.array_join("matched_tokens", "")) if entropy_source == "tokens" else entropy_bytes(F.col("content"))
    return found.select("path", "size", "mtime", "md5", F.size("tokens").cast("long").alias("total_tokens"), "matched_tokens", measure.alias("entropy"), *carry)


WEIGHED = "weighed"


def table_features(files: DataFrame, table: DataFrame, mode: str = "words", naming: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """``token_features`` with a needle table of any length, as joins: also weighed (base, critical, obfuscation,
    upload), null without a match. ``table`` has the columns of ``sources.files.needle_table``.

    Files' distinct lower-cased tokens meet the table's by equality, so a token that most files have meets one row
    for each of its spellings; Spark broadcasts the table while it is small and may split such a token otherwise.
    A weight is looked up under the lower-cased token, the last of several counts, and what has none weighs 1.
    """
    known = table.select("pos", "token", ascii_lower(F.col("token")).alias("low"), F.col("weight").cast("decimal(18,8)").alias("weight"), "is_critical", "is_obfuscation", "is_upload")
    flags = [F.coalesce(F.max(f"is_{c}"), F.lit(False)).alias(c) for c in ("critical", "obfuscation", "upload")]
    by_low = known.groupBy("low").agg(*flags)
    weights = known.where("weight is not null").groupBy(F.col("token").alias("low")).agg(F.max_by("weight", "pos").alias("weight"))
    spelled = known.groupBy("low", "token").agg(F.min("pos").alias("pos")).join(weights, "low", "left").join(by_low, "low")
    spelled = spelled.withColumn("weight", F.coalesce("weight", F.lit(Decimal(1)).cast("decimal(18,8)")))

    found = files.select("path", "size", "mtime", *carry, F.md5(F.col("content").cast("binary")).alias("md5"), tokens(F.col("content"), mode, naming).alias("tokens"))
    found = written(found.withColumn("_row", F.monotonically_increasing_id()), "file-tokens")  # so that rows keep their numbers
    low = found.select("_row", F.explode(F.array_distinct(F.transform("tokens", ascii_lower))).alias("low"))
    hits = low.join(spelled, "low").groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("pos", "token")))["token"].alias("matched_tokens"),
        F.struct(F.sum("weight").alias("base"), *(F.max(c).alias(c) for c in ("critical", "obfuscation", "upload"))).alias(WEIGHED),
    )
    none = F.array().cast("array<string>")
    met = found.join(hits, "_row", "left").withColumn("matched_tokens", F.coalesce("matched_tokens", none))
    return met.select("path", "size", "mtime", "md5", F.size("tokens").cast("long").alias("total_tokens"), "matched_tokens", entropy(F.array_join("matched_tokens", "")).alias("entropy"), *carry, WEIGHED)


def features(
    files: DataFrame, white: DataFrame, black: DataFrame, mark: bool = True, outcomes: DataFrame | None = None, table: DataFrame | None = None, **how: object
) -> DataFrame:
    """One row per kept file: known good files are dropped, known bad ones flagged, copies point at
    the first file of their hash; unreadable files (also those of which that is not known) keep a row
    without content. ``outcomes`` (md5, error) says what failed of the actions on known bad files.

    Files are read once: their tokens and hashes are written, without content, and so are the joined rows, which is
    all that the returned DataFrame reads. With ``table``, a needle table of any length, files are matched by joins
    and the rows keep what ``analyse`` needs of it in the column weighed.
    """
    kept = filter_patterns(files).withColumn("is_readable", readable())
    kept = kept.withColumn("content", F.when(F.col("is_readable"), F.col("content")))
    made = token_features(kept, carry=("is_readable",), **how) if table is None else table_features(kept, table, carry=("is_readable",), **how)
    found, extra = written(made, "tokens"), [] if table is None else [WEIGHED]
    rows = flag_blacklisted(drop_whitelisted(found.where("is_readable"), white), black)
    rows = mark_duplicates(rows) if mark else rows.withColumn("duplicate_of", F.lit(None).cast("string"))
    if outcomes is None:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    else:
        rows = rows.join(outcomes.groupBy("md5").agg(F.min("error").alias("_error")), "md5", "left").withColumn("error", F.when(F.col("is_blacklisted"), F.col("_error")))
    full = rows.select(
        "path", "size", "mtime", "total_tokens", "matched_tokens", "md5", "is_blacklisted", is_htaccess(F.col("path")).alias("is_htaccess"), "duplicate_of",
        "error", F.lit(False).alias("is_unreadable"), "entropy", *extra,
    )
    return written(full.unionByName(unreadable_features(found), allowMissingColumns=True), "features")


def weight_scale(needles: list[tuple[str, float | None]]) -> int:
    """The decimals that sums of these weights need, 2 at least; those beyond the eighth are rounded."""
    return min(8, max([2, *(-Decimal(str(w)).normalize().as_tuple().exponent for _, w in needles if w is not None)]))


def base_score(matched: Column, needles: list[tuple[str, float | None]] = N.WEB) -> Column:
    """Sum of weights, with all their decimals; the table's own spelling is looked up with the lower-cased
    token, and what it lacks weighs 1."""
    weights = {n: Decimal(str(w)) for n, w in needles if w is not None}
    kind = f"decimal(28,{weight_scale(needles)})"
    table = F.create_map(*(x for n, w in weights.items() for x in (F.lit(n), F.lit(w).cast(kind)))).cast(f"map<string,{kind}>")
    zero, one = (F.lit(Decimal(n)).cast(kind) for n in (0, 1))
    return F.aggregate(matched, zero, lambda s, t: (s + F.coalesce(F.try_element_at(table, ascii_lower(t)), one)).cast(kind))


def threat_score(
    path: Column, size: Column, matched: Column, text_entropy: Column, is_blacklisted: Column, needles: list[tuple[str, float | None]] = N.WEB, categories: N.Categories = N.CATEGORIES
) -> Column:
    """Weights, then multipliers for categories found together, then bonuses for place and small
    dense files, and only then rounded to two decimals, halves up; at least 100 for a known bad file."""
    low = F.transform(matched, ascii_lower)
    flags = (F.arrays_overlap(low, F.array(*map(F.lit, c)).cast("array<string>")) for c in categories)
    return score_of(path, size, base_score(matched, needles), *flags, text_entropy, is_blacklisted, weight_scale(needles))


def score_of(path: Column, size: Column, base: Column, critical: Column, obfuscation: Column, upload: Column, text_entropy: Column, is_blacklisted: Column, scale: int) -> Column:
    """The score of a file from its sum of weights, of ``scale`` decimals, and the categories among its tokens."""
    kind = f"decimal(32,{scale + 2})"
    score = base.cast(kind)
    score = F.when(critical & obfuscation, score * F.lit(Decimal("2.5"))).otherwise(score).cast(kind)
    score = F.when(critical & upload, score * F.lit(Decimal("1.8"))).otherwise(score).cast(kind)
    place = ascii_lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike("|".join(N.UPLOAD_PLACES))
    score = F.when(place & ((score > 0) | (text_entropy > 5.5)), score + F.lit(Decimal("5"))).otherwise(score).cast(kind)
    score = F.when(size.isNotNull() & (size < 20480) & (text_entropy > 5.8), score + F.lit(Decimal("3"))).otherwise(score).cast(kind)
    value = F.round(score, 2).cast("double")
    return F.when(is_blacklisted, F.greatest(value, F.lit(100.0))).otherwise(value)


def susp_count() -> Column:
    return F.when(F.col("is_unreadable"), 0).otherwise(F.size("matched_tokens")).cast("long")


def corpus_stats(feats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of each measure over readable rows (0 without any), and matched tokens per
    token: one row, or one for each group of the columns ``by``."""
    return stats_of(moments(feats, by), by)


def analyse(
    feats: DataFrame, z_threshold: float = 3.5, stats: DataFrame | None = None, needles: list[tuple[str, float | None]] = N.WEB, categories: N.Categories = N.CATEGORIES,
    by: list[str] | None = None,
) -> DataFrame:
    """Adds susp_count, threat_score, z, residual, is_anomaly and date to features. ``needles`` and
    ``categories`` are those that the features were matched with (see ``sources.files.needle_lists``).

    z and residual are against all readable rows, or with ``by`` against those of the row's own group; a group's
    statistics are one row, so the group of most rows meets one row, and Spark may split it. A group without
    readable rows has z and residual 0. The columns of ``by`` stay.
    """
    told = stats if stats is not None else corpus_stats(feats, by)
    rows = feats.withColumn("susp_count", susp_count())
    if by:
        numbers = [c for c in told.columns if c not in by]
        rows = rows.alias("f").join(told.alias("s"), equal_keys("f", "s", by), "left").select("f.*", *(F.coalesce(f"s.{c}", F.lit(0.0)).alias(c) for c in numbers))
    else:
        rows = rows.crossJoin(F.broadcast(told))
    unreadable = F.col("is_unreadable")

    def z(name: str) -> Column:
        v, m, s = F.col(STATS[name]).cast("double"), F.col(f"{name}_mean"), F.col(f"{name}_std")
        return F.when(unreadable | (s == 0) | v.isNull(), F.lit(0.0)).otherwise((v - m) / s)

    given = [F.col(c) for c in ("path", "size", "matched_tokens", "entropy", "is_blacklisted")]
    if WEIGHED in feats.columns:  # matched by a table, which gave weights and categories
        told = [F.coalesce(F.col(f"{WEIGHED}.base"), F.lit(0)), *(F.coalesce(F.col(f"{WEIGHED}.{c}"), F.lit(False)) for c in ("critical", "obfuscation", "upload"))]
        score = score_of(*given[:2], *told, *given[3:], 8)
    else:
        score = threat_score(*given, needles, categories)
    rows = rows.withColumn("z", F.struct(*(z(n).alias(n) for n in STATS))).withColumn("threat_score", F.when(unreadable, F.lit(0.0)).otherwise(score))
    rows = rows.withColumn("residual", F.when(unreadable, F.lit(0.0)).otherwise(F.col("susp_count") - F.col("total_tokens") * F.col("ratio")))
    far = F.lit(False)
    for n in ("size", "susp", "entropy", "mtime"):
        far = far | (F.abs(F.col(f"z.{n}")) > z_threshold)
    odd = (F.col("threat_score") >= 8) | far | (F.col("residual") > 5) | F.col("is_blacklisted") | F.col("is_htaccess") | F.col("duplicate_of").isNotNull()
    return rows.withColumn("is_anomaly", unreadable | odd).withColumn("date", format_date(F.col("mtime"))).select(*FEATURES, *(k for k in by or [] if k not in FEATURES), "susp_count", "threat_score", "z", "residual", "is_anomaly", "date")


def format_date(mtime: Column) -> Column:
    return F.when(mtime.isNull() | (mtime == 0), "N/A").otherwise(F.date_format(F.timestamp_seconds(mtime), "dd/MM/yyyy, HH:mm:ss"))
