"""Filters on paths, matching, and choices among analysed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import needles as N
from gleaner.functions.text import LOWER, UPPER, ascii_lower, extension


def filter_patterns(files: DataFrame, patterns: list[str] = N.PATTERNS) -> DataFrame:
    """Rows whose extension matches a pattern as a whole, letter case aside."""
    return files.where(extension(F.col("path")).rlike("^(?i)(" + "|".join(patterns) + ")$"))


def filter_extensions(files: DataFrame, extensions: list[str]) -> DataFrame:
    return files.where(extension(F.col("path")).isin(extensions))


def is_htaccess(path: Column) -> Column:
    return extension(path) == "htaccess"


def _ascii_lower(name: str) -> str:
    return name.translate(str.maketrans(UPPER, LOWER))


def match_needles(tokens: Column, needles: list[tuple[str, float | None]], emit: str = "needle") -> Column:
    """Needles that are among the tokens, in needle order; or the tokens that are needles, in token
    order. Compared without regard to the case of A-Z."""
    names = list(dict.fromkeys(n for n, _ in needles))
    if not names:
        return F.array().cast("array<string>")
    wanted = F.array(*(F.lit(n) for n in dict.fromkeys(map(_ascii_lower, names))))
    if emit == "needle":
        hits = F.array_intersect(wanted, _lowered(tokens, names))
        groups: dict[str, list[str]] = {}
        for n in names:
            groups.setdefault(_ascii_lower(n), []).append(n)
        if len(groups) == len(names):
            spelled = F.create_map(*(F.lit(x) for low, (n,) in groups.items() for x in (low, n)))
            return F.transform(hits, lambda low: F.element_at(spelled, low))
        return F.filter(F.array(*map(F.lit, names)), lambda n: F.array_contains(hits, ascii_lower(n)))
    return F.filter(tokens, lambda t: F.array_contains(wanted, ascii_lower(t)))


def _lowered(tokens: Column, names: list[str]) -> Column:
    """All tokens in lower case. If no needle has other signs than ASCII, one call of Spark's ``lower``
    serves for all tokens of a file; of the signs that it makes ASCII only the Kelvin sign does so alone. Tokens of
    sources have no NUL, which stands between them; the lexer's have line ends."""
    if not all(n.isascii() and "\0" not in n for n in names):
        return F.transform(tokens, ascii_lower)
    return F.split(F.lower(F.replace(F.array_join(tokens, "\0"), F.lit("\u212a"), F.lit("?"))), "\0")


def match_needles_by_join(files: DataFrame, needles: DataFrame, key: str = "path") -> DataFrame:
    """The same for needle tables too long for literals: (key, matched_tokens) in needle order. A file's tokens are
    made lower and distinct before they become rows, which meet the table before any other shuffle."""
    # for signs of ASCII alone Spark's lower is the same and faster; the outer form keeps Spark from a filter on
    # the array, for which the tokens would be made twice
    low = F.transform("tokens", lambda t: F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(ascii_lower(t)))
    rows = files.select(key, F.explode_outer(F.array_distinct(low)).alias("low"))
    hits = rows.join(needles.select("pos", "token", ascii_lower(F.col("token")).alias("low")), "low")
    found = hits.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("pos", "token"))).alias("m"))
    return found.select(key, F.col("m.token").alias("matched_tokens"))


def select_rows(scored: DataFrame, mode: str = "all", query: str = "", low: int | None = None, high: int | None = None) -> DataFrame:
    """anomalies, critical, obfuscated, blacklisted, time (low to high, both ends in), search (path
    or token holds the query), tokens (a token holds it). A blank query keeps all."""
    q = query.strip().lower()
    in_tokens = F.exists("matched_tokens", lambda t: F.contains(F.lower(t), F.lit(q)))
    if mode == "time":
        return scored.where((F.col("mtime") != 0) & F.col("mtime").between(low, high))
    if mode in ("search", "tokens"):
        return scored.where(in_tokens if mode == "tokens" else F.contains(F.lower("path"), F.lit(q)) | in_tokens) if q else scored
    conditions = {
        "all": F.lit(True),
        "anomalies": F.col("is_anomaly"),
        "critical": (F.col("threat_score") >= 10) | F.col("is_blacklisted"),
        "obfuscated": (F.col("entropy") >= 5.8) & ~F.col("is_unreadable"),
        "blacklisted": F.col("is_blacklisted"),
    }
    return scored.where(conditions[mode])


def warnings(features: DataFrame) -> DataFrame:
    failed = features.where(F.col("is_blacklisted") & F.col("error").isNotNull()).select(F.lit("action failed").alias("warning"), "path")
    return failed.unionByName(features.where("is_unreadable").select(F.lit("not readable").alias("warning"), "path"))


def severity() -> Column:
    return (
        F.when(F.col("is_unreadable"), "NOT READABLE").when(F.col("is_blacklisted"), "BLACKLIST").when(F.col("threat_score") >= 15, "CRITICAL")
        .when(F.col("threat_score") >= 8, "HIGH RISK").when(F.col("is_htaccess"), "HTACCESS").when(F.col("duplicate_of").isNotNull(), "DUPLICATE")
    )


def status() -> Column:
    """The error or duplicate target that belongs to the chosen label, else the matched tokens."""
    tokens = F.array_join("matched_tokens", ", ")
    label = severity()
    return F.when(label == "BLACKLIST", F.coalesce("error", tokens)).when(label == "DUPLICATE", F.col("duplicate_of")).otherwise(tokens)


def essential_tokens() -> Column:
    return F.array_intersect(F.transform("matched_tokens", ascii_lower), F.array(*map(F.lit, N.ESSENTIAL)))


def listing_order() -> list[Column]:
    """Readable files newest first, then by path; after them the others by path."""
    return [F.coalesce("is_unreadable", F.lit(False)), F.when(~F.col("is_unreadable"), F.coalesce("mtime", F.lit(0))).desc(), F.col("path")]


SORT_MODES = ["threat", "mtime", "tokens", "susp", "residual"]


def sort_order(mode: str = "threat") -> list[Column]:
    """By the key falling, null as 0; ties in listing order."""
    key = {"threat": F.col("threat_score"), "mtime": F.col("mtime"), "tokens": F.col("total_tokens"), "susp": F.abs(F.col("z.susp")), "residual": F.col("residual")}[mode]
    return [F.coalesce(key.cast("double"), F.lit(0.0)).desc(), *listing_order()]


def sort_rows(scored: DataFrame, mode: str = "threat") -> DataFrame:
    return scored.orderBy(*sort_order(mode))


def top_threats(scored: DataFrame, k: int = 5) -> DataFrame:
    return sort_rows(scored.where("not is_unreadable"), "threat").limit(k)


def top_recent(scored: DataFrame, k: int = 5) -> DataFrame:
    return scored.where("not is_unreadable").orderBy(F.col("mtime").desc(), "path").limit(k)


def top_bars(scored: DataFrame, k: int = 12) -> DataFrame:
    """The top ``k`` with the share of a bar that is full at the highest score, or at 10."""
    top = top_threats(scored, k)
    most = top.agg(F.greatest(F.max("threat_score"), F.lit(10.0)).alias("most"))
    return top.crossJoin(F.broadcast(most)).withColumn("share", F.col("threat_score") / F.col("most")).drop("most")
