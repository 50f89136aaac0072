"""URL filters: rules first, then a ratio of two character language models.

URLs that a rule allows or blocks train one smoothed Markov model each, of variable order: the
estimate for a character mixes those after the last five, four, three, two, one and no characters,
each weighed by how often its context was seen and how many characters followed it (Witten-Bell).
The verdict on other URLs is the difference of the two log-likelihoods per character, held against
a threshold that separates labelled URLs best which did not train the models. All of it is
DataFrame code; the models are tables of exact counts by context and character, which grow with the URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch

# The characters that URLs are written in; upper case counts as lower, all others as one more sign.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=%"
SIGNS = 64
MOST = 5  # the highest order
HOT = 2000  # a run of characters with more than one in so many of all places is joined by broadcast
#: (verdict, host and path); the longest that fits decides.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def sign_codes(url: Column) -> Column:
    """The URL's characters as numbers from 0 (any other) to 59."""
    table = [ALPHABET.find(chr(c).lower()) + 1 if c < 127 else 0 for c in range(128)]
    chars = F.filter(F.split(F.coalesce(url, F.lit("")), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.get(F.array(*map(F.lit, table)), F.least(F.ascii(c), F.lit(127))))


def _places(urls: DataFrame, *keys: str) -> DataFrame:
    """A row per character: gram, which holds its code in the lowest digit of base 64 and those of the MOST before it above."""
    at = lambda i, back: F.coalesce(F.get("codes", i - back), F.lit(0)).cast("long") * F.lit(SIGNS**back)
    steps = F.transform(F.sequence(F.lit(0), F.size("codes") - 1), lambda i: sum((at(i, back) for back in range(1, MOST + 1)), at(i, 0)))
    return urls.where(F.size("codes") > 0).select(*keys, F.explode(steps).alias("gram"))


def _model(urls: DataFrame, work: Scratch) -> DataFrame:
    """(gram, n, score) of every gram: how many places of distinct URLs have it, and its log-likelihood
    under the allowed model less that under the blocked one.

    ``urls`` has a row per distinct URL with the rows that train each class, a and r. The counts of each
    order are those of the order above by all but the first character, and each order's estimates
    mix with those below by a join on the whole gram, so no key has more than 64 rows.
    """
    grams = _places(urls.withColumn("n", F.lit(1)), "n", "a", "r").groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n", "a", "r")))
    levels = [work.table(f"order-{MOST}", grams)]
    for k in range(MOST - 1, -1, -1):
        shorter = levels[0].select(F.pmod("gram", F.lit(SIGNS ** (k + 1))).alias("gram"), "n", "a", "r").groupBy("gram")
        levels.insert(0, work.table(f"order-{k}", shorter.agg(*(F.sum(c).alias(c) for c in ("n", "a", "r")))))
    below = None
    for k, level in enumerate(levels):
        context = F.floor(F.col("gram") / SIGNS).cast("long")
        sums = level.groupBy(context.alias("context")).agg(*(x for c in ("a", "r") for x in (F.sum(c).alias("t" + c), (F.count_if(F.col(c) > 0) + F.lit(0.5)).alias("w" + c))))
        rows = level.withColumn("context", context).join(sums, "context")
        if below is None:
            rows = rows.withColumn("qa", F.lit(1.0 / SIGNS)).withColumn("qr", F.lit(1.0 / SIGNS))
        else:
            rows = rows.join(below, F.pmod("gram", F.lit(SIGNS**k)) == F.col("_gram"))
        mixed = (((F.col(c) + F.col("w" + c) * F.col("q" + c)) / (F.col("t" + c) + F.col("w" + c))).alias("p" + c) for c in ("a", "r"))
        done = work.table(f"estimates-{k}", rows.select("gram", "n", *mixed))
        below = done.select(F.col("gram").alias("_gram"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
    return done.select("gram", "n", (F.log("pa") - F.log("pr")).alias("score"))


def _scores(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(key, score): the mean of the scores of each URL's places."""
    total = model.agg(F.sum("n").alias("n")).first()["n"] or 0
    common = F.broadcast(model.where(F.col("n") * HOT > total).select(F.col("gram").alias("_gram"), F.col("score").alias("score")))  # HOT rows at the most
    places = _places(urls.select("key", "codes"), "key").join(common, F.col("gram") == F.col("_gram"), "left")
    rare = places.where("_gram is null").select("key", "gram").join(model.where(F.col("n") * HOT <= total).select("gram", "score"), "gram")
    both = places.where("_gram is not null").select("key", "score").unionByName(rare.select("key", "score"))
    return both.groupBy("key").agg(F.avg("score").alias("score"))


def judge_urls(
    spark: SparkSession,
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: list[tuple[str, str]] = RULES,
    held_out: int = 5,
) -> DataFrame:
    """One row per row of ``pages``: ``id_col``, host, path, rule (null if none fits), verdict
    (allow or block), score (log-likelihood difference per character), threshold.

    Every URL with a rule is labelled; one in ``held_out`` of the labelled ones, by its hash, finds
    the threshold and the others train. Where one label is missing the threshold is 0. A null or
    empty URL scores 0. The models read A-Z as a-z and all signs that URLs are not written in as one, which
    also stands for the places before a URL's first character; contexts are exact up to order 5. The threshold is the
    hundredth at which the shares of held-out allowed URLs below it and of blocked ones not below it are least in sum. Repeated rows count as often as they occur and give repeated rows. Other
    columns are ignored; no rows give no rows.
    """
    work = Scratch(spark, "url-filter")
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    urls = urls.withColumn("key", F.unhex(F.md5(F.coalesce("_url", F.lit("")).cast("binary"))))
    allowed = F.when(F.col("fit").isNotNull(), F.col("fit.verdict") == "allow")
    held = F.pmod(F.xxhash64("_url"), F.lit(held_out)) == 0
    distinct = urls.groupBy("key").agg(F.count("*").alias("n"), F.min("_url").alias("_url"), F.min(allowed).alias("allowed"))
    distinct = distinct.select("key", "n", "allowed", (F.col("allowed").isNotNull() & held).alias("held"), sign_codes(F.col("_url")).alias("codes"))
    trains = lambda label: F.when(F.col("allowed").eqNullSafe(label) & ~F.col("held"), F.col("n")).otherwise(0)
    distinct = work.table("distinct", distinct.withColumn("a", trains(True)).withColumn("r", trains(False)))

    # counts of held-out scores in bins of a hundredth, from -10 to 10
    scores = work.table("scores", _scores(distinct, _model(distinct, work)))
    tried = distinct.where("held").select("allowed", "n", "key").join(scores, "key")
    bins = tried.select("allowed", "n", F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") * 100))).alias("bin"))
    per_bin = bins.groupBy("bin").agg(F.sum(F.when(F.col("allowed"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("allowed"), F.col("n")).otherwise(0)).alias("r"))
    below, all_rows = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    error = F.coalesce(F.sum("a").over(below), F.lit(0)) / F.sum("a").over(all_rows) + 1 - F.coalesce(F.sum("r").over(below), F.lit(0)) / F.sum("r").over(all_rows)
    best = per_bin.select("bin", error.alias("error")).where("error is not null").agg(F.min(F.struct("error", "bin"))["bin"].alias("bin"))
    threshold = work.table("threshold", best.select(F.coalesce(F.col("bin") / 100, F.lit(0.0)).alias("threshold")))

    judged = urls.drop("_url").join(scores, "key", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("threshold", threshold.scalar())
    guess = F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    return judged.select(id_col, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", guess).alias("verdict"), "score", "threshold")
