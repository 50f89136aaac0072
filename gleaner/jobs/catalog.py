"""The registered queries of the triage jobs, with their SQL.

The given tables hold no script files, so both engines derive a table of files from ``documents``
by the same expressions; see ``files_view``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import needles as N
from gleaner.functions.text import base_name, extension, json_leaf_paths, short_label, tokens, variant_leaf_paths
from gleaner.operators import analysis, dashboard, hash_store, hashes, moments, order_stats, report, selection
from gleaner.sources import files as sources
from gleaner.sources import tree
from gleaner.sources.tables import move_files, shared_folder, spread, written
from gleaner.streaming import stateful
from gleaner.streaming.incremental import read_chunks, scan_in_chunks

SNIPPETS = """case length(text) % 8
  when 0 then 'eval(base64_decode($_POST[1]));' when 1 then 'move_uploaded_file($_FILES[1], 2); system(3);'
  when 2 then 'include 5; echo substr(1,2);' when 3 then 'echo 1;'
  when 4 then 'SYSTEM(gzinflate($password)); file_put_contents(1);'
  when 5 then 'substr(implode(strtr(basename(getcwd(pathinfo(getenv(fopen(copy(mail(ini_set(1)))))))))));'
  else 'return 0;' end"""
FILES_SQL = f"""select doc_id,
  concat('/srv/www/', source, '/', case doc_id % 5 when 0 then 'uploads' when 1 then 'cache' when 2 then 'lib' when 3 then 'images' else 'app' end,
    '/f', cast(doc_id as {{S}}), case doc_id % 6 when 0 then '.php' when 1 then '.phtml' when 2 then '.inc' when 3 then '.PHP' when 4 then '.txt' else '/.htaccess' end) as path,
  1700000000 + (doc_id * 7919) % 2592000 as mtime,
  concat('<?php ', {SNIPPETS}, ' ?> ', text) as source_text, doc_id % 29 <> 0 as is_readable
from documents"""


def files_view(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """(doc_id, path, mtime, size, content, is_readable, source_text): a file for every document; ``dealt`` over all
    tasks where the table has too few row groups for them."""
    sql = FILES_SQL.format(S="string").replace("from documents", "from {docs}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    rows = spark.sql(sql, docs=spread(docs) if dealt else docs)
    content = F.when(F.col("is_readable"), F.col("source_text"))
    return rows.withColumn("content", content).withColumn("size", F.octet_length(content).cast("long"))


def _list(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    return files_view(spark, sf_dir).where(F.col("doc_id") % every == 0).select(F.md5(F.col("source_text").cast("binary")).alias("md5")).distinct()


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _lists_of(files_view(spark, sf_dir))


def _lists_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both lists from one written table, so that the documents are hashed once for them."""
    some = files.where("doc_id % 17 = 0 or doc_id % 23 = 0")
    kept = written(some.select("doc_id", F.md5(F.col("source_text").cast("binary")).alias("md5")), "lists")
    return tuple(kept.where(F.col("doc_id") % n == 0).select("md5").distinct() for n in (17, 23))


def _features(spark: SparkSession, sf_dir: str, **how: object) -> DataFrame:
    return analysis.features(files_view(spark, sf_dir, dealt=True), *_lists(spark, sf_dir), **how)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.analyse(_features(spark, sf_dir))


def _readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = selection.filter_patterns(files_view(spark, sf_dir)).where("is_readable")
    return kept.withColumn("md5", F.md5(F.col("content").cast("binary")))


# -- SQL of the shared steps ------------------------------------------------------------------

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _low(x: str) -> str:
    return f"translate({x}, {AZ})"


WORDS = r"[$]?[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^ \t\n\x0B\f\rA-Za-z0-9_]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
EXT = r"regexp_extract(path, '[.]([^./]*)$', 1)"
PATTERN = "(?i)^(" + "|".join(N.PATTERNS) + ")$"
WORD_TOKENS = rf"""list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(content, '{CONTROL}', '', 'g'), '<\?([^=A-Za-z0-9_])', '<?php ', 'g'), '{WORDS}'), lambda x: trim(x)), lambda x: x <> '' and x <> '0'))"""
TOKEN_ENTROPY = "case when length(j) = 0 then 0.0 else coalesce(list_sum(list_transform(chars, lambda c: -(length(j) - length(replace(j, c, ''))) / length(j) * log2((length(j) - length(replace(j, c, ''))) / length(j)))), 0.0) end"
BYTE_ENTROPY = "case when strlen(content) = 0 then 0.0 else list_sum(list_transform(map_values(list_histogram(list_transform(range(strlen(content)), lambda i: substr(hex(encode(content)), 2 * i + 1, 2)))), lambda n: -(n / strlen(content)) * log2(n / strlen(content)))) end"
_COMMON = {
    "base": FILES_SQL.format(S="varchar"),
    "files": "select doc_id, path, mtime, is_readable, source_text, case when is_readable then source_text end as content, case when is_readable then strlen(source_text) end as size from base",
    "white": "select distinct md5(source_text) as md5 from base where doc_id % 17 = 0",
    "black": "select distinct md5(source_text) as md5 from base where doc_id % 23 = 0",
    "kept": f"select *, {EXT} as ext from files where regexp_matches({EXT}, '{PATTERN}')",
    "readable": "select *, md5(content) as md5 from kept where is_readable",
    "known": "select * from readable where md5 not in (select md5 from white)",
}


def _steps(tokens: str = WORD_TOKENS, needles: list[tuple[str, float | None]] = N.WEB, categories: N.Categories = N.CATEGORIES, entropy: str = TOKEN_ENTROPY) -> dict[str, str]:
    weights = "map {" + ", ".join(f"'{t}': {w}" for t, w in needles) + "}"
    critical, obfuscation, upload = map(_sql_list, categories)
    return _COMMON | {
    "tokened": f"select *, {tokens} as tokens from known",
    "lowered": f"select *, list_transform(tokens, lambda t: {_low('t')}) as low_tokens from tokened",
    "matched": f"select *, list_filter({_sql_list([t for t, _ in needles])}, lambda n: list_contains(low_tokens, {_low('n')})) as matched_tokens from lowered",
    "joined": "select *, array_to_string(matched_tokens, '') as j, list_filter(list_distinct(string_split(array_to_string(matched_tokens, ''), '')), lambda c: c <> '') as chars from matched",
    "measured": f"select *, {entropy} as entropy from joined",
    "features": """select path, cast(size as bigint) as size, mtime, cast(len(tokens) as bigint) as total_tokens, matched_tokens, md5, md5 in (select md5 from black) as is_blacklisted,
      ext = 'htaccess' as is_htaccess, case when first_value(path) over w <> path then first_value(path) over w end as duplicate_of, cast(null as varchar) as error, false as is_unreadable, entropy
    from measured window w as (partition by md5 order by mtime desc, path)
    union all select path, null, mtime, null, ['NOT_READABLE'], 'N/A', false, false, null, null, true, 0.0 from kept where not is_readable""",
    "counted": "select *, case when is_unreadable then 0 else cast(len(matched_tokens) as bigint) end as susp_count from features",
    "stats": """select coalesce(avg(size), 0) as size_mean, coalesce(stddev_pop(size), 0) as size_std, coalesce(avg(mtime), 0) as mtime_mean, coalesce(stddev_pop(mtime), 0) as mtime_std,
      coalesce(avg(total_tokens), 0) as tokens_mean, coalesce(stddev_pop(total_tokens), 0) as tokens_std, coalesce(avg(susp_count), 0) as susp_mean, coalesce(stddev_pop(susp_count), 0) as susp_std,
      coalesce(avg(entropy), 0) as entropy_mean, coalesce(stddev_pop(entropy), 0) as entropy_std, coalesce(avg(susp_count), 0) / greatest(1.0, coalesce(avg(total_tokens), 0)) as ratio
    from counted where not is_unreadable""",
    "weighed": f"select *, list_transform(matched_tokens, lambda t: {_low('t')}) as low, coalesce(list_sum(list_transform(matched_tokens, lambda t: coalesce({weights}[{_low('t')}], 1.0))), 0.0) as base_score from counted",
    "times": f"select *, base_score * case when list_has_any(low, {critical}) and list_has_any(low, {obfuscation}) then 2.5 else 1 end * case when list_has_any(low, {critical}) and list_has_any(low, {upload}) then 1.8 else 1 end as s1 from weighed",
    "placed": f"select *, s1 + case when regexp_matches({_low('path')}, '{'|'.join(N.UPLOAD_PLACES)}') and (s1 > 0 or entropy > 5.5) then 5 else 0 end as s2 from times",
    "bonus": "select *, round(cast(s2 + case when size is not null and size < 20480 and entropy > 5.8 then 3 else 0 end as double), 2) as s3 from placed",
    "zs": """select *, case when is_unreadable then 0.0 when is_blacklisted then greatest(s3, 100.0) else s3 end as threat_score,
      case when is_unreadable or size_std = 0 then 0.0 else (size - size_mean) / size_std end as z_size, case when is_unreadable or mtime_std = 0 then 0.0 else (mtime - mtime_mean) / mtime_std end as z_mtime,
      case when is_unreadable or tokens_std = 0 then 0.0 else (total_tokens - tokens_mean) / tokens_std end as z_tokens, case when is_unreadable or susp_std = 0 then 0.0 else (susp_count - susp_mean) / susp_std end as z_susp,
      case when is_unreadable or entropy_std = 0 then 0.0 else (entropy - entropy_mean) / entropy_std end as z_entropy, case when is_unreadable then 0.0 else susp_count - total_tokens * ratio end as residual
    from bonus, stats""",
    "scored": """select *, is_unreadable or threat_score >= 8 or abs(z_size) > 3.5 or abs(z_susp) > 3.5 or abs(z_entropy) > 3.5 or abs(z_mtime) > 3.5 or residual > 5 or is_blacklisted or is_htaccess or duplicate_of is not null as is_anomaly,
      case when mtime = 0 then 'N/A' else strftime(make_timestamp(mtime * 1000000), '%d/%m/%Y, %H:%M:%S') end as date from zs""",
    }


STEPS = _steps()


def _with(last: str, select: str, steps: dict[str, str] = STEPS) -> str:
    names = list(steps)
    return "with " + ",\n".join(f"{n} as materialized ({steps[n]})" for n in names[: names.index(last) + 1]) + "\n" + select


def _r(name: str) -> F.Column:
    return F.round(F.col(name).cast("double"), 6).alias(name.split(".")[-1])


CATALOG: list[tuple[str, Callable[[SparkSession, str], DataFrame], str]] = []


def _add(name: str, sql: str | None):  # noqa: ANN202
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        CATALOG.append((name, f, sql))
        return f

    return register


@_add("hash_list", _with("files", f"select path, md5(content) as md5 from files where {EXT} = 'php' and is_readable"))
def hash_list(s: SparkSession, d: str) -> DataFrame:
    return hashes.build_hash_list(files_view(s, d).where("is_readable"))


@_add("pattern_filter", _with("kept", "select path, ext, ext = 'htaccess' as is_htaccess from kept"))
def pattern_filter(s: SparkSession, d: str) -> DataFrame:
    return selection.filter_patterns(files_view(s, d)).select("path", extension(F.col("path")).alias("ext"), selection.is_htaccess(F.col("path")).alias("is_htaccess"))


@_add("extension_filter", _with("files", f"select path from files where {EXT} in ('php', 'inc')"))
def extension_filter(s: SparkSession, d: str) -> DataFrame:
    return selection.filter_extensions(files_view(s, d), ["php", "inc"]).select("path")


@_add("url_extensions", r"select page_id, regexp_extract(url, '[.]([^./]*)$', 1) as ext, case when length(split_part(url, '/', -1)) > 26 then concat(substr(split_part(url, '/', -1), 1, 23), '...') else split_part(url, '/', -1) end as label from pages")
def url_extensions(s: SparkSession, d: str) -> DataFrame:
    pages = s.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", extension(F.col("url")).alias("ext"), short_label(base_name(F.col("url"))).alias("label"))


@_add("whitelist_dropped", _with("known", "select path, md5 from known"))
def whitelist_dropped(s: SparkSession, d: str) -> DataFrame:
    return hashes.drop_whitelisted(_readable(s, d), _list(s, d, 17)).select("path", "md5")


@_add("blacklist_flagged", _with("readable", "select path, md5, md5 in (select md5 from black) as is_blacklisted from readable"))
def blacklist_flagged(s: SparkSession, d: str) -> DataFrame:
    return hashes.flag_blacklisted(_readable(s, d).select("path", "md5"), _list(s, d, 23))


@_add("hash_conflicts", _with("black", "select md5 from white intersect select md5 from black"))
def hash_conflicts(s: SparkSession, d: str) -> DataFrame:
    return hashes.hash_conflicts(_list(s, d, 17), _list(s, d, 23))


@_add("hash_list_difference", _with("black", "select md5 from white except select md5 from black"))
def hash_list_difference(s: SparkSession, d: str) -> DataFrame:
    return _list(s, d, 17).subtract(_list(s, d, 23))


@_add("hash_list_deduped", _with("base", "select md5(source_text) as md5, min(doc_id) as line_no from base group by 1"))
def hash_list_deduped(s: SparkSession, d: str) -> DataFrame:
    return hashes.dedupe_hashes(files_view(s, d).select(F.col("doc_id").alias("line_no"), F.md5(F.col("source_text").cast("binary")).alias("md5")))


@_add("duplicate_groups", _with("known", "select md5, count(*) as copies, first(path order by mtime desc, path) as first_path from known group by md5 having count(*) > 1"))
def duplicate_groups(s: SparkSession, d: str) -> DataFrame:
    return hashes.duplicate_groups(hashes.drop_whitelisted(_readable(s, d).select("path", "mtime", "md5"), _list(s, d, 17)))


@_add("token_counts", _with("tokened", "select path, cast(len(tokens) as bigint) as total_tokens from tokened"))
def token_counts(s: SparkSession, d: str) -> DataFrame:
    rows = hashes.drop_whitelisted(_readable(s, d), _list(s, d, 17))
    return rows.select("path", F.size(tokens(F.col("content"))).cast("long").alias("total_tokens"))


@_add("needles_matched", _with("matched", "select path, array_to_string(matched_tokens, '|') as matched from matched"))
def needles_matched(s: SparkSession, d: str) -> DataFrame:
    rows = hashes.drop_whitelisted(_readable(s, d), _list(s, d, 17))
    return rows.select("path", F.array_join(selection.match_needles(tokens(F.col("content")), N.WEB), "|").alias("matched"))


_WANTED = _sql_list(list(dict.fromkeys(t.lower() for t, _ in N.CLI)))


@_add("needles_matched_by_token", _with("tokened", f"select path, array_to_string(list_sort(list_filter(tokens, lambda t: list_contains({_WANTED}, {_low('t')}))), '|') as matched from tokened"))
def needles_matched_by_token(s: SparkSession, d: str) -> DataFrame:
    rows = hashes.drop_whitelisted(_readable(s, d), _list(s, d, 17))
    return rows.select("path", F.array_join(F.sort_array(selection.match_needles(tokens(F.col("content")), N.CLI, "token")), "|").alias("matched"))


@_add("features", _with("features", "select path, size, mtime, total_tokens, array_to_string(matched_tokens, '|') as matched, md5, is_blacklisted, is_htaccess, duplicate_of, is_unreadable, round(entropy, 6) as entropy from features"))
def features(s: SparkSession, d: str) -> DataFrame:
    return _features(s, d).select("path", "size", "mtime", "total_tokens", F.array_join("matched_tokens", "|").alias("matched"), "md5", "is_blacklisted", "is_htaccess", "duplicate_of", "is_unreadable", _r("entropy"))


_STATS = [f"{n}_{k}" for n in analysis.STATS for k in ("mean", "std")] + ["ratio"]


@_add("corpus_stats", _with("stats", "select " + ", ".join(f"round(cast({c} as double), 6) as {c}" for c in _STATS) + " from stats"))
def corpus_stats(s: SparkSession, d: str) -> DataFrame:
    return analysis.corpus_stats(_features(s, d)).select(*map(_r, _STATS))


_SCORED = "path, threat_score, susp_count, round(z_size, 6) as z_size, round(z_mtime, 6) as z_mtime, round(z_tokens, 6) as z_tokens, round(z_susp, 6) as z_susp, round(z_entropy, 6) as z_entropy, round(residual, 6) as residual, is_anomaly, date"


def _flat(scored: DataFrame) -> DataFrame:
    zs = [F.round(F.col(f"z.{n}"), 6).alias(f"z_{n}") for n in analysis.STATS]
    return scored.select("path", "threat_score", "susp_count", *zs, _r("residual"), "is_anomaly", "date")


@_add("scored", _with("scored", f"select {_SCORED} from scored"))
def scored(s: SparkSession, d: str) -> DataFrame:
    return _flat(_scored(s, d))


MODES = ["anomalies", "critical", "obfuscated", "blacklisted"]


@_add("selections", _with("scored", """select 'anomalies' as mode, path from scored where is_anomaly union all select 'critical', path from scored where threat_score >= 10 or is_blacklisted
union all select 'obfuscated', path from scored where entropy >= 5.8 and not is_unreadable union all select 'blacklisted', path from scored where is_blacklisted
union all select 'time', path from scored where mtime <> 0 and mtime between 1700500000 and 1701000000
union all select 'search', path from scored where contains(lower(path), 'cache') or len(list_filter(matched_tokens, lambda t: contains(lower(t), 'cache'))) > 0
union all select 'tokens', path from scored where len(list_filter(matched_tokens, lambda t: contains(lower(t), 'eval'))) > 0"""))
def selections(s: SparkSession, d: str) -> DataFrame:
    rows = written(_scored(s, d), "scored")
    parts = [selection.select_rows(rows, m).select(F.lit(m).alias("mode"), "path") for m in MODES]
    parts.append(selection.select_rows(rows, "time", low=1_700_500_000, high=1_701_000_000).select(F.lit("time").alias("mode"), "path"))
    parts += [selection.select_rows(rows, m, query=q).select(F.lit(m).alias("mode"), "path") for m, q in (("search", "Cache"), ("tokens", "eval"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


OUTCOME = "doc_id % 46 = 0"  # of the known bad files, those whose action failed
_FAILED = _with("scored", "").rstrip() + f", failed as (select distinct md5(source_text) as m from base where {OUTCOME}), told as (select scored.*, case when is_blacklisted and m is not null then 'permission denied' end as err from scored left join failed on m = md5)\n"


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    return files_view(s, d).where(OUTCOME).select(F.md5(F.col("source_text").cast("binary")).alias("md5"), F.lit("permission denied").alias("error"))


def _features_with_outcomes(s: SparkSession, d: str) -> DataFrame:
    return _features(s, d, outcomes=_outcomes(s, d))


@_add("warnings", _FAILED + "select 'action failed' as warning, path from told where err is not null union all select 'not readable', path from told where is_unreadable")
def warnings(s: SparkSession, d: str) -> DataFrame:
    return selection.warnings(_features_with_outcomes(s, d))


_SEVERITY = "case when is_unreadable then 'NOT READABLE' when is_blacklisted then 'BLACKLIST' when threat_score >= 15 then 'CRITICAL' when threat_score >= 8 then 'HIGH RISK' when is_htaccess then 'HTACCESS' when duplicate_of is not null then 'DUPLICATE' end"


@_add("labels", _FAILED + f"""select path, {_SEVERITY} as severity, case when {_SEVERITY} = 'DUPLICATE' then duplicate_of when {_SEVERITY} = 'BLACKLIST' and err is not null then err else array_to_string(matched_tokens, ', ') end as status,
  array_to_string(list_sort(list_filter(list_transform(matched_tokens, lambda t: {_low('t')}), lambda t: list_contains({_sql_list(N.ESSENTIAL)}, t))), '|') as essential from told""")
def labels(s: SparkSession, d: str) -> DataFrame:
    scored = analysis.analyse(_features_with_outcomes(s, d))
    return scored.select("path", selection.severity().alias("severity"), selection.status().alias("status"), F.array_join(F.sort_array(selection.essential_tokens()), "|").alias("essential"))


_RATIO = "case when total_tokens > 0 then susp_count / total_tokens else 0 end"


@_add("quadrants", _with("scored", f"select case when r >= 0.15 and threat_score >= 8 then 'OBFUSCATED WEBSHELL' when threat_score >= 8 then 'RCE SCRIPT' when r >= 0.15 then 'DENSE NORMAL' else 'BENIGN' end as quadrant, count(*) as n from (select *, {_RATIO} as r from scored where not is_unreadable) group by 1"))
def quadrants(s: SparkSession, d: str) -> DataFrame:
    return dashboard.quadrants(_scored(s, d))


@_add("bands", _with("scored", f"""select path, round({_RATIO}, 6) as ratio, case when threat_score >= 10 then 'high' when threat_score >= 5 then 'medium' else 'low' end as score_band,
  case when threat_score >= 15 then 'critical' when threat_score >= 8 then 'high' when entropy > 5.8 then 'dense' else 'normal' end as entropy_band from scored"""))
def bands(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).select("path", F.round(dashboard.suspicious_ratio(), 6).alias("ratio"), dashboard.score_band(F.col("threat_score")).alias("score_band"), dashboard.entropy_band().alias("entropy_band"))


@_add("top_threats", _with("scored", "select path, split_part(path, '/', -1) as base_name, threat_score, susp_count from scored where not is_unreadable order by threat_score desc, mtime desc, path limit 5"))
def top_threats(s: SparkSession, d: str) -> DataFrame:
    return selection.top_threats(_scored(s, d)).select("path", base_name(F.col("path")).alias("base_name"), "threat_score", "susp_count")


@_add("top_recent", _with("scored", "select path, mtime, size from scored where not is_unreadable order by mtime desc, path limit 5"))
def top_recent(s: SparkSession, d: str) -> DataFrame:
    return selection.top_recent(_scored(s, d)).select("path", "mtime", "size")


@_add("top_bars", _with("scored", "select path, threat_score, round(threat_score / greatest(10.0, max(threat_score) over ()), 6) as share from (select * from scored where not is_unreadable order by threat_score desc, mtime desc, path limit 12)"))
def top_bars(s: SparkSession, d: str) -> DataFrame:
    return selection.top_bars(_scored(s, d)).select("path", "threat_score", _r("share"))


@_add("sorted_by_residual", _with("scored", "select path, round(residual, 6) as residual from scored order by coalesce(residual, 0) desc, mtime desc, path"))
def sorted_by_residual(s: SparkSession, d: str) -> DataFrame:
    return selection.sort_rows(_scored(s, d), "residual").select("path", _r("residual"))


_PLACES = {"threat": "threat_score", "mtime": "mtime", "tokens": "total_tokens", "susp": "round(abs(z_susp), 9)", "residual": "round(residual, 9)"}
_LISTED = "is_unreadable, case when is_unreadable then 0 else mtime end desc, path"


@_add("result_orders", _with("scored", " union all ".join(f"select '{m}' as mode, path, row_number() over (order by coalesce({k}, 0) desc, {_LISTED}) - 1 as place from scored" for m, k in _PLACES.items())))
def result_orders(s: SparkSession, d: str) -> DataFrame:
    rows = _scored(s, d).withColumn("residual", F.round("residual", 9)).withColumn("z", F.col("z").withField("susp", F.round("z.susp", 9)))
    rows = written(rows.select("path", "is_unreadable", "mtime", "threat_score", "total_tokens", "residual", "z"), "orders")
    parts = [dashboard.ranked_rows(rows, m).select(F.lit(m).alias("mode"), "path", "place") for m in selection.SORT_MODES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@_add("listing", _with("features", f"select path, row_number() over (order by {_LISTED}) - 1 as place from features"))
def listing(s: SparkSession, d: str) -> DataFrame:
    return dashboard.numbered(_features(s, d).select("path", "mtime", "is_unreadable"), selection.listing_order()).select("path", "place")


_SIZED = "filter (where not is_unreadable and size is not null)"


@_add("insights", _with("scored", f"""select count(*) as total, count(*) filter (where not is_unreadable) as readable, count(*) filter (where is_unreadable) as unreadable, count(*) filter (where is_blacklisted) as blacklisted,
  count(duplicate_of) as duplicates, count(*) filter (where is_htaccess) as htaccess, count(*) filter (where is_anomaly) as anomalies, count(*) filter (where threat_score >= 10 or is_blacklisted) as critical,
  round(coalesce(avg(size) {_SIZED}, 0), 6) as avg_size, coalesce(min(size) {_SIZED}, 0) as min_size, coalesce(max(size) {_SIZED}, 0) as max_size,
  round(coalesce(avg(total_tokens) {_SIZED}, 0), 6) as avg_tokens, coalesce(min(total_tokens) {_SIZED}, 0) as min_tokens, coalesce(max(total_tokens) {_SIZED}, 0) as max_tokens,
  coalesce(min(mtime) {_SIZED}, 0) as min_mtime, coalesce(max(mtime) {_SIZED}, 0) as max_mtime from scored"""))
def insights(s: SparkSession, d: str) -> DataFrame:
    return dashboard.insights(_scored(s, d)).withColumn("avg_size", _r("avg_size")).withColumn("avg_tokens", _r("avg_tokens"))


def _timeline_sql(source: str, t: str, score: str) -> str:
    return f"""timed as (select {t} as t, cast({score} as double) as s from {source} where {t} > 0), ends as (select min(t) as first, greatest(1, max(t) - min(t)) as span from timed),
counts as (select least(19, cast(floor((t - first) / (span / 20)) as integer)) as bucket, count(*) as n, greatest(max(s), 0.0) as m from timed, ends group by 1),
filled as (select cast(b.range as integer) as bucket, first + b.range * span / 20 as start, coalesce(n, 0) as n, coalesce(m, 0.0) as max_threat from range(20) b cross join ends left join counts on bucket = b.range)
select bucket, round(cast(start as double), 6) as start, n, round(max_threat, 6) as max_threat, case when max_threat >= 10 then 'high' when max_threat >= 5 then 'medium' else 'low' end as band, round(n / greatest(1, max(n) over ()), 6) as height from filled"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("bucket", _r("start"), "n", _r("max_threat"), "band", _r("height"))


@_add("timeline", _with("scored", "").rstrip() + ", " + _timeline_sql("scored", "mtime", "threat_score"))
def timeline(s: SparkSession, d: str) -> DataFrame:
    return _rounded(dashboard.timeline(_scored(s, d)))


@_add("event_timeline", "with " + _timeline_sql("events", "cast(floor(epoch(ts)) as bigint)", "value"))
def event_timeline(s: SparkSession, d: str) -> DataFrame:
    events = s.read.parquet(f"{d}/events.parquet").select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("mtime"), F.col("value").alias("threat_score"))
    return _rounded(dashboard.timeline(events))


def _order_sql(source: str, col: str) -> str:
    return f"""select q, round(coalesce((select v from (select {col} as v, row_number() over (order by {col}) - 1 as i from {source}) where i = floor((select count({col}) from {source}) * q)), 0), 6) as value
from (values (0.25::double), (0.5::double), (0.75::double)) t(q)"""


@_add("entropy_percentiles", _with("scored", "").rstrip() + ", valid as (select entropy from scored where not is_unreadable) " + _order_sql("valid", "entropy"))
def entropy_percentiles(s: SparkSession, d: str) -> DataFrame:
    return dashboard.order_stats(_scored(s, d).where("not is_unreadable")).select("q", _r("value"))


@_add("event_percentiles", _order_sql("events", "value"))
def event_percentiles(s: SparkSession, d: str) -> DataFrame:
    return dashboard.order_stats(s.read.parquet(f"{d}/events.parquet"), "value").select("q", _r("value"))


@_add("entropy_rank", _with("scored", "select path, round((row_number() over (order by round(entropy, 9), mtime desc, path) - 1) / greatest(1, count(*) over () - 1), 6) as rank from scored where not is_unreadable"))
def entropy_rank(s: SparkSession, d: str) -> DataFrame:
    return dashboard.entropy_rank(_scored(s, d).withColumn("entropy", F.round("entropy", 9))).select("path", _r("rank"))


_CLASS = "case when is_unreadable then 'NOT_READABLE' when is_blacklisted then 'BLACKLIST' when is_htaccess then 'HTACCESS' when duplicate_of is not null then duplicate_of when len(matched_tokens) > 0 then array_to_string(matched_tokens, ', ') end"


def _one(x: str) -> str:
    """SQL of a number with one decimal, halves away from zero."""
    tenths = f"cast(floor(abs({x}) * 10 + 0.5) as bigint)"
    return f"concat(case when {x} < 0 and {tenths} > 0 then '-' else '' end, {tenths} // 10, '.', {tenths} % 10)"


@_add("report_lines", _with("scored", f"""select path, concat(path, coalesce(' (' || ({_CLASS}) || ')', ''), case when not is_unreadable and size is not null then
  concat(' | ', date, ' | Size: ', {_one("(size / 1024)")}, ' KB | ThreatScore: ', {_one("threat_score")}, ' | Tokens: ', total_tokens, ' | Suspicious: ', susp_count, ' | Z-Susp: ', {_one("round(z_susp, 9)")}, ' | MD5: ', md5) else concat(' | ', date) end) as line from scored"""))
def report_lines(s: SparkSession, d: str) -> DataFrame:
    # the engines' sums differ in the last digits, which a decimal must not depend on
    return report.report_lines(_scored(s, d).withColumn("z", F.col("z").withField("susp", F.round("z.susp", 9))))


_REPLIES = """replies as (select md5(source_text) as m, max(doc_id % 26) = 13 as named, max(doc_id % 3) > 0 as voted from base where doc_id % 13 = 0 group by 1)"""


def _replies(s: SparkSession, d: str) -> DataFrame:
    """Replies of both kinds, some of which recur, and one without data."""
    known = files_view(s, d).where("doc_id % 13 = 0").select("doc_id", F.md5(F.col("source_text").cast("binary")).alias("md5"))
    votes = known.select("md5", F.format_string('{"data":{"attributes":{"total_votes":{"malicious": %d}}}}', F.col("doc_id") % 3).alias("reply"))
    named = known.where("doc_id % 26 = 13").select("md5", F.lit('{"data":{"attributes":{"engines":[{"x":{"category":"Malicious"}}]}}}').alias("reply"))
    empty = known.select("md5", F.lit('{"error":{"code":"malicious"}}').alias("reply"))
    return votes.unionByName(named).unionByName(empty)


_VERDICT = "case when named then 'webshell' when voted then 'malicious' end"
_CLI = f"""{_REPLIES}, clikept as (select *, md5(content) as md5 from files where is_readable and regexp_matches(EXT, '(?i)^(ph.+|sh.+|inc)$')), cliknown as (select * from clikept where md5 not in (select md5 from white)),
rest as (select *, first_value(path) over (partition by md5 order by mtime desc, path) as first_path from cliknown where md5 not in (select md5 from black)),
told as (select *, {_VERDICT} as verdict from rest left join replies on m = md5 where first_path = path),
tokened as (select *, list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(content, '{CONTROL}', '', 'g'), '<\\?([^=A-Za-z0-9_])', '<?php ', 'g'), '{WORDS}'), lambda x: trim(x)), lambda x: list_contains({_WANTED}, {_low('x')})) as hits from told where verdict is null),
matched as (select *, list_filter(hits, lambda x, i: list_position(hits, x) = i) as shown from tokened)
""".replace("EXT", EXT)


@_add("cli_report", _with("black", "").rstrip() + ", " + _CLI + """select path, 'blacklist' as class, concat(path, ' (Blacklist)(', md5, ')') as line from cliknown where md5 in (select md5 from black)
union all select path, 'duplicate', concat(path, ' -> ', first_path, '(', md5, ')') from rest where first_path <> path
union all select path, verdict, concat('[!] ', path, case when verdict = 'webshell' then ' (VTotal Webshell) (' else ' (VTotal Malicious) (' end, md5, ')') from told where verdict is not null
union all select path, 'matched', concat(path, ' (', array_to_string(shown, ', '), ')') from matched where len(shown) > 0""")
def cli_report(s: SparkSession, d: str) -> DataFrame:
    return report.cli_report(files_view(s, d), _list(s, d, 17), _list(s, d, 23), _replies(s, d))


@_add("cli_matched", _with("black", "").rstrip() + ", " + _CLI.replace("replies as (select", "replies as (select * from (select").replace("group by 1)", "group by 1) where false)", 1) + "select path, 'matched' as class, concat(path, ' (', array_to_string(shown, ', '), ')') as line from matched where len(shown) > 0")
def cli_matched(s: SparkSession, d: str) -> DataFrame:
    return report.cli_report(files_view(s, d), _list(s, d, 17), _list(s, d, 23)).where("class = 'matched'")


@_add("quarantine", _with("known", "select path, md5, 'quarantine' as action, 'hash is blacklisted' as reason from known where md5 in (select md5 from black)"))
def quarantine(s: SparkSession, d: str) -> DataFrame:
    return report.quarantine_list(_features(s, d))


@_add("reputation", _with("readable", "").rstrip() + f", {_REPLIES} select path, md5, {_VERDICT} as verdict from readable left join replies on m = md5")
def reputation(s: SparkSession, d: str) -> DataFrame:
    return report.apply_reputation(_readable(s, d).select("path", "md5"), _replies(s, d))


@_add("json_leaves", "select event_id, case when lower(event_type) = 'click' then 'a[b[type]]|c[1]' else '' end as paths from events")
def json_leaves(s: SparkSession, d: str) -> DataFrame:
    events = s.read.parquet(f"{d}/events.parquet")
    kind = F.col("event_type")
    reply = F.concat(F.lit('{"a":{"b":{"type":"'), kind, F.lit('"}},"c":[1,"'), kind, F.lit('"],"props":'), F.col("props"), F.lit("}"))
    return events.select("event_id", F.array_join(json_leaf_paths(reply, "CLICK"), "|").alias("paths"))


@_add("blacklist_dropped", _with("readable", "").rstrip() + ", b as (" + STEPS["black"] + ") select path, md5, false as is_blacklisted from readable where md5 not in (select md5 from b)")
def blacklist_dropped(s: SparkSession, d: str) -> DataFrame:
    return hashes.flag_blacklisted(_readable(s, d).select("path", "md5"), _list(s, d, 23), drop=True)


@_add("needles_matched_by_join", _with("matched", "select path, array_to_string(matched_tokens, '|') as matched from matched where len(matched_tokens) > 0"))
def needles_matched_by_join(s: SparkSession, d: str) -> DataFrame:
    """Files are matched where they lie; only what matched meets the list."""
    rows = _readable(s, d).select(F.struct("path", "md5").alias("file"), tokens(F.col("content")).alias("tokens"))
    found = selection.match_needles_by_join(rows, sources.needle_table(s), "file").select("file.*", "matched_tokens")
    return hashes.drop_whitelisted(found, _list(s, d, 17)).select("path", F.array_join("matched_tokens", "|").alias("matched"))


# -- sources and sinks: what was written from the tables is read back -----------------------------


def _text_lines(s: SparkSession, d: str) -> str:
    """A folder of text files with a line for each document: its id and the hash of its text."""
    folder = shared_folder(s, "lines")
    files_view(s, d).select(F.concat_ws(" ", "doc_id", F.md5(F.col("source_text").cast("binary")))).write.text(folder)
    return folder


def _lines(files: DataFrame) -> DataFrame:
    lines = files.where("is_readable").select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")
    return lines.select(F.split_part("line", F.lit(" "), F.lit(1)).cast("long").alias("doc_id"), F.split_part("line", F.lit(" "), F.lit(2)).alias("md5"))


@_add("files_read", _with("base", "select doc_id, md5(source_text) as md5 from base"))
def files_read(s: SparkSession, d: str) -> DataFrame:
    return _lines(sources.read_files(s, _text_lines(s, d)))


@_add("manifest_read", _with("base", "select doc_id, md5(source_text) as md5 from base union all select -1, 'unreadable'"))
def manifest_read(s: SparkSession, d: str) -> DataFrame:
    """The same files by a manifest, which names one that is not there."""
    listed = sources.read_files(s, _text_lines(s, d)).select("path", "mtime")
    missing = s.range(1).select(F.lit("/nowhere/missing.php").alias("path"), F.lit(0).cast("long").alias("mtime"))
    files = written(sources.read_manifest(listed.unionByName(missing)), "manifest")
    return _lines(files).unionByName(files.where("not is_readable").select(F.lit(-1).cast("long").alias("doc_id"), F.lit("unreadable").alias("md5")))


TREE_LIMIT = 6000


@_add("tree_read", _with("base", f"""select path, {EXT} as ext, cast(strlen(source_text) as bigint) as size, strlen(source_text) <= {TREE_LIMIT} as is_readable,
  case when strlen(source_text) <= {TREE_LIMIT} then md5(source_text) end as md5, case when strlen(source_text) > {TREE_LIMIT} then 'too large' end as error
from base where regexp_matches({EXT}, '{PATTERN}') and strlen(source_text) >= 300"""))
def tree_read(s: SparkSession, d: str) -> DataFrame:
    """A real tree with names that begin with a dot; only scripts of some size are opened, those over the limit are not."""
    root = shared_folder(s, "tree")
    tree.write_tree(files_view(s, d).select("path", F.col("source_text").alias("content")), root)
    found = tree.read_tree(s, root, maxFileBytes=TREE_LIMIT).where("is_script and size >= 300")
    path = F.regexp_extract("path", "(/srv/www/.*)$", 1)
    return found.select(path.alias("path"), F.col("extension").alias("ext"), "size", "is_readable", F.md5("content").alias("md5"), "error")


@_add("hash_list_loaded", _with("base", "select distinct md5(source_text) as md5 from base"))
def hash_list_loaded(s: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(s, "hashes")
    files_view(s, d).select(F.concat(F.lit("  "), F.upper(F.md5(F.col("source_text").cast("binary"))), F.when(F.col("doc_id") % 2 == 0, " \r").otherwise(""))).write.text(folder)
    return sources.load_hashes(s, folder)


@_add("features_written", _with("features", "select path, size, array_to_string(matched_tokens, '|') as matched, md5, duplicate_of, is_unreadable, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d') as day from features"))
def features_written(s: SparkSession, d: str) -> DataFrame:
    feats, folder = _features(s, d), shared_folder(s, "written")
    report.write_features(feats, folder)
    back = s.read.schema(feats.schema.add("day", "date")).json(folder)
    return back.select("path", "size", F.array_join("matched_tokens", "|").alias("matched"), "md5", "duplicate_of", "is_unreadable", F.date_format("day", "yyyy-MM-dd").alias("day"))


# -- other token rules, needle tables and measures --------------------------------------------------

_LEXED = {
    0: "eval ( base64_decode $_POST [ 1 ] ) ;", 1: "move_uploaded_file ( $_FILES [ 1 ] , 2 ) ; system 3", 2: "include 5 ; echo substr ( 1 , 2 )", 3: "echo 1 ;",
    4: "SYSTEM ( gzinflate $password ) ; file_put_contents 1", 5: "substr ( implode strtr basename getcwd pathinfo getenv fopen copy mail ini_set 1 ) ;",
}
#: What the lexer finds in a file of the view: the snippet's tokens, and the text after the tags as one.
_LEXED_SQL = (
    "list_filter(list_concat(['<?php', '?>'], case cast(length(regexp_replace(content, '^<[?]php .*? [?]> ', '', 's')) % 8 as integer) "
    + " ".join(f"when {k} then {_sql_list(v.split())}" for k, v in _LEXED.items())
    + f" else ['return', ';'] end, [trim(regexp_replace(regexp_replace(content, '^<[?]php .*? [?]> ', '', 's'), '{CONTROL}', '', 'g'), ' \t\n\r\x0b')]), lambda x: x <> '' and x <> '0')"
)
_SCORE = "path, total_tokens, array_to_string(matched_tokens, '|') as matched, round(entropy, 6) as entropy, threat_score, is_anomaly"


def _short(scored: DataFrame) -> DataFrame:
    return scored.select("path", "total_tokens", F.array_join("matched_tokens", "|").alias("matched"), _r("entropy"), "threat_score", "is_anomaly")


@_add("scored_by_lexer", _with("scored", f"select {_SCORE} from scored", _steps(tokens=_LEXED_SQL)))
def scored_by_lexer(s: SparkSession, d: str) -> DataFrame:
    """The language's own lexical rules from tokens to score: words of the page text don't match."""
    return _short(analysis.analyse(_features(s, d, mode="lexer")))


# Sources whose strings hold code that holds strings, by the length of the text, and their tokens.
_NESTED = {
    0: ('echo "{$a["eval"]}";', 'echo " { $a [ "eval" ] } ;'), 1: ('eval("${b["x"]}");', 'eval ( " ${ b [ "x" ] } ) ;'),
    2: ('`{$c("system")}`; system(1);', '` { $c ( "system" ) } ; system 1'), 3: ("#[exec] function f() {}", "#[ exec ] function f ( ) { }"),
    4: ('\\system("$d[assert]");', '\\system ( " $d [ assert ] ) ;'),
    5: ('echo <<<E\n{$f->passthru("exec")} eval\nE;\nproc_open(2);', 'echo <<<E { $f -> passthru ( "exec" ) } eval E ; proc_open 2'),
}
_NESTED_CASE = "case length(text) % 6 " + " ".join(f"when {k} then '{v}'" for k, (v, _) in _NESTED.items()) + " end"
_NESTED_TOKENS = f"""list_filter(list_concat(['<?php'], case cast(length(body) % 6 as integer) {" ".join(f"when {k} then {_sql_list(v.split())}" for k, (_, v) in _NESTED.items())} end, ['?>', trim(regexp_replace(body, '{CONTROL}', '', 'g'), ' \t\n\r\x0b')]), lambda x: x <> '' and x <> '0')"""
_NESTED_STEPS = {
    k: v.replace(SNIPPETS, _NESTED_CASE).replace("as source_text\n", "as source_text, text as body\n").replace("is_readable\nfrom", "is_readable, text as body\nfrom") if k == "base" else v.replace("select doc_id, path, mtime, is_readable, source_text,", "select doc_id, path, mtime, is_readable, source_text, body,")
    for k, v in _steps(tokens=_NESTED_TOKENS).items()
}


@_add("scored_by_nested_lexer", _with("scored", f"select {_SCORE} from scored", _NESTED_STEPS))
def scored_by_nested_lexer(s: SparkSession, d: str) -> DataFrame:
    """Code in strings in code: what stands in quotes there doesn't match, what is code there does."""
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text")
    files = _nested_files(s, spread(docs))
    return _short(analysis.analyse(analysis.features(files, *_lists_of(_nested_files(s, docs)), mode="lexer")))


def _nested_files(s: SparkSession, docs: DataFrame) -> DataFrame:
    rows = s.sql(FILES_SQL.format(S="string").replace("is_readable\nfrom documents", "is_readable, text\nfrom {docs}"), docs=docs)
    snippet = F.element_at(F.array(*(F.lit(v) for v, _ in _NESTED.values())), (F.length("text") % 6 + 1).cast("int"))
    rows = rows.withColumn("source_text", F.concat(F.lit("<?php "), snippet, F.lit(" ?> "), F.col("text"))).drop("text")
    return rows.withColumn("content", F.when(F.col("is_readable"), F.col("source_text"))).withColumn("size", F.octet_length("content").cast("long"))


OWN_NEEDLES = [(0, "echo", 42.0, True, False, False), (1, "Return", 3.5, False, False, True), (2, "base64_decode", 7.0, False, True, False), (3, "getenv", None, False, False, False), (4, "eval", 1.5, True, False, False)]
_OWN = [(t, w) for _, t, w, *_ in OWN_NEEDLES]
_OWN_SQL = [(t, "null" if w is None else w) for t, w in _OWN]


@_add("scored_by_own_needles", _with("scored", f"select {_SCORE} from scored", _steps(needles=_OWN_SQL, categories=(["echo", "eval"], ["base64_decode"], ["return"]))))
def scored_by_own_needles(s: SparkSession, d: str) -> DataFrame:
    """A needle table of the user's, with weights and categories, from matching to score."""
    rows = [(i, t, None if w is None else Decimal(str(w)), *flags) for i, t, w, *flags in OWN_NEEDLES]
    needles, categories = sources.needle_lists(s.createDataFrame(rows, sources.NEEDLES))
    feats = _features(s, d, needles=needles)
    return _short(analysis.analyse(feats, needles=needles, categories=categories))


FINE_NEEDLES = [("echo", 0.125), ("return", 0.3125), ("base64_decode", 1.0078125), ("eval", 2.5078125), ("substr", 0.125), ("include", 0.0078125), ("copy", 0.125)]


@_add("scored_by_fine_weights", _with("scored", f"select {_SCORE} from scored", _steps(needles=FINE_NEEDLES)))
def scored_by_fine_weights(s: SparkSession, d: str) -> DataFrame:
    """Weights of up to seven decimals: sums keep them all, and the score is rounded once."""
    return _short(analysis.analyse(_features(s, d, needles=FINE_NEEDLES), needles=FINE_NEEDLES))


@_add("scored_by_needle_table", _with("scored", f"select {_SCORE} from scored"))
def scored_by_needle_table(s: SparkSession, d: str) -> DataFrame:
    """The needle table joined from matching to score, as one too long for literals is."""
    return _short(analysis.analyse(_features(s, d, table=sources.needle_table(s))))


_BY_SOURCE = STEPS["stats"].replace("select coalesce(avg(size)", "select split_part(path, '/', 4) as source, coalesce(avg(size)") + " group by 1"
_GROUPED = STEPS | {"stats": _BY_SOURCE, "zs": STEPS["zs"].replace("from bonus, stats", "from bonus left join stats on split_part(path, '/', 4) = source")}


@_add("scored_within_sources", _with("scored", f"select {_SCORED} from scored", _GROUPED))
def scored_within_sources(s: SparkSession, d: str) -> DataFrame:
    """Deviations from the files of the same source, not from the whole corpus."""
    feats = _features(s, d).withColumn("source", F.split_part("path", F.lit("/"), F.lit(4)))
    return _flat(analysis.analyse(feats, by=["source"]))


@_add("moments_merged", _with("stats", "select " + ", ".join(f"round(cast({c} as double), {4 if c.startswith('mtime') else 6}) as {c}" for c in _STATS) + " from stats"))
def moments_merged(s: SparkSession, d: str) -> DataFrame:
    """Corpus statistics from moments by day, merged by path part, then to one row."""
    feats = _features(s, d).withColumns({"day": F.floor(F.col("mtime") / 86400), "part": F.split_part("path", F.lit("/"), F.lit(4))})
    days = written(moments.moments(feats, ["day", "part"]), "moments")
    told = moments.stats(moments.merged(moments.merged(days, ["part"])))
    return told.select(*(F.round(c, 4 if c.startswith("mtime") else 6).alias(c) for c in _STATS))


@_add("lexer_tokens", None)
def lexer_tokens(s: SparkSession, d: str) -> DataFrame:
    rows = _readable(s, d).dropDuplicates(["md5"])
    return rows.select("md5", F.size(tokens(F.col("content"), "lexer")).alias("total_tokens"))


@_add("content_entropy", _with("scored", "select path, round(entropy, 6) as entropy, threat_score from scored", _steps(entropy=BYTE_ENTROPY)))
def content_entropy(s: SparkSession, d: str) -> DataFrame:
    feats = _features(s, d, entropy_source="content")
    return analysis.analyse(feats).select("path", _r("entropy"), "threat_score")


_DENSE = "concat('<?php echo \"', " + ", ".join(f"{{b}}(unhex({{h}}(concat({i}, {{t}}))))" for i in range(8)) + ", '\";')"
_DENSE_STEPS = {k: f"select doc_id, path, mtime, is_readable, {_DENSE.format(b='to_base64', h='sha256', t='source_text')} as source_text from ({v})" if k == "base" else v for k, v in _steps(entropy=BYTE_ENTROPY).items()}


@_add("dense_files", _with("scored", "select path, round(entropy, 6) as entropy, threat_score, is_anomaly, entropy >= 5.8 and not is_unreadable as obfuscated from scored", _DENSE_STEPS))
def dense_files(s: SparkSession, d: str) -> DataFrame:
    """Small files of dense content, for which the entropy rules hold."""
    source = F.concat(F.lit('<?php echo "'), *(F.base64(F.unhex(F.sha2(F.concat(F.lit(str(i)), "source_text"), 256))) for i in range(8)), F.lit('";'))
    files = files_view(s, d).withColumn("source_text", source).withColumn("content", F.when(F.col("is_readable"), F.col("source_text"))).withColumn("size", F.octet_length("content").cast("long"))
    lists = [files.where(F.col("doc_id") % n == 0).select(F.md5(F.col("source_text").cast("binary")).alias("md5")).distinct() for n in (17, 23)]
    scored = written(analysis.analyse(analysis.features(files, *lists, entropy_source="content")), "dense")
    dense = selection.select_rows(scored, "obfuscated").select("path", F.lit(True).alias("obfuscated"))
    return scored.join(dense, "path", "left").select("path", _r("entropy"), "threat_score", "is_anomaly", F.coalesce("obfuscated", F.lit(False)).alias("obfuscated"))


def _arriving(listed: DataFrame, root: str, chunks: int) -> Iterator[int]:
    """Cut the listing into chunks by time, newest first, in one pass over it; each step puts the files of the next
    chunk into ``root``/files. No steps without rows."""
    ends = listed.agg(F.min("mtime").alias("a"), F.max("mtime").alias("b")).first()
    if ends["a"] is None:
        return
    width = (ends["b"] - ends["a"]) // chunks + 1
    chunk = F.floor((F.lit(ends["b"]) - F.col("mtime")) / width).alias("chunk")
    listed.where("mtime is not null").select("*", chunk).write.partitionBy("chunk").parquet(f"{root}/listed")
    for k in range(chunks):
        move_files(listed.sparkSession, f"{root}/listed/chunk={k}", f"{root}/files")
        yield k


@_add("chunked_scan", _with("scored", f"select {_SCORED} from scored"))
def chunked_scan(s: SparkSession, d: str) -> DataFrame:
    """The listing cut into chunks, newest first, that arrive one after another in the folder that the
    stream reads; equal to the scan in one go."""
    root, scan = shared_folder(s, "scan"), None
    (white, black), listed = _lists(s, d), files_view(s, d).drop("source_text")
    for _ in _arriving(listed, root, 4):
        scan = scan_in_chunks(s, read_chunks(s, f"{root}/files", listed.schema), white, black, f"{root}/out", f"{root}/checkpoint")
    return _flat(analysis.analyse(_features(s, d)) if scan is None else scan)


@_add("stateful_scan", _with("scored", f"select {_SCORED} from scored"))
def stateful_scan(s: SparkSession, d: str) -> DataFrame:
    """The same chunks through one stateful stream, which goes on from its checkpoint after each."""
    root, chunk = shared_folder(s, "stateful"), None
    listed = files_view(s, d).drop("source_text")
    white, black = (written(x, "list") for x in _lists(s, d))
    for chunk in _arriving(listed, root, 2):
        stateful.stream_marked(read_chunks(s, f"{root}/files", listed.schema), white, black, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return _flat(analysis.analyse(_features(s, d) if chunk is None else s.read.parquet(f"{root}/out")))


@_add("event_percentiles_by_sketch", _order_sql("events", "value"))
def event_percentiles_by_sketch(s: SparkSession, d: str) -> DataFrame:
    return order_stats.order_stats_by_sketch(s.read.parquet(f"{d}/events.parquet"), "value", few=1000).select("q", _r("value"))


@_add("price_percentiles", _order_sql("lineitem", "l_extendedprice + l_orderkey / 100000.0 + l_linenumber / 10.0"))
def price_percentiles(s: SparkSession, d: str) -> DataFrame:
    """A column in which nearly all values differ."""
    price = F.col("l_extendedprice").cast("double") + F.col("l_orderkey") / 100000.0 + F.col("l_linenumber") / 10.0
    return order_stats.order_stats_by_sketch(s.read.parquet(f"{d}/lineitem.parquet").select(price.alias("p")), "p", few=1000).select("q", _r("value"))


@_add("json_leaves_by_variant", "select event_id, case when lower(event_type) = 'click' then 'a[b[type]]|c[1]' else '' end as paths from events")
def json_leaves_by_variant(s: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    reply = F.concat(F.lit('{"a":{"b":{"type":"'), kind, F.lit('"}},"c":[1,"'), kind, F.lit('"],"props":'), F.col("props"), F.lit("}"))
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", reply.alias("reply"))
    return variant_leaf_paths(rows, "CLICK", "event_id").select("event_id", F.array_join("paths", "|").alias("paths"))


@_add("reputation_by_variant", _with("readable", "").rstrip() + f", {_REPLIES} select path, md5, {_VERDICT} as verdict from readable left join replies on m = md5")
def reputation_by_variant(s: SparkSession, d: str) -> DataFrame:
    return report.apply_reputation(_readable(s, d).select("path", "md5"), _replies(s, d), variant=True)


@_add("lists_by_store", _with("readable", "select path, md5, md5 in (select md5 from black) as is_blacklisted from readable where md5 not in (select md5 from white)"))
def lists_by_store(s: SparkSession, d: str) -> DataFrame:
    """Both lists as bucketed tables, which are not moved for the joins."""
    white, black = (hash_store.save_hash_store(x, 16) for x in _lists(s, d))
    rows = written(_readable(s, d).select("path", "md5"), "hashed")
    return hash_store.flag_listed(hash_store.drop_listed(rows, white), black).select("path", "md5", "is_blacklisted")


@_add("features_of_days", _with("features", "select path, size, mtime, md5, duplicate_of, is_unreadable from features where mtime between 1700500000 and 1700900000"))
def features_of_days(s: SparkSession, d: str) -> DataFrame:
    feats, folder = _features(s, d), shared_folder(s, "days")
    report.write_features(feats, folder)
    return report.read_features(s, folder, feats.schema, 1_700_500_000, 1_700_900_000).select("path", "size", "mtime", "md5", "duplicate_of", "is_unreadable")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f, _ in CATALOG}
ORACLE_SQL: dict[str, str] = {name: sql for name, _, sql in CATALOG if sql}
