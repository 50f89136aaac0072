"""Column functions over paths and source text; all built-in but for three vectorised helpers."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.lexer import scan

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The tokens of the word rule, control signs, and short open tags that are written out.
#: A name with or without a dollar sign, a number, or one other sign.
WORD_TOKEN = r"[$]?[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^ \t\n\x0B\f\rA-Za-z0-9_]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
SHORT_TAG = r"<\?([^=A-Za-z0-9_])"
#: Rows and bytes of an Arrow batch of sources, where the session leaves Spark's default; sources lexed between two arrays.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}
LEXED_AT_ONCE = 32


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z only; ``lower`` would also fold signs such as the Kelvin sign."""
    return F.translate(c, UPPER, LOWER)


def extension(path: Column) -> Column:
    """Text after the last dot of the base name; empty without one."""
    return F.regexp_extract(path, r"[.]([^./]*)$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def short_label(name: Column) -> Column:
    return F.when(F.length(name) > 26, F.concat(F.substring(name, 1, 23), F.lit("..."))).otherwise(name)


def clean_source(content: Column) -> Column:
    """Without control characters (tabs and line ends stay); short open tags written out, which
    takes the character after them."""
    return F.regexp_replace(F.regexp_replace(content.cast("string"), CONTROL, ""), SHORT_TAG, "<?php ")


def tokens(content: Column, mode: str = "words", naming: int = 8) -> Column:
    """Distinct non-empty tokens other than '0', in order of appearance. ``words`` is built-in;
    ``lexer`` follows the language's own lexical rules, with names as before or from version 8 on."""
    source = clean_source(content)
    found = F.regexp_extract_all(source, F.lit(WORD_TOKEN), 0) if mode == "words" else lexer_tokens(source, naming)
    return F.array_remove(F.array_remove(F.array_distinct(found), "0"), "")


def lexer_tokens(source: Column, naming: int = 8) -> Column:
    """Trimmed distinct tokens; a file's repeated ones don't leave the task. A worker holds an Arrow batch of sources,
    which is small, and the tokens of a few of them as Python's strings."""
    small_batches()
    kind = pa.list_(pa.string())

    def lexed(source: str | None) -> list[str] | None:
        return None if source is None else list(dict.fromkeys(t.strip(" \t\n\r\0\x0b") for t in scan(source, naming)))

    @F.arrow_udf("array<string>")
    def found(sources: pa.Array) -> pa.Array:
        parts = [pa.array([lexed(s.as_py()) for s in sources.slice(i, LEXED_AT_ONCE)], kind) for i in range(0, len(sources), LEXED_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return found(source)


def small_batches() -> None:
    """Keep the Arrow batches of the active session small, where it doesn't say otherwise."""
    spark = SparkSession.getActiveSession()
    for name, (default, value) in BATCH.items() if spark else ():
        if spark.conf.get(name) == default:
            spark.conf.set(name, value)


def entropy(text: Column) -> Column:
    """Shannon entropy (base 2) of the characters of a string, 0 for an empty one."""

    def of(t: Column) -> Column:
        size = F.length(t)

        def part(c: Column) -> Column:
            n = (size - F.length(F.replace(t, c, F.lit("")))) / size
            return -n * F.log2(n)

        chars = F.filter(F.array_distinct(F.split(t, "")), lambda c: c != "")
        return F.when(size > 0, F.aggregate(F.transform(chars, part), F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))

    return F.transform(F.array(text), of)[0]  # bound once, however often it is used


def byte_entropy(value: bytes | None) -> float:
    counts = np.bincount(np.frombuffer(value or b"", np.uint8), minlength=256)
    share = counts[counts > 0] / max(1, len(value or b""))
    return float(-(share * np.log2(share)).sum()) + 0.0


def entropy_bytes(content: Column) -> Column:
    """Shannon entropy (base 2) of the bytes of the whole content, 0 for none."""

    @F.pandas_udf("double")
    def measured(contents: pd.Series) -> pd.Series:
        return contents.map(byte_entropy).astype("float64")

    return measured(content.cast("binary"))


def leaf_paths(value: object, needle: str) -> list[str]:
    """Key paths like a[b[0]] of the string leaves that equal ``needle``, the case of A-Z aside."""
    fold = str.maketrans(UPPER, LOWER)
    wanted, out = needle.translate(fold), []
    todo: list[tuple[object, list[str]]] = [(value, [])]
    while todo:
        node, keys = todo.pop()
        if isinstance(node, (dict, list)):
            items = list(node.items() if isinstance(node, dict) else enumerate(node))
            todo += [(item, [*keys, str(key)]) for key, item in reversed(items)]
        elif isinstance(node, str) and node.translate(fold) == wanted:
            out.append("[".join(keys) + "]" * (len(keys) - 1))
    return out


def json_leaf_paths(reply: Column, needle: str) -> Column:
    @F.pandas_udf("array<string>")
    def search(replies: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            try:
                return leaf_paths(json.loads(text), needle) if text else []
            except (ValueError, RecursionError):
                return []

        return replies.map(one)

    return search(reply)


def variant_leaf_paths(replies: DataFrame, needle: str, key: str = "id", reply: str = "reply") -> DataFrame:
    """(key, paths): the key paths of ``json_leaf_paths`` for each distinct row of ``replies``, in ascending order,
    without Python: the reply is a VARIANT and a recursive query goes down its levels.

    No paths for a null reply, one that is not JSON, or one in which an object repeats a key. Levels that hold the
    needle nowhere are not followed. ``key`` must name a row; the depth is bounded by Spark's limit of recursion (100).
    """
    spark, low = replies.sparkSession, needle.translate(str.maketrans(UPPER, LOWER))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    fold = f"translate({{}}, '{UPPER}', '{LOWER}')"
    rows = replies.select(F.col(key).alias("k"), F.col(reply).alias("r")).distinct()
    walked = spark.sql(
        f"""with recursive walk(k, v, path, depth) as (
          select k, v, '', 0 from (select k, try_parse_json(r) as v from {{rows}}) where contains({fold.format("to_json(v)")}, :text)
          union all
          select k, e.value, concat(path, if(depth = 0, '', '['), coalesce(e.key, cast(e.pos as string))), depth + 1
          from walk, lateral variant_explode(v) as e where contains({fold.format("to_json(e.value)")}, :text)
        )
        select k, concat(path, repeat(']', depth - 1)) as path from walk
        where schema_of_variant(v) = 'STRING' and {fold.format("variant_get(v, '$', 'string')")} = :low and depth > 0""",
        {"low": low, "text": json.dumps(low, ensure_ascii=False)[1:-1]}, rows=rows,
    )
    found = walked.groupBy("k").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return rows.select("k").distinct().join(found, "k", "left").select(F.col("k").alias(key), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))
