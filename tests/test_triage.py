"""Golden rows for the quirks of the triage rules; the queries themselves are held against SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.functions.lexer import lex
from gleaner.functions.needles import CLI, WEB
from gleaner.jobs import catalog
from gleaner.operators import analysis, dashboard, hashes, report, selection
from gleaner.sources import files as sources

SF = "/root/testdata/sf0.001"


def values(spark, column, rows, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("v"))).collect()]


def test_needle_tables(spark):
    assert (len(WEB), len({t for t, _ in CLI})) == (84, 107)
    table = sources.needle_table(spark)
    assert table.count() == 84 and table.where("is_critical").count() == 8 and table.where("is_obfuscation").count() == 7 and table.where("is_upload").count() == 3


def test_entropy(spark):
    got = values(spark, text.entropy, ["AAAAAA", "ABCDEF", "", "a$_b"])
    assert got == pytest.approx([0, 2.584963, 0, 2.0], abs=1e-6)
    assert values(spark, text.entropy_bytes, ["AAAAAA", "ABCDEF", None]) == pytest.approx([0, 2.584963, 0], abs=1e-6)


def test_extensions_and_patterns(spark):
    assert values(spark, text.extension, ["/a/b.php.txt", "/a.php/b", "/a/.htaccess"]) == ["txt", "", "htaccess"]
    frame = spark.createDataFrame([(p,) for p in ("x.PHP", "x.photo", "x.sh", "x.shtml", "x.inc5", "/a/.HTACCESS")], "path string")
    kept = selection.filter_patterns(frame).select("path", selection.is_htaccess(F.col("path"))).collect()
    assert [tuple(r) for r in kept] == [("x.PHP", False), ("x.photo", False), ("x.shtml", False), ("/a/.HTACCESS", False)]


def test_short_tags(spark):
    assert values(spark, text.clean_source, ["<? echo 1;", "<?$x", "<?=1", "<?xml", "a\x00b\x7f\tc"]) == ["<?php echo 1;", "<?php x", "<?=1", "<?xml", "ab\tc"]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<?php $a=0; $a=0;", ["<?php", " ", "$a", "=", "0", ";", " ", "$a", "=", "0", ";"]),
        ("eval <?= eval ?>\nx", ["eval ", "<?=", " ", "eval", " ", "?>\n", "x"]),
        ("<?php 'eval' /* eval */ // eval\n#x", ["<?php", " ", "'eval'", " ", "/* eval */", " ", "// eval", "\n", "#x"]),
        ('<?php "a $b c"', ["<?php", " ", '"', "a ", "$b", " c", '"']),
        ("<?php (int)$x->y??\\system", ["<?php", " ", "(int)", "$x", "->", "y", "??", "\\system"]),
        ("<?php `ls`", ["<?php", " ", "`", "ls", "`"]),
        ("<?php `cat eval -x`;", ["<?php", " ", "`", "cat eval -x", "`", ";"]),
        ("<?php `a $b\\` c", ["<?php", " ", "`", "a ", "$b", "\\` c"]),
        ("<?php yield from x(); yield fromage;", ["<?php", " ", "yield from", " ", "x", "(", ")", ";", " ", "yield", " ", "fromage", ";"]),
        ("<?php b'eval'.B\"a $b\";", ["<?php", " ", "b'eval'", ".", 'B"', "a ", "$b", '"', ";"]),
        ("<?php <<<'E'\nraw $x\nE;", ["<?php", " ", "<<<'E'\n", "raw $x\n", "E", ";"]),
        ("<?php __halt_compiler();rest <?php eval", ["<?php", " ", "__halt_compiler", "(", ")", ";", "rest <?php eval"]),
    ],
)
def test_lexer(source, want):
    assert lex(source) == want


def test_lexer_on_long_strings():
    assert len(lex("<?php '" + "x\\'" * 200_000 + "'")) == 3


def test_tokens_and_matching(spark):
    assert values(spark, lambda c: text.tokens(c, "lexer"), ["<?php $a=0; $a=0;"]) == [["<?php", "$a", "=", ";"]]
    hit = [values(spark, lambda c, e=e: selection.match_needles(text.tokens(c), WEB, e), ["EVAL eval popen "])[0] for e in ("needle", "token")]
    assert hit == [["eval"], ["EVAL", "eval"]]
    assert values(spark, lambda c: selection.match_needles(text.tokens(c), WEB), ["$sistemit_com_enc 1"]) == [["$SISTEMIT_COM_ENC"]]


def score(spark, matched, path="/a/x.php", size=30000, measured=0.0, bad=False):
    frame = spark.createDataFrame([(path, size, matched, measured, bad)], "p string, s long, m array<string>, e double, b boolean")
    return frame.select(analysis.threat_score(*map(F.col, "psmeb"))).first()[0]


def test_scores(spark):
    assert score(spark, ["eval"]) == 10.0
    assert score(spark, ["eval", "base64_decode"]) == 37.5
    assert score(spark, ["system", "move_uploaded_file"]) == 21.6
    assert score(spark, ["eval", "gzinflate", "$_files"]) == 76.5
    assert score(spark, ["include"], "/a/intermediate.php") == 5.1
    assert score(spark, [], "/uploads/x.php") == 0.0
    assert score(spark, ["pcntl_fork", "base64_decode"]) == 15.0
    assert score(spark, [], size=100, measured=5.9) == 3.0
    assert score(spark, [], bad=True) == 100.0
    assert score(spark, ["$SISTEMIT_COM_ENC"]) == 1.0


def test_duplicates(spark):
    rows = spark.createDataFrame([("a", 5, "h"), ("b", 9, "h"), ("c", 9, "h"), ("d", 1, "k")], "path string, mtime long, md5 string")
    want = {"a": "b", "b": None, "c": "b", "d": None}
    for mark in (hashes.mark_duplicates, hashes.mark_duplicates_by_window):
        assert {r["path"]: r["duplicate_of"] for r in mark(rows).collect()} == want


def test_order_stats_and_timeline(spark):
    frame = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "entropy double")
    assert sorted(map(tuple, dashboard.order_stats(frame).collect())) == [(0.25, 2.0), (0.5, 3.0), (0.75, 4.0)]
    times = spark.createDataFrame([(100, 1.0), (200, 12.0), (300, 6.0), (0, 99.0)], "mtime long, threat_score double")
    got = {r["bucket"]: (r["n"], r["band"]) for r in dashboard.timeline(times).collect()}
    assert len(got) == 20 and (got[0], got[10], got[19]) == ((1, "low"), (1, "high"), (1, "medium"))


def test_own_needles_reach_the_score(spark):
    table = spark.createDataFrame([(1, "b", None, False, True, False), (0, "Zap", 42.0, True, False, False)], "pos int, token string, weight double, is_critical boolean, is_obfuscation boolean, is_upload boolean")
    needles, categories = sources.needle_lists(table)
    assert needles == [("Zap", 42.0), ("b", None)] and categories == (["zap"], ["b"], [])
    frame = spark.createDataFrame([(["zap"],), (["zap", "b"],), (["b"],)], "m array<string>")
    none = F.lit(None)
    got = frame.select(analysis.threat_score(F.lit("/a/x"), F.lit(1), F.col("m"), F.lit(0.0), none.cast("boolean"), [("zap", 42.0), ("b", None)], categories)).collect()
    assert [r[0] for r in got] == [42.0, 107.5, 1.0]
    assert values(spark, lambda c: selection.match_needles(text.tokens(c), needles), ["ZAP \u212a B"]) == [["Zap", "b"]]
    assert values(spark, lambda c: selection.match_needles(text.tokens(c), [("k", 1.0), ("É", 1.0)]), ["\u212a é É"]) == [["É"]]


def files(spark, rows):
    return spark.createDataFrame([(*r, None if r[2] is None else len(r[2])) for r in rows], "path string, mtime long, content string, is_readable boolean, size long")


def test_unknown_readability_and_outcomes(spark):
    rows = files(spark, [("/a.php", 5, "<?php eval(1);", True), ("/b.php", 6, None, False), ("/c.php", None, None, None), ("/d.txt", 1, "x", True)])
    md5 = rows.where("path = '/a.php'").select(F.md5(F.col("content").cast("binary")).alias("md5"))
    none = md5.limit(0)
    feats = analysis.features(rows, none, md5, outcomes=md5.withColumn("error", F.lit("busy")).unionAll(md5.withColumn("error", F.lit("busy"))))
    got = {r["path"]: (r["is_unreadable"], r["error"], r["mtime"]) for r in feats.collect()}
    assert got == {"/a.php": (False, "busy", 5), "/b.php": (True, None, 6), "/c.php": (True, None, 0)}
    assert sorted(map(tuple, selection.warnings(feats).collect())) == [("action failed", "/a.php"), ("not readable", "/b.php"), ("not readable", "/c.php")]
    assert analysis.analyse(analysis.features(rows.limit(0), none, none)).count() == 0


def test_reputation(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, md5 string")
    voted = '{"data":{"attributes":{"total_votes":{"malicious":2}}}}'
    replies = [("1", voted), ("1", voted), ("1", '{"data":{"x":["MALICIOUS"]}}'), ("2", voted), ("3", '{"error":"malicious"}'), ("4", "no json"), ("4", None)]
    got = report.apply_reputation(rows, spark.createDataFrame(replies, "md5 string, reply string"))
    assert sorted((r["path"], r["verdict"]) for r in got.collect()) == [("a", "webshell"), ("b", "malicious"), ("c", None), ("d", None)]


def test_orders_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(f"/p{i:04}", None if i % 50 == 0 else rng.randrange(9), rng.choice([0.0, 1.5, None]), i % 11 == 0, rng.random()) for i in range(900)]
    frame = spark.createDataFrame(rows, "path string, mtime long, threat_score double, is_unreadable boolean, entropy double").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        got = {r["path"]: r["place"] for r in dashboard.ranked_rows(frame, "threat").collect()}
        ranks = {r["path"]: r["rank"] for r in dashboard.entropy_rank(frame.withColumn("mtime", F.coalesce("mtime", F.lit(0)))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = sorted(rows, key=lambda r: (-(r[2] or 0), r[3], 0 if r[3] else -(r[1] or 0), r[0]))
    assert [got[r[0]] for r in want] == list(range(900))
    read = sorted((r for r in rows if not r[3]), key=lambda r: r[4])
    assert [ranks[r[0]] for r in read] == pytest.approx([i / (len(read) - 1) for i in range(len(read))])


@pytest.mark.parametrize(("value", "want"), [(0.25, "0.3"), (-0.25, "-0.3"), (0.04, "0.0"), (-0.04, "0.0"), (1234.5, "1234.5"), (None, None)])
def test_one_decimal(spark, value, want):
    assert spark.range(1).select(report.one_decimal(F.lit(value).cast("double"))).first()[0] == want


def test_json_leaves():
    assert text.leaf_paths({"a": {"b": {"c": "MALICIOUS", "d": ["x", {"e": "malicious"}]}}}, "malicious") == ["a[b[c]]", "a[b[d[1[e]]]]"]
    assert text.leaf_paths({"a": {"b": "Malicious"}, "c": 1, "d": ["x", "malicious"]}, "malicious") == ["a[b]", "d[1]"]


def test_files_and_hash_lists(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.php").write_text("<?php 1;")
    (tmp_path / "t" / ".htaccess").write_text("Deny")
    (tmp_path / "list").write_text("AB \r\ncd\n\nab\n")
    assert sources.read_files(spark, f"file://{tmp_path}/t").select("path", "size").collect()[0]["size"] == 8
    manifest = spark.createDataFrame([(f"{tmp_path}/t/.htaccess", 5), (f"{tmp_path}/t/none", None)], "path string, mtime long")
    assert sorted((r["mtime"], r["size"], r["is_readable"]) for r in sources.read_manifest(manifest).collect()) == [(0, None, False), (5, 4, True)]
    assert sorted(r["md5"] for r in sources.load_hashes(spark, f"file://{tmp_path}/list").collect()) == ["ab", "cd"]


@pytest.mark.parametrize("name", ["top_threats", "scored", "cli_report", "chunked_scan", "scored_by_lexer", "scored_by_nested_lexer", "tree_read", "scored_by_own_needles", "dense_files", "result_orders", "manifest_read", "labels"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "events"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = con.execute(f"select {', '.join(got.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    clean = lambda rows: sorted(tuple(str(round(v, 5) + 0.0 if isinstance(v, float) else v) for v in r) for r in rows)
    assert clean(map(tuple, got.collect())) == clean(want)


def test_sources_go_to_the_lexer_in_small_batches(spark):
    from pyspark.sql import Row

    names = list(text.BATCH)
    kept = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.unset(n)
    try:
        lines = "<?php echo 1; ?> a\neval\nb"
        frame = spark.createDataFrame([Row(c=lines), Row(c=None), Row(c="")] * 50 + [Row(c="<?php eval(2);")], "c string").coalesce(1)
        made = frame.select(text.tokens(F.col("c"), "lexer").alias("t"))
        assert [spark.conf.get(n) for n in names] == ["1000", "8m"]
        found = [r["t"] for r in made.collect()]
        assert found == [["<?php", "echo", "1", ";", "?>", "a\neval\nb"], None, []] * 50 + [["<?php", "eval", "(", "2", ")", ";"]]
        told = [r[0] for r in made.select(selection.match_needles(F.col("t"), WEB)).collect()]
        assert told[0] == [] and told[-1] == ["eval"]  # a line of the page text is no token
    finally:
        for n in names:
            spark.conf.set(n, kept[n])


def test_nested_sources_of_recurring_ids(spark, tmp_path):
    rows = [(i % 20, f"text {i}", "en", "s", 6) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["scored_by_nested_lexer"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"select path, total_tokens from ({catalog.ORACLE_SQL['scored_by_nested_lexer']})").fetchall()
    assert sorted(map(str, got.select("path", "total_tokens").collect())) == sorted(f"Row(path={p!r}, total_tokens={n})" for p, n in want)


def test_tokens_meet_the_needle_table_before_a_shuffle(spark):
    frame = spark.createDataFrame([("/a", ["EVAL", "eval", "x", "Äb", "Key"]), ("/b", []), ("/c", None), ("/a", ["Echo"]), ("/d", ["none"])], "path string, tokens array<string>")
    table = spark.createDataFrame([(2, "eval"), (0, "Eval"), (1, "ÄB"), (3, "key"), (4, "echo")], "pos int, token string")
    found = selection.match_needles_by_join(frame, table)
    assert {r["path"]: r["matched_tokens"] for r in found.collect()} == {"/a": ["Eval", "ÄB", "eval", "echo"]}
    plan = spark._jvm.PythonSQLUtils.explainString(selection.match_needles_by_join(frame, F.broadcast(table))._jdf.queryExecution(), "formatted")
    assert plan.count(") Exchange\n") == 1


def test_files_matched_by_join_match_sql(spark):
    test_queries_match_sql(spark, "needles_matched_by_join")
