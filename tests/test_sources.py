"""The tree data source, and the lexer's constructs."""

import hashlib
import os
import time

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.functions.lexer import lex, scan
from gleaner.operators import analysis
from gleaner.sources import files as sources
from gleaner.sources import tree


@pytest.fixture
def site(tmp_path):
    for name, content in {"a.php": "<?php 1;", "b/.htaccess": "Deny", "b/_c/.d/e.PHTML": "x", "b/f.txt": "text", "g.inc": "y" * 500, "big.php": "z" * 5000, ".hidden/h": ""}.items():
        path = tmp_path / "site" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
        os.utime(path, (1_700_000_000 + len(content), 1_700_000_000 + len(content)))
    os.symlink(tmp_path / "site", tmp_path / "site" / "loop")
    return tmp_path / "site"


class Counting(tree.TreeReader):
    """Names the files that it opens; one of them is gone by then."""

    names: list[str] = []

    def opened(self, system, path):
        self.names.append(os.path.basename(path))
        if path.endswith(".inc"):
            raise FileNotFoundError("gone")
        return super().opened(system, path)


def read(site, filters=(), **options):
    reader = Counting({"path": f"file://{site}", **{k: str(v) for k, v in options.items()}})
    reader.names = []
    left = list(reader.pushFilters(list(filters)))
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    return {os.path.relpath(r["path"], site): r for r in rows}, reader.names, left, parts


def test_all_names_are_listed_and_failures_are_rows(site):
    rows, names, left, _ = read(site, maxFileBytes=1000)
    assert sorted(rows) == [".hidden/h", "a.php", "b/.htaccess", "b/_c/.d/e.PHTML", "b/f.txt", "big.php", "g.inc"] and left == []
    assert [(rows[n]["is_readable"], rows[n]["error"], rows[n]["content"]) for n in ("g.inc", "big.php", ".hidden/h")] == [(False, "gone", None), (False, "too large", None), (True, None, b"")]
    assert "big.php" not in names and rows["b/.htaccess"]["extension"] == "htaccess" and rows["a.php"]["mtime"] == 1_700_000_008
    assert {n for n, r in rows.items() if r["is_script"]} == {"a.php", "b/.htaccess", "b/_c/.d/e.PHTML", "big.php", "g.inc"}


def test_filters_decide_what_is_opened(site):
    asked = [ds.EqualTo(("is_script",), True), ds.LessThan(("size",), 100), ds.Not(ds.StringEndsWith(("path",), ".php")), ds.EqualTo(("content",), b"x"), ds.EqualTo(("size",), None)]
    rows, names, left, _ = read(site, asked)
    assert sorted(names) == [".htaccess", "e.PHTML"] and sorted(rows) == ["b/.htaccess", "b/_c/.d/e.PHTML"] and left == asked[3:]
    rows, names, _, _ = read(site, [ds.In(("extension",), ["txt", "inc"]), ds.GreaterThan(("mtime",), 0)])
    assert sorted(names) == ["f.txt", "g.inc"]


def test_partitions_follow_size_and_tasks_list_what_the_driver_left(site):
    assert len(read(site)[3]) == 1
    rows, _, _, parts = read(site, partitionBytes=2000, openBytes=10)
    assert len(parts) == 2 and len(rows) == 7
    rows, _, _, parts = read(site, plannedFiles=4)
    assert len(rows) == 7 and any(p.folders for p in parts)
    with pytest.raises(FileNotFoundError):
        read(site / "none")
    assert sorted(read(site / "b" / "f.txt")[0]) == ["."]
    os.mkdir(site / "empty")
    assert read(site / "empty")[0] == {}


def test_names_are_taken_as_they_are(spark, tmp_path):
    (tmp_path / "a b#%41").mkdir()
    (tmp_path / "a b#%41" / "c d%20.php").write_text("<?php 2;")
    found = tree.read_tree(spark, f"{tmp_path}/a b#%41").collect()
    assert [(r["path"], r["size"]) for r in found] == [(f"{tmp_path}/a b#%41/c d%20.php", 8)]
    manifest = spark.createDataFrame([(found[0]["path"], 1), (None, 1), ("nowhere://x", 2)], "path string, mtime long")
    assert sorted(((r["mtime"], r["size"], r["is_readable"]) for r in sources.read_manifest(manifest).collect()), key=str) == [(1, 8, True), (1, None, False), (2, None, False)]


def test_tree_in_spark(spark, site):
    found = tree.read_tree(spark, f"file://{site}").where("is_script and size < 100")
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "EqualTo(is_script,true)" in plan and "LessThan(size,100)" in plan
    none = spark.createDataFrame([], "md5 string")
    feats = analysis.features(tree.read_tree(spark, str(site), maxFileBytes=1000).where("is_script"), none, none)
    got = {os.path.relpath(r["path"], site): (r["is_unreadable"], r["is_htaccess"]) for r in feats.collect()}
    assert got == {"a.php": (False, False), "b/.htaccess": (False, True), "b/_c/.d/e.PHTML": (False, False), "g.inc": (False, False), "big.php": (True, False)}
    assert tree.read_tree(spark, f"file://{site}/.hidden").where("extension = 'php'").count() == 0


LEXED = [
    ('"{$a["eval"]}"', ['"', "{", "$a", "[", '"eval"', "]", "}", '"']),
    ('"${a}${b["x"]}"', ['"', "${", "a", "}", "${", "b", "[", '"x"', "]", "}", '"']),
    ('"$a[0]$b[k]$c[-1]$d[$e]"', ['"', "$a", "[", "0", "]", "$b", "[", "k", "]", "$c", "[", "-", "1", "]", "$d", "[", "$e", "]", '"']),
    ('"$a->b->c $d?->e"', ['"', "$a", "->", "b", "->c ", "$d", "?->", "e", '"']),
    ('"\\$a {\\$b} $ {x"', ['"\\$a {\\$b} $ {x"']),
    ('"{$a(function() { return "x{$y}"; })}";', ['"', "{", "$a", "(", "function", "(", ")", "{", "return", '"', "x", "{", "$y", "}", '"', ";", "}", ")", "}", '"', ";"]),
    ('<<<E\na $b\n  {$c["x"]}\nEx\n  E; eval', ["<<<E\n", "a ", "$b", "{", "$c", "[", '"x"', "]", "}", "\nEx\n", "  E", ";", "eval"]),
    ("<<<E\n{$a(<<<F\n$b\nF)}\nE;", ["<<<E\n", "{", "$a", "(", "<<<F\n", "$b", "F", ")", "}", "E", ";"]),
    ("<<<'E'\nraw {$x}\nE . 1", ["<<<'E'\n", "raw {$x}\n", "E", ".", "1"]),
    ("`a {$b[`c`]} d`", ["`", "a ", "{", "$b", "[", "`", "c", "`", "]", "}", " d", "`"]),
    ("#[eval] f() # x ?> y", ["#[", "eval", "]", "f", "(", ")", "# x ", "?>", " y"]),
    ("if (1) { ?>a<?php }", ["if", "(", "1", ")", "{", "?>", "a", "<?php", "}"]),
    ('"open $a', ['"', "open ", "$a"]),
    ('"open', ['"', "open"]),
    ("'open", ["'open"]),
    ("/* open", ["/* open"]),
    ("<<<E\nopen $a", ["<<<E\n", "open ", "$a"]),
    ("1_000 0o17 .5e3 1.5 0x1F", ["1_000", "0o17", ".5e3", "1.5", "0x1F"]),
    ("__halt_compiler ( ) ; eval <?php", ["__halt_compiler", "(", ")", ";", " eval <?php"]),
    ("__halt_compiler ?>eval <?php", ["__halt_compiler", "?>", "eval ", "<?php"]),
    ("a << <b <<< c", ["a", "<<", "<", "b", "<<<", "c"]),
]


@pytest.mark.parametrize(("source", "want"), LEXED)
def test_constructs(source, want):
    found = lex("<?php " + source)
    assert "".join(found) == "<?php " + source
    assert [t for t in found[1:] if t.strip()] == want


def test_names_before_version_8(spark):
    source = "<?php \\system(a\\b); #[eval]\n$a?->b"
    assert [t for t in lex(source, 7)[1:] if t.strip()] == ["\\", "system", "(", "a", "\\", "b", ")", ";", "#[eval]", "$a", "?", "->", "b"]
    assert [t for t in lex(source)[1:] if t.strip()] == ["\\system", "(", "a\\b", ")", ";", "#[", "eval", "]", "$a", "?->", "b"]
    frame = spark.createDataFrame([(source,)], "c string")
    assert [("system" in frame.select(text.tokens(F.col("c"), "lexer", n)).first()[0]) for n in (7, 8)] == [True, False]


@pytest.mark.parametrize("unit", ['"{$a["', '"${a', "{$", "`", '"$a[', "<<<E\n", "'", "\\", "(", "yield ", '"{$a["eval"]}" '])
def test_any_source_of_a_megabyte_takes_seconds(unit):
    source = "<?php " + unit * (1_000_000 // len(unit))
    began = time.time()
    assert sum(map(len, scan(source))) == len(source) and time.time() - began < 20


def test_scan_of_a_tree(spark, site, tmp_path):
    from gleaner.jobs import scan

    (site / "evil.php").write_text('<?php eval(base64_decode("x")); ?> eval')
    (site / "quoted.php").write_text('<?php echo "{$a["system"]} exec it"; ?> <b>text</b>')
    (tmp_path / "white").write_text(hashlib.md5(b"<?php 1;").hexdigest() + "\n")
    (tmp_path / "black").write_text(hashlib.md5(b"x").hexdigest().upper() + " \r\n")
    scan.scan(spark, f"file://{site}", f"file://{tmp_path}/out", f"file://{tmp_path}/white", f"file://{tmp_path}/black", tokens="lexer", max_file_bytes=1000)
    lines = [r[0] for r in spark.read.text(f"file://{tmp_path}/out/report").collect()]
    names = [line.split(" ")[0].removeprefix(f"{site}/") for line in lines]
    assert names[:2] == ["b/_c/.d/e.PHTML", "evil.php"] and set(names) == {"b/_c/.d/e.PHTML", "evil.php", "quoted.php", "b/.htaccess", "g.inc", "big.php"}
    assert "(eval, base64_decode)" in lines[1] and "ThreatScore: 42.5" in lines[1] and "(BLACKLIST)" in lines[0]
    told = {r["path"].removeprefix(f"{site}/"): r["severity"] for r in spark.read.json(f"{tmp_path}/out/labels").collect()}
    assert told == {"b/_c/.d/e.PHTML": "BLACKLIST", "evil.php": "CRITICAL", "b/.htaccess": "HTACCESS", "big.php": "NOT READABLE"}
    assert spark.read.json(f"{tmp_path}/out/insights").first()["total"] == 6 and spark.read.json(f"{tmp_path}/out/timeline").count() == 20
    (tmp_path / "needles.csv").write_text("pos,token,weight,is_critical,is_obfuscation,is_upload\n0,ECHO,0.125,false,false,false\n")
    scan.scan(spark, f"file://{site}", f"file://{tmp_path}/own", needles=f"file://{tmp_path}/needles.csv")
    assert "(ECHO)" in next(r[0] for r in spark.read.text(f"file://{tmp_path}/own/report").collect() if "quoted" in r[0])
    scan.scan(spark, f"file://{site}", f"file://{tmp_path}/cli", black=f"file://{tmp_path}/black", profile="cli")
    assert any(r[0].endswith("evil.php (eval, base64_decode)") for r in spark.read.text(f"file://{tmp_path}/cli/report").collect())


def test_many_directories_are_dealt_over_a_bounded_number_of_tasks(tmp_path):
    for i in range(300):
        (tmp_path / f"d{i % 3}" / f"e{i}").mkdir(parents=True)
        (tmp_path / f"d{i % 3}" / f"e{i}" / ".htaccess").write_text("x")
    rows, _, _, parts = read(tmp_path, plannedFiles=100)
    assert len(rows) == 300 and sum(len(p.folders) for p in parts) == 300 and len(parts) <= 256
    rows, _, _, parts = read(tmp_path, plannedFiles=100, folderPartitions=7)
    assert len(rows) == 300 and [len(p.folders) for p in parts] == [43] * 6 + [42]


def test_the_driver_stops_listing_within_a_level(tmp_path):
    for i in range(200):
        (tmp_path / f"d{i}").mkdir()
        for k in range(10):
            (tmp_path / f"d{i}" / f"{k}.php").write_text("x")
    rows, _, _, parts = read(tmp_path, plannedFiles=300)
    assert len(rows) == 2000 and 300 <= sum(len(p.files) for p in parts) <= 640 + 300
