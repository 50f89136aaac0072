"""Streams against batch results, moments, order statistics, stores and layouts."""

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.functions.needles import WEB
from gleaner.operators import analysis, dashboard, hash_store, hashes, moments, order_stats, report
from gleaner.sources import files as sources
from gleaner.sources import tables
from gleaner.streaming import incremental, stateful

SCHEMA = "path string, mtime long, size long, content string, is_readable boolean"


def some_files(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        content = None if i % 13 == 12 else f"<?php eval({rng.randrange(n // 3)}); " + "x" * rng.randrange(50)
        content = content and rng.choice([content, "<?php same();", content])
        rows.append((f"/srv/f{i:03}.php", None if i % 17 == 5 else 1_700_000_000 + rng.randrange(40), content and len(content), content, content is not None))
    return rows


def lists(spark, rows):
    md5 = spark.createDataFrame(rows, SCHEMA).where("content is not null").select(F.md5(F.col("content").cast("binary")).alias("md5"))
    kept = sorted({r["md5"] for r in md5.collect()})
    return (spark.createDataFrame([(h,) for h in kept[k::7]] or [("",)], "md5 string") for k in (0, 1))


def marks(df):
    return {r["path"]: (r["md5"], r["duplicate_of"], r["is_blacklisted"], r["is_unreadable"], r["mtime"], r["size"], tuple(r["matched_tokens"])) for r in df.collect()}


def test_parts_of_seen_hashes_stay_few():
    for n in (0, 1, 15, 16, 17, 300, 5000):
        parts = incremental.spans(n)
        assert [c for level, start in parts for c in range(start, start + 16**level)] == list(range(n)) and len(parts) <= 15 * 4


def test_keyed_state_equals_the_other_scans_and_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "SPAN", 2)  # so that the third chunk reads a part of two
    rows = some_files(60)
    rows.sort(key=lambda r: (-(r[1] or 0), r[0]))
    white, black = lists(spark, rows)
    for part in range(3):  # the second start finds two chunks, the first and the third one each
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part != 1:
            stream = incremental.read_chunks(spark, f"{tmp_path}/in", spark.createDataFrame(rows, SCHEMA).schema, 1)
            stateful.stream_marked(stream, white, black, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = marks(spark.read.parquet(f"{tmp_path}/out"))
    batch = marks(analysis.features(spark.createDataFrame(rows, SCHEMA), white, black))
    assert got == batch and sum(m[1] is not None for m in got.values()) > 5
    stream = incremental.read_chunks(spark, f"{tmp_path}/in", spark.createDataFrame(rows, SCHEMA).schema, 1)
    incremental.stream_features(stream, white, black, f"{tmp_path}/each", f"{tmp_path}/check2").awaitTermination()
    assert marks(spark.read.parquet(f"{tmp_path}/each/features").drop("chunk")) == batch
    assert spark.read.parquet(f"{tmp_path}/each/moments").count() == 3  # what a re-analysis reads
    told = incremental.scored_so_far(spark, f"{tmp_path}/each", 2)
    scores = lambda df: [(r["path"], r["threat_score"], r["is_anomaly"], *r["z"]) for r in df.orderBy("path").collect()]
    for one, other in zip(scores(told), scores(analysis.analyse(spark.read.parquet(f"{tmp_path}/out"))), strict=True):
        assert one[:3] == other[:3] and one[3:] == pytest.approx(other[3:], abs=1e-6)


def test_chunks_of_real_files(spark, tmp_path):
    rows = [r for r in some_files(24) if r[3] is not None]
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for k, (path, mtime, _, content, _) in enumerate(rows):
        target = tmp_path / "in" / ("sub" if k % 2 else "") / os.path.basename(path)
        target.write_text(content)
        os.utime(target, (1_700_000_000 + 10 * ((k * 7) % len(rows)),) * 2)
    white, black = lists(spark, rows)
    stream = incremental.read_file_chunks(spark, f"file://{tmp_path}/in", files_per_chunk=5)
    scan = incremental.scan_in_chunks(spark, stream, white, black, f"{tmp_path}/out", f"{tmp_path}/check")
    whole = analysis.features(sources.read_files(spark, f"file://{tmp_path}/in"), white, black)
    assert marks(scan) == marks(whole) and len(marks(whole)) > 15
    chunks = spark.read.parquet(f"{tmp_path}/out/features").groupBy("chunk").agg(F.min("mtime").alias("a"), F.max("mtime").alias("b")).orderBy("chunk").collect()
    assert len(chunks) == -(-len(rows) // 5) and all(x["a"] > y["b"] for x, y in zip(chunks, chunks[1:], strict=False))


def measured(spark, rows):
    return spark.createDataFrame(rows, "path string, part int, size long, mtime long, total_tokens long, matched_tokens array<string>, entropy double, is_unreadable boolean")


def test_moments_merge_without_cancelling(spark):
    rng = random.Random(4)
    rows = [(f"/{i}", i % 4 if i % 4 else None, rng.randrange(9000), 1_700_000_000 + rng.randrange(9), 5, ["a"] * rng.randrange(3), rng.choice([math.nan, None, rng.random()]), i % 9 == 0) for i in range(400)]
    frame = measured(spark, rows)
    kept = moments.moments(frame.repartition(5), ["part"])
    got = moments.stats(moments.merged(kept)).first().asDict()
    read = [r for r in rows if not r[7]]
    for name, values in {"size": [r[2] for r in read], "mtime": [r[3] for r in read], "susp": [len(r[5]) for r in read], "entropy": [r[6] for r in read if r[6] is not None and not math.isnan(r[6])]}.items():
        mean = math.fsum(values) / len(values)
        assert got[f"{name}_mean"] == pytest.approx(mean, rel=1e-12)
        assert got[f"{name}_std"] == pytest.approx(math.sqrt(math.fsum((v - mean) ** 2 for v in values) / len(values)), abs=1e-6)
    assert sorted(map(str, moments.merged(kept, ["part"]).collect())) == sorted(map(str, kept.collect()))
    none = moments.stats(moments.merged(moments.moments(frame.limit(0)))).first()
    assert set(none.asDict().values()) == {0.0} and moments.merged(kept.limit(0), ["part"]).count() == 0


def test_statistics_of_groups(spark):
    rows = [(f"/{i}.php", i % 3 if i % 3 else None, (i % 3) * 1000 + i, 5, 5, [], 0.0, False) for i in range(90)] + [("/u", 7, None, 0, None, ["NOT_READABLE"], 0.0, True)]
    frame = measured(spark, rows).withColumns({"md5": F.lit("m"), "is_blacklisted": F.lit(False), "is_htaccess": F.lit(False), "duplicate_of": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    got = {r["path"]: (r["part"], r["z"]["size"]) for r in analysis.analyse(frame, by=["part"]).collect()}
    for part in (None, 1, 2):
        zs = [z for p, z in got.values() if p == part]
        assert len(zs) == 30 and sum(zs) == pytest.approx(0, abs=1e-9) and sum(z * z for z in zs) == pytest.approx(30)
    assert got["/u"] == (7, 0.0)


def test_weights_keep_their_decimals(spark):
    frame = spark.createDataFrame([(["a", "b", "c"],), (["a"],), (["d", "d"],)], "m array<string>")
    needles = [("a", 0.125), ("b", 0.125), ("c", 0.125), ("d", 0.00000001)]
    score = analysis.threat_score(F.lit("/x"), F.lit(1), F.col("m"), F.lit(0.0), F.lit(False), needles)
    assert [r[0] for r in frame.select(score).collect()] == [0.38, 0.13, 0.0]
    assert [float(r[0]) for r in frame.select(analysis.base_score(F.col("m"), needles)).collect()] == [0.375, 0.125, 0.00000002]
    assert analysis.weight_scale(WEB) == 2


def test_long_needle_tables_reach_the_score(spark):
    rng = random.Random(6)
    names = [f"w{i}" for i in range(3000)]
    needles = [(n.upper() if i % 7 == 0 else n, None if i % 5 == 0 else rng.randrange(1000) / 1000) for i, n in enumerate(names)] + [("Zap", 42.0), ("zap", 5.125), ("ZAP", 1.5)]
    flags = [[i % k == 0 for k in (40, 60, 90)] for i in range(len(needles))]
    table = spark.createDataFrame([(i, n, w, *f) for i, ((n, w), f) in enumerate(zip(needles, flags, strict=True))], "pos int, token string, weight double, is_critical boolean, is_obfuscation boolean, is_upload boolean")
    rows = [(f"/{rng.choice(['uploads', 'x'])}/{i}.php", i, None, " ".join(rng.choices([*names, "zap", "ZAP", "none"], k=rng.randrange(30))), i % 10 != 9) for i in range(60)]
    frame = spark.createDataFrame([(p, m, len(c), c, ok) for p, m, _, c, ok in rows] * 2, SCHEMA).repartition(3)
    none = spark.createDataFrame([], "md5 string")
    listed, categories = sources.needle_lists(table)
    shown = ["path", "matched_tokens", "total_tokens", "threat_score", "entropy", "is_anomaly"]
    by_join = analysis.analyse(analysis.features(frame, none, none, table=table)).select(*shown)
    by_list = analysis.analyse(analysis.features(frame, none, none, needles=listed), needles=listed, categories=categories).select(*shown)
    got, want = (sorted(map(str, x.collect())) for x in (by_join, by_list))
    assert got == want and len(got) == 120 and sum("matched_tokens=[]" in r for r in got) < 30


@pytest.mark.parametrize("kind", ["distinct", "few", "one", "steps"])
def test_order_statistics_by_sketch(spark, kind):
    n = 20_000
    value = {"distinct": F.rand(3) * 1e9, "few": F.floor(F.rand(3) * 5).cast("double"), "one": F.lit(2.5), "steps": F.when(F.col("id") < 9000, F.lit(1.0)).otherwise(F.rand(5))}[kind]
    frame = spark.range(n).select(F.when(F.col("id") % 50 == 0, None).otherwise(value).alias("v")).persist()
    values = sorted(r["v"] for r in frame.collect() if r["v"] is not None)
    qs = (0.0, 0.1, 0.5, 0.999, 1.0)
    got = {r["q"]: r["value"] for r in order_stats.order_stats_by_sketch(frame, "v", qs, few=300).collect()}
    assert got == {q: values[int(len(values) * q)] if q < 1 else 0.0 for q in qs}
    slow = {r["q"]: r["value"] for r in dashboard.order_stats(frame, "v", qs).collect()}
    assert got == slow


def test_order_statistics_of_odd_columns(spark):
    frame = spark.createDataFrame([(1.0,), (math.nan,), (None,), (0.0,)], "v double")
    got = [r["value"] for r in order_stats.order_stats_by_sketch(frame, "v").collect()]
    assert got == [0.0, 1.0, pytest.approx(math.nan, nan_ok=True)]
    assert [r["value"] for r in order_stats.order_stats_by_sketch(frame.limit(0), "v").collect()] == [0.0] * 3


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_leaf_paths_without_python(spark):
    nested = '{"a":{"b":{"c":"MALICIOUS","d":["x",{"e":"malicious"}]}},"z":"malicious too"}'
    rows = [(1, nested), (1, nested), (2, '{"a":1,"b":null,"malicious":2}'), (3, None), (4, "no malicious json"), (5, '["\\u006dalicious",["Malicious"]]'), (6, '"malicious"'), (7, '{"a":"Kalicious"}')]
    frame = spark.createDataFrame(rows, "id int, reply string")
    found = text.variant_leaf_paths(frame, "Malicious")
    assert {r["id"]: list(r["paths"]) for r in found.collect()} == {1: ["a[b[c]]", "a[b[d[1[e]]]]"], 2: [], 3: [], 4: [], 5: ["0", "1[0]"], 6: [], 7: []}
    plan = plan_of(found)
    assert "EvalPython" not in plan and "InArrow" not in plan and "InPandas" not in plan
    quoted = spark.createDataFrame([(1, '{"k":"say \\"Hi\\""}')], "id int, reply string")
    assert text.variant_leaf_paths(quoted, 'SAY "hi"').first()["paths"] == ["k"]


def test_reputation_without_python(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5")], "path string, md5 string")
    voted = '{"data":{"attributes":{"total_votes":{"malicious":2}}}}'
    replies = [("1", voted), ("1", voted), ("1", '{"data":{"x":["MALICIOUS"]}}'), ("2", voted), ("3", '{"error":"malicious"}'), ("4", "no json"), ("4", None), ("5", '{"data":{"malicious":1}}')]
    frame = spark.createDataFrame(replies, "md5 string, reply string")
    both = [sorted((r["path"], r["verdict"]) for r in report.apply_reputation(rows, frame, v).collect()) for v in (False, True)]
    assert both[0] == both[1] == [("a", "webshell"), ("b", "malicious"), ("c", None), ("d", None), ("e", None)]


def test_hash_store_stays_where_it_is(spark):
    listed = spark.createDataFrame([(f"{i:032x}",) for i in range(500)] * 2 + [(None,)], "md5 string")
    store = hash_store.save_hash_store(listed, 8)
    assert spark.table(store).count() == 500
    files = spark.createDataFrame([(f"/{i}", f"{i:032x}") for i in range(450, 550)] + [(f"/hot{i}", f"{3:032x}") for i in range(300)] + [("/null", None)], "path string, md5 string")
    for new, old in ((hash_store.drop_listed(files, store), hashes.drop_whitelisted(files, listed)), (hash_store.flag_listed(files, store), hashes.flag_blacklisted(files, listed))):
        assert sorted(map(str, new.select(*old.columns).collect())) == sorted(map(str, old.collect()))
    plan = plan_of(hash_store.listed(files, store))
    assert "Bucketed: true" in plan and plan.count(") Exchange\n") == 1  # of the files' own hashes


def test_days_are_pruned(spark, tmp_path):
    rows = [(f"/{i}", 1_700_000_000 + i * 40_000, "m") for i in range(20)] + [("/zero", 0, "m"), ("/none", None, "m")]
    frame = spark.createDataFrame(rows, "path string, mtime long, md5 string")
    report.write_features(frame, f"{tmp_path}/days", "parquet")
    low, high = 1_700_080_000, 1_700_200_000
    found = report.read_features(spark, f"{tmp_path}/days", frame.schema, low, high, "parquet")
    assert sorted(r["path"] for r in found.collect()) == ["/2", "/3", "/4", "/5"]
    days = {os.path.basename(os.path.dirname(r[0])) for r in found.select(F.col("_metadata.file_path")).collect()}
    assert days == {"day=2023-11-15", "day=2023-11-16", "day=2023-11-17"} and "PartitionFilters: [isnotnull(day" in plan_of(found)


def test_written_tables_can_be_dropped(spark):
    before = tables.count_written()
    kept = tables.written(spark.range(3), "t")
    assert kept.count() == 3 and tables.count_written() == before + 1
    path = tables._written[-1].removeprefix("file://")
    tables.drop_written(spark, before)
    assert not os.path.exists(path) and tables.count_written() == before


def test_documents_are_read_once_for_features(spark):
    from gleaner.jobs import catalog

    plan = plan_of(catalog.timeline(spark, "/root/testdata/sf0.001"))
    assert "documents.parquet" not in plan and len(re.findall(r"^\(\d+\) \w*Join", plan, re.M)) <= 4


def test_the_listing_is_cut_in_one_pass(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from gleaner.jobs import catalog

    written, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (written.append(path), write(self, path, *a, **b))[1])
    listed = spark.createDataFrame([(f"/{i}", 100 + i if i < 9 else 140) for i in range(10)] + [("/none", None)], "path string, mtime long").repartition(3)
    seen = []
    for k in catalog._arriving(listed, f"file://{tmp_path}", 4):
        names = [r["path"] for r in spark.read.schema(listed.schema).parquet(f"file://{tmp_path}/files").collect()]
        seen.append((k, sorted(set(names) - {p for _, s in seen for p in s})))
    assert seen == [(0, ["/9"]), (1, []), (2, ["/8"]), (3, [f"/{i}" for i in range(8)])] and len(written) == 1
    assert list(catalog._arriving(listed.limit(0), f"file://{tmp_path}/empty", 4)) == []


def test_a_hash_asks_the_state_once(spark):
    from pyspark.sql import Row

    class State:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    seen = stateful.FirstSeen()
    seen.first = state = State()
    rows = [Row(md5="m", path=p, age=a, packed=str(a)) for p, a in (("/b", 2), ("/c", 1), (None, 1), ("/a", 1))]
    told = [(r["path"], r["duplicate_of"], r["packed"]) for r in seen.handleInputRows(("m",), iter(rows), None)]
    assert told == [("/b", "/a", "2"), ("/c", "/a", "1"), (None, "/a", "1"), ("/a", None, "1")] and state.calls == 2
    assert [r["duplicate_of"] for r in seen.handleInputRows(("m",), iter(rows[:1]), None)] == ["/a"] and state.calls == 3
    assert [r["duplicate_of"] for r in seen.handleInputRows((None,), iter(rows[:1]), None)] == [None] and state.calls == 3
