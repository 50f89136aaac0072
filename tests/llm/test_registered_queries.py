"""The registered queries on whole small tables, on every column of their contracts, and the
pipeline's stages on odd rows."""

import collections
import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gleaner.llm import queries
from gleaner.llm.tokens import vocabulary
from tests.llm.test_corpus_operators import brute_components, brute_contamination
from tests.llm.test_search_and_filters import brute_rule, brute_secrets

SF = "/root/testdata/sf0.001"


def table(name, *columns):
    found = pq.read_table(f"{SF}/{name}.parquet").to_pydict()
    return list(zip(*(found[c] for c in columns), strict=True))


def rows(spark, name, *columns):
    found = queries.QUERIES[name](spark, SF)
    assert set(columns) <= set(found.columns)
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=str)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_op2(spark):
    want = []
    for i, t in table("documents", "doc_id", "text"):
        found = brute_secrets(t or "")
        kinds = collections.Counter(k for k, _, _ in found)
        want.append((i, kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))))
    assert rows(spark, "op2_secret_scan", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=str)
    for (i, spans), (_, text) in zip(sorted(rows(spark, "op2_secret_scan", "doc_id", "spans")), sorted(table("documents", "doc_id", "text")), strict=True):
        base = [s for s in spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert base == [f"{k}:{a}:{b}" for k, a, b in brute_secrets(text or "")], i


def test_op3(spark):
    urls = dict(table("pages", "page_id", "url"))
    got = rows(spark, "op3_url_filter", "page_id", "host", "path", "rule", "verdict")
    assert len(got) == len(urls)
    for i, host, path, rule, verdict in got:
        want = brute_rule(urls[i])
        assert (host, path, rule) == want[:3] and verdict in ("allow", "block") and verdict == (want[3] or verdict)


def test_op4(spark):
    docs = {i: (t, lang) for i, t, lang in table("documents", "doc_id", "text", "lang")}
    got = rows(spark, "op4_language_id", "doc_id", "held_out", "lang_pred", "score")
    assert sorted(r[0] for r in got) == sorted(docs)
    assert all(held == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= score <= 1 for i, held, _, score in got)
    told = [(p, docs[i][1]) for i, held, p, _ in got if held and p != "und" and docs[i][1]]
    assert sum(p == x for p, x in told) >= 0.9 * len(told) > 20


def test_op5(spark):
    assert rows(spark, "op5_ngram_join", "doc_id", "n_shingles", "component_id", "n_links") == sorted(brute_components(table("documents", "doc_id", "text")), key=str)


def brute_text(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
    return [b for b in blocks if b]


def windows(block):
    words = block.split(" ")
    return [tuple(words[k : k + 8]) for k in range(max(1, len(words) - 7))]


def test_op7(spark):
    pages = table("pages", "page_id", "url", "html")
    count, distinct = collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for _, u, h in pages:
        host = brute_rule(u)[0]
        if h is not None and h not in distinct[host]:
            distinct[host].add(h)
            count[host].update({w for block in brute_text(h) for w in windows(block)})

    def want(u, h):
        host, blocks, kept, own = brute_rule(u)[0], brute_text(h), [], 0
        # all blocks of these pages stand inside the article container
        common = {w for w, n in count[host].items() if n >= max(3, 0.5 * len(distinct[host]))}
        for block in blocks:
            words, covered = block.split(" "), set()
            for k, w in enumerate(windows(block)):
                if w in common:
                    covered.update(range(k, k + len(w)))
            own += 2 * len(covered) < len(words)
            kept.append(block if 2 * len(covered) < len(words) else " ".join(w for k, w in enumerate(words) if k not in covered))
        text = "\n\n".join(b for b in (kept if own else blocks) if b)
        return u, text, len(text)

    assert rows(spark, "op7_html_text", "page_id", "url", "text", "n_chars") == sorted(((i, *want(u, h)) for i, u, h in pages), key=str)


def test_op8(spark):
    want = [(i, n, hit, len(items), sha(",".join(items)), hit > 0) for i, n, hit, items in brute_contamination(table("documents", "doc_id", "text"), table("benchmark", "item_id", "text"))]
    assert rows(spark, "op8_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=str)


def ids_of(name):
    tokenizer = Tokenizer.from_file(vocabulary(name))
    docs = sorted(table("documents", "doc_id", "text"))
    return {i: [*e.ids, 1] for (i, _), e in zip(docs, tokenizer.encode_batch([t or "" for _, t in docs], add_special_tokens=False), strict=True)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op9(spark):
    whole, taken, filled = ids_of("byte_bpe_50k.json"), collections.Counter(), collections.defaultdict(list)
    for i, start, length, check, n, sequence, offset in rows(spark, "op9_packing", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        assert n == len(whole[i]) and check == crc(whole[i][start : start + length])
        taken.update((i, k) for k in range(start, start + length))
        filled[sequence].append((offset, length))
    assert set(taken.values()) == {1} and len(taken) == sum(map(len, whole.values()))
    assert sorted(filled) == list(range(len(filled)))
    for pieces in filled.values():
        assert len(pieces) == 1 and pieces[0][0] == 0 and pieces[0][1] in [1 << b for b in range(12)]


def test_op10(spark):
    start, want = 0, []
    for i, ids in sorted(ids_of("word_bpe_49k.json").items()):
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert rows(spark, "op10_token_store", "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


LONG = " ".join(f"the{i} of and to in" for i in range(6000))
ODD = [(1, None, None), (2, "", "en"), (None, "the cat and the dog sat on the mat of a house", "en"), (None, None, None), (4, LONG, "en"), (4, LONG, "en"), (5, LONG, "en"), (6, "Der Hund und die Katze sind in dem Haus token=abcdef123", "de"), (6, "Der Hund und die Katze sind in dem Haus token=abcdef123", "de"), (7, "12 !?", None)]


def odd(spark, n=None):
    extra = "key long, spans string, _id long, row string, cleaned string, score double"
    frame = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 1, "x", 2, "r", "c", 0.5) for i, t, lang in ODD[:n]], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    return frame.repartition(3)


def kept(spark, stage, n=None):
    found = stage(spark, odd(spark, n), SF)
    assert found.columns == corpus_pipeline.COLUMNS
    return sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str)


def test_language_stage_on_odd_rows(spark):
    got = kept(spark, corpus_pipeline.language_id)
    texts = collections.Counter((i, t) for i, t, _ in ODD if t and re.search("[A-Za-z]", t))
    assert not collections.Counter(got) - texts and set(got) >= {(4, LONG), (5, LONG)}
    assert kept(spark, corpus_pipeline.language_id, 0) == []


def test_join_stage_on_odd_rows(spark):
    want = [(i, t) for i, t, _ in ODD]
    for gone in ((4, LONG), (5, LONG), (6, ODD[7][1])):
        want.remove(gone)
    assert kept(spark, corpus_pipeline.ngram_jaccard) == sorted(want, key=str)
    assert kept(spark, corpus_pipeline.ngram_jaccard, 0) == []


def test_decontamination_and_secret_stages_on_odd_rows(spark):
    same = sorted(((i, t) for i, t, _ in ODD), key=str)
    assert kept(spark, corpus_pipeline.decontamination) == same
    assert kept(spark, corpus_pipeline.secret_scans) == sorted(((i, t and t.replace("token=abcdef123", "[secret]")) for i, t in same), key=str)
    assert kept(spark, corpus_pipeline.decontamination, 0) == kept(spark, corpus_pipeline.secret_scans, 0) == []


def test_packing_stage_on_odd_rows(spark):
    found = corpus_pipeline.power_of_two_packing(spark, odd(spark), SF).collect()
    firsts = collections.Counter(r["doc_id"] for r in found if r["start"] == 0)
    assert firsts == collections.Counter(i for i, _, _ in ODD)
    assert sorted(r["sequence_id"] for r in found) == list(range(len(found)))
    assert corpus_pipeline.power_of_two_packing(spark, odd(spark, 0), SF).collect() == []
