"""Joins, archives, page text, decontamination, packing and token files against brute force."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import decontaminate, html_text, ngram_join, packing, token_store, warc
from gleaner.llm.scratch import Scratch
from gleaner.llm.tokens import WordEncoder, vocabulary

DOC = "doc_id long, text string, class string, id long, rep string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def near_copies(rng, n, length, edits):
    base = [f"w{rng.randrange(3000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def odd_texts():
    rng = random.Random(5)
    line = " ".join(f"common{i}" for i in range(30))
    texts = [None, "", " \t\n", "one", "one", "One two", "a b c d e", "A B C D E", "a\x0bb\x0cc d e", line, line + " x", "é É ü\x00z k"]
    texts += near_copies(rng, 60, 90, 7) + near_copies(rng, 25, 40, 3) + [near_copies(rng, 1, 30, 1)[0] + " " + line for _ in range(20)]
    texts += [texts[12]] * 15 + [" ".join(f"long{i % 977}" for i in range(30_000))] * 2
    return texts


def brute_components(texts):
    sets = {}
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    root, links = {i: i for i in sets}, collections.Counter()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                links[a] += 1
                links[b] += 1
                root[max(top(a), top(b))] = min(top(a), top(b))
    return sorted((i, len(sets[i]), top(i), links[i]) for i in sets)


@pytest.mark.parametrize(("group_size", "hot_sets"), [(128, 1 << 16), (4, 8)])
def test_ngram_join(spark, group_size, hot_sets):
    texts = list(enumerate(odd_texts()))
    random.Random(2).shuffle(texts)
    frame = spark.createDataFrame([(i, t, "c", 1, "r") for i, t in texts], DOC).repartition(5)
    got = ngram_join.jaccard_components(spark, frame, group_size=group_size, buckets=1 << 14, broadcast_rows=10**6 if group_size > 4 else 0, hot_sets=hot_sets)
    assert sorted(map(tuple, got.collect())) == brute_components(texts)


def test_ngram_join_of_odd_rows(spark):
    frame = spark.createDataFrame([(None, "a b c d e f", "c", 1, "r"), (4, "a b c d e f", "c", 1, "r"), (4, "a b c d e f", "c", 1, "r"), (2, "A b c d e f", "c", 1, "r")], DOC)
    got = ngram_join.jaccard_components(spark, frame).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in got) == [(-1, 2, -1), (2, 2, 2), (4, 2, 2), (4, 2, 2)]
    assert ngram_join.jaccard_components(spark, frame.limit(0)).collect() == []


def test_rows_that_repeat_an_id_are_one_document(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(5, one), (5, two), (5, two), (5, ""), (3, one + " end"), (9, two + " end"), (9, three), (12, three), (20, two), (30, None), (4, "other words only here now")]
    frame = spark.createDataFrame([(i, t, "c", 1, "r") for i, t in rows], DOC)
    for group_size in (128, 1):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(spark, frame, group_size=group_size).collect())
        assert got == [(3, 37, 3, 1), (4, 1, 4, 0), (5, 0, 3, 0), (5, 36, 3, 1), (5, 36, 3, 2), (5, 36, 3, 2), (9, 36, 3, 1), (9, 37, 3, 2), (12, 36, 3, 1), (20, 36, 3, 2), (30, 0, 30, 0)]


PAGES = "page_id long, url string, html string, digest string, first long"


def test_warc_round_trip(spark):
    long = "<p>é🙂" + "x" * 200 + "</p>"
    rows = [(5, "http://a/", long), (3, "http://b/ \r\nX: y", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "y" * 300_000), (8, "u", "\r\n\r\n" * 60), (8, "u", "\r\n\r\n" * 60), (None, "n", long)]
    frame = spark.createDataFrame([(*r, "d", 0) for r in rows], PAGES)
    folder = Scratch(spark, "t").path("warc")
    index = warc.write_archives(spark, frame, folder)
    got = warc.read_archives(index, folder).collect()
    joined = warc.write_archives(spark, frame, folder + "1", broadcast_rows=0)
    assert sorted(warc.read_archives(joined, folder + "1").drop("payload").collect(), key=str) == sorted((r[:6] for r in got), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min([j for j, _, h in rows if (h or "") == (html or "") and j is not None], default=None)
        revisit = len(raw) >= 100 and i is not None and first != i
        want.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(want)
    some = warc.read_archives(index.where("page_id = 7"), folder).collect()
    assert [(r["page_id"], len(r["payload"])) for r in some] == [(7, 300_000)]
    assert warc.read_archives(warc.write_archives(spark, frame.limit(0), folder + "0"), folder + "0").collect() == []


def test_ranges_are_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (40, 5), (200, 5)], gap=30, most=100) == [(0, 45, 3), (200, 205, 1)]
    assert warc.coalesced([(0, 90), (90, 20)], gap=30, most=100) == [(0, 90, 1), (90, 110, 1)]


ARTICLE = """<html><head><title>No</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Home<li>News</ul></nav>
<div class="cookie-notice">Accept</div><article><header><h1>Big  &amp;
 title</h1></header><p>One <b>bold</b>word<br>two&nbsp;three<p>Second <a href="a>b">link</a> &eacute;
<script>var x = "</p><p>no";</script><aside>Side</aside><div class="ad">Buy</div><blockquote>Quote</blockquote></article>
<form>Name <input></form><section id="comments"><p>First!</p></section><footer>Foot</footer></body></html>"""


def test_page_text(spark):
    menu = " ".join(f"menu{i}" for i in range(12))
    plain = [f"<body><p>{menu}</p><p>only{i} this{i} page{i}</p><p>{menu} tail{i}</p></body>" for i in range(3)]
    rows = [(1, "http://a/1", ARTICLE), (2, "http://a/2", None), (3, "http://a/3", ""), (4, None, "just text"), (5, "http://a/5", "<article><p>cut off <b>here"), (1, "http://a/1", ARTICLE)]
    rows += [(10 + i, f"http://B.org/{i}", p) for i, p in enumerate(plain)] + [(20, "http://c/", plain[0]), (21, "http://d/", "<article>" + "<p>long words here</p>" * 20_000)]
    frame = spark.createDataFrame([(*r, "d", 0) for r in rows], PAGES.replace("digest", "host"))
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract_text(spark, frame).collect())
    article = "Big & title\n\nOne boldword two three\n\nSecond link é\n\nQuote"
    assert got[:2] == [(1, article)] * 2
    texts = dict(got)
    assert (texts[2], texts[3], texts[4], texts[5]) == ("", "", "just text", "cut off here")
    assert [texts[10 + i] for i in range(3)] == [f"only{i} this{i} page{i}\n\ntail{i}" for i in range(3)]
    assert texts[20] == f"{menu}\n\nonly0 this0 page0\n\n{menu} tail0"
    assert texts[21].count("long words here") == 20_000
    assert html_text.extract_text(spark, frame.limit(0)).collect() == []


def page_texts(spark, pages, **how):
    frame = spark.createDataFrame([(i, f"http://h/{i}", p, "d", 0) for i, p in pages], PAGES)
    return sorted((r["page_id"], r["text"]) for r in html_text.extract_text(spark, frame, **how).collect())


def test_repeated_blocks_leave_containers_and_unique_ones_outside_stay(spark):
    share = " ".join(f"share{i}" for i in range(10))
    pages = [(i, f"<article><p>{share}</p><p>own{i} text{i} here</p><p>Tell a friend</p></article><p>more of {i}</p>") for i in range(4)]
    assert page_texts(spark, pages) == [(i, f"own{i} text{i} here\n\nmore of {i}") for i in range(4)]


def test_inside_a_container_half_of_the_pages_must_have_a_run(spark):
    line = " ".join(f"line{i}" for i in range(9))
    pages = [(i, f"<article><p>own{i} words</p>{f'<p>{line}</p>' * (i % 3 == 0)}</article>{f'<p>{line}</p>' * (i % 3 == 0)}") for i in range(9)]
    assert page_texts(spark, pages) == [(i, f"own{i} words" + f"\n\n{line}" * (i % 3 == 0)) for i in range(9)]


def test_shards_do_not_change_page_text(spark):
    rng = random.Random(8)
    notes = [" ".join(f"note{k}x{i}" for i in range(9)) for k in range(6)]
    pages = []
    for i in range(40):
        some = [notes[k] for k in range(6) if i % (k + 1) == 0]  # on 40, 20, 14, 10, 8 and 7 pages
        pages.append((i, "".join(f"<p>{b}</p>" for b in [*some, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))])))
    pages += pages[:5]
    one = page_texts(spark, pages)
    assert page_texts(spark, pages, shard_chars=700) == page_texts(spark, pages, shard_chars=5000, broadcast_rows=0) == one
    assert [sum(n in t for _, t in one) for n in notes] == [0, 0, 0, 0, 8 + 1, 7 + 1]


def test_pieces_do_not_change_common_runs():
    rng = random.Random(7)
    pages = [html_text.block_codes([" ".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(rng.randrange(6))], 4) for _ in range(60)]
    one, some = (dict(zip(*(x.tolist() for x in html_text.common_runs(pages, 4, 0.2, n)), strict=True)) for n in (10**6, 200))
    assert one == some and one


def test_copies_and_quotes_stay(spark):
    quote, article = (" ".join(f"{w}{i}" for i in range(n)) for w, n in (("quote", 20), ("word", 300)))
    copies = [(1, f"<p>{article}</p>"), (1, f"<p>{article}</p>"), (2, f"<p>{article}</p>")]
    assert page_texts(spark, copies) == [(i, article) for i in (1, 1, 2)]
    near = [(i, f"<p>{article} end{i}</p>") for i in range(4)]
    assert page_texts(spark, near) == [(i, f"{article} end{i}") for i in range(4)]
    quoted = [(i, "<p>" + " ".join(f"p{i}a{k}" for k in range(15)) + f" {quote} " + " ".join(f"p{i}b{k}" for k in range(15)) + "</p>") for i in range(4)]
    assert page_texts(spark, quoted) == [(i, p[3:-4]) for i, p in quoted]


@pytest.mark.parametrize("size", [30, 150, 900])
def test_equal_blocks_go_whatever_their_size(spark, size):
    notice = " ".join(f"notice{k}" for k in range(size))
    pages = [(i, f"<p>{notice}</p><p>{' '.join(f'a{i}w{k}' for k in range(40))}</p>") for i in range(20)]
    assert page_texts(spark, pages) == [(i, p.split("</p><p>")[1].removesuffix("</p>")) for i, p in pages]
    near = [(i, f"<h1>{notice}</h1><p>{notice} end{i}</p>") for i in range(8)]
    assert page_texts(spark, near) == [(i, f"{notice}\n\n{notice} end{i}") for i in range(8)]


def test_common_runs_match_brute_force():
    rng = random.Random(9)
    for _ in range(30):
        pages = [[" ".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(rng.randrange(4))] for _ in range(8)]
        coded = [html_text.block_codes(p, 4) for p in pages]
        found = dict(zip(*(x.tolist() for x in html_text.common_runs(coded, 4, 0.4)), strict=True))
        padded = [[(*b.split(" "), *[""] * (4 - len(b.split(" ")))) for b in p] for p in pages]
        runs = [{b[i : i + 4] for b in p for i in range(len(b) - 3)} for p in padded]
        count = collections.Counter(r for p in runs for r in p)
        number = {r: int(html_text.window_hashes(html_text.block_codes([" ".join(r).strip()], 4)[0], np.array([4]), 4)[0][0]) for r in count}
        assert found == {number[r]: n for r, n in count.items() if n >= 0.4 * len(pages)}


MARKED = """<body><article class="post category-social"><h1>Head</h1><div class="social-history"><p>The social history of the town</p></div><ul><li>kept item<li class="reply"><p>a reader's reply</p><li>last item</ul>
<ol class="comment-list"><li>nice!</li></ol><div class="AdSlot">buy</div><p>end</p></article><article class="teaser"><p>another story</p></article><div class="share-buttons">tell all</div></body>"""


def test_marks_are_whole_names():
    kept = [t for t, _, side in html_text.blocks_of(MARKED) if not side]
    assert kept == ["Head", "The social history of the town", "kept item", "last item", "end"]


def test_long_tokens(spark):
    pages = [(i, f"<article><p>{'x' * 100_000}{i}</p><p>short {i}</p></article>") for i in range(4)]
    assert page_texts(spark, pages) == [(i, f"{'x' * 100_000}{i}\n\nshort {i}") for i in range(4)]


def test_fm_index_matches_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(25):
        text = rng.integers(0, 5, rng.integers(1, 300))
        index = decontaminate.FMIndex(text, 4)
        phrases, lengths = rng.integers(1, 5, (20, 4)), rng.integers(1, 5, 20)
        lo, hi = index.ranges(phrases, lengths)
        for k, n in enumerate(lengths):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == phrases[k, :n]).all()]
            assert sorted(index.locate(np.arange(lo[k], max(lo[k], hi[k]))).tolist()) == want


def brute_contamination(docs, items):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(word, lower(t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    out = []
    for i, t in docs:
        w = re.findall(word, lower(t or ""))
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [1] * n
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), sum(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("block_chars", [8_000_000, 150])
def test_decontamination(spark, block_chars):
    rng = random.Random(4)
    passage = " ".join(rng.choice(["Alpha", "beta", "gamma", "delta", "ñu", "7"]) for _ in range(40))
    items = [(1, passage), (2, "Short item"), (3, None), (4, "--"), (12, " ".join(passage.split()[5:20])), (30, "lone")]
    docs = [(1, None), (2, ""), (3, "x " + passage.upper().replace("Ñ", "ñ") + " y"), (4, "a short-item b"), (5, passage[:60]), (6, "alpha beta " * 9), (7, "n " * 50_000 + passage), (8, "lone"), (9, "clean words only"), (10, passage)]
    frame = spark.createDataFrame([(i, t, "c", 1, "r") for i, t in docs], DOC)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = decontaminate.find_contamination(spark, frame, bench, block_chars=block_chars).collect()
    rows = sorted((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), list(r["items"])) for r in got)
    assert rows == brute_contamination(docs, items)
    assert all(a["end"] < b["start"] for r in got for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    assert {r["n_words"] > 0 and bool(r["spans"]) for r in decontaminate.find_contamination(spark, frame, bench.limit(0)).collect()} == {False}
    assert decontaminate.find_contamination(spark, frame.limit(0), bench).collect() == []


@pytest.mark.parametrize("block_chars", [8_000_000, 150])
def test_decontamination_keeps_repeated_rows(spark, block_chars):
    bench = spark.createDataFrame([(i, " ".join(f"item{i}w{k}" for k in range(12))) for i in range(5)], "item_id long, text string")
    rows = [(1, " ".join(f"item2w{k}" for k in range(12)) + " x"), (2, "clean"), (None, "null id"), (3, None)]
    bench = bench.unionByName(bench.where("item_id = 2").withColumn("text", F.concat("text", F.lit(" more")))).unionByName(bench)  # ids that recur
    frame = spark.createDataFrame([(i, t, "c", 1, "r") for i, t in rows * 3 + rows[:1]], DOC)
    kept = decontaminate.find_contamination(spark, frame, bench, block_chars=block_chars, carry=("text", "class")).collect()
    assert collections.Counter((r["doc_id"], r["text"], r["class"]) for r in kept) == collections.Counter((i, t, "c") for i, t in rows * 3 + rows[:1])
    got = decontaminate.find_contamination(spark, frame, bench, block_chars=block_chars).collect()
    found = collections.Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["spans"])), tuple(r["items"])) for r in got)
    assert found == {(1, 13, ((0, 12),), ("2",)): 4, (2, 1, (), ()): 3, (None, 2, (), ()): 3, (3, 0, (), ()): 3}


TOKEN_TEXTS = [None, "", "a", "a  b\n\n c", " lead", "It's they'll.", "x,\ty\r\nz", "é, ñ .", "3.5, 4!) ok?!", "ΟΔΟΣ. ΟΔΟΣ", "<|endoftext|> a<|endoftext|>b.", "日本語。 テスト", "x'., y", "word " * 3000, "unbroken" * 2000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cut_words_give_the_ids_of_whole_texts(name):
    rng = random.Random(6)
    texts = TOKEN_TEXTS[1:] + ["".join(rng.choices(["a", "b", " ", "\n", "'s", ",", "!", "1", "\t", "é", "\u0301", "Σ", "\xa0", "'", "<|endoftext|>"], k=rng.randint(1, 25))) for _ in range(3000)]
    words = WordEncoder(vocabulary(name), cache_bytes=5000)
    want = [np.array(e.ids, "<u4").tobytes() for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert words.cut and [x for lo in range(0, len(texts), 40) for x in words.encode(texts[lo : lo + 40])] == want


def test_packing(spark):
    rows = [(i, t) for i, t in enumerate(TOKEN_TEXTS)] + [(3, "again"), (None, "no id")]
    frame = spark.createDataFrame([(i, t, "c", 1, "r") for i, t in rows], DOC)
    got = packing.pack_power_of_two(spark, frame, vocabulary("byte_bpe_50k.json")).collect()
    encode = WordEncoder(vocabulary("byte_bpe_50k.json")).encode
    whole = collections.Counter((i, np.frombuffer(encode([t])[0], "<i4").tobytes() + struct.pack("<i", 1)) for i, t in rows)
    by_doc = collections.defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) <= 2048 and not r["length"] & (r["length"] - 1) and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<i4").tobytes())
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    joined = collections.Counter((i, b"".join(np.array(r["ids"], "<i4").tobytes() for r in sorted(rs, key=lambda r: r["start"]))) for (i, _), rs in by_doc.items())
    assert joined == whole
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    lengths = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)
    assert packing.pack_power_of_two(spark, frame.limit(0), vocabulary("byte_bpe_50k.json")).collect() == []


def test_cut_lengths():
    assert packing.cut_lengths(2500, 2048) == [2048, 256, 128, 64, 4] and packing.cut_lengths(1, 2048) == [1] and packing.cut_lengths(4096, 2048) == [2048, 2048]


def test_token_files(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TOKEN_TEXTS)] + [(3, "again"), (100, "last")]
    frame = spark.createDataFrame([(i, t, "c", 1, "r") for i, t in rows], DOC).repartition(3)
    folder = f"file://{tmp_path}/ids"
    index = token_store.write_tokens(spark, frame, vocabulary("word_bpe_49k.json"), folder, file_chars=9000, frame_tokens=100)
    got = sorted(token_store.read_tokens(index, folder).collect(), key=lambda r: r["start"])
    encode = WordEncoder(vocabulary("word_bpe_49k.json")).encode
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*np.frombuffer(encode([t])[0], "<i4").tolist(), 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()), ids))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    one = token_store.read_tokens(index.where("doc_id = 13"), folder).collect()
    assert one[0]["n_tokens"] == 3001
    none = token_store.write_tokens(spark, frame.limit(0), vocabulary("word_bpe_49k.json"), folder + "0")
    assert token_store.read_tokens(none, folder + "0").collect() == []


def test_reader_decompresses_only_what_is_asked_and_checks_it(tmp_path):
    import pyarrow.fs as pafs

    fs, path = pafs.LocalFileSystem(), str(tmp_path / "x.zst")
    out = token_store.FrameWriter(fs.open_output_stream(path, compression=None), 100)
    data = bytes(range(256)) * 4
    for lo in range(0, len(data), 33):
        out.write(data[lo : lo + 33])
    out.close()
    reader = token_store.FrameReader(fs.open_input_file(path))
    assert reader.begin[-1] == len(data) and reader.read(150, 300) == data[150:450]
    raw = bytearray(open(path, "rb").read())
    raw[-9 - 12 * 11 + 8] ^= 1  # the first frame's checksum in the table
    open(path, "wb").write(bytes(raw))
    reader = token_store.FrameReader(fs.open_input_file(path))
    assert reader.read(200, 50) == data[200:250]
    with pytest.raises(ValueError):
        reader.read(0, 5)


def test_pipeline_stages(spark):
    table = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{table}/documents.parquet"), []
    work = Scratch(spark, "t")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = work.table(str(k), stage(spark, docs, table))
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    # one document of each group stays, and clean ones are as they were
    texts = sorted(kept[0].items())
    assert sorted(kept[1]) == sorted({c for _, _, c, _ in brute_components(texts)})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{table}/benchmark.parquet").collect()]
    hits = {i: n for i, _, n, _ in brute_contamination(sorted(kept[1].items()), items)}
    assert all(kept[2][i] == t for i, t in kept[1].items() if not hits[i])
    assert all(n == 0 or i not in kept[2] or len(kept[2][i]) < len(kept[1][i]) for i, n in hits.items())
    assert set(kept[3]) == set(kept[2])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, table).collect()
    assert {r["doc_id"] for r in packed} == set(kept[3])


def test_pipeline_keeps_rows_without_id_and_one_of_equal_rows(spark):
    same, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(None, "clean one"), (None, "clean two"), (None, "clean two"), (7, same), (7, same), (8, same), (None, same), (None, near), (None, near + " end"), (9, "two texts"), (9, "of one id")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.ngram_jaccard(spark, frame, "").collect()]
    assert sum(t.startswith(near) for _, t in got) == 1
    assert sorted((str(i), t) for i, t in got if not t.startswith(near)) == [("7", same), ("9", "of one id"), ("9", "two texts"), ("None", "clean one"), ("None", "clean two")]
