"""Language-model scores, periodic runs and hard negatives against plain Python."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleaner.llm import hard_negatives, lm_score, periodic, queries

SF = "/root/testdata/sf0.001"


def table(name, *columns):
    found = pq.read_table(f"{SF}/{name}.parquet").to_pydict()
    return list(zip(*(found[c] for c in columns), strict=True))


# -- periodic runs ---------------------------------------------------------------------------------


def brute_runs(words):
    """Every maximal stretch of each period, smallest period first."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(6, 4 * p):
                found.setdefault((start, i + p - start), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    rng = random.Random(5)
    for turn in range(1500):
        kind = turn % 5
        if kind == 0:
            words = [rng.randrange(2) for _ in range(rng.randrange(80))]
        elif kind == 1:
            words = [rng.randrange(4) for _ in range(rng.randrange(60))]
        elif kind == 2:  # repeats of repeats
            unit = [rng.randrange(2) for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 7) + [rng.randrange(3)]
            words = unit * rng.randrange(1, 7) + [1] * rng.randrange(8)
        elif kind == 3:
            words = [0] * rng.randrange(120)
        else:
            words = [x for _ in range(6) for x in [rng.randrange(50) for _ in range(rng.randrange(1, 20))] * rng.choice([1, 1, 3, 4, 5])]
        assert periodic.periodic_runs(np.array(words, np.int32)) == brute_runs(words), words


def test_very_long_texts_take_seconds():
    words = np.zeros(400_000, np.int32)
    assert periodic.periodic_runs(words) == [(0, 400_000, 1)]
    words = np.tile(np.random.default_rng(1).integers(0, 1 << 30, 90_000).astype(np.int32), 5)
    assert periodic.periodic_runs(words) == [(0, 450_000, 90_000)]
    fib = [np.array([0], np.int32), np.array([0, 1], np.int32)]
    while len(fib[-1]) < 100_000:
        fib.append(np.concatenate([fib[-1], fib[-2]]))
    assert periodic.periodic_runs(fib[-1]) == []  # its exponents stay below four


def test_runs_of_odd_rows(spark):
    texts = [None, "", "  ", "a a a a a a b", "x " * 3, "A a A a A a A a", "é e " * 7, "a\x0bb\x0ca b a b a b"]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(3, "a a a a a a b", "k"), (None, "z z z z z z", "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(spark, frame).collect()), key=str)
    want = []
    for i, t, _ in rows:
        words = (t or "").encode().split()
        want.append((i, len(words), brute_runs(words), kept(words).decode()))
    assert got == sorted(want, key=str)
    assert ("a b" in [r[3] for r in got]) and periodic.find_runs(spark, frame.limit(0)).collect() == []


def kept(words):
    gone = {i for s, n, q in brute_runs(words) for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_op12(spark):
    want = []
    for doc, text in table("documents", "doc_id", "text"):
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = periodic.periodic_runs(periodic.numbered(words)) if n > 1500 else brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((doc, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF).select(*names).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[1] > 0 for r in want) >= 5


# -- language-model scores -------------------------------------------------------------------------


def brute_scores(docs, train, deleted, order):
    """docs: [(id, text)]. Weights by the same rule from exact ratios, counts by plain dictionaries."""
    tokens = [((t or "").encode().lower()).split() + [b"</s>"] for _, t in docs]
    pad = [b"<s>"] * (order - 1)

    def count(rows):
        found = collections.Counter()
        for k in rows:
            seq = pad + tokens[k]
            for i in range(len(pad), len(seq)):
                for n in range(1, order + 1):
                    found[tuple(seq[i - n + 1 : i + 1])] += 1
            for n in range(1, order):
                found[tuple(pad[-1:] * n)] += 1
        total = sum(c for g, c in found.items() if len(g) == 1 and g != (b"<s>",))
        return found, total, sum(len(g) == 1 and g != (b"<s>",) for g in found)

    def bucket(c):
        return 0 if c == 0 else min(63, 1 + math.floor(2 * math.log2(c)))

    def mixed(seq, i, found, n, v, weights):
        p = 1 / (v + 1)
        for level, w in enumerate(weights, 1):
            context = n if level == 1 else found[tuple(seq[i - level + 1 : i])]
            if context:
                lam = w[0 if level == 1 else bucket(context)]
                p = lam * found[tuple(seq[i - level + 1 : i + 1])] / context + (1 - lam) * p
        return p

    main, n_main, v_main = count([k for k in range(len(docs)) if train[k] and not deleted[k]])
    weights = []
    for level in range(1, order + 1):
        ratios = collections.defaultdict(list)
        for k in range(len(docs)):
            if train[k] and deleted[k]:
                seq = pad + tokens[k]
                for i in range(len(pad), len(seq)):
                    context = n_main if level == 1 else main[tuple(seq[i - level + 1 : i])]
                    if context:
                        ratios[0 if level == 1 else bucket(context)].append(main[tuple(seq[i - level + 1 : i + 1])] / context / mixed(seq, i, main, n_main, v_main, weights))
        learned = {}
        for b, rs in ratios.items():
            lam, rs = 0.5, np.array(rs)
            for _ in range(200):
                lam = min(max((lam * rs / (lam * rs + 1 - lam)).mean(), 1e-4), 1 - 1e-4)
            learned[b] = lam
        weights.append([learned[min(learned, key=lambda x: (abs(x - b), x))] if learned else 0.5 for b in range(64)])
    every, n, v = count([k for k in range(len(docs)) if train[k]])
    out = []
    for (doc, _), words in zip(docs, tokens, strict=True):
        base = sum(math.log10((every[(w,)] + 1) / (n + v + 1)) for w in words)
        seq = pad + words
        out.append((doc, len(words), sum(every[(w,)] > 0 for w in words), n, base, sum(math.log10(mixed(seq, i, every, n, v, weights)) for i in range(len(pad), len(seq)))))
    return out


@pytest.mark.parametrize("order,block", [(1, 1 << 20), (2, 300), (3, 2000)])
def test_scores_against_plain_python(spark, order, block):
    docs = [(i, t) for i, t in table("documents", "doc_id", "text") if len(t or "") < 3000] + [(9001, None), (9002, ""), (None, "the cat")]
    frame = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double").repartition(5)
    keys = {r[0]: r[1] for r in frame.select("doc_id", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0).collect()}
    want = brute_scores(docs, [d is None or d % 7 != 2 for d, _ in docs], [keys[d] for d, _ in docs], order)
    found = lm_score.score_texts(spark, frame, F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True)), order=order, block_tokens=block)
    got = {r["doc_id"]: tuple(r) for r in found.collect()}
    assert found.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and len(got) == len(docs)
    for row in want:
        assert got[row[0]][:4] == row[:4]
        assert got[row[0]][4] == pytest.approx(row[4], rel=1e-9)
        assert got[row[0]][5] == pytest.approx(row[5], rel=0.02)  # weights come from binned ratios


def test_scores_of_odd_tables(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    rows = lm_score.score_texts(spark, frame, F.lit(False)).collect()
    assert sorted(tuple(r)[:4] for r in rows) == [(1, 3, 0, 0), (1, 3, 0, 0), (2, 1, 0, 0)] and all(r["score"] == r["base_score"] == 0 for r in rows)
    assert lm_score.score_texts(spark, frame.limit(0), F.lit(True)).collect() == []
    taught = lm_score.score_texts(spark, frame, F.lit(None).cast("boolean") | (F.col("doc_id") == 1)).collect()
    assert {r["n_known"] for r in taught} == {3, 1} and all(r["score"] < 0 for r in taught)


def test_op11(spark):
    docs = table("documents", "doc_id", "text")
    counts = collections.Counter(w for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2 for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_lm_score"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        words = [*(t or "").encode().lower().split(), None]
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(d).encode()) % 7 == 2, len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


# -- hard negatives --------------------------------------------------------------------------------


def brute_negatives(rows, is_anchor):
    seen, out = [], []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (i, label, tuple(v)) not in seen:
            seen.append((i, label, tuple(v)))
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in seen]
    for i, label, v in whole:
        if not is_anchor(i):
            continue
        scores = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in whole if j != i and len(w) == len(v)]
        order = sorted(scores, key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in order if s[2] == label][:5]:
            fits = [s for s in order if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(i, j, r, s[1], p, s[0]) for r, s in enumerate(fits, 1)]
    return out


def test_hard_negatives_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * rng.choice([0.1, 1, 5])], int(rng.integers(0, 4))) for i in range(300)]
    rows += [(400 + k, [1.0, 1.0, 0.0, 0.0], k % 3) for k in range(30)]  # ties
    rows += [(500, [0.0] * 4, 1), (501, None, 1), (502, [1.0, None, 0.0, 0.0], 1), (503, [math.inf, 0.0, 0.0, 0.0], 1), (504, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    rows += [(505, [1.0, 2.0], 1), (510, [2.0, 1.0], 1), (515, [1.0, 0.5], 2), (510, [2.0, 1.0], 1), rows[5], rows[5]]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, label int, rank int").repartition(4)
    monkeypatch.setattr(hard_negatives, "FIRST_BUCKETS", 2)
    found = hard_negatives.mine_hard_negatives(spark, frame, F.col("vec_id") % 5 == 0, bucket_rows=16, block_rows=20)
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(brute_negatives(rows, lambda i: i % 5 == 0)) and len(got) > 200
    assert hard_negatives.mine_hard_negatives(spark, frame.limit(0), F.lit(True)).collect() == []
    assert hard_negatives.mine_hard_negatives(spark, frame, F.lit(False)).collect() == []
