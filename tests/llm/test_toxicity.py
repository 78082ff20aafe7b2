"""Marginals against all paths written out, held-out quality, and rows without text."""

import itertools
import zlib

import numpy as np
import pyarrow as pa

from fieldtrace.llm import toxicity as X
from fieldtrace.llm.queries import QUERIES

CLEAN, BAD = "the cat sat on a mat with the dog", "you idiot cat sat on the mat scumbag"


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(2)
    step, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    lengths = np.array([1, 3, 5])
    unary = rng.normal(size=(3, 5))
    forward, backward, norm = X.marginals(unary, lengths, step, start)
    for r, n in enumerate(lengths):
        weight = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            s = start[path[0]] + sum(unary[r, i] for i in range(n) if path[i]) + sum(step[a, b] for a, b in zip(path, path[1:]))
            weight[path] = np.exp(s)
        total = sum(weight.values())
        assert np.isclose(norm[r], np.log(total))
        for t in range(n):
            want = sum(w for p, w in weight.items() if p[t]) / total
            got = np.exp(forward[t, r] + backward[t, r] - norm[r])
            assert np.isclose(got[1], want) and np.isclose(got.sum(), 1)


def test_vocabulary_finds_its_keys_alone():
    rng = np.random.default_rng(3)
    keys = rng.integers(1, 1 << 63, 500).astype(np.uint64)
    v = X.Vocabulary(keys)
    assert (v.keys[v.find(keys)] == keys).all() and (v.find(keys + np.uint64(1)) == len(v.keys)).all()
    assert (X.Vocabulary(keys[:0]).find(keys) == 0).all()


def test_spans_and_scores():
    texts = [CLEAN + f" {i}" for i in range(40)] + [BAD + f" {i}" for i in range(40)]
    tagger = X.train(texts, np.repeat([0, 1], 40))
    text = "é " + BAD.upper()
    score, spans = X.score_texts(tagger, pa.array([CLEAN, text, None, "", "x " * 100_000 + "idiot", "idiotic scumbags"]))
    data = text.encode()
    assert [data[s:e].split()[-1] for s, e in spans[1]] == [b"IDIOT", b"SCUMBAG"] and spans[0] == spans[2] == spans[3] == []
    assert score[1] > 0.7 and score[0] < 0.3 and score[2] == score[3] < 0.3 and score[4] > 0.5
    assert X.train(texts[:40], np.zeros(40)) is None and X.train([], np.zeros(0)) is None


def test_odds_are_those_of_the_whole_chain():
    rng = np.random.default_rng(4)
    for trial in range(60):
        keys = 30
        tagger = X.Tagger(X.Vocabulary(np.arange(1, keys + 1, dtype=np.uint64)), np.append(rng.normal(size=keys) * 4, 0), float(rng.normal() - 2),
                          rng.normal(size=(2, 2)) * (1 + trial % 3), rng.normal(size=2), np.zeros(3))
        sizes = rng.integers(0, [6, 40, 400][trial % 3], 12)
        found = np.where(rng.random((sizes.sum(), 4)) < rng.choice([0, 0.01, 0.3]), rng.integers(0, keys, (sizes.sum(), 4)), keys)
        bounds = np.append(0, np.cumsum(sizes))
        got = X.token_odds(tagger, found, bounds)
        for low, high in zip(bounds[:-1], bounds[1:]):
            unary = tagger.weights[found[low:high]].sum(axis=1) + tagger.bias
            want = X._log_odds(*X.marginals(unary[None, :], np.array([high - low]), tagger.step, tagger.start)[:2])[0] if high > low else []
            assert np.allclose(got[low:high], want, rtol=1e-7, atol=1e-7)
        top, count, _ = X._document_numbers(tagger, found, np.repeat(np.arange(12), sizes), 12)
        for i, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
            odds = got[low:high]
            assert np.isclose(top[i], odds.max() if len(odds) else tagger.start[1] + tagger.bias - tagger.start[0])
            assert np.isclose(count[i], (1 / (1 + np.exp(-odds[odds > 0]))).sum())


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op9_toxicity"](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(k).encode()) % 3 == 1 for k in got.doc_id]).all()
    known = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    out = known[known.held_out]
    order = out.score.rank()
    bad = out.toxic == 1
    area = (order[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert area > 0.95 and out.predicted[bad].mean() > 0.75 and out.predicted[~bad].mean() < 0.01


def test_odd_rows(spark):
    rows = [(i, CLEAN + f" {i}") for i in range(30)] + [(i, BAD + f" {i}") for i in range(30, 60)]
    rows += [(100, None), (101, ""), (None, BAD), (30, BAD + " 30"), (102, "…")]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, toxic int, spans string")
    labels = spark.createDataFrame([(i, int(i >= 30), 9) for i in range(60)] + [(None, 1, 9), (5, None, 9), (101, 0, 9)],
                                   "doc_id long, toxic int, quality int")
    tagger = X.fit_tagger(docs, labels)
    got = X.score_toxicity(docs, tagger)
    assert got.count() == len(rows) and got.columns == ["doc_id", "text", "toxic", "score", "spans"]
    assert all((r.score > 0.7) == (r.text or "").startswith(BAD) for r in got.collect())
    assert X.fit_tagger(docs, labels.limit(0)) is None and X.fit_tagger(docs.limit(0), labels) is None
    assert {r.score for r in X.score_toxicity(docs, None).collect()} == {0.0}
    assert X.score_toxicity(docs.limit(0), tagger).count() == 0
