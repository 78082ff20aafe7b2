"""The network's gradient by differences, held-out accuracy, and rows without text."""

import numpy as np
import pytest
import zlib

from fieldtrace.llm import language as L
from fieldtrace.llm.common import flat_text
from fieldtrace.llm.queries import QUERIES


def test_windows_cover_every_byte():
    import pyarrow as pa
    texts = ["", "a" * 256, None, "é" * 200, "b" * 700]
    made, row, used = L.windows_of(*flat_text(pa.array(texts)))
    for i, t in enumerate(texts):
        data = b"".join(w[:n].tobytes() for w, r, n in zip(made, row, used) if r == i)
        assert data == (t or "").encode()
    assert all((w[n:] == 0).all() for w, n in zip(made, used))


def test_answers_are_those_of_a_plain_convolution():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, (5, L.WINDOW)).astype(np.uint8)
    net = L.train(windows, list("abaab"), epochs=1)
    w = windows[0]
    want = []
    for f in range(net.filters.shape[1]):
        taps = net.filters[:, f].reshape(-1, L.DIMENSIONS)
        want.append(max(sum(net.vectors[w[i + j]] @ taps[j] for j in range(len(taps))) for i in range(L.WINDOW - len(taps) + 1)))
    hidden = np.maximum(np.array(want) + net.shift, 0)
    z = hidden @ net.out + net.bias
    assert np.allclose(L.log_probabilities(net, windows)[0], z - np.log(np.exp(z).sum()), atol=1e-3)
    narrow = net.filters.reshape(len(L.WIDTHS) and max(L.WIDTHS), L.DIMENSIONS, -1)
    assert (narrow[2:, :, :L.FILTERS] == 0).all()


@pytest.fixture(scope="module")
def predictions(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    return QUERIES["op7_language"](spark, sf).toPandas().merge(docs, on="doc_id")


def test_held_out_accuracy(predictions):
    p = predictions
    assert (p.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in p.doc_id]).all()
    out = p[p.held_out]
    assert len(out) > 100 and (out.lang == out.lang_pred).mean() > 0.97
    assert p.score.between(0, 1).all()


def test_odd_rows(spark):
    rows = [(i, t, g, 1) for i, (t, g) in enumerate([
        ("the cat and the dog sat here", "en"), ("der hund und die katze sind da", "de")] * 20)]
    rows += [(100, None, "en", 1), (101, "", "de", 1), (102, "123 !!", "en", 1), (103, "x" * 300_000, None, 1), (None, "und die katze", "de", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    net = L.fit_language_network(docs)
    got = L.predict_language(docs, net)
    assert sorted(got.columns) == ["doc_id", "lang", "lang_pred", "score", "text"]
    by = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    assert got.count() == len(rows)
    assert by[100] == by[101] == by[102] == ("und", 0.0) and by[0][0] == "en" and by[1][0] == "de" and by[None][0] == "de"
    assert L.predict_language(docs.limit(0), net).count() == 0
    assert L.fit_language_network(docs.limit(0)) is None
    assert {r.lang_pred for r in L.predict_language(docs, None).collect()} == {"und"}
