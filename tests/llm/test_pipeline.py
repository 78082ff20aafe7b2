"""Each stage against a plain version over what the stage before kept, and rows that have no text."""

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as P
from fieldtrace.llm import language as L
from fieldtrace.llm.pii import all_spans, redact
from test_decontaminate import WORD
from test_near_dups import brute_classes, shingled
from test_tokens import reference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    from fieldtrace.llm.common import written
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "1234 !!", "en", "s", 7), (-4, docs.first()["text"], None, None, 5)], docs.schema)
    steps = [docs.unionByName(extra)]
    for _, stage in P.STAGES:
        steps.append(written(stage(spark, steps[-1], SF)))
    return steps


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_columns(steps):
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[1:5])


def test_language(steps, spark):
    before, after = rows(steps[0]), rows(steps[1])
    assert set(after) <= set(before)
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert {-1, -2, -3} <= gone and len(gone) <= 4
    assert all(L.has_letter(r[1]) for r in after)


def test_near_duplicates(steps):
    before, after = rows(steps[1]), rows(steps[2])
    top = brute_classes([(r[0], r[1]) for r in before])
    assert after == [r for i, r in enumerate(before) if top[i] == i or not shingled(r[1])]


def test_decontamination(steps, spark):
    def words(t):
        return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))

    wanted = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        wanted |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(w) for w in wanted}
    before = rows(steps[2])

    def clean(t):
        w = words(t)
        return not any(tuple(w[i:i + n]) in wanted for n in sizes for i in range(len(w) - n + 1))

    assert rows(steps[3]) == [r for r in before if clean(r[1])]


def test_personal_data(steps):
    want = [(r[0], redact(r[1], all_spans(r[1])[1]), r[2], r[3]) for r in rows(steps[3])]
    got = rows(steps[4])
    assert [r[:4] for r in got] == want and all(r[4] == len(r[1]) for r in got)
    assert not any(all_spans(r[1])[0] for r in got)


def test_packing(steps):
    ids = reference(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {r[0]: len(ids(r[1])) + 1 for r in rows(steps[4])}
    got = steps[5].toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == lengths
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    assert got.sequence_id.nunique() <= 1.1 * sum(lengths.values()) / 2048 + 2


def test_run_is_the_stages(spark, monkeypatch):
    names = []
    monkeypatch.setattr(P, "STAGES", [(n, lambda s, d, f, n=n: names.append(n) or d) for n, _ in P.STAGES])
    assert P.run(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert names == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0 and np.array_equal(docs.columns[:2], ["doc_id", "piece"])
