"""Top-k against all scores, for data on which the bounds are tight and loose."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from check_queries import canonical, connect

from fieldtrace.llm import vector_search as V
from fieldtrace.llm.queries import ORACLE_SQL, QUERIES


def brute(vectors, queries, k):
    out = []
    for q, x in queries:
        scored = sorted((-sum(int(np.floor(64 * a)) * int(np.floor(64 * b)) for a, b in zip(x, y)), i) for i, y in vectors if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("bits", [1, 3, 5, 12])
@pytest.mark.parametrize("kind", ["normal", "ties", "long", "one"])
def test_lots_against_all_scores(kind, bits):
    rng = np.random.default_rng(bits)
    n = {"normal": 700, "ties": 400, "long": 300, "one": 1}[kind]
    x = {"normal": rng.normal(0, 8, (n, 16)), "ties": rng.integers(-1, 2, (n, 3)), "long": rng.normal(0, 1, (n, 4)) ** 9 * 50,
         "one": rng.normal(0, 8, (n, 4))}[kind].astype(np.int64)
    ids = np.sort(rng.choice(10_000, n, replace=False))
    found = V.search_lot(V.ApproximationFile(x, bits), ids, x[:40], ids[:40], 7, np.full(40, -np.inf))
    for q, (s, i) in enumerate(found):
        exact = x @ x[q]
        order = [j for j in np.lexsort((ids, -exact)) if j != q][:7]
        assert i.tolist() == ids[order].tolist() and s.tolist() == exact[order].tolist()


def test_bounds_hold():
    rng = np.random.default_rng(9)
    x, q = rng.integers(-900, 900, (500, 32)), rng.integers(-900, 900, (30, 32))
    scores, error = V.ApproximationFile(x, 4).bounds(q)
    assert (np.abs(scores - q @ x.T) <= error[:, None]).all()


def test_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(0, 1, 6).tolist()) for i in range(60)] + [(7, [0.5] * 6), (200, [1.0, 2.0]), (201, [])]
    odd = [(100, None), (120, [1.0, None]), (140, [float("nan")] * 6), (160, [float("inf")] * 6), (None, [1.0] * 6)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in good + odd], "vec_id long, embedding array<float>, v string, score int").repartition(3)
    as_float = [(i, [float(np.float32(x)) for x in v]) for i, v in good]
    queries = frame.where("vec_id % 20 = 0")
    want = brute(as_float, [x for x in as_float if x[0] % 20 == 0], 5)
    assert sorted(map(tuple, V.top_inner_products(frame, queries, 5).collect())) == want
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, V.top_inner_products(frame, queries, 5).collect())) == want
    assert V.top_inner_products(frame.limit(0), queries, 5).count() == 0
    assert V.top_inner_products(frame, queries.limit(0), 5).count() == 0
    assert V.top_inner_products(frame.where("vec_id = 20"), frame.where("vec_id = 20"), 5).count() == 0
    assert V.top_inner_products(frame, queries, 100).where("query_id = 0").count() == len(good) - 1


def test_large_numbers(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(0, 1, 4) * 10.0 ** rng.choice([0, 0, 0, 3, 9, 15, 200])).tolist()) for i in range(80)] + [(81, [1e15, 1.0]), (82, [1e15, -1.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = frame.where("vec_id % 4 = 0")
    whole = lambda x: int(x * 64) if abs(x * 64) >= 2**53 else int(np.floor(x * 64))
    want = []
    for q, x in [r for r in rows if r[0] % 4 == 0]:
        scored = sorted((-sum(whole(a) * whole(b) for a, b in zip(x, y)), i) for i, y in rows if i != q)
        want += [(q, r, i, max(-2**63, min(2**63 - 1, -s))) for r, (s, i) in enumerate(scored[:6], 1)]
    assert sorted(map(tuple, V.top_inner_products(frame, queries, 6).collect())) == sorted(want)


def test_few_exact_vectors_are_read(spark, monkeypatch):
    """The written cells decide which exact vectors are read."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 20, (3000, 16)).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(x.astype(float).tolist())], names=["id", "v"])
    lots = list(V._lots(16, V.BITS)([batch]))
    assert sum(b.column("cells")[0].as_buffer().size for b in lots) == x.size and {b.column("bytes")[0].as_py() for b in lots} <= {1, 2}
    read = []
    real = V.ApproximationFile.exact
    monkeypatch.setattr(V.ApproximationFile, "exact", lambda self, rows, q: read.append(len(rows)) or real(self, rows, q))
    out = pa.Table.from_batches(V._searcher(np.arange(20), x[:20], 5, V.BITS, False)(iter(lots)))
    for q in range(20):
        exact = x @ x[q]
        order = [j for j in np.lexsort((np.arange(3000), -exact)) if j != q][:5]
        got = out.filter(pa.compute.equal(out["query_id"], q))
        assert sorted(got["vec_id"].to_pylist()) == sorted(order)
    assert sum(read) < 20 * 3000 / 20


def test_order_of_scores():
    values = [0, 1, -1, 9, 10, 11, -9, -10, -11, 10**30, -10**30, 99, 100]
    assert sorted(values, key=V._order) == sorted(values, reverse=True)


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = QUERIES["op3_vector_search"](spark, sf)
    cur = connect(sf).execute(ORACLE_SQL["op3_vector_search"])
    assert canonical(df.collect(), df.columns) == canonical(cur.fetchall(), [c[0] for c in cur.description])
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
