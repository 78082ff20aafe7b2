"""Repeated strings against all windows of a small table."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from fieldtrace.llm import substrings as S
from fieldtrace.llm.common import flat_text
from fieldtrace.llm.queries import QUERIES

L = S.LENGTH


def brute(rows, keep_first):
    """rows in order -> (n_bytes, n_removed, n_spans, kept_sha256) of each."""
    seen = {}
    data = [(t or "").encode() for t in rows]
    for i, d in enumerate(data):
        for p in range(len(d) - L + 1):
            seen.setdefault(d[p:p + L], []).append((i, p))
    out = []
    for i, d in enumerate(data):
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - L + 1):
            places = seen[d[p:p + L]]
            if (places[0] != (i, p)) if keep_first else len(places) > 1:
                gone[p:p + L] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    rng = random.Random(seed)

    def text(n):
        return "".join(rng.choice("abcdeé ") for _ in range(n))

    passages = [text(n) for n in (150, 199, 200, 201, 260, 700)]
    rows = [text(rng.randint(0, 500)) for _ in range(20)]
    for _ in range(60):
        rows.append("".join(rng.choice([text(rng.randint(0, 300)), rng.choice(passages), passages[-1][rng.randint(0, 300):]]) for _ in range(rng.randint(1, 4))))
    base = text(3000)
    for _ in range(12):
        w = list(base)
        for i in rng.sample(range(3000), 4):
            w[i] = rng.choice("xyz")
        rows.append("".join(w))
    rows += ["a" * 450, "ab" * 300, "a" * 200, "a" * 199, "", None, rows[5], rows[5], passages[0] * 5, "-" * 5000]
    return rows


def test_blocks_hold_every_window_once_and_equal_windows_meet():
    rows = made(1)
    flat, bounds = flat_text(pa.array(rows, pa.string()))
    row, low, n, anchor, content = S.blocks_of(flat, bounds)
    seen, by_window = set(), {}
    for r, s, c, a in zip(row, low, n, anchor):
        d = (rows[r] or "").encode()
        for p in range(s, s + c):
            assert (r, p) not in seen and p + L <= len(d)
            seen.add((r, p))
            assert by_window.setdefault(d[p:p + L], a) == a
    assert len(seen) == sum(max(0, len((t or "").encode()) - L + 1) for t in rows)


def test_suffix_order():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1600] = data[:600]
    starts = np.arange(len(data) - L + 1)
    rank = S._windows_equal(data, starts)
    text = [data[s:s + L].tobytes() for s in starts]
    assert [sorted(set(text)).index(t) for t in text] == rank.tolist()


@pytest.mark.parametrize("seed,group,first", [(1, 2000, False), (2, 2000, True), (3, 1, False), (4, 1, True), (5, 4, False)])
def test_rows_against_all_windows(spark, monkeypatch, seed, group, first):
    monkeypatch.setattr(S, "GROUP_BLOCKS", group)
    monkeypatch.setattr(S, "SEGMENT", 900 if seed == 5 else S.SEGMENT)
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(rows)], "doc_id long, text string, anchor string, n int").repartition(5)
    got = {r.doc_id: tuple(r)[1:4] + (r.kept_sha256,) for r in S.remove_repeats(docs, keep_first=first).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows, first)


def test_query_against_all_windows(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_repeated_substrings"](spark, sf).collect()}
    assert [got[k] for k, _ in docs] == brute([t for _, t in docs], False)
    assert any(g[1] for g in got.values())


def test_odd_rows(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh ") for _ in range(500))
    rows = [(1, None), (1, ""), (None, long), (2, "short"), (2, "short"), (3, "x" + long[100:400])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in S.remove_repeats(docs, keep_first=False).collect())
    assert got == sorted([("1", 0, 0, 0), ("1", 0, 0, 0), ("None", 500, 300, 1), ("2", 5, 0, 0), ("2", 5, 0, 0), ("3", 301, 300, 1)])
    twice = spark.createDataFrame([(None, long), (None, long)], "doc_id long, text string")
    assert [r.n_removed for r in S.remove_repeats(twice, keep_first=False).collect()] == [500, 500]
    assert S.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("group", [S.GROUP_BLOCKS, 1])
def test_repeated_rows_keep_one_copy(spark, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP_BLOCKS", group)
    rng = random.Random(8)
    long, other = ("".join(rng.choice("abcdefgh ") for _ in range(500)) for _ in range(2))
    rows = [(None, other), (None, other), (None, other), (1, long), (1, long), (2, "x" + long[100:400]), (2, "x" + long[100:400]),
            (3, other[:250] + long[:300]), (3, other[:250] + long[:300]), (4, "y" * 300), (4, "y" * 300), (5, "short"), (5, "short"), (6, None), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r)[:4] + (r.kept_sha256,) for r in S.remove_repeats(docs).collect()]
    want = [(k, *b) for (k, _), b in zip(rows, brute([t for _, t in rows], True))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[0] is None and r[2] == 0 for r in got) == 1


def test_smaller_neighbours_by_walking():
    rng = np.random.default_rng(6)
    for values in [rng.permutation(n) for n in (0, 1, 2, 3, 50, 400)] + [np.arange(100), np.arange(100)[::-1]]:
        before, after = S.smaller_neighbours(values)
        for i, v in enumerate(values):
            assert before[i] == next((j for j in range(i - 1, -1, -1) if values[j] < v), -1)
            assert after[i] == next((j for j in range(i + 1, len(values)) if values[j] < v), len(values))


def test_previous_factors_are_those_of_all_pairs():
    """The source is earlier and equal; there is one whenever any earlier suffix is equal, in whatever order the suffixes come."""
    rng = np.random.default_rng(7)
    for _ in range(20):
        starts = rng.permutation(300)[:120]
        rank = rng.integers(0, 40, 120)
        source = S.previous_factors(starts, rank)
        for i in range(120):
            earlier = [j for j in range(120) if rank[j] == rank[i] and starts[j] < starts[i]]
            assert (source[i] >= 0) == bool(earlier)
            assert not earlier or source[i] in earlier


def test_flags_come_from_the_previous_factors(monkeypatch):
    data = np.frombuffer(b"".join(bytes([65 + i % 7 * 3 % 26]) * 3 for i in range(400)) * 2, np.uint8)
    args = data, np.array([0]), np.array([len(data) - S.LENGTH + 1]), np.array([1])
    elsewhere, earlier = S.repeated_windows(*args)
    assert earlier.any() and (elsewhere & ~earlier).any()
    monkeypatch.setattr(S, "previous_factors", lambda starts, rank: np.full(len(starts), -1))
    assert not S.repeated_windows(*args)[0].any()
