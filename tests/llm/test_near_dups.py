"""Classes against all pairs of a small table, estimates against exact similarities, and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldtrace.llm import near_dups as N
from fieldtrace.llm.common import flat_text
from fieldtrace.llm.components import components
from fieldtrace.llm.queries import QUERIES

WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def shingled(text):
    w = ["".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(text or "")]
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    """Probability Jaccard similarity by its definition."""
    every = set(a) | set(b)
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in every) for x in set(a) & set(b))


def brute_classes(rows):
    sets = [shingled(t) for _, t in rows]
    names = {x: n for n, x in enumerate(sorted({x for s in sets for x in s}))}
    arrays = [(np.array(sorted(names[x] for x in s)), np.array([s[x] for x in sorted(s, key=names.get)])) for s in sets]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    with_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            with_shingle.setdefault(x, []).append(i)
    for i in range(len(rows)):
        for j in {j for x in sets[i] for j in with_shingle[x] if j > i}:
            if top(i) != top(j) and N.probability_jaccard(arrays[i], arrays[j]) >= 0.8 - 1e-9:
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return [top(i) for i in range(len(rows))]


def test_similarity_is_that_of_the_definition():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (Counter({k: rng.randint(1, 5) for k in rng.sample(range(12), rng.randint(1, 9))}) for _ in "ab")
        arrays = [(np.array(sorted(c)), np.array([c[k] for k in sorted(c)])) for c in (a, b)]
        assert np.isclose(N.probability_jaccard(*arrays), similarity(a, b))


def test_registers_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(0)
    wrong = []
    for n in [1, 3, 40, 400] * 40:
        x, y = np.sort(rng.integers(0, 1 << 62, n).astype(np.uint64)), None
        y = np.unique(np.append(x[:rng.integers(0, n + 1)], rng.integers(0, 1 << 62, rng.integers(1, n + 1)).astype(np.uint64)))
        w, v = rng.integers(1, 5, len(x)), rng.integers(1, 5, len(y))
        sig = N.signatures(np.append(x, y), np.repeat([0, 1], [len(x), len(y)]), np.append(w, v), 2)
        assert (sig != 0).all()
        wrong.append((sig[0] == sig[1]).mean() - N.probability_jaccard((x, w), (y, v)))
        twice = N.signatures(x, np.zeros(len(x), int), 7 * w, 1)
        assert (twice[0] == sig[0]).all()  # only the shares of the weights count
    assert abs(np.mean(wrong)) < 0.01 and np.std(wrong) < 0.06


def test_shingles_are_those_of_the_words():
    texts = ["A b c d e a B c d e a", "one two", "", None, "…", "Éa-b c", "x " * 30_000]
    h, r, w = N.weighted_shingles(*flat_text(pa.array(texts)))
    for i, t in enumerate(texts):
        assert sorted(w[r == i]) == sorted(shingled(t).values())
    assert set(h[r == 1]) == set(N.weighted_shingles(*flat_text(pa.array(["ONE, two!"])))[0])


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()))
    group = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(100):
        for a, b in pairs:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    assert got == group
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def same_classes(got, want):
    pairs = set(zip(got, want))
    return len(pairs) == len(set(got)) == len(set(want))


def test_classes_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: r.class_id for r in QUERIES["op1_near_duplicates"](spark, sf).collect()}
    want = brute_classes(docs)
    assert [got[k] for k, _ in docs] == [docs[i][0] for i in want]
    assert len(set(want)) < len(docs)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(200)]

    def copy(n):
        w = list(base)
        for i in rng.sample(range(200), n):
            w[i] = f"v{rng.randint(0, 9999)}"
        return " ".join(w)

    rows = [(i, copy(rng.randint(0, 8))) for i in range(300)] + [(i, " ".join(base)) for i in range(300, 400)]
    rows += [(1000, None), (1001, ""), (1001, ""), (1002, "…!"), (None, "two words"), (1003, "Two, words"), (None, copy(1)), (1004, "x " * 50_000),
             (1004, "x " * 50_000), (1005, "y z"), (1006, "z y"), (None, None)]
    return rows, spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id long, text string, class_id string, bucket int")


def test_odd_rows_and_a_large_group(odd):
    rows, docs = odd
    got = N.near_duplicate_classes(docs)
    assert got.count() == len(rows)
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append(r.class_id)
    top = brute_classes(rows)
    worded = [i for i, (_, t) in enumerate(rows) if shingled(t)]
    best = {}
    for i in worded:
        if rows[i][0] is not None:
            best[top[i]] = min(best.get(top[i], 10**9), rows[i][0])
    for i, (k, t) in enumerate(rows):
        if k is not None:
            assert set(found[k]) == {best[top[i]] if shingled(t) else k}
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        [str(k) for k in best.values()] + [str(k) for k, t in rows if not shingled(t)])
    assert N.near_duplicate_classes(docs.limit(0)).count() == 0 and N.drop_near_duplicates(docs.limit(0)).count() == 0


def test_columns_of_any_name_stay_when_copies_go(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "orig", "t1"), (2, "a b c d e f", "copy", "t2"), (3, None, "none", "t3")], "doc_id long, text string, _key string, _text_key string")
    assert sorted((r.doc_id, r["_key"], r["_text_key"]) for r in N.drop_near_duplicates(docs).collect()) == [(1, "orig", "t1"), (3, "none", "t3")]


def test_differences_allowed_hold_for_all_similar_pairs():
    rng = random.Random(11)
    reached = 0
    for _ in range(3000):
        a = Counter({k: rng.choice([1, 1, 1, 2, 5]) for k in rng.sample(range(30), rng.randint(1, 30))})
        b = Counter({k: n for k, n in a.items() if rng.random() < 0.93})
        b.update({rng.randint(30, 60): rng.choice([1, 1, 3]) for _ in range(rng.randint(0, 4))})
        b = Counter({k: n * rng.choice([1, 1, 1, 2]) for k, n in b.items()})
        if b and similarity(a, b) >= 0.8:
            x, y = sum(a[k] for k in a if k not in b) / a.total(), sum(b[k] for k in b if k not in a) / b.total()
            assert similarity(a, b) <= (1 - x) * (1 - y) / (1 - x * y) + 1e-9
            assert len(set(a) ^ set(b)) <= 2 * 0.2 / 1.8 * max(a.total(), b.total()) + 1e-9
            reached += 1
    assert reached > 500


def crowd_of(rng, n):
    """Copies of one text: many too far from each other, chains that link some of them, and two groups apart from the first."""
    base = [f"w{rng.randint(0, 9999)}" for _ in range(160)]

    def edited(words, k):
        w = list(words)
        for _ in range(k):
            at = rng.randrange(len(w))
            rng.choice([lambda: w.__setitem__(at, f"v{rng.randint(0, 99999)}"), lambda: w.pop(at), lambda: w.insert(at, f"v{rng.randint(0, 99999)}")])()
        return w

    texts = [base] + [edited(base, rng.randint(1, 9)) for _ in range(n)]
    for far in (edited(base, 8), edited(base, 6)):
        texts += [far] + [edited(far, rng.randint(0, 4)) for _ in range(n // 4)]
    texts += [edited(texts[-1], 2), texts[-1] + texts[-1], base[:130], base[20:]]
    return [" ".join(w) for w in texts]


def test_pairs_of_a_crowd_are_few_and_lose_no_link(spark):
    texts = crowd_of(random.Random(12), 300)
    full = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    crowd = spark.createDataFrame([(0, i) for i in range(len(texts))], "pivot long, node long")
    h, r, w = N.weighted_shingles(*flat_text(pa.array(texts)))
    sets = [(h[r == i], w[r == i]) for i in range(len(texts))]
    links = {(i, j) for i in range(len(texts)) for j in range(i) if N.probability_jaccard(sets[i], sets[j]) >= 0.8 - 1e-9}
    group = {i: 0 for i, j in links if j == 0} | {0: 0}
    classes = spark.createDataFrame(list(group.items()), "node long, component long")
    got = {(r.b, r.a) for r in N._alike(N._differences(crowd, full), classes, 1).collect()}
    # a text of the pivot's class and one of no class, or two of none
    wanted = {(i, j) for i, j in links if group.get(i, i) != group.get(j, j)}
    assert wanted and wanted <= got
    every = sum(group.get(i, i) != group.get(j, j) for i in range(len(texts)) for j in range(i))
    assert len(got) < every / 4, (len(got), every, len(wanted))


def test_classes_of_a_crowd_against_all_pairs(spark, monkeypatch):
    texts = crowd_of(random.Random(13), 240)
    rows = list(enumerate(texts))
    compared, verified = [], N._verified

    def counted(pairs, *more):
        compared.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(N, "_verified", counted)
    got = {r.doc_id: r.class_id for r in N.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k, _ in rows] == brute_classes(rows)
    assert len(compared) <= 1 + len(N.ASKING)
