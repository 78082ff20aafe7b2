"""Benchmark windows against a plain walk, and the query against its SQL."""

import re

import pytest
from check_queries import canonical, connect

from fieldtrace.llm.decontaminate import drop_contaminated, find_contamination, remove_spans
from fieldtrace.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ALPHABET = "one two three four five six seven eight nine ten eleven twelve".split()
LONG = " ".join(ALPHABET)
DOCS = [
    (1, f"Start {LONG.upper()}, end"), (2, None), (3, ""), (4, "…!"), (5, "Étude à deux, étude"), (6, f"{LONG} {LONG}"),
    (6, f"{LONG} {LONG}"), (None, "only short item here"), (None, "clean"), (7, "ten words " * 3000 + LONG), (8, "one\ttwo  three-four"),
]
ITEMS = [(1, LONG), (2, "short item"), (3, None), (4, ""), (5, "étude à deux"), (6, LONG), (None, "three four"), (10, "short item")]


def words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(text):
    w, hit, spans, items = words(text), set(), set(), set()
    for item, t in ITEMS:
        v = words(t)
        n = min(10, len(v))
        wanted = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in wanted:
                hit |= set(range(i, i + n))
                spans.add((i, n))
                items |= {str(item)} - {"None"}
    return len(w), len(hit), sorted(items), sorted(spans)


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame([(k, t, "x", "x", "x") for k, t in DOCS], "doc_id long, text string, words string, hash string, items string")
    return docs, spark.createDataFrame([(k, t, 1) for k, t in ITEMS], "item_id long, text string, spans int")


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_hits_are_those_of_a_plain_walk(frames, limit):
    docs, items = frames
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans], r.contaminated)
           for r in find_contamination(docs, items, broadcast_bytes=limit).collect()]
    want = [(k, *brute(t), brute(t)[1] > 0) for k, t in DOCS]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_contaminated_documents_go(frames):
    docs, items = frames
    assert sorted(r.text or "" for r in drop_contaminated(docs, items).collect()) == ["", "", "clean", "Étude à deux, étude", "…!"]
    assert drop_contaminated(docs, items).columns == docs.columns
    assert drop_contaminated(docs, items.limit(0)).count() == len(DOCS)
    assert drop_contaminated(docs.limit(0), items).count() == 0


def test_spans_are_cut_out(frames):
    docs, items = frames
    got = {r.doc_id: r.text for r in remove_spans(docs, items).where("doc_id is not null").collect()}
    assert got[1] == "Start end" and got[2] is None and got[5] == DOCS[4][1] and got[6] == "" and got[8] == "one\ttwo  "


@pytest.mark.parametrize("name", ["op4_benchmark_decontamination"])
def test_query_and_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, sf)
    cur = connect(sf).execute(ORACLE_SQL[name])
    assert canonical(df.collect(), df.columns) == canonical(cur.fetchall(), [c[0] for c in cur.description])


def test_windows_of_every_length_at_every_place(spark):
    import random
    rng = random.Random(4)
    letters = ["a", "B", "é", "É", "d7"]
    items = [(i, " ".join(rng.choices(letters, k=rng.choice([1, 2, 3, 4, 5, 7, 9, 10, 11, 14])))) for i in range(25)]
    docs = [(i, " - ".join(rng.choices(letters, k=rng.randint(0, 45)))) for i in range(120)]
    docs += [(200 + i, " ".join(rng.choices(letters, k=rng.randint(0, 9)) + t.split() + rng.choices(letters, k=3))) for i, t in items]
    for lengths in ({1, 2, 3}, {5, 7}, {9, 10}, {3, 10}):
        some = [(i, t) for i, t in items if min(10, len(t.split())) in lengths]
        global ITEMS
        kept, ITEMS = ITEMS, some
        want = [(k, *brute(t), brute(t)[1] > 0) for k, t in docs]
        ITEMS = kept
        got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(some, "item_id long, text string"))
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans], r.contaminated) for r in got.collect()) == sorted(want)


def test_columns_of_any_name_stay(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"zero {passage} eleven", "s", "k", 7), (2, "nothing here", "t", "l", 8), (None, None, "u", "m", 9)],
                                 "doc_id long, text string, spans string, _bad_key string, _bad_hash int")
    bench = spark.createDataFrame([(5, passage)], "item_id long, text string")
    assert sorted(map(str, drop_contaminated(docs, bench).collect())) == sorted(map(str, docs.where("doc_id IS DISTINCT FROM 1").collect()))
    got = {r.doc_id: r for r in remove_spans(docs, bench).collect()}
    assert got[1].text == "zero eleven" and (got[1].spans, got[1]._bad_key, got[1]._bad_hash) == ("s", "k", 7)
    assert got[2].text == "nothing here" and got[None].text is None
