"""Spelling variants against comparing all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from fieldtrace.llm import spelling as S
from fieldtrace.llm.common import table
from fieldtrace.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_words(rows):
    count = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_deletion(words):
    """All near words of each word: two near words share a word made by deleting one letter, or one is made from the other."""
    made = {}
    for w in words:
        for v in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            made.setdefault(v, set()).add(w)
    out = {w: set() for w in words}
    for group in made.values():
        for a in group:
            out[a] |= {b for b in group if near(a, b)}
    return out


def brute(rows):
    words = brute_words(rows)
    nears = by_deletion(words)
    form = {}
    for w, n in words.items():
        if nears[w]:
            best = min(nears[w], key=lambda v: (-words[v], v))
            if words[best] >= 5 * n:
                form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(nears[w]), words[form[w]] if w in form else None)
    return out


def rows_of(df):
    got = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(out) == len(got)
    return out


def some_words(seed, size):
    rng = random.Random(seed)
    words = set()
    while len(words) < size:
        base = "".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(6, 9)))
        words.add(base)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(base))
            words.add(rng.choice([base[:at] + base[at + 1:], base[:at] + rng.choice("abcdxé") + base[at:], base[:at] + rng.choice("abcz") + base[at + 1:]]))
    return sorted(words)


def test_search_finds_every_pair_once():
    words = some_words(3, 1500)
    want = {tuple(sorted((a, b))) for a, bs in by_deletion(words).items() for b in bs}
    i, j = S.search(pa.array(words), pa.array(words), np.zeros(len(words), np.int8), 0)
    got = {tuple(sorted((words[a], words[b]))) for a, b in zip(i.tolist(), j.tolist())}
    assert got == want and len(want) > 500


def test_one_edit():
    words = ["a" * 300, "a" * 299, "a" * 298, "b" + "a" * 299, "abcabc", "abcab", "bcabc", "abxabc", "acbabc", "abcabcd", "xabcabc", "", "a"]
    flat = S._latin(pa.array(words))
    i, j = (np.ravel(x) for x in np.meshgrid(range(len(words)), range(len(words))))
    assert S._one_edit(flat, flat, i, j).tolist() == [near(words[a], words[b]) for a, b in zip(i, j)]


@pytest.mark.parametrize("limits", [(4096, 65536), (40, 64)])
def test_pairs_of_split_nodes(spark, monkeypatch, limits):
    monkeypatch.setattr(S, "NODE_WORDS", limits[0])
    monkeypatch.setattr(S, "LOT_WORDS", limits[1])
    words = some_words(4, 800) + ["".join(p) for p in ("abcnop", "nbcaop", "abcnoc")]  # letters of one group: a and n, b and o, c and p
    words += ["abcdef" + x + y for x in "abcdefghij" for y in "nopqrst"]
    words = sorted(set(words))
    want = {tuple(sorted((a, b))) for a, bs in by_deletion(words).items() for b in bs}
    got = [tuple(sorted((r.word, r.near))) for r in S.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = brute(rows)
    assert rows_of(QUERIES["op12_spelling_variants"](spark, sf)) == want
    assert sum(v[0] is not None for v in want.values()) > 10


def test_odd_rows(spark):
    word, other = "colours", "colour"
    rows = [(None, None), (1, ""), (2, "12 ;"), (None, f"{word} " * 60), (3, f"{other.upper()}, " * 11), (3, f"{other}/" * 11),
            (4, "ÀÿÀÿÀÿ " * 6), (4, "àÿÀÿÀÿ " * 40), (5, ("x" * 40000 + " ") * 5), (6, ("x" * 40001 + " ") * 30), (7, "×÷×÷×÷ " * 5), (8, "abcde " * 9)]
    want = brute(rows)
    df = spark.createDataFrame(rows, DOCS)
    assert rows_of(S.spelling_variants(df, damage=199)) == want
    assert want["colour"] == (None, "colour", 22, 1, None) and "×÷×÷×÷" in want
    clash = df.selectExpr("doc_id", "text", "1 AS word", "2 AS n", "3 AS node", "4 AS key")
    assert rows_of(S.spelling_variants(clash, damage=199)) == want
    assert rows_of(S.spelling_variants(df.limit(0))) == {}


def test_chain_of_forms(spark):
    rows = [(0, "abcdef " * 5), (1, "abcdeg " * 25), (2, "abcdhg " * 125), (3, "abcihg " * 625), (4, "jbcihg " * 3125)]
    got = rows_of(S.spelling_variants(spark.createDataFrame(rows, DOCS)))
    assert got["abcdef"] == ("abcdeg", "jbcihg", 5, 1, 25)
    assert got["jbcihg"] == (None, "jbcihg", 3125, 1, None)
