"""Plain identifiers against the patterns written out, disguised ones against what they stand for."""

import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldtrace.llm.pii import KINDS, all_spans, find_personal_data, joined, plain_spans, redact, redact_personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn_by_hand(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
    return sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def brute(text):
    keep = {
        "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn_by_hand(re.sub("[^0-9]", "", m)),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    found = [(k, *m.span()) for k in KINDS for m in re.finditer(PATTERNS[k], text) if keep[k](m.group())]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "-", " ", "+", "1", "255", "256", "4111 1111 1111 1111", "+1 (212) 555-0100",
                                 "x@y.z", "é", "1.2.3.4", "000", "%", "(", "\n"]), max_size=25).map("".join))
def test_plain_spans_are_those_of_the_patterns(text):
    assert plain_spans(text) == brute(text)
    base, every = all_spans(text)
    assert base == brute(text) and set(base) <= set(every)


@pytest.mark.parametrize("text,kind,span", [
    ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("john.doe(at)mail.example.org", "email", "john.doe(at)mail.example.org"),
    ("ask john at example dot com.", "email", "john at example dot com"),
    ("jοhn＠exаmple．com", "email", "jοhn＠exаmple．com"),
    ("jo​hn@example.com", "email", "jo​hn@example.com"),
    ("é call plus one two one two five five five one two three four", "phone", "plus one two one two five five five one two three four"),
    ("+1 two one two 555 one two three four", "phone", "+1 two one two 555 one two three four"),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("four " + "one " * 15 + "end", "card", "four" + " one" * 15),
    ("192[.]168[.]1[.]20", "ip", "192[.]168[.]1[.]20"), ("host 10 dot 0 dot 0 dot 1", "ip", "10 dot 0 dot 0 dot 1"),
])
def test_disguises_map_back_to_the_source(text, kind, span):
    base, every = all_spans(text)
    assert [(k, text[s:e]) for k, s, e in every if (k, s, e) not in base] == [(kind, span)]


@pytest.mark.parametrize("text,kind,span", [
    ("mail john@example[.]com now", "email", "john@example[.]com"), ("john@example(dot)com", "email", "john@example(dot)com"),
    ("ask john@example dot com.", "email", "john@example dot com"), ("john@example_dot_com", "email", "john@example_dot_com"),
    ("to john@mail.example[.]com. Then more", "email", "john@mail.example[.]com"),
    ("to john@example[.]co[.]uk, and", "email", "john@example[.]co[.]uk"),
    ("é jo​hn＠example [punto] com", "email", "jo​hn＠example [punto] com"),
    ("the dot john[.]doe@example.com now", "email", "john[.]doe@example.com"),
    ("call +1 2l2 555 O1OO now", "phone", "+1 2l2 555 O1OO"), ("+l (2l2) 555-OIOO", "phone", "+l (2l2) 555-OIOO"),
    ("pay 4lll 1111 1111 1111.", "card", "4lll 1111 1111 1111"), ("4111 llll 1111 IIII", "card", "4111 llll 1111 IIII"),
    ("host l0.O.0.1 is", "ip", "l0.O.0.1"), ("+1 2l2 five five five O1OO", "phone", "+1 2l2 five five five O1OO"),
    ("+1 2l2 555 О1ОО", "phone", "+1 2l2 555 О1ОО"),
])
def test_plain_at_and_letters_for_digits(text, kind, span):
    base, every = all_spans(text)
    assert [(k, text[s:e]) for k, s, e in every if (k, s, e) not in base] == [(kind, span)]
    assert span not in redact(text, every) and f"<{kind.upper()}>" in redact(text, every)


@pytest.mark.parametrize("text", ["10 o 12 o 15 o 20 o 25 o 30", "Il 1 Io 2", "10l of 12 l", "@example dot com", "a@b", "1O of l0", "4lll 1111 1111 1112",
                                  "mail[.]example", "World War II 1939", "look 111 1111 oil 1111"])
def test_clean_texts_with_stand_ins_have_no_spans(text):
    assert all_spans(text) == ([], [])


@pytest.mark.parametrize("text", ["jo@example.com. See dot notes", "+1 212 555 0100 III", "＋１ ２１２ ５５５ ０１００ III"])
def test_neighbours_do_not_widen_a_span(text):
    assert len(all_spans(text)[1]) == 1 and all_spans(text)[1][0][2] < len(text) - 3


@pytest.mark.parametrize("text", ["look at one thing", "see you at example.com", "one, two, three!", "meet at noon", "the dot in it",
                                  "Version 1.2.3", "© é à", "nine of ten at work", ""])
def test_clean_texts_have_no_spans(text):
    assert all_spans(text) == ([], [])


DOCS = [(1, "a@b.com and 1.2.3.4"), (2, None), (3, ""), (None, "x"), (1, "a@b.com and 1.2.3.4"), (5, "word " * 50_000 + "a@b.co"), (6, "john [at] b [dot] co")]


def test_frames(spark):
    docs = spark.createDataFrame([(k, t, "s", 1) for k, t in DOCS], "doc_id long, text string, spans string, n_ip int")
    got = [tuple(r) for r in find_personal_data(docs).collect()]
    want = [(k, *[sum(x[0] == kind for x in brute(t or "")) for kind in KINDS],
             hashlib.sha256(joined(brute(t or "")).encode()).hexdigest(), joined(all_spans(t)[1])) for k, t in DOCS]
    assert sorted(map(str, got)) == sorted(map(str, want))
    clean = redact_personal_data(docs)
    assert clean.schema == docs.schema
    texts = [r.text for r in clean.orderBy("doc_id", "text").collect()]
    assert texts[0] == "x" and texts[1] == "<EMAIL> and <IP>" and texts[3] is None and texts[-1] == "<EMAIL>"
    assert texts[-2] == "word " * 50_000 + "<EMAIL>"
    assert find_personal_data(docs.limit(0)).count() == 0 and redact_personal_data(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["john at example (punkt) com", "john [at] example punkt com", "john arroba example punto com", "john at example punkt com",
                                  "john at example dot com"])
def test_addresses_spelled_in_four_languages(text):
    base, every = all_spans(f"écrire à {text}, merci")
    assert base == [] and every == [("email", 9, 9 + len(text))]


def test_words_for_a_dot_stay_words():
    for text in ("we met at the point of no return", "at this point it is", "sie kam an den punkt de facto", "hablo at gusto punto y coma", "look at it point by point"):
        assert all_spans(text) == ([], [])


def test_long_runs_of_digits_are_read_once():
    for text in ("1" * 1_000_000, "one " * 100_000, "1." * 300_000, "1 " * 300_000, "+" + "1 " * 300_000):
        began = time.process_time()
        all_spans(text)
        assert time.process_time() - began < 5


def test_runs_of_dotted_numbers():
    old = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["1", "25", "300", "0007", ".", ".", "..", " ", "a"]) for _ in range(rng.randint(0, 30)))
        want = [("ip", *m.span()) for m in old.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        assert [s for s in plain_spans(text) if s[0] == "ip"] == want
