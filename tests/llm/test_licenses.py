"""License notices against the wordings planted in the tables, and wordings that differ a little or too much."""

import random
import re
import textwrap
from functools import lru_cache

import pytest

from fieldtrace.llm import licenses
from fieldtrace.llm.licenses import TEMPLATES, license_spans, ranking, scan_licenses
from fieldtrace.llm.queries import QUERIES

PLANTED = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0", "MIT": "Released under the MIT License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0", "Proprietary": "All rights reserved",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
}


@pytest.mark.parametrize("name,wording", [(n, w) for n, ws in TEMPLATES.items() for w in ws])
def test_every_template_confirms_itself(name, wording):
    text = re.sub("[{}]", "", wording)
    blocks, found = license_spans(f"Some words come before.\nmore {text} and after")
    assert blocks and found[0][0] == name and found[0][3] == 0


@pytest.mark.parametrize("width", [24, 40, 70, 80])
@pytest.mark.parametrize("mark,end", [("", ""), (" * ", ""), ("# ", ""), ("    // ", ""), ("dnl ", ""), ("/* ", " */"), (" " * 60 + ";; ", "\r")])
@pytest.mark.parametrize("name,wording", [(n, w) for n, ws in TEMPLATES.items() for w in ws])
def test_every_template_is_found_wrapped(name, wording, width, mark, end):
    plain = re.sub("[{}]", "", wording)
    lines = textwrap.wrap(f"The parts of this program were made by several people. {plain} and more words come after it here", width)
    text = "".join(f"{mark}{line}{end}\n" for line in lines)
    found = license_spans(f"{mark}A file{end}\n{text}x = 1\n")[1]
    assert [f[0] for f in found] == [name] and found[0][3] == 0
    source = text[found[0][1] - len(f"{mark}A file{end}\n"):found[0][2] - len(f"{mark}A file{end}\n")]
    assert re.findall(r"\w+", source.replace("dnl ", "")) == re.findall(r"\w+", plain)


def test_notices_on_lines_of_their_own():
    text = "under the MIT License\nReleased under the MIT License\nAll rights\nreserved.\n\nLicensed under CC BY-\nNC 4.0, for any pur-\npose"
    assert [(n, text[s:e]) for n, s, e, _ in license_spans(text)[1]] == [
        ("MIT", "under the MIT License"), ("MIT", "Released under the MIT License"), ("Proprietary", "All rights\nreserved"),
        ("CC-BY-NC-4.0", "Licensed under CC BY-\nNC 4.0")]
    assert license_spans("Released under\n\nthe MIT\n\nLicense")[1] == []


def test_the_template_that_saves_most_is_first():
    assert ranking("Licensed under the Apache License, Version 2.0.", "Licence")[0][1].name == "Apache-2.0"
    assert ranking("Released under the MIT License.", "License")[0][1].name == "MIT"


@pytest.mark.parametrize("text,names", [
    ("licensed under the GNU General Public License, version 2", ["GPL-2.0"]), ("Licensed under the Apache License, Version 1.1.", []),
    ("a driving license for Apache county", []), ("without permission of the author", []), ("LICENSED UNDER THE MIT LICENCE", ["MIT"]),
    ("Copyright X. All rights reserved. Released under the MIT License. Ask for permission.", ["Proprietary", "MIT"]),
    ("Licensed under CC BY-NC-SA 3.0", ["CC-BY-NC-SA-3.0"]), (None, []), ("", []),
    ("x " * 100_000 + "Released under the MIT License." + " y" * 100_000, ["MIT"]),
    ("# SPDX-License-Identifier: MIT\nx = 1", ["MIT"]), ("// SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0"]),
    ("SPDX-License-Identifier: Apache-2.0 OR MIT", ["Apache-2.0"]), ("SPDX-License-Identifier: Unknown", []),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", ["GPL-3.0"]), ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", ["LGPL-2.1"]),
    ("Apache License\n  Version 2.0, January 2004", ["Apache-2.0"]), ("Published under the GPLv3", ["GPL-3.0"]), ("the GPLv3 and others", []),
    ("All rights reserved.\n" * 3, ["Proprietary"] * 3),
])
def test_wordings(text, names):
    assert [f[0] for f in license_spans(text)[1]] == names


def plain_difference(text, here, template):
    """Fewest words that stand in one of the two only, over all stretches around ``here``; naming words must be met."""
    words, naming = template.words, set(template.naming)
    never = 10**6
    best = never
    for i in range(here + 1):
        for j in range(here + 1, len(text) + 1):
            part = text[i:j]

            @lru_cache(maxsize=None)
            def apart(a, b):
                if a == len(part) and b == len(words):
                    return 0
                ways = [never]
                if a < len(part):
                    ways.append(1 + apart(a + 1, b))
                if b < len(words):
                    ways.append((never if b in naming else 1) + apart(a, b + 1))
                if a < len(part) and b < len(words) and part[a] == words[b]:
                    ways.append(apart(a + 1, b + 1))
                return min(ways)

            best = min(best, apart(0, 0))
    return best


def test_differences_against_all_stretches():
    rng = random.Random(5)
    confirmed = 0
    for t in [t for t in licenses._templates()[0] if 4 <= len(t.words) <= 12]:
        for _ in range(8):
            text = list(t.words)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(text))
                text[i:i + 1] = rng.choice([[], [text[i], "so"], ["or"], [text[i], text[i]]])
                text = text or ["so"]
            text = ["as", *text, "we"]
            here = rng.randrange(len(text))
            got, want = licenses._differences(text, here, t), plain_difference(text, here, t)
            if got is None:
                # a stretch whose word in the middle lies outside all that is met is none
                assert want > licenses.DIFFERENT_SHARE * len(t.words) or text[here] not in t.words
            else:
                confirmed += 1
                first, last, different = got
                assert first <= here <= last and different == want
    assert confirmed > 50


def test_the_ranking_leads_and_ends_the_search(monkeypatch):
    """The best template by compression is tried first, and what is compared word by word grows if the ranking is turned round."""
    text = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
            "License. Released under the MIT License. This work is licensed under the GNU General Public License, version 3.")
    tried = []
    real, order = licenses._differences, licenses.ranking

    def counted(words, here, t):
        tried.append(t)
        return real(words, here, t)

    monkeypatch.setattr(licenses, "_differences", counted)
    licenses.scan_block.cache_clear()
    first = licenses.scan_block(text, 0, "License")
    assert first[0] == "Apache-2.0" and tried[0] is order(text, "License")[0][1] and len(tried) == 1
    tried.clear()
    monkeypatch.setattr(licenses, "ranking", lambda block, trigger: order(block, trigger)[::-1])
    licenses.scan_block.cache_clear()
    assert licenses.scan_block(text, 0, "License")[0] == "Apache-2.0" and len(tried) > 1
    licenses.scan_block.cache_clear()


@pytest.mark.parametrize("first,wording", [(n, w) for n, ws in TEMPLATES.items() for w in ws])
@pytest.mark.parametrize("second,other", [(n, w) for n in ("GPL-3.0", "BSD", "CC-BY-NC-ND-3.0", "Apache-2.0") for w in TEMPLATES[n]])
def test_a_second_notice_does_not_hide_the_first(first, wording, second, other):
    text = re.sub("[{}]", "", f"{wording} Some parts of it: {other}")
    assert [f[0] for f in license_spans(text)[1]] == [first, second]


def test_planted_notices_and_no_others(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["op6_licenses"](spark, sf).collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        want = sorted((m.start(), m.end(), n) for n, w in PLANTED.items() for m in re.finditer(re.escape(w), text or ""))
        assert got[k].spans == ",".join(f"{n}:{s}:{e}:0" for s, e, n in want)
        assert got[k].licenses == ",".join(sorted({n for _, _, n in want}))


def test_odd_rows(spark):
    rows = [(1, None), (None, "Released under the MIT License."), (2, ""), (2, "")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, licenses string")
    got = sorted(map(str, map(tuple, scan_licenses(docs).collect())))
    assert got == sorted(map(str, [(1, 0, "", ""), (None, 1, "MIT", "MIT:0:30:0"), (2, 0, "", ""), (2, 0, "", "")]))
    assert scan_licenses(docs.limit(0)).count() == 0
