"""License notices by conditional compression.

A block of text around a word that license notices use is compressed alone and with each template as a raw zstandard
dictionary: the template that saves most bytes describes the block best.  Templates are tried in that order; one is confirmed
only if its wording stands around the word with all words that name the license, told by the exact differences in words.  As a
block may hold other notices too, the search goes down the ranking until no template below can differ less than the best one
confirmed: words of a template that the block lacks all differ.  Line ends and the marks of comments are gaps between words.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import chunks

# Wordings of notices, by license; the words in braces name the license.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU {Affero} General Public License, version {3}."],
    "Apache-2.0": [
        "Licensed under the {Apache} License, Version {2.0}.",
        'Licensed under the {Apache} License, Version {2.0} (the "License"); you may not use this file except in compliance with the License.'],
    "BSD-2-Clause": ["Licensed under the {BSD} {2-Clause} License."],
    "BSD-3-Clause": ["Licensed under the {BSD} {3-Clause} License."],
    "BSD": ["{Redistribution} and use in {source} and {binary} {forms}, with or without modification, are permitted provided that the "
            "following conditions are met"],
    "CC0-1.0": ["Released under {CC0} {1.0}."],
    **{f"CC-{kind}-{v}": [f"Licensed under CC {{{kind}}} {{{v}}}."] for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
       for v in ("3.0", "4.0")},
    "GPL-2.0": ["This work is licensed under the {GNU} {General} Public License, version {2}.",
                "it under the terms of the {GNU} {General} Public License as published by the Free Software Foundation; either version {2} of the License"],
    "GPL-3.0": ["This work is licensed under the {GNU} {General} Public License, version {3}.",
                "it under the terms of the {GNU} {General} Public License as published by the Free Software Foundation, either version {3} of the License"],
    "ISC": ["Permission to use, copy, modify, and/or {distribute} this software for any {purpose} with or without {fee} is hereby granted"],
    "LGPL-2.1": ["This work is licensed under the GNU {Lesser} General Public License, version {2.1}."],
    "LGPL-3.0": ["This work is licensed under the GNU {Lesser} General Public License, version {3}."],
    "MIT": ["Released under the {MIT} License.", "Licensed under the {MIT} License.",
            "Permission is hereby granted, {free} of {charge}, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}."],
    "Proprietary": ["{All} {rights} {reserved}."],
    "Unlicense": ["This is free and {unencumbered} software released into the {public} {domain}."],
}
# Title lines of license texts, and short names.
for _name, _wordings in {
    "AGPL-3.0": ["GNU {Affero} General Public License Version {3}, 19 November 2007", "under the {AGPLv3}"],
    "Apache-2.0": ["{Apache} License Version {2.0}, January 2004"],
    "GPL-2.0": ["{GNU} {General} Public License Version {2}, June 1991", "under the {GPLv2}"],
    "GPL-3.0": ["{GNU} {General} Public License Version {3}, 29 June 2007", "under the {GPLv3}"],
    "LGPL-2.1": ["GNU {Lesser} General Public License Version {2.1}, February 1999", "under the {LGPLv2.1}"],
    "LGPL-3.0": ["GNU {Lesser} General Public License Version {3}, 29 June 2007", "under the {LGPLv3}"],
    "MPL-2.0": ["{Mozilla} Public License Version {2.0}"],
}.items():
    TEMPLATES[_name] = TEMPLATES[_name] + _wordings
#: Tags with the identifier of the license; the first of several counts.  Families with versions may say what follows them.
for _name in [n for n in TEMPLATES if n not in ("BSD", "Proprietary")]:
    TEMPLATES[_name] = TEMPLATES[_name] + [
        f"SPDX-License-Identifier: {{{_name}{more}}}" for more in (["", "-only", "-or-later"] if "GPL" in _name else [""])]
#: The end of a line and what stands before the next line's words: space, marks of a comment, words that are such marks.
_LINE = r"\r?\n[^\S\n]*(?:[^\w\s]{1,4}[^\S\n]*|(?:dnl|rem|c)[^\S\n]+)?"
_TAIL = r"(?:[^\S\n]+[^\w\s]{1,4})?[^\S\n]*"  # what a boxed comment has at the line's end
_GAP = rf"(?:{_TAIL}{_LINE}|[^\S\n]+)"
#: Every template holds one of these; a block is what stands around one, up to a blank line.  A word of a text leads to
#: the templates that hold the same.
_TRIGGER = re.compile(rf"licen[cs]e|\b[AL]?GPLv[23](?:\.1)?\b|CC0|redistribution|permission|public{_GAP}licen[cs]e|rights{_GAP}reserved|public{_GAP}domain", re.IGNORECASE)
REACH = 400  # characters of a block to each side of the trigger, line ends and marks of comments not counted
RAW_REACH = 10 * REACH  # the same with them
DIFFERENT_SHARE = 0.25  # of a template's words that may differ if none of them names the license
_LINE_END = re.compile(_LINE, re.IGNORECASE)
_BLANK = re.compile(r"\n[^\S\n]*(?=\n)")
_BROKEN = re.compile(rf"-{_TAIL}{_LINE}", re.IGNORECASE)
#: A word, which may go on after a hyphen at the end of a line; a mark of a comment at the start of a line is none.
_WORD = re.compile(rf"(?:(?<=\n)[^\S\n]*(?:dnl|rem|c)[^\S\n]+)|([^\W_]+(?:(?:[.\-]|{_BROKEN.pattern})[^\W_]+)*)", re.IGNORECASE)


def _plain(trigger: str) -> str:
    return re.sub(r"[^a-z0-9]+(?:(?:dnl|rem|c)\s+)?", " ", trigger.lower()).replace("licence", "license")


def _words(text: str) -> list[tuple[str, int, int]]:
    """Words in small letters with their spans; one that was cut at a line's end is put together."""
    out = []
    for m in _WORD.finditer(text):
        if m.group(1):
            word = m.group(1).lower()
            if "\n" in word:
                whole = _BROKEN.sub("", word)
                word = whole if whole in _vocabulary() else _BROKEN.sub("-", word)
            out.append((word, *m.span(1)))
    return out


@lru_cache(maxsize=1)
def _vocabulary() -> frozenset[str]:
    return frozenset(w for t in _templates()[0] for w in t.words)


class _Template:
    def __init__(self, name: str, wording: str):
        import zstandard

        self.name, text = name, wording.replace("{", "").replace("}", "")
        self.words = [w for w, _, _ in _words(text)]
        naming = {w for part in re.findall(r"\{(.*?)\}", wording) for w, _, _ in _words(part)}
        self.triggers = {_plain(m.group()) for m in _TRIGGER.finditer(text)}
        self.naming = [i for i, w in enumerate(self.words) if w in naming]
        self.bag = Counter(self.words)
        data = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.size = _compressor(data)

    def least(self, held: Counter) -> tuple[float, int]:
        """The smallest share of words that can differ from a text of these words, and the words, more first."""
        if any(not held[self.words[i]] for i in self.naming):
            return 2.0, 0
        return sum((self.bag - held).values()) / len(self.words), -len(self.words)


def _compressor(dictionary=None):
    import zstandard

    pack = zstandard.ZstdCompressor(level=19, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)
    return lambda data: len(pack.compress(data))


@lru_cache(maxsize=1)
def _templates() -> tuple[list[_Template], object]:
    return [_Template(name, w) for name, wordings in TEMPLATES.items() for w in wordings], _compressor()


def ranking(block: str, trigger: str) -> list[tuple[int, _Template]]:
    """Templates that hold the trigger, by the bytes that each saves as a dictionary, the most first."""
    templates, alone = _templates()
    data = block.lower().encode()
    base = alone(data)
    return sorted(((base - t.size(data), t) for t in templates if _plain(trigger) in t.triggers), key=lambda x: (-x[0], x[1].name))


@lru_cache(maxsize=10_000)
def scan_block(block: str, at: int, trigger: str) -> tuple[str, int, int, int] | None:
    """(license, start, end, words that differ) of the notice confirmed around the trigger at ``at``."""
    words = _words(block)
    text = [w for w, _, _ in words]
    here = next((i for i, (_, _, e) in enumerate(words) if at < e), None)
    if here is None:
        return None
    held = Counter(text)
    ranked = [(saved, t, t.least(held)) for saved, t in ranking(_LINE_END.sub(" ", block), trigger)]
    best = None
    for i, (saved, t, least) in enumerate(ranked):
        if best and all(below > best[:2] for _, _, below in ranked[i:]):
            break  # the winner so far differs less than any template below can
        if least[0] > DIFFERENT_SHARE:
            continue
        found = _differences(text, here, t)
        if found:
            first, last, different = found
            way = (different / len(t.words), -len(t.words), -saved, t.name, words[first][1], words[last][2], different)
            best = way if best is None else min(best, way)
    return best[3:] if best else None


def _side(text: list[str], template: list[str], needed: list[bool]) -> list[tuple[int, int]]:
    """For each start in the template the fewest words that differ from there to its end, and how many words of the text that takes.

    A word that stands in one of the two only counts once; ``needed`` words of the template must be met.  What the text holds behind
    the last word met is free.
    """
    never = len(text) + len(template) + 1
    row = [(0, 0)] * (len(text) + 1)
    out = [row[0]]
    for word, need in zip(reversed(template), reversed(needed)):
        skip = never if need else 1
        new = [(row[-1][0] + skip, 0)]
        for k in range(len(text) - 1, -1, -1):
            cost, reach = row[k]
            best = (cost + skip, -reach)
            if text[k] == word:
                cost, reach = row[k + 1]
                best = min(best, (cost, -reach - 1))
            cost, reach = new[-1]
            if reach:  # a word passed over lies before one that is met
                best = min(best, (cost + 1, -reach - 1))
            new.append((best[0], -best[1]))
        row = new[::-1]
        out.append(row[0])
    return out[::-1]


def _differences(text: list[str], here: int, t: _Template) -> tuple[int, int, int] | None:
    """First and last word of the stretch around word ``here`` that differs least from the template, and the number of words that
    differ; None if unlike."""
    n, span = len(t.words), 2 * len(t.words)
    text, cut = text[max(0, here - span):here + span + 1], max(0, here - span)
    here -= cut
    if not {t.words[i] for i in t.naming} <= set(text):
        return None
    needed = [i in t.naming for i in range(n)]
    after = _side(text[here + 1:], t.words, needed)
    before = _side(text[:here][::-1], t.words[::-1], needed[::-1])[::-1]
    best = None
    for i in range(n + 1):
        ways = []
        if i < n and t.words[i] == text[here]:
            ways.append((0, before[i], after[i + 1]))
        if before[i][1] and after[i][1]:  # the word itself is none of the template's
            ways.append((1, before[i], after[i]))
        for own, (left, to_left), (right, to_right) in ways:
            way = (own + left + right, -to_left - to_right, here - to_left, here + to_right)
            best = way if best is None else min(best, way)
    if best is None or best[0] > DIFFERENT_SHARE * n:
        return None
    return cut + best[2], cut + best[3], best[0]


def _block(text: str, start: int, end: int, done: int) -> tuple[int, int]:
    """Bounds of the block around a trigger: ``REACH`` characters to each side, not over a blank line nor before ``done``."""
    low, high = max(done, start - RAW_REACH), min(len(text), end + RAW_REACH)
    for blank in _BLANK.finditer(text, low, start):
        low = blank.end()
    blank = _BLANK.search(text, end, high)
    high = blank.start() if blank else high
    room, at = REACH, start
    for line in reversed(list(_LINE_END.finditer(text, low, start))):
        if at - line.end() >= room:
            break
        room, at = room - (at - line.end()), line.start()
    low = max(low, at - room)
    room, at = REACH, end
    for line in _LINE_END.finditer(text, end, high):
        if line.start() - at >= room:
            break
        room, at = room - (line.start() - at), line.end()
    return low, min(high, at + room)


def license_spans(text: str | None) -> tuple[int, list[tuple[str, int, int, int]]]:
    """Number of blocks tried and the notices (license, start, end, words that differ) of a whole text, in characters."""
    text, done, blocks, found = text or "", 0, 0, []
    for m in _TRIGGER.finditer(text):
        if m.start() < done:
            continue  # inside a notice
        start, end = _block(text, *m.span(), done)
        blocks += 1
        notice = scan_block(text[start:end], m.start() - start, m.group())
        if notice:
            found.append((notice[0], start + notice[1], start + notice[2], notice[3]))
            done = start + notice[2]
    return blocks, found


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: key, n_blocks, licenses (sorted, comma-joined), spans (license:start:end:different, comma-joined).

    Whole texts are searched; null counts as empty, a text without a notice gives empty strings.  Rows are independent, so
    repeated rows repeat, null keys stay null, an empty table gives no rows; other columns are not read.
    """
    schema = pa.schema([(key, pa.int64()), ("n_blocks", pa.int64()), ("licenses", pa.string()), ("spans", pa.string())])

    def scan(batches):
        for batch in chunks(batches, text):
            rows = [license_spans(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(key), pa.array([n for n, _ in rows], pa.int64()),
                pa.array([",".join(sorted({s[0] for s in f})) for _, f in rows], pa.string()),
                pa.array([",".join(":".join(map(str, s)) for s in f) for _, f in rows], pa.string())], schema=schema)

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(
        scan, f"`{key}` long, n_blocks long, licenses string, spans string")
