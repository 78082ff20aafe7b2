"""Token ids of whole texts by the tokenizers library, with the ids of a piece kept for reuse.

Both vocabularies split a text by a fixed pattern before merging, and a piece always gets the same
ids, so each distinct piece goes through the library once per worker.  Texts with characters for
which the split could differ from the pattern below, or with the wording of a token that was added
to the vocabulary, go through the library whole.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGIT = "0-9²³¹¼-¾"
_OTHER = rf"[^\t\n\r {_LETTER}{_DIGIT}]+"
#: Characters for which normalising a text and normalising its pieces are the same.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-įı-ɏ]")
# The split patterns of the two vocabularies.
SPLITS = {
    "word_bpe_49k.json": re.compile(
        rf"'(?:[sS]|[tT]|[rR][eE]|[vV][eE]|[mM]|[lL][lL]|[dD])|[{_LETTER}]+|[{_DIGIT}]|{_OTHER}"),
    "byte_bpe_50k.json": re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?{_OTHER}|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"),
}
_LETTERS = re.compile(f" ?[{_LETTER}]+").fullmatch


def _shown_bytes() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: its own where that is visible."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


_SHOWN = _shown_bytes()
#: Distinct pieces kept per worker and vocabulary.
KEPT_PIECES = 500_000


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE).search
        self._split = SPLITS.get(path.rsplit("/", 1)[-1])
        self._lower = path.endswith("word_bpe_49k.json")
        self._merge = self._tokenizer.model.tokenize
        self._ids: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        """Merge new pieces of letters by the vocabulary's model itself; others go through the whole library path."""
        alone = []
        for p in new:
            if not _LETTERS(p):
                alone.append(p)
                continue
            shown = p.lower() if self._lower else p
            shown = shown.replace(" ", _SHOWN[32]) if shown.isascii() else "".join(map(_SHOWN.__getitem__, shown.encode()))
            merged = self._merge(shown)
            self._ids[p] = struct.pack(f"<{len(merged)}I", *[t.id for t in merged])
        if alone:
            self._ids.update(zip(alone, self._whole(alone)))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._split is None or _UNUSUAL.search(text) or self._added(text):
            return self._whole([text])[0]
        pieces = self._split.findall(text)
        try:
            return b"".join(map(self._ids.__getitem__, pieces))
        except KeyError:
            if len(self._ids) > KEPT_PIECES:
                self._ids.clear()
            self._learn({p for p in pieces if p not in self._ids})
            return b"".join(map(self._ids.__getitem__, pieces))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
