"""Distinct tokens of a batch of texts, encoded exactly by Arrow's dictionary."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from fieldtrace.llm.common import flat_text

_CODES = np.arange(256)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
#: Bytes of white space: 0x20 and 0x09 to 0x0D.
IS_SPACE = (_CODES == 0x20) | ((_CODES >= 0x09) & (_CODES <= 0x0D))
_IS_LETTER = ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122))


def between_spaces(flat: np.ndarray) -> np.ndarray:
    """Marks bytes that are not white space."""
    return ~IS_SPACE[flat]


def letters(flat: np.ndarray) -> np.ndarray:
    """Marks bytes of A-Z, a-z and U+00C0 to U+00FF: in UTF-8 the last are the byte 0xC3 and the one after it."""
    lead = flat == 0xC3
    inside = _IS_LETTER[flat] | lead
    inside[1:] |= lead[:-1]
    return inside


def token_codes(column: pa.Array, inside) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens (binary, A-Z lower-cased), and for each token of the batch its index there and its row.

    A token is a maximal run of bytes that ``inside`` marks; runs do not cross rows.
    """
    flat, bounds = flat_text(column)
    mark = inside(flat)
    first = np.zeros(len(flat) + 1, bool)
    first[bounds] = True
    before = np.empty_like(mark)
    before[:1], before[1:] = False, mark[:-1]
    starts = np.flatnonzero(mark & (first[:-1] | ~before))
    at = np.cumsum(mark)  # bytes of tokens up to here
    offsets = np.append(at[starts] - 1, at[-1] if len(at) else 0).astype(np.int64)
    data = LOWER[flat[mark]]
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    encoded = tokens.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False), np.searchsorted(bounds, starts, "right") - 1


_STEP = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


def crc_of_joined(prefix: np.ndarray, rest: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of prefix + rest from the crc32 of both and the number of bytes of ``rest``, element by element."""
    x = prefix.astype(np.uint32).copy()
    todo, step = np.flatnonzero(sizes > 0), 0
    while len(todo):  # the prefix's remainder moves on by one zero byte each time
        x[todo] = (x[todo] >> np.uint32(8)) ^ _STEP[x[todo] & np.uint32(255)]
        step += 1
        todo = todo[sizes[todo] > step]
    return x ^ rest.astype(np.uint32)
