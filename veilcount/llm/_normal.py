"""Words in lower case without punctuation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from veilcount.llm import _text

_MAP = np.arange(256, dtype=np.uint8)
_MAP[:0x80] = [ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(0x80)]


def normal(buf: np.ndarray) -> np.ndarray:
    """Same length: ASCII other than letters and digits becomes a space; ASCII and Latin-1 letters become lower case."""
    out = _MAP[buf]
    if len(buf) > 1:
        after = out[1:]
        after[(buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)] += 0x20
    return out


def normal_words(column: pa.Array) -> Iterator[tuple[int, int, _text.Words]]:
    for i, j, buf, offsets in _text.blocks(column):
        yield i, j, _text.split_words(normal(buf), offsets)
