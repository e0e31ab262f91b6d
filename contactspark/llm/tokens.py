"""Words of whole batches of texts, cut by arithmetic on their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import WS_CHARS

WHITE = WS_CHARS.encode()
#: A to Z in lower case, all other bytes as they are.
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype("u1")


def cut_words(texts: pa.Array, blank: bytes = WHITE, stop: bytes = b"", lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, one after the other, the text of each, and whether it goes on the piece of the word before it.

    Words are runs of anything but the ASCII characters of blank and stop; a piece ends at a character of stop and with its text.
    Null texts are empty. lower: A to Z become a to z.
    """
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, content = whole.buffers()
    at = np.frombuffer(offsets, "i8")[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(content, "u1")[at[0] : at[-1]] if content else np.zeros(0, "u1")
    at = at - at[0]
    kinds = np.zeros(256, "u1")
    kinds[list(blank)], kinds[list(stop)] = 1, 2
    kind = kinds[data]
    inside = kind == 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = at[(at > 0) & (at < len(data))]  # texts meet here, perhaps within a run of bytes that are no blanks
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(at, start, side="right") - 1
    stops = np.searchsorted(np.flatnonzero(kind == 2), start)
    goes_on = np.zeros(len(start), bool)
    goes_on[1:] = (stops[1:] == stops[:-1]) & (owner[1:] == owner[:-1])
    letters = data[inside]
    edges = np.zeros(len(start) + 1, "i4")
    np.cumsum(end - start, out=edges[1:])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(edges), pa.py_buffer(LOWER[letters] if lower else letters)), owner, goes_on


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal for equal words, and the words by number."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype("i8"), found.dictionary
