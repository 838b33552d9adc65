"""Word shingles of many texts at once, as hashes in numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from seekframe.llm.rolling import U, mix, prefix_hash, span_hash
from seekframe.llm.runtime import utf8_chunks

#: A shingle is known by this many bits of its hash; the rest of a key says which text it is in.
ID_BITS = 48
_STEP = np.uint64(0xD6E8FEB86659FD93)


def packed(text: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """Keys of text number and shingle; a text number that has no room in a key is an error."""
    if len(text) and int(text.max()) >> (64 - ID_BITS):
        raise OverflowError(f"text number {int(text.max())} has no room beside a shingle of {ID_BITS} bits")
    return (text.astype(np.uint64) << U(ID_BITS)) | shingle


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word: bytes other than blank and tab to carriage return."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    letter = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word never runs over from one text into the next
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | edge[1:-1]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, side="right") - 1


def shingle_counts(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (text number, then shingle) and how often each shingle stands in its text.

    A text of fewer than ``width`` words has one shingle, all its words; one without words has none.
    """
    start, end, text = words_of(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = span_hash(prefix_hash(data), start, end)
    n = len(offsets) - 1
    counts = np.bincount(text, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    room = len(word) - width + 1
    keys = []
    if room > 0:
        value = word[:room].copy()
        for j in range(1, width):
            value = value * _STEP + word[j : j + room]
        inside = text[:room] == text[width - 1 :]
        keys.append(packed(text[:room][inside], mix(value[inside]) >> U(64 - ID_BITS)))
    for t in np.flatnonzero((counts > 0) & (counts < width)):
        value = U(counts[t])
        with np.errstate(over="ignore"):
            for h in word[first[t] : first[t] + counts[t]]:
                value = value * _STEP + h
        keys.append(packed(np.array([t]), mix(np.array([value], np.uint64)) >> U(64 - ID_BITS)))
    keys = np.sort(np.concatenate(keys))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys)))


def shingles_of(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle and count by shingle_counts of lower-cased texts, chunk by chunk: what is held beside the result is one chunk's.

    The text number has an array of its own, so the number of texts is not bounded by a key.
    """
    text, shingle, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, _, data, offsets in utf8_chunks(lowered(texts)):
        key, count = shingle_counts(data, offsets, width)
        text.append((key >> U(ID_BITS)).astype(np.int64) + first)
        shingle.append(key & U((1 << ID_BITS) - 1))
        counts.append(count)
    return np.concatenate(text), np.concatenate(shingle), np.concatenate(counts)
