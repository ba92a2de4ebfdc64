"""Words of many texts at once: spans and 64-bit hashes on the bytes of an Arrow column.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.
Texts are UTF-8, so no word is cut inside a character. A null text has no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SEED = 0x5EED
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Words of more bytes are hashed one by one.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len+1 offsets of its texts (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of every word; no word crosses a text's border."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends


def word_hashes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, each text's first word (len+1 offsets), word starts and ends as bytes in the text's column, and the texts' byte offsets."""
    data, offsets = column_bytes(column)
    starts, ends = word_spans(data, offsets)
    padded = np.concatenate((_LOWER[data], np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    length = ends - starts
    out = mix(length.astype(np.uint64) + np.uint64(SEED))
    at = 0
    own, begin, left = np.flatnonzero(length <= LONG), None, None
    while len(own):
        begin, left = starts[own] + at, length[own] - at
        value = eight[begin]
        short = left < 8
        value[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[own] = mix(out[own] * np.uint64(3) + value)
        at += 8
        own = own[left > 8]
    for i in np.flatnonzero(length > LONG):
        out[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]].tobytes(), SEED)
    return out, np.searchsorted(starts, offsets), starts, ends, offsets


def shingles(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `width` words and each text's first run (len+1 offsets). A text of fewer words, but one at least, has one run: all of them."""
    counts = np.diff(firsts)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    to = np.concatenate(([0], np.cumsum(runs)))
    text = np.repeat(np.arange(len(counts)), runs)
    begin = firsts[:-1][text] + (np.arange(to[-1]) - to[:-1][text])
    length = np.minimum(width, counts[text])
    out = mix(length.astype(np.uint64))
    for k in range(width):
        more = length > k
        out[more] = mix(out[more] * np.uint64(3) + words[begin[more] + k])
    return out, to
