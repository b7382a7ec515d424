"""Numpy over the text buffers of Arrow batches: words, their hashes and rolling hashes.

All hashes are unsigned 64-bit with wrap-around.  Words are hashed lane by lane through a mixing step that isn't linear; spans of
longer sequences come from a prefix sum (``spans``): they choose candidates, which callers compare by their words or bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_LANE_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: \x20 and \x09-\x0D end words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z alone are lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection that spreads every bit of ``h``."""
    h = h + np.uint64((salt * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    if n:
        up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Rolling:
    """Hash of any span of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64), salt)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def text_chunks(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for slices of whole rows; null texts are empty.

    A slice has one row at least, so a text is never cut."""
    text = batch.column(batch.schema.get_field_index(column))
    if text.null_count:
        text = pc.fill_null(text, "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, kind)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most_bytes, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the first word of each text (one more entry: the end)."""
    solid = np.zeros(len(data) + 1, bool)
    np.logical_not(WHITE[data], out=solid[:-1])
    before = np.zeros(len(data) + 1, bool)
    before[1:] = solid[:-1]
    before[offsets] = False  # a word never goes on from one text into the next
    starts = np.flatnonzero(solid & ~before)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    after = np.flatnonzero(before[1:] & ~solid[1:] | edge[1:] & solid[:-1]) + 1 if len(data) else starts
    return starts, after, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, long: int = 64) -> np.ndarray:
    """A hash of each word: its 8-byte lanes are mixed in one after another; words over ``long`` bytes go through BLAKE2b."""
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    left = ends - starts
    h, at, todo = mix(left.astype(np.uint64), 13 + 50 * seed), starts, slice(None)
    for _ in range(0, long, 8):
        value = lanes[at] & _LANE_MASKS[np.minimum(left, 8)]
        h[todo] = mix(h[todo] ^ value, 17 + 50 * seed)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        at, left = at[more] + 8, left[more] - 8
        todo = more if isinstance(todo, slice) else todo[more]
    for i in np.flatnonzero(ends - starts > long).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    return h


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return h.view(np.int64)
