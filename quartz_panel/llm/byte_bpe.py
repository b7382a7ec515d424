"""Byte-level BPE encoding and decoding with padded numpy matrices.

Each text is split by the public pattern; each distinct piece is encoded once per task and
remembered.  New pieces are dealt into buckets by length and become rows of a padded matrix of
token ids.  In a round every row merges its leftmost pair of minimum rank, looked up in a hash table
of all pairs, and closes the gap; rows without a pair left leave the matrix.  Pieces of more than
``LONG`` bytes merge all places of the minimum pair in a round, which gives the same tokens where no
merge makes a token of lower rank than its parts; the table is tested for that when it is built, and
rank files without that property merge one pair a round there too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import mix
from .token_counts import splitter

NONE = np.int32(2**31 - 1)
LONG = 256


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id; ids without a token are empty."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PairTable:
    """Open-addressed hash table from a pair of ids to the id of their concatenation."""

    def __init__(self, tokens: list[bytes]):
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        left, right, whole = [], [], []
        for token, i in self.rank.items():
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), whole.append(i)
        left, right, whole = (np.array(x, np.int64) for x in (left, right, whole))
        self.rises = bool((whole > np.maximum(left, right)).all())
        keys = (left << 32 | right).astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, NONE, np.int32)
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 1
        while len(todo):
            free = todo[self.keys[slot[todo]] == 2**64 - 1]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], whole[first]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = slot[todo] + 1 & self.mask
            self.probes += len(todo) > 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each pair's merge, or NONE; ids below 0 are padding."""
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = (left.ravel()[todo].astype(np.uint64) << np.uint64(32)) | right.ravel()[todo].astype(np.uint64)
        slot, flat = self._slot(keys), out.ravel()
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == keys
            flat[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 2**64 - 1)
            if not on.any():
                break
            todo, keys, slot = todo[on], keys[on], slot[on] + 1 & self.mask
        return flat.reshape(left.shape)


class Encoder:
    def __init__(self, tokens: list[bytes]):
        self.pairs = PairTable(tokens)
        self.single = np.array([self.pairs.rank[bytes([i])] for i in range(256)], np.int32)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.pairs.rank.get(piece)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(piece) > LONG:
                out[i] = self._long(self.single[np.frombuffer(piece, np.uint8)])
            else:
                buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            for lo in range(0, len(rows), part := max(1, 400_000 // width)):
                some = rows[lo : lo + part]
                for i, ids in zip(some, self._matrix([pieces[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        size = np.array([len(p) for p in pieces])
        inside = np.arange(width) < size[:, None]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list = [None] * len(pieces)
        who, ranks = np.arange(len(pieces)), self.pairs.look_up(ids[:, :-1], ids[:, 1:])
        while len(who):
            at = ranks.argmin(axis=1)  # the leftmost of the least
            rows = np.arange(len(who))
            best = ranks[rows, at]
            live = best != NONE
            for r in np.flatnonzero(~live):
                out[who[r]] = ids[r, : size[r]].copy()
            ids, ranks, who, size, at, best = ids[live], ranks[live], who[live], size[live] - 1, at[live], best[live]
            if not len(who):
                break
            rows, column = np.arange(len(who)), np.arange(ids.shape[1])
            take = column + (column > at[:, None])
            ids = np.where(take < ids.shape[1], np.take_along_axis(ids, np.minimum(take, ids.shape[1] - 1), 1), -1)
            ids[rows, at] = best
            take = take[:, : ranks.shape[1]]
            ranks = np.where(take < ranks.shape[1], np.take_along_axis(ranks, np.minimum(take, ranks.shape[1] - 1), 1), NONE)
            after = at < ranks.shape[1]
            ranks[rows[after], at[after]] = self.pairs.look_up(ids[rows[after], at[after]], ids[rows[after], at[after] + 1])
            before = at > 0
            ranks[rows[before], at[before] - 1] = self.pairs.look_up(ids[rows[before], at[before] - 1], ids[rows[before], at[before]])
            if (keep := int(size.max())) < ids.shape[1] * 3 // 4 and keep >= 2:
                ids, ranks = ids[:, :keep], ranks[:, : keep - 1]
        return out

    def _long(self, ids: np.ndarray) -> np.ndarray:
        while len(ids) > 1:
            ranks = self.pairs.look_up(ids[:-1], ids[1:])
            least = ranks.min()
            if least == NONE:
                break
            at = np.flatnonzero(ranks == least)
            if self.pairs.rises:  # of places that overlap, each second one, from the left
                start = np.maximum.accumulate(np.where(np.diff(at, prepend=-9) != 1, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            else:
                at = at[:1]
            ids = ids.copy()
            ids[at] = least
            ids = np.delete(ids, at + 1)
        return ids


class Known:
    """Pieces seen so far in this task; ids lie one after the other in one array.  Bounded: starts anew when full."""

    def __init__(self, encoder: Encoder, most: int = 400_000):
        self.encoder, self.most = encoder, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def flat_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has."""
        if len(self.index) > self.most:
            self.clear()
        if new := [p for p in dict.fromkeys(pieces) if p not in self.index]:
            got = self.encoder.encode([p.encode() for p in new])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, *got])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in got])])
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        return gathered(self.ids, self.starts[at], counts := self.starts[at + 1] - self.starts[at]), counts


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[s : s + n] for each s and n, one after the other."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _encoded(batches: Iterator[pa.RecordBatch], path: str, group: int = 256) -> Iterator[pa.RecordBatch]:
    known, pattern_of = Known(Encoder(read_ranks(path))), splitter()
    for batch in batches:
        for lo in range(0, batch.num_rows, group):
            pieces = [pattern_of(t).findall(t) if t else [] for t in batch.column(1).slice(lo, group).to_pylist()]
            ids, counts = known.flat_ids([p for one in pieces for p in one])
            ends = _offsets(counts)[_offsets(np.array([len(one) for one in pieces], np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, group), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, group: int = 256) -> Iterator[pa.RecordBatch]:
    tokens = read_ranks(path)
    data, sizes = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64)
    starts = _offsets(sizes)[:-1]
    for batch in batches:
        for lo in range(0, batch.num_rows, group):
            lists = batch.column(1).slice(lo, group)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            rows = _offsets(np.array(lists.value_lengths().fill_null(0), np.int64))
            ends = _offsets(sizes[ids])[rows]
            text = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(gathered(data, starts[ids], sizes[ids]).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, group), lists, text], names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids (array of int), a row for each row of ``docs``; no shuffle.

    Null and empty texts give an empty array.  Other columns are ignored.  Needs 256 one-byte tokens in the file.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _encoded(batches, ranks_path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids, decoded (binary: the bytes need not be UTF-8); a null or empty array gives no bytes."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, ranks_path), "doc_id long, ids array<int>, decoded binary")
