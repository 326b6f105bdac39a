"""Tokenising by distinct segments: every different piece of text between spaces is encoded once per worker.

A segment's tokens depend on its own bytes alone (each vocabulary's module says why), so texts are cut with
numpy and only segments not met before are encoded. A segment is looked up by a 64-bit hash and compared by
its bytes, so two segments never share tokens because their hashes do.

The store is a cache of one worker and holds MOST_BYTES. When it is full, between blocks of texts, the half
that was met more often stays: frequent words are encoded once, however many rare ones come by.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from barspan.llm.text import counts_to_offsets, differing, distinct, flat_places, word_hashes

#: Memory of a store: bytes and ids of its segments and ENTRY_BYTES for each (table, dictionary, offsets).
MOST_BYTES, ENTRY_BYTES = 64_000_000, 150
#: Segments that are found without the dictionary: one for each value of a hash's first bits.
TABLE_BITS = 17


class SegmentStore:
    """Token runs of segments. ``encode`` maps new segments (bytes) to their runs of ids."""

    def __init__(self, encode: Callable[[list[bytes]], list]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.slot_of: dict[int, int] = {}
        self.odd: dict[bytes, int] = {}  # segments whose hash another one has
        self.pending: list[bytes] = []
        self.table_name = np.zeros(1 << TABLE_BITS, np.uint64)
        self.table_slot = np.full(1 << TABLE_BITS, -1, np.int64)
        self.n = 0  # slots given out
        self.name = np.zeros(1 << 12, np.uint64)
        self.hits = np.zeros(1 << 12, np.int64)
        self.at = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.data = np.zeros(1 << 14, np.uint8)
        self.lengths = np.zeros(1 << 12, np.int64)
        self.starts = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.used = self.filled = self.bytes = 0

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray | None = None) -> np.ndarray:
        """The slot of every segment (``names``: its hash); slots of new segments are filled by settle()."""
        names = word_hashes(data, starts, ends) if names is None else names
        place = (names >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        slots = np.where(self.table_name[place] == names, self.table_slot[place], -1)
        rest = np.flatnonzero(slots < 0)
        if len(rest):
            own, first, number = distinct(names[rest])
            found = np.fromiter(map(self.slot_of.get, own.tolist(), [-1] * len(own)), np.int64, len(own))
            new = np.flatnonzero(found < 0)
            if len(new):
                at = rest[first[new]]
                found[new] = self._add(data, starts[at], ends[at], own[new])
                self.slot_of.update(zip(own[new].tolist(), found[new].tolist()))
            place = (own >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            self.table_name[place], self.table_slot[place] = own, found
            # Of two that fall on one place, the name and the slot of the same one are kept.
            self.table_slot[place] = np.fromiter(map(self.slot_of.get, self.table_name[place].tolist()), np.int64, len(place))
            slots[rest] = found[number]
        unlike = differing(data, starts, ends - starts, self.data[: self.bytes], self.at[slots], self.size[slots])
        for k in unlike.tolist():
            segment = data[starts[k] : ends[k]].tobytes()
            if segment not in self.odd:
                self.odd[segment] = int(self._add(data, starts[k : k + 1], ends[k : k + 1], names[k : k + 1])[0])
            slots[k] = self.odd[segment]
        self.hits[: self.n] += np.bincount(slots, minlength=self.n)
        return slots

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Slots for segments that have none."""
        sizes = ends - starts
        have, more = self.n, len(starts)
        for array in ("name", "hits", "at", "size"):
            setattr(self, array, _room(getattr(self, array), have, more))
        self.data = _room(self.data, self.bytes, int(sizes.sum()))
        whole = data[flat_places(starts, ends)]
        offsets = self.bytes + counts_to_offsets(sizes)
        self.data[self.bytes : self.bytes + len(whole)] = whole
        self.name[have : have + more], self.hits[have : have + more] = names, 0
        self.at[have : have + more], self.size[have : have + more] = offsets[:-1], sizes
        self.n, self.bytes = have + more, self.bytes + len(whole)
        text, cuts = whole.tobytes(), (offsets - offsets[0]).tolist()
        self.pending += [text[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return np.arange(have, have + more)

    def settle(self) -> None:
        if not self.pending:
            return
        runs = self.encode(self.pending)
        if isinstance(runs, FlatRuns):
            lengths, flat = np.diff(runs.offsets), runs.ids
        else:
            lengths = np.fromiter(map(len, runs), np.int64, len(runs))
            flat = np.fromiter(chain.from_iterable(runs), np.uint32, int(lengths.sum()))
        self.lengths = _room(self.lengths, self.used, len(runs))
        self.starts = _room(self.starts, self.used, len(runs))
        self.ids = _room(self.ids, self.filled, len(flat))
        self.lengths[self.used : self.used + len(runs)] = lengths
        self.starts[self.used : self.used + len(runs)] = self.filled + counts_to_offsets(lengths)[:-1]
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.used += len(runs)
        self.filled += len(flat)
        self.pending = []

    def tokens(self, slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of the texts; ``first``: their first segments."""
        lengths = self.lengths[slots]
        offsets = counts_to_offsets(lengths)
        ids = self.ids[np.repeat(self.starts[slots] - offsets[:-1], lengths) + np.arange(offsets[-1])]
        return ids, offsets[first]

    def memory(self) -> int:
        return self.bytes + 4 * self.filled + ENTRY_BYTES * self.n

    def full(self) -> bool:
        return self.memory() > MOST_BYTES

    def shrink(self) -> None:
        """Keep the segments met most often, in half of the memory; call it between blocks, when no slot is in use."""
        size = self.size[: self.n] + 4 * self.lengths[: self.n] + ENTRY_BYTES
        order = np.argsort(-self.hits[: self.n], kind="stable")
        keep = np.sort(order[np.cumsum(size[order]) <= MOST_BYTES // 2])
        old = {a: getattr(self, a) for a in ("name", "hits", "at", "size", "data", "lengths", "starts", "ids")}
        odd = set(self.odd.values())
        keep = keep[~np.isin(keep, list(odd))] if odd else keep
        self.clear()
        n = self.n = self.used = len(keep)
        self.name, self.hits, self.size, self.lengths = old["name"][keep], old["hits"][keep] // 2, old["size"][keep], old["lengths"][keep]
        self.data = old["data"][flat_places(old["at"][keep], old["at"][keep] + self.size)]
        self.ids = old["ids"][flat_places(old["starts"][keep], old["starts"][keep] + self.lengths)]
        self.at, self.starts = counts_to_offsets(self.size)[:-1], counts_to_offsets(self.lengths)[:-1]
        self.bytes, self.filled = len(self.data), len(self.ids)
        self.slot_of = dict(zip(self.name.tolist(), range(n)))


def drop_stores() -> None:
    """Drop the stores that tasks of a tokenizer left in this worker, and give their memory back to the system.

    A worker outlives its tasks; those of another operator call this first.
    """
    modules = (sys.modules.get(f"barspan.llm.{name}") for name in ("bytebpe", "tokencounts", "wordbpe"))
    left = [m._stores for m in modules if m and m._stores]
    for stores in left:
        stores.clear()
    if left:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


class FlatRuns:
    """Runs of ids as one array with offsets."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray):
        self.ids, self.offsets = ids, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(array):
        return array
    grown = np.zeros(max(2 * len(array), used + more), array.dtype)
    grown[:used] = array[:used]
    return grown
