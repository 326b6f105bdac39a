"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of a block of texts (a partition, or BLOCK_BYTES of it) are laid out as one row of
symbols. An inverted index leads from the rank of a pair to the places where such a pair stands; ranks are
replayed in ascending order, each once, on all its places at a time, and only the pairs that touch a merged
place are looked up anew. The result equals merging each pre-token by itself, lowest rank first and leftmost
first: places of one rank that overlap are taken from the left, and a pre-token in which a merge opens a pair
of no higher rank is redone by that plain rule.

Segments: every space that a letter, digit or sign may take along opens a segment, so the pattern finds the
same pre-tokens in a segment as in the whole text. A space inside a run of white space opens none, and a text
with white space beyond ASCII is one segment.

Decoding joins the tokens' bytes. Defined cases: a null text is empty and has no tokens; texts of any length are
encoded whole; extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barspan.llm.segments import FlatRuns, SegmentStore
from barspan.llm.text import counts_to_offsets, raw, slices

#: Bytes of text whose new pre-tokens are merged together.
BLOCK_BYTES = 48_000_000

_NONE = np.int64(1 << 40)
_WIDE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Lines of ``base64 rank``."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


class Merges:
    """Token pairs and the rank of the token they make."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = max(ranks.values()) + 1
        keys, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    made.append(rank)
        order = np.argsort(keys)
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def plain(self, word: bytes) -> list[int]:
        """One word by the plain rule: merge the leftmost pair of lowest rank until none is left."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, _NONE), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == _NONE:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> FlatRuns:
        """Ids of every word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        offsets = counts_to_offsets(sizes)
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        total = len(symbol)
        if not total:
            return FlatRuns(np.zeros(0, np.uint32), offsets)
        word_of = np.repeat(np.arange(len(words)), sizes)
        after = np.arange(1, total + 1)
        before = np.arange(-1, total - 1)
        after[offsets[1:][sizes > 0] - 1] = -1
        before[offsets[:-1][sizes > 0]] = -1
        alive = np.ones(total, bool)
        rank = np.full(total, _NONE)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])

        index: dict[int, list[np.ndarray]] = {}

        def enter(places: np.ndarray) -> None:
            own = rank[places]
            order = np.argsort(own, kind="stable")
            places, own = places[order], own[order]
            cuts = np.flatnonzero(np.diff(own)) + 1
            starts = np.concatenate(([0], cuts)).tolist()
            for r, a, b in zip(own[starts].tolist(), starts, [*cuts.tolist(), len(own)]):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(waiting, r)

        waiting: list[int] = []
        pairs = np.flatnonzero(rank < _NONE)
        if len(pairs):
            enter(pairs)
        redo: list[np.ndarray] = []
        while waiting:
            r = heapq.heappop(waiting)
            found = index.pop(r)
            places = found[0] if len(found) == 1 else np.concatenate(found)
            places = places[rank[places] == r]
            if len(places) > 1:
                places = np.unique(places)
            if not len(places):
                continue
            chained = np.zeros(len(places), bool)
            chained[1:] = after[places[:-1]] == places[1:]
            if chained.any():
                head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(places))))
                places = places[(np.arange(len(places)) - head) % 2 == 0]
            gone = after[places]
            symbol[places] = r
            following = after[gone]
            after[places] = following
            inside = following >= 0
            before[following[inside]] = places[inside]
            alive[gone] = False
            rank[gone] = _NONE
            left = before[places]
            touched = np.concatenate((places, left[left >= 0]))
            touched = touched[alive[touched]]
            if len(touched) > 1:
                touched = np.unique(touched)
            right = after[touched]
            open_ = right >= 0
            rank[touched[~open_]] = _NONE
            touched, right = touched[open_], right[open_]
            if len(touched):
                new = self.rank(symbol[touched], symbol[right])
                rank[touched] = new
                early = new <= r
                if early.any():
                    redo.append(word_of[touched[early]])
                    new = np.where(early, _NONE, new)
                    rank[touched[early]] = _NONE
                touched = touched[new < _NONE]
                if len(touched):
                    enter(touched)
        lengths = np.bincount(word_of[alive], minlength=len(words))
        ids = symbol[alive]
        if redo:
            bad = np.unique(np.concatenate(redo))
            runs = np.split(ids, np.cumsum(lengths)[:-1])
            for k in bad.tolist():
                runs[k] = np.array(self.plain(words[k]), np.int64)
                lengths[k] = len(runs[k])
            ids = np.concatenate(runs)
        return FlatRuns(ids.astype(np.uint32), counts_to_offsets(lengths))


class SegmentEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        space = rf"\t-\r {_WIDE}"
        self.pattern = regex.compile(pattern.replace(r"[^\s", rf"[^{space}").replace(r"\s", rf"[{space}]").replace(r"\S", rf"[^{space}]"))
        self.merges = Merges(ranks)

    def __call__(self, segments: list[bytes]) -> FlatRuns:
        place: dict[str, int] = {}
        parts: list[int] = []
        counts = []
        for segment in segments:
            found = self.pattern.findall(segment.decode())
            counts.append(len(found))
            parts += [place.setdefault(p, len(place)) for p in found]
        made = self.merges.replay([p.encode() for p in place])
        part = np.array(parts, np.int64)
        lengths = np.diff(made.offsets)[part]
        offsets = counts_to_offsets(lengths)
        ids = made.ids[np.repeat(made.offsets[:-1][part] - offsets[:-1], lengths) + np.arange(offsets[-1])]
        return FlatRuns(ids, offsets[counts_to_offsets(np.array(counts, np.int64))])


def segment_bounds(data: np.ndarray, offsets: np.ndarray, ascii_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every segment, and the first segment of every text (len + 1 entries)."""
    white = (data == 32) | ((data >= 9) & (data <= 13))
    last = np.zeros(len(data) + 1, bool)
    last[offsets] = True  # of a position: a text starts here (or the slice ends)
    behind = np.ones(len(data), bool)
    behind[1:] = white[:-1]
    ahead = np.ones(len(data), bool)
    ahead[:-1] = white[1:]
    ahead |= last[1:]
    cut = (data == 32) & ~(behind & ahead)
    if not ascii_only:
        for k in range(len(offsets) - 1):
            a, b = offsets[k], offsets[k + 1]
            if (data[a:b] >= 0x80).any() and _has_wide_space(data[a:b]):
                cut[a:b] = False
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


def _has_wide_space(text: np.ndarray) -> bool:
    a, b = text[:-1], text[1:]
    if (((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE3) & (b == 0x80))).any():
        return True
    return bool((((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81)))).any())


_stores: dict[int, tuple[SegmentStore, list[bytes]]] = {}


def _store(content: bytes, pattern: str) -> tuple[SegmentStore, list[bytes]]:
    key = hash((content, pattern))
    if key not in _stores:
        ranks = read_ranks(content)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        _stores.clear()
        _stores[key] = SegmentStore(SegmentEncoder(ranks, pattern)), tokens
    return _stores[key]


def encoded(batches: Iterable[pa.RecordBatch], content: bytes, pattern: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice of the batch, ids of its texts one after another, len + 1 offsets), block by block."""
    store, _ = _store(content, pattern)
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
    size = 0

    def finish() -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        store.settle()
        for batch, slots, first in held:
            yield batch, *store.tokens(slots, first)
        held.clear()
        if store.full():
            store.shrink()

    for batch, texts in slices(batches):
        data, offsets = raw(texts)
        if len(data):
            starts, ends, first = segment_bounds(data, offsets, bool((data < 0x80).all()))
            held.append((batch, store.look_up(data, starts, ends).astype(np.int32), first))
        else:
            held.append((batch, np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)))
        size += len(data)
        if size >= BLOCK_BYTES:
            yield from finish()
            size = 0
    yield from finish()


def encode(docs: DataFrame, content: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row, as the vocabulary's own library gives them."""
    shared = docs.sparkSession.sparkContext.broadcast((content, pattern))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, offsets in encoded(batches, *shared.value):
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded_docs: DataFrame, content: bytes) -> DataFrame:
    """doc_id and bytes (binary) of every row of doc_id, ids."""
    shared = encoded_docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in read_ranks(shared.value).items()}
        for batch in batches:
            texts = [b"".join(map(tokens.__getitem__, x)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return encoded_docs.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, content: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as decimals, comma-joined) and decoded_sha256, without moving the ids."""
    shared = docs.sparkSession.sparkContext.broadcast((content, pattern))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, pattern = shared.value
        tokens = _store(content, pattern)[1]
        decimals = [b"%d" % k for k in range(len(tokens))]
        for batch, ids, offsets in encoded(batches, content, pattern):
            listed, at = ids.tolist(), offsets.tolist()
            digests = [
                (hashlib.sha256(b",".join(map(decimals.__getitem__, listed[a:b]))).hexdigest(), hashlib.sha256(b"".join(map(tokens.__getitem__, listed[a:b]))).hexdigest())
                for a, b in zip(at[:-1], at[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array([d[0] for d in digests]), pa.array([d[1] for d in digests])], schema=schema
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
