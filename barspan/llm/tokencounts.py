"""Token counts with a whole-token shortcut, for a ``sentencepiece`` BPE model.

Offline, each vocabulary string that begins with one space mark is encoded alone; those that come back as the
one token they are form the proven set. In a text, units (a run of spaces and what follows it up to the next
space) that stand in the proven set count one, without a merge; only the others are merged, each distinct one
once per worker.

Units are independent because no vocabulary string has a space mark behind another character, so no merge
reaches across the start of a unit; ``proven`` checks that and refuses a model for which it isn't so. The
model itself puts a space mark before a text.

Defined cases: a null text is empty; an empty text has no tokens; texts of any length are counted whole; extra
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from barspan.llm.segments import SegmentStore
from barspan.llm.text import counts_to_offsets, raw, slices, word_hashes

MARK = "▁"


def _model(content: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=content)


def proven(content: bytes) -> list[bytes]:
    """Units (with their leading space) that the model encodes as one token."""
    model = _model(content)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces) or model.encode("a  b") == model.encode("a b"):
        raise ValueError("units of this model aren't independent")
    single = [(k, p[1:]) for k, p in enumerate(pieces) if p.startswith(MARK) and p.count(MARK) == 1 and len(p) > 1]
    return [b" " + p.encode() for (k, p), ids in zip(single, model.encode([p for _, p in single], num_threads=1)) if ids == [k]]


def unit_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every unit, and the first unit of every text (len + 1 entries)."""
    cut = data == 32
    joined = np.zeros(len(data), bool)  # behind another space mark, in either spelling
    joined[1:] = cut[:-1]
    if len(data) > 3:
        joined[3:] |= (data[:-3] == 0xE2) & (data[1:-2] == 0x96) & (data[2:-1] == 0x81)
    cut &= ~joined
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


class UnitEncoder:
    def __init__(self, content: bytes):
        self.model = _model(content)

    def __call__(self, units: list[bytes]) -> list[list[int]]:
        # The model adds the space mark that each unit begins with; a unit that is a mark alone is one token.
        mark = [self.model.piece_to_id(MARK)]
        return [ids if len(unit) > 1 else mark for unit, ids in zip(units, self.model.encode([u[1:].decode() for u in units], num_threads=1))]


_stores: dict[int, tuple[SegmentStore, np.ndarray]] = {}


def _store(content: bytes, whole: list[bytes]) -> tuple[SegmentStore, np.ndarray]:
    key = hash(content)
    if key not in _stores:
        offsets = counts_to_offsets(np.array([len(w) for w in whole], np.int64))
        data = np.frombuffer(b"".join(whole), np.uint8)
        _stores.clear()
        _stores[key] = SegmentStore(UnitEncoder(content)), np.sort(word_hashes(data, offsets[:-1], offsets[1:]))
    return _stores[key]


def token_counts(docs: DataFrame, content: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row. ``content``: the model file."""
    shared = docs.sparkSession.sparkContext.broadcast((content, proven(content)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, known = _store(*shared.value)
        for batch, texts in slices(batches):
            sizes = np.diff(raw(texts)[1])
            spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
            data, offsets = raw(spaced)
            if not len(data):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(sizes)], schema=schema)
                continue
            starts, ends, first = unit_bounds(data, offsets)
            names = word_hashes(data, starts, ends)
            counts = np.ones(len(starts), np.int64)
            rest = np.flatnonzero(known[np.minimum(np.searchsorted(known, names), len(known) - 1)] != names)
            slots = store.look_up(data, starts[rest], ends[rest], names[rest])
            store.settle()
            counts[rest] = store.lengths[slots]
            upto = counts_to_offsets(counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(np.diff(upto[first]))], schema=schema)
            if store.full():
                store.shrink()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
