"""Packing token sequences of documents into windows: best fit, decreasing.

A document's ids are cut into full windows and a rest shorter than a window. Rests are packed longest first,
each into the tightest open window that holds it; a segment tree over the remaining capacities finds it.

Only the number of rests per length matters for that, so the packing runs on a histogram (at most WINDOW
rows): equal rests and windows with equal room are taken together, as runs. A run says: rests of this length,
ranks a to b, go to windows w to w + b - a at this offset. Ranks come from counts per task, so no length,
however common, meets in one task, and the whole table is packed as one.

Defined cases: a null text is empty; an empty text has the end id alone; equal documents are packed each by
itself; an empty table has no pieces; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from barspan.llm import wordbpe
from barspan.llm.text import counts_to_offsets
from barspan.plans.tables import written

WINDOW = 2048
END_ID = 1


class CapacityTree:
    """Numbers of open windows by remaining capacity; finds the smallest capacity from a given one on."""

    def __init__(self, most: int):
        self.base = 1
        while self.base <= most:
            self.base *= 2
        self.open = [0] * (2 * self.base)

    def add(self, capacity: int, windows: int) -> None:
        node = capacity + self.base
        while node:
            self.open[node] += windows
            node //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least with an open window."""
        node = least + self.base
        if self.open[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.base:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.base
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, rests, first window, offset) and the number of windows.

    A window that takes a rest is then the tightest one for rests of the same length, as long as they fit;
    hence windows of equal room take as many equal rests as fit before the next ones are looked at.
    """
    tree = CapacityTree(window)
    open_at: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    windows = 0

    def fill(length: int, rank: int, first: int, n: int, room: int, each: int) -> None:
        for slot in range(each):
            runs.append((length, rank + slot * n, n, first, window - room + slot * length))
        left = room - each * length
        if left:
            tree.add(left, n)
            open_at.setdefault(left, []).append((first, n))

    for length in sorted((x for x in counts if 0 < x < window), reverse=True):
        rank, rests = 0, counts[length]
        while rests:
            room = tree.tightest(length)
            if room is None:
                first, have, room = windows, None, window
            else:
                first, have = open_at[room].pop()
            each = min(room // length, rests)
            n = rests // each if have is None else min(rests // each, have)
            if have is None:
                windows += n
            else:
                tree.add(room, -have)
                if n < have:
                    open_at[room].append((first + n, have - n))
                    tree.add(room, have - n)
            fill(length, rank, first, n, room, each)
            rank += n * each
            rests -= n * each
    return runs, windows


_PIECES = pa.schema(
    [("part", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("place", pa.int64()), ("ids", pa.binary())]
)


def cut(docs: DataFrame, content: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every document; ``place`` numbers the pieces of one length within a task (``part``)."""
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch, ids, offsets in wordbpe.encoded(batches, shared.value):
            total = np.diff(offsets) + 1
            whole = np.insert(ids, offsets[1:], end_id).astype("<u4")
            pieces = -(-total // window)
            doc = np.repeat(np.arange(len(total)), pieces)
            start = (np.arange(len(doc)) - np.repeat(counts_to_offsets(pieces)[:-1], pieces)) * window
            length = np.minimum(total[doc] - start, window)
            order = np.argsort(length, kind="stable")
            each = np.bincount(length, minlength=window + 1)
            place = np.empty(len(doc), np.int64)
            place[order] = seen[length[order]] + np.arange(len(doc)) - counts_to_offsets(each)[length[order]]
            seen += each
            cuts = pa.array(4 * counts_to_offsets(length), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(doc), part)), batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length.astype(np.int32)),
                    pa.array(total[doc]), pa.array(place), pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, cuts.buffers()[1], pa.py_buffer(whole)]),
                ],
                schema=_PIECES,
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "part long, doc_id long, start long, length int, doc_tokens long, place long, ids binary"
    )


def pack(
    docs: DataFrame, content: str, end_id: int = END_ID, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (uint32 each).

    ``content`` is a tokenizers file. Texts are read once; the pieces are written, counted and placed.
    """
    pieces = written(cut(docs, content, end_id, window, id_col, text_col), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    # At most ``window`` rows, whatever the input's size.
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, windows = best_fit_decreasing(counts, window)
    runs = sorted(runs)
    lengths, ranks, _, firsts, offsets = (np.array([r[k] for r in runs], np.int64) for k in range(5))
    shared = docs.sparkSession.sparkContext.broadcast((lengths * (1 << 40) + ranks, ranks, firsts, offsets))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length, rank):
        import pandas as pd

        keys, ranks, firsts, offsets = shared.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        full = length == window
        out = pd.DataFrame({"sequence_id": windows + rank, "offset": np.zeros(len(rank), np.int64)})
        if not full.all():
            at = np.searchsorted(keys, length[~full] * (1 << 40) + rank[~full], side="right") - 1
            out.loc[~full, "sequence_id"] = firsts[at] + rank[~full] - ranks[at]
            out.loc[~full, "offset"] = offsets[at]
        return out

    ranked = pieces.join(base, ["part", "length"]).withColumn("at", placed(F.col("length").cast("long"), F.col("base") + F.col("place")))
    return ranked.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "at.sequence_id", "at.offset", "ids"
    )
