"""Stretches of words that repeat with a period, and the text without the repeats.

A run is a stretch with smallest period q, of MIN_LENGTH words and MIN_TURNS * q at least, that can't be
extended. Every word of a run comes MIN_TURNS times in it. So a word that comes less often in a segment can be
in no run there and splits it; the parts are counted anew, until nothing splits. Ordinary text is gone
after a few rounds.

What survives is scanned by lags. Lags below SHORT are compared word by word over all segments at once. For
lags of 2^k to 2^(k+1) - 1, only those are scanned at which a window of 2^(k+1) words comes again: in a run of
such a period q, a window that begins at a multiple of 2^k near the run's start lies in the run together with
its next copy, which is exactly q words on (a nearer one would make a smaller period). The scan then runs
left and right from there until words differ. Windows are named exactly, by doubling; a text of m surviving words
takes m log m steps per doubling, whatever its periods.

Words are compared by their bytes. A row is worked off in one task, whose memory follows the longest text.

Defined cases: a null or wordless text has no runs and collapses to the empty text; texts of any length are
scanned whole; runs are listed by start, then period; rows that repeat an id are separate rows; a null id
stays null; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barspan.llm.text import counts_to_offsets, flat_places, raw, slices, word_bounds, word_codes

MIN_LENGTH, MIN_TURNS = 6, 4
#: Lags up to here are compared everywhere; beyond, where windows come again. A power of two.
SHORT = 16

_DIVISORS = {q: [d for d in range(1, q) if q % d == 0] for q in range(1, SHORT)}


def survivors(codes: np.ndarray, first: np.ndarray, least: int = MIN_TURNS, shortest: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments left when rare words split the texts (``first``: len + 1 first words)."""
    long = np.diff(first) >= shortest
    starts, ends = first[:-1][long], first[1:][long]
    kinds = int(codes.max(initial=0)) + 1
    stable = [(starts[:0], ends[:0])]
    while len(starts):
        at = flat_places(starts, ends)
        segment = np.repeat(np.arange(len(starts)), ends - starts)
        _, place, count = np.unique(segment * kinds + codes[at], return_inverse=True, return_counts=True)
        rare = count[place] < least
        split = np.zeros(len(starts), bool)
        split[segment[rare]] = True
        stable.append((starts[~split], ends[~split]))
        left = ~rare & split[segment]
        edge = np.flatnonzero(np.diff(left, prepend=False, append=False) | np.diff(segment, prepend=-1, append=-1).astype(bool))
        opens = edge[:-1][left[edge[:-1]]]
        closes = edge[1:][left[edge[:-1]]]
        long = closes - opens >= shortest
        starts, ends = at[opens[long]], at[closes[long] - 1] + 1
    starts, ends = (np.concatenate(x) for x in zip(*stable))
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def _joined(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments one after another, each closed by a word of its own, and where their words stood."""
    offsets = counts_to_offsets(ends - starts + 1)
    at = np.repeat(starts - offsets[:-1], ends - starts + 1) + np.arange(offsets[-1])
    words = np.empty(len(at), np.int64)
    closing = np.zeros(len(at), bool)
    closing[offsets[1:] - 1] = True
    words[~closing] = codes[at[~closing]]
    words[closing] = -1 - np.arange(len(starts))
    return words, at


def _extended(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch around ``at`` in which every word equals the one ``lag`` on (start, end of the equal ones)."""
    lo, hi, step = at, at + 1, 2 * lag
    while lo > 0:
        a = max(0, lo - step)
        differ = np.flatnonzero(words[a:lo] != words[a + lag : lo + lag])
        if len(differ):
            lo = a + int(differ[-1]) + 1
            break
        lo, step = a, 2 * step
    step = 2 * lag
    while hi < len(words) - lag:
        b = min(len(words) - lag, hi + step)
        differ = np.flatnonzero(words[hi:b] != words[hi + lag : b + lag])
        if len(differ):
            hi += int(differ[0])
            break
        hi, step = b, 2 * step
    return lo, hi


def short_lags(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of periods below SHORT; ``longest``: words of the longest segment."""
    found = []
    for q in range(1, min(SHORT - 1, longest // MIN_TURNS) + 1):
        edge = np.flatnonzero(np.diff(words[:-q] == words[q:], prepend=False, append=False))
        opens, closes = edge[::2], edge[1::2]
        enough = closes - opens + q >= max(MIN_LENGTH, MIN_TURNS * q)
        for a, b in zip(opens[enough].tolist(), closes[enough].tolist()):
            if not any(np.array_equal(words[a : a + q], words[a + d : a + d + q]) for d in _DIVISORS[q]):
                found.append((a, b - a + q, q))
    return found


def long_lags(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of periods from SHORT on."""
    found = []
    names, size, low = words, 1, SHORT
    while MIN_TURNS * low <= longest:
        while size < 2 * low:  # names of windows twice as long; those past the end are left out
            if len(names) <= size:
                return found
            _, names = np.unique(names, return_inverse=True)
            names, size = names[:-size].astype(np.int64) * len(words) + names[size:], 2 * size
        order = np.argsort(names, kind="stable")
        again = names[order[:-1]] == names[order[1:]]
        here, gap = order[:-1][again], np.diff(order)[again]
        some = (here % low == 0) & (gap >= low) & (gap < 2 * low)
        seen: dict[int, int] = {}
        for at, lag in sorted(zip(here[some].tolist(), gap[some].tolist())):
            if at < seen.get(lag, 0):
                continue
            a, b = _extended(words, at, lag)
            seen[lag] = b
            if b - a + lag >= MIN_TURNS * lag:
                found.append((a, b - a + lag, lag))
        low *= 2
    return found


def all_runs(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period), sorted, of all runs of all texts; starts are words of the text."""
    starts, ends = survivors(codes, first)
    if not len(starts):
        return np.zeros((0, 4), np.int64)
    words, at = _joined(codes, starts, ends)
    longest = int((ends - starts).max())
    found = np.array(short_lags(words, longest) + long_lags(words, longest), np.int64).reshape(-1, 3)
    begin = at[found[:, 0]]
    text = np.searchsorted(first, begin, side="right") - 1
    rows = np.column_stack([text, begin - first[text], found[:, 1], found[:, 2]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def kept_words(n: int, first: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which of the n words no run holds behind its first period."""
    depth = np.zeros(n + 1, np.int64)
    begin = first[runs[:, 0]] + runs[:, 1]
    np.add.at(depth, begin + runs[:, 3], 1)
    np.add.at(depth, begin + runs[:, 2], -1)
    return np.cumsum(depth[:-1]) == 0


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, n: int) -> pa.Array:
    """The words of each of n texts (``text``: the text of every word, ascending) joined by one space."""
    size = ends - starts + 1
    offsets = counts_to_offsets(size)
    out = np.full(offsets[-1], 32, np.uint8)
    out[flat_places(offsets[:-1], offsets[1:] - 1)] = data[flat_places(starts, ends)]
    gap = np.zeros(len(text), bool)
    gap[:-1] = text[1:] == text[:-1]  # no space behind a text's last word
    use = np.ones(len(out), bool)
    use[offsets[1:][~gap] - 1] = False
    lengths = np.bincount(text, size - ~gap, n).astype(np.int64)
    bounds = counts_to_offsets(lengths)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds), pa.py_buffer(out[use]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (array<struct<start,length,period>> in words) and collapsed (the text without repeats) of every row."""
    names = ("start", "length", "period")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            data, offsets = raw(texts)
            starts, ends, first = word_bounds(data, offsets)
            runs = all_runs(word_codes(data, starts, ends), first)
            keep = kept_words(len(starts), first, runs)
            text = np.repeat(np.arange(len(texts)), np.diff(first))
            listed = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], names=names)
            bounds = counts_to_offsets(np.bincount(runs[:, 0], minlength=len(texts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), listed), joined_words(data, starts[keep], ends[keep], text[keep], len(texts)).cast(pa.string())],
                names=["doc_id", "runs", "collapsed"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
