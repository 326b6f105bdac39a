"""A class-based n-gram language model after Brown: P(w_i | w_i-1) = P(c_i | c_i-1) P(w_i | c_i).

Tokens are words (lower case A-Z) and one end per text, a class of its own. A unit is a word that the training
texts have at least LEAST times, or all rarer words (and unknown ones) whose last two bytes have the same hash; so
every word has a class, and both the units and the classes (half the root of the units) grow with the input.

Exchange clustering gives units their classes. One pass over the training texts counts the pairs of neighbouring
units into a table in which all pairs of a unit lie together, dealt over tasks. The HEAVY most frequent units have
no rows of their own there: their pairs with others lie with these, those among themselves once. A round counts the class bigrams, moves the heavy units one after the other on the
driver, then all others in their tasks, each to the class that raises the likelihood of the class bigrams most.
Rounds run until one adds less than LEAST_GAIN of all that was gained.

Transitions are smoothed towards the classes' own frequencies, emissions by ALPHA added to each word of the
class and to one unknown word. The base score is the add-one unigram score of the same tokens.

Counts of words travel as a table; the KNOWN most frequent go to every task as a bounded one (6 MB). Only other
words of a text are joined with the table. Word identity is a 64-bit hash.

Defined cases: a null text is empty; an empty text is one end token; a row without doc_id is training text;
repeated rows count and are scored each by itself; with no training text all probabilities are those of smoothing
alone; extra columns of the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from barspan.llm.text import U, lowered, mix, raw, slices, word_bounds, word_hashes
from barspan.plans.tables import written

#: Words seen this often have a unit of their own.
LEAST = 3
GROUPS = 1 << 10
#: The fewest classes; see ``classes_for``.
CLASSES = 64
LEAST_GAIN = 1e-3
#: Units whose pairs lie with their neighbours.
HEAVY = 1 << 10
KNOWN = 1 << 19
ALPHA = 0.5
BETA = 10.0
#: Entries of a vector of counts that travel together.
CHUNK = 1 << 16
#: Tokens whose pairs a task counts before it sends them, pairs a task merges, pairs in a row of their table.
TOKENS, MERGED, ROW = 1 << 19, 1 << 20, 1 << 16
#: Pairs, before equal ones are merged, in a file of their table, which one task of a round reads.
READ = 1 << 23
#: Entries of a dense matrix of units and classes.
DENSE = 1 << 19
#: Numbers in a block of lines of gains that are added up.
LINES = 1 << 17
#: Units that have neighbours in up to one class of so many add up lines, others are multiplied as dense ones.
FEW = 20
#: Units whose cells (units times classes) are up to so many times their pairs are counted in cells.
SPARSE = 8
#: Places that a word is looked for in turn before a search.
NEXT = 8
#: Pairs of neighbouring units that are counted together.
COUNTED = 1 << 20


def classes_for(units: int) -> int:
    return max(CLASSES, math.isqrt(units) // 2)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


#: The spelling group of each number that two bytes make.
_GROUP = (mix(np.arange(1 << 16, dtype=np.uint64)) % U(GROUPS)).astype(np.int64)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and spelling group of every word of a slice, and the first word of every text (len + 1)."""
    data, offsets = raw(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    data = lowered(data)
    starts, ends, first = word_bounds(data, offsets)
    tail = data.take(ends - 1).astype(np.uint16) * np.uint16(256) + data.take(ends - 2, mode="clip") * (ends - starts > 1)
    return word_hashes(data, starts, ends), _GROUP.take(tail), first


class Places:
    """Where words are among ascending hashes: the first bits of a hash lead next to it."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes, bits = hashes, max(1, len(hashes).bit_length())
        self.shift = U(64 - bits)
        self.first = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``searchsorted``, the last place at most; and whether the word is there."""
        at = self.first.take((words >> self.shift).view(np.int64), mode="clip")
        last = len(self.hashes) - 1
        found = self.hashes.take(at, mode="clip")
        more = np.flatnonzero(found < words)
        for _ in range(NEXT):
            at[more] += 1
            more = more.take(np.flatnonzero(self.hashes.take(at.take(more), mode="clip") < words.take(more)))
            if not len(more):
                break
        at[more] = np.searchsorted(self.hashes, words.take(more))
        at = np.minimum(at, last)
        return at, self.hashes.take(at, mode="clip") == words


@dataclass
class Vocabulary:
    """The words with a unit of their own (hashes ascending), their units, and the number of units but the end."""

    hashes: np.ndarray
    unit: np.ndarray

    @cached_property
    def places(self) -> Places:
        return Places(self.hashes)

    @property
    def units(self) -> int:
        return len(self.hashes) + GROUPS

    def units_of(self, words: np.ndarray, groups: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return groups
        at, have = self.places.of(words)
        return np.where(have, self.unit.take(at, mode="clip"), len(self.hashes) + groups)


def word_counts(train: DataFrame) -> DataFrame:
    """word (hash), group, n of every word of the training texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, texts in slices(batches):
            held.append(_words(texts)[:2])
            size += len(held[-1][0])
            if size >= TOKENS:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        words, groups = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(words)
        words = words.take(order)
        new = _starts(words)
        n = np.diff(np.append(new, len(words)))
        return pa.RecordBatch.from_arrays([pa.array(words.take(new).view(np.int64)), pa.array(groups.take(order.take(new)).astype(np.int32)), pa.array(n)], names=["word", "group", "n"])

    return train.mapInArrow(run, "word long, group int, n long").groupBy("word", "group").agg(F.sum("n").alias("n"))


_PAIRS = "part int, pairs binary"


def _sent(unit: np.ndarray, other: np.ndarray, n: np.ndarray) -> bytes:
    return np.concatenate((unit, other, n)).astype("<u4").tobytes()


#: Counts from here on lie apart in a row of pairs.
LARGE = 255


def _packed(unit: np.ndarray, other: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs in order of their units: each unit once with its number of pairs, counts in a byte where they fit."""
    starts = _starts(unit)
    large = np.flatnonzero(n >= LARGE)
    numbers = ([len(starts), len(unit), len(large)], unit[starts], np.diff(np.append(starts, len(unit))), other, large, n[large])
    return np.concatenate(numbers).astype("<u4").tobytes() + np.minimum(n, LARGE).astype(np.uint8).tobytes()


def _grouped(pairs: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of pairs the units, their numbers of pairs, and of each pair
    2 * other unit + (0: it follows, 1: it comes before) and its count."""
    units, size, large = np.frombuffer(pairs, "<u4", 3).tolist()
    numbers = np.frombuffer(pairs, "<u4", 2 * units + size + 2 * large, 12)
    n = np.frombuffer(pairs, np.uint8, size, 12 + numbers.nbytes)
    if large:
        n = n.astype(np.int64)
        n[numbers[-2 * large : -large]] = numbers[-large:]
    return numbers[:units], numbers[units : 2 * units], numbers[2 * units : 2 * units + size], n


def _unpacked(pairs: bytes) -> np.ndarray:
    """Rows unit, 2 * other unit + (0: it follows, 1: it comes before) and count."""
    units, sizes, other, n = _grouped(pairs)
    return np.stack((np.repeat(units, sizes), other, n)).astype(np.int64)


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)


def _summed(unit: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs as one, in order of unit and other."""
    if not len(unit):
        return unit, other, n
    low, bits = int(other.max()).bit_length(), int(n.max()).bit_length()
    key = unit << low | other
    if int(unit.max()).bit_length() + low + bits < 64:
        # A count that fits beside its pair is sorted with it, which is faster than by an order.
        key = np.sort(key << bits | n)
        n = key & (1 << bits) - 1
        key >>= bits
    else:
        order = np.argsort(key)
        key, n = key.take(order), n.take(order)
    new = _starts(key)
    key = key.take(new)
    return key >> low, key & (1 << low) - 1, np.add.reduceat(n, new)


def _places(heavy: np.ndarray) -> np.ndarray:
    """For every unit (the last of ``heavy`` is the last of all), its place among the heavy ones or -1."""
    out = np.full(heavy[-1] + 1, -1)
    out[heavy] = np.arange(len(heavy))
    return out


def unit_pairs(train: DataFrame, vocabulary: Vocabulary, heavy: np.ndarray, tokens: int) -> DataFrame:
    """Both sides of all pairs of neighbouring units (the end is the last unit) as packed rows.

    All pairs of a unit that is not heavy are in one row; pairs of two heavy units are there once, spread over tasks.
    """
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, heavy))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * tokens // MERGED))
    parts = 8 * tasks  # several for a task, so that tasks get about equally many

    def send(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        heavy = _places(shared.value[1]) >= 0
        key = np.sort(np.concatenate([r[:-1] << 32 | r[1:] for r in rows]))
        new = _starts(key)
        a, b, n = key[new] >> 32, key[new] & 0xFFFFFFFF, np.diff(np.append(new, len(key)))
        first, second = ~heavy[a] | heavy[b], ~heavy[b]
        unit, other, n = np.concatenate((a[first], b[second])), np.concatenate((2 * b[first], 2 * a[second] + 1)), np.concatenate((n[first], n[second]))
        spread = np.where(heavy[unit], other + 1, 0)
        part = (mix((unit << 32 | spread).astype(np.uint64)) % U(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
        order = np.argsort(part, kind="stable")
        part, unit, other, n = part[order], unit[order], other[order], n[order]
        cuts = np.append(_starts(part), len(part)).tolist()
        for k in range(0, len(cuts) - 1, 256):
            spans = list(zip(cuts[k : k + 256], cuts[k + 1 : k + 257]))
            yield pa.RecordBatch.from_arrays([pa.array([part[i] for i, _ in spans], pa.int32()), pa.array([_sent(unit[i:j], other[i:j], n[i:j]) for i, j in spans], pa.binary())], names=["part", "pairs"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value[0]
        end, rows, held = vocabulary.units, [], 0
        for _, texts in slices(batches):
            words, groups, first = _words(texts)
            # An end before the slice and behind every text.
            rows.append(np.concatenate(([end], np.insert(vocabulary.units_of(words, groups), first[1:], end))))
            held += len(rows[-1])
            if held >= TOKENS:
                yield from send(rows)
                rows, held = [], 0
        if rows:
            yield from send(rows)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(x, "<u4").reshape(3, -1) for batch in batches for x in batch.column("pairs").to_pylist()]
        if not found:
            return
        together = np.concatenate(found, axis=1)
        del found
        unit, other, n = _summed(*(x.astype(np.int64) for x in together))
        del together
        starts = _starts(unit)
        at = 0
        while at < len(unit):
            later = np.searchsorted(starts, at + ROW)
            end = int(starts[later]) if later < len(starts) else len(unit)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([_packed(unit[at:end], other[at:end], n[at:end])], pa.binary())], names=["part", "pairs"])
            at = end

    merged = train.mapInArrow(count, _PAIRS).repartition(tasks, "part").mapInArrow(merge, _PAIRS)
    # A task merges its parts one after the other and writes one file: each round starts a task for a file.
    table = written(merged.coalesce(max(spark.sparkContext.defaultParallelism, -(-2 * tokens // READ))), "unit-pairs")
    shared.destroy()
    return table


def class_counts(pairs: DataFrame, class_of: np.ndarray, classes: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class bigrams, and per heavy unit (ascending), how often each class follows it and comes before it.

    Each task counts into one fixed vector and sends it in compressed chunks; equal chunks are added one at a
    time. The size depends on the classes, not on the text.
    """
    shared = pairs.sparkSession.sparkContext.broadcast((class_of.astype(np.int32), heavy))
    width = classes + 1
    square, lines = width * width, len(heavy) * width
    length = square + 2 * lines
    schema = "at int, bytes int, counts binary"

    def sent(totals: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for at, part in totals:
            if part.any():
                kind = np.min_scalar_type(min(int(part.min()), -int(part.max()) - 1))
                packed = zlib.compress(part.astype(kind).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([kind.itemsize], pa.int32()), pa.array([packed], pa.binary())], names=["at", "bytes", "counts"])

    def received(size: int, counts: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(counts), f"i{size}")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, heavy = shared.value
        places, total = _places(heavy), np.zeros(length + width)
        # Where a pair's counter is, less the class of its unit: among the bigrams (the second class first) of units that
        # are not heavy, or in the line of a heavy neighbour. What such a unit has before it, another has behind it: that
        # goes behind the end.
        first = np.full(2 * len(places), length)
        first[::2] = class_of * np.int64(width)
        first[2 * heavy] = square + lines + np.arange(len(heavy)) * width
        first[2 * heavy + 1] = square + np.arange(len(heavy)) * width

        def counted(rows: list[tuple[np.ndarray, ...]]) -> None:
            units, sizes, other, n = (np.concatenate(x) for x in zip(*rows))
            at = first.take(other)
            at += np.repeat(class_of[units], sizes)
            total[:] += np.bincount(at, n, length + width)
            if (places[units] >= 0).any():
                # Two heavy ones are in the lines of both, so once less among the bigrams.
                both = np.flatnonzero(np.repeat(places[units] >= 0, sizes))
                unit, near, n = np.repeat(units, sizes)[both], class_of[other[both] >> 1].astype(np.int64), n[both]
                total[square : square + lines] += np.bincount(places[unit] * width + near, n, lines)
                total[:square] -= np.bincount(near * width + class_of[unit], n, square)

        rows, held = [], 0
        for batch in batches:
            for row in batch.column("pairs"):
                rows.append(_grouped(row.as_buffer()))
                held += len(rows[-1][-1])
                if held >= COUNTED:
                    counted(rows)
                    rows, held = [], 0
        if rows:
            counted(rows)
        yield from sent((at, total[at : min(at + CHUNK, length)].astype(np.int64)) for at in range(0, length, CHUNK))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                at, part = row["at"], received(row["bytes"], row["counts"])
                if at in totals:
                    totals[at] += part.astype(np.int64)
                else:
                    totals[at] = part.astype(np.int64)
        yield from sent(totals.items())

    out = np.zeros(length)
    for r in pairs.mapInArrow(count, schema).repartition(min(16, -(-length // (4 * CHUNK))), "at").mapInArrow(add, schema).collect():
        part = received(r["bytes"], bytes(r["counts"]))
        out[r["at"] : r["at"] + len(part)] = part
    shared.destroy()
    after, before = out[square:].reshape(2, len(heavy), width)
    bigrams = out[:square].reshape(width, width).T.copy()
    np.add.at(bigrams, class_of[heavy], after)
    np.add.at(bigrams.T, class_of[heavy], before)
    return bigrams, after, before


class Exchange:
    """What a unit gains in a class while all others stay, from the class bigrams."""

    def __init__(self, bigrams: np.ndarray) -> None:
        self.bigrams, self.width = bigrams, len(bigrams)
        self.sides = np.concatenate((bigrams.T, bigrams)).ravel()
        self.totals = np.concatenate((bigrams.sum(1), bigrams.sum(0)))
        rows, columns = self.totals.reshape(2, -1)
        after, before = (BETA * (x + 1) / (x.sum() + self.width) for x in (columns, rows))
        follows = np.log((bigrams + after) / (rows + BETA)[:, None])[:-1]
        precedes = np.log((bigrams + before[:, None]) / (columns + BETA))[:, :-1]
        self.prior = np.concatenate((after, before))
        self.gains = np.concatenate((follows.T, precedes)).astype(np.float32)

    def stay(self, line: np.ndarray, place: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The score of units in their own classes, with their counts taken out first."""
        side = 2 * line + (place >= self.width)
        left = self.sides.take(place * self.width + own.take(line)) - n
        rest = np.maximum(self.totals.reshape(2, -1)[:, own].T.ravel() - np.bincount(side, n, 2 * len(own)), 0) + BETA
        return np.bincount(line, n * np.log((np.maximum(left, 0) + self.prior.take(place)) / rest.take(side)), len(own))

    def best(self, unit: np.ndarray, other: np.ndarray, n: np.ndarray, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units of some pairs, in order, and the class that suits each best.

        Units with few neighbouring classes add up their lines of gains, others are multiplied as dense lines.
        """
        starts = _starts(unit)
        units = unit[starts]
        return units, self.best_of(class_of[units], np.diff(np.append(starts, len(unit))), self.places(class_of).take(other), n)

    def places(self, class_of: np.ndarray) -> np.ndarray:
        """For 2 * unit + (0: it follows, 1: it comes before), the line of gains."""
        return np.stack((class_of, class_of + self.width), 1).ravel().astype(np.int64)

    def best_of(self, own: np.ndarray, sizes: np.ndarray, place: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The same of units by their own classes, their numbers of pairs and the places of these."""
        width, units = self.width, own
        if not len(units):
            return units
        line = np.repeat(np.arange(len(units)), sizes)
        if len(units) * 2 * width <= SPARSE * len(line):
            # Counting cells takes no sort.
            cells = np.bincount(line * (2 * width) + place, n, len(units) * 2 * width)
            at = np.flatnonzero(cells)
            (line, place), n = np.divmod(at, 2 * width), cells.take(at)
        else:
            line, place, n = _summed(line, place, n.astype(np.int64))
        held = np.bincount(line)
        stay = self.stay(line, place, n, own)
        first = np.append(0, np.cumsum(held))
        few, best = held <= width // FEW, np.zeros(len(units), np.int64)

        def chosen(some: np.ndarray, score: np.ndarray) -> None:
            score[np.arange(len(some)), own[some]] = stay[some]
            best[some] = score.argmax(1)

        weight = n.astype(np.float32)
        # Units with equally many neighbouring classes are multiplied together; their lines of gains lie in one block.
        order = np.flatnonzero(few)
        order = order.take(np.argsort(held.take(order), kind="stable"))
        cuts = np.append(_starts(held.take(order)), len(order)).tolist()
        block = np.empty(max(LINES, width // FEW * (width - 1)), np.float32)
        for start, stop in zip(cuts[:-1], cuts[1:]):
            size = int(held[order[start]])
            at_once = max(1, len(block) // (size * (width - 1)))
            for upto in range(start, stop, at_once):
                some = order[upto : min(upto + at_once, stop)]
                at = first.take(some)[:, None] + np.arange(size)
                lines = self.gains.take(place.take(at.ravel()), 0, block[: at.size * (width - 1)].reshape(at.size, width - 1), "clip")
                chosen(some, np.matmul(weight.take(at)[:, None], lines.reshape(len(some), size, width - 1))[:, 0])

        many = np.flatnonzero(~few)
        at_once = max(1, DENSE // (2 * width))
        for start in range(0, len(many), at_once):
            some = many[start : start + at_once]
            dense = np.zeros((len(some), 2 * width), np.float32)
            size, upto = held[some], first[some]
            line_of = np.repeat(np.arange(len(some)), size)
            at = np.arange(len(line_of)) + np.repeat(upto - np.cumsum(size) + size, size)
            dense[line_of, place[at]] = weight[at]
            chosen(some, dense @ self.gains)
        return best


def moved(pairs: DataFrame, class_of: np.ndarray, bigrams: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Every unit that is not heavy in its best class."""
    shared = pairs.sparkSession.sparkContext.broadcast((class_of.astype(np.int32), bigrams, heavy))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, bigrams, heavy = shared.value
        gains, light = Exchange(bigrams), _places(heavy) < 0
        places = gains.places(class_of)
        for batch in batches:
            for row in batch.column("pairs"):
                units, sizes, other, n = _grouped(row.as_buffer())
                some = light[units]
                if not some.all():
                    each = np.repeat(some, sizes)
                    units, sizes, other, n = units[some], sizes[some], other[each], n[each]
                own = class_of[units]
                best = gains.best_of(own, sizes, places.take(other), n)
                new = best != own
                yield pa.RecordBatch.from_arrays([pa.array(units[new].astype(np.int32)), pa.array(best[new].astype(np.int32))], names=["unit", "class"])

    found = pairs.mapInArrow(run, "unit int, class int").toArrow()
    shared.destroy()
    out = class_of.copy()
    out[found.column("unit").to_numpy()] = found.column("class").to_numpy()
    return out


def log_likelihood(bigrams: np.ndarray) -> float:
    """Of the class bigrams, up to what no exchange changes."""
    return float(_gain(bigrams).sum() - _gain(bigrams.sum(1)).sum() - _gain(bigrams.sum(0)).sum())


def clustered(pairs: DataFrame, class_of: np.ndarray, classes: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes and class bigrams of the best round, and the likelihood of each."""
    likelihoods: list[float] = []
    best = class_of, np.zeros((classes + 1, classes + 1))
    while True:
        bigrams, after, before = class_counts(pairs, class_of, classes, heavy)
        likelihoods.append(log_likelihood(bigrams))
        if len(likelihoods) == 1 or likelihoods[-1] > max(likelihoods[:-1]):
            best = class_of, bigrams
        if len(likelihoods) > 1 and likelihoods[-1] - max(likelihoods[:-1]) <= LEAST_GAIN * (max(likelihoods) - likelihoods[0]):
            return *best, likelihoods
        class_of = class_of.copy()
        class_of[heavy], bigrams = exchange_within(after, before, class_of[heavy], bigrams)
        class_of = moved(pairs, class_of, bigrams, heavy)


def class_bigrams(after: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    out = np.zeros((after.shape[1], after.shape[1]))
    np.add.at(out, class_of, after)
    return out


def _gain(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(after: np.ndarray, before: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """One round: every unit but the end, most frequent first, moves to its best class."""
    return exchange_within(after, before, class_of, class_bigrams(after, class_of))[0]


def exchange_within(after: np.ndarray, before: np.ndarray, class_of: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for some units, the end last, among the class bigrams of all; also these after the moves."""
    class_of, pairs = class_of.copy(), pairs.copy()
    sizes = after.sum(1)
    plain = _gain(pairs)
    for unit in np.argsort(-sizes[:-1], kind="stable").tolist():
        out, into = after[unit], before[unit]
        if not sizes[unit] and not into.any():
            continue
        own = class_of[unit]
        pairs[own] = np.maximum(pairs[own] - out, 0)
        pairs[:, own] = np.maximum(pairs[:, own] - into, 0)
        plain[own], plain[:, own] = _gain(pairs[own]), _gain(pairs[:, own])
        rows, columns = pairs.sum(1), pairs.sum(0)
        follows, precedes = np.flatnonzero(out), np.flatnonzero(into)
        better = (_gain(pairs[:, follows] + out[follows]) - plain[:, follows]).sum(1) + (_gain(pairs[precedes] + into[precedes, None]) - plain[precedes]).sum(0)
        better -= _gain(rows + out.sum()) - _gain(rows) + _gain(columns + into.sum()) - _gain(columns)
        best = int(np.argmax(better[:-1]))
        class_of[unit] = best
        pairs[best] += out
        pairs[:, best] += into
        plain[best], plain[:, best] = _gain(pairs[best]), _gain(pairs[:, best])
    return class_of, pairs


@dataclass
class Model:
    """Everything a task needs; of the counts, those of the KNOWN most frequent words."""

    vocabulary: Vocabulary
    class_of: np.ndarray
    transition: np.ndarray  # log10 P(class | class before)
    members: np.ndarray  # ALPHA * (words of the class + 1) + its tokens
    known: np.ndarray  # hashes, ascending
    known_n: np.ndarray
    tokens: int  # N
    types: int  # V
    ends: int

    @cached_property
    def places(self) -> Places:
        return Places(self.known)

    @property
    def end(self) -> int:
        """The end's class."""
        return len(self.members) - 1

    def emission(self, n: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return np.log10((n + ALPHA) / self.members[classes])

    def unigram(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.tokens + self.types + 1))


def most_frequent(counts: DataFrame) -> pd.DataFrame:
    """The frequent words, most frequent first: all those above a count that leaves KNOWN at most.

    The count comes from a histogram of eighth powers of two (some hundred rows).
    """
    bucket = F.floor(F.log2(F.col("n")) * 8)
    sizes = sorted(((r["bucket"], r["count"]) for r in counts.groupBy(bucket.alias("bucket")).count().collect()), reverse=True)
    upto = np.cumsum([n for _, n in sizes])
    fitting = int((upto <= KNOWN).sum())
    least = sizes[fitting - 1][0] if fitting else 1 << 10
    return counts.where(bucket >= least).toArrow().to_pandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


def train_model(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the table of all counts (word, group, n)."""
    counts = written(word_counts(train), "word-counts")
    ends = train.count()
    top = most_frequent(counts)
    # Words rarer than LEAST count with their group (at most GROUPS rows).
    own = counts.where(F.col("n") >= LEAST).toArrow().to_pandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    by_group = counts.groupBy("group").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types")).toPandas()
    n, groups, head = own["n"].to_numpy(np.int64), own["group"].to_numpy(np.int64), len(own)
    sizes, kinds = np.append(n, np.zeros(GROUPS, np.int64)), np.append(np.ones(head, np.int64), np.zeros(GROUPS, np.int64))
    for total, each, less in ((sizes, by_group["tokens"], n), (kinds, by_group["types"], np.ones(head, np.int64))):
        total[head + by_group["group"].to_numpy(np.int64)] = each.to_numpy(np.int64)
        np.subtract.at(total, head + groups, less)
    words = own["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    vocabulary = Vocabulary(words[order], order.astype(np.int64))
    classes = classes_for(vocabulary.units)
    # The end, the last unit, is a heavy one.
    heavy = np.append(np.sort(np.argsort(-sizes, kind="stable")[: HEAVY - 1]), vocabulary.units)
    pairs_of = unit_pairs(train, vocabulary, heavy, int(sizes.sum()) + ends)
    start = np.append(np.append(np.arange(head) % classes, np.arange(GROUPS) % classes), classes)
    class_of, pairs, _ = clustered(pairs_of, start, classes, heavy)

    tokens, types = (np.append(np.bincount(class_of[:-1], x, classes), last) for x, last in ((sizes, ends), (kinds, 1)))
    total = tokens.sum()
    prior = (tokens + 1) / (total + classes + 1)
    transition = np.log10((pairs + BETA * prior) / (pairs.sum(1, keepdims=True) + BETA))
    hashes = top["word"].to_numpy(np.int64).view(np.uint64)
    by_hash = np.argsort(hashes)
    model = Model(
        vocabulary, class_of, transition, tokens + ALPHA * (types + 1), hashes[by_hash], top["n"].to_numpy(np.int64)[by_hash],
        int(total), int(by_group["types"].sum()) + (ends > 0), ends,
    )
    return model, counts


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    Each text sums what its transitions, its end and its known words give; its other words join the table of
    counts, one row per distinct word, and add their part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    train = rows.where(~held_out(F.col("doc_id"))).select("text")
    model, counts = train_model(train)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("word", pa.int64()), ("times", pa.int32()), ("class", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        row = TaskContext.get().partitionId() << 40
        end_base = float(m.unigram(np.array([m.ends]))[0])
        for batch, texts in slices(batches):
            words, groups, first = _words(texts)
            size = len(texts)
            owner = np.repeat(np.arange(size), np.diff(first))
            classes = m.class_of[m.vocabulary.units_of(words, groups)]
            line = np.insert(classes, first[1:], m.end)
            steps = m.transition[np.concatenate(([m.end], line[:-1])), line] if len(line) else np.zeros(0)
            at = first + np.arange(size + 1)  # places of the texts in ``line``
            score = np.array([steps[a:b].sum() for a, b in zip(at[:-1], at[1:])])
            if len(m.known):
                place, have = m.places.of(words)
                n = m.known_n[place[have]]
            else:
                have, n = np.zeros(len(words), bool), np.zeros(0)
            known = np.bincount(owner[have], minlength=size)
            base = np.bincount(owner[have], m.unigram(n), minlength=size)
            score = score + np.bincount(owner[have], m.emission(n, classes[have]), minlength=size) + m.emission(np.array([m.ends]), np.array([m.end]))[0]
            ids = np.arange(row, row + size)
            # A text's own row; its word hash only spreads the rows and is not looked at.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids), batch.column("doc_id"), pa.array(mix(ids.astype(np.uint64)).view(np.int64)), pa.array(np.zeros(size, np.int32)), pa.array(np.zeros(size, np.int32)),
                    pa.array(np.diff(first) + 1), pa.array(known + (m.ends > 0)), pa.array(base + end_base), pa.array(score),
                ],
                schema=schema,
            )
            rest = np.flatnonzero(~have)
            if len(rest):
                # In order of texts, in these of words.
                rest = rest.take(np.argsort(words.take(rest)))
                rest = rest.take(np.argsort(owner.take(rest).astype(np.uint16 if size <= 1 << 16 else np.int64), kind="stable"))
                new = np.ones(len(rest), bool)
                new[1:] = (words[rest[1:]] != words[rest[:-1]]) | (owner[rest[1:]] != owner[rest[:-1]])
                heads = np.flatnonzero(new)
                some = rest[heads]
                zero = np.zeros(len(some))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[owner[some]]), pa.nulls(len(some), pa.int64()), pa.array(words[some].view(np.int64)), pa.array(np.diff(np.append(heads, len(rest))).astype(np.int32)),
                        pa.array(classes[some].astype(np.int32)), pa.array(zero.astype(np.int64)), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero),
                    ],
                    schema=schema,
                )
            row += size

    parts = rows.mapInArrow(run, "row long, doc_id long, word long, times int, class int, n_tokens long, n_known long, base double, score double")
    found = parts.join(counts.select("word", "n"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    members = F.array(*[F.lit(float(x)) for x in model.members])
    times, n = F.col("times"), F.col("n")
    summed = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(n > 0, times).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + times * F.log10((n + 1) / F.lit(float(model.tokens + model.types + 1)))).alias("base_score"),
        F.sum(F.col("score") + times * F.log10((n + F.lit(ALPHA)) / F.get(members, F.col("class")))).alias("score"),
    )
    return summed.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
