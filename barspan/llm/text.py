"""Texts inside tasks: bounded slices of Arrow batches, words and hashes as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1_000_000

# Any odd multiplier serves a polynomial hash modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}

#: Words of up to so many bytes are hashed and compared eight bytes at a time.
LONG = 128
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each in ``x``, and each element's number among them.

    As np.unique, without its stable sort.
    """
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD6E8FEB86659FD93))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 2), base & (2**64 - 1), np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def texts_of(column: pa.Array) -> pa.Array:
    """The column as strings; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a slice and the len + 1 offsets into them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut batches so that a slice holds ``most`` bytes of text, or one text that is longer.

    The texts are the batch's column ``text``; memory then follows the longest text, not the batch.
    """
    for batch in batches:
        texts = texts_of(batch.column("text"))
        if not len(texts):
            continue
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at), texts.slice(at, end - at)
            at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of every text (len + 1 entries).

    Words are runs of bytes other than space and \\x09 to \\x0D; no word crosses two texts.
    """
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def flat_places(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after another."""
    offsets = counts_to_offsets(ends - starts)
    return np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])


def _factors(n: int) -> np.ndarray:
    """An odd number for every place in a word."""
    return mix(np.arange(n, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(1)) | U(1)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number (zeros behind the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word's bytes (no word is empty).

    Words of up to LONG bytes are taken eight bytes at a time, each step mixing all bits, so no pattern of letters
    cancels, as it does in a polynomial of one base. In longer ones each byte stands for a random number,
    multiplied by another one for its place. Words that must be told apart for certain are compared by their
    bytes as well (``word_codes``, ``SegmentStore``).
    """
    sizes = ends - starts
    at_8 = eights(data)
    out = at_8[starts]
    out &= _MASKS[np.minimum(sizes, 8)]
    out += sizes.astype(np.uint64) * U(0xD6E8FEB86659FD93)
    out = mix(out)
    rest = np.flatnonzero((sizes > 8) & (sizes <= LONG))
    at, left = starts[rest], sizes[rest]
    while len(rest):
        at, left = at + 8, left - 8
        out[rest] = mix(out[rest] ^ (at_8[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        rest, at, left = rest[more], at[more], left[more]
    for k in np.flatnonzero(sizes > LONG).tolist():
        word = _LETTERS[data[starts[k] : ends[k]]]
        out[k] = mix(out[k : k + 1] ^ (word * _factors(len(word))).sum(dtype=np.uint64))[0]
    return out


def differing(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Numbers of the words whose bytes differ from those of their counterpart in ``other``."""
    unlike = sizes != other_sizes
    a, b = eights(data), eights(other)
    # Places behind the end of a shorter counterpart are not looked at: its size differs already.
    unlike |= ((a[starts] ^ b[other_starts]) & _MASKS[np.minimum(sizes, 8)]) != 0
    rest = np.flatnonzero(~unlike & (sizes > 8) & (sizes <= LONG))
    at, to, left = starts[rest], other_starts[rest], sizes[rest]
    while len(rest):
        at, to, left = at + 8, to + 8, left - 8
        wrong = ((a[at] ^ b[to]) & _MASKS[np.minimum(left, 8)]) != 0
        unlike[rest[wrong]] = True
        more = (left > 8) & ~wrong
        rest, at, to, left = rest[more], at[more], to[more], left[more]
    for k in np.flatnonzero(~unlike & (sizes > LONG)).tolist():
        n = sizes[k]
        unlike[k] = not np.array_equal(data[starts[k] : starts[k] + n], other[other_starts[k] : other_starts[k] + n])
    return np.flatnonzero(unlike)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for every word of a slice; equal numbers mean equal bytes."""
    _, first, codes = distinct(word_hashes(data, starts, ends))
    like = first[codes]
    unlike = differing(data, starts, ends - starts, data, starts[like], (ends - starts)[like])
    if len(unlike):
        known: dict[bytes, int] = {}
        for k in unlike.tolist():
            codes[k] = len(first) + known.setdefault(data[starts[k] : ends[k]].tobytes(), len(known))
    return codes


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words of one sequence (order counts)."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out += mix(words[j : j + count] + U((j + 1) * 0xC2B2AE3D27D4EB4F & (2**64 - 1)))
    return mix(out)


def counts_to_offsets(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in columns.items()], schema=schema
    )
