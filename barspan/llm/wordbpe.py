"""Ids of a ``tokenizers`` file whose vocabulary drops white space, such as word_bpe_49k.json.

The file's pattern never matches white space and nothing before it joins characters across it, so texts are
cut at ASCII white space and each distinct segment is encoded once. Words of plain Latin letters (up to U+00FF)
are lower-cased and cut from the commas and full stops behind them, as the vocabulary's own normaliser and
pattern do, so that a word is one segment however it is written; any other word goes through the library's
chain as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from barspan.llm.segments import SegmentStore
from barspan.llm.text import counts_to_offsets, raw, slices, word_bounds

_stores: dict[int, SegmentStore] = {}


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first segment of every text): the bytes have plain words in lower case."""
    starts, ends, first = word_bounds(data, offsets)
    if not len(starts):
        return data, starts, ends, first
    capital = (data >= 65) & (data <= 90)
    letter = capital | ((data >= 97) & (data <= 122))
    wide = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF: two bytes, of which 0xD7 and 0xF7 are signs
    behind = data[wide + 1]
    letter[wide] = letter[wide + 1] = (behind != 0x97) & (behind != 0xB7)
    capital[wide[(behind < 0x9F) & (behind != 0x97)] + 1] = True
    mark = (data == 44) | (data == 46)
    body = np.maximum.accumulate(np.where(mark, -1, np.arange(len(data))))[ends - 1] + 1
    others = counts_to_offsets(~letter)
    plain = (body > starts) & (others[np.maximum(body, starts)] == others[starts])
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[plain]] += 1
    edge[body[plain]] -= 1
    low = data + ((np.cumsum(edge[:-1], dtype=np.int8) > 0) & capital).astype(np.uint8) * np.uint8(32)
    tailed = plain & (body < ends)
    at = np.repeat(np.arange(len(starts)), 1 + tailed)
    second = np.zeros(len(at), bool)
    second[1:] = at[1:] == at[:-1]
    from_, to = np.where(second, body[at], starts[at]), np.where(tailed[at] & ~second, body[at], ends[at])
    return low, from_, to, counts_to_offsets(1 + tailed)[first]


_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, then U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(content)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.letters = _byte_letters()

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        tokenize, letters = self.whole.model.tokenize, self.letters
        out: list[list[int]] = [[]] * len(words)
        rest = []
        for k, word in enumerate(words):
            if word.isalpha() and word.islower():
                out[k] = [t.id for t in tokenize(word.decode())]
            elif _PLAIN.fullmatch(word.decode()):
                out[k] = [t.id for t in tokenize(word.decode("latin-1").translate(letters))]
            else:
                rest.append(k)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for k, made in zip(some, self.whole.encode_batch([words[k].decode() for k in some], add_special_tokens=False)):
                out[k] = made.ids
        return out


def store_for(content: str) -> SegmentStore:
    key = hash(content)
    if key not in _stores:
        _stores.clear()
        _stores[key] = SegmentStore(WordEncoder(content))
    return _stores[key]


def encoded(batches: Iterable[pa.RecordBatch], content: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice of the batch, ids of its texts one after another, len + 1 offsets) for every slice."""
    store = store_for(content)
    for batch, texts in slices(batches):
        data, offsets = raw(texts)
        if len(data):
            low, starts, ends, first = segments(data, offsets)
            slots = store.look_up(low, starts, ends)
            store.settle()
            ids, at = store.tokens(slots, first)
        else:
            ids, at = np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        yield batch, ids, at
        if store.full():
            store.shrink()
