"""Token ids as binary shards with Elias-Fano document boundaries.

A shard holds the ids of consecutive documents (ascending doc_id) one after another, in two bytes each if the
vocabulary allows it, in four otherwise. Where a document starts is not stored as a table of 64-bit offsets:
the n + 1 boundaries are Elias-Fano coded, low bits packed, high bits as a bit vector with one 1 per boundary,
in about 2 + log2(tokens / documents) bits each. A sample of every 64th 1 answers select, so any document is
found without decoding the others. The documents' ids are coded the same way.

Layout, little-endian: magic, bytes per id (u4), documents (u8), documents without id (u8), least doc_id (i8),
bytes of the id and boundary sections (u8, u8), the two sections, the ids. A section: low bits (u4), values
(u8), bytes of the low part, the high part and the samples (u8 each), then those parts.

Defined cases: a null text is empty, an empty text has the end id alone; rows without doc_id come first;
repeated ids follow each other in order of their texts; an empty table makes no shard; extra columns of the
input are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barspan.llm import wordbpe
from barspan.llm.text import eights
from barspan.plans.tables import fresh_path, written

END_ID = 2
MAGIC = b"EFIDS001"
SAMPLE = 64
#: Number of 1s of a byte, and the place of its k-th one.
_ONES = np.array([b.bit_count() for b in range(256)], np.int64)
_PLACE = np.array([[*(k for k in range(8) if b >> k & 1), *[0] * (8 - b.bit_count())] for b in range(256)], np.int64)
_HEAD = struct.Struct("<8sIQQqQQ")
_SECTION = struct.Struct("<IQQQQ")


class EliasFano:
    """A non-decreasing sequence of whole numbers from 0 on."""

    def __init__(self, low_bits: int, n: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.low_bits, self.n, self.low, self.high, self.samples = low_bits, n, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        low_bits = max(0, (most // max(1, n)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        marks[ones] = 1
        return cls(low_bits, n, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(marks, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        parts = [x.tobytes() for x in (self.low, self.high, self.samples)]
        return _SECTION.pack(self.low_bits, self.n, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, content: bytes) -> EliasFano:
        low_bits, n, *sizes = _SECTION.unpack_from(content)
        at, parts = _SECTION.size, []
        for size, kind in zip(sizes, ("u1", "u1", "<u4")):
            parts.append(np.frombuffer(content, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(low_bits, n, *parts)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low_bits
        at_8 = eights(np.concatenate([self.low, np.zeros(16, np.uint8)]))
        shift = (bit % 8).astype(np.uint64)
        behind = np.where(shift > 0, at_8[bit // 8 + 8] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return (at_8[bit // 8] >> shift | behind) & np.uint64((1 << self.low_bits) - 1)

    def select(self, i: np.ndarray) -> np.ndarray:
        """Places of the i-th 1s of the high bits, each from the nearest sample on, all together."""
        place, left = self.samples[i // SAMPLE].astype(np.int64), i % SAMPLE
        byte = place // 8
        rest = self.high[byte] >> (place % 8).astype(np.uint8) << (place % 8).astype(np.uint8)
        going = np.flatnonzero(left >= _ONES[rest])
        while len(going):
            left[going] -= _ONES[rest[going]]
            byte[going] += 1
            rest[going] = self.high[byte[going]]
            going = going[left[going] >= _ONES[rest[going]]]
        return byte * 8 + _PLACE[rest, left]

    def at(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers of the sequence."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        return (self.select(i) - i).astype(np.uint64) << np.uint64(self.low_bits) | self._lows(i)

    def __getitem__(self, i: int) -> int:
        return int(self.at(np.array([i]))[0])

    def all(self) -> np.ndarray:
        """The whole sequence at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        return high | (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def shard_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    names = EliasFano.of((known - least).astype(np.uint64)).to_bytes()
    bounds = EliasFano.of(np.concatenate(([0], np.cumsum(lengths)))).to_bytes()
    head = _HEAD.pack(MAGIC, width, len(doc_ids), len(doc_ids) - len(known), least, len(names), len(bounds))
    return head + names + bounds + ids.astype(f"<u{width}").tobytes()


class Shard:
    """A shard's content, read back."""

    def __init__(self, content: bytes):
        magic, self.width, self.n, self.unnamed, self.least, names, bounds = _HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size
        self.names = EliasFano.from_bytes(content[at : at + names])
        self.bounds = EliasFano.from_bytes(content[at + names : at + names + bounds])
        self.ids = np.frombuffer(content, f"<u{self.width}", offset=at + names + bounds)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.unnamed + (self.names.at(np.arange(self.names.n)).astype(np.int64) + self.least).tolist()

    def offsets(self) -> np.ndarray:
        """Where each document starts, and the end of the last one."""
        return self.bounds.at(np.arange(self.n + 1)).astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects."""
        return self.ids[self.bounds[i] : self.bounds[i + 1]]


def _put(folder: str, name: str, content: bytes) -> None:
    """Write under a name of this attempt, then rename: a repeated task leaves one whole file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(own) as out:
        out.write(content)
    store.move(own, f"{path}/{name}")


def write_shards(
    docs: DataFrame, content: str, folder: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write every document's ids to ``folder``; return the manifest: shard, n_docs, n_tokens, base.

    Shards are ranges of doc_id; ``base`` is the number of ids in the shards before. ``folder`` must be one
    that all executors share.
    """
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(content).get_vocab_size() - 1, end_id) < 1 << 16 else 4
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        names: list[int | None] = []
        lengths: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        for batch, ids, offsets in wordbpe.encoded(batches, shared.value):
            names += batch.column("doc_id").to_pylist()
            lengths.append(np.diff(offsets) + 1)
            parts.append(np.insert(ids, offsets[1:], end_id).astype(f"<u{width}"))
        if names:
            every, ids = np.concatenate(lengths), np.concatenate(parts)
            _put(folder, f"shard-{shard:08d}.ids", shard_bytes(names, every, ids, width))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64())], names=["shard", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    manifest = written(
        rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "shard long, n_docs long, n_tokens long"), "manifest"
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (among all ids), n_tokens, ids_crc32 (ids in four bytes)."""
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                number = int(re.search(r"shard-(\d+)\.ids$", path)[1])
                shard = Shard(content.as_buffer().to_pybytes())
                bounds = shard.offsets()
                ids = shard.ids.astype("<u4").tobytes()
                cuts = (4 * bounds).tolist()
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(shard.n, number)), pa.array(shard.doc_ids(), pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())], schema=schema
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "content")
    found = files.mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(manifest.select("shard", "base"), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def through_files(docs: DataFrame, content: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents to a fresh shared folder and read them back."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-ids")
    manifest = write_shards(docs, content, folder, end_id, id_col, text_col)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, folder, manifest)
