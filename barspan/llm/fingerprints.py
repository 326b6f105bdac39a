"""Document fingerprints by winnowing.

Every run of GRAM code points is hashed; in every window of WINDOW consecutive hashes the smallest one is
chosen, the rightmost of equal ones. Any passage of GRAM + WINDOW - 1 = 15 code points that two texts share
puts a common hash into both fingerprints, and no shared passage under GRAM code points does. Positions are
kept, so a match can be traced back to its place.

Defined cases: a null text is empty; an empty text has the empty fingerprint; a text under GRAM code points
has one hash, that of the whole text, at position 0; two empty fingerprints have likeness 1, an empty and
another one 0. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barspan.llm.text import BASE, U, mix
from barspan.plans.tables import written

GRAM = 8
WINDOW = 8
#: Neighbouring ids that travel together when texts are put in order of their ids.
BLOCK_IDS = 1024
#: Blocks up to this number (16 MB of ids) are sent to every task; more are joined.
MOST_SENT = 1_000_000


def gram_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """32-bit hash of every run of ``gram`` code points, by doubling: a run of 2m is two runs of m."""
    whole = gram if len(codes) >= gram else len(codes)
    have, length, shift = np.zeros(len(codes) + 1, np.uint64), 0, 0
    run, size = mix(codes.astype(np.uint64) + U(1)), 1
    while whole >> shift:
        if whole >> shift & 1:  # append this power of two to what is already covered
            count = len(codes) - length - size + 1
            part = run[length : length + count]
            have = have[:count] * U(pow(BASE, size, 1 << 64)) + part if length else part
            length += size
        if whole >> (shift + 1):
            run = run[:-size] * U(pow(BASE, size, 1 << 64)) + run[size:]
            size *= 2
        shift += 1
    return mix(have) >> U(32)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The chosen hashes and their positions, in order of position."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = gram_hashes(codes, gram)
    # The low half is larger further left, so the smallest key is the rightmost of equal hashes.
    keys = hashes << U(32) | (U(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64))
    width = min(window, len(keys))
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        covered += step
    chosen = keys[np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))]
    return chosen >> U(32), (U(0xFFFFFFFF) - (chosen & U(0xFFFFFFFF))).astype(np.int64)


def written_form(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Eight hex digits per hash, then the positions: ``hashes|p0,p1,..``; empty for an empty text."""
    if not len(hashes):
        return ""
    return hashes.astype(">u4").tobytes().hex() + "|" + ",".join(map(str, positions.tolist()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes, each sorted and distinct."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hashes (array<long>), positions (array<long>) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [winnow(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([m[k].astype(np.int64) for m in made], pa.list_(pa.int64())) for k in (0, 1))],
                    schema=schema,
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        run, "doc_id long, hashes array<long>, positions array<long>"
    )


def edited(text: str, following: str) -> str:
    """The last third (rounded down) gives way to the first as many code points of another text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (block, guest, descending id): each row's next row is its next document."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )
    out: list[list] = [[] for _ in schema]
    held = None
    for batch in batches:
        for block, guest, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("block", "guest", "doc_id", "text"))):
            hashes, positions = winnow(text)
            own = np.unique(hashes)
            if held is not None and held[0] == block:
                _, before_id, before, before_print, before_set = held
                new = edited(before, text)
                new_hashes, new_positions = winnow(new)
                row = (
                    before_id, len(before), hashlib.sha256(new.encode()).hexdigest(), before_print,
                    written_form(new_hashes, new_positions), likeness(before_set, np.unique(new_hashes)), likeness(before_set, own),
                )
                for column, value in zip(out, row):
                    column.append(value)
            # A guest stands behind the rows of a block only to be their last row's next one.
            held = None if guest else (block, doc_id, text, written_form(hashes, positions), own)
            if len(out[0]) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                out = [[] for _ in schema]
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness to each other and the next one.

    The next document is the one with the next smaller id; after the last comes the first. Texts move once,
    in blocks of neighbouring ids; the row that follows a block joins it as a guest. One task holds one pair
    of texts at a time. A row without id counts as the smallest id; rows that repeat an id follow each other
    in order of their texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    n, low, high = found["n"], found["low"] or 0, found["high"] or 0
    width = max(BLOCK_IDS, -(-BLOCK_IDS * (high - low + 2) // max(1, n)))
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(low - 1)))
    rows = rows.withColumn("block", F.expr(f"(place - ({low - 1}L)) div {width}L"))
    tops = rows.groupBy("block").agg(F.max("place").alias("top"))
    # One row per block of about a thousand documents; the lowest block is followed by the highest id.
    donors = tops.select(
        F.col("block").alias("for_block"),
        F.coalesce(F.lag("top").over(Window.orderBy("block")), F.lit(high if found["high"] is not None else low - 1)).alias("donor"),
    )
    # Written first, so that its size is known: while it is small, texts need not move to meet it.
    donors = written(donors, "donors")
    if donors.count() <= MOST_SENT:
        donors = F.broadcast(donors)
    guests = rows.drop("block").join(donors, F.col("place") == F.col("donor"))
    both = rows.withColumn("guest", F.lit(0)).select("block", "guest", "place", "doc_id", "text").unionByName(
        guests.select(F.col("for_block").alias("block"), F.lit(1).alias("guest"), "place", "doc_id", "text")
    )
    return (
        both.repartition("block")
        .sortWithinPartitions("block", "guest", F.desc("place"), "text")
        .mapInArrow(
            _compare,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        )
    )
