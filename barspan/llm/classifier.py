"""A quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal updates.

Features of a text are hashed runs of one and two words and of one to three word shapes (letters, capitals,
digits and signs with equal neighbours merged; a word equal to the one before it has a shape of its own), in
2^18 buckets, weighted by log(1 + count) and scaled to length one, plus a constant. A score is a sparse dot
product.

Training reads at most SAMPLE_ROWS labelled texts, chosen by a hash of their ids; updates run over them in the
order of that hash. Scoring covers every row.

Defined cases: a null text is empty; an empty text is scored by the constant alone; an id that is labelled
twice counts once, with its lowest label; without any labelled text every score is 0.5. Extra columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barspan.llm.segments import drop_stores
from barspan.llm.text import BASE, BASE_INVERSE, U, lowered, mix, ngram_hashes, powers, raw, slices, word_bounds, word_hashes

#: Most labelled texts that one model is trained on.
SAMPLE_ROWS = 20_000
BITS = 18
EPOCHS = 10
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.005, 0.1
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    kind = np.arange(256, dtype=np.uint8)  # a sign is its own kind
    kind[ord("a") : ord("z") + 1] = kind[128:] = ord("a")
    kind[ord("A") : ord("Z") + 1] = ord("A")
    kind[ord("0") : ord("9") + 1] = ord("0")
    return kind


_KIND = _classes()


def _shape_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    kinds = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[starts] = True
    place = np.cumsum(new)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.where(new, (kinds.astype(np.uint64) + U(1)) * powers(BASE, len(data) + 1)[place], U(0)), out=sums[1:])
    shapes = mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(data) + 1)[place[starts]] + U(7))
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[first[:-1][first[:-1] < len(words)]] = False
    return np.where(again, U(0x51ED270B), shapes)


def features(texts: pa.Array, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of every text of a slice; bucket 2^bits is the constant."""
    data, offsets = raw(texts)
    if not len(data):
        return [(np.array([1 << bits]), np.ones(1))] * len(texts)
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(lowered(data), starts, ends)
    shapes = _shape_hashes(data, starts, ends, words, first)
    mask = U((1 << bits) - 1)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        w, s = words[a:b], shapes[a:b] + U(0x632BE5AB)
        grams = np.concatenate([ngram_hashes(w, 1), ngram_hashes(w, 2), ngram_hashes(s, 1), ngram_hashes(s, 2), ngram_hashes(s, 3)])
        buckets, counts = np.unique(grams & mask, return_counts=True)
        values = np.log1p(counts)
        norm = np.sqrt(values @ values) or 1.0
        out.append((np.append(buckets.astype(np.int64), 1 << bits), np.append(values / norm, 1.0)))
    return out


class Ftrl:
    """Weights by follow-the-regularised-leader: z holds gradients, n their squares, both per bucket."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, at: np.ndarray, values: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS, bits: int = BITS,
) -> np.ndarray:
    """Weights (2^bits + 1 floats) learned from labelled rows whose id isn't held out."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).dropna()
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    n = known.count()
    draw = F.xxhash64("doc_id")
    if n > sample_rows:
        # 2^63 times the share, taken from both ends of the hash.
        known = known.where(F.abs(draw.cast("double")) < F.lit(sample_rows / n * 2.0**63))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # At most about ``sample_rows`` ids, so the texts stay where they are.
    rows = rows.join(F.broadcast(known), "doc_id").select("label", "text", draw.alias("draw"))
    made = pa.schema([("label", pa.float64()), ("draw", pa.int64()), ("at", pa.binary()), ("value", pa.binary())])

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_stores()
        for batch, texts in slices(batches):
            found = features(texts, bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("draw"), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())],
                schema=made,
            )

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Eight bytes a feature: the batches' own buffers, read in place.
        rows = [
            (np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32), y)
            for b in batches
            for y, a, v in zip(b.column("label").to_pylist(), b.column("at"), b.column("value"))
        ]
        model = Ftrl((1 << bits) + 1)
        for _ in range(EPOCHS):
            for at, values, label in rows:
                model.learn(at.astype(np.int64), values.astype(np.float64), label)
        w = model.weights(np.arange((1 << bits) + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["at", "weight"])

    # The bounded sample's features meet in one task, in an order that any run repeats.
    table = (
        rows.mapInArrow(extract, "label double, draw long, at binary, value binary")
        .repartition(1)
        .sortWithinPartitions("draw", "at", "label")
        .mapInArrow(fit, "at long, weight double")
        .toPandas()
    )
    weights = np.zeros((1 << bits) + 1, np.float32)
    weights[table["at"].to_numpy(np.int64)] = table["weight"].to_numpy()
    return weights


def scored(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the score (0 to 1) of every row. The weights have a fixed size, about 1 MB."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    bits = (len(weights) - 1).bit_length() - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch, texts in slices(batches):
            score = [1.0 / (1.0 + np.exp(-np.clip(w[at] @ v, -35, 35))) for at, v in features(texts, bits)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def kept_rows(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their columns, that score at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    bits = (len(weights) - 1).bit_length() - 1

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        drop_stores()
        w = shared.value.astype(np.float64)
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        cut = np.log(threshold / (1 - threshold))
        return pd.Series([bool(w[at] @ v >= cut) for _, part in slices([batch]) for at, v in features(part, bits)], dtype=bool)

    return docs.where(good(F.col(text_col).cast("string")))
