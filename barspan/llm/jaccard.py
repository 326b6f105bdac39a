"""Size-aware Jaccard join on word shingles, and the components of its links.

Two sets link when their Jaccard similarity is THRESHOLD (3/4) or more. Equal sets are one class from the start.
Classes meet in one of two ways:

* small sets (up to a boundary) enumerate all 2-element subsets of a prefix; two that link share a subset;
* large sets scan inverted lists: they, and the small sets near enough in size, enter every token of a prefix,
  and two that link, of which one is large, share a token.

The boundary is the largest size at which enumerating costs less than scanning, by the sizes and the mean list
length measured on the input. Prefixes follow one order of tokens, rarest first, read off a sketch of counts
(a fixed table; it decides the order, never the result). In that order two sets that link share a token among
the first n/4 + 1 of each, and the smaller set's is among its first n/7 + 1; tokens passed over that nobody
else entered bound the overlap further.

A list is not paired off. First each member is checked against the list's least edited member only; links found
make components. Then members of different components are paired, within the bounds above, and checked. Links
inside a component are not needed and not made, so a group of copies costs about its size; no link that joins
components is lost. All checks are exact on the whole sets.

Shingles are SHINGLE words (lower case A-Z; a text with fewer words has one shingle, all its words) as 64-bit
hashes: two different ones coincide with probability 2^-64.

Defined cases: a null or wordless text has the empty set and links with nothing; a row without doc_id links with
nothing; rows that repeat a doc_id are one document that links if any of its texts does; extra columns of the input
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barspan.llm.components import components
from barspan.llm.segments import drop_stores
from barspan.llm.text import U, lowered, mix, ngram_hashes, raw, slices, word_bounds, word_hashes
from barspan.plans.tables import written

SHINGLE = 5
#: Counters of the token sketch, and how many travel together.
COUNTERS, CHUNK = 1 << 22, 1 << 16
#: Largest size at which subsets may be enumerated.
MOST_SMALL = 64
#: Ids of documents up to this number (16 MB) are sent to every task; more are joined.
MOST_SENT = 1_000_000


def sets_of(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a slice."""
    data, offsets = raw(texts)
    if not len(data):
        return [np.zeros(0, np.uint64)] * len(texts)
    data = lowered(data)
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    grams = ngram_hashes(words, SHINGLE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append(np.unique(grams[a : b - SHINGLE + 1]) if b - a >= SHINGLE else ngram_hashes(words[a:b], b - a) if b > a else words[a:a])
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """One row per text (doc_id, n, two hashes of its set), and a task's token counts in chunks."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_stores()
        counts = np.zeros(COUNTERS, np.uint32)
        for batch, texts in slices(batches):
            sets = sets_of(texts)
            flat = np.concatenate(sets)
            at, n = np.unique(flat & U(COUNTERS - 1), return_counts=True)
            counts[at.astype(np.int64)] += n.astype(np.uint32)
            h1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            h2 = np.array([mix(s + U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            none = [None] * len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2), pa.array(none, pa.int32()), pa.array(none, pa.binary())], schema=schema
            )
        chunks = [k for k in range(COUNTERS // CHUNK) if counts[k * CHUNK : (k + 1) * CHUNK].any()]
        packed = [zlib.compress(counts[k * CHUNK : (k + 1) * CHUNK].tobytes(), 1) for k in chunks]
        none = pa.array([None] * len(chunks), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(chunks, pa.int32()), pa.array(packed, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, chunk int, counts binary")


def token_classes(signed: DataFrame) -> tuple[np.ndarray, float]:
    """A small class per counter, higher for more frequent tokens (4 MB), and the mean list length of a token.

    The counts of all tasks are added per chunk, one at a time.
    """

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                total = totals.setdefault(chunk, np.zeros(CHUNK, np.uint64))
                total += np.frombuffer(zlib.decompress(packed), np.uint32)
        rows = [(k, (2 * np.log2(t + U(1))).astype(np.uint8).tobytes(), float(t.sum()), float((t.astype(np.float64) ** 2).sum())) for k, t in totals.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.binary(), pa.float64(), pa.float64()))], names=["chunk", "classes", "sum", "squares"])

    found = signed.where("chunk is not null").select("chunk", "counts").repartition(16, "chunk").mapInArrow(add, "chunk int, classes binary, sum double, squares double").collect()
    classes = np.zeros(COUNTERS, np.uint8)
    for r in found:
        classes[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["classes"]), np.uint8)
    total, squares = sum(r["sum"] for r in found), sum(r["squares"] for r in found)
    # Tokens that share a counter by chance add total^2 / COUNTERS to the squares.
    return classes, max(1.0, (squares - total * total / COUNTERS) / max(total, 1.0))


def boundary(mean_list: float) -> int:
    """The largest size up to which subsets cost less than lists: rows written plus members met."""
    size = 2
    for n in range(3, MOST_SMALL + 1):
        prefix = n // 4 + 2
        if prefix * (prefix - 1) // 2 * 2 > (n // 4 + 1) * (1 + mean_list):
            break
        size = n
    return size


def entries(docs: DataFrame, classes: np.ndarray, small: int) -> DataFrame:
    """key, id, n, pos, kind of every entry: 0 a subset of a small set, 1 a token of a large, 2 of a small one."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_stores()
        rank = shared.value
        for batch, texts in slices(batches):
            keys, ids, sizes, places, kinds = [], [], [], [], []

            def enter(key: np.ndarray, doc_id: int, n: int, pos: np.ndarray, kind: int) -> None:
                keys.append(key)
                ids.append(np.full(len(key), doc_id))
                sizes.append(np.full(len(key), n, np.int32))
                places.append(pos.astype(np.int32))
                kinds.append(np.full(len(key), kind, np.int8))

            for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), sets_of(texts)):
                n = len(tokens)
                if n < 3:  # below three, only equal sets link
                    continue
                ordered = tokens[np.lexsort((tokens, rank[(tokens & U(COUNTERS - 1)).astype(np.int64)]))]
                if n <= small:
                    pairs = np.array(list(combinations(range(n // 4 + 2), 2)))
                    subsets = mix(ordered[pairs[:, 0]] + U(0x9E6C63D0876A9A35)) + ordered[pairs[:, 1]]
                    enter(mix(subsets), doc_id, n, np.zeros(len(pairs)), 0)
                if 4 * n >= 3 * (small + 1):
                    enter(ordered[: n // 4 + 1], doc_id, n, np.arange(n // 4 + 1), 1 if n > small else 2)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids)), *(pa.array(np.concatenate(x)) for x in (sizes, places, kinds))],
                    names=["key", "id", "n", "pos", "kind"],
                )

    return docs.mapInArrow(run, "key long, id long, n int, pos int, kind byte")


def shared_lists(entered: DataFrame) -> DataFrame:
    """Entries whose key another set has too, with ``miss``, ``hi``, ``short`` and ``left``.

    miss: tokens of the prefix before this one that nobody else entered; a partner in this list has none of
    them. hi: the largest partner size at which the overlap can still suffice (3 (a + b) <= 7 (b - miss)).
    short: the token is among the first n/7 + 1, where the smaller set of a link has a shared one. left: the
    set's entries from this one on; a link needs a number of shared ones, so its first has as many left.
    """
    alone = F.count(F.lit(1)).over(Window.partitionBy("key"))
    lists = entered.withColumn("df", alone).where("df > 1").drop("df")
    rank = F.row_number().over(Window.partitionBy("id", "kind").orderBy("pos", "key")) - 1
    own = F.count(F.lit(1)).over(Window.partitionBy("id", "kind"))
    lists = lists.withColumn("left", own - rank).withColumn("miss", F.when(F.col("kind") == 0, F.lit(0)).otherwise(F.col("pos") - rank))
    lists = lists.withColumn("hi", F.expr("(7 * (n - miss) - 3 * n) div 3")).withColumn("short", F.expr("pos <= n div 7"))
    return lists.where("4 * hi >= 3 * n")


def possible(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) whose shared prefix keys leave enough.

    The set whose prefix ends first in the common order has no other token in common with the other one's
    prefix or before it, so outside the shared keys at most the longer rest counts. Pairs that met in a
    subset and have no lists pass.
    """
    ids = _sent(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))
    entered = lists.where("kind != 0").select("id", "n", "key").join(ids, "id", "left_semi")
    keys = written(entered.groupBy("id").agg(F.max("n").alias("n"), F.collect_set("key").alias("keys")), "keys")
    own = lambda side: keys.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("keys").alias(f"keys_{side}"))
    both = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left")
    enough = F.expr("7 * (size(array_intersect(keys_a, keys_b)) + greatest(n_a - n_a div 4, n_b - n_b div 4) - 1) >= 3 * (n_a + n_b)")
    return both.where(F.coalesce(enough, F.lit(True))).select("a", "b")


#: Members that one task checks against one set.
BLOCK = 1024


def checked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by the whole sets of their texts.

    Sets are made anew from the texts of the pairs' ids. A set ``a`` stands at the head of each block of its
    partners, which pass it one by one; many partners are dealt to several blocks.
    """
    ids = _sent(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))))
    sets = written(_whole_sets(rows.join(ids, "doc_id", "left_semi")), "sets")
    blocks = pairs.groupBy("a").agg(F.expr(f"count(1) div {BLOCK} + 1").alias("blocks"))
    heads = blocks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    heads = heads.join(sets.withColumnRenamed("id", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "tokens")
    members = pairs.join(blocks, "a").select("a", F.expr("pmod(xxhash64(b), blocks)").alias("block"), "b")
    members = members.join(sets.withColumnRenamed("id", "b"), "b").select("a", "block", "b", "tokens")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            found = []
            for a, block, b, tokens in zip(*(batch.column(n).to_pylist() for n in ("a", "block", "b", "tokens"))):
                other = np.frombuffer(tokens, np.uint64)
                if b is None:  # texts of one id may have several sets
                    own = [*own, other] if at == (a, block) else [other]
                    at = (a, block)
                    continue
                for x in own:
                    same = len(np.intersect1d(x, other, assume_unique=True))
                    if 100 * same >= 75 * (len(x) + len(other) - same):
                        found.append((a, b))
                        break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    dealt = heads.unionByName(members).repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b"))
    return dealt.mapInArrow(run, "a long, b long").distinct()


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    rows = _rows(docs, id_col, text_col)
    signed = written(signatures(rows), "signatures")
    texts = signed.where("chunk is null").select("doc_id", "n", "h1", "h2")
    named = texts.where("doc_id is not null and n > 0")
    heads = named.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("head"))
    classed = written(named.join(heads, ["n", "h1", "h2"]).select("doc_id", "head"), "classes")
    # An id whose texts are all copies is left out; one that is the head of any class stays.
    copies = classed.where("doc_id != head").select("doc_id").join(heads.select(F.col("head").alias("doc_id")), "doc_id", "left_anti")

    classes, mean_list = token_classes(signed)
    firsts = rows.where("doc_id is not null").join(_sent(copies), "doc_id", "left_anti")
    lists = written(shared_lists(entries(firsts, classes, boundary(mean_list))), "lists")

    # Every member against its list's least edited one.
    best = F.min(F.struct((F.col("miss") / F.col("n")).alias("edits"), "id", "n")).over(Window.partitionBy("key"))
    stars = lists.withColumn("best", best).where("id != best.id and 4 * least(n, best.n) >= 3 * greatest(n, best.n)")
    stars = written(stars.select(F.col("best.id").alias("a"), F.col("id").alias("b")).distinct(), "met")
    stars = written(possible(stars, lists), "stars")
    # Equal texts under different ids link through their class; so do the texts of a repeated id.
    same = classed.where("doc_id != head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = written(checked(stars, rows), "links")
    labels = components(links)

    # Members of different components, within the bounds.
    labels = F.broadcast(labels) if labels.count() <= MOST_SENT else labels
    placed = lists.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    one_list = Window.partitionBy("key")
    placed = placed.withColumn("lo", F.min("label").over(one_list)).withColumn("up", F.max("label").over(one_list)).where("lo != up")
    x, y = placed.alias("x"), placed.alias("y")
    within = F.expr(
        "x.key = y.key and x.label != y.label and x.short and (x.n < y.n or (x.n = y.n and x.id < y.id)) and 4 * x.n >= 3 * y.n "
        "and x.n <= y.hi and y.n <= x.hi and not (x.kind = 2 and y.kind = 2) "
        "and 7 * (least(x.pos - x.miss, y.pos - y.miss) + least(x.n - x.pos, y.n - y.pos)) >= 3 * (x.n + y.n) "
        "and (x.kind = 0 or 7 * (least(x.left, y.left) + greatest(x.n - x.n div 4, y.n - y.n div 4) - 1) >= 3 * (x.n + y.n))"
    )
    rest = written(x.join(y, within).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "met")
    tried = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = written(possible(rest, lists).join(tried, ["a", "b"], "left_anti"), "rest")
    more = checked(rest, rows)
    final = components(links.unionByName(more).unionByName(same))
    out = texts.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def _sent(ids: DataFrame) -> DataFrame:
    """Distinct ids, sent to every task if their number is small; else Spark shuffles them."""
    ids = ids.distinct()
    return F.broadcast(ids) if ids.count() <= MOST_SENT else ids


def _whole_sets(rows: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_stores()
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets_of(texts)], pa.binary())], names=["id", "tokens"])

    return rows.mapInArrow(run, "id long, tokens binary")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, without those linked to a document of smaller id.

    A row without id stays. Rows that repeat an id stay or go together.
    """
    found = linked_components(docs, id_col, text_col)
    gone = _sent(written(found.where("doc_id != component_id").select(F.col("doc_id").alias("__gone_id")).distinct(), "gone"))
    return docs.join(gone, docs[id_col] == gone["__gone_id"], "left_anti")
