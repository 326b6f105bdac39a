"""A Merkle manifest of a table: every row's leaf, the roots above it and the siblings that prove it.

Rows hash to leaves, the leaves of a group (by default a language) fold into its subroot, the subroots of all
groups into one root. A parent's children are spread into FANOUT columns, one conditional aggregate for each
slot; the columns joined in order hash to the parent, and without a row's own slot they are its siblings.

Work is cut into blocks of FANOUT^LEVELS neighbours. Rows are dealt by (group, block) once, and that many
levels are climbed where the rows lie; the next block of levels sees one row in 64. A language that holds
most rows is thus spread over all tasks, and 10^11 leaves take seven exchanges. What lies above a block comes
back by its key, of which no more than 64 rows share one.

Places in a group come from a range partitioning that is written down first: a retried task finds the places
it had, and only the number of rows of each part of the range is added up.

Defined cases: a null field hashes as ``-``, any other as its number of UTF-8 bytes, ``:`` and its value; a
null group is a group of its own, before all others; rows without an order value come first; rows that tie
are ordered by their leaves, so equal rows are interchangeable; a group of one row has that leaf as subroot; an
empty table has an empty manifest; columns that aren't hashed are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from barspan.plans.tables import written

FANOUT = 2
#: Levels that are climbed between two exchanges.
LEVELS = 6
SPAN = FANOUT**LEVELS
#: Offsets of range parts (a part, a group and two numbers each) up to this number are sent to every task.
MOST_SENT = 100_000


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(*[field(f) for f in fields])


def proof(path: Column) -> Column:
    """All siblings of a path, from the leaf to the root, in one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda node, s: digest(s["left"], node, s["right"]))


def placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` (with a column ``group``) with their ``place`` in their group and its size ``n``; the largest n."""
    ranged = rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    at = {"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}
    table = written(ranged.withColumns(at), "ranged")
    spans = written(table.groupBy("part", "group").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("held")), "spans")
    whole = Window.partitionBy("group")
    before = F.sum("held").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("part", "group", (F.coalesce(before, F.lit(0)) - F.col("lo")).alias("shift"), F.sum("held").over(whole).alias("n"))
    known = spans.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("spans")).first()
    spans = F.broadcast(spans) if known["spans"] <= MOST_SENT else spans
    found = table.join(spans, ["part", "group"]).withColumn("place", F.col("at") + F.col("shift"))
    return found.drop("part", "at", "shift"), known["most"] or 0


def block_levels(nodes: DataFrame) -> DataFrame:
    """Climb LEVELS levels inside blocks: ``node`` becomes the block's, ``path`` the siblings passed.

    A group that is down to one node climbs no further.
    """
    div = lambda by: F.floor(F.col("place") / F.lit(by)).cast("long")
    rows = nodes.withColumns({"block": div(SPAN), "path": F.array().cast("array<struct<left:string,right:string>>")})
    rows = rows.repartition("group", "block")
    names = [f"slot{s}" for s in range(FANOUT)]
    for level in range(LEVELS):
        children = Window.partitionBy("group", "block", div(FANOUT ** (level + 1)))
        own = div(FANOUT**level) % F.lit(FANOUT)
        rows = rows.withColumns({c: F.coalesce(F.max(F.when(own == s, F.col("node"))).over(children), F.lit("")) for s, c in enumerate(names)})
        side = lambda keep: F.concat(*[F.when(keep(F.lit(s)), F.col(c)).otherwise("") for s, c in enumerate(names)])
        step = F.struct(side(lambda s: s < own).alias("left"), side(lambda s: s > own).alias("right"))
        several = F.col("n") > F.lit(FANOUT**level)
        rows = rows.withColumns({
            "path": F.when(several, F.concat("path", F.array(step))).otherwise(F.col("path")),
            "node": F.when(several, digest(*[F.col(c) for c in names])).otherwise(F.col("node")),
        }).drop(*names)
    return rows


def climbed(nodes: DataFrame, most: int, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Paths of all ``nodes`` (group, place, n, node) up to where ``finish`` has taken the last block of each group."""
    rows = written(block_levels(nodes), "levels")
    if most <= SPAN:
        return finish(rows)
    tops = rows.where(F.col("place") % SPAN == 0).select("group", F.col("block").alias("place"), F.ceil(F.col("n") / SPAN).alias("n"), "node")
    above = climbed(tops, -(-most // SPAN), finish)
    above = above.select("group", F.col("place").alias("block"), F.col("path").alias("higher"), "subroot", "root")
    joined = rows.drop("node").join(above, ["group", "block"])
    return joined.withColumn("path", F.concat("path", "higher")).drop("higher")


def with_root(rows: DataFrame) -> DataFrame:
    """The last block of every group (its nodes are subroots) with the tree of the subroots on top."""
    subroots = rows.groupBy("group").agg(F.max("node").alias("node")).select(F.lit("").alias("group"), F.col("group").alias("name"), "node")
    ordered, most = placed(subroots, ["name"])
    roots = climbed_alone(ordered, most).select(F.col("name").alias("group"), F.col("path").alias("higher"), "root")
    joined = rows.withColumnRenamed("node", "subroot").join(roots, "group")
    return joined.withColumn("path", F.concat("path", "higher")).drop("higher")


def climbed_alone(nodes: DataFrame, most: int) -> DataFrame:
    """A single tree: its subroot is the root."""
    return climbed(nodes, most, lambda rows: rows.withColumnRenamed("node", "root").withColumn("subroot", F.col("root")))


def manifest(docs: DataFrame, fields: list[str], by: str = "lang", order: str = "doc_id", changed: dict[str, Column] | None = None) -> DataFrame:
    """Per row: ``order`` column, leaf, changed_leaf, path, subroot, root.

    path: array of (left, right), the hashes left and right of the row's own branch, level by level up to the root.
    changed_leaf: the leaf of the row with the values of ``changed`` in place of its own.
    """
    now = [F.col(f) for f in fields]
    other = [(changed or {}).get(f, F.col(f)) for f in fields]
    same = F.lit(True)
    for a, b in zip(now, other):
        same = same & (a.eqNullSafe(b) if a is not b else F.lit(True))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("group"),
        F.col(order).alias("key"), leaf(now).alias("leaf"), F.when(~same, leaf(other)).alias("changed_leaf"),
    )
    ordered, most = placed(written(leaves, "leaves"), ["key", "leaf"])
    found = climbed(ordered.withColumn("node", F.col("leaf")), most, with_root)
    return found.select(F.col("key").alias(order), "leaf", F.coalesce("changed_leaf", "leaf").alias("changed_leaf"), "path", "subroot", "root")
