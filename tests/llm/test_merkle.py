"""The Merkle manifest against a plain tree, with awkward rows of every kind."""

import hashlib

import pytest
from pyspark.sql import functions as F

from barspan.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, path string, node int, part string"


def plain_hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return plain_hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """The root and, for each node, its siblings as (left, right) level by level."""
    paths = [[] for _ in nodes]
    groups = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, merged = [], []
        for at in range(0, len(nodes), 2):
            run = nodes[at : at + 2]
            for slot in range(len(run)):
                for i in groups[at + slot]:
                    paths[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            above.append(plain_hash("".join(run)))
            merged.append([i for slot in range(len(run)) for i in groups[at + slot]])
        nodes, groups = above, merged
    return nodes[0], paths


def plain_manifest(rows, changed):
    """(doc_id, leaf, subroot, root, path, folded) of every row; ``changed`` gives a row's other n_chars."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    found, subroots = {}, []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        subroot, paths = plain_tree([plain_leaf(r) for r in own])
        subroots.append(subroot)
        found[lang] = list(zip(own, paths))
    root, tops = plain_tree(subroots)
    out = []
    for lang, subroot, top in zip(langs, subroots, tops):
        for row, path in found[lang]:
            node = plain_leaf((*row[:3], changed(row), row[4]))
            for left, right in path + top:
                node = plain_hash(left + node + right)
            out.append((row[0], plain_leaf(row), subroot, root, path + top, node))
    return out


def found_manifest(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, "p", 1, "q") for r in rows], SCHEMA).repartition(parts)
    changed = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    made = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed={"n_chars": changed})
    made = made.withColumn("folded", merkle.folded(F.col("changed_leaf"), F.col("path")))
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]], r["folded"]) for r in made.collect()]


def changed(row):
    return row[3] + 1 if row[0] is not None and row[0] % 3 == 0 and row[3] is not None else row[3]


def rows_of(n, langs):
    return [(7 * k, f"s{k % 3}", langs[k % len(langs)], k, f"text {k} é日") for k in range(n)]


AWKWARD = [
    (None, None, None, None, None), (None, "s", None, 3, "x"), (5, "s", None, 3, ""), (5, "s", "en", 3, "a"), (5, "s", "en", 3, "a"), (5, "s", "en", 3, "b"),
    (6, "-", "", 0, "-"), (9, "1:a", "日本", 2**62, "x" * 200_000), (None, "s", "en", None, "no id"), (12, None, "en", None, "tampering leaves null"), (-3, "s", "EN", 1, "\n\x00"),
]


@pytest.mark.parametrize(
    "rows",
    [AWKWARD, rows_of(1, ["en"]), rows_of(2, ["en"]), rows_of(65, ["en"]), rows_of(64, ["de"]), rows_of(700, ["en", "en", "en", "fr", None]), rows_of(130, [f"l{k}" for k in range(67)])],
    ids=["awkward", "one", "two", "block and one", "block", "one large", "many groups"],
)
def test_equals_a_plain_tree(spark, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], str(r[4]))
    assert sorted(found_manifest(spark, rows), key=key) == sorted(plain_manifest(rows, changed), key=key)


def test_parts_change_nothing(spark):
    rows = rows_of(300, ["en", "en", None])
    assert sorted(found_manifest(spark, rows, 1)) == sorted(found_manifest(spark, rows, 17))


def test_offsets_that_are_joined(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_SENT", 0)
    rows = rows_of(300, ["en", "fr"])
    assert sorted(found_manifest(spark, rows)) == sorted(plain_manifest(rows, changed))


def test_empty_table(spark):
    assert found_manifest(spark, []) == []


def test_tampering_shows(spark):
    rows = rows_of(100, ["en", "fr"])
    for doc_id, leaf, _, root, _, folded in found_manifest(spark, rows):
        assert (folded == root) == (doc_id % 3 != 0)
