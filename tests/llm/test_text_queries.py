"""Registered text queries against DuckDB, and the pipeline against plain versions of its stages."""

import collections
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from barspan.llm import classifier, jaccard, packing, pii, wordbpe
from barspan.llm.queries import QUERIES, SQL, WORD_MODEL, documents, vocabulary


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    problem = differences(QUERIES[name](spark, sf_dir).toPandas(), duck(sf_dir).execute(SQL[name]).df())
    assert problem is None, problem


def test_all_are_registered():
    known = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(known)
    assert known["pipeline"].__wrapped__ is corpus_pipeline.run


def test_pipeline(spark, small_dir):
    docs = documents(spark, small_dir)
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in left.collect()}
        left = stage(spark, left, small_dir)
        assert left.columns == docs.columns
        after = {r["doc_id"]: r for r in left.collect()}
        assert set(after) <= set(before) and after
        if name == "quality_rules":
            rows = {r["doc_id"]: r["kept"] for r in QUERIES["op3_quality_rules"](spark, small_dir).collect()}
            assert set(after) == {k for k in before if rows[k]}
        if name == "near_duplicates":
            assert len({r["text"] for r in after.values()}) == len(after)
        if name == "personal_data":
            assert set(after) == set(before)
            for k, r in after.items():
                assert r["text"] == pii.redacted(before[k]["text"], pii.find_spans(before[k]["text"])) and r["n_chars"] == len(r["text"])
        left = spark.createDataFrame(list(after.values()), docs.schema)
    rows = corpus_pipeline.run(spark, small_dir).collect()
    pieces = collections.Counter(r["doc_id"] for r in rows)
    assert set(pieces) == {r["doc_id"] for r in left.collect()}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[1:]])
def test_stages_hand_workers_small_batches(spark, small_dir, name):
    """Batches follow bytes: 9,000 texts of 2,500 bytes came as one."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    spark.conf.unset(setting)
    try:
        dict(corpus_pipeline.STAGES)[name](spark, documents(spark, small_dir), small_dir)
        rows = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("word "), 500).alias("text"))
        found = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.unset(setting)
    assert sum(found) > 9000 * 2500 and max(found) < 1.01 * corpus_pipeline.BATCH_BYTES


def test_join_drops_the_stores_of_tokenizers():
    """A worker that has packed holds a vocabulary and tokens; they go when it joins."""
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a few words"])], names=["doc_id", "text"])
    assert list(wordbpe.encoded([batch], vocabulary(WORD_MODEL).decode())) and wordbpe._stores

    class Rows:
        def mapInArrow(self, run, schema):
            return list(run([batch]))

    assert jaccard.signatures(Rows())[0].column("n").to_pylist() == [1]
    assert not wordbpe._stores


def test_packed_sequences_hold_their_ids(spark, small_dir):
    """The pipeline and op9 return the sequences: a document's pieces decode to its text."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(vocabulary(WORD_MODEL).decode())
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, small_dir).collect()}
    for name in ("op9_packing", "pipeline"):
        pieces = collections.defaultdict(dict)
        for r in __spark_entry__.queries()[name](spark, small_dir).collect():
            assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
            pieces[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], "<u4").tolist()
        assert pieces
        for doc_id, found in pieces.items():
            ids = [i for _, piece in sorted(found.items()) for i in piece]
            text = texts[doc_id] if name == "op9_packing" else pii.redacted(texts[doc_id], pii.find_spans(texts[doc_id]))
            assert ids == [*model.encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_classifier_on_held_out_rows(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op5_quality_classifier"](spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
    assert all(r["predicted"] == int(r["score"] >= classifier.THRESHOLD) for r in rows)


def test_class_model_beats_the_base(spark, sf_dir):
    rows = [r for r in QUERIES["op8_class_model"](spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_rest_does_not_need_these_parts():
    root = os.path.dirname(__spark_entry__.__file__)
    for folder, _, names in os.walk(os.path.join(root, "barspan")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as file:
                    assert "barspan.llm" not in file.read()
