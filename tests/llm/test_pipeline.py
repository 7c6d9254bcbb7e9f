"""The pipeline's stages, and the registration of the subpackage."""

import re
from collections import Counter

import corpus_pipeline
import pyarrow as pa
from conftest import SMALL

from __spark_entry__ import queries
from contractflow.llm import pieces, toxicity
from contractflow.llm.common import staged, table
from contractflow.llm.queries import QUERIES


def test_stages(spark, odd_docs):
    docs, names = table(spark, SMALL, "documents"), []
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, SMALL), name)
        names.append(name)
        counts.append(docs.count())
        if name != "pieces":
            assert docs.columns == columns
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "mixing":
            assert max(Counter(r["doc_id"] for r in docs.collect()).values()) <= 3
    assert names == ["toxicity", "language", "simhash_dedup", "mixing", "pieces"]
    assert counts[0] > counts[1] >= counts[2] > counts[3]
    assert all(r["round_trip"] for r in docs.select("round_trip").collect())


def test_stages_on_odd_and_empty_rows(spark, odd_docs, no_docs):
    for first in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, first, SMALL).columns == first.columns
        docs = first
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, SMALL), name)
        assert docs.count() == 0 or first is odd_docs


def test_workers_hand_counts_on_early():
    texts = [" ".join(f"{i:x}q" for i in range(start, start + 10_000)) for start in range(1 << 20, (1 << 20) + 200_000, 10_000)]
    batches = [pa.RecordBatch.from_arrays([pa.array([t]), pa.array([[1, 0]])], ["text", "labels"]) for t in texts]
    out = list(toxicity._label_counts(iter(batches)))
    assert max(b.num_rows for b in out) <= 100_000
    counted = Counter()
    for b in out:
        counted.update(dict(zip(b["feature"].to_pylist(), b["rows"].to_pylist())))
    assert counted == sum((Counter(toxicity.features(t)) for t in texts), Counter())


def test_small_windows_give_the_same_pieces(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text").dropDuplicates(["doc_id"])
    found = [sorted(map(str, pieces.sample_segmentations(docs, window=window).collect()))
             for window in (pieces.WINDOW, corpus_pipeline.WINDOW, 1000)]
    assert found[0] == found[1] == found[2]


def test_one_word_documents_are_encoded(spark):
    """Of a large table some documents are one sentence of one word, with a single way to cut it."""
    texts = ["Ê.", "Ó.", "Íñ.", "Êé.", "Óíó.", "Êç."]
    docs = spark.createDataFrame([(i, t, "fr", "s", len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.encode(spark, docs, SMALL).collect()
    assert sorted((r["doc_id"], r["sample"], r["round_trip"]) for r in found) == [(i, 1, True) for i in range(len(texts))]


def test_registered_names():
    found = queries()
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", name)) for name in QUERIES) == 1
    assert set(QUERIES) | {"pipeline"} <= set(found)
