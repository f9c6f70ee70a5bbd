"""The two classifiers on driver tables and on awkward rows."""

import os
import zlib

import numpy as np
import pytest

from cohortlake.llm import quality_fm, sparse, toxicity_pu
from text_cases import AWKWARD

DATA = "/root/testdata/sf0.01"
LABELS = "doc_id bigint, quality int, toxic int, label int"


def test_pairwise_part_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    rows = [(np.arange(n), rng.normal(size=n)) for n in (1, 4, 7)]
    m = quality_fm.Machine(10, 3)
    m.w = rng.normal(size=10)
    raw, _ = m.parts(sparse.Rows(rows))
    for (i, v), got in zip(rows, raw):
        slow = (m.w[i] * v).sum() + sum(m.v[a] @ m.v[b] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert abs(slow - got) < 1e-9


def test_taken_rows_are_the_rows():
    rows = sparse.Rows([(np.array([1, 2]), np.array([1.0, 2.0])), (np.array([5]), np.array([3.0])), (np.array([7, 8, 9]), np.ones(3))])
    some = rows.take(np.array([2, 0]))
    assert some.index.tolist() == [7, 8, 9, 1, 2] and some.row.tolist() == [0, 0, 0, 1, 1] and some.start.tolist() == [0, 3]


@pytest.mark.parametrize("classify, parts, held, cut", [(quality_fm.classify, 5, 0, 0.3), (toxicity_pu.classify, 3, 1, 0.7)])
def test_awkward_rows(spark, documents, classify, parts, held, cut):
    docs = documents(AWKWARD, True)
    for labels in ([], [(5, 1, 1, 0), (7, 0, 0, 0), (8, 1, 1, 1), (8, 0, 0, 1), (None, 1, 1, 1), (9, None, None, 1), (4, 0, 1, 0), (2, 1, 0, 0)]):
        got = classify(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(i for i, _ in AWKWARD if i is not None)
        for r in got:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == held)
    assert classify(documents([]), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")
@pytest.mark.parametrize("classify, column, least", [(quality_fm.classify, "quality", 0.97), (toxicity_pu.classify, "toxic", 0.93)])
def test_held_out_accuracy(spark, classify, column, least):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got["predicted"] == got[column]).mean() >= least


def test_labels_of_the_held_out_fold_do_not_matter(spark, documents):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for classify, parts, held in ((quality_fm.classify, 5, 0), (toxicity_pu.classify, 3, 1)):
        flipped = labels.selectExpr("doc_id", *[f"if(crc32(cast(cast(doc_id as string) as binary)) % {parts} = {held}, 1 - {c}, {c}) AS {c}" for c in ("quality", "toxic")])
        a, b = (sorted((r.doc_id, r.score) for r in classify(docs, x).collect()) for x in (labels, flipped))
        assert a == b
