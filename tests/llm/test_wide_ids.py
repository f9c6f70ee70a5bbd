"""Ids keep all digits in the operators that go through Python, also beside null ids."""

import public_tokenizers
import pytest

from cohortlake.llm import ngram_join, packing, quality_fm, robust_rules, seed_extend, toxicity_pu

IDS = [-(2**62) - 1, 2**53 + 1, 2**53 + 3, None]


@pytest.mark.parametrize(
    "operator",
    [
        lambda docs, labels: quality_fm.classify(docs, labels),
        lambda docs, labels: packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")),
        lambda docs, labels: ngram_join.join(docs),
        lambda docs, labels: seed_extend.remove_repeats(docs),
        lambda docs, labels: robust_rules.judge(docs),
        lambda docs, labels: toxicity_pu.classify(docs, labels),
    ],
    ids=["op2", "op4", "op6", "op7", "op8", "op10"],
)
def test_ids_keep_all_digits(spark, wide_ids, operator):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = [r.doc_id for r in operator(wide_ids, labels).select("doc_id").collect()]
    assert sorted(got, key=lambda i: (i is None, i or 0)) == IDS
