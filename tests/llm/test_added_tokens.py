"""The registered packing gives the ids of an unmodified Tokenizer, added tokens included."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from cohortlake.llm import packing, queries
from text_cases import AWKWARD

TOKENIZERS = pytest.importorskip("public_tokenizers")
TEXTS = [
    "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|startoftext|> y", "<|endoftext| >", "plain",
    "z " * 700 + "<|endoftext|>" + " q" * 700, "w" * 9000 + "<|endoftext|>", *[t or "" for _, t in AWKWARD],
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_unmodified_tokenizer(name):
    from tokenizers import Tokenizer

    plain, encoder = Tokenizer.from_file(TOKENIZERS.path(name)), packing.Encoder(TOKENIZERS.path(name), added=True)
    for t in TEXTS:
        assert encoder.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_query_and_pipeline_stage_keep_added_tokens(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZERS.path("byte_bpe_50k.json"))
    want = []
    for i, t in enumerate(TEXTS):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    docs = documents(list(enumerate(TEXTS)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for got in (queries.op4_island_packing(spark, str(tmp_path)), corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path))):
        assert sorted(tuple(r) for r in got.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == sorted(want)
