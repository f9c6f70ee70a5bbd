"""Registered queries against their SQL twins, and the pipeline against plain Python."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import corpus_pipeline  # noqa: E402
from cohortlake.llm import queries  # noqa: E402
from test_texts import brute_chunks, brute_join, brute_leaks, brute_pieces, words  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from check import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = rows_of(queries.QUERIES[name](spark, DATA).toArrow()), rows_of(con.execute(queries.ORACLES[name]).to_arrow_table())
    assert got[0] == want[0] and got[2] == want[2]


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in queries.QUERIES["op8_robust_rules"](spark, DATA).filter("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    rows = [(i, t) for i, _, gone, t in brute_chunks(rows) if not gone or words(t)]
    classes = {}
    for i, _, c, _, _ in brute_join(rows):
        classes[c] = min(classes.get(c, i), i)
    rows = [(i, t) for i, t in rows if i in classes.values()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = {i for i, *_ in brute_leaks(rows, items)}
    rows = [(i, t) for i, t in rows if i not in leaks]
    got = corpus_pipeline.run(spark, DATA)
    assert sorted((tuple(r) for r in got.select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=str) == brute_pieces(rows)
    assert got.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 1024").count() == 0


def test_pipeline_takes_awkward_rows(spark, documents, tmp_path):
    from text_cases import AWKWARD

    for name, rows in (("some", AWKWARD), ("none", [])):
        documents(rows, True).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() >= 0
