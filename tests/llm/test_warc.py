"""Archives and the capture index against the pages they were made of."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cohortlake.llm import common, warc

DDL = "page_id bigint, url string, html string, digest string, n bigint"


def want(rows, least=100):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least and i is not None:
            first[b] = min(first.get(b, i), i)
    out, done = [], set()
    for i, u, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        b = (h or "").encode()
        stored = len(b) < least or b not in done
        done.add(b)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if stored else "revisit", None if stored else first.get(b)))
    return sorted(out, key=str)


def pages():
    rng = random.Random(2)
    rows = [(i, rng.choice(["http://x.org/", "https://a.b.example.com:80/p?q=%d#f" % (i % 5), None, "", "rel/ative", "http://x.org/\nodd"]), rng.choice(["z" * 99, "é" * 50, "y" * 300, None, "", f"own {i} \r\n\r\n" * 30])) for i in range(150)]
    rows += [rows[7]] * 3 + [(None, "http://n.org", "y" * 300), (None, None, None)] + [(300, "u", "l\n" * 200_000)]
    return rows


def test_round_trip(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DDL)
    folder = common.shared_folder(spark)
    got = warc.round_trip(df, folder)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == want(rows)
    # The archives are plain WARC: gzip members one after the other, each a record.
    raw = b"".join(gzip.decompress(r.content) for r in spark.read.format("binaryFile").load(f"{folder}/archives").filter("path not like '%_SUCCESS'").collect())
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)
    # Some URLs only, and payloads.
    some = warc.lookup(spark, f"{folder}/index", spark.createDataFrame([("http://X.org/",), ("http://none.org/",), ("https://a.b.example.com:80/p?q=3",)], "url string"))
    pairs = {(r.page_id, r.payload) for r in warc.read_records(some, with_payload=True).collect() if r.record_type == "response"}
    asked = [r for r in rows if r[1] in ("http://x.org/", "https://a.b.example.com:80/p?q=3#f")]
    assert some.count() == len(asked) and pairs <= {(i, h or "") for i, _, h in asked}


def test_key_runs_over_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 8)
    monkeypatch.setattr(warc, "SHARD", 40)
    rows = [(i, "http://hot.org/a" if i % 3 else f"http://h{i}.org/", "p" * (100 + i)) for i in range(200)]
    folder = common.shared_folder(spark)
    got = warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string"), folder)
    assert got.count() == 200 and got.select("page_id").distinct().count() == 200
    directory = spark.read.parquet(f"{folder}/index/directory")
    assert directory.select("shard").distinct().count() > 2 and directory.count() > 20
    assert warc.lookup(spark, f"{folder}/index", spark.createDataFrame([("http://hot.org/a",)], "url string")).count() == 133


def test_empty_table(spark):
    df = spark.createDataFrame([], DDL)
    assert warc.round_trip(df, common.shared_folder(spark)).count() == 0


def test_keys_reverse_the_host(spark):
    cases = {"https://A.b.org:80/x?y#z": "org,b,A:80)/x?y".lower(), "//u@h.de": "de,h)", "x/y": ")x/y", None: ")"}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.k for r in df.select("url", warc.url_key(F.col("url")).alias("k")).collect()} == cases


def test_a_changed_payload_is_noticed(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 41\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n"
    path = tmp_path / "a.gz"
    path.write_bytes(gzip.compress(record))
    captures = spark.createDataFrame([(f"file:{path}", 0, path.stat().st_size)], "file string, offset bigint, length bigint")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_records(captures).collect()
