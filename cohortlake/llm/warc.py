"""WARC archives with a two-level capture index.

Archives are files of one gzip member per record. The index sorts captures by reversed-host URL key, packs them
into compressed blocks and keeps a sparse directory of the blocks' first and last keys. A look-up finds the range
of keys (shard) by binary search, then the block in that shard's directory, then the capture in the block; only
then are bytes of an archive read, by offset and length.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlake.llm import common

LEAST_REVISIT = 100  # bytes; smaller payloads are always stored
BLOCK = 512  # captures in a block of the index
SHARD = 8192  # captures in a shard of the index, as long as there are fewer than SHARDS
SHARDS = 4096  # most shards; so many (first key, last key) pairs at most reach the driver
SPAN = 1 << 22  # bytes fetched at once by a range read
GAP = 1 << 14  # unwanted bytes that are fetched rather than ask again
DATE = "1970-01-01T00:00:00Z"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)  # gzip of nothing; separates records
HEAD = "record_id string, record_type string, url string, page_id {id}, payload_digest string, payload_bytes long, refers_to {id}"
CAPTURE = "key string, record_id string, record_type string, url string, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """``https://a.example.org:80/x?y#z`` -> ``org,example,a:80)/x?y``; null and relative URLs have an empty host."""
    start = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
    url = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    place = F.regexp_extract(url, start + r"(?:[^/?#@]*@)?([^/?#]*)", 1)
    host, port = F.regexp_extract(place, r"^([^:]*)", 1), F.regexp_extract(place, r"(:.*)$", 1)
    tail = F.regexp_extract(F.regexp_replace(url, start + r"[^/?#]*", ""), r"^([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), port, F.lit(")"), tail)


def decide(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """One row per page: which record it becomes. Only digests and ids are shuffled.

    Of equal payloads of ``least`` bytes or more the smallest page_id is the response; null ids come last, and ties
    of one id go by URL. Rows that repeat id, URL and payload are counted, and one of them is the response.
    """
    rows = pages.groupBy("digest", "n", "page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("b"), F.col("url").isNull().alias("c"), F.col("url").alias("d"))
    first = rows.filter(F.col("n") >= least).groupBy("digest", "n").agg(F.min(order).alias("first"))
    out = rows.join(first, ["digest", "n"], "left").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    stored = F.col("first").isNull() | (order.eqNullSafe(F.col("first")) & (F.col("copy") == 0))
    return out.select("digest", "n", "page_id", "url", "copy", stored.alias("stored"), F.when(~stored, F.col("first.b")).alias("refers_to"))


def _record_id(page_id: object, copy: int = 0) -> str:
    name = "null" if pd.isna(page_id) else str(int(page_id)) if isinstance(page_id, float) else str(page_id)
    return f"urn:page:{name}" + (f":{copy}" if copy else "")


def _one_line(value: object) -> str:
    return "" if not isinstance(value, str) else value.replace("\r", "%0D").replace("\n", "%0A")


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for x in batch.itertuples(index=False):
            payload = x.html.encode("utf-8", "surrogatepass") if isinstance(x.html, str) else b""
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {x.n}\r\n\r\n".encode()
            block = http + payload if x.stored else http
            head = [
                "WARC/1.1",
                f"WARC-Type: {'response' if x.stored else 'revisit'}",
                f"WARC-Record-ID: <{_record_id(x.page, x.copy)}>",
                f"WARC-Date: {DATE}",
                f"WARC-Target-URI: {_one_line(x.url)}",
                f"WARC-Payload-Digest: sha256:{x.digest}",
                "Content-Type: application/http; msgtype=response",
                f"Content-Length: {len(block)}",
            ]
            if not x.stored:
                head += [f"WARC-Refers-To: <{_record_id(x.refers)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
            out.append(gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0))
        yield pd.DataFrame({"value": pd.Series(out, dtype=object)})


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """A WARC record for each row of ``pages(page_id, url, html)``; a null html is an empty payload.

    The text writer puts out each record's bytes as they are, with an empty gzip member as line separator, so any
    file system that Spark knows will do and failed tasks leave nothing behind. Revisits are written without
    fetching their payload; the others' payloads are shuffled once.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    slim = pages.select("page_id", "url", F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).cast("long").alias("n"))
    choice = common.stage(decide(slim, least).withColumn("k", F.xxhash64("page_id", "url")))
    bodies = pages.select(F.xxhash64("page_id", "url").alias("k"), F.sha2(body.cast("binary"), 256).alias("digest"), "html").dropDuplicates(["k", "digest"])
    stored = choice.filter("stored").join(bodies, ["k", "digest"]).select(*choice.columns, "html")
    rows = stored.unionByName(choice.filter("not stored").withColumn("html", F.lit(None).cast("string")))
    named = rows.select(F.col("page_id").cast("string").alias("page"), "url", "digest", "n", "copy", "stored", F.col("refers_to").cast("string").alias("refers"), "html")
    records = named.mapInPandas(_records, "value binary").select(F.col("value").cast("string"))
    records.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def _open(uri: str):
    """A file as pyarrow opens it on the executor: local, HDFS or an object store."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri[5:].lstrip("/"))
    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return system.open_input_file(path)


def _members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that isn't empty; the file is streamed."""
    at, start, parts, member = 0, 0, [], zlib.decompressobj(31)
    while chunk := stream.read(1 << 18):
        while chunk:
            parts.append(member.decompress(chunk))
            rest = member.unused_data
            at += len(chunk) - len(rest)
            if member.eof:
                if content := b"".join(parts):
                    yield start, at - start, content
                start, parts, member = at, [], zlib.decompressobj(31)
            chunk = rest
    if at > start:
        raise ValueError("the archive ends within a record")


def _parse(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def _index_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for uri in batch["path"]:
            rows = []
            with _open(uri) as stream:
                for offset, length, content in _members(stream):
                    f, _, _ = _parse(content)
                    rows.append((f["WARC-Record-ID"].strip("<>"), f["WARC-Type"], f.get("WARC-Target-URI", ""), uri, offset, length))
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=["record_id", "record_type", "url", "file", "offset", "length"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["record_id", "record_type", "url", "file", "offset", "length"])


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted captures of one shard -> its compressed blocks."""

    def block(rows: list[tuple], shard: int, number: int) -> pd.DataFrame:
        lines = "\n".join(json.dumps(r) for r in rows)
        return pd.DataFrame([(shard, number, rows[0][0], rows[-1][0], len(rows), zlib.compress(lines.encode("utf-8", "surrogatepass")))], columns=["shard", "block", "first_key", "last_key", "n", "captures"])

    rows, shard, number = [], -1, 0
    for batch in batches:
        for x in batch.itertuples(index=False, name=None):
            shard = x[0]
            rows.append(x[1:])
            if len(rows) == BLOCK:
                yield block(rows, shard, number)
                rows, number = [], number + 1
    if rows:
        yield block(rows, shard, number)


def build_index(spark: SparkSession, archives: str, path: str) -> None:
    """Index all records of the archives in a folder, as the tables ``blocks`` and ``directory`` below ``path``.

    Captures of one URL are told apart by their record ids, so even a URL with a third of all captures is dealt
    over many shards.
    """
    files = spark.read.format("binaryFile").load(archives).select("path").filter(~F.col("path").endswith("_SUCCESS"))
    number = files.count()
    found = files.repartition(max(number, 1), "path").mapInPandas(_index_files, "record_id string, record_type string, url string, file string, offset long, length long")
    captures = common.stage(found.withColumn("key", url_key(F.col("url"))))
    shards = min(SHARDS, captures.count() // SHARD + 1)
    dealt = captures.repartitionByRange(shards, "key", "record_id").withColumn("shard", F.spark_partition_id())
    columns = [c.split()[0] for c in CAPTURE.split(", ")]
    blocks = dealt.select("shard", *columns).sortWithinPartitions("key", "record_id").mapInPandas(_pack, "shard int, block int, first_key string, last_key string, n int, captures binary")
    blocks.write.parquet(f"{path}/blocks")
    spark.read.parquet(f"{path}/blocks").drop("captures").write.parquet(f"{path}/directory")


def lookup(spark: SparkSession, index: str, urls: DataFrame) -> DataFrame:
    """Captures (``key``, record, file, offset, length) of each distinct URL of ``urls(url)``; none for unknown ones."""
    directory = spark.read.parquet(f"{index}/directory")
    blocks = spark.read.parquet(f"{index}/blocks")
    bounds = directory.groupBy("shard").agg(F.min("first_key").alias("a"), F.max("last_key").alias("b")).orderBy("shard").collect()  # SHARDS rows at most
    numbers, firsts, lasts = [r.shard for r in bounds], [r.a for r in bounds], [r.b for r in bounds]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, numbers[i]) for k in batch["key"] for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            yield pd.DataFrame(out, columns=["key", "shard"])

    def find(keys: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        first, last, shard = part["first_key"].tolist(), part["last_key"].tolist(), part["shard"].iloc[0] if len(part) else 0
        out = [(k, shard, part["block"].iloc[i]) for k in keys["key"] for i in range(bisect.bisect_left(last, k), bisect.bisect_right(first, k))]
        return pd.DataFrame(out, columns=["key", "shard", "block"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for wanted, data in zip(batch["wanted"], batch["captures"], strict=True):
                rows = [json.loads(x) for x in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")]
                keys, out = [r[0] for r in rows], []
                for k in wanted:
                    out += rows[bisect.bisect_left(keys, k) : bisect.bisect_right(keys, k)]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in CAPTURE.split(", ")])

    keys = urls.select(url_key(F.col("url")).alias("key")).distinct()
    routed = keys.mapInPandas(route, "key string, shard int")
    hits = routed.groupBy("shard").cogroup(directory.groupBy("shard")).applyInPandas(find, "key string, shard int, block int")
    asked = hits.groupBy("shard", "block").agg(F.collect_list("key").alias("wanted"))
    return blocks.join(asked, ["shard", "block"]).select("wanted", "captures").mapInPandas(search, CAPTURE)


def read_records(captures: DataFrame, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """Fetch captures by range reads and parse them; neighbours in a file are fetched together.

    A response's payload is checked against its digest. A revisit has no payload of its own: ``payload`` is null,
    and digest and size are those of the payload it refers to.
    """

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = list(zip(batch["file"], batch["offset"], batch["length"], strict=True))
            i = 0
            while i < len(rows):
                uri, start, length = rows[i]
                j, end = i + 1, start + length
                while j < len(rows) and rows[j][0] == uri and 0 <= rows[j][1] - end <= GAP and rows[j][1] + rows[j][2] - start <= SPAN:
                    end = rows[j][1] + rows[j][2]
                    j += 1
                with _open(uri) as stream:
                    data = stream.read_at(end - start, start)
                out = []
                for _, offset, size in rows[i:j]:
                    f, http, payload = _parse(gzip.decompress(data[offset - start : offset - start + size]))
                    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    stored = f["WARC-Type"] == "response"
                    if stored and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{uri} at {offset}: the payload does not match its digest")
                    n = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    name = f["WARC-Record-ID"].strip("<>")
                    refers = f["WARC-Refers-To"].strip("<>").split(":")[2] if "WARC-Refers-To" in f else "null"
                    row = (name, f["WARC-Type"], f.get("WARC-Target-URI", ""), name.split(":")[2], digest, n, refers)
                    out.append(row + (payload.decode("utf-8", "surrogatepass") if stored else None,) * with_payload)
                yield pd.DataFrame(out, columns=names)
                i = j

    kinds = HEAD.format(id="string") + ", payload string" * with_payload
    names = [c.split()[0] for c in kinds.split(", ")]
    near = captures.repartition("file", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("file", "offset").select("file", "offset", "length")
    ids = {c: F.expr(f"cast(nullif({c}, 'null') as {id_type})") for c in ("page_id", "refers_to")}
    return near.mapInPandas(fetch, kinds).withColumns(ids)


def round_trip(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` as archives below ``folder``, index them, look all their URLs up and read the records back.

    Extra columns of ``pages`` are ignored. An empty table gives no rows.
    """
    spark = pages.sparkSession
    write_archives(pages, f"{folder}/archives", least)
    build_index(spark, f"{folder}/archives", f"{folder}/index")
    captures = lookup(spark, f"{folder}/index", pages.select("url"))
    return read_records(captures, pages.schema["page_id"].dataType.simpleString())
