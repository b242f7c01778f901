"""Operator 9, WARC: a deterministic sharded writer and its reader.

Records are dealt into shards by ranges of their id and sorted by it, one task a shard; each task writes its shard's records as single
gzip members and rolls to a new file once ``file_bytes`` compressed bytes are reached, so no more than one record is held.
Headers, record ids and digests are made anew from the payload. Of equal payloads of at least ``least_bytes`` bytes the
record with the largest id is a response; the others are revisits that name its record id, URI and date and carry the HTTP head alone.
A task writes each file under a temporary name of its attempt and then gives it its own; the driver publishes a manifest,
which alone says what belongs to the archive, so what a lost attempt left is never read.

Ranges come from exact counts of payload bytes in aligned parts of the ids' range: about four parts a shard, and a part that holds
more than ``shard_bytes`` is divided by 64 further and further, down to a single id, whose records go by their digest. So the files depend on
the rows alone, not on partitions, tasks or their order, and a shard has about ``shard_bytes`` (one part more at most; equal
rows of one id stay together). The driver and a broadcast hold 16 bytes for each part. Equal payloads meet as digests only: a
maximum that is taken before the shuffle.

Null payloads are empty ones; null URLs are empty. Rows that repeat the id of a response are responses too, with record ids
of their own. Rows without an id are dealt by their digest, written with an empty id, and are revisits where others have their
payload; ids are any of 64 bits. An empty table gives an archive without files. Extra columns are not read. The longest
payload bounds a task's memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import files
from faultline.llm.common import Scratch, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE = {c: f"%{c:02X}" for c in [*range(33), 127]}


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, number: int = 0) -> str:
    """The id of the ``number``-th record of a page id and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{number}')}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: tuple[int, str] | None, date: str, number: int = 0) -> bytes:
    """One record with its head and digests; a revisit (``refers_to``: page id and URL of the response) ends with the HTTP head."""
    url, digest = url.translate(_SAFE), sha1_base32(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id, digest, number), "WARC-Date": date, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is None:
        block += payload
    else:
        page, link = refers_to
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(page, digest), "WARC-Refers-To-Target-URI": link.translate(_SAFE), "WARC-Refers-To-Date": date, "Refers-To-Page-ID": str(page)}
    head |= {"WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Page-ID": "" if page_id is None else str(page_id), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head, block) of each record of an open, unpacked archive file; block digests are verified."""
    while first := stream.readline():
        if first.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {first[:40]!r}")
        head = {}
        while line := stream.readline().rstrip(b"\r\n"):
            k, _, v = line.decode().partition(": ")
            head[k] = v
        block = stream.read(int(head["Content-Length"]))
        if head["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        stream.readline()
        stream.readline()
        yield head, block


class Roller:
    """Writes a shard's records to files of about ``most`` compressed bytes below ``root/folder``: each under a name of the attempt, then under its own."""

    def __init__(self, root: str, folder: str, most: int):
        (self.store, self.base), self.folder, self.most = files.open_store(root), folder, most
        self.shard, self.number, self.out, self.held, self.row = None, 0, None, "", None

    def close(self) -> list[dict]:
        if self.out is None:
            return []
        self.out.close()
        files.settle(self.store, self.held, f"{self.base}/{self.row['path']}")
        row, self.out = self.row, None
        return [row]

    def write(self, shard: int, data: bytes) -> list[dict]:
        """Files that were finished before this record."""
        done = []
        if self.out is not None and (shard != self.shard or self.row["bytes"] >= self.most):
            done = self.close()
        if shard != self.shard:
            self.shard, self.number = shard, 0
        if self.out is None:
            name = f"part-{shard:06d}-{self.number:05d}.warc.gz"
            self.held, self.number = f"{self.base}/{self.folder}/_held/{uuid.uuid4().hex}-{name}", self.number + 1
            self.store.create_dir(f"{self.base}/{self.folder}/_held", recursive=True)
            self.out = self.store.open_output_stream(self.held, compression=None)
            self.row = {"path": f"{self.folder}/{name}", "records": 0, "bytes": 0}
        packed = gzip.compress(data, 6, mtime=0)
        self.out.write(packed)
        self.row["records"] += 1
        self.row["bytes"] += len(packed)
        return done


def _levels(rows: DataFrame, shard_bytes: int) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """The parts of the ids' range: for each level its shift and the bytes of each part (page_id >> shift), without those that a later level divides; and the bytes of single ids that exceed a shard."""
    low, high, total = rows.agg(F.min("page_id"), F.max("page_id"), F.sum("size")).first()
    if low is None:
        return [], {}
    wanted = max(64, 4 * (total or 0) // shard_bytes)
    shift = next(s for s in range(64) if (high >> s) - (low >> s) < wanted)
    levels, todo = [], rows.select("page_id", "size").where("page_id is not null")
    while True:
        counts = {r.b: r.n for r in todo.groupBy(F.shiftright("page_id", shift).alias("b")).agg(F.sum("size").alias("n")).collect()}
        large = {b: n for b, n in counts.items() if n > shard_bytes}
        levels.append((shift, {b: n for b, n in counts.items() if b not in large or not shift}))
        if not shift or not large:
            return levels, large if not shift else {}
        todo = todo.join(F.broadcast(rows.sparkSession.createDataFrame([(b,) for b in large], "b bigint")), F.shiftright("page_id", shift) == F.col("b"), "left_semi")
        shift = max(0, shift - 6)


def _shards(rows: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """(shift, part, shard, of): the shard of each part, or for a single id that exceeds one the first of its ``of`` shards; and the number of shards."""
    levels, alone = _levels(rows, shard_bytes)
    parts = sorted((b << shift, shift, b, n) for k, (shift, found) in enumerate(levels) for b, n in found.items())
    placed, shard, held = [], 0, 0
    for _, shift, b, n in parts:
        many = -(-n // shard_bytes) if not shift and b in alone else 1
        if held and (many > 1 or held + n > shard_bytes):
            shard, held = shard + 1, 0
        placed.append((shift, b, shard, many))
        shard, held = (shard + many, 0) if many > 1 else (shard, held + max(1, n))
    return rows.sparkSession.createDataFrame(placed, "shift int, part bigint, shard int, of int"), max(1, shard + bool(held))


def write_archive(
    pages: DataFrame, root: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, file_bytes: int = 64 << 20, shard_bytes: int = 256 << 20, date: str = "2024-01-01T00:00:00Z"
) -> dict:
    """Writes the rows of ``pages`` as the next version of the archive at ``root``; returns its manifest."""
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), text.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1(F.col("payload").cast("binary"))})
    parts, count = _shards(rows.select("page_id", "size"), shard_bytes)
    shifts = sorted({r.shift for r in parts.select("shift").distinct().collect()})

    def dealt(df: DataFrame) -> DataFrame:
        """With ``shard``: by the parts of each level (as many rows as there are parts), rows without an id and those of a large single id by their digest."""
        for s in shifts:
            mine = parts.where(F.col("shift") == s).select(F.col("part").alias(f"_p{s}"), F.struct("shard", "of").alias(f"_s{s}"))
            df = df.join(F.broadcast(mine), F.shiftright("page_id", s) == F.col(f"_p{s}"), "left").drop(f"_p{s}")
        at = F.coalesce(*(F.col(f"_s{s}") for s in shifts)) if shifts else F.lit(None).cast("struct<shard:int,of:int>")
        place = F.coalesce(at, F.struct(F.lit(0).alias("shard"), F.lit(count).alias("of")))
        spread = F.pmod(F.xxhash64("digest"), place["of"].cast("long")).cast("int")
        return df.withColumn("shard", place["shard"] + spread).drop(*(f"_s{s}" for s in shifts))

    # The least URL of the response stands in references to it; ~page_id turns the order of ids round.
    copies = rows.select("digest", "page_id", "url", "size").where(f"size >= {least_bytes}")
    heads = copies.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct(F.expr("~page_id").alias("r"), "url"))).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1 and h is not null")
    heads = heads.select("digest", F.expr("~h.r").alias("head"), F.col("h.url").alias("head_url"))
    # Payloads are shuffled once: the notes of what each revisit refers to travel beside them and sort before their record.
    notes = copies.select("digest", "page_id").join(heads, "digest").where("not (page_id <=> head)").distinct()
    noted = notes.select("page_id", "digest", F.lit(0).alias("kind"), F.col("head_url").alias("url"), F.lit("").alias("payload"), F.col("head").alias("refers_to"))
    full = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    shards = dealt(full.unionAll(noted)).repartitionById(count, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url", "payload")
    manifests = files.Manifests(root)
    version = manifests.latest()[0] + 1
    folder = f"v{version:08d}-{uuid.uuid4().hex[:12]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, note, last, number = Roller(root, folder, file_bytes), None, None, 0
        for batch in batches:
            done = []
            for k in range(batch.num_rows):
                page, digest, kind, link, body, refers, shard = (c[k].as_py() for c in batch.columns)
                if kind == 0:
                    note = ((page, digest), (refers, link))
                    continue
                number = number + 1 if last == (page, digest) else 0
                last = (page, digest)
                done += roller.write(shard, record(page, link, body.encode(), note[1] if note and note[0] == last else None, date, number))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_FILES)
        if done := roller.close():
            yield pa.RecordBatch.from_pylist(done, schema=_FILES)

    # One row for each file, from the attempts that succeeded.
    found = sorted((r.path, r.records, r.bytes) for r in shards.mapInArrow(run, "path string, records bigint, bytes bigint").collect())
    body = {"version": version, "files": [{"path": path, "records": n, "bytes": b} for path, n, b in found]}
    manifests.commit(version, body)
    files.remove(f"{root}/{folder}/_held")
    return body


_FILES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """The records of the archive's version in force: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for revisits)."""
    kinds = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
    paths = [(f["path"],) for f in files.Manifests(root).latest()[1].get("files", [])]
    if not paths:
        return spark.createDataFrame([], kinds)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, base = files.open_store(root)
                held, size = [], 0
                with store.open_input_stream(f"{base}/{path}", compression=None) as raw, gzip.open(raw) as stream:
                    for head, block in records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = head["WARC-Type"] == "revisit"
                        if not revisit and (len(payload) != n or sha1_base32(payload) != digest):
                            raise ValueError(f"damaged payload {head['WARC-Record-ID']}")
                        held.append((int(head["Page-ID"]) if head["Page-ID"] else None, head["WARC-Target-URI"], head["WARC-Type"], int(head["Refers-To-Page-ID"]) if revisit else None, digest, n, None if revisit else payload))
                        size += len(block)
                        if size > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return spark.createDataFrame(paths, "path string").repartition(min(len(paths), 100_000)).mapInArrow(run, kinds)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "warc").root
    write_archive(table(spark, sf_dir, "pages"), root, file_bytes=8 << 20, shard_bytes=32 << 20)
    return read_archive(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, octet_length(encode(html)) AS payload_bytes, unhex(sha1(html))::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT
    + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM d"""
