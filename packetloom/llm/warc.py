"""Deterministic sharded WARC writer and reader.

Pages are dealt to shards by exact ranges of page id that hold about equal bytes. So that raw pages
never cross the network, each task sorts its pages per shard into compressed runs; a shard's task
merges its runs in order of (page id, digest, url), writes records with regenerated headers and
digests, and starts a new file when the compressed size reaches the limit. A file gets its name only
when it is complete, and readers open only the files that the manifest lists, which is written last.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import arrow_schema, map_rows, saved, to_batch
from packetloom.session import scratch_path

RUN = "shard int, run binary, page_id long, sha binary, response_id long"
MANIFEST = "file string, records long, raw_bytes long, file_bytes long, first_page long, last_page long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RUN_BYTES, RUN_BATCH, HELD_BYTES, FRAME_BYTES = 8 << 20, 1 << 20, 64 << 20, 1 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace
DATE = "2000-01-01T00:00:00Z"


def balanced_ranges(keys: DataFrame, column: str, weight: str, parts: int, bins: int = 256) -> list[tuple[int, int]]:
    """(first value, number of sub-parts) of consecutive ranges of a whole-number column, of about equal weight.

    Exact counts, so the same table gives the same ranges however it is stored. A range too heavy is
    divided again until it is a single value, which gets sub-parts. At most ``bins`` sums per heavy range
    reach the driver in a round.
    """
    low, high, total = keys.agg(F.min(column), F.max(column), F.sum(weight)).first()
    if low is None or not total:
        return [(0, 1)]
    target = max(1, -(-total // parts))
    todo, light = [(low, high)], []
    while todo:
        step = {a: (b - a) // bins + 1 for a, b in todo}
        edges = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(step[a]).cast("long").alias("step")) for a, b in todo])
        own = F.get(F.filter(edges, lambda e: (e["a"] <= F.col(column)) & (F.col(column) <= e["b"])), 0)
        start = own["a"] + F.floor((F.col(column) - own["a"]) / own["step"]).cast("long") * own["step"]
        sums = (keys.filter(own.isNotNull()).groupBy(own["a"].alias("a"), start.alias("start")).agg(F.sum(weight).alias("w")).collect())
        todo = []
        for r in sums:
            if r["w"] > target and step[r["a"]] > 1:
                todo.append((r["start"], r["start"] + step[r["a"]] - 1))
            else:
                light.append((r["start"], r["w"]))
    ranges, held = [], 0
    for start, w in sorted(light):
        if not ranges or held + w > target:
            ranges.append((start, max(1, -(-w // target))))
            held = 0
        held += w
    return ranges


def shard_of(ranges: list[tuple[int, int]], unnamed: int = 0):
    """``page id, digest -> shard``, and the number of shards.

    Null ids have the first ``unnamed`` shards (at least one where such a row comes), by their digest. Ids below
    the first range go to that range; a range of several shards is dealt by digest.
    """
    starts = np.array([r[0] for r in ranges], np.int64)
    first = unnamed + np.concatenate([[0], np.cumsum([r[1] for r in ranges])])

    def part(sha: bytes, parts: int) -> int:
        return int.from_bytes(sha[:4], "big") * parts >> 32

    def shard(page_id, sha: bytes) -> int:
        if page_id is None:
            return part(sha, max(1, unnamed))
        at = max(int(np.searchsorted(starts, page_id, side="right")) - 1, 0)
        return int(first[at]) + part(sha, ranges[at][1])

    return shard, int(first[-1])


def pack_run(rows: list[tuple]) -> bytes:
    """Sorted rows (page_id, sha, url, html) as a compressed Arrow stream."""
    schema = pa.schema([("page_id", pa.int64()), ("sha", pa.binary()), ("url", pa.string()), ("html", pa.binary())])
    rows.sort(key=order_key)
    sink, part, size = io.BytesIO(), [], 0
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        for i, row in enumerate(rows):
            part.append(row)
            size += len(row[3])
            if size >= RUN_BATCH or i == len(rows) - 1:
                stream.write_batch(to_batch(part, schema))
                part, size = [], 0
    return sink.getvalue()


def open_run(run: bytes) -> Iterator[tuple]:
    for batch in pa.ipc.open_stream(pa.BufferReader(run)):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def order_key(row: tuple) -> tuple:
    return row[0] is not None, row[0] or 0, row[1], row[2] or ""


def digest32(sha: bytes) -> str:
    return base64.b32encode(sha).decode()


def record(page_id, sha: bytes, url, html: bytes, response_id, revisit: bool) -> bytes:
    """Bytes of one record; block and payload digests are computed here."""
    name = "null" if page_id is None else str(page_id)
    own = uuid.uuid5(NAMESPACE, f"page:{name}:{sha.hex()}:{url}:{revisit}")
    target = "".join(c if 32 < ord(c) != 127 else f"%{ord(c):02X}" for c in url or "") or f"urn:page:{name}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if revisit else http + html
    head = (f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}\r\nWARC-Record-ID: <urn:uuid:{own}>\r\nWARC-Date: {DATE}\r\n"
            f"WARC-Target-URI: {target}\r\nContent-Type: application/http; msgtype=response\r\n"
            f"WARC-Block-Digest: sha1:{digest32(hashlib.sha1(block).digest())}\r\nWARC-Payload-Digest: sha1:{digest32(sha)}\r\n"
            f"X-Page-Id: {name}\r\nX-Payload-Length: {len(html)}\r\n")
    if revisit:
        head += f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Refers-To-Page: {'null' if response_id is None else response_id}\r\n"
    return b"".join((f"{head}Content-Length: {len(block)}\r\n\r\n".encode(), block, b"\r\n\r\n"))


class RollingWriter:
    """Writes the records of one shard to numbered files below a folder; ``rows`` holds the manifest rows."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, codec: str):
        import zstandard
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.codec = shard, roll_bytes, codec
        squeeze = zstandard.ZstdCompressor(level=1)
        self.squeeze = squeeze.compress if codec == "zst" else lambda raw: zlib.compress(raw, 6, wbits=31)
        self.number, self.rows, self.out, self.frame, self.frame_size = 0, [], None, [], 0

    def write(self, page_id, raw: bytes) -> None:
        if self.out is None:
            self._open()
        self.frame.append(raw)
        self.frame_size += len(raw)
        self.records += 1
        self.pages = (page_id if self.records == 1 else self.pages[0], page_id)
        if self.frame_size >= FRAME_BYTES:
            self._flush()
            if self.size >= self.roll:
                self.close()

    def _open(self) -> None:
        self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.{self.codec}"
        self.temporary = f"{self.path}/_temporary/{self.name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.size = self.raw = self.records = 0
        self.check = hashlib.sha256()
        info = b"software: packetloom\r\nformat: WARC File Format 1.1\r\n"
        head = (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, self.name)}>\r\nWARC-Date: {DATE}\r\n"
                f"WARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n")
        self.frame, self.frame_size = [head.encode(), info, b"\r\n\r\n"], len(head)

    def _flush(self) -> None:
        raw = b"".join(self.frame)
        done = self.squeeze(raw)
        self.out.write(done)
        self.check.update(done)
        self.size, self.raw, self.frame, self.frame_size = self.size + len(done), self.raw + len(raw), [], 0

    def close(self) -> None:
        if self.out is not None:
            if self.frame:
                self._flush()
            self.out.close()
            self.fs.move(self.temporary, f"{self.path}/{self.name}")
            self.rows.append((self.name, self.records, self.raw, self.size, *self.pages, self.check.hexdigest()))
            self.out, self.number = None, self.number + 1


def write(pages: DataFrame, folder: str, shard_bytes: int = 32 << 20, roll_bytes: int = 64 << 20, codec: str = "zst") -> DataFrame:
    """Write one record per page row below ``folder`` and return the manifest (also kept at ``folder/_manifest``).

    Of rows with equal payloads the first with the largest page id is a response and the others
    revisit it; null html is an empty payload; a null page id comes before all others and is a response
    only where no row with that payload has an id. Repeated rows are records each. A null url is named after the page.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keys = saved(rows.select("page_id", F.unhex(F.sha1("html")).alias("sha"), F.octet_length("html").cast("long").alias("n")), "pagekeys")
    weight = F.col("n") + 512
    named, unnamed = keys.agg(*[F.coalesce(F.sum(F.when(c, weight)), F.lit(0)) for c in (F.col("page_id").isNotNull(), F.col("page_id").isNull())]).first()
    ranges = balanced_ranges(keys.filter("page_id is not null").withColumn("n", weight), "page_id", "n", max(1, -(-named // shard_bytes)))
    shard, count = shard_of(ranges, -(-unnamed // shard_bytes))
    same = keys.groupBy("sha").agg(F.count("*").alias("copies"), F.max("page_id").alias("response_id")).filter("copies > 1").drop("copies")
    copies = keys.select("page_id", "sha").distinct().join(same, "sha")

    run_schema, manifest_schema = arrow_schema(RUN), arrow_schema(MANIFEST)

    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size: dict[int, int] = {}

        def flush(which: int) -> pa.RecordBatch:
            size.pop(which)
            return to_batch([(which, pack_run(held.pop(which)), None, None, None)], run_schema)

        for batch in batches:
            ids, urls, html = batch.columns
            for page_id, url, text in zip(ids.to_pylist(), urls, html):
                body = text.as_py()
                sha = hashlib.sha1(body).digest()
                to = shard(page_id, sha)
                held.setdefault(to, []).append((page_id, sha, url.as_py(), body))
                size[to] = size.get(to, 0) + len(body) + 256
                if size[to] >= RUN_BYTES:
                    yield flush(to)
                elif sum(size.values()) >= HELD_BYTES:
                    yield flush(max(size, key=size.get))
        for to in sorted(held):
            yield flush(to)

    def write_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[bytes]] = {}
        responses: dict[tuple, int | None] = {}
        for batch in batches:
            for to, run, page_id, sha, response_id in zip(*(c.to_pylist() for c in batch.columns)):
                if run is None:
                    responses[page_id, sha] = response_id
                else:
                    runs.setdefault(to, []).append(run)
        for to in sorted(runs):
            writer, last = RollingWriter(folder, to, roll_bytes, codec), None
            for page_id, sha, url, html in heapq.merge(*map(open_run, runs[to]), key=order_key):
                response_id = responses.get((page_id, sha), page_id)
                revisit = response_id != page_id or last == (page_id, sha)
                writer.write(page_id, record(page_id, sha, url, html, response_id, revisit))
                last = (page_id, sha)
            writer.close()
            if writer.rows:
                yield to_batch(writer.rows, manifest_schema)

    def place(page_id, sha, response_id):
        return [(shard(page_id, sha), None, page_id, sha, response_id)]

    runs = rows.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(to_runs, RUN)
    dealt = runs.unionByName(map_rows(copies, ["page_id", "sha", "response_id"], lambda: place, RUN)).repartitionById(count, F.col("shard"))
    dealt.mapInArrow(write_shards, MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an uncompressed stream."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().partition(":")
            headers[key.lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` of every record of the listed files.

    A response whose payload does not have the digest of its header fails the read.
    """

    def start():
        import zstandard
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)

        def number(text):
            return None if text in (None, "null") else int(text)

        def rows(file):
            with store.open_input_stream(f"{path}/{file}", compression=None) as raw:
                if file.endswith(".zst"):
                    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
                else:
                    plain = pa.CompressedInputStream(raw, "gzip")
                for head, block in records(io.BufferedReader(plain, 1 << 20)):
                    kind = head["warc-type"]
                    if kind == "warcinfo":
                        continue
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        payload = memoryview(block)[block.index(b"\r\n\r\n") + 4:]
                        if digest32(hashlib.sha1(payload).digest()) != digest or len(payload) != int(head["x-payload-length"]):
                            raise ValueError(f"{file}: payload of page {head['x-page-id']} is damaged")
                    yield number(head["x-page-id"]), int(head["x-payload-length"]), digest, kind, number(head.get("x-refers-to-page"))

        return rows

    files = max(1, manifest.count())
    return map_rows(manifest.select("file").repartition(files), ["file"], start, RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to a fresh folder of the shared scratch space and read the archives back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder, **options), folder)
