"""Deterministic sharded WARC archives, and reading them back.

Records are range-sorted by page id. The cut points come from the ids whose hash
falls into a fixed residue class, weighted by bytes, so the same pages give the
same shards on any cluster. Each task writes one shard as a stream, rolls to a new
file once the compressed size is reached, and starts every file with its own
``warcinfo`` record. Headers and digests are made anew from the payload.

Files are written under names of their task attempt. The list of files of the
attempts that succeeded is a Spark table (so a lost or repeated attempt leaves
nothing in it); a second job gives those files their final names, and the
manifest is written last. Readers open only files that the manifest lists.

Defined results: a null payload is empty; a null id sorts first; a null or odd
URL is escaped. Payloads shorter than ``MIN_REVISIT`` are always responses. Rows
that repeat the smallest id of their payload are responses as well. Columns other
than the id, URL and payload are not read.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf.llm.common import attach, read_table
from reelshelf.session import materialise, scratch_dir

MIN_REVISIT = 100
SHARD_BYTES = 64 << 20  # payload of one shard, one task
ROLL_BYTES = 16 << 20  # compressed size at which a file is closed
SAMPLES_PER_SHARD = 32  # ids looked at for each cut point
DATE = "2024-01-01T00:00:00Z"

FILES = "shard int, part int, temporary string, name string, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payloads(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, payload) with the payload as UTF-8 bytes."""
    return pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))


def revisits(sums: DataFrame) -> DataFrame:
    """Pages that repeat an earlier payload: (page_id, digest, refers_to)."""
    large = sums.where(F.col("size") >= MIN_REVISIT)
    groups = materialise(
        large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n_rows")),
        "payload-groups",
    )
    found = attach(large.select("page_id", "digest"), groups.where("n_rows > 1"), "digest")
    return found.where(F.col("page_id") > F.col("refers_to")).select("page_id", "digest", "refers_to")


def cut_points(sums: DataFrame, shard_bytes: int) -> list[int]:
    """First page id of every shard but the first, the same for the same pages."""
    rows, size = sums.agg(F.count("page_id"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = -(-size // shard_bytes)
    if shards < 2 or not rows:
        return []
    stride = max(1, rows // (SAMPLES_PER_SHARD * shards))
    looked_at = sums.where(F.pmod(F.xxhash64("page_id"), F.lit(stride)) == 0).where("page_id IS NOT NULL")
    seen = sorted(looked_at.select("page_id", "size").collect())
    weight = np.cumsum([size for _, size in seen])
    if not len(weight) or not weight[-1]:
        return []
    at = np.searchsorted(weight, weight[-1] * np.arange(1, shards) / shards)
    return sorted({seen[i][0] for i in at})


def _shard_of(cuts: list[int]):
    bounds = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def shard(page_id: pd.Series) -> pd.Series:
        known = page_id.notna().to_numpy()
        ids = page_id.fillna(0).to_numpy(dtype=np.int64)
        return pd.Series(np.where(known, np.searchsorted(bounds, ids, side="right"), 0).astype(np.int32))

    return shard


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(path)


def record_uri(page_id: int | None, repeat: int = 1) -> str:
    name = "none" if page_id is None else page_id
    return f"urn:page:{name}" + (f":{repeat}" if repeat > 1 else "")


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member, without time stamps."""
    fields = [*fields, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, repeat: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = record_uri(page_id, repeat)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{uri}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe="%:/?#[]@!$&'()*+,;=~") if url else uri),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Refers-To", f"<{record_uri(refers_to)}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    return warc_record(fields, block)


class _ShardWriter:
    """Writes the records of one shard to files of bounded compressed size."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.shard, self.roll_bytes, self.part = shard, roll_bytes, 0
        self.files, self.base = filesystem(folder)
        self.attempt = f"{folder}/_temporary/{uuid.uuid4().hex}"
        self.out, self.done = None, []
        self.files.create_dir(posixpath.join(self.base, "_temporary", posixpath.basename(self.attempt)))

    def add(self, record: bytes) -> None:
        if self.out is None:
            self._open()
        self._put(record)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def _open(self) -> None:
        self.name = f"pages-{self.shard:06d}-{self.part:05d}.warc.gz"
        self.temporary = f"{self.attempt}/{self.name}"
        self.out = self.files.open_output_stream(filesystem(self.temporary)[1], compression=None)
        self.size, self.records, self.sum = 0, 0, hashlib.sha256()
        info = f"software: reelshelf\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {self.shard}\r\n".encode()
        self._put(
            warc_record(
                [
                    ("WARC-Type", "warcinfo"),
                    ("WARC-Record-ID", f"<urn:file:{self.name}>"),
                    ("WARC-Date", DATE),
                    ("WARC-Filename", self.name),
                    ("WARC-Block-Digest", f"sha256:{hashlib.sha256(info).hexdigest()}"),
                    ("Content-Type", "application/warc-fields"),
                ],
                info,
            )
        )

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append(
                (self.shard, self.part, self.temporary, self.name, self.records, self.size, self.sum.hexdigest())
            )
            self.out, self.part = None, self.part + 1


def _file_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in FILES.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _write(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, page, repeat, refers = None, (), 0, {}
        done: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "page_id", "kind", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                shard, page_id, kind, url, payload, digest, refers_to = (c[i].as_py() for c in columns)
                if writer is None or writer.shard != shard:
                    if writer:
                        writer.close()
                        done += writer.done
                    writer, page = _ShardWriter(folder, shard, roll_bytes), ()
                if page != (page_id,):
                    page, repeat, refers = (page_id,), 0, {}
                if kind == 0:  # the mark of a revisit comes before its page
                    refers[digest] = refers_to
                    continue
                repeat += 1
                mark = refers.get(hashlib.sha256(payload).digest()) if refers else None
                writer.add(page_record(page_id, repeat, url, payload, mark))
        if writer:
            writer.close()
            done += writer.done
        if done:
            yield _file_rows(done)

    return run


def _rename(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = filesystem(row["temporary"])[1], posixpath.join(base, row["name"])
                # A repeated task finds its files in place already.
                if files.get_file_info(source).type == fs.FileType.File:
                    files.move(source, target)
                elif files.get_file_info(target).size != row["bytes"]:
                    raise FileNotFoundError(row["name"])
            yield batch

    return run


def write_archive(
    pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files below ``folder``; returns the manifest.

    Every executor must reach ``folder``, a URI that Arrow's file systems know.
    """
    spark = pages.sparkSession
    content = payloads(pages)
    sums = materialise(
        content.select(
            "page_id", F.length("payload").cast("long").alias("size"), F.unhex(F.sha2("payload", 256)).alias("digest")
        ),
        "payload-sums",
    )
    cuts = cut_points(sums, shard_bytes)
    marks = revisits(sums).select(
        "page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("binary").alias("payload"), "digest", "refers_to",
    )
    records = content.select(
        "page_id", F.lit(1).alias("kind"), "url", "payload",
        F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("refers_to"),
    )
    # Marks travel to the shards by themselves, so that payloads are shuffled once.
    dealt = (
        marks.unionByName(records)
        .withColumn("shard", _shard_of(cuts)("page_id"))
        .repartitionById(len(cuts) + 1, "shard")
        .sortWithinPartitions("shard", "page_id", "kind", "url", "payload")
    )
    written = f"{folder}/_written"
    dealt.mapInArrow(_write(folder, roll_bytes), FILES).write.parquet(written)
    listed = spark.read.schema(FILES).parquet(written)
    listed.mapInArrow(_rename(folder), FILES).drop("temporary").write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def members(source, block: int = 1 << 20) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, one at a time."""
    unpacker, parts = zlib.decompressobj(31), []
    while data := source.read(block):
        while data:
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page_of(uri: str) -> int | None:
    name = uri.strip("<>").split(":")[2]
    return None if name == "none" else int(name)


def page_row(record: bytes) -> tuple | None:
    """Digest row of a response or revisit record, after its digests have been checked."""
    fields, block = parse_record(record)
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    kind = fields["WARC-Type"]
    if kind == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and digest != hashlib.sha256(payload).hexdigest():
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    length = int(http.decode().rsplit("Content-Length: ", 1)[1])
    refers_to = _page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return _page_of(fields["WARC-Record-ID"]), length, digest, kind, refers_to


def _read(folder: str):
    kinds = pa.schema(
        [
            ("page_id", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
        ]
    )

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        for listed in batches:
            for name in listed.column("name").to_pylist():
                rows: list[tuple] = []
                with files.open_input_stream(posixpath.join(base, name), compression=None) as source:
                    for record in members(source):
                        if row := page_row(record):
                            rows.append(row)
                        if len(rows) == 5000:
                            yield batch(rows)
                            rows = []
                yield batch(rows)

    return run


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Digest rows of every page record in the files that the manifest lists."""
    listed = spark.read.parquet(f"{folder}/_manifest").select("name", "shard", "part")
    dealt = listed.repartition(max(1, spark.sparkContext.defaultParallelism), "shard", "part")
    return dealt.mapInArrow(_read(folder), RECORDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/reelshelf/warc-{uuid.uuid4().hex}"
    write_archive(read_table(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder)


OP9_SQL = """
WITH sums AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM sums
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM firsts
"""
