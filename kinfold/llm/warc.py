"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id.  The split points come from ids chosen by their hashes, so they depend on
the rows alone; there is a shard for every ``shard_bytes`` of payload, however many that makes.  A shard is written by one task, which rolls to
a new file when the compressed size of the current one reaches ``roll_bytes``.  Headers and digests are made anew from the payload.
Every record is a gzip member of its own with no time stamp, so the same rows give the same bytes.

Commit.  Tasks write under a temporary folder of their own attempt, in a folder of the run.  What the attempts that count have written is
listed in a table.  From its names and digests the run gets its name, so the same rows have the same one.  Tasks move the files to
``<out>/<run>/``, each of which succeeds when repeated; the listing is written as the run's manifest table; last, the pointer ``manifest.json``
that names the run is replaced in one step.  Readers only follow the pointer, so an archive is the old one or the new one, and a crash at any
place is mended by running again.  The run that the pointer named before is then removed, as are the run's temporary files and nobody else's.
Nothing grows on the driver but ``SPLIT_SAMPLE`` ids a shard (at 100 TB 1.6 million shards and 200 MB).

``out`` must be a URI that both Spark and Arrow's file systems open; ``s3a`` is passed to the latter as ``s3``.

Of records with equal payloads of at least ``least`` bytes, that with the largest id is the response and the others are
revisits of it.  Copies are found on (digest, length) with map-side combine; payloads of one digest never meet in a task.

Defined results: a null payload is empty; a null id sorts first and isn't named in the record; a null id is never referred to, so copies
that only have null ids are all responses; rows that share the largest id of their payload are all responses; a null url
becomes ``urn:page:<id>``; a very long payload is one record, held by one task; an empty table gives an archive of no files; further
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, exists, remove

LEAST = 1000
ROLL_BYTES = 1 << 28
SHARD_BYTES = 1 << 26
#: Ids for each shard that the split points are taken from, in expectation.
SPLIT_SAMPLE = 16
#: Files that a task reads at least, once there are more files than these tasks.
READ_TASKS = 20_000
POINTER, MANIFEST = "manifest.json", "manifest.parquet"
LEVEL = 6
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = "shard int, part int, name string, temporary string, n_records long, n_bytes long, sha256 string"
_MANIFEST = _FILES.replace("temporary string, ", "")
_RECORDS = "file string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _line(text: str) -> str:
    """Header values can't hold control characters."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, ordinal: int) -> bytes:
    """One record, uncompressed, with regenerated headers and digests."""
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}:{ordinal}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url) if url is not None else f"urn:page:{page_id}"),
        ("WARC-Payload-Digest", _b32(digest)),
        ("WARC-Block-Digest", _b32(hashlib.sha1(block).digest())),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}:0>"), ("X-Refers-To-Page-Id", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    block = b"software: kinfold\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3:" + uri.removeprefix("s3a:") if uri.startswith("s3a:") else uri)


def _writer(out: str, run: str, roll_bytes: int, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = base = attempt = stream = None
        shard, part, files, same, last_id = None, 0, [], 0, object()

        def close() -> None:
            if stream is not None:
                stream.close()
                files[-1]["sha256"] = files[-1]["sha256"].hexdigest()

        def put(data: bytes) -> None:
            packed = _member(data, level)
            stream.write(packed)
            files[-1]["n_bytes"] += len(packed)
            files[-1]["sha256"].update(packed)

        for b in batches:
            if store is None:
                store, base = _store(out)
                attempt = f"_temporary/{run}/{uuid.uuid4().hex}"
                store.create_dir(f"{base}/{attempt}", recursive=True)
            columns = [b.column(i) for i in range(b.num_columns)]
            for row in zip(*columns, strict=True):
                s, page_id, url, payload, refers_to = (x.as_py() for x in row)
                if s != shard or files[-1]["n_bytes"] >= roll_bytes:
                    close()
                    shard, part = s, part + 1 if s == shard else 0
                    name = f"shard-{shard:05d}-{part:05d}.warc.gz"
                    files.append({"shard": shard, "part": part, "name": name, "temporary": f"{attempt}/{name}", "n_records": 0, "n_bytes": 0, "sha256": hashlib.sha256()})
                    stream = store.open_output_stream(f"{base}/{attempt}/{name}", compression=None)
                    put(_info(name))
                same, last_id = same + 1 if page_id == last_id else 0, page_id
                put(record(page_id, url, payload, refers_to, same))
                files[-1]["n_records"] += 1
        close()
        if files:
            yield pa.RecordBatch.from_pylist(files, schema=pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())]))

    return write


def _shards(splits: np.ndarray) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """How many split points lie at or below an id."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.searchsorted(splits, s.to_numpy(np.int64), side="right").astype(np.int32))

    return run


def _mover(out: str, run: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Moves files to their names in the run; what was moved before, by this or another attempt or run, is left."""
    from pyarrow import fs

    gone = fs.FileType.NotFound

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            store, base = _store(out)
            store.create_dir(f"{base}/{run}", recursive=True)
            for name, temporary in zip(b.column("name").to_pylist(), b.column("temporary").to_pylist(), strict=True):
                there, source = f"{base}/{run}/{name}", f"{base}/{temporary}"
                if store.get_file_info(there).type == gone:
                    try:
                        store.move(source, there)
                    except OSError:
                        if store.get_file_info(there).type == gone:
                            raise
            yield b.select(["name"])

    return move


def write_archives(
    pages: DataFrame, out: str, id_col: str = "page_id", url: str = "url", payload: str = "html",
    least: int = LEAST, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, level: int = LEVEL,
) -> dict:
    """Write ``pages`` as WARC files under the URI ``out``, in place of what is there, and return the pointer: run, n_files, n_records, n_bytes."""
    spark = pages.sparkSession
    d = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("payload"))
    d = d.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("n", F.octet_length("payload").cast("long"))
    narrow, at = cut(d.select("id", "digest", "n"), "payloads")
    copies = narrow.where((F.col("n") >= least) & F.col("id").isNotNull()).groupBy("digest", "n").agg(F.max("id").alias("last"), F.min("id").alias("first"))
    copies = copies.where(F.col("first") < F.col("last")).select("digest", "n", "last")
    # Rows with a null id refer to the others, so a payload with one named row and unnamed ones counts as copied too.
    unnamed = narrow.where((F.col("n") >= least) & F.col("id").isNull()).select("digest", "n").distinct()
    alone = narrow.where((F.col("n") >= least) & F.col("id").isNotNull()).join(unnamed, ["digest", "n"], "left_semi").groupBy("digest", "n").agg(F.max("id").alias("last"))
    # Written, so that the planner knows its size: payloads only move by digest where it is too large to broadcast.
    rows = narrow.count()
    copies, copied = cut(copies.unionByName(alone).distinct(), "copies", rows)
    total = narrow.agg(F.sum("n") + F.count("n") * 512).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    splits = np.zeros(0, np.int64)
    if shards > 1:
        share = SPLIT_SAMPLE * shards / max(1, rows)
        u = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
        sample = np.sort(narrow.where(F.col("id").isNotNull() & (u < share)).select("id").distinct().toPandas()["id"].to_numpy(np.int64))
        splits = np.unique(sample[len(sample) * np.arange(1, shards) // shards]) if len(sample) else splits
    d = d.join(copies, ["digest", "n"], "left")
    refers = F.when(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    shard = F.pandas_udf(_shards(splits), "int")(F.coalesce("id", F.lit(-(1 << 63)))) if len(splits) else F.lit(0)  # type: ignore[call-overload]
    d = d.select(shard.alias("shard"), "id", "url", "payload", refers.alias("refers_to"))
    d = d.repartitionById(len(splits) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "refers_to", "url", "payload")
    d = d.select("shard", "id", "url", F.col("payload").cast("binary").alias("payload"), "refers_to")
    work = uuid.uuid4().hex
    written, listing = cut(d.mapInArrow(_writer(out, work, roll_bytes, level), _FILES), "archive-files")
    pointer = _commit(spark, out, written)
    remove(spark, f"{out}/_temporary/{work}", at, listing, copied)
    everyone = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_temporary")
    fs = everyone.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(everyone) and not len(fs.listStatus(everyone)):
        fs.delete(everyone, False)
    return pointer


def _commit(spark: SparkSession, out: str, files: DataFrame) -> dict:
    n, n_records, n_bytes, digest = files.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("n_records"), F.lit(0)), F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("name", "sha256")), F.lit(0))
    ).first()
    pointer = {"run": f"run-{digest & (1 << 64) - 1:016x}-{n}", "n_files": n, "n_records": n_records, "n_bytes": n_bytes}
    before = _pointer(spark, out)
    if n:
        files.select("name", "temporary").repartition(max(1, min(n, READ_TASKS))).mapInArrow(_mover(out, pointer["run"]), "name string").write.format("noop").mode("overwrite").save()
    files.drop("temporary").orderBy("shard", "part").write.mode("overwrite").parquet(f"{out}/{pointer['run']}/{MANIFEST}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    temporary, final = path(f"{out}/_{POINTER}.{uuid.uuid4().hex}"), path(f"{out}/{POINTER}")
    stream = final.getFileSystem(conf).create(temporary, True)
    stream.write(bytearray(json.dumps(pointer, sort_keys=True).encode()))
    stream.close()
    # The one rename that replaces: after it the new archive is the archive.
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(temporary, final, options)
    if before and before["run"] != pointer["run"]:
        remove(spark, f"{out}/{before['run']}")
    return pointer


def _pointer(spark: SparkSession, out: str) -> dict | None:
    if not exists(spark, f"{out}/{POINTER}"):
        return None
    return json.loads(spark.read.text(f"{out}/{POINTER}", wholetext=True).first()[0])


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream; checks block digests."""
    while line := stream.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            head[k.strip()] = v.strip()
        block = stream.read(int(head["Content-Length"]))
        want = head.get("WARC-Block-Digest")
        if len(block) != int(head["Content-Length"]) or want and want != _b32(hashlib.sha1(block).digest()):
            raise ValueError(f"damaged record {head.get('WARC-Record-ID')}")
        yield head, block


def _reader(out: str, rows: int = 2000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        schema = pa.schema([("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for name in b.column("name").to_pylist():
                store, base = _store(out)
                got = []
                with store.open_input_stream(f"{base}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as unpacked:
                    for head, block in parse(io.BufferedReader(unpacked, 1 << 20)):
                        kind = head["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:"))
                        size = int(head["X-Payload-Length"])
                        if kind == "response":
                            body = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha1(body).digest() != digest or len(body) != size:
                                raise ValueError(f"damaged payload {head['WARC-Record-ID']}")
                        page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
                        got.append({"file": name, "page_id": page and int(page), "url": head["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest.hex(), "record_type": kind, "refers_to": refers and int(refers)})
                        if len(got) >= rows:
                            yield pa.RecordBatch.from_pylist(got, schema=schema)
                            got = []
                yield pa.RecordBatch.from_pylist(got, schema=schema)

    return read


def manifest(spark: SparkSession, out: str) -> tuple[dict, DataFrame]:
    """The pointer of the committed archive and its files."""
    pointer = _pointer(spark, out)
    if pointer is None:
        raise FileNotFoundError(f"no archive was committed to {out}")
    return pointer, spark.read.schema(_MANIFEST).parquet(f"{out}/{pointer['run']}/{MANIFEST}")


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """One row per record of the files that the manifest lists, checked against their digests."""
    pointer, files = manifest(spark, out)
    return files.select("name").repartition(max(1, min(pointer["n_files"], READ_TASKS))).mapInArrow(_reader(f"{out}/{pointer['run']}"), _RECORDS)
