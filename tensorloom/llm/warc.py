"""WARC: a deterministic sharded writer and a reader.

Records are sorted by id into shards whose edges depend on the data alone.  An
id (or the missing one) that fills several shards by itself is dealt to shards of
its own by a hash of the payload, so equal payloads stay together.  Each shard is
one task and one sorted stream: HTTP and WARC headers and digests are made
anew, every record becomes a gzip member of its own, and a file rolls when its
compressed size reaches ``roll_bytes``.  Members reach the store through
Spark's own text sink: its task commit works on any file system and survives
lost executors.  The sink ends each value with one zero byte, which is the
last byte of every gzip member here (the high byte of a length below 2**24),
so that byte is left to the sink; longer records are followed by an empty
member.  Files appear under a temporary name, which is renamed once all are
there; the manifest, renamed last, makes the archive valid.

Defined cases: a null payload is empty; a null url is written as an empty one;
line ends in a url are percent-encoded.  Of equal payloads the record of the
smallest id is the response, a null id ranking after all others; repeated rows
of that id after the first are revisits.  A very long payload is a record like
any other.  An empty table gives an archive without files and an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, slices, staged

ROLL_BYTES = 64 << 20
#: Payload bytes of a shard at most, and shards at least (fewer bytes each then).
SHARD_BYTES, LEAST_SHARDS = 256 << 20, 64
_BUCKET_BITS = 16
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def _edges(narrow: DataFrame) -> tuple[np.ndarray, int]:
    """Smallest ids of the shards after the first, and a shard's bytes; they depend on ids and sizes only.

    Sizes are summed over buckets of the ids' high bits, 65,536 at most.  A
    bucket of more than sixteen shards' bytes is cut again by four more bits, so what
    the driver holds is bounded by those buckets plus the number of shards.
    """
    low, high, total = narrow.agg(F.min("id"), F.max("id"), F.sum("size")).first()
    want = max(1, min(SHARD_BYTES, (total or 0) // LEAST_SHARDS))
    if low is None:
        return np.zeros(0, dtype=np.int64), want
    shift = 0
    while (high >> shift) - (low >> shift) >= 1 << _BUCKET_BITS:
        shift += 1
    heavy, starts, sizes = None, [], []
    while True:
        part = narrow.where("id is not null").select(F.shiftright("id", shift).alias("bucket"), "size")
        if heavy is not None:
            part = part.join(F.broadcast(heavy), F.shiftright("bucket", step) == F.col("up"), "left_semi")
        got = part.groupBy("bucket").agg(F.sum("size").alias("size")).collect()
        big = [r.bucket for r in got if r.size > 16 * want and shift > 0]
        for r in got:
            if not (r.size > 16 * want and shift > 0):
                starts.append(r.bucket << shift)
                sizes.append(r.size)
        if not big:
            break
        step = min(4, shift)
        shift -= step
        heavy = narrow.sparkSession.createDataFrame([(b,) for b in big], "up long")
    order = np.argsort(np.asarray(starts, dtype=np.int64))
    out, held = [], 0
    for i in order:
        if held >= want:
            out.append(starts[i])
            held = 0
        held += sizes[i]
    return np.asarray(out, dtype=np.int64), want


def _heavy(narrow: DataFrame, want: int) -> dict[int | None, int]:
    """Ids with more than four shards' bytes, and how many shards each takes; no more than a shard in four has one."""
    sums = narrow.groupBy("id").agg(F.sum("size").alias("size")).where(F.col("size") > 4 * want)
    return {r.id: -(-r.size // want) for r in sums.collect()}


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(ident: int | None, digest: str, number: int, url: str | None = None) -> str:
    """The name of the ``number``-th record of a row id and a payload; where payloads aren't compared, of a url, too."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{ident}/{digest}/{number}' if url is None else f'{ident}/{digest}/{number}/{url}')}>"


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def _uri(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member that ends with a zero byte; the same bytes for the same data."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return out if out[-1] == 0 else out + _EMPTY


def record(ident: int | None, name: str, url: str | None, payload: bytes, refers: tuple[int | None, str] | None, date: str) -> bytes:
    """The bytes of a response called ``name``, or of a revisit where ``refers`` names a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Row", "" if ident is None else str(ident)), ("WARC-Payload-Digest", f"sha1:{_digest(payload)}"), ("WARC-Block-Digest", f"sha1:{_digest(block)}")]
    if refers:
        fields += [("WARC-Refers-To", refers[1]), ("WARC-Refers-To-Row", "" if refers[0] is None else str(refers[0])), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def write(pages: DataFrame, target: str | None = None, *, ident: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0, roll_bytes: int = ROLL_BYTES, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write an archive and return its path.

    Payloads of at least ``revisit_from`` bytes that repeat become revisits.
    """
    spark = pages.sparkSession
    target = target or fresh_dir(spark, "warc")
    rows = pages.select(F.col(ident).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    narrow = staged(rows.select("id", F.octet_length("html").cast("long").alias("size"), F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("sha"), F.xxhash64("html").alias("tie")), "payloads")
    edges, want = _edges(narrow)
    heavy, shards = {}, len(edges) + 1
    for ident_, n in sorted(_heavy(narrow, want).items(), key=str):
        heavy[ident_] = (shards, n)
        shards += n
    large = narrow.where(F.col("size") >= revisit_from)
    first = large.groupBy("sha").agg(F.min("id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    notes = large.join(first, "sha").select("id", "sha", "keep", "tie").distinct()

    @F.arrow_udf("int")
    def shard(ids: pa.Array, ties: pa.Array) -> pa.Array:
        none = ids.is_null().to_numpy(zero_copy_only=False)
        values = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        out = np.searchsorted(edges, values, side="right").astype(np.int32)
        for ident_, (base, n) in heavy.items():
            own = none if ident_ is None else ~none & (values == ident_)
            out[own] = base + ties.to_numpy(zero_copy_only=False)[own] % n
        return pa.array(out)

    def stream(batches):
        now = file = None
        own: dict[bytes, int | None] = {}
        seen: dict[bytes, int] = {}
        ident_now, row_now, repeat, seq, size = object(), None, 0, 0, 0
        out: list[tuple[int, int, int, bytes]] = []
        held = 0

        def flush():
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["shard", "part", "seq", "member"])

        for batch in slices(batches, "html"):
            for r in batch.to_pylist():
                if r["shard"] != now:
                    now, file, size = r["shard"], 0, -1
                if r["id"] != ident_now:
                    ident_now, own, seen = r["id"], {}, {}
                if r["html"] is None:
                    own[r["sha"]] = r["keep"]
                    continue
                payload = r["html"].encode()
                digest, refers, name = _digest(payload), None, None
                if own and len(payload) >= revisit_from and (sha := hashlib.sha256(payload).digest()) in own:
                    keep, number = own[sha], seen.get(sha, 0)
                    if keep != r["id"] or number:
                        refers = (keep, record_id(keep, digest, 0))
                    seen[sha], name = number + 1, record_id(r["id"], digest, number)
                else:  # equal rows follow each other
                    repeat = repeat + 1 if row_now == (r["id"], r["url"], digest) else 0
                    row_now = (r["id"], r["url"], digest)
                    name = record_id(r["id"], digest, repeat, r["url"] or "")
                if size >= roll_bytes:
                    file, size = file + 1, -1
                if size < 0:
                    info = f"software: tensorloom\r\nformat: WARC file version 1.1\r\nisPartOf: {now:05d}-{file:05d}\r\n".encode()
                    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'info/{now}/{file}')}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]
                    data = member(_header(fields) + info + b"\r\n\r\n")
                    out.append((now, file, seq, data))
                    seq, size = seq + 1, len(data)
                data = member(record(r["id"], name, r["url"], payload, refers, date))
                out.append((now, file, seq, data))
                seq, size, held = seq + 1, size + len(data), held + len(data)
                if held > 4 << 20:
                    yield flush()
                    out, held = [], 0
        yield flush()

    empty = F.lit(None)
    tagged = rows.select("id", F.lit(1).alias("tag"), "url", "html", empty.cast("binary").alias("sha"), empty.cast("long").alias("keep"), F.xxhash64("html").alias("tie"))
    tagged = tagged.unionByName(notes.select("id", F.lit(0).alias("tag"), empty.cast("string").alias("url"), empty.cast("string").alias("html"), "sha", "keep", "tie"))
    dealt = tagged.withColumn("shard", shard("id", "tie")).repartitionById(shards, "shard").sortWithinPartitions("shard", "id", "tag", "url", "tie").drop("tie", "tag")
    members = dealt.mapInArrow(stream, "shard int, part int, seq long, member binary").sortWithinPartitions("shard", "part", "seq")
    told = Observation()
    # All but the last byte, a zero, which the sink's line end puts back.
    value = F.substring("member", F.lit(1), F.octet_length("member") - 1).cast("string").alias("value")
    counted = members.observe(told, F.count("*").alias("members"), F.sum(F.octet_length("member")).alias("bytes"))
    data, commit = f"{target}/data", f"{target}/manifest"
    counted.select("shard", "part", value).write.partitionBy("shard", "part").option("lineSep", "\0").option("compression", "none").text(f"{data}.tmp")
    files = _listed(spark, f"{data}.tmp").select(F.regexp_extract("path", r"/(shard=[^/]*/part=[^/]*/[^/]*)$", 1).alias("name"), "length")
    files.withColumn("members", F.lit(told.get["members"])).withColumn("bytes", F.lit(told.get["bytes"] or 0)).write.parquet(f"{commit}.tmp")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in (data, commit):  # the manifest last
        if not fs.rename(hadoop(f"{name}.tmp"), hadoop(name)):
            raise OSError(f"{name} is there already")
    return target


def _listed(spark: SparkSession, data: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(data)


def _records(raw: bytes):
    """The uncompressed members of a file, one at a time."""
    view, at = memoryview(raw), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut short")
            chunk = view[at : at + (1 << 15)]
            parts.append(d.decompress(chunk))
            at += len(chunk)
        at -= len(d.unused_data)
        if data := b"".join(parts):
            yield data


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read(spark: SparkSession, target: str, *, payload: bool = True) -> DataFrame:
    """One row per response or revisit of an archive whose manifest is there.

    Digests of blocks and of stored payloads are checked; a mismatch is an
    error.
    """
    manifest = spark.read.parquet(f"{target}/manifest")
    listed = _listed(spark, f"{target}/data") if not manifest.isEmpty() else None
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    if listed is None:
        return spark.createDataFrame([], schema)
    whole = listed.join(manifest.select("name"), F.regexp_extract("path", r"/(shard=[^/]*/part=[^/]*/[^/]*)$", 1) == F.col("name"), "left_semi")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for data in _records(batch.column(0)[i].as_buffer().to_pybytes()):
                    fields, block = parse(data)
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    if fields["WARC-Block-Digest"] != f"sha1:{_digest(block)}":
                        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
                    http, _, body = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (length != len(body) or digest != _digest(body)):
                        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
                    number = {k: int(fields[k]) if fields.get(k) else None for k in ("WARC-Row", "WARC-Refers-To-Row")}
                    rows.append((number["WARC-Row"], fields["WARC-Target-URI"], length, digest, fields["WARC-Type"], number["WARC-Refers-To-Row"], body if payload else None))
                    size += len(body) if payload else 200
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    def _batch(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return whole.select("content").mapInArrow(run, schema)
