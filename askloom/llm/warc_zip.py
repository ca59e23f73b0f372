"""ZIP-packaged web archives (op 3): writing, and reading by range without extraction.

A package is a ZIP file whose members are stored, not compressed: `archive/data.warc.gz`, a row of gzip members with
one WARC record each, and `indexes/index.cdxj`, a line per record with its offset and length in the archive member.
The reader finds the end record and, where it is there, the ZIP64 one, walks the central directory, locates the
stored members by their local headers, reads the index, and fetches runs of records by range in separate tasks.
Packages are written in the shared folder through the file system its address names; a package counts only if the
manifest lists it, so a task that ran twice leaves at most a file nobody reads.

A null page is an empty payload, which is a payload like any other. Of rows with equal payloads, those with the
smallest page_id are responses and the others revisits; repeated rows stay separate records. Rows without page_id are
responses. An empty table gives no package and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.common import cut, shared_dir, table

PACKAGE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
DATE = "2020-01-01T00:00:00Z"
# fixed values: signatures and fixed parts of the public ZIP format
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
TOP16, TOP32 = 0xFFFF, 0xFFFFFFFF


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{of}')}>"


def to_record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> tuple[bytes, dict]:
    """A WARC record and its index entry; first: the page whose record holds the payload, if not this one."""
    of, kind = digest(payload), "response" if first is None else "revisit"
    target = quote(url or "urn:none", safe="%/:=&?~#+!$,;'@()*[]")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if first is None else http
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id(page_id, of), "WARC-Date": DATE, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{of}"}
    if first is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(first, of), "X-Refers-To-Page": first}
    if page_id is not None:
        head["X-Page"] = page_id
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", {"url": target, "digest": f"sha1:{of}", "mime": "text/html" if first is None else "warc/revisit"}


def from_record(raw: bytes) -> dict:
    """The fields of a WARC record as written by to_record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (digest(payload) != stated or len(payload) != size):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is not what its digest says")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page"), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": stated, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "payload": payload}


def write_package(folder: str, records: Iterator[tuple[bytes, dict]]) -> Iterator[tuple[str, int]]:
    """Packages of about PACKAGE_BYTES of the records; their addresses and numbers of records."""
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    record = next(records, None)
    while record is not None:
        name, index, size = f"{uuid.uuid4().hex}.zip", [], 0
        with store.open_output_stream(f"{at}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            with package.open("archive/data.warc.gz", "w", force_zip64=True) as member:
                while record is not None and size < PACKAGE_BYTES:
                    packed = gzip.compress(record[0], 6, mtime=0)
                    member.write(packed)
                    index.append(f"{record[1]['url']} {DATE} {json.dumps(record[1] | {'filename': 'data.warc.gz', 'offset': size, 'length': len(packed)})}\n")
                    size += len(packed)
                    record = next(records, None)
            with package.open("indexes/index.cdxj", "w", force_zip64=True) as member:
                for line in index:
                    member.write(line.encode())
        yield f"{folder}/{name}", len(index)


def directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP file by name: method, offset of the local header, stored size."""
    tail = min(size, 22 + TOP16 + 20)
    file.seek(size - tail)
    end = file.read(tail)
    k = end.rfind(END)
    if k < 0:
        raise ValueError("no end record: not a ZIP file")
    count, length, start = struct.unpack("<HII", end[k + 10 : k + 20])
    if k >= 20 and end[k - 20 : k - 16] == LOCATOR64:
        (at,) = struct.unpack("<Q", end[k - 12 : k - 4])
        file.seek(at)
        wide = file.read(56)
        if wide[:4] != END64:
            raise ValueError("the ZIP64 locator leads nowhere")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    file.seek(start)
    held, members, at = file.read(length), {}, 0
    for _ in range(count):
        if held[at : at + 4] != ENTRY:
            raise ValueError("the central directory is broken")
        method, packed, full, n, m, o, local = struct.unpack("<10xH8xIIHHH8xI", held[at : at + 46])
        name, extra = held[at + 46 : at + 46 + n], held[at + 46 + n : at + 46 + n + m]
        while len(extra) >= 4:
            kind, own = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = list(struct.unpack(f"<{own // 8}Q", extra[4 : 4 + own // 8 * 8]))
                full = wide.pop(0) if full == TOP32 else full
                packed = wide.pop(0) if packed == TOP32 else packed
                local = wide.pop(0) if local == TOP32 else local
            extra = extra[4 + own :]
        members[name.decode()] = (method, local, packed)
        at += 46 + n + m + o
    return members


def member_start(file, local: int) -> int:
    """Where a member's bytes begin, by its local header."""
    file.seek(local)
    head = file.read(30)
    if head[:4] != LOCAL:
        raise ValueError("no local header where the directory says")
    n, m = struct.unpack("<HH", head[26:30])
    return local + 30 + n + m


def ranges(address: str) -> Iterator[tuple[str, int, list[int]]]:
    """Runs of records of a package: address, first byte, lengths of the records, about RANGE_BYTES together. Every index
    entry names its archive member by its file name; it may leave that out where the package has a single one."""
    store, at = fs.FileSystem.from_uri(address)
    with store.open_input_file(at) as file:
        members = directory(file, file.size())
        archives = {x.rsplit("/", 1)[-1]: x for x in members if x.endswith(".warc.gz")}
        bases: dict[str, int] = {}
        for index in (x for x in members if x.endswith(".cdxj")):
            method, local, size = members[index]
            if method:
                raise ValueError("only stored members can be read by range")
            file.seek(member_start(file, local))
            name, start, run, held = "", 0, [], 0
            for line in file.read(size).splitlines():
                entry = json.loads(line.split(b" ", 2)[2])
                own = entry.get("filename", "").rsplit("/", 1)[-1]
                if own not in archives:
                    if own or len(archives) != 1:
                        raise ValueError(f"no archive member for an index entry of {index}")
                    own = next(iter(archives))
                if own not in bases:
                    if members[archives[own]][0]:
                        raise ValueError("only stored members can be read by range")
                    place = file.tell()
                    bases[own] = member_start(file, members[archives[own]][1])
                    file.seek(place)
                if run and (own != name or held + entry["length"] > RANGE_BYTES or entry["offset"] != start + held):
                    yield address, bases[name] + start, run
                    run, held = [], 0
                if not run:
                    name, start = own, entry["offset"]
                run.append(entry["length"])
                held += entry["length"]
            if run:
                yield address, bases[name] + start, run


def read_run(address: str, start: int, lengths: list[int]) -> Iterator[dict]:
    store, at = fs.FileSystem.from_uri(address)
    with store.open_input_file(at) as file:
        held = file.read_at(sum(lengths), start)
    k = 0
    for n in lengths:
        yield from_record(zlib.decompress(held[k : k + n], 31))
        k += n


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record per row into packages in the folder; the manifest: path and n_records of each package."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    marks = own.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n"))
    firsts = marks.groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    revisits = marks.join(firsts, ["sha", "n"]).where("page_id > first").select("page_id", "sha", "first").distinct()
    tagged = own.withColumn("sha", F.sha1("payload")).join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (to_record(*(c[i].as_py() for c in batch.columns)) for batch in batches for i in range(batch.num_rows))
        for path, n in write_package(folder, records):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

    return cut(tagged.mapInArrow(run, "path string, n_records long"))


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the packages that manifest lists in `path`, read by range in tasks of their own."""
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    names = [x.split()[0] for x in kind.split(", ")]
    runs_kind = "path string, start long, lengths array<long>"

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for x in ranges(path):
                    yield pa.RecordBatch.from_arrays([pa.array([x[0]]), pa.array([x[1]], pa.int64()), pa.array([x[2]], pa.list_(pa.int64()))], ["path", "start", "lengths"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                found = list(read_run(row["path"], row["start"], row["lengths"]))
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], t) for n, t in zip(names, types, strict=False)], names)

    tasks = max(2, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = manifest.select("path").repartition(tasks, "path").mapInArrow(locate, runs_kind)
    return runs.repartition(tasks, "path", "start").mapInArrow(fetch, kind)


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
    WITH d AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
    v AS (
      SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first, list_transform(range(8), lambda g: list_reduce(
        list_transform(range(5), lambda j: strpos('0123456789abcdef', x[(5 * g + j + 1)::INT]) - 1), lambda a, b: 16 * a + b)) AS v FROM d)
    SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((v[(k // 4 + 1)::INT] >> (15 - 5 * (k % 4))) & 31))::INT, 1)), '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM v"""
