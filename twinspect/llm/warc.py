"""WARC archives of pages, and their two-level capture index.

Writing: every page is one WARC/1.1 record. Of pages with equal payloads (SHA-1, least_bytes or more) the one with the smallest
page_id is a response, the others are revisits without payload that refer to it. A record is a gzip member, its closing blank
lines another one, which is the same for all records: so Spark's own text writer, told to end lines with that member, writes
the archives, and commits them as it commits all files.

Index: every capture's key is its URL with the host's labels reversed, its time and its record's id. Keys are sorted by range
partitions; a partition's lines are cut into compressed blocks of BLOCK_LINES in one file, and the directory keeps the first
key of each block with the place of the block. A lookup finds its partition by binary search over the partitions' first keys
(one a partition, broadcast), its block by binary search over that partition's part of the directory, reads this range of the
file, finds its lines by binary search, and then reads only the ranges of the archives that these name. Lookups go in key order, so
that a block is read once, and reads go in the order of the archives.

Blocks and records are read by range through Arrow's file systems (local, HDFS and object stores), at the places that Spark wrote.
Nothing grows on the driver but one key a partition.

Defined cases: a null html is an empty payload; equal page_ids part by URL, and of equal rows one is the response; a missing
page_id comes after all others, and is left out of the record; a missing URL is urn:twinspect:none; control characters and
spaces of URLs are percent-encoded; an empty table gives no records; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspect.llm.common import heavy_from, join_heavy
from twinspect.session import checkpoint_dir, cut, load, remove_folder

LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
BLOCK_LINES = 1000
LEVEL = 4
WINDOW = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
NO_URL = "urn:twinspect:none"


# ---- gzip members, keys, records


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


ENDING = member(b"\r\n\r\n")  # of a record
NOTHING = member(b"")  # after a block of the index


def unpacked(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the member at `at`, and where it ends."""
    z, out = zlib.decompressobj(31), []
    while not z.eof:
        part = data[at : at + WINDOW]
        if not len(part):
            raise ValueError(f"a member ends early, at {at}")
        out.append(z.decompress(part))
        at += len(part)
    return b"".join(out), at - len(z.unused_data)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def safe_url(url: str | None) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else NO_URL


_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)")


def url_key(url: str) -> str:
    """The URL by its host's labels from the last to the first, without scheme, user and fragment: com,example,www)/path?query."""
    found = _URL.match(url)
    if not found:
        return url
    host, port, rest = found.groups()
    port = "" if port in (None, ":80", ":443") else port
    return ",".join(reversed(host.lower().split("."))) + port + ")" + (rest or "/")


def capture_key(url: str, date: str, record_id: str) -> str:
    return f"{url_key(url)} {re.sub('[^0-9]', '', date)} {record_id}"


def record_id(page_id: int | None, url: str, digest: str, kind: str, copy: int) -> str:
    name = f"{page_id}\n{url}\n{digest}\n{kind}\n{copy}".encode()
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(name).digest(), version=3)}>"


def record(kind: str, own_id: str, page_id: int | None, url: str, date: str, digest: str, payload: bytes, refers: tuple[str, str, str] | None) -> bytes:
    """A whole record but for its closing blank lines. refers: id, URL and date of the response that a revisit refers to."""
    block = HTTP % len(payload) + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own_id}", f"WARC-Target-URI: {url}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"Twinspect-Page-ID: {page_id}")
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers[0]}", f"WARC-Refers-To-Target-URI: {refers[1]}", f"WARC-Refers-To-Date: {refers[2]}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, payload) of a record; a revisit's payload is empty."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    if len(block) != int(fields["content-length"]):
        raise ValueError("a record of another length than it says")
    return fields, block.partition(b"\r\n\r\n")[2]


# ---- writing


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


def _write(rows: DataFrame, ending: bytes, folder: str) -> None:
    """Column value (binary) of rows, each followed by `ending`, as files of the rows' partitions."""
    rows.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", ending.decode("latin-1")).text(folder)


def _kinds(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Rows of pages (page_id, url, payload, digest) with `of`, the page that a revisit refers to, null for responses."""
    me = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("id"), F.col("url").alias("url"))
    rows = pages.select("page_id", "url", "payload", "digest", me.alias("me"))
    large = rows.where(F.octet_length("payload") >= least_bytes)
    each = large.groupBy("digest", "me").agg(F.count("*").alias("n"))
    seen = cut(each.groupBy("digest").agg(F.sum("n").alias("many"), F.min(F.struct("me", "n")).alias("first")).where("many > 1"))
    total = seen.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    heavy = F.col("many") >= heavy_from(total)
    marked = join_heavy(rows, seen, "digest", heavy, ["me"], inner=False)
    leads = F.col("first.me") == F.col("me")
    out = marked.select("page_id", "url", "payload", "digest", F.when(~leads, F.col("first.me")).alias("of"), F.lit(0).cast("long").alias("copy"), (leads & (F.col("first.n") > 1)).alias("same"))
    twice = seen.where("first.n > 1")
    if twice.isEmpty():
        return out.drop("same")
    # Equal rows lead together: one stays a response, the others become revisits of it.
    equal = cut(join_heavy(large.drop("payload"), twice, "digest", heavy, ["me"]).where(leads).select("page_id", "url", "digest", "me", F.monotonically_increasing_id().alias("copy")))
    one = equal.groupBy("digest").agg(F.min("copy").alias("low"), F.count("*").alias("many"))
    rest = join_heavy(equal, cut(one), "digest", heavy, ["copy"]).where("copy > low").select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "digest", F.col("me").alias("of"), "copy")
    first = out.where("same").groupBy("digest").agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("payload").alias("payload"))
    first = first.select("page_id", "url", "payload", "digest", F.lit(None).cast(out.schema["of"].dataType).alias("of"), F.lit(0).cast("long").alias("copy"))
    return out.where("same IS NULL OR NOT same").drop("same").unionByName(rest).unionByName(first)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """WARC records of pages (page_id, url, html) as files below folder, which must not exist."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))

    def run(batches):
        for batch in batches:
            out = []
            for page_id, url, payload, digest, of, copy in zip(*(batch.column(k) for k in range(6))):
                page_id, url, of, copy = page_id.as_py(), safe_url(url.as_py()), of.as_py(), copy.as_py()
                digest, refers = base32(bytes.fromhex(digest.as_py())), None
                if of is not None:
                    first = safe_url(of["url"])
                    refers = record_id(of["id"], first, digest, "response", 0), first, date
                kind = "revisit" if refers else "response"
                out.append((member(record(kind, record_id(page_id, url, digest, kind, copy), page_id, url, date, digest, payload.as_py() or b"", refers)),))
            yield _batch(out, [("value", pa.binary())])

    _write(_kinds(rows, least_bytes).select("page_id", "url", "payload", "digest", "of", "copy").mapInArrow(run, "value binary"), ENDING, folder)


# ---- reading


RECORD = [
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("capture", pa.string()),
    ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("sound", pa.bool_()),
]
_RECORD = "file string, offset long, length long, record_type string, page_id long, capture string, refers_to string, payload_bytes long, payload_digest string, sound boolean"


def described(file: str, offset: int, length: int, data: bytes) -> tuple:
    """A record as a row of RECORD. refers_to is a capture's key; sound: the payload has the digest that the record names, true of revisits."""
    fields, payload = parsed(data)
    kind, named = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    refers = None
    if kind == "revisit":
        refers = capture_key(fields["warc-refers-to-target-uri"], fields["warc-refers-to-date"], fields["warc-refers-to"])
    sound = kind == "revisit" or base32(hashlib.sha1(payload).digest()) == named
    page = fields.get("twinspect-page-id")
    key = capture_key(fields["warc-target-uri"], fields["warc-date"], fields["warc-record-id"])
    return file, offset, length, kind, None if page is None else int(page), key, refers, len(payload), named, sound


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row (RECORD) for every record of the archives below folder; an archive is read whole, by one task."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, at, out = memoryview(content.as_buffer()), 0, []
                while at < len(data):
                    start = at
                    body, at = unpacked(data, at)
                    end, at = unpacked(data, at)
                    if end != b"\r\n\r\n":
                        raise ValueError(f"a record without its end in {path} at {start}")
                    out.append(described(path, start, at - start, body))
                    if len(out) == 1000:
                        yield _batch(out, RECORD)
                        out = []
                yield _batch(out, RECORD)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, _RECORD)


def opened(path: str):
    """A file for random access, wherever it is; Spark names local files file:/..."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path.removeprefix("file:").replace("//", "", 1) if path.startswith("file://") else path.removeprefix("file:"))
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


class Ranges:
    """Reads ranges of files; the last file stays open."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            self.path, self.file = path, opened(path)
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError(f"{path} ends before {offset + length}")
        return data


# ---- the index


@dataclass
class CaptureIndex:
    """directory: part, block, first (its first key), file, offset, length of each block; lows: (first key, part), sorted."""

    directory: DataFrame
    lows: list[tuple[str, int]]


def build_index(records: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """The index of records (capture, file, offset, length), its blocks as files below folder, which must not exist."""
    spark = records.sparkSession
    lines = cut(records.select("capture", "file", "offset", "length").repartitionByRange("capture", "file", "offset").sortWithinPartitions("capture", "file", "offset"))

    def run(batches):
        held, at, k = [], 0, 0

        def block():
            data = member("\n".join(held).encode())
            return held[0].split("\t")[0], k, at, len(data), data

        schema = [("first", pa.string()), ("block", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("value", pa.binary())]
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append("\t".join(map(str, row)))
                if len(held) == block_lines:
                    out.append(block())
                    held, at, k = [], at + out[-1][3] + len(NOTHING), k + 1
            yield _batch(out, schema)
        yield _batch([block()] if held else [], schema)

    blocks = cut(lines.mapInArrow(run, "first string, block long, offset long, length long, value binary").withColumn("part", F.spark_partition_id()))
    _write(blocks, NOTHING, folder)
    # A file's name has the number of the partition that it comes from.
    files = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.regexp_extract("path", r"/part-(\d+)-[^/]*$", 1).cast("int").alias("of"))
    directory = cut(blocks.drop("value").join(F.broadcast(files), F.col("part") == F.col("of")).drop("of"))  # one file a partition
    lows = sorted((r["low"], r["part"]) for r in directory.groupBy("part").agg(F.min("first").alias("low")).collect())  # one row a partition
    return CaptureIndex(directory, lows)


FOUND = [("want", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]


def find(index: CaptureIndex, wanted: DataFrame) -> DataFrame:
    """(want, file, offset, length) of the captures whose key begins with a want (each once); some have none, some several."""
    shared = wanted.sparkSession.sparkContext.broadcast(index.lows)

    def parts(batches):
        lows = shared.value
        for batch in batches:
            out = []
            for want in batch.column(0).to_pylist():
                lo = max(0, bisect_left(lows, (want, -1)) - 1)
                hi = bisect_right(lows, (want + "\U0010ffff", 0))
                out += [(lows[k][1], want) for k in range(lo, hi)]
            yield _batch(out, [("part", pa.int32()), ("first", pa.string())])

    asked = wanted.select("want").mapInArrow(parts, "part int, first string").select("part", F.lit(1).alias("kind"), "first", *[F.lit(None).cast(t).alias(n) for n, t in (("file", "string"), ("offset", "long"), ("length", "long"))])
    rows = index.directory.select("part", F.lit(0).alias("kind"), "first", "file", "offset", "length").unionByName(asked)
    rows = rows.repartition("part").sortWithinPartitions("part", "kind", "first", "offset")

    def search(batches):
        files, part, firsts, places, number, keys, lines = Ranges(), None, [], [], -1, [], []
        for batch in batches:
            out = []
            for of, kind, first, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if of != part:
                    part, firsts, places, number = of, [], [], -1
                if kind == 0:
                    firsts.append(first)
                    places.append((file, offset, length))
                    continue
                for k in range(max(0, bisect_left(firsts, first) - 1), len(firsts)):
                    if firsts[k] > first and not firsts[k].startswith(first):
                        break
                    if k != number:
                        data = unpacked(memoryview(files.read(*places[k])), 0)[0]
                        number, lines = k, [x.split("\t") for x in data.decode().split("\n")]
                        keys = [x[0] for x in lines]
                    for at in range(bisect_left(keys, first), len(keys)):
                        if not keys[at].startswith(first):
                            break
                        out.append((first, lines[at][1], int(lines[at][2]), int(lines[at][3])))
            yield _batch(out, FOUND)

    return rows.select("part", "kind", "first", "file", "offset", "length").mapInArrow(search, "want string, file string, offset long, length long")


def fetch(found: DataFrame) -> DataFrame:
    """found (want, file, offset, length) with the record at that place (RECORD), read by range, in the order of the archives."""
    rows = found.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def run(batches):
        files = Ranges()
        for batch in batches:
            out = []
            for want, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                out.append((want, *described(file, offset, length, unpacked(memoryview(files.read(file, offset, length)), 0)[0])))
            yield _batch(out, [("want", pa.string()), *RECORD])

    return rows.select("want", "file", "offset", "length").mapInArrow(run, f"want string, {_RECORD}")


def captures(index: CaptureIndex, urls: DataFrame) -> DataFrame:
    """The records (RECORD) of all captures of the URLs in rows (url), with the wanted key as want."""

    def run(batches):
        for batch in batches:
            yield _batch([(url_key(safe_url(u)) + " ",) for u in batch.column(0).to_pylist()], [("want", pa.string())])

    return fetch(find(index, urls.select("url").mapInArrow(run, "want string").distinct()))


def archived(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) and their capture index below folder, reads them back, and gives a row for each page:
    page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit's come from the record that it refers to."""
    write_archives(pages, f"{folder}/archives", least_bytes)
    records = cut(read_archives(pages.sparkSession, f"{folder}/archives"))
    unsound = records.where("NOT sound").limit(1).collect()
    if unsound:
        raise ValueError(f"the payload at {unsound[0]['offset']} of {unsound[0]['file']} hasn't the digest that its record names")
    index = build_index(records, f"{folder}/index")
    revisits = records.where("record_type = 'revisit'").select("page_id", "payload_digest", F.col("refers_to").alias("want"))
    asked = cut(revisits.groupBy("want").agg(F.count("*").alias("many")))
    firsts = fetch(find(index, asked)).where("record_type = 'response' AND sound").select("want", F.col("page_id").alias("first"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("digest"))
    firsts = cut(firsts.join(asked, "want"))
    total = asked.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    back = join_heavy(revisits.withColumn("salt", F.monotonically_increasing_id()), firsts, "want", F.col("many") >= heavy_from(total), ["salt"], inner=False)
    wrong = F.when(F.col("digest").isNull() | (F.col("digest") != F.col("payload_digest")), F.raise_error(F.concat(F.lit("a revisit without its response: "), F.col("want"))))
    back = back.select("page_id", F.coalesce(wrong, F.col("n")).cast("long").alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), F.col("first").alias("refers_to"))
    own = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(back)


def op12_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    out = cut(archived(load(spark, sf_dir, "pages"), folder))
    remove_folder(spark, folder)
    return out


_CHARS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, {5 * g + 1}, 5))::BIGINT >> {s}) & 31)::INTEGER + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, {_CHARS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
