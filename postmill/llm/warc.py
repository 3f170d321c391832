"""Operator 7: WARC archives with a two-level capture index.

Writing: every page becomes a WARC/1.1 record, compressed by itself, in archives of bounded size that tasks write to
the shared folder (``pyarrow.fs`` opens its URL: a local or mounted path, HDFS, S3 or GCS). Archive names are drawn
anew by each attempt and the capture rows name the archive that the attempt wrote, so a task that runs again after a
lost executor can't harm; the rows themselves are kept by a checkpoint. Of records with equal payloads of at least
``MIN_REVISIT`` bytes the one with the smallest page_id holds the payload, the others are revisits.

Index: captures are sorted by reversed-host URL key and page_id over range partitions and packed into compressed
blocks of ``BLOCK_LINES`` lines; the sparse directory has the first key of each block. Looking up: keys are
binary-searched in the directory (broadcast in parts of at most ``DIRECTORY_ROWS`` rows, so of bounded size), meet
their block, are binary-searched in it, and yield (archive, offset, length); records are then read by those ranges.

Nulls: a null html is an empty payload, a null url the empty key, a null page_id never is a response if another
record of the payload has an id. Rows that repeat a page_id and its payload are all responses. A very large payload is
a batch by itself. Columns of other names are not read. Empty tables give empty results.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import broadcast_if_small, cut_lineage, parts_for, shared_dir, sliced

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
BLOCK_LINES = 3000
DIRECTORY_ROWS = 1_000_000
DATE = "2001-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """The host's labels reversed, then the path and query: keys of one site stand together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = re.sub(r"^www\d*\.", "", (parts.hostname or "").rstrip("."))
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/").lower() + (f"?{query.lower()}" if query else "")


def sort_key(url: str | None, page_id: int | None) -> str:
    """URL key and page number; the number is padded so that text order is number order."""
    return f"{url_key(url)} {'' if page_id is None else format(page_id + (1 << 63), '020d')}"


def record(page_id, url: str | None, payload: bytes, digest: str, revisit_of) -> bytes:
    """One WARC record, compressed as a gzip member of its own."""
    kind = "response" if revisit_of is None else "revisit"
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", "", url or ""), f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: text/html;charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if revisit_of is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{revisit_of}>"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one compressed record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:size]


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty) and digest."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))


def revisits(rows: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the records that revisit another; payload digests only, no payloads."""
    facts = cut_lineage(rows.filter(F.octet_length("html") >= MIN_REVISIT).select("page_id", "digest"))
    first = facts.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null")
    found = facts.join(first.select("digest", "refers_to"), "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return cut_lineage(found.select("page_id", "digest", "refers_to").distinct())


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``pages`` (page_id, url, html) to archives in ``folder``; returns the captures.

    A capture: key, page_id, archive, offset, length. The rows are kept, so no archive is written twice.
    """
    rows = payloads(pages)
    again = revisits(rows).select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to")
    rows = rows.join(broadcast_if_small(again), (F.col("digest") == F.col("__digest")) & F.col("page_id").eqNullSafe(F.col("__id")), "left")

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for batch in sliced(batches, "html", BATCH_BYTES):
            found = {k: [] for k in ("key", "page_id", "archive", "offset", "length")}
            for p, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = record(p, url, html.encode(), digest, refers)
                out.write(data)
                for k, v in (("key", sort_key(url, p)), ("page_id", p), ("archive", name), ("offset", at), ("length", len(data))):
                    found[k].append(v)
                at += len(data)
            yield pa.RecordBatch.from_pydict(found, schema=captures)
        if out is not None:
            out.close()

    captures = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "digest", F.col("refers_to").cast("long").alias("refers_to"))
    return cut_lineage(rows.mapInArrow(write, "key string, page_id long, archive string, offset long, length long"))


def build_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Blocks of the sorted captures: first_key, lines (compressed) and n."""
    parts = max(1, min(parts_for(captures.sparkSession, 0, 1), -(-captures.count() // block_lines)))
    order = ["key", "archive", "offset"]
    ranged = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def pack(batches):
        held: list[tuple] = []

        def block(lines):
            text = "\n".join(json.dumps(x) for x in lines).encode()
            return pa.RecordBatch.from_pydict({"first_key": [lines[0][0]], "lines": [zlib.compress(text, 6)], "n": [len(lines)]}, schema=pa.schema([("first_key", pa.string()), ("lines", pa.binary()), ("n", pa.int64())]))

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("key", "archive", "offset", "length")), strict=True)
            while len(held) >= block_lines:
                yield block(held[:block_lines])
                held = held[block_lines:]
        if held:
            yield block(held)

    return cut_lineage(ranged.mapInArrow(pack, "first_key string, lines binary, n long"))


def lookup(blocks: DataFrame, keys: DataFrame, directory_rows: int = DIRECTORY_ROWS) -> DataFrame:
    """Captures of the distinct ``key`` values: key, archive, offset, length.

    The directory (first keys, a row a block) is searched in parts of ``directory_rows`` rows; each part answers for
    the keys between its first key and the next part's. A key can start in the block before the one that begins with
    it, and a key with very many captures spans several blocks: it is sent to each of them.
    """
    spark = blocks.sparkSession
    numbered = cut_lineage(blocks.select("first_key", "lines", F.xxhash64("first_key", "lines").alias("block")))
    wanted = keys.select("key").filter("key is not null").distinct()
    n = numbered.count()
    found = None
    bounds: list[str | None] = [None]
    while bounds[-1] is not None or len(bounds) == 1:
        low = bounds[-1]
        rest = numbered.select("first_key", "block") if low is None else numbered.select("first_key", "block").filter(F.col("first_key") >= low)
        part = rest.orderBy("first_key", "block").limit(directory_rows + 1).collect() if n > directory_rows else sorted(rest.collect())
        high = part[directory_rows][0] if len(part) > directory_rows else None
        if high is not None and high == part[0][0]:
            raise ValueError("one key fills a whole part of the directory: raise directory_rows")
        mine = [r for r in part if high is None or r[0] < high]
        here = wanted if low is None else wanted.filter(F.col("key") >= low)
        here = here if high is None else here.filter(F.col("key") < high)
        if mine:
            shared = spark.sparkContext.broadcast(([r[0] for r in mine], [r[1] for r in mine]))
            step = here.mapInArrow(_route(shared), "key string, block long")
            found = step if found is None else found.unionAll(step)
        bounds.append(high)
        if high is None:
            break
    if found is None:
        return spark.createDataFrame([], "key string, archive string, offset long, length long")
    return found.groupBy("block").cogroup(numbered.groupBy("block")).applyInArrow(_search_block, "key string, archive string, offset long, length long")


def _route(shared):
    def run(batches):
        firsts, blocks = shared.value
        for batch in batches:
            keys, to = [], []
            for key in batch.column("key").to_pylist():
                last = bisect.bisect_right(firsts, key)
                first = max(0, bisect.bisect_left(firsts, key) - 1)
                keys += [key] * (last - first)
                to += blocks[first:last]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(to, pa.int64())], ["key", "block"])

    return run


def _search_block(keys: pa.Table, block: pa.Table) -> pa.Table:
    schema = pa.schema([("key", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    if not keys.num_rows or not block.num_rows:
        return schema.empty_table()
    lines = [json.loads(x) for x in zlib.decompress(block["lines"][0].as_py()).split(b"\n")]
    firsts = [x[0] for x in lines]
    out = []
    for key in keys["key"].to_pylist():
        out += lines[bisect.bisect_left(firsts, key) : bisect.bisect_right(firsts, key)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, schema.types, strict=True)], schema=schema)


def read_records(found: DataFrame, folder: str) -> DataFrame:
    """Range-read the records of ``found`` (archive, offset, length): what their headers and payloads say.

    Ranges are dealt by archive and stretch of the archive and read in order, so a task reads forward.
    """
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("offset") / F.lit(BATCH_BYTES))
    dealt = found.withColumn("stretch", stretch).repartition(parts, "archive", "stretch").sortWithinPartitions("archive", "offset")

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        now, file = None, None
        for batch in batches:
            out = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")}
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != now:
                    if file is not None:
                        file.close()
                    now, file = archive, fs.open_input_file(f"{base}/{archive}")
                fields, body = parse_record(file.read_at(length, offset))
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                number = lambda name: None if (x := re.search(r"urn:page:(-?\d+|None)", fields.get(name, "urn:page:None"))[1]) == "None" else int(x)  # noqa: B023, E731
                size = len(body) if kind == "response" else int(fields["X-Payload-Length"])
                for k, v in (
                    ("page_id", number("WARC-Record-ID")), ("payload_bytes", size), ("payload_digest", digest), ("record_type", kind),
                    ("refers_to", number("WARC-Refers-To")), ("intact", kind == "revisit" or hashlib.sha256(body).hexdigest() == digest),
                ):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        if file is not None:
            file.close()

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for archives beside the checkpoints, as a URL."""
    base = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    base = base if "://" in base else "file://" + re.sub(r"^file:", "", base)
    fs, path = pafs.FileSystem.from_uri(base)
    fs.create_dir(path, recursive=True)
    return base


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    captures = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    blocks = build_index(captures)
    found = lookup(blocks, captures.select("key"))
    return read_records(found, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


ORACLE = {
    "op7_warc_index": r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> low THEN low END AS refers_to, true AS intact FROM r
""",
}
