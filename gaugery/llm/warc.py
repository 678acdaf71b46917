"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

A record is a row: record_id, record_type, target_uri, date, content_type, refers_to, refers_to_target_uri,
refers_to_date, headers (all further named fields as pairs, repeated ones included), block (binary), block_digest,
payload_digest. Each response
gives a `metadata` record (application/warc-fields: title, charset, outlinks) and a `conversion` record (text/plain),
both referring to it by its id, target and date. They carry the source's HTTP headers as `Source-HTTP-<name>`, its
content type, and its block and payload digests, and have digests of their own blocks. Ids are UUIDs made from the
source's id and the kind, so a task that runs twice makes the same records.

`write` stores records as gzip members, one per record as the format advises, in a table; `export` writes .warc.gz files of
records whose blocks are UTF-8, as those of derivatives are. `read` takes an archive whole, up to 2 GB, in one task.

Defined cases: a null page is a response with an empty body, whose conversion is empty; a null URL is a null target. A
block that isn't HTTP is taken as the body itself. The encoding is that of the HTTP header, else that of the first <meta>
anywhere in the page; one that isn't known, or isn't one of texts, counts as UTF-8, and bytes that don't fit are replaced. Rows that repeat give equal records. Records of other types than
response give no derivatives. Further columns of pages (page_id apart) aren't read. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as entities
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugery.ship import ship, tidy

DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
FIELDS = ("record_id", "record_type", "target_uri", "date", "content_type", "refers_to", "refers_to_target_uri", "refers_to_date")
NAMED = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "refers_to": "WARC-Refers-To",
    "refers_to_target_uri": "WARC-Refers-To-Target-URI", "refers_to_date": "WARC-Refers-To-Date", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest",
}
SCHEMA = ", ".join(f"{f} string" for f in FIELDS) + ", headers array<struct<name:string,value:string>>, block binary, block_digest string, payload_digest string"
_TYPES = [pa.string()] * len(FIELDS) + [pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary(), pa.string(), pa.string()]
COLUMNS = [*FIELDS, "headers", "block", "block_digest", "payload_digest"]

_tag = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>(.*?)(?:</\1\s*>|\Z)|<(/?)([A-Za-z][^\s<>/]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^<>]*>",
    re.S | re.I,
)
_href = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_charset = re.compile(r"<meta[^<>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)
_blanks = re.compile(r"[ \t\r\f\v ]+")
#: Elements after and before which a line ends.
BLOCKS = frozenset(
    "address article aside blockquote body br caption dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead tr ul".split()
)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block, usedforsecurity=False).digest()).decode()


def plain_text(page: str) -> tuple[str, str | None, list[str]]:
    """Text of a page line by line, its title, and the targets of its links."""
    parts, title, links, last = [], None, [], 0
    for m in _tag.finditer(page):
        parts.append(page[last : m.start()])
        last = m.end()
        if m[1]:
            if m[1].lower() == "title" and title is None:
                title = " ".join(entities.unescape(m[2]).split())
        elif m[4]:
            name = m[4].lower()
            if name in BLOCKS:
                parts.append("\n")
            if name == "a" and not m[3] and (h := _href.search(m[5])):
                links.append(entities.unescape(h[1] or h[2] or h[3] or ""))
    parts.append(page[last:])
    lines = (_blanks.sub(" ", x).strip() for x in entities.unescape("".join(parts)).split("\n"))
    return "\n".join(x for x in lines if x), title, links


def split_http(block: bytes) -> tuple[str | None, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP message; (None, [], block) for anything else."""
    if not block.startswith(b"HTTP/"):
        return None, [], block
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, _, body = block.partition(b"\n\n")
    first, *rest = head.decode("latin-1").splitlines()
    pairs = [x.partition(":") for x in rest if ":" in x]
    return first, [(k.strip(), v.strip()) for k, _, v in pairs], body


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=COLUMNS)


def _pairs(headers: list[tuple[str, str]]) -> list[dict[str, str]]:
    return [{"name": k, "value": v} for k, v in headers]


def _record(key: str, kind: str, uri: str | None, date: str | None, content: str, block: bytes, headers: list[tuple[str, str]], payload: bytes | None, refers: tuple = (None, None, None)) -> tuple:
    return (f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}:{key}')}>", kind, uri, date, content, *refers, _pairs(headers), block, digest(block), digest(payload) if payload is not None else None)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """A response record for each page, as a crawler would have written it, with the page's id among its headers."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (page or "").encode("utf-8", "surrogatepass")
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                headers = [("X-Page-ID", own)] if own is not None else []
                rows.append(_record(f"{own}:{url}", "response", url, date, "application/http; msgtype=response", http + body, headers, body))
            yield _batch(rows)

    return pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(tidy(run), SCHEMA)


def _of_texts(charset: str) -> bool:
    """Whether Python has an encoding of texts by that name which can replace what doesn't fit."""
    try:
        return b"\xff".decode(charset, "replace") is not None and codecs.lookup(charset).name not in ("idna", "punycode", "undefined", "unicode-escape", "raw-unicode-escape")
    except (LookupError, UnicodeError, ValueError):
        return False


def _derivatives(row: dict) -> list[tuple]:
    status, http, body = split_http(row["block"] or b"")
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    named = re.search(r"charset=[\"']?([\w:.-]+)", kind, re.I) or _charset.search(body.decode("latin-1"))
    charset = named[1] if named else "utf-8"
    text, title, links = plain_text(body.decode(charset if _of_texts(charset) else "utf-8", "replace"))
    source = [*((x["name"], x["value"]) for x in row["headers"] or ()), *((f"Source-HTTP-{k}", v) for k, v in http), ("Source-Content-Type", row["content_type"] or "")]
    source += [("Source-HTTP-Status", status)] if status else []
    source += [(f"Source-{k}-Digest", row[f"{k.lower()}_digest"]) for k in ("Block", "Payload") if row[f"{k.lower()}_digest"]]
    refers = row["record_id"], row["target_uri"], row["date"]
    fields = [("title", title), ("charset", charset), *(("outlink", f"{x} A/@href") for x in links)]
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v).encode("utf-8", "replace")
    plain, key = text.encode("utf-8", "replace"), row["record_id"] or ""
    return [
        _record(key, "metadata", row["target_uri"], row["date"], "application/warc-fields", meta, source, None, refers),
        _record(key, "conversion", row["target_uri"], row["date"], "text/plain; charset=utf-8", plain, source, plain, refers),
    ]


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records, two for each, without a shuffle."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                yield _batch([x for row in batch.slice(i, 500).to_pylist() for x in _derivatives(row)])

    return records.filter("record_type = 'response'").select(*COLUMNS).mapInArrow(tidy(run), SCHEMA)


def encode(row: dict) -> bytes:
    """A record as WARC/1.1 in a gzip member of its own."""
    block = row["block"] or b""
    return gzip.compress(_head(row, len(block)) + block + b"\r\n\r\n", mtime=0)


def _head(row: dict, length: int) -> bytes:
    named = [(NAMED[k], row[k]) for k in NAMED if row[k] is not None] + [(x["name"], x["value"]) for x in row["headers"] or ()]
    lines = "".join(f"{k}: {' '.join(str(v).splitlines())}\r\n" for k, v in named)
    return f"WARC/1.1\r\n{lines}Content-Length: {length}\r\n\r\n".encode()


def decode(data: bytes) -> Iterator[tuple]:
    """Records of a file, of gzip members or plain."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    own = {v.lower(): k for k, v in NAMED.items()}
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        known, rest, length = dict.fromkeys(NAMED), [], 0
        while (line := f.readline()).strip():
            k, _, v = (x.strip() for x in line.decode("utf-8", "replace").partition(":"))
            if k.lower() == "content-length":
                length = int(v)
            elif k.lower() in own:
                known[own[k.lower()]] = v
            else:
                rest.append((k, v))
        yield (*(known[k] for k in FIELDS), _pairs(rest), f.read(length), known["block_digest"], known["payload_digest"])


def write(records: DataFrame, path: str) -> None:
    """A table of gzip members, one a record, in the folder `path`, through Spark's writers, so that any shared store will do."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                yield pa.RecordBatch.from_arrays([pa.array([encode(x) for x in batch.slice(i, 500).to_pylist()], pa.binary())], names=["value"])

    # Members are stored as rows of a table; `read` takes both such a table and plain .warc or .warc.gz files.
    records.select(*COLUMNS).mapInArrow(tidy(run), "value binary").write.mode("errorifexists").parquet(path)


def export(records: DataFrame, path: str) -> None:
    """.warc.gz files in the folder `path`, one for each partition, through Spark's text writer. Blocks must be UTF-8, as text
    writers know no other; a block that isn't is an error. A file is one gzip member."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                # The writer ends each record by its second line end.
                texts = [(_head(x, len(x["block"] or b"")) + (x["block"] or b"") + b"\r\n").decode("utf-8") for x in batch.slice(i, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

    records.select(*COLUMNS).mapInArrow(tidy(run), "value string").write.mode("errorifexists").options(lineSep="\r\n", compression="gzip").text(path)


def read(spark: SparkSession, path: str, table: bool = False) -> DataFrame:
    """Records of .warc and .warc.gz files, or with table=True of a folder made by `write`."""
    ship(spark)
    blobs = spark.read.schema("value binary").parquet(path) if table else spark.read.format("binaryFile").load(path).select(F.col("content").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                rows = []
                for row in decode(x.as_py()):
                    rows.append(row)
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return blobs.mapInArrow(tidy(run), SCHEMA)
