"""WARC derivatives: responses become linked metadata and plain-text conversion records.

``read_warc`` reads record files (plain or gzip, one member a record or one a
file) record by record; ``responses`` makes response records of a table of
pages; ``derivatives`` writes, for each response, a metadata record (title,
language, links, source headers) and a conversion record (its text), both with
``WARC-Refers-To`` the response, its target and date, and the response's
payload digest; ``write_warc`` stores records as files.

Markup is scanned once from left to right and nothing is looked at twice, so a
page costs time linear in its length, whatever it holds: what has no end is
text up to the end of the page, or dropped where its content is.

Identifiers are functions of what a record holds, so a job that runs again
gives the same ones. Defined results: a null html is an empty payload with an
empty text; a null url is an empty target; records of other types give nothing;
repeated rows give records each, with equal identifiers; further columns are
ignored; an empty table gives an empty result. A payload in chunks or compressed
(gzip, deflate) is decoded for its text and links, and taken as it is where it
is not what its header says; digests are of the payload as it was sent.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = b"\r\n\r\n"
#: Elements whose content is no text, and those that begin a line.
DROPPED = {"script", "style", "noscript", "template"}
BREAKING = set("p div br li ul ol dl dt dd h1 h2 h3 h4 h5 h6 tr td th table article section aside nav main header footer blockquote pre form hr".split())
_OPEN, _STOP = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))"), re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++)?)?+""")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+>?", re.I) for name in (*DROPPED, "title")}
_SPACE = re.compile(r"[^\S\n]+")
_META = re.compile(rb"<meta[^>]{0,200}?charset\s*+=\s*+[\"']?([\w-]+)", re.I)
#: Bytes that a compressed payload may become, so that one page cannot fill a worker; the rest is left out of its text.
LARGEST = 256 << 20
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, headers array<string>, block binary"
DERIVED = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, record string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


class Page:
    """Title, language, links and visible text (a line for each block, blank ones dropped) of a page."""

    def __init__(self, markup: str):
        self.title = self.language = ""
        self.links: list[str] = []
        parts: list[str] = []
        at, size, head, titled, gone = 0, len(markup), False, False, set()
        while (m := _OPEN.search(markup, at)) is not None:
            if not head:
                parts.append(markup[at : m.start()])
            if m[0] == "<!--":
                end = markup.find("-->", m.end())
                at = size if end < 0 else end + 3
                continue
            at = self.tag_end(markup, m.end(), gone)
            if at < 0:
                at = m.start() if not head else size
                break
            name, closing = (m[2] or "").lower(), m[1] == "/"
            if name in DROPPED and not closing:
                end = _CLOSE[name].search(markup, at)
                at = end.end() if end else size
            elif name == "title" and not closing:
                end = _CLOSE["title"].search(markup, at)
                inner, at = markup[at : end.start() if end else size], end.end() if end else size
                if not titled:
                    self.title, titled = one_line(inner), True
                if not head:
                    parts.append(inner)
            elif name == "head":
                head = not closing
            elif name == "body":
                head = False
            elif name in BREAKING and not head:
                parts.append("\0")
            elif name in ("a", "html") and not closing:
                self.attributes(name, markup[m.end() : at])
        if not head:
            parts.append(markup[at:])
        text = html.unescape("".join(parts).replace("\n", " ").replace("\r", " ").replace("\0", "\n"))
        self.text = "\n".join(x for line in text.split("\n") if (x := _SPACE.sub(" ", line).strip()))

    @staticmethod
    def tag_end(markup: str, at: int, gone: set[str]) -> int:
        """The place behind a tag's end, quoted values passed over, or -1; ``gone`` has the quotes that do not come again."""
        while (m := _STOP.search(markup, at)) is not None:
            if m[0] == ">":
                return m.end()
            close = -1 if m[0] in gone else markup.find(m[0], m.end())
            if close < 0:
                gone.add(m[0])
            at = m.end() if close < 0 else close + 1
        return -1

    def attributes(self, name: str, inner: str) -> None:
        for key, value in _ATTRIBUTE.findall(inner):
            value = html.unescape(value[1:-1] if value[:1] in ("'", '"') else value)
            if name == "a" and key.lower() == "href":
                if value:
                    self.links.append(value)
                return
            if name == "html" and key.lower() == "lang" and not self.language:
                self.language = value


def plain(markup: str) -> str:
    return Page(markup).text


def one_line(text: str) -> str:
    return " ".join(html.unescape(text).split())


def record_bytes(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """A whole record but for the two line ends that close it."""
    head = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in {"WARC-Type": kind, **fields, "Content-Length": len(block)}.items() if v not in ("", None))
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def parse(record: bytes) -> tuple[list[tuple[str, str]], bytes, int]:
    """(fields in order, what follows them, the length they give) of a record behind its first line; names keep their spelling, folded lines are joined."""
    head, _, rest = record.partition(END)
    fields: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            fields.append((name.strip(), value.strip()))
    size = field(fields, "Content-Length") or ""
    return fields, rest, int(size) if size.isdecimal() else len(rest.removesuffix(END))


def field(fields: list[tuple[str, str]], name: str) -> str | None:
    """The first value under a name, however it is spelt."""
    return next((v for k, v in fields if k.lower() == name.lower()), None)


#: What every record begins with, followed by its minor version.
START = "WARC/1."


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files under ``path``, one at a time in memory; ``page_id`` is a number of this reading.

    Files are read as lines that end before the next record, so gzip is undone
    by the stream and plain files are read in parts. Where a block holds the
    beginning of a record itself, it is put together again by its length.
    """
    names = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type")

    def run(batches):
        held, of = b"", None
        for b in batches:
            rows = []
            for data, file in zip(b.column(0), b.column(1).to_pylist()):
                data = data.as_py() or b""
                if held and file == of:
                    data = held + START.encode() + data
                elif held:
                    rows.append(told(held))
                held, of = data, file
                _, rest, size = parse(data[data.find(b"\n") + 1 :])
                if len(rest) >= size or data[:1] not in (b"0", b"1"):
                    if data[:1] in (b"0", b"1"):
                        rows.append(told(data))
                    held = b""
            yield batch(rows)
        if held:
            yield batch([told(held)])

    def told(data):
        fields, rest, size = parse(data[data.find(b"\n") + 1 :])
        block = rest[:size]
        return (None, *(field(fields, k) for k in names), len(block), field(fields, "WARC-Block-Digest"), field(fields, "WARC-Payload-Digest"), [f"{k}: {v}" for k, v in fields], block)

    def batch(rows):
        types = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in RECORD.split(", ")])

    lines = spark.read.option("lineSep", START).text(path).select(F.col("value").cast("binary").alias("value"), F.input_file_name().alias("file"))
    return lines.mapInArrow(run, RECORD).withColumn("page_id", F.monotonically_increasing_id())


def responses(pages: DataFrame, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """A response record for each row of (page_id, url, html)."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    block = F.concat(F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(payload).cast("string"), F.lit("\r\n\r\n")), "UTF-8"), payload)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    name = F.md5(F.encode(F.concat_ws("\n", F.lit("response"), F.col("page_id").cast("string"), url, F.sha1(payload)), "UTF-8"))
    dashed = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.lit("response").alias("record_type"), F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"), F.lit(None).cast("string").alias("refers_to"), url.alias("target_uri"),
        F.lit(date).alias("warc_date"), F.lit("application/http;msgtype=response").alias("content_type"), F.length(block).cast("long").alias("content_length"), F.lit(None).cast("string").alias("block_digest"), F.lit(None).cast("string").alias("payload_digest"), F.array().cast("array<string>").alias("headers"), block.alias("block"),
    )


def dechunked(payload: bytes) -> bytes:
    """A payload sent in chunks; as it is where it was not."""
    out, at = [], 0
    while (end := payload.find(b"\r\n", at, at + 64)) >= 0:
        try:
            size = int(payload[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if not size:
            return b"".join(out)
        out.append(payload[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out) if out and at >= len(payload) else payload


def decoded(payload: bytes, fields: list[tuple[str, str]]) -> bytes:
    """The payload's content, without the codings that the response names."""
    if "chunked" in (field(fields, "Transfer-Encoding") or "").lower():
        payload = dechunked(payload)
    coding = (field(fields, "Content-Encoding") or "").strip().lower()
    for bits in {"gzip": (47,), "x-gzip": (47,), "deflate": (15, -15)}.get(coding, ()):
        try:
            return zlib.decompressobj(bits).decompress(payload, LARGEST)
        except zlib.error:
            continue
    return payload


def derived_from(source: dict) -> list[tuple]:
    """The two records of one response."""
    block = source["block"] or b""
    head, gap, payload = block.partition(END)
    if not gap or not head.startswith(b"HTTP/"):
        head, payload = b"", block
    sent, _, _ = parse(head.partition(b"\r\n")[2])
    content = decoded(payload, sent)
    said = re.search(r"charset=\"?([\w-]+)", field(sent, "Content-Type") or "")
    named = _META.search(content[:2048])
    try:
        markup = content.decode(said[1] if said else named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        markup = content.decode("utf-8", "replace")
    payload_digest = source["payload_digest"] or digest(payload)
    page = Page(markup)
    fields = [("title", page.title), ("language", page.language), ("source-block-digest", source["block_digest"] or digest(block)), ("source-payload-length", str(len(payload)))]
    fields += [("source-header", " ".join(x.split())) for x in [*(source["headers"] or []), *head.decode("latin-1").split("\r\n")] if x.strip()]
    fields += [("outlink", " ".join(x.split())) for x in page.links]
    out = []
    for kind, content_type, body in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields if v)), ("conversion", "text/plain; charset=utf-8", page.text)):
        data = body.encode("utf-8", "replace")
        name, own = identifier(kind, source["record_id"] or "", digest(data)), digest(data)
        whole = record_bytes(kind, {"WARC-Record-ID": name, "WARC-Refers-To": source["record_id"], "WARC-Target-URI": source["target_uri"], "WARC-Date": source["warc_date"], "WARC-Block-Digest": own, "WARC-Source-Payload-Digest": payload_digest, "Content-Type": content_type}, data)
        out.append((source["page_id"], kind, name, source["record_id"], source["target_uri"], source["warc_date"], content_type, len(data), own, payload_digest, whole.decode("utf-8")))
    return out


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of each response among ``records``."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.int64(), *[pa.string()] * 6, pa.int64(), *[pa.string()] * 3]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = [r for source in b.slice(at, 256).to_pylist() for r in derived_from(source)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in DERIVED.split(", ")])

    return records.where("record_type = 'response'").select(*names).mapInArrow(run, DERIVED)


def write_warc(derived: DataFrame, path: str, compression: str = "gzip") -> None:
    """The records as files, each closed by two line ends."""
    derived.select("record").write.option("lineSep", END.decode()).option("compression", compression).text(path)
