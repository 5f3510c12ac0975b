"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives a metadata record (HTTP status and headers, title, out-links,
digests of the source) and, if its payload is text, a conversion record (the page's
plain text).  Both refer to the response by its record id and keep its target
and date; ids of derivatives follow from the response's id, so a repeated run gives
the same records.  One pass in Arrow functions, no shuffle.  ``write`` stores
records as WARC files through Spark's own writer.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_rows import slices
from .common import col_of

SLICE_BYTES = 8 << 20
SPACE_OF_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of addresses
RESPONSE = "key long, record_id string, target_uri string, date string, block binary"
FIELDS = ["key", "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest",
          "source_block_digest", "source_payload_digest", "block"]
DERIVATIVE = ("key long, warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
              "content_length long, block_digest string, source_block_digest string, source_payload_digest string, block string")

# What a page does not show; an unclosed comment, script or style runs to the page's end, as in browsers, of the others only the tag goes.
HIDDEN = re.compile(r"<!--|<(script|style|noscript|template|svg|iframe)\b", re.I)
HIDDEN_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "svg", "iframe")}
TO_THE_END = ("script", "style")
SELF_CLOSED = re.compile(r"""<svg\b(?:[^>"']|"[^"]*"|'[^']*')*(?<=/)>""", re.I)
HEAD_OR_BODY = re.compile(r"<(head|body)(?=[\s/>])[^>]*>", re.I)
# What may stand in a head: anything else ends it, with or without end tag.
IN_HEAD = re.compile(r"\s+|<title\b[^>]*>.*?</title\s*>|<(?:title|meta|link|base|basefont|bgsound|noscript|template|noframes|head)\b[^>]*>|<[!?][^>]*>"
                     r"|</(?!(?:head|body|html|br)\b)[a-z][^>]*>", re.S | re.I)
HEAD_END = re.compile(r"</head\s*>", re.I)
# The rest of a tag: quoted values may hold a ">"; where a quote is not closed (or longer than 4096 characters), the first ">" ends the tag.
QUOTED = r"""(?:[^>"']++|"[^"]{0,4096}+"|'[^']{0,4096}+')"""
REST = rf"(?:{QUOTED}*+>|[^>]*>)"
BREAKS = re.compile(rf"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|main|aside|blockquote|pre|hr|dd|dt|form|title)\b{REST}", re.I)
CELLS = re.compile(rf"</?(?:td|th|caption|option|optgroup|select|button|textarea|legend|summary)\b{REST}", re.I)
TAG = re.compile(rf"<!?/?[a-zA-Z]{REST}|<![^>]*>|<\?[^>]*>")
TITLE = re.compile(rf"<title\b{REST}(.*?)</title", re.S | re.I)
LINK = re.compile(rf"""<a\b(?=[\s/>]){QUOTED.replace("]++", "]")}*?(?<![\w-])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.S | re.I)
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
NAMED_IN_PAGE = re.compile(r"<meta\b[^>]*?charset\s*=\s*[\"']?([\w.:-]+)|<\?xml[^>]*?encoding\s*=\s*[\"']([\w.:-]+)", re.I)
BLANKS = re.compile(r"[^\S\n]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_IDS, name)}>"


def _open_parts(page: str) -> str:
    """A page without comments and hidden elements."""
    parts, at, missing = [], 0, set()
    while found := HIDDEN.search(page, at):
        parts.append(page[at:found.start()])
        name = (found[1] or "").lower()
        single = SELF_CLOSED.match(page, found.start()) if name == "svg" else None
        if single:
            at = single.end()
        elif not name:
            end = page.find("-->", found.end())
            at = len(page) if end < 0 else end + 3
        else:
            end = None if name in missing else HIDDEN_END[name].search(page, found.end())
            if end:
                at = end.end()
            elif name in TO_THE_END:
                at = len(page)
            else:
                missing.add(name)
                tag = page.find(">", found.end())
                at = found.end() if tag < 0 else tag + 1
        parts.append(" ")
    return "".join([*parts, page[at:]])


def _without_head(page: str) -> str:
    head = HEAD_OR_BODY.search(page)
    if not head or head[1].lower() == "body":
        return page
    at = head.end()
    while part := IN_HEAD.match(page, at):
        at = part.end()
    end = HEAD_END.match(page, at)
    return page[:head.start()] + " " + page[end.end() if end else at:]


def plain_text(page: str) -> str:
    """Visible text of an HTML page, a line per block and a blank between cells; comments, scripts, styles, frames and the head go."""
    text = TAG.sub("", CELLS.sub(" ", BREAKS.sub("\n", _without_head(_open_parts(page)))))
    lines = (BLANKS.sub(" ", line).strip() for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers (folded lines joined) and payload of an HTTP response; without a header part all is payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    end = re.search(rb"\r?\n\r?\n", block)  # a head whose lines end in LF alone ends there, too
    head, payload = (block[:end.start()], block[end.end():]) if end else (block, b"")
    lines = re.split(r"\r?\n", re.sub(r"\r?\n[ \t]+", " ", head.decode("latin-1")))
    headers = [(n.strip().lower(), v.strip()) for n, c, v in (line.partition(":") for line in lines[1:]) if c]
    return lines[0], headers, payload


def _body(headers: dict[str, str], payload: bytes) -> bytes | None:
    """The payload without transfer and content coding; as it is where a coding is broken, None where one is unknown (br, zstd)."""
    data = payload
    if "chunked" in headers.get("transfer-encoding", "").lower():
        parts, rest = [], data
        while rest:
            size, _, rest = rest.partition(b"\r\n")
            try:
                n = int(size.split(b";")[0], 16)
            except ValueError:
                return payload
            parts.append(rest[:n])
            rest = rest[n + 2:] if n else b""
        data = b"".join(parts)
    for kind in reversed([c.strip() for c in headers.get("content-encoding", "").lower().split(",")]):
        if kind in ("gzip", "x-gzip", "deflate"):
            data = _inflated(data, "gzip" in kind)
            if data is None:
                return payload
        elif kind not in ("", "identity"):
            return None
    return data


def _inflated(data: bytes, gzip: bool) -> bytes | None:
    """All members of a gzip body, or a deflate body with or without zlib's head; None where it is broken. What follows the last member is ignored."""
    for bits in (47,) if gzip else (15, -15):
        parts, rest = [], data
        while rest and (not parts or gzip):
            member = zlib.decompressobj(31 if parts else bits)
            try:
                part = member.decompress(rest) + member.flush()
            except zlib.error:
                break
            if not parts and not member.eof:
                break
            parts.append(part)
            rest = member.unused_data
        if parts:
            return b"".join(parts)
    return None


def derived(key, source_id: str, uri: str | None, date: str | None, block: bytes) -> list[tuple]:
    """The derivative records of one response, as rows of ``FIELDS``."""
    status, headers, payload = http_parts(block)
    by_name = dict(reversed(headers))  # the first of equal names
    kind = by_name.get("content-type", "text/html").split(";")[0].strip().lower()
    block_digest, payload_digest = digest(block), digest(payload)
    page, data = "", None
    if kind.startswith("text/") or kind.endswith(("xml", "json")):
        data = _body(by_name, payload)
    if data is not None:
        named = CHARSET.search(by_name.get("content-type", "")) or (NAMED_IN_PAGE.search(data[:1024].decode("latin-1")) if kind != "text/plain" else None)
        try:
            page = data.decode(next(filter(None, named.groups())) if named else "utf-8", "replace")
        except LookupError:
            page = data.decode("utf-8", "replace")
    marked = kind in ("text/html", "application/xhtml+xml")
    fields = [("sourceRecord", source_id), ("sourceBlockDigest", block_digest), ("sourcePayloadDigest", payload_digest)]
    if status:
        fields.append(("httpStatus", status))
    fields += [("httpHeader", f"{n}: {v}") for n, v in headers]
    if marked:
        seen = _open_parts(page)
        fields += [("title", html.unescape(BLANKS.sub(" ", t.replace("\n", " "))).strip()) for t in TITLE.findall(seen)[:1]]
        fields += [("outlink", html.unescape(a or b or c)) for a, b, c in LINK.findall(seen)]
    made = [("metadata", "application/warc-fields", "".join(f"{n}: {BLANKS.sub(' ', v.replace(chr(10), ' ')).strip()}\r\n" for n, v in fields))]
    if data is not None and (kind.startswith("text/") or marked):
        made.append(("conversion", "text/plain", plain_text(page) if marked else page))
    out = []
    for name, content_type, text in made:
        raw = text.encode("utf-8", "replace")
        out.append((key, name, record_id(f"{source_id} {name}"), source_id, uri, date, content_type, len(raw), digest(raw), block_digest, payload_digest, raw.decode()))
    return out


def responses(pages: DataFrame, date: str, key_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of pages, with an HTTP head: key, record_id, target_uri, date, block.

    Null html: a response without payload.  Null address or key: the record id follows
    from what there is.  Other input columns are ignored.
    """
    rows = pages.select(col_of(pages, key_col).cast("long").alias("key"), col_of(pages, uri_col).alias("uri"), col_of(pages, html_col).cast("binary").alias("html"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html", SLICE_BYTES):
                keys, uris = part.column("key").to_pylist(), part.column("uri").to_pylist()
                blocks = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%b" % (len(h or b""), h or b"")
                          for h in part.column("html").to_pylist()]
                ids = [record_id(f"{k} {u}") for k, u in zip(keys, uris)]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(ids, pa.string()), part.column("uri"), pa.array([date] * len(ids), pa.string()),
                                                  pa.array(blocks, pa.binary())], ["key", "record_id", "target_uri", "date", "block"])

    return rows.mapInArrow(run, RESPONSE)


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of response records (the columns of ``responses``): the columns of ``FIELDS``.

    A response without payload gives empty conversion text; one whose type is no text, or whose content
    coding has no decoder here (br, zstd), gives metadata only.  A null block counts as empty, a null record id as one made from key and address.  Repeated responses give
    repeated records.  Other input columns are ignored.  Empty table: no rows.
    """
    rows = records.select(*[col_of(records, c) for c in ("key", "record_id", "target_uri", "date", "block")])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "block", SLICE_BYTES):
                out = [r for key, rid, uri, date, block in zip(*[c.to_pylist() for c in part.columns])
                       for r in derived(key, rid or record_id(f"{key} {uri}"), uri, date, block or b"")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if f in ("key", "content_length") else pa.string())
                                                  for k, f in enumerate(FIELDS)], FIELDS)

    return rows.mapInArrow(run, DERIVATIVE)


def record_text() -> Column:
    """A derivative record as it stands in a WARC file, without the two line ends behind it."""
    named = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
             ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type")]
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n}: "), F.regexp_replace(c, r"[\r\n]+", " "), F.lit("\r\n"))).otherwise("") for n, c in named]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"), "block")


def write(records: DataFrame, path: str, compression: str = "none") -> None:
    """Derivative records as WARC files, one per partition."""
    records.select(record_text().alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)
