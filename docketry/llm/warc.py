"""WARC derivatives: metadata and plain-text conversion records from responses.

Each response gives a conversion record, the plain text of its payload, and a metadata record, the links and the
headers of the source; both refer to the response by its record id. Records are rows, so that links and text come
from Spark's own expressions; `warc_bytes` and `parse_warc` turn rows into the file format and back.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text, those that end a line.
SILENT = r"(?is)<!--.*?-->|<(script|style|noscript|template|head)\b.*?</\1\s*>"
BLOCKS = r"(?i)<(?:/?(?:p|div|h[1-6]|ul|ol|li|table|tr|article|section|header|footer|nav|blockquote|pre)\b[^>]*|br\b[^>]*)>"
TAGS = r"<[^>]*>"
#: Named references that are read beside all numeric ones.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "sect": "§", "deg": "°", "times": "×",
}
REFERENCE = "^(#[0-9]{1,6}|#[xX][0-9a-fA-F]{1,5}|[a-zA-Z]{2,6});"
#: An href in double quotes, single quotes or none.
LINKS = r"(?i)<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
CRLF = "\r\n"


def decoded(text: Column) -> Column:
    """Text with its character references read, each once; others stay as they stand."""
    named = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def read(p: Column) -> Column:
        name = F.regexp_extract(p, REFERENCE, 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).when(name.startswith("#"), F.substr(name, F.lit(2))).cast("int")
        # A character outside Unicode's first plane, or none, stays as it stands.
        c = F.when(code.between(1, 55295) | code.between(57344, 65535), F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")).when(~name.startswith("#"), named[name])
        return F.when((name == "") | c.isNull(), F.concat(F.lit("&"), plain(p))).otherwise(F.concat(c, plain(F.substr(p, F.length(name) + 2))))

    # Most references are to the ampersand itself: only the others part the text.
    plain = lambda p: F.replace(p, F.lit("&amp;"), F.lit("&"))
    part = lambda p, i: F.when(i == 0, plain(p)).otherwise(read(p))
    whole = lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, "&(?!amp;)", -1), part), "")).otherwise(t)
    # The text is computed once: as the only element of an array that a lambda takes.
    return F.element_at(F.transform(F.array(text), whole), 1)


def plain_text(html: Column) -> Column:
    """Text as it reads: one line for each block, single blanks, no empty lines."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), SILENT, " "), "[ \\t\\r\\n]+", " "), BLOCKS, "\n")
    text = F.regexp_replace(F.regexp_replace(decoded(F.regexp_replace(text, TAGS, "")), "[ \\t]+", " "), " ?\n[ \n]*", "\n")
    return F.regexp_replace(text, "^[ \n]+|[ \n]+$", "")


def title_of(html: Column) -> Column:
    return F.trim(decoded(F.regexp_extract(F.coalesce(html, F.lit("")), TITLE, 1)))


def links(html: Column) -> Column:
    """Targets of the anchors in order, repeats included."""
    bare = lambda x: F.when(x.startswith('"') | x.startswith("'"), F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINKS), F.lit(1)), lambda x: decoded(bare(x)))


def record_id(*parts: Column) -> Column:
    """A name-based URN: the same record gets the same id in every run."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def digest(payload: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(payload, "UTF-8"), 256))


def responses(pages: DataFrame, row_id: str = "page_id") -> DataFrame:
    """Response records of a table of (page_id, url, html). Null html is an empty payload, a null url stays null.

    The headers say what the table knows: the type and the length. It knows no date.
    """
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        F.col(row_id).alias("source_id"),
        record_id(F.lit("response"), F.col(row_id), F.col("url")).alias("record_id"),
        F.lit("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(None).cast("string").alias("date"),
        F.concat(F.lit(f"content-type: text/html; charset=utf-8{CRLF}content-length: "), F.octet_length(html).cast("string")).alias("headers"),
        digest(html).alias("payload_digest"),
        html.alias("payload"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """A conversion and a metadata record for each response: (source_id, record_type, record_id, refers_to, target_uri,
    date, content_type, source_headers, source_digest, payload_digest, content_length, n_links, payload).

    Identifier, date, headers and digest of the source are kept as they stand; a source without a digest gets that of
    its text. Both records share the source's date. Other record types are passed over. Repeated responses give
    repeated records; null or empty payloads give an empty text. Columns beyond those of `responses` aren't read. Empty
    in, empty out.
    """
    r = records.where(F.col("record_type") == "response")
    own = F.coalesce("payload", F.lit(""))
    r = r.select("source_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.coalesce("headers", F.lit("")).alias("source_headers"), F.coalesce(F.col("payload_digest"), digest(own)).alias("source_digest"), title_of(own).alias("title"), links(own).alias("links"), plain_text(own).alias("text"))
    lines = F.transform(F.filter(F.split("source_headers", CRLF), lambda x: x != ""), lambda x: F.concat(F.lit("source-header: "), x))
    meta = F.concat_ws(CRLF, F.concat(F.lit("title: "), F.col("title")), F.concat(F.lit("source-digest: "), F.col("source_digest")), lines, F.transform("links", lambda x: F.concat(F.lit("outlink: "), x)))
    made = F.array(F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), F.col("text").alias("payload")), F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), meta.alias("payload")))
    out = r.select("source_id", "refers_to", "target_uri", "date", "source_headers", "source_digest", F.size("links").cast("long").alias("n_links"), F.explode(made).alias("d"))
    return out.select(
        "source_id",
        F.col("d.record_type").alias("record_type"),
        record_id(F.col("d.record_type"), F.col("refers_to")).alias("record_id"),
        "refers_to",
        "target_uri",
        "date",
        F.col("d.content_type").alias("content_type"),
        "source_headers",
        "source_digest",
        digest(F.col("d.payload")).alias("payload_digest"),
        F.octet_length("d.payload").cast("long").alias("content_length"),
        "n_links",
        F.col("d.payload").alias("payload"),
    )


def warc_bytes(fields: dict[str, str | None], payload: bytes) -> bytes:
    """One record in the file format; fields that are None are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record of a file, compressed by record or not, one record at a time.

    Of a field that comes several times the values are joined by line breaks. What stands between records, and a
    record that is cut short, is passed over.
    """
    file = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        last = None
        while (line := file.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and last:  # goes on
                fields[last] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields[last] = f"{fields[last]}\n{value.strip()}" if last in fields else value.strip()
        size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else 0
        block = file.read(size)
        if len(block) == size:
            yield fields, block


def http_body(headers: dict[str, str], body: bytes) -> str:
    """The text of a response's body: chunks joined, compression undone, in the charset that the headers or the page name."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        out, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0:
            try:
                size = int(body[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if not size:
                break
            out.append(body[end + 2 : end + 2 + size])
            at = end + 4 + size
        body = b"".join(out) or body
    try:
        match headers.get("content-encoding", "").strip().lower():
            case "gzip" | "x-gzip":
                body = gzip.decompress(body)
            case "deflate":
                body = zlib.decompress(body, -zlib.MAX_WBITS if body[:1] not in (b"\x78", b"\x58") else zlib.MAX_WBITS)
    except (OSError, EOFError, zlib.error):
        pass  # said to be compressed, but isn't: as it stands
    told = re.search(r"charset=[\"']?([\w.:-]+)", headers.get("content-type", "")) or re.search(r"charset=[\"']?([\w.:-]+)", body[:2048].decode("latin-1"))
    try:
        return body.decode(told[1] if told else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def read_responses(files: DataFrame) -> DataFrame:
    """Records of WARC files, from rows of `spark.read.format("binaryFile")`: one file as it lies there in memory at a
    time, and of what it holds one record. More columns: the response's status line, and all of the record's WARC fields.

    WARC-Date and WARC-Payload-Digest are the file's own; a record without a digest gets that of its raw body.
    """

    names = ["source_id", "record_id", "record_type", "target_uri", "date", "headers", "payload_digest", "payload", "status", "warc_fields"]

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for i, (fields, block) in enumerate(parse_warc(raw)):
                    head, _, body = block.partition(b"\r\n\r\n") if fields.get("warc-type") == "response" else (b"", b"", block)
                    status, *lines = head.decode("latin-1").split(CRLF)
                    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                    name = fields.get("warc-record-id") or f"<urn:sha256:{hashlib.sha256(f'{path}#{i}'.encode()).hexdigest()}>"
                    own = fields.get("warc-payload-digest") or f"sha256:{hashlib.sha256(body).hexdigest()}"
                    rows.append((f"{path}#{i}", name, fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-date"), CRLF.join(lines), own, http_body(headers, body), status or None, fields))
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(records, "source_id string, record_id string, record_type string, target_uri string, date string, headers string, payload_digest string, payload string, status string, warc_fields map<string,string>")


def write_derivatives(records: DataFrame, path: str, **options) -> None:
    """The derivatives as WARC files, one for each partition. Options are those of Spark's text sink, such as compression.

    A record ends in two line breaks, which the sink writes between its rows and after the last.
    """
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    fields = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type")]
    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(line(name, F.col(column)), F.lit("")) for name, column in fields], line("Content-Length", F.octet_length("payload").cast("string")), F.lit(CRLF))
    records.select(F.concat(head, F.col("payload")).alias("value")).write.options(**options).option("lineSep", CRLF * 2).text(path)


def oracle() -> str:
    """The same derivatives in SQL."""

    def q(pattern: str) -> str:
        return pattern.replace("'", "''")

    names = ", ".join(f"'{k}': '{q(v)}'" for k, v in ENTITIES.items())

    def dec(x: str) -> str:
        """References read as `decoded` reads them."""
        name = f"regexp_extract(p, '{REFERENCE}', 1)"
        code = f"CASE WHEN regexp_matches({name}, '^#[xX]') THEN CAST('0x' || substr({name}, 3) AS INTEGER) WHEN {name} LIKE '#%' THEN CAST(substr({name}, 2) AS INTEGER) END"
        c = f"CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 65535 THEN chr({code}) WHEN {name} NOT LIKE '#%' THEN MAP {{{names}}}[{name}] END"
        part = f"CASE WHEN i = 1 THEN p WHEN starts_with(p, 'amp;') THEN '&' || substr(p, 5) WHEN {name} = '' OR ({c}) IS NULL THEN '&' || p ELSE ({c}) || substr(p, length({name}) + 2) END"
        return f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: {part}), '')"

    silent = [r"(?is)<!--.*?-->", *(rf"(?is)<{t}\b.*?</{t}\s*>" for t in ("script", "style", "noscript", "template", "head"))]
    text = f"regexp_replace(html, '{q('|'.join(x.replace('(?is)', '(?:') + ')' for x in silent))}', ' ', 'gis')"
    text = f"regexp_replace(regexp_replace({text}, '[ \\t\\r\\n]+', ' ', 'g'), '{q(BLOCKS.replace('(?i)', ''))}', chr(10), 'gi')"
    text = f"regexp_replace(regexp_replace({dec(f"regexp_replace({text}, '{TAGS}', '', 'g')")}, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
    text = f"regexp_replace({text}, '^[ \\n]+|[ \\n]+$', '', 'g')"
    uid = "'<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>'"
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')) AS h FROM pages),
r AS (
  SELECT html, page_id AS source_id, {uid} AS refers_to, url AS target_uri, 'content-type: text/html; charset=utf-8' || chr(13) || chr(10) || 'content-length: ' || strlen(html) AS source_headers,
         'sha256:' || sha256(html) AS source_digest, trim({dec(f"regexp_extract(html, '{q(TITLE)}', 1)")}) AS title,
         list_transform(regexp_extract_all(html, '{q(LINKS)}', 1), lambda x: {dec("CASE WHEN x[1] IN ('\"', ) THEN x[2:-2] ELSE x END")}) AS links, {text} AS text FROM p),
d AS (
  SELECT *, 'conversion' AS record_type, 'text/plain' AS content_type, text AS payload FROM r
  UNION ALL
  SELECT *, 'metadata', 'application/warc-fields', 'title: ' || title || chr(13) || chr(10) || 'source-digest: ' || source_digest || chr(13) || chr(10) || 'source-header: content-type: text/html; charset=utf-8' || chr(13) || chr(10) || 'source-header: content-length: ' || strlen(html)
         || coalesce(list_reduce(list_transform(links, lambda x: chr(13) || chr(10) || 'outlink: ' || x), lambda a, b: a || b, ''), '') FROM r),
e AS (SELECT *, md5(record_type || '|' || refers_to) AS h FROM d)
SELECT source_id, record_type, {uid} AS record_id, refers_to, target_uri, CAST(NULL AS VARCHAR) AS date, content_type, source_headers, source_digest,
       'sha256:' || sha256(payload) AS payload_digest, CAST(strlen(payload) AS BIGINT) AS content_length, CAST(len(links) AS BIGINT) AS n_links, payload
FROM e
"""
