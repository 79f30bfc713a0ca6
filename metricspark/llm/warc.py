"""WARC derivatives: linked metadata and plain-text conversion records of responses.

A response gives two records. Both refer to it by its record id and keep its target, date and
payload digest. The metadata record holds the source's HTTP headers, the title and the links as
``application/warc-fields``; the conversion record holds the text. Everything is column
expressions: a row in, two rows out, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import column

CRLF = "\r\n"
VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
STATUS = "HTTP/1.1 200 OK"
TYPE = "text/html; charset=utf-8"

# What vanishes with its content, what ends a line, and the entities that are decoded.
DROPPED = ("script", "style", "noscript", "template")
BREAKING = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|"
    "pre|section|table|td|th|title|tr|ul"
)
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&copy;", "©"), ("&reg;", "®"),
    ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&euro;", "€"), ("&laquo;", "«"), ("&raquo;", "»"),
    ("&amp;", "&"),
)
#: (pattern, replacement) in order, in the syntax that Java's and RE2's expressions share.
TO_TEXT = (
    (r"(?s)<!--.*?-->", ""),
    *((rf"(?is)<{t}\b.*?</{t}[ \t\r\n\f]*>", "") for t in DROPPED),
    (rf"(?i)</?({BREAKING})\b[^>]*>", "\n"),
    (r"<[!/?a-zA-Z][^>]*>", ""),
    *((e, t) for e, t in ENTITIES),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+", ""),
    (r"[ \n]+$", ""),
)
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LINK = r"(?i)<a\b[^>]*?\bhref[ \t\r\n\f]*=[ \t\r\n\f]*[\"']([^\"'>]*)[\"']"
FOLD = r"[\r\n\t ]+"


def _urn(value: Column) -> Column:
    h = F.md5(value)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _sha256(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def _fold(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, FOLD, " "))


def plain_text(html: Column) -> Column:
    """Text of a page: markup, scripts and styles removed, blocks on lines of their own."""
    for pattern, replacement in TO_TEXT:
        if (pattern, replacement) in ENTITIES:  # plain strings
            html = F.replace(html, F.lit(pattern), F.lit(replacement))
        else:
            html = F.regexp_replace(html, pattern, replacement)
    return html


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of raw pages: id, target, date, HTTP headers, payload and its digest."""
    html = F.coalesce(column(pages, html_col), F.lit(""))
    url = F.coalesce(column(pages, url_col), F.lit(""))
    page = column(pages, id_col)
    rows = pages.select(page.cast("long").alias("page_id"), url.alias("target_uri"), html.alias("payload"))
    digest = _sha256(F.col("payload"))
    headers = F.concat_ws(CRLF, F.lit(STATUS), F.lit(f"Content-Type: {TYPE}"), F.concat(F.lit("Content-Length: "), F.octet_length("payload")))
    key = F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"), digest)
    return rows.select(
        "page_id", _urn(key).alias("record_id"), _fold(F.col("target_uri")).alias("target_uri"), F.lit(date).alias("date"),
        headers.alias("http_headers"), "payload", digest.alias("payload_digest"))


def derivatives(source: DataFrame) -> DataFrame:
    """Two records of every response: its metadata and its plain text.

    ``header`` and ``block`` are the record as written. A null page counts as empty: its text is
    empty and it has neither title nor links. Repeated responses give repeated records with equal
    ids, as their captures are the same. An empty table gives an empty result. Columns other than
    those of ``responses`` are not read.
    """
    title = _fold(F.regexp_extract("payload", TITLE, 1))
    links = F.regexp_extract_all("payload", F.lit(LINK), F.lit(1))
    fields = F.concat_ws(
        CRLF, F.concat(F.lit("title: "), title), F.concat(F.lit("payload-digest: "), F.col("payload_digest")),
        F.transform(F.split("http_headers", CRLF), lambda h: F.concat(F.lit("http-header: "), h)),
        F.transform(links, lambda x: F.concat(F.lit("outlink: "), _fold(x))), F.lit(""))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block")))
    rows = source.select("page_id", "record_id", "target_uri", "date", "payload_digest", F.inline(kinds)).withColumnRenamed("record_id", "refers_to")
    linked = rows.withColumn("record_id", _urn(F.concat_ws("|", "record_type", "refers_to"))).withColumn("block_digest", _sha256(F.col("block")))
    lines = [
        ("WARC-Type: ", "record_type"), ("WARC-Record-ID: ", "record_id"), ("WARC-Refers-To: ", "refers_to"), ("WARC-Target-URI: ", "target_uri"),
        ("WARC-Date: ", "date"), ("WARC-Payload-Digest: ", "payload_digest"), ("WARC-Block-Digest: ", "block_digest"), ("Content-Type: ", "content_type")]
    length = F.octet_length("block")
    header = F.concat_ws(CRLF, F.lit(VERSION), *[F.concat(F.lit(a), F.col(c)) for a, c in lines], F.concat(F.lit("Content-Length: "), length), F.lit(""))
    return linked.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", length.cast("long").alias("content_length"),
        header.alias("header"), "block")


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files, one per partition: header, empty line, block, two line ends."""
    whole = F.concat("header", F.lit(CRLF), "block")
    records.select(whole.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def oracle() -> str:
    """The derivatives of ``pages`` in DuckDB's SQL."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    crlf = "chr(13) || chr(10)"
    text = "payload"
    for pattern, replacement in TO_TEXT:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(replacement)}, 'g')"

    def fold(x: str) -> str:
        return f"trim(regexp_replace({x}, {quoted(FOLD)}, ' ', 'g'))"

    def urn(x: str) -> str:
        h = f"md5({x})"
        parts = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        return f"('<urn:uuid:' || {parts} || '>')"

    names = (
        ("WARC-Type: ", "record_type"), ("WARC-Record-ID: ", "record_id"), ("WARC-Refers-To: ", "refers_to"), ("WARC-Target-URI: ", "target_uri"),
        ("WARC-Date: ", quoted(DATE)), ("WARC-Payload-Digest: ", "payload_digest"), ("WARC-Block-Digest: ", "block_digest"), ("Content-Type: ", "content_type"))
    header = f"{quoted(VERSION)} || {crlf} || " + " || ".join(f"{quoted(a)} || {c} || {crlf}" for a, c in names)
    return f"""
WITH src AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS payload FROM pages),
res AS (SELECT page_id, {fold('url')} AS target_uri, payload, 'sha256:' || sha256(payload) AS payload_digest,
  {urn("'response|' || coalesce(page_id::VARCHAR, '') || '|' || url || '|sha256:' || sha256(payload)")} AS refers_to FROM src),
two AS (
 SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
  'title: ' || {fold(f"regexp_extract(payload, {quoted(TITLE)}, 1)")} || {crlf} || 'payload-digest: ' || payload_digest || {crlf}
  || 'http-header: {STATUS}' || {crlf} || 'http-header: Content-Type: {TYPE}' || {crlf}
  || 'http-header: Content-Length: ' || strlen(payload) || {crlf}
  || array_to_string(list_transform(regexp_extract_all(payload, {quoted(LINK)}, 1), lambda x: 'outlink: ' || {fold('x')} || {crlf}), '') AS block FROM res
 UNION ALL
 SELECT *, 'conversion', 'text/plain; charset=utf-8', {text} FROM res),
named AS (SELECT *, {urn("record_type || '|' || refers_to")} AS record_id, 'sha256:' || sha256(block) AS block_digest FROM two)
SELECT page_id, record_type, record_id, refers_to, target_uri, payload_digest, block_digest, strlen(block)::BIGINT AS content_length,
 {header} || 'Content-Length: ' || strlen(block) || {crlf} AS header, block FROM named"""
