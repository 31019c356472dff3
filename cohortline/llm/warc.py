"""WARC derivatives: metadata and plain-text conversion records of responses.

``responses`` turns crawled pages into response records (the stored source
headers and payload). ``derive`` makes two records of each response: a
``metadata`` record of source facts and a ``conversion`` record with the plain
text. Both carry WARC-Refers-To, the response's WARC-Record-ID, the target URI,
the source record's headers that describe it, the source payload's digest and
their own block and payload digests. ``serialize`` gives the bytes of a record,
the source headers and digest among its header lines.

Record ids are UUID URNs made from a digest of what they identify (page id, URI,
payload digest and kind of record), so a repeated run gives the same ids and
links. Rows equal in all of these are one response stored twice; they share ids.

Rows: a null url is an empty URI, a null html an empty payload (the records are
made all the same, with the digests of nothing). Extra columns are left out.
"""

from __future__ import annotations

import html as references

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import text_batches

HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
VERSION = "WARC/1.0"

# What doesn't show: comments, scripts, styles, the head; then all other tags. Unended ones go on to the end. A quote
# counts at the start of an attribute's value only, and keeps a > inside it from ending the tag.
_REST = r"""[^>=]*+(?:=[\s]*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+"""
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style|noscript|template|head)(?:\s" + _REST + r")?>.*?(?:</(?:script|style|noscript|template|head)\s*>|\z)"
_BREAK = r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|aside|blockquote|pre|form)(?:[\s/]" + _REST + ")?>"
_TAG = r"</?[a-zA-Z]" + _REST + r"(?:>|\z)|<![^>]*+(?:>|\z)"

#: White space that a reference may stand for, no-break space included.
_SPACES = str.maketrans(dict.fromkeys("\t\n\f\r\xa0", " "))


def _decoded(text: str | None) -> str | None:
    """All named and numeric character references replaced, each once, as HTML5 reads them."""
    if text is None or "&" not in text:
        return text
    parts = text.split("\n")  # line ends of blocks; a reference to one is white space
    return "\n".join(references.unescape(p).translate(_SPACES) if "&" in p else p for p in parts)


def plain_text(html: Column) -> Column:
    """Visible text: a line for each block, single spaces inside lines, no empty lines."""

    @F.pandas_udf("string")
    def decoded(texts: pd.Series) -> pd.Series:
        return texts.map(_decoded)

    # White space is matched only where something changes, as most of it is single spaces.
    out = F.regexp_replace(html, _HIDDEN, " ")
    out = F.regexp_replace(F.regexp_replace(out, r"[\r\n\t][\r\n\t ]*+| [\r\n\t ]++", " "), _BREAK, "\n")
    out = F.regexp_replace(out, _TAG, "")
    out = decoded(out)
    out = F.regexp_replace(F.regexp_replace(out, "[ ]{2,}", " "), " \n[ \n]*+|\n[ \n]++", "\n")
    return F.btrim(out, F.lit(" \n"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(F.encode(text, "UTF-8")))


def _urn(*what: Column) -> Column:
    h = F.md5(F.encode(F.concat_ws("\n", *what), "UTF-8"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def responses(pages: DataFrame) -> DataFrame:
    """Response records: page_id, uri, payload, http_head, payload_digest, record_id."""
    got = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    return got.withColumns({
        "http_head": F.concat(F.lit(HTTP_HEAD), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n")),
        "payload_digest": _digest(F.col("payload")),
    }).withColumn("record_id", _urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "uri", "payload_digest"))


def derive(source: DataFrame) -> DataFrame:
    """A metadata and a conversion record of each response.

    record_type, record_id, refers_to, target_uri, content_type, source_headers,
    source_digest, block, block_digest, payload_digest (conversion only; the
    metadata block has no payload of its own), content_length; page_id goes along.
    """
    text_batches(source.sparkSession)
    text = source.withColumn("text", plain_text(F.col("payload")))
    facts = F.concat_ws(
        "\r\n",
        F.concat(F.lit("source-digest: "), "payload_digest"),
        F.concat(F.lit("source-content-length: "), F.octet_length("payload").cast("string")),
        F.concat(F.lit("text-length: "), F.length("text").cast("string")),
        F.lit(""),
    )
    made = text.select("*", F.explode(F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), facts.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )).alias("r"))
    block = F.col("r.block")
    made = made.withColumn("digest", _digest(block))
    return made.select(
        "page_id",
        F.col("r.record_type").alias("record_type"),
        _urn(F.col("r.record_type"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        F.col("uri").alias("target_uri"),
        F.col("r.content_type").alias("content_type"),
        F.col("http_head").alias("source_headers"),
        F.col("payload_digest").alias("source_digest"),
        block.alias("block"),
        F.col("digest").alias("block_digest"),
        F.when(F.col("r.record_type") == "conversion", F.col("digest")).alias("payload_digest"),
        F.octet_length(block).cast("long").alias("content_length"),
    )


def serialize(records: DataFrame, date: str) -> DataFrame:
    """``record`` (binary): header lines, an empty line, the block, two line ends; ``date`` is the WARC-Date.

    The source's digest and its headers, each a Source-Header line, stand after the headers that WARC names.
    """
    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))

    kept = F.filter(F.split("source_headers", "\r\n"), lambda x: x != "")
    source = F.array_join(F.transform(kept, lambda x: F.concat(F.lit("Source-Header: "), x, F.lit("\r\n"))), "")
    head = F.concat(
        F.lit(VERSION + "\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.lit(date)),
        line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Payload-Digest", F.col("payload_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
        line("Source-Digest", F.col("source_digest")), F.coalesce(source, F.lit("")),
    )
    return records.withColumn("record", F.encode(F.concat(head, F.lit("\r\n"), "block", F.lit("\r\n\r\n")), "UTF-8"))
