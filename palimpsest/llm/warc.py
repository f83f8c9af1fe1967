"""WARC derivatives: response records become linked metadata and plain-text conversion records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CRLF = "\r\n"
#: Entities that are decoded; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|nav|article|section|header|footer|title|body|head|html)\b[^>]*>"
TAGS = r"<[a-zA-Z/!][^>]*>"


def plain_text(html: Column) -> Column:
    """Visible text of a page: one line per block, runs of spaces as one, empty lines dropped."""
    out = F.regexp_replace(html, HIDDEN, " ")
    out = F.regexp_replace(out, r"[\r\n]+", " ")
    out = F.regexp_replace(out, BREAKS, "\n")
    out = F.regexp_replace(out, TAGS, "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t\x0B\f]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def named_id(*parts: Column) -> Column:
    """A record id that depends on nothing but its parts, so a retried task writes the same."""
    hex_ = F.sha2(F.concat_ws("|", *parts), 256)
    cut = [F.substring(hex_, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of fetched pages: record_id, target_uri, date, block (HTTP head and payload), and page_id.

    Null urls and pages are empty texts; rows that repeat a page get the same record.
    """
    uri, body = F.coalesce(F.col(url).cast("string"), F.lit("")), F.coalesce(F.col(html).cast("string"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF))
    return pages.select(
        F.col(page_id).alias("page_id"),
        named_id(F.lit("response"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), uri).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(head, body).alias("block"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """Two records per response: columns of `records` besides block, then warc_type, derived_id, refers_to,
    content_type, block (text), block_digest, source_digest (of the whole source block), payload_digest, headers (an array
    of the header lines).

    `records` has record_id, target_uri, date, block. The metadata record lists the source's status line,
    header lines and digests as warc-fields; the conversion record holds the payload as plain text. A null
    block is empty: no status, no headers and an empty text. A block without an empty line is all head.
    Repeated rows give repeated records. Columns of `records` named like the new ones are replaced. Nothing is shuffled.
    """
    new = ("block", "warc_type", "content_type", "derived_id", "refers_to", "block_digest", "source_digest", "payload_digest", "headers")
    records = records.drop(*[c for c in new if c != "block"])
    head, payload, kind = ("_" * (i + max(map(len, records.columns))) for i in (1, 2, 3))  # names that no column has
    block = F.coalesce(F.col("block"), F.lit(""))
    cut = F.instr(block, CRLF + CRLF)
    parts = records.withColumns({
        head: F.when(cut > 0, F.substring(block, F.lit(1), cut - 1)).otherwise(block),
        payload: F.when(cut > 0, F.expr("substring(block, instr(block, '\\r\\n\\r\\n') + 4)")).otherwise(""),
        "source_digest": F.concat(F.lit("sha256:"), F.sha2(block, 256)),
    }).withColumn("payload_digest", F.concat(F.lit("sha256:"), F.sha2(payload, 256)))
    lines = F.split(head, CRLF)
    fields = F.concat(
        F.lit("http-status: "), F.get(lines, F.lit(0)), F.lit(CRLF),
        F.array_join(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.concat(F.lit("http-header: "), x, F.lit(CRLF))), ""),
        F.lit("source-block-digest: "), F.col("source_digest"), F.lit(CRLF),
        F.lit("source-payload-digest: "), F.col("payload_digest"), F.lit(CRLF),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col(payload)).alias("block")),
    )
    kept = [F.col(f"`{c}`") for c in records.columns if c != "block"]
    out = parts.select(*kept, "source_digest", "payload_digest", F.explode(kinds).alias(kind)).select(*kept, "source_digest", "payload_digest", f"{kind}.*")
    out = out.withColumns({"derived_id": named_id(F.col("warc_type"), F.col("record_id")), "refers_to": F.col("record_id"), "block_digest": F.concat(F.lit("sha256:"), F.sha2("block", 256))})
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    return out.withColumn(
        "headers",
        F.array(
            F.lit("WARC/1.1"), header("WARC-Type", F.col("warc_type")), header("WARC-Record-ID", F.col("derived_id")), header("WARC-Refers-To", F.col("refers_to")),
            header("WARC-Target-URI", F.col("target_uri")), header("WARC-Date", F.col("date")), header("WARC-Block-Digest", F.col("block_digest")),
            header("Content-Type", F.col("content_type")), header("Content-Length", F.octet_length("block").cast("string")),
        ),
    )


def write_warc(derived: DataFrame, folder: str) -> None:
    """Writes the records as WARC files: Spark's text writer, whose line separator is the end of a record."""
    record = F.concat(F.array_join("headers", CRLF), F.lit(CRLF + CRLF), F.col("block"))
    derived.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).text(folder)
