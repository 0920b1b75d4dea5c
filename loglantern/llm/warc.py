"""WARC derivatives: each response record gives a metadata and a plain-text conversion record.

Both refer to the response by WARC-Refers-To and carry its target, date, content type and
payload digest on. All of it is column arithmetic on one row, so there is no shuffle.

Defined cases: a null or empty payload gives empty blocks with the digest of nothing; a null
target leaves its header out. Repeated rows give repeated, equally named records. Unclosed
scripts and comments run to the end of the payload. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = "\r\n"

#: Named character references that are read; others stay as they are.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®",
    "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "laquo": "«", "raquo": "»",
}

#: A reference, after its ``&``: decimal, hexadecimal or a name.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"

#: What is no text at all, tags that end a line, other tags, blanks in a line.
HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script[^>]*>|\z)|style\b.*?(?:</style[^>]*>|\z))"
BREAKS = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|"
    r"pre|section|table|td|th|title|tr|ul)\b[^>]*>"
)
TAGS = r"</?[A-Za-z!][^>]*>"
SPACES = "[\\x20\\t\\r\\f\\x0b ]+"
#: The same, but for single blanks, which stay as they are: far fewer places to rewrite.
RUNS = "\\x20[\\x20\\t\\r\\f\\x0b ]+|[\\t\\r\\f\\x0b ][\\x20\\t\\r\\f\\x0b ]*"
LINE_ENDS = r"\x20*\n[\x20\n]*"
#: A link with the quote before it, if it has one.
LINKS = r"(?i)<a\s[^>]*?href\s*=\s*([\"'][^\"'>]*|[^\s\"'>]+)"
TITLE = r"(?is)<title[^>]*>(.*?)</title"

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """``sha1:`` and the base-32 digest that web archives use, from hexadecimal digits."""
    fives = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32))


def record_id(*parts: Column) -> Column:
    """A name that is the same on every run."""
    h = F.md5(F.concat_ws("\x01", *[F.coalesce(p.cast("string"), F.lit("\x02")) for p in parts]))
    cuts = [F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def unescaped(text: Column) -> Column:
    """Reads numeric and the common named character references, each once.

    What follows an ``&`` is read on its own, so texts without one cost nothing and what a
    reference gives is not read again.
    """
    signs = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair], F.lit("amp"), F.lit("&"))

    def read(piece: Column) -> Column:
        name = F.regexp_extract(piece, REFERENCE, 1)
        number = F.when(F.substring(name, 2, 1).isin("x", "X"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).cast("int")
        good = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        sign = F.when(name.startswith("#"), F.when(good, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))).otherwise(F.try_element_at(signs, name))
        return F.coalesce(F.concat(sign, F.substring(piece, F.length(name) + 2, F.length(piece))), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&", -1)
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), read)
    return F.when(text.contains("&"), F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))).otherwise(text)


def with_text(records: DataFrame, html: str, into: str) -> DataFrame:
    """Adds the visible text of a page: one line per block, blanks collapsed.

    Each step is a column of its own, so that what several branches of the next one ask for
    is made once.
    """
    shown = F.replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " "), F.lit("\n"), F.lit(" "))
    flat = F.regexp_replace(F.regexp_replace(shown, BREAKS, "\n"), TAGS, "")
    tidy = F.regexp_replace(F.regexp_replace(F.col(into), RUNS, " "), LINE_ENDS, "\n")
    return records.withColumn(into, flat).withColumn(into, unescaped(F.col(into))).withColumn(into, F.trim(tidy, F.lit(" \n")))


def responses(pages: DataFrame, date: str, server_type: str = "text/html; charset=utf-8") -> DataFrame:
    """Response records of crawled pages (page_id, url, html): source headers, digests and payload."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: {server_type}{LINE}Content-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit(LINE + LINE),
    )
    hashed = pages.select(
        "page_id",
        record_id(F.col("page_id"), F.col("url"), F.col("html")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit(server_type).alias("source_type"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
        F.sha1(F.concat(http, payload).cast("binary")).alias("block_digest"),
        payload.alias("payload"),
    )
    return hashed.withColumns({c: base32(F.col(c)) for c in ("payload_digest", "block_digest")})


def _fields(*pairs: tuple[str, Column]) -> Column:
    """Header lines of those fields that are not null."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(LINE)) for name, value in pairs])


def derivatives(records: DataFrame) -> DataFrame:
    """Two records per response: its metadata and its plain text, with headers, digest and block."""
    links = F.regexp_extract_all(F.col("payload"), F.lit(LINKS), F.lit(1))
    title = F.trim(F.regexp_replace(unescaped(F.col("raw_title")), "[\\x20\\t\\r\\n\\f\\x0b ]+", " "))
    metadata = F.concat(
        _fields(
            ("source-content-type", F.col("source_type")),
            ("source-payload-digest", F.col("payload_digest")),
            ("source-block-digest", F.col("block_digest")),
            ("source-length", F.octet_length("payload")),
            ("title", title),
        ),
        F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), F.ltrim(x, F.lit("\"'")), F.lit(LINE))), ""),
    )
    read = with_text(records, "payload", "conversion").withColumn("raw_title", F.regexp_extract("payload", TITLE, 1))
    made = read.withColumn("metadata", metadata)
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), F.col("metadata").alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("conversion").alias("block")),
    )
    both = made.select(
        "page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "source_type",
        F.col("payload_digest").alias("source_payload_digest"), F.explode(kinds).alias("made"),
    ).select("*", "made.*").drop("made")
    named = both.withColumns(
        {
            "record_id": record_id(F.col("refers_to"), F.col("warc_type")),
            "content_length": F.octet_length("block").cast("long"),
            "block_digest": F.sha1(F.col("block").cast("binary")),
        }
    ).withColumn("block_digest", base32(F.col("block_digest")))
    header = F.concat(
        F.lit("WARC/1.1" + LINE),
        _fields(
            ("WARC-Type", F.col("warc_type")),
            ("WARC-Record-ID", F.col("record_id")),
            ("WARC-Refers-To", F.col("refers_to")),
            ("WARC-Target-URI", F.col("target_uri")),
            ("WARC-Date", F.col("date")),
            ("WARC-Source-Content-Type", F.col("source_type")),
            ("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
            ("WARC-Block-Digest", F.col("block_digest")),
            ("Content-Type", F.col("content_type")),
            ("Content-Length", F.col("content_length")),
        ),
        F.lit(LINE),
    )
    return named.withColumn("header", header)


def serialised(records: DataFrame) -> DataFrame:
    """The bytes of each record as an archive holds them, ready for ``write.text`` or a sink of bytes."""
    whole = F.concat(F.col("header"), F.col("block"), F.lit(LINE + LINE)).cast("binary")
    return records.select("page_id", "warc_type", "record_id", whole.alias("record"))


def parsed(archive: DataFrame) -> DataFrame:
    """Reads serialised records back: header fields and block."""
    text = F.decode("record", "UTF-8")
    header = F.substring_index(text, LINE + LINE, 1)

    def field(name: str) -> Column:
        found = F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)", 1)
        return F.when(found != "", found)

    length = field("Content-Length").cast("int")
    start = F.octet_length(header) + 5
    return archive.select(
        "page_id",
        field("WARC-Type").alias("warc_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Block-Digest").alias("block_digest"),
        F.decode(F.col("record").substr(start, length), "UTF-8").alias("block"),
    )
