"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Every step is a column expression: tags, scripts and comments go by regular expressions, so the rows never leave the JVM
and nothing is shuffled. A response gives two records, each with an identifier of its own, WARC-Refers-To the response, its
target URI, date and digests:

- metadata (application/warc-fields): the response's headers, digests and what the page itself says (title, language,
  numbers of links and characters), and the identifier of the conversion;
- conversion (text/plain): the text of the page, blocks on lines of their own, entities as characters.

write_warc() writes records as gzipped WARC text through Spark's committer.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import prepare

CRAWL_DATE = "1970-01-01T00:00:00Z"

# Elements that begin a line, names of entities.
BLOCKS = (
    "address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html"
    "|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul"
)
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "#34": '"', "#60": "<", "#62": ">", "#160": " ",
    "copy": "©", "reg": "®", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "sect": "§", "deg": "°", "times": "×",
    "#38": "&", "amp": "&",
}

#: What no reader sees, in one pattern, so that whichever opens first closes first: a comment in a script does not hide the page.
_RAW = "|".join(rf"{name}(?=[\s/>])[^>]*>.*?(?:</{name}(?=[\s/>])[^>]*>|\z)" for name in ("script", "style", "noscript"))
HIDDEN = rf"(?is)<(?:!--(?:-?>|.*?(?:--!?>|\z))|{_RAW})"
#: A reference at the beginning of what follows an ampersand: 1 decimal, 2 hexadecimal, 3 name.
REFERENCE = r"^(?:#0*([0-9]+);?|#[xX]0*([0-9A-Fa-f]+);?|([A-Za-z][A-Za-z0-9]*);)"
#: All named characters of HTML, the frequent ones first, and what numbers 128 to 159 stand for. No-break spaces are blanks here.
NAMED = {name: "" for name in ("amp", "nbsp", "lt", "gt", "quot", "apos")} | {n[:-1]: c for n, c in html5.items() if n.endswith(";")}
NAMED |= {"nbsp": " ", "NonBreakingSpace": " "}
WINDOWS_1252 = "".join(bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(128, 160))

#: (pattern, replacement) of the SQL, applied in this order, for pages without openings inside one another. The last two are those of
#: plain_text too; written so that Java's and RE2's engines agree.
STEPS = (
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    (r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)", ""),
    (r"(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)", ""),
    (r"(?is)<noscript\b[^>]*>.*?(?:</noscript\s*>|\z)", ""),
    (rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n"),
    (r"<[A-Za-z/!?][^>]*>", ""),
)
SPACES = ((r"[\x20\x09\x0B\x0C\x0D]+", " "), (r"\x20?\n[\x20\n]*", "\n"), (r"^[\x20\n]+|[\x20\n]+$", ""))

#: The steps with tags, the words of BLOCKS by their first letters: the same for Java's engine in less time.
_LETTERS = "|".join(
    rf"{letter}(?:{'|'.join(word[1:] for word in BLOCKS.split('|') if word[0] == letter)})" for letter in dict.fromkeys(w[0] for w in BLOCKS.split("|"))
)
TAGS = ((rf"(?i)</?(?:{_LETTERS})\b[^>]*>", "\n"), STEPS[-1])
#: The first of SPACES without what it would leave as it is, a blank by itself.
BLANKS = (r"[\x09\x0B\x0C\x0D][\x20\x09\x0B\x0C\x0D]*|\x20[\x20\x09\x0B\x0C\x0D]+", " ")
#: What `$` also stands before at the end of a text in Java's engine, carriage returns apart.
LINE_ENDS = ("\u0085", "\u2028", "\u2029")

SCHEMA = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, payload_digest string, header string, block string"
)


def uuid_of(*parts: Column) -> Column:
    """A name-based identifier: the same input always gives the same urn."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    pieces = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces, F.substring(h, 21, 12)), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str = CRAWL_DATE) -> DataFrame:
    """Response records of a table (page_id, url, html): page_id, record_id, target_uri, warc_date, content_type, http, payload and
    digests. A null page is an empty payload, a null url an empty target."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html), F.lit("\r\n\r\n"))
    rows = pages.select("page_id", url.alias("target_uri"), html.alias("payload"), http.alias("http"))
    return rows.select(
        "page_id", uuid_of(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"), F.sha2("payload", 256)).alias("record_id"),
        "target_uri", F.lit(date).alias("warc_date"), F.lit("application/http; msgtype=response").alias("content_type"), "http", "payload",
        digest(F.col("payload")).alias("payload_digest"), digest(F.concat("http", "payload")).alias("block_digest"),
    )


def character(code: Column) -> Column:
    """The character of a number, as browsers take it."""
    wrong = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(wrong, F.lit("\ufffd")).when(code == 160, F.lit(" "))
        .when(code.between(128, 159), F.substr(F.lit(WINDOWS_1252), (code - 127).cast("int"), F.lit(1))).otherwise(plain)
    )


def decoded(text: Column) -> Column:
    """References as characters, each once: what a reference gives is not read again. Unknown names stay."""
    named = F.str_to_map(F.lit("\x01".join(f"{n}\x02{c}" for n, c in NAMED.items())), F.lit("\x01"), F.lit("\x02"))

    def one(part: Column) -> Column:
        decimal, hexadecimal, name = (F.regexp_extract(part, REFERENCE, k) for k in (1, 2, 3))
        beyond = F.lit("\ufffd")
        to = (
            F.when(name != "", F.element_at(named, name))
            .when(decimal != "", F.when(F.length(decimal) > 7, beyond).otherwise(character(decimal.cast("bigint"))))
            .when(hexadecimal != "", F.when(F.length(hexadecimal) > 6, beyond).otherwise(character(F.conv(hexadecimal, 16, 10).cast("bigint"))))
        )
        return F.coalesce(F.concat(to, F.regexp_replace(part, REFERENCE, "")), F.concat(F.lit("&"), part))

    parts = F.split(text, "&", -1)
    joined = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def untagged(html: Column) -> Column:
    for pattern, to in ((HIDDEN, ""), *TAGS):
        html = F.regexp_replace(html, pattern, to)
    return html


def spaced(text: Column) -> Column:
    for pattern, to in (BLANKS, SPACES[1]):
        text = F.regexp_replace(text, pattern, to)
    return text


def plain_text(html: Column) -> Column:
    return trimmed(spaced(decoded(untagged(html))))


def with_plain_text(rows: DataFrame, html: str, name: str) -> DataFrame:
    """plain_text() as a column, in projections one after the other: some steps name their input more than once, and in one expression
    what lies below them would be done again for each."""
    rows = rows.withColumn(name, untagged(F.col(html)))
    for step in (decoded, spaced, trimmed):
        rows = rows.withColumn(name, step(F.col(name)))
    return rows


def trimmed(text: Column) -> Column:
    """The last of SPACES, by expression unless the text ends in a separator of lines."""
    return F.when(F.right(text, F.lit(1)).isin(*LINE_ENDS), F.regexp_replace(text, *SPACES[-1])).otherwise(F.btrim(text, F.lit(" \n")))


def first(text: str, pattern: str) -> Column:
    return F.regexp_replace(F.regexp_extract(text, pattern, 1), r"[\x20\x09-\x0D]+", " ")


def header(kind: str, record: str, concurrent: str | None, content_type: str) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), F.col(record))]
    lines += [F.concat(F.lit("WARC-Refers-To: "), F.col("record_id")), F.concat(F.lit("WARC-Target-URI: "), F.col("target_uri"))]
    lines += [F.concat(F.lit("WARC-Date: "), F.col("warc_date"))]
    if concurrent:
        lines.append(F.concat(F.lit("WARC-Concurrent-To: "), F.col(concurrent)))
    lines += [F.concat(F.lit("WARC-Block-Digest: "), F.col(f"{kind}_digest")), F.lit(f"Content-Type: {content_type}")]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(f"{kind}_block"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def derived(source: DataFrame) -> DataFrame:
    """SCHEMA: a metadata and a conversion record for each response, in this order.

    A page without text has a conversion with an empty block. Repeated responses give equal records again. payload_digest is
    the response's, block_digest the record's own.
    """
    prepare(source.sparkSession)
    text = with_plain_text(source, "payload", "conversion_block")
    ids = text.select(
        "*", uuid_of(F.lit("metadata"), F.col("record_id")).alias("metadata_id"), uuid_of(F.lit("conversion"), F.col("record_id")).alias("conversion_id"),
        digest(F.col("conversion_block")).alias("conversion_digest"),
        first("payload", r"(?is)<title\b[^>]*>(.*?)</title").alias("title"),
        first("payload", r"(?is)<html\b[^>]*\blang=[\"']?([A-Za-z-]+)").alias("language"),
        F.regexp_count("payload", F.lit(r"(?i)<a\b[^>]*\bhref=")).alias("links"),
    )
    fields = {
        "source-content-type": "content_type", "source-payload-digest": "payload_digest", "source-block-digest": "block_digest",
        "conversion-record": "conversion_id", "conversion-digest": "conversion_digest", "title": "title", "language": "language",
    }
    lines = [F.concat(F.lit(f"{name}: "), F.col(column)) for name, column in fields.items()]
    lines += [F.concat(F.lit("outlinks: "), F.col("links")), F.concat(F.lit("text-characters: "), F.length("conversion_block"))]
    lines += [F.concat(F.lit("http-"), F.replace(F.rtrim(F.replace("http", F.lit("\r\n\r\n"), F.lit(""))), F.lit("\r\n"), F.lit("\r\nhttp-")))]
    both = ids.withColumn("metadata_block", F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n"))).drop("payload", "http", "title", "language", "links")
    both = both.withColumn("metadata_digest", digest(F.col("metadata_block")))

    def record(kind: str, concurrent: str | None, content_type: str) -> Column:
        return F.struct(
            F.lit(kind).alias("record_type"), F.col(f"{kind}_id").alias("id"), F.lit(content_type).alias("type"), F.col(f"{kind}_digest").alias("digest"),
            header(kind, f"{kind}_id", concurrent, content_type).alias("header"), F.col(f"{kind}_block").alias("block"),
        )

    made = both.select(
        "page_id", "record_id", "target_uri", "warc_date", "payload_digest",
        F.explode(F.array(record("metadata", "conversion_id", "application/warc-fields"), record("conversion", None, "text/plain"))).alias("r"),
    )
    return made.select(
        "page_id", "r.record_type", F.col("r.id").alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
        F.col("r.type").alias("content_type"), F.octet_length("r.block").cast("long").alias("content_length"), F.col("r.digest").alias("block_digest"),
        "payload_digest", "r.header", "r.block",
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Gzipped WARC files, header, block and two line ends for each record."""
    record = F.concat("header", "block").alias("value")
    records.select(record).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


def op9_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    return derived(responses(table(spark, sf_dir, "pages")))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same records in DuckDB SQL."""
    text = "payload"
    for pattern, to in STEPS:
        text = f"regexp_replace({text}, {sql_text(pattern)}, {sql_text(to) if to else chr(39) * 2}, 'g')"
    for name, to in ENTITIES.items():
        text = f"replace({text}, {sql_text('&' + name + ';')}, {sql_text(to)})"
    for pattern, to in SPACES:
        text = f"regexp_replace({text}, {sql_text(pattern)}, {sql_text(to)}, 'g')"

    def urn(parts: str) -> str:
        h = f"sha256({parts})"
        return f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-8' || {h}[14:16] || '-8' || {h}[18:20] || '-' || {h}[21:32] || '>'"

    squeeze = lambda value: f"regexp_replace({value}, '[\\x20\\x09-\\x0D]+', ' ', 'g')"
    crlf = "chr(13) || chr(10)"
    head = lambda kind, more, content: (
        f"'WARC/1.1' || {crlf} || 'WARC-Type: {kind}' || {crlf} || 'WARC-Record-ID: ' || {kind}_id || {crlf} || 'WARC-Refers-To: ' || record_id || {crlf} "
        f"|| 'WARC-Target-URI: ' || target_uri || {crlf} || 'WARC-Date: ' || warc_date || {crlf} {more} || 'WARC-Block-Digest: ' || {kind}_digest || {crlf} "
        f"|| 'Content-Type: {content}' || {crlf} || 'Content-Length: ' || strlen({kind}_block) || {crlf} || {crlf}"
    )
    row = lambda kind, more, content: (
        f"SELECT page_id, '{kind}' AS record_type, {kind}_id AS record_id, record_id AS refers_to, target_uri, warc_date, '{content}' AS content_type, "
        f"strlen({kind}_block)::BIGINT AS content_length, {kind}_digest AS block_digest, payload_digest, {head(kind, more, content)} AS header, "
        f"{kind}_block AS block FROM described"
    )
    return f"""
WITH source AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, '{CRAWL_DATE}' AS warc_date,
    'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(coalesce(html, '')) AS http
  FROM pages
), responses AS (
  SELECT *, {urn("'response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || target_uri || chr(10) || sha256(payload)")} AS record_id,
    'sha256:' || sha256(payload) AS payload_digest, 'sha256:' || sha256(http || {crlf} || {crlf} || payload) AS block_digest,
    {text} AS conversion_block
  FROM source
), named AS (
  SELECT *, {urn("'metadata' || chr(10) || record_id")} AS metadata_id, {urn("'conversion' || chr(10) || record_id")} AS conversion_id,
    'sha256:' || sha256(conversion_block) AS conversion_digest
  FROM responses
), fields AS (
  SELECT *, 'source-content-type: application/http; msgtype=response' || {crlf} || 'source-payload-digest: ' || payload_digest || {crlf}
    || 'source-block-digest: ' || block_digest || {crlf} || 'conversion-record: ' || conversion_id || {crlf}
    || 'conversion-digest: ' || conversion_digest || {crlf}
    || 'title: ' || {squeeze("regexp_extract(payload, '(?is)<title" + chr(92) + "b[^>]*>(.*?)</title', 1)")} || {crlf}
    || 'language: ' || {squeeze("regexp_extract(payload, '(?is)<html" + chr(92) + "b[^>]*" + chr(92) + "blang=[" + chr(34) + chr(39) * 2 + "]?([A-Za-z-]+)', 1)")} || {crlf}
    || 'outlinks: ' || len(regexp_extract_all(payload, '(?i)<a\\b[^>]*\\bhref=')) || {crlf}
    || 'text-characters: ' || length(conversion_block) || {crlf} || 'http-' || replace(http, {crlf}, {crlf} || 'http-') || {crlf} AS metadata_block
  FROM named
), described AS (SELECT *, 'sha256:' || sha256(metadata_block) AS metadata_digest FROM fields)
{row("metadata", "|| 'WARC-Concurrent-To: ' || conversion_id || " + crlf, "application/warc-fields")}
UNION ALL {row("conversion", "", "text/plain")}
"""
