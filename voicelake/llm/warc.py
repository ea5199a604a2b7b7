"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

Each response gives a metadata record (what it links to, its title, its
lengths) and a conversion record (its text). Both refer to the response's
record id, keep its target and date, name its payload digest, and carry a
digest of their own block. Record ids are name-based, from page, url, date and
payload, so reruns agree and captures of one page differ.

Plain text: comments, scripts, styles and tags go, block ends become line
breaks, all numeric and HTML5 named character references are resolved, blanks
are folded. Outlinks are the href of every ``a`` outside of comments and
scripts, in any case, place and quoting; title and outlinks are resolved too.

Defined results: a null url or html is empty; a response with no text gives
records with empty blocks; repeated rows are one capture and give its records
again, with the same ids; line breaks in header values are escaped; null ids pass
through; an empty table gives an empty result; further columns are dropped.
Bare pages have no capture: their date and HTTP headers are made up, and
``made_up`` says so in every row; a table with columns ``date`` and
``headers`` (a null is made up) brings its own.
"""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.sources.files import write_files

#: Captures made from bare pages carry one date; a capture table brings its own.
UNDATED = "1970-01-01T00:00:00Z"


def record_id(*parts: Column) -> Column:
    """urn:uuid made from an MD5 of the parts."""
    digest = F.md5(F.concat_ws("|", *parts))
    pieces = [F.substring(digest, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in ("script", "style", "title", "textarea")}
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_NAME_END, _STOP, _SPACE = re.compile(r"[\s/>]"), re.compile("[>=]"), re.compile(r"\s*")
_BREAKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 br tr table article nav title section header footer".split())
_IN_VALUE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*)[;=]?")


def _resolved(text: str) -> str:
    return unescape(text).replace("\xa0", " ") if "&" in text else text


def _unquoted(value: str) -> str:
    """An attribute's value; a reference without a semicolon counts only where neither = nor a letter follows, as in browsers."""
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        value = value[1:-1]
    found = lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]
    return _IN_VALUE.sub(found, value) if "&" in value else value


class Tags:
    """The tags of a page from left to right, found in time that grows with its length, whatever is left open.

    A tag ends at the first > outside of quoted values; a < that starts none is text. What a search has shown to be
    missing from some place on is kept, and so are the = after which no tag ends.
    """

    def __init__(self, html: str):
        self.html, self.next, self.missing, self.failed = html, {}, {}, set()

    def _find(self, what: str, at: int) -> int:
        """The place of a string, or -1, which is searched for once."""
        if at >= self.missing.get(what, len(self.html) + 1):
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    def _next(self, what: re.Pattern, at: int) -> int:
        """The next place of a class of characters, or the end, which is walked to once."""
        start, stop = self.next.get(what, (-1, -1))
        if not start <= at <= stop:
            found = what.search(self.html, at)
            stop = found.start() if found else len(self.html)
            self.next[what] = at, stop
        return stop

    def _end(self, at: int) -> int:
        """The > that ends a tag whose attributes begin here, or -1."""
        html, passed = self.html, []
        while True:
            at = self._next(_STOP, at)
            if at >= len(html) or at in self.failed:
                self.failed.update(passed)
                return -1
            if html[at] == ">":
                return at
            passed.append(at)
            at = _SPACE.match(html, at + 1).end()
            if html[at : at + 1] in ("'", '"') and (close := self._find(html[at], at + 1)) >= 0:
                at = close + 1

    def following(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, lower-case name, attributes) of the next tag; comments and declarations have no name."""
        html, start = self.html, self._find("<", at)
        while start >= 0:
            if html.startswith("<!--", start) and (end := self._find("-->", start + 4)) >= 0:
                return start, end + 3, False, "", ""
            closing = html[start + 1 : start + 2] == "/"
            first = start + 1 + closing
            if html[first : first + 1] in _LETTERS and (end := self._end(last := self._next(_NAME_END, first))) >= 0:
                return start, end + 1, closing, html[first:last].lower(), html[last:end]
            if (closing or html[start + 1 : start + 2] in ("!", "?")) and (end := self._find(">", start + 2)) >= 0:
                return start, end + 1, False, "", ""
            start = self._find("<", start + 1)
        return None

    def close(self, name: str, at: int) -> tuple[int, int] | None:
        """Start and end of the tag that ends a raw element, of which nothing else does."""
        if at >= self.missing.get(name + ">", len(self.html) + 1):
            return None
        found = _RAW[name].search(self.html, at)
        end = self._find(">", found.end()) if found else -1
        if end < 0:
            self.missing[name + ">"] = at
            return None
        return found.start(), end + 1


def parsed(html: str) -> tuple[str, list[str], str]:
    """Title, outlinks and plain text of a page; a script or style that is not ended takes the rest."""
    title, links, out, at, tags = None, [], [], 0, Tags(html)
    while tag := tags.following(at):
        start, end, closing, name, attributes = tag
        out.append(_resolved(html[at:start]))
        at = end
        if not name:
            out.append(" " if html.startswith("<!--", start) else "")
            continue
        if name in _BREAKS:
            out.append("\n")
        if closing:
            continue
        if name == "a":
            href = next((value for key, value in _ATTRIBUTE.findall(attributes) if key.lower() == "href"), None)
            if href is not None:
                links.append(re.sub(r"[\t\r\n]", "", _unquoted(href)))
        elif name in _RAW:
            last = tags.close(name, at)
            if name in ("script", "style"):
                out.append(" ")
                at = last[1] if last else len(html)
            elif last:  # references count in here, tags do not
                inside = html[at : last[0]]
                title = _resolved(inside) if name == "title" and title is None else title
                out.append(_resolved(inside))
                at = last[0]
    out.append(_resolved(html[at:]))
    text = re.sub(r"[ \t\r\f]+", " ", "".join(out))
    return re.sub(r"[ \t\r\n\f]+", " ", title or "").strip(" "), links, re.sub(r" ?\n[ \n]*", "\n", text).strip(" \n")


_PARSED = "struct<title:string,links:array<string>,text:string>"


def _pages(payload: pa.Array) -> pa.Array:
    found = [parsed(html.as_py() or "") for html in payload]
    kinds = (pa.string(), pa.list_(pa.string()), pa.string())
    columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
    return pa.StructArray.from_arrays(columns, ["title", "links", "text"])


def responses(pages: DataFrame) -> DataFrame:
    """Pages as responses: page_id, record_id, target, date, http headers, payload, and whether date or headers are made up."""
    url, html = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html), F.lit("\r\n\r\n"))
    own = lambda name: F.col(name).cast("string") if name in pages.columns else F.lit(None).cast("string")
    date = F.coalesce(own("date"), F.lit(UNDATED))
    identity = record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, date, digest(html))
    return pages.select(
        "page_id", identity.alias("record_id"), url.alias("target"), date.alias("date"), F.coalesce(own("headers"), headers).alias("headers"),
        html.alias("payload"), (own("date").isNull() | own("headers").isNull()).alias("made_up"),
    )


def derivatives(captures: DataFrame) -> DataFrame:
    """Two rows a response: page_id, kind, record_id, refers_to, target, date, source_headers, made_up, payload_digest, block_digest, block_bytes, block."""
    page = F.arrow_udf(_pages, _PARSED)("payload")
    captures = captures.withColumn("_page", page)
    links, text = F.col("_page.links"), F.col("_page.text")
    metadata = F.concat(F.lit("title: "), F.col("_page.title"), F.lit("\nlinks: "), F.size(links), F.lit("\n"), F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), x, F.lit("\n"))), ""))
    both = F.explode(F.array(F.struct(F.lit("metadata").alias("kind"), metadata.alias("block")), F.struct(F.lit("conversion").alias("kind"), text.alias("block"))))
    rows = captures.withColumn("_d", both)
    return rows.select(
        "page_id", F.col("_d.kind").alias("kind"), record_id(F.col("_d.kind"), F.col("record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target", "date",
        F.col("headers").alias("source_headers"), "made_up", digest(F.col("payload")).alias("payload_digest"), digest(F.col("_d.block")).alias("block_digest"),
        F.octet_length("_d.block").cast("long").alias("block_bytes"), F.col("_d.block").alias("block"),
    )


def record_text(kind: str = "kind") -> Column:
    """A derivative as WARC text: header lines, those of the source as WARC-Source-Header, and block."""
    flat = lambda value, blank: F.regexp_replace(value, r"[\r\n]", blank)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), flat(value, " "), F.lit("\r\n"))
    mime = F.when(F.col(kind) == "conversion", "text/plain").otherwise("application/warc-fields")
    source = F.filter(F.split("source_headers", r"\r?\n"), lambda x: x != "")
    target = F.replace(F.replace(F.col("target"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.col(kind)), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", target),
        line("WARC-Date", F.col("date")), line("WARC-Payload-Digest", F.col("payload_digest")), line("WARC-Block-Digest", F.col("block_digest")),
        F.array_join(F.transform(source, lambda x: line("WARC-Source-Header", x)), ""), line("Content-Type", mime), line("Content-Length", F.col("block_bytes").cast("string")),
    )
    return F.concat(head, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n"))


def write_warc(derived: DataFrame, path: str) -> None:
    """Writes records below the folder ``path``, each a gzip member of its own, in one file records.warc.gz a task.

    Beside each lies records.idx, a JSON line a record: record_id, offset and length of its member.
    """
    write_files(derived.select("record_id", record_text().cast("binary").alias("record")), path, _write_members)


def _write_members(batches: Iterator[pa.RecordBatch], create) -> None:
    files = None
    for batch in batches:
        for name, record in zip(batch.column("record_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
            files = files or (create("records.warc.gz"), create("records.idx"))
            member, at = gzip.compress(record, mtime=0), files[0].tell()
            files[0].write(member)
            files[1].write((json.dumps({"record_id": name, "offset": at, "length": len(member)}) + "\n").encode())
    for file in files or ():
        file.close()


def op10_derivatives(spark, sf_dir):
    return derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


#: The SQL twin's character references, ampersand last, and its one form of link: those of the given tables. The operator knows all.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _resolved_sql(column: str) -> str:
    for name, value in REFERENCES:
        column = f"replace({column}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    return column


_TEXT_SQL = r"regexp_replace(coalesce(html, ''), '<!--.*?-->', ' ', 'gs')"
_TEXT_SQL = rf"regexp_replace({_TEXT_SQL}, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis')"
_TEXT_SQL = rf"regexp_replace({_TEXT_SQL}, '</?(p|div|li|ul|ol|h[1-6]|br|tr|table|article|nav|title|section|header|footer)(\s[^>]*)?/?>', chr(10), 'gi')"
_TEXT_SQL = rf"regexp_replace({_TEXT_SQL}, '<[^>]*>', '', 'g')"
_TEXT_SQL = rf"regexp_replace(regexp_replace(regexp_replace({_resolved_sql(_TEXT_SQL)}, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
_ID_SQL = "'<urn:uuid:' || substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12) || '>'"
OP10_SQL = rf"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS target, coalesce(html, '') AS payload, md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|{UNDATED}|sha256:' || sha256(coalesce(html, ''))) AS m,
         regexp_extract_all(coalesce(html, ''), '<a href="([^"]*)"', 1) AS links, {_TEXT_SQL} AS plain FROM pages
), s AS (
  SELECT *, {_ID_SQL.format("m")} AS refers_to FROM r
), d AS (
  SELECT *, 'metadata' AS kind, 'title: ' || trim(regexp_replace({_resolved_sql("regexp_extract(payload, '<title>(.*?)</title>', 1, 's')")}, '[ \t\r\n\f]+', ' ', 'g')) || chr(10) || 'links: ' || len(links) || chr(10)
         || coalesce(list_aggregate(list_transform(links, lambda x: 'outlink: ' || {_resolved_sql('x')} || chr(10)), 'string_agg', ''), '') AS block FROM s
  UNION ALL SELECT *, 'conversion', plain FROM s
)
SELECT page_id, kind, {_ID_SQL.format("md5(kind || '|' || refers_to)")} AS record_id, refers_to, target, '{UNDATED}' AS date,
       'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(payload)) || chr(13) || chr(10) || chr(13) || chr(10) AS source_headers,
       true AS made_up, 'sha256:' || sha256(payload) AS payload_digest, 'sha256:' || sha256(block) AS block_digest, CAST(octet_length(encode(block)) AS BIGINT) AS block_bytes, block
FROM d
"""
