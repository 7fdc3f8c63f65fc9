"""Documents of any format as blocks: what each row says of itself tells its parser.

A row has what a source fetched (``FIELDS``; columns that are absent are null).  Its
media type, or the end of its file name (else of its address), tells the format; what
neither tells is plain text.  Bytes of a textual format are read as UTF-8.  The title
is the source's, else the one that the parser found, else the first heading, else the
file name without its ending, else "Untitled".

Defined results: a document without content, one of a binary format without bytes, one
that its parser cannot read and one that gives no blocks have an ``error``, no title and
no blocks, and are no other document's matter.  PDF files have a format and an error,
for no library that reads them is here.  A media type of tab-separated values means
tabs, whatever the name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import office
from . import parsing as R

FIELDS = {"title": "string", "author": "string", "media_type": "string", "filename": "string", "source_uri": "string", "content_text": "string", "content_bytes": "binary"}
PARSED = f"format string, title string, author string, page_count int, error string, blocks array<{R.BLOCK}>"
TABS = "text/tab-separated-values"
#: Fixed: formats in the order in which they are tried, by media type (those of Office files by a part of it) and by ending.
FORMATS = {
    "pdf": (lambda m: m == "application/pdf", (".pdf",)),
    "docx": (lambda m: "wordprocessingml" in m, (".docx",)),
    "pptx": (lambda m: "presentationml" in m, (".pptx",)),
    "xlsx": (lambda m: "spreadsheetml" in m, (".xlsx", ".xlsm")),
    "html": (lambda m: m in ("text/html", "application/xhtml+xml"), (".html", ".htm")),
    "markdown": (lambda m: m == "text/markdown", (".md", ".markdown")),
    "csv": (lambda m: m in ("text/csv", TABS), (".csv", ".tsv")),
}
BINARY = ("pdf", "docx", "pptx", "xlsx")


class ParseError(ValueError):
    """A document that gives no blocks."""


def plain_type(media_type: str | None) -> str:
    """A media type without its parameters."""
    return (media_type or "").split(";")[0].strip().lower()


def format_of(media: str, name: str) -> str:
    return next((f for f, (is_type, ends) in FORMATS.items() if is_type(media) or name.endswith(ends)), "text")


def name_title(filename: str | None) -> str:
    """A file name without folders and ending, its separators as spaces."""
    stem = (filename or "").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return stem.replace("_", " ").replace("-", " ").strip() or "Untitled"


def _read(kind: str, media: str, name: str, text: str | None, content: bytes | None) -> tuple[list[dict], dict]:
    """The blocks of a document by the parser of its format, and what the parser found besides."""
    if not text and not content:
        raise ParseError("no content to parse")
    if kind in BINARY:
        if content is None:
            raise ParseError(f"{kind} needs bytes")
        if kind == "pdf":
            raise ParseError("no library reads PDF files here")
        return office.read(content, kind)
    if text is None:
        text = content.decode("utf-8", errors="replace")
    if kind == "html":
        blocks, title = R.read_html(text)
        return blocks, {"title": title}
    if kind == "csv":
        return R.parse_csv(text, delimiter="\t" if media == TABS or name.endswith(".tsv") else ","), {}
    return R.PARSERS[kind](text), {}


def parse(title: str | None, author: str | None, media_type: str | None, filename: str | None, source_uri: str | None, text: str | None, content: bytes | None) -> dict:
    """A document parsed: the columns of ``PARSED``."""
    media, name = plain_type(media_type), (filename or source_uri or "").lower()
    kind = format_of(media, name)
    out = {"format": kind, "title": None, "author": None, "page_count": None, "error": None, "blocks": []}
    try:
        blocks, told = _read(kind, media, name, text, content)
        if not blocks:
            raise ParseError("no blocks")
    except Exception as e:  # noqa: BLE001  parsers raise a dozen kinds; each is this document's error
        return out | {"error": f"{type(e).__name__}: {e}"[:200]}
    title = (title or "").strip() or told.get("title") or next((b["text"] for b in blocks if b["kind"] == "heading"), "") or name_title(filename)
    return out | {"title": title, "author": author or told.get("author") or None, "page_count": told.get("page_count"), "blocks": blocks}


def documents(docs: DataFrame, id_col: str) -> DataFrame:
    """A row for each document: id, format, title, author, page_count, error, blocks in their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ([None if v is None or v is pd.NA or v != v else v for v in row] for pdf in batches for row in pdf.itertuples(index=False, name=None))
        found = ({"id": i, **parse(*own, None if content is None else bytes(content))} for i, *own, content in rows)
        yield from R.grouped((sum(len(b["text"]) for b in d["blocks"]), d) for d in found)

    fields = [(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in FIELDS.items()]
    return docs.select(F.col(id_col).alias("id"), *fields).mapInPandas(run, f"id {dict(docs.dtypes)[id_col]}, {PARSED}")


def blocks(parsed: DataFrame) -> DataFrame:
    """A row for each block of ``documents``: id, format, title, pos, kind, text, level, section; a failed document is one of kind ``error``."""
    failed = F.array(F.struct(F.lit("error").alias("kind"), F.col("error").alias("text"), F.lit(0).alias("level"), F.array().cast("array<string>").alias("section")))
    each = F.posexplode(F.when(F.col("error").isNull(), F.col("blocks")).otherwise(failed)).alias("pos", "b")
    return parsed.select("id", "format", "title", each).select("id", "format", "title", "pos", "b.*")
