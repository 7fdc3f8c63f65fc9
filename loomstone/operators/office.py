"""Office Open XML files as ordered blocks: text documents, workbooks, slides.

A file is a zip of XML parts that name each other by relations; parts are followed
from the package's root, whatever their names.  Files come from outside, so sizes are
bounded by what the archive says before anything is unpacked and again by what comes
out, documents with a DTD are refused, and whatever goes wrong with one file is a row
with its error and no other file's matter.

Defined results: an empty or null content, an archive that is no Office file, an
encrypted or broken one and one beyond the bounds give one block of kind ``error``;
a part that is missing is empty.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as E

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parsing import BLOCK, MOST, Blocks, add_tables, grouped, normal, table

#: Bytes that a file's parts may have in all and one by one, parts, and how far one may be packed.
MOST_BYTES, PART_BYTES, MOST_PARTS, MOST_PACKED = 512 << 20, 256 << 20, 20_000, 1000
# Fixed: names of the formats' XML.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DC = "{http://purl.org/dc/elements/1.1/}"
#: Number formats that are dates: those built in, and what a format of one's own has outside quotes and brackets.
DATES = {*range(14, 23), *range(45, 48)}
_DATE = re.compile(r"[ymdhs]", re.I)
_QUOTED = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]')


class OfficeError(ValueError):
    """A file that cannot be read."""


class Package:
    """The parts of a file."""

    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, ValueError, OSError) as e:
            raise OfficeError("not a zip archive") from e
        parts = self.zip.infolist()
        if len(parts) > MOST_PARTS or sum(x.file_size for x in parts) > MOST_BYTES:
            raise OfficeError("too many or too large parts")
        self.parts = {x.filename.lstrip("/"): x for x in parts}

    def data(self, name: str) -> bytes:
        x = self.parts.get(name)
        if x is None:
            return b""
        if x.flag_bits & 1:
            raise OfficeError(f"{name} is encrypted")
        if x.file_size > PART_BYTES or x.file_size > 1 << 20 and x.file_size > MOST_PACKED * max(1, x.compress_size):
            raise OfficeError(f"{name} is too large")
        with self.zip.open(x) as f:
            out = f.read(x.file_size + 1)
        if len(out) > x.file_size:
            raise OfficeError(f"{name} is larger than it says")
        return out

    def xml(self, name: str) -> E.Element | None:
        if not (data := self.data(name)):
            return None
        if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
            raise OfficeError(f"{name} has a DTD")
        return E.fromstring(data)

    def relations(self, name: str) -> dict[str, tuple[str, str]]:
        """Of a part ("" is the package): id to (kind, name of the part)."""
        folder, own = posixpath.split(name)
        root = self.xml(posixpath.join(folder, "_rels", f"{own}.rels"))
        out = {}
        for x in root if root is not None else ():
            target = x.get("Target", "")
            if x.get("TargetMode") != "External":
                path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                out[x.get("Id", "")] = (x.get("Type", "").rpartition("/")[2], path)
        return out

    def related(self, name: str, kind: str) -> str:
        return next((path for k, path in self.relations(name).values() if k == kind), "")


# --- text documents ---------------------------------------------------------------------


def _words(p: E.Element) -> str:
    """The text of a paragraph: runs, tabs and breaks, without what is deleted or an instruction."""
    out: list[str] = []

    def walk(x: E.Element) -> None:
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag == f"{W}tab":
            out.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
        elif x.tag not in (f"{W}del", f"{W}pPr", f"{W}rPr", f"{W}moveFrom"):
            for y in x:
                walk(y)

    walk(p)
    return "".join(out)


def _style_names(root: E.Element | None) -> Callable[[str], list[str]]:
    """From a style's id to its name and the names of those that it is based on."""
    found = {}
    for x in root.iter(f"{W}style") if root is not None else ():
        name, base = x.find(f"{W}name"), x.find(f"{W}basedOn")
        found[x.get(f"{W}styleId", "")] = ("" if name is None else name.get(f"{W}val", ""), "" if base is None else base.get(f"{W}val", ""))

    def names(style: str) -> list[str]:
        out, seen = [], set()
        while style and style not in seen:
            seen.add(style)
            name, base = found.get(style, (style, ""))
            out.append(name)
            style = base
        return out

    return names


def _role(names: list[str]) -> tuple[str, int]:
    """What a paragraph of a style is, by the first of its names that says so."""
    for name in names:
        low = name.lower()
        if low in ("title", "subtitle"):
            return "heading", 1
        if m := re.match(r"heading\s*(\d)", low):
            return "heading", int(m[1])
        for word, kind in (("list", "list_item"), ("quote", "quote"), ("caption", "caption")):
            if word in low:
                return kind, 0
    return "paragraph", 0


def _body(x: E.Element) -> Iterator[E.Element]:
    """Paragraphs and tables of a body, through content controls."""
    for y in x:
        if y.tag in (f"{W}p", f"{W}tbl"):
            yield y
        elif y.tag in (f"{W}sdt", f"{W}sdtContent"):
            yield from _body(y)


def _cells(t: E.Element) -> list[list[str]]:
    """Rows of a table; a cell that spans columns or rows is told in each."""
    rows: list[list[str]] = []
    for tr in t.iter(f"{W}tr"):
        row: list[str] = []
        for tc in tr.findall(f"{W}tc"):
            text = "\n".join(_words(p) for p in tc.findall(f"{W}p"))
            span, merge = tc.find(f"{W}tcPr/{W}gridSpan"), tc.find(f"{W}tcPr/{W}vMerge")
            if merge is not None and merge.get(f"{W}val", "continue") == "continue" and rows and len(row) < len(rows[-1]):
                text = rows[-1][len(row)]
            wide = span.get(f"{W}val", "1") if span is not None else "1"
            row += [text] * (min(int(wide), 1000) if wide.isdigit() else 1)
        rows.append(row)
    return rows


def parse_docx(package: Package, main: str) -> list[dict]:
    """Paragraphs by their styles, then the tables."""
    root = package.xml(main)
    body = root.find(f"{W}body") if root is not None else None
    b, names, tables = Blocks(), _style_names(package.xml(package.related(main, "styles"))), []
    for x in _body(body) if body is not None else ():
        if x.tag == f"{W}tbl":
            tables.append(x)
            continue
        text, style = _words(x), x.find(f"{W}pPr/{W}pStyle")
        if not text.strip():
            continue
        kind, level = _role(names(style.get(f"{W}val", "")) if style is not None else [])
        if kind == "heading":
            b.heading(" ".join(text.split()), level)
        else:
            b.add(kind, text)
    for x in tables:
        b.add("table", table(_cells(x)))
    return b.out


# --- workbooks --------------------------------------------------------------------------


def _shared(root: E.Element | None) -> list[str]:
    """Shared strings: runs joined, readings left out."""
    return ["".join(t.text or "" for path in (f"{S}t", f"{S}r/{S}t") for t in x.findall(path)) for x in root.findall(f"{S}si")] if root is not None else []


def _date_styles(root: E.Element | None) -> set[int]:
    """The cell styles that show a number as a date."""
    if root is None:
        return set()
    own = {int(x.get("numFmtId", -1)) for x in root.iter(f"{S}numFmt") if _DATE.search(_QUOTED.sub("", x.get("formatCode", "")))}
    return {k for k, x in enumerate(root.findall(f"{S}cellXfs/{S}xf")) if int(x.get("numFmtId", 0)) in DATES | own}


def _date(serial: float, from_1904: bool) -> str:
    """A day number as a date, with a time where it has one."""
    if from_1904:
        day = datetime(1904, 1, 1)
    else:
        day = datetime(1899, 12, 30) if serial >= 60 else datetime(1899, 12, 31)  # the format has a 29 February 1900
    at = day + timedelta(seconds=round(serial * 86_400))
    return str(at) if serial % 1 else str(at.date())


def _column(ref: str, default: int) -> int:
    """The place of a cell from 0."""
    letters = re.match(r"[A-Z]{1,3}", ref)
    if not letters:
        return default
    n = 0
    for c in letters[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _value(c: E.Element, shared: list[str], dates: set[int], from_1904: bool) -> str:
    kind, v = c.get("t", "n"), c.find(f"{S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for path in (f"{S}is/{S}t", f"{S}is/{S}r/{S}t") for t in c.findall(path))
    raw = (v.text or "") if v is not None else ""
    if kind == "s":
        return shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
    if kind == "b":
        return {"1": "True", "0": "False"}.get(raw, "")
    if kind == "n" and raw:
        try:
            number = float(raw)
            if (c.get("s") or "").isdigit() and int(c.get("s")) in dates:
                return _date(number, from_1904)
            return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
        except (ValueError, OverflowError):
            return raw
    return raw


def _rows(root: E.Element | None, value: Callable[[E.Element], str]) -> Iterator[list[str]]:
    """The rows of a sheet that have something."""
    for x in root.iter(f"{S}row") if root is not None else ():
        row: list[str] = []
        for c in x.findall(f"{S}c"):
            at = _column(c.get("r", ""), len(row))
            row += [""] * (at - len(row))
            row[at : at + 1] = [value(c)]
        if any(v.strip() for v in row):
            yield row


def parse_xlsx(package: Package, main: str, most: int = MOST) -> list[dict]:
    """Each sheet a section, its rows in tables of at most ``most`` tokens below the first row."""
    root, relations, b = package.xml(main), package.relations(main), Blocks()
    shared, dates = _shared(package.xml(package.related(main, "sharedStrings"))), _date_styles(package.xml(package.related(main, "styles")))
    props = root.find(f"{S}workbookPr") if root is not None else None
    from_1904 = props is not None and props.get("date1904") in ("1", "true")
    for sheet in root.iter(f"{S}sheet") if root is not None else ():
        kind, path = relations.get(sheet.get(f"{R}id", ""), ("", ""))
        rows = list(_rows(package.xml(path), lambda c: _value(c, shared, dates, from_1904))) if kind == "worksheet" else []
        if rows:
            b.path.clear()
            b.heading(sheet.get("name", ""), 1)
            add_tables(b, rows[0], rows[1:], most)
    return b.out


# --- slides -----------------------------------------------------------------------------


def _lines(x: E.Element) -> list[tuple[int, str]]:
    """(level, text) of the paragraphs of a shape."""
    out = []
    for p in x.iter(f"{A}p"):
        props = p.find(f"{A}pPr")
        text = "".join("\n" if t.tag == f"{A}br" else t.text or "" for t in p.iter() if t.tag in (f"{A}t", f"{A}br"))
        level = props.get("lvl", "0") if props is not None else "0"
        out.append((int(level) if level.isdigit() else 0, text))
    return out


def _placeholder(shape: E.Element) -> str | None:
    x = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
    return None if x is None else x.get("type", "body")


def parse_pptx(package: Package, main: str) -> list[dict]:
    """Each slide a section under its title, then its shapes and notes."""
    root, relations, b = package.xml(main), package.relations(main), Blocks()
    listed = [x.get(f"{R}id", "") for x in root.iter(f"{P}sldId")] if root is not None else []
    for n, path in enumerate((relations[x][1] for x in listed if x in relations), 1):
        slide = package.xml(path)
        tree = slide.find(f"{P}cSld/{P}spTree") if slide is not None else None
        shapes = list(tree) if tree is not None else []
        heads = [x for x in shapes if x.tag == f"{P}sp" and _placeholder(x) in ("title", "ctrTitle")]
        b.path.clear()
        title = " ".join(" ".join(t for _, t in _lines(heads[0])).split()) if heads else ""
        b.heading(title or f"Slide {n}", 1)
        for x in shapes:
            if x in heads[:1]:
                continue
            if (grid := x.find(f".//{A}tbl")) is not None:
                b.add("table", table([["\n".join(t for _, t in _lines(c)) for c in r.findall(f"{A}tc")] for r in grid.findall(f"{A}tr")]))
            elif x.tag in (f"{P}sp", f"{P}grpSp"):
                for level, text in _lines(x):
                    b.add("list_item" if level else "paragraph", text)
        notes = package.xml(package.related(path, "notesSlide"))
        for x in notes.iter(f"{P}sp") if notes is not None else ():
            if _placeholder(x) == "body":
                b.add("footnote", "\n".join(t for _, t in _lines(x)))
    return b.out


#: The kinds of files by the root of their main part.
KINDS = {f"{W}document": ("docx", parse_docx), f"{S}workbook": ("xlsx", parse_xlsx), f"{P}presentation": ("pptx", parse_pptx)}


def opened(content: bytes) -> tuple[Package, str, E.Element]:
    """A file, the name of its main part and that part's root."""
    package = Package(content)
    main = package.related("", "officeDocument")
    root = package.xml(main)
    if root is None or root.tag not in KINDS:
        raise OfficeError("not an Office file")
    return package, main, root


def read(content: bytes, kind: str) -> tuple[list[dict], dict]:
    """The blocks of a file of one kind, and what it says of itself: title, author, page_count (slides, sheets)."""
    package, main, root = opened(content)
    own, parser = KINDS[root.tag]
    if own != kind:
        raise OfficeError(f"a file of kind {own}, not {kind}")
    relations, told = package.relations(main), {}
    if kind == "docx":
        core = package.xml(package.related("", "core-properties"))
        told = {name: normal(core.findtext(f"{DC}{tag}") or "") for name, tag in (("title", "title"), ("author", "creator"))} if core is not None else {}
    elif kind == "pptx":
        told["page_count"] = sum(x.get(f"{R}id", "") in relations for x in root.iter(f"{P}sldId"))
    else:
        told["page_count"] = sum(relations.get(x.get(f"{R}id", ""), ("", ""))[0] == "worksheet" for x in root.iter(f"{S}sheet"))
    return parser(package, main), told


def parse(content: bytes | None) -> list[dict]:
    """The blocks of a file of any of the three kinds, told by its main part; or its error."""
    try:
        package, main, root = opened(content or b"")
        return KINDS[root.tag][1](package, main)
    except Exception as e:  # noqa: BLE001  zip, decompressors and XML raise a dozen kinds; each is this file's error
        return [{"kind": "error", "text": f"{type(e).__name__}: {e}"[:200], "level": 0, "section": []}]


def blocks(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """A row for each block of each file: id, pos, kind, text, level, section."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = ((i, content) for pdf in batches for i, content in zip(pdf["id"], pdf["content"], strict=True))
        found = ((i, parse(None if content is None else bytes(content))) for i, content in files)
        yield from grouped((sum(len(b["text"]) for b in own), {"id": i, "blocks": own}) for i, own in found)

    d = files.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")).mapInPandas(run, f"id {dict(files.dtypes)[id_col]}, blocks array<{BLOCK}>")
    return d.select("id", F.posexplode("blocks").alias("pos", "b")).select("id", "pos", "b.*")
