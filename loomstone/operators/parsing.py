"""Texts of several formats as ordered blocks, and blocks as chunks.

A block is (kind, text, level, section): its section is the headings above it.  All
of these read a text from start to end with some state, so they are functions of
one document, run where its row is.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import spread

#: Fixed: target, least, most and overlap of a chunk, in estimated tokens.
TARGET, LEAST, MOST, OVERLAP = 512, 64, 1024, 64
_WORDISH = re.compile(r"\w+|[^\w\s]")
BLOCK = "struct<kind:string,text:string,level:int,section:array<string>>"


def grouped(rows: Iterable[tuple[int, dict]], most: int = 1 << 20, n: int = 1000) -> Iterator[pd.DataFrame]:
    """Frames of rows that come with their size: of about ``most`` bytes and at most ``n`` rows, for a frame of each row costs more than the row."""
    held, size = [], 0
    for own, row in rows:
        held.append(row)
        size += own
        if size >= most or len(held) >= n:
            yield pd.DataFrame(held)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held)


def tokens(text: str) -> int:
    return max(1, int(max(len(text) / 3.6, len(_WORDISH.findall(text)) * 1.15))) if text else 0


def normal(text: str) -> str:
    """Lines without runs of white space; blank ones go."""
    return "\n".join(x for line in text.replace("\xa0", " ").split("\n") if (x := re.sub(r"[ \t\r\f]+", " ", line).strip()))


class Blocks:
    """Collects blocks; headings keep the path of sections."""

    def __init__(self):
        self.out: list[dict] = []
        self.path: list[tuple[int, str]] = []

    def heading(self, text: str, level: int) -> None:
        while self.path and self.path[-1][0] >= level:
            self.path.pop()
        self.path.append((level, text))
        self.add("heading", text, level)

    def add(self, kind: str, text: str, level: int = 0) -> None:
        if text := text.rstrip() if kind == "code" else normal(text):
            self.out.append({"kind": kind, "text": text, "level": level, "section": [t for _, t in self.path]})


def table(rows: list[list[str]]) -> str:
    """A pipe table; blank rows go, short rows are filled up."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    wide = max(map(len, rows))
    lines = ["| " + " | ".join(c.strip().replace("|", "\\|").replace("\n", " ") for c in [*r, *[""] * (wide - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]])


def parse_text(text: str) -> list[dict]:
    b = Blocks()
    for p in re.split(r"\n\s*\n", text):
        b.add("paragraph", p)
    return b.out


#: Fixed: a heading of Markdown, which may be closed by marks.
_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*$")


def parse_markdown(text: str) -> list[dict]:
    b, held, kind = Blocks(), [], ""

    def flush() -> None:
        nonlocal kind
        if held:
            b.add(kind or "paragraph", "\n".join(held))
        held.clear()
        kind = ""

    fence = ""
    for line in text.split("\n"):
        s = line.strip()
        if fence:
            if s.startswith(fence):
                fence = ""
                flush()
            else:
                held.append(line)
        elif m := re.match(r"(`{3,}|~{3,})", s):
            flush()
            fence, kind = m[1], "code"
        elif m := _HEADING.match(s):
            flush()
            b.heading(m[2], len(m[1]))
        elif held and not kind and len(held) == 1 and re.fullmatch(r"=+|-{2,}", s):
            title = held.pop()
            b.heading(title.strip(), 1 if s[0] == "=" else 2)
        elif not s:
            flush()
        else:
            now = "table" if s.startswith("|") else "list_item" if re.match(r"([-*+]|\d+[.)])\s", s) else "quote" if s.startswith(">") else ""
            if now != kind and not (kind == "list_item" and not now):
                flush()
                kind = now
            held.append(s.lstrip("> ") if now == "quote" else line)
    flush()
    return b.out


def add_tables(b: Blocks, head: list[str], rows: list[list[str]], most: int = MOST) -> None:
    """Tables of as many rows as fit under ``most`` tokens with the header."""
    held, room = [], most - tokens(table([head]))
    for r in rows:
        cost = tokens(" | ".join(r))
        if held and cost > room:
            b.add("table", table([head, *held]))
            held, room = [], most - tokens(table([head]))
        held.append(r)
        room -= cost
    b.add("table", table([head, *held]))


#: Fixed: a field may be as long as its file; the library's own bound is 128 KiB.
csv.field_size_limit((1 << 31) - 1)


def parse_csv(text: str, most: int = MOST, delimiter: str = ",") -> list[dict]:
    """The rows of a file in tables, each with the header; blank rows go."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if any(c.strip() for c in r)]
    b = Blocks()
    if rows:
        add_tables(b, rows[0], rows[1:], most)
    return b.out


class _Html(HTMLParser):
    SKIP = {"script", "style", "noscript", "template", "svg"}
    LEAF = {"p": "paragraph", "li": "list_item", "pre": "code", "blockquote": "quote", "figcaption": "caption", "caption": "caption", "div": "paragraph", "section": "paragraph", "article": "paragraph", "td": "paragraph"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.b, self.skip, self.held, self.kind, self.title, self.rows = Blocks(), 0, [], "paragraph", None, None

    def flush(self) -> None:
        text = "".join(self.held)
        self.held = []
        if self.kind[:1] == "h" and self.kind[1:].isdigit():
            if text.strip():
                self.b.heading(re.sub(r"\s+", " ", text).strip(), int(self.kind[1:]))
        elif self.kind == "title":
            if self.title is None and not self.skip:
                self.title = normal(text)
        else:
            self.b.add(self.kind, text)
        self.kind = "paragraph"

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # of no known kind: a comment, as in browsers
            return self.parse_bogus_comment(i, report)

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "table":
            self.flush()
            self.rows = []
        elif self.rows is not None:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th") and self.rows:
                self.rows[-1].append("")
        elif tag in self.LEAF or tag == "title" or re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind = self.LEAF.get(tag, tag)
        elif tag == "br":
            self.held.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.rows is not None:
            rows, self.rows = self.rows, None
            self.b.add("table", table(rows))
        elif self.rows is None and (tag in self.LEAF or tag == "title" or re.fullmatch("h[1-6]", tag)):
            self.flush()

    def handle_data(self, data):
        if self.skip:
            return
        if self.rows is not None:
            if self.rows and self.rows[-1]:
                self.rows[-1][-1] += data
        else:
            self.held.append(data)


def read_html(text: str) -> tuple[list[dict], str]:
    """The blocks of a page and its title."""
    p = _Html()
    p.feed(text)
    p.close()
    p.handle_endtag("table")
    p.flush()
    return p.b.out, p.title or ""


def parse_html(text: str) -> list[dict]:
    return read_html(text)[0]


#: Fixed: a numbered heading and an item of a list in text taken from a page; the most characters of a heading.
_NUMBERED = re.compile(r"^(\d+(?:\.\d+){0,4})[.)]?\s+(\S.{0,110})$")
_ITEM = re.compile(r"^\s{0,3}(?:[-*+]\s+|\d{1,3}[.)]\s+)(.*)$")
HEADING_CHARS = 90


def parse_page_text(text: str) -> list[dict]:
    """Text taken from a page: a numbered line alone is a heading of its depth, a short capitalised one of level 2."""
    b = Blocks()
    for paragraph in re.split(r"\n\s*\n", text):
        lines = [x for line in paragraph.split("\n") if (x := line.strip())]
        if not lines:
            continue
        alone = lines[0] if len(lines) == 1 else ""
        if m := _NUMBERED.match(alone):
            b.heading(m[2], m[1].count(".") + 1)
        elif alone and len(alone) <= HEADING_CHARS and alone[-1] not in ".,;:" and alone[0].isupper():
            b.heading(alone, 2)
        elif all(items := [_ITEM.match(x) for x in lines]):
            for m in items:
                b.add("list_item", m[1])
        else:
            b.add("paragraph", " ".join(lines))
    return b.out


PARSERS: dict[str, Callable[[str], list[dict]]] = {"text": parse_text, "markdown": parse_markdown, "html": parse_html, "csv": parse_csv, "page": parse_page_text}


def sentences(text: str) -> list[str]:
    return [x for s in re.split(r"(?<=[.!?])\s+|\n+", text) if (x := s.strip())]


def _pack(units: list[str], target: int, joint: str) -> Iterator[str]:
    held, n = [], 0
    for u in units:
        cost = tokens(u)
        if held and n + cost > target:
            yield joint.join(held)
            held, n = [], 0
        held.append(u)
        n += cost
    if held:
        yield joint.join(held)


def split_block(block: dict) -> list[str]:
    """A block too large for a chunk: prose by sentences, code and tables by lines, each part of a table with its header."""
    if block["kind"] in ("table", "code"):
        lines = block["text"].split("\n")
        head = lines[:2] if block["kind"] == "table" and len(lines) > 2 else []
        return ["\n".join([*head, part]) for part in _pack(lines[len(head) :], max(1, TARGET - tokens("\n".join(head))), "\n")]
    return list(_pack(sentences(block["text"]), TARGET, " "))


def table_batches(header: list[str], body: list[list[str]], most: int = MOST) -> list[list[list[str]]]:
    """The rows of a table in batches that fit a chunk with the header, which each repeats."""
    room, out, used = max(1, most - tokens(table([header]))), [], 0
    for row in body:
        cost = tokens(" ".join(row))
        if not out or used + cost > room:
            out.append([])
            used = 0
        out[-1].append(row)
        used += cost
    return out


def merge_runt(chunks_: list[dict], least: int = LEAST, most: int = MOST) -> list[dict]:
    """A last chunk of few tokens joins the one before, if they have one section and fit together."""
    if len(chunks_) < 2:
        return chunks_
    *rest, before, last = chunks_
    text = before["text"] + "\n\n" + last["text"]
    if last["tokens"] >= least or last["section"] != before["section"] or tokens(text) > most:
        return chunks_
    return [*rest, {"text": text, "section": before["section"], "tokens": tokens(text)}]


def tail(text: str, budget: int = OVERLAP) -> str:
    """The last sentences within a budget, one at least."""
    out, n = [], 0
    for s in reversed(sentences(text)):
        if out and n + tokens(s) > budget:
            break
        out.insert(0, s)
        n += tokens(s)
    return " ".join(out)


def chunk(blocks: list[dict]) -> list[dict]:
    """Blocks packed to a target; a heading starts a chunk once the last has its least; a last runt joins the one before."""
    out: list[dict] = []
    held: list[str] = []
    section: list[str] = []
    fresh = 0  # tokens that are not overlap

    def close(carry: bool) -> None:
        nonlocal held, fresh
        if fresh:
            text = "\n\n".join(held)
            out.append({"text": text, "section": section, "tokens": tokens(text)})
            held = [tail(text)] if carry else []
        fresh = 0

    for b in blocks:
        if b["kind"] == "heading":
            if fresh >= LEAST:
                close(False)
            if not fresh:
                held, section = [], b["section"]
        whole = tokens(b["text"])
        for part in [b["text"]] if whole <= MOST else split_block(b):
            n = tokens(part)
            if fresh and sum(map(tokens, held)) + n > TARGET:
                close(b["kind"] not in ("table", "code", "heading"))
            if not held:
                section = b["section"]
            held.append(part)
            fresh += n
    close(False)
    return merge_runt(out)


def blocks(docs: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    """A row for each block: id, pos, kind, text, level, section."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "blocks": [PARSERS[kind](t or "") for t in pdf["text"]]})

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id long, blocks array<{BLOCK}>")
    return d.select("id", F.posexplode("blocks").alias("pos", "b")).select("id", "pos", "b.*")


def chunks(docs: DataFrame, id_col: str, text_col: str, kind: str = "text") -> DataFrame:
    """A row for each chunk: id, pos, text, section, tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "chunks": [chunk(PARSERS[kind](t or "")) for t in pdf["text"]]})

    d = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInPandas(run, "id long, chunks array<struct<text:string,section:array<string>,tokens:int>>")
    return d.select("id", F.posexplode("chunks").alias("pos", "c")).select("id", "pos", "c.*")
