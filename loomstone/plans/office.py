"""Queries of Office files: documents and orders written as files, and read back block by block."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from ..operators import dispatch as X
from ..operators import office as O
from ..operators.graph import spread
from ..operators.parsing import grouped
from .base import query

#: Characters that XML cannot hold.
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_NS = {"w": O.W, "s": O.S, "a": O.A, "p": O.P, "r": O.R}
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def xml(tag: str, inner: str) -> str:
    """A root element with every prefix declared."""
    return f'<?xml version="1.0" encoding="UTF-8"?><{tag} ' + " ".join(f'xmlns:{k}="{v[1:-1]}"' for k, v in _NS.items()) + f">{inner}</{tag.split()[0]}>"


def text(value: str) -> str:
    return escape(_BAD.sub(" ", value))


def package(main: str, parts: dict[str, str], relations: dict[str, list[tuple[str, str, str]]]) -> bytes:
    """A zip of parts and of their relations (id, kind, target)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, own in {"": [("rId1", "officeDocument", main)], **relations}.items():
            folder, _, base = name.rpartition("/")
            each = "".join(f'<Relationship Id="{i}" Type="{_REL}/{k}" Target="{t}"/>' for i, k, t in own)
            z.writestr(f"{folder}/_rels/{base}.rels".lstrip("/"), f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{each}</Relationships>')
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def docx_of(title: str, paragraphs: list[str]) -> bytes:
    p = lambda style, t: f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t xml:space="preserve">{text(t)}</w:t></w:r></w:p>'
    body = p("H", title) + "".join(p("L" if x.startswith("- ") else "", x) for x in paragraphs)
    styles = '<w:style w:styleId="H"><w:name w:val="heading 1"/></w:style><w:style w:styleId="L"><w:name w:val="Own"/><w:basedOn w:val="LP"/></w:style><w:style w:styleId="LP"><w:name w:val="List Paragraph"/></w:style>'
    return package("word/document.xml", {"word/document.xml": xml("w:document", f"<w:body>{body}</w:body>"), "word/styles.xml": xml("w:styles", styles)}, {"word/document.xml": [("rId7", "styles", "styles.xml")]})


def xlsx_of(name: str, rows: list[list[str | float]]) -> bytes:
    """One sheet; texts are shared strings."""
    shared: dict[str, int] = {}
    cell = lambda v: f"<s:c><s:v>{v}</s:v></s:c>" if isinstance(v, (int, float)) else f'<s:c t="s"><s:v>{shared.setdefault(v, len(shared))}</s:v></s:c>'
    data = "".join(f"<s:row>{''.join(map(cell, r))}</s:row>" for r in rows)
    parts = {"xl/workbook.xml": xml("s:workbook", f'<s:sheets><s:sheet name="{text(name)}" r:id="rId1"/></s:sheets>'), "xl/worksheets/sheet1.xml": xml("s:worksheet", f"<s:sheetData>{data}</s:sheetData>")}
    parts["xl/sharedStrings.xml"] = xml("s:sst", "".join(f"<s:si><s:t>{text(v)}</s:t></s:si>" for v in shared))
    return package("xl/workbook.xml", parts, {"xl/workbook.xml": [("rId1", "worksheet", "worksheets/sheet1.xml"), ("rId2", "sharedStrings", "sharedStrings.xml")]})


def pptx_of(slides: list[tuple[str, list[str]]]) -> bytes:
    p = lambda t: f"<a:p><a:r><a:t>{text(t)}</a:t></a:r></a:p>"
    shape = lambda kind, inner: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>{inner}</p:txBody></p:sp>'
    parts, relations = {}, {"ppt/presentation.xml": []}
    for n, (title, lines) in enumerate(slides, 1):
        parts[f"ppt/slides/slide{n}.xml"] = xml("p:sld", f"<p:cSld><p:spTree>{shape('title', p(title))}{shape('body', ''.join(map(p, lines)))}</p:spTree></p:cSld>")
        relations["ppt/presentation.xml"].append((f"rId{n}", "slide", f"slides/slide{n}.xml"))
    parts["ppt/presentation.xml"] = xml("p:presentation", "<p:sldIdLst>" + "".join(f'<p:sldId id="{255 + n}" r:id="rId{n}"/>' for n in range(1, len(slides) + 1)) + "</p:sldIdLst>")
    return package("ppt/presentation.xml", parts, relations)


def _files(df, make):
    """id and content of a file made of each row (id, ...)."""

    def run(batches):
        made = ((row.id, make(row)) for pdf in batches for row in pdf.itertuples(index=False))
        yield from grouped((len(content), {"id": i, "content": content}) for i, content in made)

    return spread(df).mapInPandas(run, "id long, content binary")


_LINES_SQL = r"""WITH x AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: regexp_replace(regexp_replace(p, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g'), '[ \t\r\x{A0}]+', ' ', 'g')) AS ps FROM documents),
y AS (SELECT doc_id, unnest(list_filter(ps, lambda p: trim(p) <> '')) AS p, generate_subscripts(list_filter(ps, lambda p: trim(p) <> ''), 1) AS k FROM x)"""


@query("parse_docx", f"{_LINES_SQL} SELECT doc_id AS id, k::INT AS pos, CASE WHEN starts_with(p, '- ') THEN 'list_item' ELSE 'paragraph' END AS kind, md5(trim(p)) AS digest, 'Document ' || doc_id AS section FROM y UNION ALL SELECT doc_id, 0, 'heading', md5('Document ' || doc_id), 'Document ' || doc_id FROM documents")
def parse_docx(t):
    files = _files(t.documents.select(F.col("doc_id").alias("id"), "text"), lambda r: docx_of(f"Document {r.id}", (r.text or "").split("\n")))
    return O.blocks(files, "id", "content").select("id", "pos", "kind", F.md5("text").alias("digest"), F.array_join("section", " > ").alias("section"))


@query("parse_pptx", f"{_LINES_SQL} SELECT doc_id AS id, k::INT AS pos, 'paragraph' AS kind, md5(trim(p)) AS digest FROM y UNION ALL SELECT doc_id, 0, 'heading', md5('Slide of ' || doc_id) FROM documents")
def parse_pptx(t):
    files = _files(t.documents.select(F.col("doc_id").alias("id"), "text"), lambda r: pptx_of([(f"Slide of {r.id}", (r.text or "").split("\n"))]))
    return O.blocks(files, "id", "content").select("id", "pos", "kind", F.md5("text").alias("digest"))


_SHEET_SQL = """WITH l AS (SELECT o_custkey AS id, '| id | status | clerk |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |', chr(10) ORDER BY o_orderkey) AS tab FROM orders GROUP BY 1)
SELECT id, 0 AS pos, 'heading' AS kind, md5('C' || id) AS digest FROM l UNION ALL SELECT id, 1, 'table', md5(tab) FROM l"""


@query("parse_xlsx", _SHEET_SQL)
def parse_xlsx(t):
    """Orders of each customer as a sheet."""
    g = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("rows"))
    files = _files(g, lambda r: xlsx_of(f"C{r.id}", [["id", "status", "clerk"], *([int(x["o_orderkey"]), x["o_orderstatus"], x["o_orderpriority"]] for x in r.rows)]))
    return O.blocks(files, "id", "content").select("id", "pos", "kind", F.md5("text").alias("digest"))


_OPEN = "application/vnd.openxmlformats-officedocument."
#: Formats that documents are written in, by the remainder of their ids: ending and media type.
WRITTEN = {
    "txt": "text/plain",
    "md": "text/markdown",
    "html": "text/html",
    "csv": "text/csv",
    "tsv": X.TABS,
    "docx": f"{_OPEN}wordprocessingml.document",
    "pptx": f"{_OPEN}presentationml.presentation",
    "xlsx": f"{_OPEN}spreadsheetml.sheet",
}


def written(doc_id: int, body: str) -> bytes:
    """A document as a file of its format."""
    ending, lines = list(WRITTEN)[doc_id % len(WRITTEN)], body.split("\n")
    grid = [["line", "text"], *([k, x] for k, x in enumerate(lines))]
    if ending in ("csv", "tsv"):
        out = io.StringIO()
        csv.writer(out, delimiter="\t" if ending == "tsv" else ",").writerows(grid)
        return out.getvalue().encode()
    if ending == "docx":
        return docx_of(f"Document {doc_id}", lines)
    if ending == "pptx":
        return pptx_of([(f"Slide of {doc_id}", lines), ("", ["end"])])
    if ending == "xlsx":
        return xlsx_of(f"Sheet {doc_id}", grid)
    if ending == "html":
        return (f"<title>Page {doc_id}</title><h2>Lines</h2>" + "".join(f"<p>{escape(x)}</p>" for x in lines)).encode()
    return (f"# Document {doc_id}\n\n{body}" if ending == "md" else body).encode()


@query("parse_formats")
def parse_formats(t):
    """Documents written as files of eight formats; every other eight of them say their media type, the others have a name."""
    files = _files(t.documents.select(F.col("doc_id").alias("id"), "text"), lambda r: written(r.id, r.text or ""))
    i, of = F.col("id"), lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod("id", F.lit(len(WRITTEN))) + 1).cast("int"))
    typed = F.pmod(F.floor(i / len(WRITTEN)), F.lit(2)) == 0
    named = files.select("id", F.when(typed, of(WRITTEN.values())).alias("media_type"), F.when(~typed, F.concat(F.lit("files/the_doc-"), i, F.lit("."), of(WRITTEN))).alias("filename"), F.col("content").alias("content_bytes"))
    texts = F.transform("blocks", lambda b: F.concat_ws(" ", b["kind"], b["text"]))
    return X.documents(named, "id").select("id", "format", "title", "page_count", "error", F.size("blocks").alias("n"), F.md5(F.array_join(texts, "\n")).alias("digest"))
