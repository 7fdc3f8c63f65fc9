"""Documents dispatched row by row: which parser, which title, which error."""

import hashlib
import re
from collections import defaultdict

import pytest

from loomstone.operators import dispatch as X
from loomstone.operators import parsing as R
from loomstone.plans import office as M
from loomstone.plans import registry

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


@pytest.mark.parametrize(
    "media, name, want",
    [
        ("", "", "text"), ("application/octet-stream", "", "text"), ("text/plain", "x.md", "markdown"), ("text/plain", "x.htm", "html"),
        ("application/pdf", "x.html", "pdf"), ("text/html", "x.pdf", "pdf"), ("text/html", "x.md", "html"), ("text/html", "x.docx", "docx"),
        (DOCX, "x.csv", "docx"), ("", "x.xlsm", "xlsx"), ("application/xhtml+xml", "", "html"), ("", "x.markdown", "markdown"),
        ("", "x.tsv", "csv"), ("text/csv", "x.txt", "csv"), ("", "csv", "text"), ("", "dir.html/x", "text"),
    ],
)
def test_format(media, name, want):
    assert X.format_of(media, name) == want


def parsed(title=None, author=None, media_type=None, filename=None, source_uri=None, text=None, content=None):
    return X.parse(title, author, media_type, filename, source_uri, text, content)


def test_titles_fall_back_in_order():
    page = "<svg><title>icon</title></svg><title> The\n  page </title><title>late</title><h1>Head</h1><p>x"
    assert parsed(" Own ", media_type="Text/HTML; charset=x", text=page)["title"] == "Own"
    assert parsed("  ", media_type="Text/HTML; charset=x", text=page)["title"] == "The\npage"
    assert parsed(filename="A.HTML", text="<title> </title><p>x<h2>Head  two</h2>")["title"] == "Head two"
    assert parsed(filename="a/b_c-d.v2.TXT", text="x")["title"] == "b c d.v2"
    assert parsed(source_uri="http://x/y.md", text="plain")["title"] == parsed(filename="a/_.txt", text="x")["title"] == "Untitled"
    assert parsed(source_uri="http://x/y.md", text="## Two\n\nplain")["title"] == "Two"
    assert parsed(source_uri="http://x/y.md", filename="y.txt", text="## Two")["format"] == "text"


def test_files_tell_of_themselves():
    core = '<c:p xmlns:c="c" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> Of  the file</dc:title><dc:creator>Ann</dc:creator></c:p>'
    main = M.xml("w:document", "<w:body><w:p><w:r><w:t>text</w:t></w:r></w:p></w:body>")
    content = M.package("w.xml", {"w.xml": main, "core.xml": core}, {"": [("a", "officeDocument", "w.xml"), ("b", "metadata/core-properties", "core.xml")]})
    got = parsed(media_type=DOCX, content=content)
    assert (got["title"], got["author"], [b["text"] for b in got["blocks"]]) == ("Of the file", "Ann", ["text"])
    assert parsed(author="Me", media_type=DOCX, content=content)["author"] == "Me"
    got = parsed(filename="x.PPTX", content=M.pptx_of([("", ["a"]), ("Two", ["b"])]))
    assert (got["format"], got["title"], got["page_count"]) == ("pptx", "Slide 1", 2)
    got = parsed(filename="x.xlsm", content=M.xlsx_of("S", [["a"], [1]]))
    assert (got["format"], got["title"], got["page_count"]) == ("xlsx", "S", 1)


def test_tables_and_bytes():
    texts = lambda d: [b["text"] for b in d["blocks"]]
    assert texts(parsed(filename="x.csv", text="\n , \na,b\n1,2\n")) == ["| a | b |\n| --- | --- |\n| 1 | 2 |"]
    for own in ({"filename": "x.TSV"}, {"media_type": "text/tab-separated-values"}, {"filename": "x.tsv", "media_type": "text/csv"}):
        assert texts(parsed(text="a\tb,c\n", **own)) == ["| a | b,c |\n| --- | --- |"]
    assert texts(parsed(filename="x.csv", text="a,b\r1,2\r")) == ["| a | b |\n| --- | --- |\n| 1 | 2 |"]
    assert texts(parsed(filename="x.csv", text="a\n" + "x" * 200_000)) == ["| a |\n| --- |\n| " + "x" * 200_000 + " |"]
    assert texts(parsed(content=b"caf\xc3\xa9 \xff")) == ["café �"]
    assert texts(parsed(text="text", content=b"bytes")) == ["text"]


def test_odd_pages_keep_their_text():
    texts = lambda html: [b["text"] for b in parsed(media_type="text/html", text=html)["blocks"]]
    assert texts("<p>a</p><![foo bar]><p>b") == ["a", "b"]
    assert texts("<p>a<table><tr><td>1<td>2") == ["a", "| 1 | 2 |\n| --- | --- |"]
    assert texts("a <![foo") == ["a <![foo"]


@pytest.mark.parametrize(
    "own, says",
    [
        ({}, "no content"), ({"text": "", "content": b""}, "no content"), ({"text": " \n\n "}, "no blocks"), ({"text": "<title>T</title>", "media_type": "text/html"}, "no blocks"),
        ({"filename": "x.docx", "text": "text"}, "needs bytes"), ({"filename": "x.pdf", "text": "text"}, "needs bytes"), ({"filename": "x.pdf", "content": b"%PDF"}, "PDF"),
        ({"filename": "x.docx", "content": b"no zip"}, "zip"), ({"filename": "x.docx", "content": M.xlsx_of("S", [["a"]])}, "kind xlsx"),
    ],
)
def test_errors(own, says):
    got = parsed(**own)
    assert says in got["error"] and not got["blocks"] and got["title"] is None


def test_one_failed_document_is_one_row(spark):
    rows = [("a", "text/html", "<h1>A</h1><p>x", None), ("b", None, None, None), ("c", None, "one\n\ntwo", None), ("d", DOCX, None, bytearray(M.docx_of("T", ["- i"]))), ("e", DOCX, "text", None)]
    df = spark.createDataFrame(rows, "key string, media_type string, content_text string, content_bytes binary").coalesce(1)
    got = [(r.id, r.format, r.pos, r.kind, r.title) for r in X.blocks(X.documents(df, "key")).orderBy("id", "pos").collect()]
    assert got == [
        ("a", "html", 0, "heading", "A"), ("a", "html", 1, "paragraph", "A"), ("b", "text", 0, "error", None), ("c", "text", 0, "paragraph", "Untitled"),
        ("c", "text", 1, "paragraph", "Untitled"), ("d", "docx", 0, "heading", "T"), ("d", "docx", 1, "list_item", "T"), ("e", "docx", 0, "error", None),
    ]


def test_parse_dispatch(spark, sf):
    """Each row's title by another way: the source's or the name's for documents, the page's own for pages."""
    titles = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        name = {1: f"note {r.doc_id}", 3: f"log {r.doc_id}"}.get(r.doc_id % 4, "Untitled")
        titles["text", "paragraph"].add(f"Document {r.doc_id}" if r.doc_id % 5 == 0 else name)
    own = {r.page_id: R.read_html(r.html)[1] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in registry.queries()["parse_html"](spark, sf).collect():
        titles["html", r.kind].add(own[r.id])
    assert all(own.values())
    assert {(r.format, r.kind): r.titles for r in registry.queries()["parse_dispatch"](spark, sf).collect()} == {k: len(v) for k, v in titles.items()}


def test_parse_dispatch_tells_failed_documents(spark, tmp_path):
    spark.createDataFrame([(1, "a\n\nb"), (2, ""), (3, None), (4, " \n")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, None, html) for k, html in enumerate(["<h1>A</h1>", "<p>b", "", "<title>T</title>"])], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.format, r.kind): r.n for r in registry.queries()["parse_dispatch"](spark, str(tmp_path)).collect()}
    assert got == {("text", "paragraph"): 2, ("text", "error"): 3, ("html", "heading"): 1, ("html", "paragraph"): 1, ("html", "error"): 2}


def test_parse_formats(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.queries()["parse_formats"](spark, sf).collect()
    assert {r.id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        text, ending = texts[r.id], list(M.WRITTEN)[r.id % 8]
        name = "Untitled" if r.id // 8 % 2 == 0 else f"the doc {r.id}"
        title = {"md": f"Document {r.id}", "docx": f"Document {r.id}", "html": f"Page {r.id}", "pptx": f"Slide of {r.id}", "xlsx": f"Sheet {r.id}"}.get(ending, name)
        assert (r.format, r.title, r.page_count, r.error) == ({"txt": "text", "md": "markdown", "tsv": "csv"}.get(ending, ending), title, {"pptx": 2, "xlsx": 1}.get(ending), None)
        lines = [re.sub(r"[ \t\r\f\xa0]+", " ", M._BAD.sub(" ", x)).strip() for x in text.split("\n")]
        lines = [x for x in lines if x]
        if ending == "txt":
            assert r.n == sum(1 for p in re.split(r"\n\s*\n", text) if p.strip())
        elif ending == "html":
            assert r.n == 1 + len(lines)
        elif ending == "md":
            assert r.digest == hashlib.md5("\n".join(f"{b['kind']} {b['text']}" for b in R.parse_markdown(f"# Document {r.id}\n\n{text}")).encode()).hexdigest()
        elif ending == "docx":
            want = [f"heading Document {r.id}", *(("list_item " if x.startswith("- ") else "paragraph ") + x for x in lines)]
            assert r.digest == hashlib.md5("\n".join(want).encode()).hexdigest()
        elif ending == "pptx":
            want = [f"heading Slide of {r.id}", *(f"paragraph {x}" for x in lines), "heading Slide 2", "paragraph end"]
            assert r.digest == hashlib.md5("\n".join(want).encode()).hexdigest()
