"""Office files built part by part, and archives made to do harm."""

import io
import zipfile
import zlib

import pytest

from loomstone.operators import office as O
from loomstone.plans import office as M


def kinds(blocks):
    return [(b["kind"], b["text"]) for b in blocks]


def test_documents():
    p = lambda style, inner: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{inner}</w:p>'
    r = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p>{r(t)}</w:p></w:tc>"
    grid = f'<w:tbl><w:tr>{cell("a", """<w:gridSpan w:val="2"/>""")}{cell("b", """<w:vMerge w:val="restart"/>""")}</w:tr><w:tr>{cell("c")}{cell("d|e")}{cell("", "<w:vMerge/>")}</w:tr></w:tbl>'
    body = p("T", r("The Title")) + grid + p("H2", r("Sub ") + r("part")) + "<w:p>" + r("one") + "<w:r><w:tab/></w:r>" + "<w:del><w:r><w:t>gone</w:t></w:r></w:del>" + "<w:hyperlink>" + r("two") + "</w:hyperlink><w:r><w:br/></w:r>" + r("three") + "</w:p>" + p("Q", r("said")) + p("Mine", r("item")) + p("C", r("under")) + p("loop", r("plain")) + "<w:p/>" + f"<w:sdt><w:sdtContent>{p('', r('in a control'))}</w:sdtContent></w:sdt>"
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/>{f"""<w:basedOn w:val="{b}"/>""" if b else ""}</w:style>' for i, n, b in [("T", "Title", ""), ("H2", "heading 2", ""), ("Q", "Intense Quote", ""), ("Mine", "Mine", "LB"), ("LB", "List Bullet", ""), ("C", "caption", ""), ("loop", "x", "pool"), ("pool", "y", "loop")])
    content = M.package("any/where.xml", {"any/where.xml": M.xml("w:document", f"<w:body>{body}</w:body>"), "styles-elsewhere.xml": M.xml("w:styles", styles)}, {"any/where.xml": [("x", "styles", "../styles-elsewhere.xml"), ("y", "hyperlink", "none.xml")]})
    got = O.parse(content)
    assert kinds(got) == [("heading", "The Title"), ("heading", "Sub part"), ("paragraph", "one two\nthree"), ("quote", "said"), ("list_item", "item"), ("caption", "under"), ("paragraph", "plain"), ("paragraph", "in a control"), ("table", "| a | a | b |\n| --- | --- | --- |\n| c | d\\|e | b |")]
    assert got[2]["section"] == ["The Title", "Sub part"] and got[1]["level"] == 2


def test_workbooks():
    c = lambda ref, kind, v, style="": f'<s:c r="{ref}" t="{kind}"{style and f""" s="{style}" """}><s:v>{v}</s:v></s:c>'
    one = f'<s:row>{c("A1", "s", 0)}{c("C1", "s", 1)}</s:row><s:row/><s:row>{c("A9", "n", "45292", "1")}{c("B9", "n", "1.5")}{c("C9", "b", 1)}{c("D9", "n", "7")}</s:row><s:row>{c("A10", "n", "45292.25", "2")}{c("B10", "e", "#N/A")}{c("C10", "s", 99)}<s:c r="D10" t="inlineStr"><s:is><s:r><s:t>in</s:t></s:r><s:r><s:t>line</s:t></s:r></s:is></s:c></s:row>'
    two = f'<s:row>{c("A1", "str", "only")}</s:row>'
    styles = '<s:numFmts><s:numFmt numFmtId="170" formatCode="yyyy&quot;m&quot;\\d"/><s:numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></s:numFmts><s:cellXfs><s:xf numFmtId="171"/><s:xf numFmtId="14"/><s:xf numFmtId="170"/></s:cellXfs>'
    parts = {"xl/w.xml": M.xml("s:workbook", '<s:sheets><s:sheet name="One" r:id="b"/><s:sheet name="Empty" r:id="e"/><s:sheet name="Two" r:id="a"/><s:sheet name="Lost" r:id="z"/></s:sheets>'), "xl/2.xml": M.xml("s:worksheet", f"<s:sheetData>{two}</s:sheetData>"), "xl/1.xml": M.xml("s:worksheet", f"<s:sheetData>{one}</s:sheetData>"), "xl/e.xml": M.xml("s:worksheet", "<s:sheetData/>")}
    parts |= {"xl/s.xml": M.xml("s:sst", "<s:si><s:t>day</s:t></s:si><s:si><s:r><s:t>ri</s:t></s:r><s:rPh><s:t>no</s:t></s:rPh><s:r><s:t>ch</s:t></s:r></s:si>"), "xl/st.xml": M.xml("s:styleSheet", styles)}
    got = O.parse(M.package("/xl/w.xml", parts, {"xl/w.xml": [("a", "worksheet", "2.xml"), ("b", "worksheet", "/xl/1.xml"), ("e", "worksheet", "e.xml"), ("s", "sharedStrings", "s.xml"), ("t", "styles", "st.xml")]}))
    assert kinds(got) == [("heading", "One"), ("table", "| day | | rich | |\n| --- | --- | --- | --- |\n| 2024-01-01 | 1.5 | True | 7 |\n| 2024-01-01 06:00:00 | #N/A | | inline |"), ("heading", "Two"), ("table", "| only |\n| --- |")]
    assert got[1]["section"] == ["One"] and got[3]["section"] == ["Two"]


def test_many_rows_are_dealt_out_with_their_header():
    got = O.parse(M.xlsx_of("S", [["k", "v"], *([k, "word " * 20] for k in range(200))]))
    tables = [b["text"].split("\n") for b in got if b["kind"] == "table"]
    assert len(tables) > 3 and all(x[0] == "| k | v |" for x in tables) and sum(len(x) - 2 for x in tables) == 200


def test_slides():
    grid = "<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>x</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    content = M.pptx_of([("First", ["one", "two"]), ("", ["three"])])
    z = zipfile.ZipFile(io.BytesIO(content))
    parts = {n: z.read(n).decode() for n in z.namelist() if not n.endswith(".rels")}
    parts["ppt/slides/slide1.xml"] = parts["ppt/slides/slide1.xml"].replace("</p:spTree>", grid + "</p:spTree>").replace("<a:p><a:r><a:t>two", '<a:p><a:pPr lvl="1"/><a:r><a:t>two')
    parts["ppt/notes.xml"] = M.xml("p:notes", '<p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>note</a:t></a:r></a:p></p:txBody></p:sp>')
    got = O.parse(M.package("ppt/presentation.xml", parts, {"ppt/presentation.xml": [("rId2", "slide", "slides/slide1.xml"), ("rId1", "slide", "slides/slide2.xml")], "ppt/slides/slide1.xml": [("n", "notesSlide", "../notes.xml")]}))
    assert kinds(got) == [("heading", "Slide 1"), ("paragraph", "three"), ("heading", "First"), ("paragraph", "one"), ("list_item", "two"), ("table", "| x |\n| --- |"), ("footnote", "note")]


def zipped(parts, **kw):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def hostile():
    good = M.docx_of("T", ["text"])
    bomb = M.package("word/document.xml", {"word/document.xml": " " * (40 << 20)}, {})
    dtd = M.package("d.xml", {"d.xml": '<?xml version="1.0"?><!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'}, {})
    late = M.package("d.xml", {"d.xml": "<x>" + " " * 9000 + "<!ENTITY a 'b'></x>"}, {})
    flipped = bytearray(good)
    at = good.index(b"word/document.xml") + 40
    flipped[at : at + 30] = bytes(30)
    return {"null": None, "empty": b"", "text": b"hello", "cut": good[:-40], "half": good[: len(good) // 2], "zip": zipped({"a": "b"}), "bomb": bomb, "dtd": dtd, "late": late, "flipped": bytes(flipped), "missing": M.package("none.xml", {}, {}), "not xml": M.package("d.xml", {"d.xml": "<a>"}, {}), "many": zipped({f"{k}": "" for k in range(O.MOST_PARTS + 1)}), "deep": M.package("d.xml", {"d.xml": M.xml("w:document", "<w:body><w:p>" + "<w:r>" * 50_000 + "</w:r>" * 50_000 + "</w:p></w:body>")}, {})}


@pytest.mark.parametrize("name", ["null", "empty", "text", "cut", "half", "zip", "bomb", "dtd", "late", "flipped", "missing", "not xml", "many", "deep"])
def test_hostile_files(name):
    (b,) = O.parse(hostile()[name])
    assert b["kind"] == "error" and b["text"]


def test_one_bad_file_is_one_row(spark):
    good = M.docx_of("T", ["text", "- item"])
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"x"))], "id long, content binary")
    got = [(r.id, r.pos, r.kind) for r in O.blocks(df, "id", "content").orderBy("id", "pos").collect()]
    assert got == [(1, 0, "heading"), (1, 1, "paragraph"), (1, 2, "list_item"), (2, 0, "error"), (3, 0, "error")]
    assert zlib.crc32(good)


def test_dates():
    assert [O._date(x, False) for x in (1, 59, 61, 45292.5)] == ["1900-01-01", "1900-02-28", "1900-03-01", "2024-01-01 12:00:00"]
    assert O._date(0, True) == "1904-01-01"
