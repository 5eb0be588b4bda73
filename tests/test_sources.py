import io
import zipfile

from pyspark.sql import functions as F

from variorum.sources import files, html, ooxml, pdf

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def test_html():
    sections = html.parse("<p>Lead<h1>Title</h1><p>One <b>two</b><ul><li>a<ul><li>b</li></ul></li></ul><table><tr><td>x<br>y</td><td>z</td></tr></table><script>no</script>")
    assert [s for s, _ in sections] == ["Document", "Title"]
    assert [(b["type"], b["text"]) for b in sections[1][1]] == [("heading", "Title"), ("paragraph", "One two"), ("list", "ab"), ("list", "b"), ("tableRow", "x y | z")]
    assert html.parse(None) == [("Document", [])]


def test_html_with_end_tags_left_out():
    shown = lambda text: [(title, [(b["type"], b["text"]) for b in blocks]) for title, blocks in html.parse(text)]
    assert shown("<ul><li>a<li>b</ul><p>later</p><h1>Head</h1>") == [("Document", [("list", "a"), ("list", "b"), ("paragraph", "later")]), ("Head", [("heading", "Head")])]
    assert shown("<html><head><title>t</title><meta charset=x><body>some text<p>one<p>two") == [("Document", [("paragraph", "some text"), ("paragraph", "one"), ("paragraph", "two")])]
    assert shown("<head><script>x()</script>bare") == [("Document", [("paragraph", "bare")])]
    ((_, blocks),) = html.parse("<table><tr><td>a<td>b<tr><th>c<table><tr><td>in</table></table><p>after")
    assert [(b["text"], b["cells"], b["row_index"]) for b in blocks] == [("a | b", ["a", "b"], 0), ("cin | in", ["cin", "in"], 1), ("in", ["in"], 2), ("after", None, None)]
    assert shown("<ol><li><p>one</p><ul><li>deep</ol><p>out") == [("Document", [("list", "onedeep"), ("list", "deep"), ("paragraph", "out")])]


def _docx():
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Some  text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return data.getvalue()


def test_docx():
    (section,) = ooxml.docx(_docx())
    assert section["title"] == "Head" and [b["type"] for b in section["blocks"]] == ["heading", "paragraph", "tableRow"] and section["blocks"][2]["cells"] == ["a", "b"]


def test_dispatch(spark):
    rows = [(1, "src", "a.docx", bytearray(_docx())), (1, "out", "a.txt", bytearray(b"one\n\ntwo\nlines")), (2, "src", "b.xyz", bytearray(b"?")), (3, "src", "c.docx", bytearray(b"broken")), (4, "src", "d.txt", bytearray()), (5, "src", "e.pdf", bytearray(b"%PDF"))]
    parsed = files.parse_documents(spark.createDataFrame(rows, "pair_id long, side string, file_name string, content binary"))
    errors = {r.file_name: r.parse_error for r in parsed.collect()}
    assert errors["a.docx"] is None and errors["a.txt"] is None and errors["b.xyz"] == "Unsupported file type: .xyz"
    assert errors["c.docx"].startswith("Could not parse c.docx") and errors["d.txt"] == "Empty file" and errors["e.pdf"].startswith("Unsupported file type: .pdf")
    assert [r.text for r in files.blocks(parsed).where("side = 'out'").orderBy("block_idx").collect()] == ["one", "two lines"]


def test_pdf(spark):
    items = [("A", 0.0, 700.0, 10.0), ("b", 10.5, 700.0, 10.0), ("c", 22.0, 700.2, 10.0), ("next", 0.0, 690.0, 20.0), ("far", 0.0, 600.0, 20.0), ("x", 0.0, 590.0, 10.0), ("y", 40.0, 590.0, 10.0), ("z", 80.0, 590.0, 10.0)]
    df = spark.createDataFrame([(1, 1, *i) for i in items], "doc_id int, page int, str string, x double, y double, width double")
    lines = pdf.lines(df)
    assert [r.text for r in lines.orderBy("line_no").collect()] == ["Ab c", "next", "far", "x y z"]
    blocks = pdf.blocks(lines).orderBy("block_no").collect()
    assert [(b.type, b.text) for b in blocks] == [("paragraph", "Ab c next"), ("paragraph", "far"), ("tableRow", "x | y | z")] and blocks[2].table_id == "page1_table_1"


def test_pdf_items_as_documents(spark):
    items = [("x.pdf", "src", 2, "two", 0.0, 700.0, 10.0), ("x.pdf", "src", 1, "one", 0.0, 700.0, 10.0), ("x.pdf", "src", 1, "far", 0.0, 600.0, 10.0)]
    got = files.pdf_blocks(spark.createDataFrame(items, "file_name string, side string, page int, str string, x double, y double, width double")).orderBy("sec_idx", "block_idx").collect()
    assert [(b.title, b.page, b.text) for b in got] == [("Page 1", 1, "one"), ("Page 1", 1, "far"), ("Page 2", 2, "two")]
    assert {b.pair_id for b in got} == {spark.range(1).select(files.pair_of(F.lit("x.docx"))).head()[0]}


def test_words_outside_tables(spark):
    words = [("in", 10.0, 20.0, 10.0, 20.0), ("edge", 9.2, 20.0, 30.9, 40.9), ("one", 0.0, 8.0, 100.2, 110.0), ("two", 9.0, 15.0, 100.4, 110.0), ("wrapped", 0.0, 9.0, 112.0, 122.0), ("•", 0.0, 2.0, 124.0, 134.0), ("item", 3.0, 9.0, 124.0, 134.0), ("far", 0.0, 9.0, 150.0, 160.0)]
    df = spark.createDataFrame([(1, 1, *w) for w in words], "doc_id int, page int, text string, x0 double, x1 double, top double, bottom double")
    boxes = spark.createDataFrame([(1, 1, 10.0, 60.0, 5.0, 40.0), (1, 2, 0.0, 900.0, 0.0, 900.0)], "doc_id int, page int, x0 double, x1 double, top double, bottom double")
    left = pdf.outside_boxes(df, boxes)
    assert {r.text for r in left.collect()} == {"one", "two", "wrapped", "•", "item", "far"}
    assert [r.text for r in pdf.word_paragraphs(left).orderBy("para_no").collect()] == ["one two wrapped", "• item", "far"]


A, P, C, D, R = ("http://schemas.openxmlformats.org/" + x for x in ("drawingml/2006/main", "presentationml/2006/main", "drawingml/2006/chart", "drawingml/2006/diagram", "officeDocument/2006/relationships"))


def _pptx():
    para = lambda *texts: "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts)
    shape = lambda kind, *texts: f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type=\"{kind}\"/>" if kind else ""}</p:nvPr></p:nvSpPr><p:txBody>{para(*texts)}</p:txBody></p:sp>'
    cell = lambda *texts: f"<a:tc><a:txBody>{para(*texts)}</a:txBody></a:tc>"
    table = f'<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>{cell("a", "b")}{cell("c")}</a:tr><a:tr>{cell()}{cell()}</a:tr><a:tr>{cell()}{cell("d")}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    frames = '<p:graphicFrame><a:graphic><a:graphicData><c:chart r:id="rC"/></a:graphicData></a:graphic></p:graphicFrame><p:graphicFrame><a:graphic><a:graphicData><d:relIds r:dm="rD"/></a:graphicData></a:graphic></p:graphicFrame>'
    ns = f'xmlns:a="{A}" xmlns:p="{P}" xmlns:c="{C}" xmlns:d="{D}" xmlns:r="{R}"'
    slide = lambda body: f"<p:sld {ns}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"
    point = lambda i, v: f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>'
    chart = f'<c:chartSpace {ns}><c:chart><c:title><c:tx>{para("Sales")}</c:tx></c:title><c:ser><c:tx>{point(0, "2024")}</c:tx><c:cat>{point(0, "Q1")}{point(1, "Q2")}</c:cat><c:val>{point(0, "5")}{point(1, "7")}</c:val></c:ser></c:chart></c:chartSpace>'
    art = f'<d:dataModel {ns}><d:ptLst><d:pt><d:t>{para("Step one")}</d:t></d:pt><d:pt type="pres"><d:t>{para("no")}</d:t></d:pt><d:pt type="node"><d:t>{para("Step two")}</d:t></d:pt></d:ptLst></d:dataModel>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("ppt/slides/slide10.xml", slide(shape(None, "last")))
        z.writestr("ppt/slides/slide2.xml", slide(frames + table + shape("ctrTitle", "The", "title") + shape(None, "alone") + shape("body", "x", "y")))
        z.writestr("ppt/slides/_rels/slide2.xml.rels", '<Relationships><Relationship Id="rC" Target="../charts/chart1.xml"/><Relationship Id="rD" Target="../diagrams/data1.xml"/></Relationships>')
        z.writestr("ppt/charts/chart1.xml", chart)
        z.writestr("ppt/diagrams/data1.xml", art)
        z.writestr("ppt/notesSlides/notesSlide2.xml", slide(shape("sldNum", "2") + shape("body", "a note")))
    return data.getvalue()


def test_pptx():
    first, last = ooxml.pptx(_pptx())
    assert (first["title"], first["slide"], last["title"], last["slide"]) == ("The title", 2, "Slide 10", 10)
    assert [(b["type"], b["text"]) for b in first["blocks"]] == [
        ("heading", "The title"), ("paragraph", "alone"), ("list", "x"), ("list", "y"), ("list", "Step one"), ("list", "Step two"),
        ("paragraph", "Chart title: Sales"), ("paragraph", "2024 — Q1: 5, Q2: 7"), ("tableRow", "a b | c"), ("tableRow", " | d"), ("notes", "a note"),
    ]
    assert first["blocks"][8]["table_id"] == "slide2_table_1" and [b["text"] for b in last["blocks"]] == ["last"]


def test_one_file_for_a_path(spark, tmp_path):
    for name, text in (("old/x.txt", "First text."), ("old/x.html", "<p>Other words.</p>"), ("old/sub/x.txt", "Below."), ("new/x.txt", "First text."), ("new/sub/x.txt", "Below."), ("new/a.b/y", "No extension.")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    docs = files.read_pairs(spark, str(tmp_path / "old"), f"file://{tmp_path}/new/").collect()
    told = {(d.side, d.file_name): (d.parse_error or "").partition(":")[0] for d in docs}
    assert told == {("src", "x.txt"): files.AMBIGUOUS, ("src", "x.html"): files.AMBIGUOUS, ("src", "sub/x.txt"): "", ("out", "x.txt"): "", ("out", "sub/x.txt"): "", ("out", "a.b/y"): files.UNSUPPORTED}
    pairs = {}
    for d in docs:
        pairs.setdefault(d.pair_id, set()).add(d.file_name)
    assert sorted(map(sorted, pairs.values())) == [["a.b/y"], ["sub/x.txt"], ["x.html", "x.txt"]]
