"""Word and PowerPoint packages made from conversations, for queries that read such files: a heading or a slide per turn."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

_OPEN = "http://schemas.openxmlformats.org"
_W, _A, _P = f"{_OPEN}/wordprocessingml/2006/main", f"{_OPEN}/drawingml/2006/main", f"{_OPEN}/presentationml/2006/main"
_C, _D, _R = f"{_OPEN}/drawingml/2006/chart", f"{_OPEN}/drawingml/2006/diagram", f"{_OPEN}/officeDocument/2006/relationships"


def _zipped(parts: dict[str, str]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return held.getvalue()


def _lines(text: str | None) -> list[str]:
    return [x for x in (text or "").split("\n") if x.strip()]


def word(turns: list[tuple[int, str, str | None]]) -> bytes:
    """A heading per turn, its lines as paragraphs (list items of a user's) and a table of two rows."""
    p = lambda text, style="": f"<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{escape(text)}</w:t></w:r></w:p>"
    body = []
    for number, role, text in turns:
        body.append(p(f"{role} {number}", '<w:pStyle w:val="Heading 1"/>'))
        body += [p(x, "<w:numPr/>" if role == "user" else "") for x in _lines(text)]
        rows = [("role", role), ("lines", str(len(_lines(text))))]
        body.append("<w:tbl>" + "".join(f"<w:tr>{''.join(f'<w:tc>{p(c)}</w:tc>' for c in row)}</w:tr>" for row in rows) + "</w:tbl>")
    return _zipped({"word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{"".join(body)}</w:body></w:document>'})


def slides(turns: list[tuple[int, str, str | None]]) -> bytes:
    """A slide per turn: a title, its lines, a diagram of its role, a chart and a table of its numbers, and notes."""
    para = lambda text: f"<a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p>"
    shape = lambda kind, paras: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>{"".join(map(para, paras))}</p:txBody></p:sp>'
    spaces = f'xmlns:a="{_A}" xmlns:p="{_P}" xmlns:c="{_C}" xmlns:dgm="{_D}" xmlns:r="{_R}"'
    points = lambda values: "".join(f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>' for i, v in enumerate(values) if v != "")
    parts = {}
    for number, role, text in turns:
        n, lines = number + 1, _lines(text)
        table = "".join(f"<a:tr>{''.join(f'<a:tc><a:txBody>{para(c)}</a:txBody></a:tc>' for c in row)}</a:tr>" for row in (("role", role), ("lines", str(len(lines)))))
        frame = lambda inner: f"<p:graphicFrame><a:graphic><a:graphicData>{inner}</a:graphicData></a:graphic></p:graphicFrame>"
        tree = shape("title", [f"{role} {number}"]) + shape("body", lines) + frame('<dgm:relIds r:dm="r1"/>') + frame('<c:chart r:id="r2"/>') + frame(f"<a:tbl>{table}</a:tbl>")
        parts[f"ppt/slides/slide{n}.xml"] = f"<p:sld {spaces}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>"
        parts[f"ppt/slides/_rels/slide{n}.xml.rels"] = f'<Relationships><Relationship Id="r1" Target="../diagrams/data{n}.xml"/><Relationship Id="r2" Target="../charts/chart{n}.xml"/></Relationships>'
        parts[f"ppt/diagrams/data{n}.xml"] = f'<dgm:dataModel {spaces}><dgm:ptLst><dgm:pt type="pres"><dgm:t>{para("hidden")}</dgm:t></dgm:pt><dgm:pt><dgm:t>{para("by " + role)}</dgm:t></dgm:pt></dgm:ptLst></dgm:dataModel>'
        # The third category has no name, the second no value.
        series = f'<c:ser><c:tx>{points(["counts"])}</c:tx><c:cat>{points(["turn", "gap"])}</c:cat><c:val>{points([number, "", len(lines)])}</c:val></c:ser>'
        parts[f"ppt/charts/chart{n}.xml"] = f"<c:chartSpace {spaces}><c:chart><c:title>{para('Turn ' + str(number))}</c:title><c:plotArea>{series}</c:plotArea></c:chart></c:chartSpace>"
        parts[f"ppt/notesSlides/notesSlide{n}.xml"] = f"<p:notes {spaces}>{shape('sldNum', ['9'])}{shape('body', [f'Notes of {role}'])}</p:notes>"
    return _zipped(parts)


def of_conversations(conversations: DataFrame, extension: str) -> DataFrame:
    """pair_id, side, file_name and content of a package per conversation. A conversation is what a package can hold."""
    make: Callable = {"docx": word, "pptx": slides}[extension]

    def built(turns: pd.DataFrame) -> pd.DataFrame:
        turns = turns.sort_values("turn")
        conv = int(turns["conv_id"].iloc[0])
        return pd.DataFrame({"pair_id": [conv], "side": ["src"], "file_name": [f"{conv}.{extension}"], "content": [make(list(zip(turns["turn"].tolist(), turns["role"].tolist(), turns["text"].tolist(), strict=True)))]})

    known = conversations.where("conv_id is not null and turn is not null and role is not null").select("conv_id", "turn", "role", "text")
    return known.groupBy("conv_id").applyInPandas(built, "pair_id long, side string, file_name string, content binary")
