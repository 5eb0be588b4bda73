"""Word and PowerPoint packages to sections of blocks, from their XML parts, with the standard library."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from variorum.functions.similarity import _WS

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
_D = "{http://schemas.openxmlformats.org/drawingml/2006/diagram}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _clean(text: str) -> str:
    return _WS.sub(" ", text).strip()


def _block(kind: str, text: str, cells: list[str] | None = None, table_id: str | None = None, row_index: int | None = None) -> dict:
    return {"type": kind, "text": text, "cells": cells, "table_id": table_id, "row_index": row_index}


def _section(title: str, page: int | None = None, slide: int | None = None) -> dict:
    return {"title": title, "page": page, "slide": slide, "blocks": []}


def _word_text(p: ET.Element) -> str:
    return "".join(e.text or "" if e.tag == f"{_W}t" else " " if e.tag in (f"{_W}tab", f"{_W}br") else "" for e in p.iter())


def docx(data: bytes) -> list[dict]:
    """Headings open sections; numbered paragraphs are list items; every table row is a block."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    sections, tables = [_section("Document")], 0
    for child in body if body is not None else ():
        if child.tag == f"{_W}tbl":
            tables += 1
            row_no = 0
            for row in child.iter(f"{_W}tr"):
                cells = [_clean(" ".join(_word_text(p) for p in cell.iter(f"{_W}p"))) for cell in row.findall(f"{_W}tc")]
                if any(cells):
                    sections[-1]["blocks"].append(_block("tableRow", " | ".join(cells), cells, f"docx_table_{tables}", row_no))
                row_no += 1
        elif child.tag == f"{_W}p" and (text := _clean(_word_text(child))):
            style = child.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            if re.fullmatch(r"(?i)heading\s*\d+|title", name):
                sections.append(_section(text))
                sections[-1]["blocks"].append(_block("heading", text))
            else:
                listed = child.find(f"{_W}pPr/{_W}numPr") is not None
                sections[-1]["blocks"].append(_block("list" if listed else "paragraph", text))
    return [s for s in sections if s["blocks"]] or sections[:1]


def _paragraphs(e: ET.Element) -> list[str]:
    texts = [_clean("".join(t.text or "" for t in p.iter(f"{_A}t"))) for p in e.iter(f"{_A}p")]
    return [t for t in texts if t]


def _links(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    return {r.get("Id", ""): posixpath.normpath(posixpath.join(folder, r.get("Target", ""))).lstrip("/") for r in ET.fromstring(z.read(path))}


def _chart(z: zipfile.ZipFile, part: str) -> list[str]:
    root, out = ET.fromstring(z.read(part)), []
    title = root.find(f".//{_C}chart/{_C}title")
    if title is not None and (text := _clean(" ".join(_paragraphs(title)))):
        out.append(f"Chart title: {text}")

    def points(e: ET.Element | None) -> dict[int, str]:
        return {} if e is None else {int(p.get("idx", "0")): (p.findtext(f"{_C}v") or "").strip() for p in e.iter(f"{_C}pt")}

    for series in root.iter(f"{_C}ser"):
        name = "".join(points(series.find(f"{_C}tx")).values())
        categories = points(series.find(f"{_C}cat") if series.find(f"{_C}cat") is not None else series.find(f"{_C}xVal"))
        values = points(series.find(f"{_C}val") if series.find(f"{_C}val") is not None else series.find(f"{_C}yVal"))
        pairs = [f"{categories.get(i, f'#{i}')}: {values.get(i, '')}" for i in sorted(categories.keys() | values.keys())]
        out.append(f"{name} — {', '.join(pairs)}" if name else ", ".join(pairs))
    return [x for x in out if x]


def _smart_art(z: zipfile.ZipFile, part: str) -> list[str]:
    nodes = (pt for pt in ET.fromstring(z.read(part)).iter(f"{_D}pt") if pt.get("type", "node") in ("", "node"))
    return [t for pt in nodes for t in _paragraphs(pt)]


def pptx(data: bytes) -> list[dict]:
    """A section per slide, in numeric order: shapes, then SmartArt, charts, tables and notes."""
    sections = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        slides = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, part in slides:
            root, links = ET.fromstring(z.read(part)), _links(z, part)
            section = _section(f"Slide {number}", slide=number)
            blocks, titled = section["blocks"], False
            for shape in root.iter(f"{_P}sp"):
                texts = _paragraphs(shape)
                if not texts:
                    continue
                holder = shape.find(f".//{_P}nvPr/{_P}ph")
                if not titled and holder is not None and re.search("title", holder.get("type", ""), re.I):
                    titled, section["title"] = True, " ".join(texts)
                    blocks.append(_block("heading", section["title"]))
                else:
                    blocks += [_block("paragraph" if len(texts) == 1 else "list", t) for t in texts]
            frames = list(root.iter(f"{_P}graphicFrame"))
            for frame in frames:
                ids = frame.find(f".//{_D}relIds")
                if ids is not None and (target := links.get(ids.get(f"{_R}dm", ""))) in names:
                    blocks += [_block("list", t) for t in _smart_art(z, target)]
            for frame in frames:
                chart = frame.find(f".//{_C}chart")
                if chart is not None and (target := links.get(chart.get(f"{_R}id", ""))) in names:
                    blocks += [_block("paragraph", t) for t in _chart(z, target)]
            for k, table in enumerate(root.iter(f"{_A}tbl"), 1):
                row_no = 0
                for row in table.iter(f"{_A}tr"):
                    cells = [" ".join(_paragraphs(c)) for c in row.findall(f"{_A}tc")]
                    if any(cells):
                        blocks.append(_block("tableRow", " | ".join(cells), cells, f"slide{number}_table_{k}", row_no))
                        row_no += 1
            notes = f"ppt/notesSlides/notesSlide{number}.xml"
            if notes in names:
                for shape in ET.fromstring(z.read(notes)).iter(f"{_P}sp"):
                    holder = shape.find(f".//{_P}nvPr/{_P}ph")
                    if holder is not None and holder.get("type") == "body":
                        blocks += [_block("notes", t) for t in _paragraphs(shape)]
            sections.append(section)
    return sections
