"""HTML bodies to blocks: headings open sections, list items and table rows are blocks of their own."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.functions.similarity import _WS
from variorum.schema import BLOCK_COLUMNS

_HEADINGS = {f"h{i}" for i in range(1, 7)}
_SKIPPED = {"script", "style", "title"}
#: Elements that leave a head open; all others, and text, end it, as its end tag may be left out.
_IN_HEAD = {"html", "head", "meta", "link", "base", "noscript", "template"} | _SKIPPED


def _clean(text: str) -> str:
    return _WS.sub(" ", text).strip()


class _Walker(HTMLParser):
    """Collects blocks of the body's children. End tags that HTML lets out are supplied: a list item ends with the next one or
    its list, a row and a cell with the next one or their table, a paragraph with the next block, the head with the first
    thing that can't stand in it. A nested list item's or cell's text counts for its parent and again for itself."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.sections: list[tuple[str, list[dict]]] = [("Document", [])]
        self.open: list[tuple[str, list[str]]] = []  # element under way, and its text
        self.skip = 0
        self.head = False
        self.lists: list[tuple[str, int]] = []  # open lists, and how many items were open where each began
        self.items: list[list[str]] = []
        self.tables: list[int] = []  # how many rows were open where each open table began
        self.rows: list[tuple[dict, int]] = []  # open rows, and how many cells were open where each began
        self.cells: list[list[str]] = []
        self.n_tables = self.n_rows = 0

    def _block(self, kind: str, text: str | list[str]) -> dict:
        block = {"type": kind, "text": text, "cells": None, "table_id": None, "row_index": None}
        self.sections[-1][1].append(block)
        return block

    def _flush(self) -> None:
        while self.open:
            name, parts = self.open.pop()
            text = _clean("".join(parts))
            if text and name in _HEADINGS:
                self.sections.append((text, []))
            if text:
                self._block("heading" if name in _HEADINGS else "paragraph", text)

    def _close_rows(self, upto: int) -> None:
        if len(self.rows) > upto:
            del self.cells[self.rows[upto][1] :]
            del self.rows[upto:]

    def handle_starttag(self, tag: str, attrs: list) -> None:  # noqa: ARG002
        if tag == "head":
            self.head = True
        elif self.head and tag not in _IN_HEAD:
            self.head = False
        if tag in _SKIPPED:
            self.skip += 1
        elif tag == "br":
            self.handle_data(" ")
        elif tag in _HEADINGS or tag == "p":
            if not self.rows and not self.items:
                self._flush()
                self.open.append((tag, []))
        elif tag in ("ul", "ol"):
            if not self.rows:
                self._flush()
            self.lists.append((tag, len(self.items)))
        elif tag == "li":
            if not self.rows:
                self._flush()
            del self.items[self.lists[-1][1] if self.lists else 0 :]
            self.items.append([])
            if not self.rows:
                self._block("list", self.items[-1])
        elif tag == "table":
            self._flush()
            if not self.tables:
                self.n_tables, self.n_rows = self.n_tables + 1, 0
            self.tables.append(len(self.rows))
        elif tag == "tr" and self.tables:
            self._row()
        elif tag in ("td", "th") and self.tables:
            if len(self.rows) <= self.tables[-1]:
                self._row()
            del self.cells[self.rows[-1][1] :]
            self.cells.append([])
            for block, _ in self.rows:
                block["cells"].append(self.cells[-1])

    def _row(self) -> None:
        self._close_rows(self.tables[-1])
        block = self._block("tableRow", "") | {"cells": [], "table_id": f"table_{self.n_tables}", "row_index": self.n_rows}
        self.sections[-1][1][-1] = block
        self.n_rows += 1
        self.rows.append((block, len(self.cells)))

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.head = False
        elif tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "li":
            least = self.lists[-1][1] if self.lists else 0
            if len(self.items) > least:
                del self.items[least:]
        elif tag in ("ul", "ol") and any(name == tag for name, _ in self.lists):
            while (ended := self.lists.pop())[0] != tag:
                pass
            del self.items[ended[1] :]
        elif tag in ("td", "th") and self.rows:
            del self.cells[self.rows[-1][1] :]
        elif tag == "tr" and self.tables:
            self._close_rows(self.tables[-1])
        elif tag == "table" and self.tables:
            self._close_rows(self.tables.pop())
        elif any(name == tag for name, _ in self.open):
            self._flush()

    def handle_data(self, data: str) -> None:
        if self.skip or self.head and not data.strip():
            return
        self.head = False
        for cell in self.cells:
            cell.append(data)
        if self.rows:
            return
        if self.items:
            for item in self.items:
                item.append(data)
        elif self.open:
            self.open[-1][1].append(data)
        elif data.strip():
            self.open.append(("", [data]))

    def blocks(self) -> list[tuple[str, list[dict]]]:
        self._flush()
        out = []
        for title, blocks in self.sections:
            done = []
            for b in blocks:
                if b["cells"] is not None:
                    cells = [_clean("".join(c)) for c in b["cells"]]
                    b = b | {"cells": cells, "text": " | ".join(cells) if any(cells) else ""}
                elif isinstance(b["text"], list):
                    b = b | {"text": _clean("".join(b["text"]))}
                done.append(b)
            out.append((title, [b for b in done if b["text"]]))
        return [s for s in out if s[1]] or out[:1]


def parse(html: str | None) -> list[tuple[str, list[dict]]]:
    """Sections (title, blocks)."""
    walker = _Walker()
    walker.feed(html or "")
    walker.close()
    return walker.blocks()


def blocks(documents: DataFrame, html: str = "html") -> DataFrame:
    """pair_id, side and an HTML column to a table of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pair, side, text in zip(batch["pair_id"], batch["side"], batch[html], strict=True):
                for s, (title, found) in enumerate(parse(text)):
                    rows += [(pair, side, s, title, None, None, i, b["type"], b["text"], b["cells"], b["table_id"], b["row_index"]) for i, b in enumerate(found)]
            frame = pd.DataFrame(rows, columns=BLOCK_COLUMNS)
            for c in ("page", "slide", "row_index"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    from variorum.schema import BLOCKS

    return documents.select(F.col("pair_id").cast("long").alias("pair_id"), "side", html).mapInPandas(run, BLOCKS)
