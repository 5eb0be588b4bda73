"""Tables and types that the stages hand on."""

from __future__ import annotations

#: A document as parsers give it: sections of blocks.
RAW_DOCUMENT = (
    "doc_type string, file_name string, sections array<struct<title:string,page:int,slide:int,"
    "blocks:array<struct<type:string,text:string,cells:array<string>,table_id:string,row_index:int>>>>"
)
#: The same, a row per block; every table of the engine begins with (pair_id, side), side being src or out.
BLOCKS = "pair_id long, side string, sec_idx int, title string, page int, slide int, block_idx int, type string, text string, cells array<string>, table_id string, row_index int"
BLOCK_COLUMNS = [x.split()[0] for x in BLOCKS.split(", ")]
TABLE_ROW = "tableRow"
