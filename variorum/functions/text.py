"""Scalar text functions as Column expressions: normalisation, sentences, tokens, patterns, labels.

White space is the class that the engine's semantics name (Unicode spaces, no-break space and byte-order mark
included), never the narrower one of SQL's trim().
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, folded characters, patterns and thresholds that results depend on.
WS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
WS_CHARACTERS = "".join(chr(c) for c in (*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
BULLET = rf"^{WS}*[•▪◦‣∙·–—\-\*]{WS}+"
PUNCTUATION = r"""[.,;:!?"'“”‘’()\[\]{}]"""
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_MON = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
PATTERNS = {
    "percentage": rf"-?\d+(?:\.\d+)?{WS}?%",
    "currency": rf"(?i)(?:[$₹€£¥]|Rs\.?|INR|USD|EUR|GBP){WS}?-?\d{{1,3}}(?:,\d{{2,3}})*(?:\.\d+)?",
    "fiscalYear": rf"(?i){_B}FY{WS}?-?\d{{2,4}}{_E}|{_B}Q[1-4]{WS}?FY{WS}?-?\d{{2,4}}{_E}",
    "date": rf"(?i){_B}\d{{1,2}}[-/ ]{_MON}[-/ ]\d{{2,4}}{_E}|{_B}{_MON}[ .,]+\d{{1,2}}[a-z]{{0,2}},?[ ]+\d{{2,4}}{_E}|{_B}\d{{4}}-\d{{2}}-\d{{2}}{_E}|{_B}\d{{1,2}}/\d{{1,2}}/\d{{2,4}}{_E}|{_B}\d{{1,2}}-\d{{1,2}}-\d{{2,4}}{_E}",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "url": r"""(?i)(https?://[^\s,)"'<>]+)|(www\.[^\s,)"'<>]+\.[a-zA-Z]{2,}[^\s,)"'<>]*)""",
    "number": r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?",
}
SKELETON = r"-?\d+(?:,\d{3})*(?:\.\d+)?"
HEADER_FOOTER_LENGTH = 60
FOLDED = "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0"
#: Spaces and tabs that become one space; a single space is one already.
SEVERAL = r"[ \t]{2,}|\t"


@dataclass(frozen=True)
class NormalizeOptions:
    ignore_case: bool = True
    ignore_extra_spaces: bool = True
    ignore_blank_lines: bool = True
    ignore_bullet_symbols: bool = True
    ignore_punctuation: bool = False
    ignore_headers: bool = False
    ignore_footers: bool = False


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARACTERS))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once however often f reads it (Spark copies the expression of a plain column)."""
    return F.transform(F.array(value), f)[0]


def normalize(c: Column, opts: NormalizeOptions = NormalizeOptions()) -> Column:
    """Quotes, dashes and no-break spaces folded, then bullets, spaces, punctuation and case as the options say."""
    c = F.coalesce(c, F.lit(""))
    # Folding and joining look at every character: only what has something to fold or to join goes there.
    c = F.when(c.rlike(f"[{FOLDED}]"), F.translate(c, FOLDED, "''\"\"-- ")).otherwise(c)
    if opts.ignore_bullet_symbols:
        c = F.regexp_replace(c, BULLET, "")
    if opts.ignore_extra_spaces:
        c = js_trim(F.regexp_replace(c, SEVERAL, " "))
    if opts.ignore_punctuation:
        c = F.regexp_replace(F.regexp_replace(c, PUNCTUATION, ""), SEVERAL, " ")
    if opts.ignore_case:
        c = F.lower(c)
    return js_trim(c)


def split_sentences(c: Column) -> Column:
    """Cut after . ! ? before a capital, digit, quote or bracket, and at line feeds; the trimmed text where nothing is left."""
    parts = F.filter(F.transform(F.split(c, rf"""(?<=[.!?]){WS}+(?=[A-Z0-9"“'(])|\n+"""), js_trim), lambda s: s != "")
    some = once(parts, lambda p: F.when(F.size(p) == 0, F.array(js_trim(c))).otherwise(p))
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(some)


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{WS}+"), lambda t: t != "")


def matches(c: Column, name: str) -> Column:
    """All matches of a named pattern, trimmed."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PATTERNS[name]), F.lit(0)), js_trim)


def number_skeleton(c: Column) -> Column:
    return F.regexp_replace(c, SKELETON, "#")


def unclaimed(c: Column) -> Column:
    """The text without what percentages, currency, fiscal years and dates claim, for the number scan."""
    for name in ("percentage", "currency", "fiscalYear", "date"):
        c = F.regexp_replace(c, PATTERNS[name], " ")
    return c


def escape_html(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def format_bytes(c: Column) -> Column:
    n = c.cast("double")
    exponent = F.least(F.lit(3), F.greatest(F.lit(0), F.floor(F.log2(n) / 10 + 1e-12))).cast("int")
    scaled = n / F.pow(F.lit(1024.0), exponent)
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), exponent + 1)
    text = F.when(exponent == 0, F.format_string("%d", F.floor(scaled + 0.5).cast("long"))).otherwise(F.format_string("%.1f", scaled))
    return F.when(n.isNull() | (n == 0), F.lit("0 B")).otherwise(F.concat_ws(" ", text, unit))


def format_duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit(" ms"))).otherwise(F.format_string("%.2f s", ms / 1000.0))


def file_extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(?i)\.([a-z0-9]+)$", 1))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return js_trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", " "))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def reconcile_key(c: Column) -> Column:
    return collapse(F.lower(c))


def append_comment(existing: Column, addition: Column) -> Column:
    return F.when(F.coalesce(existing, F.lit("")) == "", addition).otherwise(F.concat_ws(" | ", existing, addition))


def _where(page: Column, slide: Column) -> Column:
    return F.when(slide.isNotNull(), F.concat(F.lit("Slide "), slide.cast("string"))).when(page.isNotNull(), F.concat(F.lit("Page "), page.cast("string")))


def location_label(section: Column, page: Column, slide: Column, is_table: Column) -> Column:
    """Section and slide or page; the latter is left out where the section is called so."""
    base = F.when(F.coalesce(section, F.lit("")) == "", F.lit("Document")).otherwise(section)
    where = _where(page, slide)
    label = F.when(where.isNull() | (base == where), base).otherwise(F.concat(base, F.lit(" — "), where))
    return F.concat(label, F.when(is_table, F.lit(" (table)")).otherwise(F.lit("")))


def section_label(section: Column, page: Column, slide: Column) -> Column:
    where = _where(page, slide)
    return F.when(where.isNull() | (section == where), section).otherwise(F.concat(where, F.lit(" — "), section))


def slide_index(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"slide(\d+)\.xml$", 1).try_cast("int"), F.lit(0))


def js_round(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))
