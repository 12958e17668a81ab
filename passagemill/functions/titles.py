"""Titles of documents, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = [".md", ".markdown", ".txt", ".pdf", ".docx", ".pptx", ".xlsx", ".html", ".htm", ".csv", ".epub", ".ipynb"]
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]

# Words of file names that say nothing about the content.
GENERIC_STEM_WORDS = [
    "untitled", "document", "documents", "doc", "docs", "docx", "index", "readme", "new", "copy", "of", "scan", "image", "img", "file", "dsc", "screenshot", "report",
    "снимок", "документ", "документа", "документов", "копия", "копии", "безымянный",
]
# Headings that name a part every document has.
BOILERPLATE_HEADINGS = [
    "общие положения", "назначение", "введение", "назначение и область применения", "лист изменений", "история изменений", "содержание", "оглавление", "термины и определения", "список сокращений",
    "general provisions", "introduction", "overview", "purpose", "scope", "table of contents", "contents", "revision history", "change log", "definitions", "abbreviations",
]


def squeezed(c: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def stem(source: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(source, "/"), -1), r"\.[^.]*$", "")


def extension(source: Column) -> Column:
    return F.lower(F.regexp_extract(source, r"(\.[^./]+)$", 1))


def display_stem(name: Column) -> Column:
    shown = squeezed(F.replace(name, F.lit("_"), F.lit(" ")))
    return F.when(shown == "", name).otherwise(shown)


def without_extension(title: Column) -> Column:
    """One known extension left at the end goes, unless nothing would stay."""
    known = "|".join(x[1:] for x in [*EXTENSIONS, *IMAGE_EXTENSIONS])
    cut = F.regexp_replace(title, rf"(?i)\.({known})$", "")
    return F.when(F.trim(cut) == "", title).otherwise(cut)


def informative(name: Column) -> Column:
    """Whether a file's stem says something: four characters or more, and a word that is neither a
    number nor a generic one."""
    bare = F.regexp_replace(name, r"(?U)[\s_\-.]+", "")
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\p{L}+|\p{Nd}+)"), F.lit(1))
    said = F.filter(parts, lambda w: ~w.rlike(r"^\p{Nd}+$") & ~w.isin(GENERIC_STEM_WORDS))
    return (F.length(bare) >= 4) & (F.size(said) > 0)


def first_h1(markdown: Column) -> Column:
    """The first top heading; fenced blocks are taken out before."""
    open_text = F.regexp_replace(markdown, r"(?ms)^[ \t]*(`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t]*\1[`~]*[ \t]*$|\z)", "")
    return F.nullif(F.regexp_extract(open_text, r"(?m)^#[ \t]+(\S.*?)[ \t]*$", 1), F.lit(""))


def usable_heading(heading: Column) -> Column:
    """Not one of the parts every document has, whatever its numbering, and with a word in it."""
    bare = F.lower(F.regexp_replace(squeezed(heading), r"^[*_`~#\[\]() \t.:;,!–—-]+|[*_`~#\[\]() \t.:;,!–—-]+$", ""))
    bare = F.regexp_replace(bare, r"^(?:(?:\d+|[ivxlcdm]+)(?:[.)]\s*|\s+))+", "")
    shown = F.regexp_replace(heading, r"!\[[^\]]*\]\([^)]*\)", "")
    return ~bare.isin(BOILERPLATE_HEADINGS) & shown.rlike(r"\p{L}|\p{N}")


def file_title(metadata: Column, markdown: Column, source: Column) -> Column:
    """Metadata, a usable heading, an informative stem, any heading, the stem: the first there is."""
    given = F.nullif(F.regexp_replace(metadata, r"(?U)^\s+|\s+$", ""), F.lit(""))
    h1 = first_h1(markdown)
    name = without_extension(stem(source))
    return F.coalesce(given, F.when(usable_heading(h1), h1), F.when(informative(name), display_stem(name)), h1, display_stem(name))


def strip_data_images(markdown: Column) -> Column:
    """Embedded images become their trimmed description, outside fenced blocks and within a line; a
    text of nothing else stays."""
    fenced = r"(^[ \t]*(`{3,}|~{3,})[^\n]*(?:\n.*?(?:^[ \t]*\2[^\n]*$|\z)|\z))"
    cut = F.regexp_replace(markdown, rf"(?ms){fenced}|!\[[ \t]*([^\]\n]*?)[ \t]*\]\([ \t]*data:[^)\n]*\)", "$1$3")
    return F.when(squeezed(cut) == "", markdown).otherwise(cut)


def display_path(source: Column, roots: list[str]) -> Column:
    """A source without the longest root it lies in."""
    out = source
    for root in sorted({r.rstrip("/") for r in roots}, key=len):
        out = F.when(source.startswith(root + "/"), F.substr(source, F.lit(len(root) + 2))).otherwise(out)
    return out
