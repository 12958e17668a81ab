"""Text that looks the same brought to one form.

A character is *stable* if it can appear in the levelled form next to any other stable character:
it is its own decomposition, is no mark, and is neither invisible, nor a space of another kind,
nor a full-width form, nor a letter that looks like one of another script.  One regular expression
with these quick-check properties finds the unstable runs; each is extended by the character
before it where it begins with a mark (its boundary context), is levelled on its own, and is
spliced into the text, whose stable parts are never touched.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of Cyrillic and Greek, in natural order, and the Latin letters they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТХѴԌԚԜаеѕіјорсухһԁԛԝҮ"
AS_LATIN_1 = "ABESIJKMHOPCTXVGQWaesijopcyxhdqwY"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲονϳ"
AS_LATIN_2 = "ABEZHIKMNOPTYXcovj"
UKRAINIAN_U = "У"  # the capital also stands for Y
LOOKS_LIKE = {**dict(zip(CYRILLIC, AS_LATIN_1, strict=True)), **dict(zip(GREEK, AS_LATIN_2, strict=True)), UKRAINIAN_U: "Y"}

_LEVEL = {ord(k): v for k, v in LOOKS_LIKE.items()}


def _kind(ch: str) -> str:
    """'' for a stable character, else why it is not."""
    code, category = ord(ch), unicodedata.category(ch)
    if ch in LOOKS_LIKE:
        return "look-alike"
    if 0xFF01 <= code <= 0xFF5E or 0xFFE0 <= code <= 0xFFE6 or 0xFF61 <= code <= 0xFFDC:
        return "width"
    if category == "Zs":
        return "" if ch == " " else "space"
    if category == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164):
        return "invisible"
    if category in ("Mn", "Mc", "Me"):
        return "mark"
    if not 0xAC00 <= code <= 0xD7A3 and not unicodedata.is_normalized("NFD", ch):
        return "composed"
    return ""


@lru_cache(maxsize=1)
def _unstable() -> re.Pattern:
    """One class of all unstable characters, built by the rule above over the whole of Unicode."""
    spans: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or not _kind(chr(code)):
            continue
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]+")


def _narrow(ch: str) -> str:
    return unicodedata.normalize("NFKC", ch) if _kind(ch) == "width" else ch


def _levelled(segment: str) -> str:
    kept = []
    for ch in segment:
        kind = _kind(ch)
        if kind == "invisible":
            continue
        kept.append(" " if kind == "space" else _narrow(ch))
    return unicodedata.normalize("NFD", "".join(kept)).translate(_LEVEL)


def level(text: str) -> str:
    """The form in which texts that look the same are equal: decomposed, with look-alikes as Latin."""
    if text.isascii():
        return text
    out, done = [], 0
    for m in _unstable().finditer(text):
        lo = m.start()
        if lo > done and _kind(text[lo]) in ("mark", "invisible", "width"):
            lo -= 1  # boundary context: the starter a mark may compose with
        out += [text[done:lo], _levelled(text[lo : m.end()])]
        done = m.end()
    out.append(text[done:])
    # Where an unstable run ends, nothing can reorder or compose across the border: what follows is a stable starter.
    return "".join(out)


_BACK = {lang: {v: k for k, v in zip(table, latin, strict=True)} for lang, table, latin in (("CYRILLIC", CYRILLIC, AS_LATIN_1), ("GREEK", GREEK, AS_LATIN_2))}


def _script(ch: str) -> str:
    return unicodedata.name(ch, "").split(" ")[0]


def canonical(text: str) -> str:
    """One readable form of all texts with the same :func:`level`: composed accents, plain spaces,
    nothing invisible, and each word in one script (that of its letters without a double)."""

    def word(m: re.Match) -> str:
        letters = m.group()
        own = [s for s in map(_script, letters) if s in ("CYRILLIC", "GREEK")]
        if not own:
            return letters
        back = _BACK[max(sorted(set(own)), key=own.count)]
        return "".join(back.get(ch, ch) for ch in letters)

    return unicodedata.normalize("NFC", re.sub(r"\w+", lambda m: word(m) if not m.group().isascii() else m.group(), level(text)))


def one_form(df: DataFrame, columns: list[str], form=canonical) -> DataFrame:
    """``(field, value, form)``: each distinct non-null value of each of ``columns`` with its form.

    Nulls are left out, an empty string stays itself, an empty table gives no rows.  Only distinct
    values are looked at, once each.
    """

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = pa.array([form(v) for v in batch.column(1).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), forms], names=["field", "value", "form"])

    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x"))
    values = pairs.select("x.field", "x.value").where("value is not null").distinct()
    return values.mapInArrow(shape, "field string, value string, form string")


def same_looking(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(field, value_a, value_b)``: pairs of different values of a column that look the same."""
    forms = one_form(df, columns, level)
    a, b = forms.alias("a"), forms.alias("b")
    return a.join(b, (F.col("a.field") == F.col("b.field")) & (F.col("a.form") == F.col("b.form")) & (F.col("a.value") < F.col("b.value"))).select(
        F.col("a.field").alias("field"), F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b")
    )
