"""Oversized texts cut into pieces under a token limit, at natural boundaries, with overlap.

A hierarchy of separators is tried in turn: sections, paragraphs, sentences, words, characters.
A part that fits stays whole; one that does not is cut at the next finer separator.  Neighbouring
parts are then packed greedily, and each piece after the first begins with the last whole units
of the one before, up to the overlap.  Pieces are slices of the text: taking from each what lies
after the end of the one before gives the text again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from passagemill.llm.common import pick
from passagemill.llm.tokens import counter, token_path

LIMIT = 512
OVERLAP = 64
SECTION, PARAGRAPH, SENTENCE, WORD, CHARACTER = range(5)
_BREAKS = (
    (SECTION, re.compile(r"\n(?=#{1,6} |=+ ?\S|<!-- Slide|\\(?:sub)*section|<h[1-6]\b)", re.IGNORECASE)),
    (PARAGRAPH, re.compile(r"\n[ \t]*\n\s*")),
    (SENTENCE, re.compile(r"(?<=[.!?…])\s+|\n+")),
    (WORD, re.compile(r"(?<=\S)(?=\s)")),
)


def surely_over(count, characters: int, limit: int) -> bool:
    """Whether a text of so many characters has more tokens than the limit, whatever it says."""
    longest = getattr(count, "longest", None)
    return longest is not None and characters > longest * limit


def units(text: str, count, room: int) -> list[tuple[int, int, int, int]]:
    """``(start, end, tokens, level)``: consecutive slices of ``text`` of at most ``room`` tokens
    each, cut at the coarsest separators that allow it; ``level`` is that of the cut before.

    Every sentence is counted once; what is made of several has the sum of their counts.
    """
    level_at: dict[int, int] = {}
    for level, pattern in _BREAKS[:WORD]:
        for m in pattern.finditer(text):
            at = m.end() if level else m.start() + 1
            if 0 < at < len(text):
                level_at.setdefault(at, level)
    edges = [0, *sorted(level_at), len(text)]
    # A space counts with the word after it, as in the whole text, so that the counts add up.
    counted = [0, *(e - (text[e - 1] == " ") for e in edges[1:-1]), len(text)]
    sizes = [room + 1 if surely_over(count, y - x, room) else count(text[x:y]) for x, y in zip(counted[:-1], counted[1:], strict=True)]
    total = [0]
    for n in sizes:
        total.append(total[-1] + n)
    out: list[tuple[int, int, int, int]] = []
    todo = [(0, len(sizes), SECTION, SECTION)]
    while todo:
        i, j, level, cut = todo.pop()
        if total[j] - total[i] <= room:
            out.append((edges[i], edges[j], total[j] - total[i], cut))
        elif j - i == 1:
            out += _finer(text, count, room, edges[i], edges[j], cut)
        else:
            inner = [x for x in range(i + 1, j) if level_at[edges[x]] <= level]
            bounds = [i, *inner, j]
            todo += [(x, y, level + 1 if len(bounds) == 2 or y - x > 1 else SENTENCE, cut if x == i else level) for x, y in zip(bounds[:-1], bounds[1:], strict=True)][::-1]
    return out


def _finer(text: str, count, room: int, start: int, end: int, cut: int) -> list[tuple[int, int, int, int]]:
    """A sentence over the limit as words, and a word over it as runs of characters."""
    out: list[tuple[int, int, int, int]] = []
    edges = [start, *(m.start() for m in _BREAKS[WORD][1].finditer(text, start, end) if start < m.start() < end), end]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        todo = [(lo, hi, WORD if lo > start else cut)]
        while todo:
            a, b, level = todo.pop()
            size = room + 1 if surely_over(count, b - a, room) else count(text[a:b])
            if size <= room or b - a == 1:
                out.append((a, b, size, level))
                continue
            step = max(1, min(room // 4, (b - a + 1) // 2))
            todo += [(x, min(b, x + step), CHARACTER if x > a else level) for x in range(a, b, step)][::-1]
    return out


def pieces(text: str, count, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """``(start, end, tokens)`` of each piece of ``text``; none of more than ``limit`` tokens.

    ``count`` gives the tokens of a slice; a sum over slices may differ from the count of their
    whole, so that every piece is counted again and shortened by a unit where it is over.
    """
    if not text:
        return []
    overlap = max(0, min(overlap, limit // 2))
    parts = units(text, count, max(1, limit - overlap)) if len(text) > 4 * limit else []
    if not _opening_over(text, count, parts, limit):
        size = count(text)
        if size <= limit:
            return [(0, len(text), size)]
        parts = parts or units(text, count, max(1, limit - overlap))
    out: list[tuple[int, int, int]] = []
    i = 0
    while i < len(parts):
        start = parts[i][0]
        if out and overlap:
            start = _overlap_start(text, count, out[-1][0], parts[i][0], overlap)
        spent, j = count(text[start : parts[i][0]]) if start < parts[i][0] else 0, i
        while j < len(parts) and spent + parts[j][2] <= limit:
            spent += parts[j][2]
            j += 1
        j = max(j, i + 1)
        size = count(text[start : parts[j - 1][1]])
        while size > limit and j > i + 1:
            j -= 1
            size = count(text[start : parts[j - 1][1]])
        room = overlap
        while size > limit and start < parts[i][0]:  # the whole may count more than its parts: a shorter overlap
            room -= size - limit
            start = _overlap_start(text, count, out[-1][0], parts[i][0], room) if room > 0 else parts[i][0]
            size = count(text[start : parts[j - 1][1]])
        out.append((start, parts[j - 1][1], size))
        i = j
    return out


def _opening_over(text: str, count, parts: list[tuple[int, int, int, int]], limit: int) -> bool:
    """Whether the opening of a text, of about twice the limit, shows that the whole is over it: what
    follows can change the tokens of its last unit, but no others."""
    total = 0
    for start, end, size, _ in parts:
        total += size
        if total >= 2 * limit:
            return bool(text[start:end].strip()) and count(text[:start]) > limit
    return False


def _overlap_start(text: str, count, floor: int, end: int, overlap: int) -> int:
    """Where the overlap before ``end`` begins: the earliest sentence start within reach, else the
    earliest word start, else the earliest character."""
    lo = max(floor + 1, end - 8 * overlap)
    while True:
        words = [lo + m.start() for m in re.finditer(r"(?<=\s)\S", text[lo:end])]
        if words or lo == floor + 1 or count(text[lo:end]) > overlap:
            break
        lo = max(floor + 1, 2 * lo - end)
    a = _earliest(words, text, count, end, overlap)
    if a == len(words):
        inner = range(words[-1] if words else lo, end)
        a = _earliest(inner, text, count, end, overlap)
        return inner[a] if a < len(inner) else end
    first = words[a]
    sentence = next((first + m.end() for m in re.finditer(r"[.!?…]\s+", text[first:end]) if first + m.end() < end), None)
    return sentence if sentence is not None and 2 * (end - sentence) >= end - first else first


def _earliest(starts: Sequence[int], text: str, count, end: int, overlap: int) -> int:
    """The number of the earliest start from which no more than the overlap remains."""
    a, b = 0, len(starts)
    while a < b:
        mid = (a + b) // 2
        if count(text[starts[mid] : end]) <= overlap:
            b = mid
        else:
            a = mid + 1
    return a


def split_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = "byte_bpe_multi_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """``(doc_id, piece int, start int, end int, tokens int, text string)``: ordered pieces, from 0.

    ``start`` and ``end`` are character offsets; ``tokens`` is at most ``limit`` (a single
    character of more tokens is the one exception).  A text within the limit is one piece.  Null
    and empty texts have none; rows with a null id keep it; repeated rows are split each.
    """
    path = token_path(tokenizer, folder)
    kind = dict(pick(df, doc_id=id_col).dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            at, number, rows, texts = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for p, (start, end, size) in enumerate(pieces(text or "", count, limit, overlap)):
                    at.append(i)
                    number.append(p)
                    rows.append((start, end, size))
                    texts.append(text[start:end])
                if len(at) > 5_000:
                    yield _pieces_batch(batch, at, number, rows, texts)
                    at, number, rows, texts = [], [], [], []
            yield _pieces_batch(batch, at, number, rows, texts)

    return pick(df, doc_id=id_col, text=text_col).mapInArrow(cut, f"doc_id {kind}, piece int, start int, end int, tokens int, text string")


def _pieces_batch(batch: pa.RecordBatch, at: list, number: list, rows: list, texts: list) -> pa.RecordBatch:
    cols = np.array(rows, dtype=np.int32).reshape(-1, 3)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(at, type=pa.int64())), pa.array(number, type=pa.int32()), *(pa.array(cols[:, j]) for j in range(3)), pa.array(texts, type=pa.string())],
        names=["doc_id", "piece", "start", "end", "tokens", "text"],
    )
