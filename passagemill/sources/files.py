"""Files on disk as a table, and their text as Markdown."""

from __future__ import annotations

import csv
import io
import itertools
import json
import os
import statistics
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.titles import EXTENSIONS, extension, strip_data_images

SKIPPED = {"node_modules", "__pycache__", ".venv", "venv"}


def scan(spark: SparkSession, roots: Sequence[str], extensions: Sequence[str] = tuple(EXTENSIONS)) -> DataFrame:
    """``(path, size, mtime)`` of readable files under the roots, by path; hidden files and folders
    are skipped, links to folders not followed, linked files kept only if they lead into a root."""
    real_roots = [os.path.realpath(r) for r in roots]
    found: dict[str, tuple[str, int, float]] = {}
    for root in real_roots:
        for folder, inner, names in os.walk(root):
            inner[:] = sorted(d for d in inner if d[0] != "." and d not in SKIPPED)
            for name in sorted(names):
                path = os.path.join(folder, name)
                real = os.path.realpath(path)
                inside = any(real == r or real.startswith(r + "/") for r in real_roots)
                if name[0] == "." or os.path.splitext(name)[1].lower() not in extensions or not inside or not os.path.isfile(real):
                    continue
                stat = os.stat(real)
                found.setdefault(real, (path, stat.st_size, stat.st_mtime))
    rows = sorted(found.values())
    return spark.createDataFrame(rows, "path string, size bigint, mtime double")


class _Markdown(HTMLParser):
    """A whole body as Markdown; only scripts and styles are left out."""

    BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "blockquote", "table", "ul", "ol", "pre", "br", "hr", "figure", "form"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title = ""
        self.muted = self.in_title = self.in_pre = 0
        self.lists: list[list] = []
        self.link = ""
        self.row: list[str] | None = None
        self.rows = 0

    def handle_starttag(self, tag, attrs) -> None:
        attrs = dict(attrs)
        if tag in ("script", "style"):
            self.muted += 1
        elif tag == "title":
            self.in_title += 1
        elif tag[0] == "h" and tag[1:].isdigit():
            self.out.append(f"\n\n{'#' * int(tag[1:])} ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append(f"\n{'  ' * (len(self.lists) - 1)}{f'{kind[1]}.' if kind[0] == 'ol' else '-'} ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and attrs.get("href"):
            self.link = attrs["href"]
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{attrs.get('alt') or ''}]({attrs.get('src') or ''})")
        elif tag == "pre":
            self.in_pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.in_pre:
            self.out.append("`")
        elif tag == "table":
            self.rows = 0
            self.out.append("\n\n")
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append("")
        elif tag == "br":
            self.out.append("\n")
        elif tag in self.BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag) -> None:
        if tag in ("script", "style"):
            self.muted = max(0, self.muted - 1)
        elif tag == "title":
            self.in_title = 0
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("" if self.lists else "\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and self.link:
            self.out.append(f"]({self.link})")
            self.link = ""
        elif tag == "pre":
            self.in_pre = max(0, self.in_pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.in_pre:
            self.out.append("`")
        elif tag == "tr" and self.row is not None:
            cells = self.row
            self.row = None
            self.out.append("| " + " | ".join(" ".join(c.split()) for c in cells) + " |\n")
            self.rows += 1
            if self.rows == 1:
                self.out.append("|" + " --- |" * len(cells) + "\n")
        elif (tag[0] == "h" and tag[1:].isdigit()) or tag in self.BLOCKS:
            self.out.append("\n\n")

    def handle_data(self, data) -> None:
        if self.in_title:
            self.title += data
        elif self.row is not None and self.row:
            self.row[-1] += data
        elif not self.muted and self.row is None:
            self.out.append(data if self.in_pre else " ".join(data.split()) + " " * (data[-1:].isspace() and bool(data.strip())) if data.strip() else " " if self.out and self.out[-1][-1:] not in ("\n", " ", "") else "")

    def text(self) -> str:
        lines = [x.rstrip() if not x.startswith("    ") else x for x in "".join(self.out).split("\n")]
        kept: list[str] = []
        for line in lines:
            if line.strip() or (kept and kept[-1].strip()):
                kept.append(line)
        return "\n".join(kept).strip()


def html_to_markdown(page: str) -> tuple[str, str | None]:
    """Markdown of a page, and its title if it has one."""
    reader = _Markdown()
    reader.feed(page)
    reader.close()
    return reader.text(), " ".join(reader.title.split()) or None


def csv_to_markdown(text: str) -> str:
    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    if not rows:
        return ""
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * len(rows[0]), *map(line, rows[1:])])


def notebook_to_markdown(text: str) -> str:
    out = []
    for cell in json.loads(text).get("cells", []):
        source = "".join(cell.get("source", []))
        if source.strip():
            out.append(source if cell.get("cell_type") != "code" else f"```python\n{source}\n```")
    return "\n\n".join(out)


def to_markdown(content: bytes, suffix: str) -> tuple[str, str | None]:
    text = content.decode("utf-8", errors="replace")
    if suffix in (".html", ".htm"):
        return html_to_markdown(text)
    if suffix == ".csv":
        return csv_to_markdown(text), None
    if suffix == ".ipynb":
        return notebook_to_markdown(text), None
    if suffix in (".md", ".markdown", ".txt"):
        return text, None
    raise ValueError(f"UnsupportedFormatError: no converter for {suffix or 'files without an extension'}")


def parsed(files: DataFrame, converter=to_markdown) -> DataFrame:
    """``(path, markdown, meta_title, file_hash, error)`` from ``(path, content)``; a file that cannot
    be read has its error in its row, and the job goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for content, suffix in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    if content is None:
                        raise OSError("the file cannot be read")
                    out.append((*converter(content, suffix), None))
                except Exception as e:  # noqa: BLE001 - one bad file must not end the job
                    out.append((None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=pa.string()) for c in cols), batch.column(3)], names=["path", "markdown", "meta_title", "error", "file_hash"])

    rows = files.select("path", "content", extension(F.col("path")).alias("suffix"), F.sha2("content", 256).alias("file_hash"))
    done = rows.mapInArrow(run, "path string, markdown string, meta_title string, error string, file_hash string")
    return done.withColumn("markdown", strip_data_images(F.col("markdown")))


def read_files(spark: SparkSession, entries: DataFrame, max_file_size: int) -> DataFrame:
    """``(path, content)`` of scanned files within the size limit; sizes are tested before anything
    is read.  Files are opened by the executors, which must see the same folder; Spark's own reader
    would leave out names that begin with an underscore."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with open(path, "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], type=pa.binary())], names=["path", "content"])

    wanted = entries.where(F.col("size") <= max_file_size).select("path")
    return wanted.repartition(F.col("path")).mapInArrow(load, "path string, content binary")


def still_there(paths: DataFrame) -> DataFrame:
    """``(source)``: those of a table of paths that are files, as the executors see them."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([os.path.isfile(p) for p in batch.column(0).to_pylist()], type=pa.bool_()))

    return paths.select("source").where("source is not null").mapInArrow(test, "source string")


def assemble_lines(boxes: Sequence, texts: Sequence[str]) -> str:
    """Reading order of recognised line boxes: rows by the height of their centres, then left to
    right.  A row ends where a centre lies more than half the median height (1 at least) below that
    of the row's first box."""
    if len(boxes) != len(texts):
        raise ValueError(f"{len(boxes)} boxes for {len(texts)} texts")
    if not boxes:
        return ""
    tops, ends = ([f(p[1] for p in b) for b in boxes] for f in (min, max))
    reach = max(statistics.median_high(z - a for a, z in zip(tops, ends, strict=True)) / 2, 1.0)
    marks = sorted(((a + z) / 2, min(p[0] for p in b), z - a, t) for a, z, b, t in zip(tops, ends, boxes, texts, strict=True))
    starts = itertools.accumulate((m[0] for m in marks), lambda start, centre: centre if centre - start > reach else start)
    rows = itertools.groupby(zip(starts, marks, strict=True), key=lambda x: x[0])
    return "\n".join(" ".join(t for _, t in sorted((m[1], m[3]) for _, m in row)) for _, row in rows)


def page_text(converted: str | None, recognised: str | None, least: int) -> tuple[str, str | None]:
    """Text of a page, and its error: pages with little text of their own get what was recognised
    after it; little is better than nothing, nothing is an error; 0 turns recognition off."""
    own, seen = converted or "", recognised or ""
    if least == 0 or len(own.strip()) >= least:
        return own, None
    both = "\n\n".join(x for x in (own.strip(), seen.strip()) if x)
    return both, None if both else "OcrError: no text on the page"
