"""Text of scanned pages as continuous paragraphs of whole, rightly spelled words.

The lines of a text are a sequence; a linear-chain conditional random field over layout features,
trained here on made-up pages, labels each line as body, running header, page number or break.
Body lines are joined across the others, which makes words cut at line ends whole.  A rare word is
held against the repeated words of the whole corpus through a table of characters that recognisers
mix up: every distinct word of the scanned texts is joined with the counts of all words, once.
"""

from __future__ import annotations

import os
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import pick, spread, stored
from passagemill.llm.same_look import level
from passagemill.llm.tagger import Chain

LINE_TAGS = ["BODY", "HEADER", "NUMBER", "BREAK"]
BREAK_MARKS = "-‐­¬‑"

# What recognisers read (left) for what is printed (right).
MIXED_UP = [
    ("0", "o"), ("0", "о"), ("1", "l"), ("1", "i"), ("1", "і"), ("3", "з"), ("3", "э"), ("4", "ч"), ("5", "s"), ("6", "б"), ("6", "é"), ("6", "e"),
    ("8", "в"), ("8", "b"), ("9", "g"), ("9", "q"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("rn", "m"), ("m", "rn"),
    ("rn", "м"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"), ("ii", "u"), ("u", "ii"), ("ii", "ü"), ("ii", "и"), ("vv", "w"), ("w", "vv"), ("a", "ä"), ("a", "á"),
    ("o", "ó"), ("o", "ö"), ("e", "é"), ("i", "í"), ("u", "ú"), ("n", "ñ"), ("u", "ü"), ("г", "т"), ("т", "г"), ("и", "н"), ("н", "и"), ("л", "п"),
    ("п", "л"), ("л", "д"), ("д", "л"), ("щ", "ш"), ("ш", "щ"), ("ьi", "ы"), ("ы", "ьi"), ("е", "є"), ("е", "с"), ("с", "е"), ("й", "и"), ("и", "й"), ("b", "h"), ("h", "b"), ("n", "ri"), ("ri", "n"),
]

_WORD = re.compile(r"[^\W_]+")
_COMPOUND = re.compile(r"[^\W_]+(?:-[^\W_]+)+")
_CUT_LEFT = re.compile(rf"([^\W_]+(?:-[^\W_]+)*)[{BREAK_MARKS}]\s*$")
_CUT_RIGHT = re.compile(r"^\s*([^\W_]+(?:-[^\W_]+)*)")
_DRESSED = re.compile(r"^\W*(?:[^\W\d_]{1,10}\.?\s*)?(\d{1,4})\W*(?:(?:[^\W\d_]{1,4}|/|-)?\s*\d{1,4})?\W*$")


# ---- lines --------------------------------------------------------------------------------------


def line_features(lines: list[str]) -> list[list[str]]:
    """Layout features of each line of a text."""
    full = sorted(len(x.strip()) for x in lines if x.strip())
    width = full[len(full) // 2] if full else 1
    out = []
    for i, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            out.append(["blank"])
            continue
        before = next((x.strip() for x in reversed(lines[:i]) if x.strip()), "")
        after = next((x.strip() for x in lines[i + 1 :] if x.strip()), "")
        letters = [c for c in bare if c.isalpha()]
        upper = sum(c.isupper() for c in letters) / max(1, len(letters))
        words = re.findall(r"[^\W\d_]{2,}", bare)
        caps = sum(w[0].isupper() for w in words)
        numbers = re.findall(r"\d+", bare)
        sign = "dot" if "·" in bare else "bar" if " | " in bare else "dash" if re.search(r"\s[—–]\s", bare) else "gap" if re.search(r"\S\s{2,}\S", bare) else "none"
        dress = bool(_DRESSED.match(bare))
        first, last = bare[0], bare[-1]
        start = "low" if first.islower() else "up" if first.isupper() else "num" if first.isdigit() else "open" if first in "([«\"" else "sign"
        end = "cut" if last in BREAK_MARKS else "stop" if last in ".!?…" else "num" if last.isdigit() else "low" if last.islower() else "up" if last.isupper() else "sign"
        short = min(4, int(5 * len(bare) / max(1, width)))
        broken = before[-1:] in tuple(BREAK_MARKS) and before != ""
        open_ = "start" if not before else "cut" if broken else "open" if before[-1] not in ".!?…" else "stop"
        runs_on = "end" if not after else "low" if after[0].islower() else "other"
        gap = f"{not lines[i - 1].strip() if i else 'edge'}{not lines[i + 1].strip() if i + 1 < len(lines) else 'edge'}"
        out.append(
            [
                "b", f"sign={sign}", f"start={start}", f"end={end}", f"short={short}", f"gap={gap}", f"dress={dress}", f"indent={line[0].isspace()}",
                f"sign={sign}|short={short}", f"sign={sign}|words={min(len(words), 7)}", f"dress={dress}|num={min(len(numbers), 3)}|words={min(len(words), 3)}",
                f"upper={int(3 * upper)}|sign={sign}", f"caps={caps == len(words)}|words={min(len(words), 4)}|short={short}", f"sign={sign}|start={start}|end={end}",
                f"open={open_}|start={start}|sign={sign}", f"open={open_}|on={runs_on}|sign={sign}", f"gap={gap}|sign={sign}|short={short}", f"gap={gap}|dress={dress}|open={open_}",
                f"dress={dress}|end={end}|start={start}", f"paren={'(' in bare or ')' in bare}|sign={sign}", f"num={min(len(numbers), 3)}|sign={sign}", f"comma={',' in bare}|sign={sign}|dress={dress}",
                f"stop={bool(re.search('[.!?] [^ ]', bare))}|sign={sign}|dress={dress}", f"body={len(words) >= 4 and caps <= 2}|sign={sign}", f"marks={''.join(sorted(set(re.findall('[—–·|/]', bare))))}|num={min(len(numbers), 2)}|words={min(len(words), 5)}",
            ]
        )
    return out


def _made_up_page(rng: random.Random) -> tuple[list[str], list[str]]:
    cyrillic = rng.random() < 0.4
    syllables = "ба ве ли тор мун ске дра фи пре зол хан ул нор ска" if cyrillic else "ba ve li tor mun ske dra fi pre zol han ul nor ska"
    syllables = syllables.split()
    word = lambda n=4: "".join(rng.choice(syllables) for _ in range(rng.randint(1, n)))
    Cap = lambda n=3: word(n).capitalize()
    width = rng.randint(36, 72)
    said: list[str] = []
    for _ in range(rng.randint(2, 5)):
        sentence = [Cap(), *(rng.choice([word(), word(), word(), word(2), word(2), str(rng.randint(1, 99999)), f"{rng.choice(['KB', 'AP', 'TKT'])}{rng.choice('-/ ')}{rng.randint(100, 9999999)}", f"({Cap()}, {rng.randint(1, 99999)})", Cap() + ",", word() + ",", "2024-11-02", "03.11.2025", word(2) + "-" + word(2)]) for _ in range(rng.randint(8, 24)))]
        said += [*sentence[:-1], sentence[-1].rstrip(",") + "."]
    lines, row, at = [], "", 0
    said = " ".join(said).split(" ")
    while at < len(said):
        w = said[at]
        if len(row) + len(w) + 1 <= width or not row:
            row = f"{row} {w}".strip()
            at += 1
        elif w.isalpha() and len(w) > 5 and rng.random() < 0.6:
            cut = rng.randint(2, len(w) - 2)
            lines.append(f"{row} {w[:cut]}{rng.choice(BREAK_MARKS[:4])}{rng.choice(['', '', '', ' '])}")
            said[at], row = w[cut:], ""
        else:
            lines.append(row)
            row = ""
    lines.append(row)
    tags = ["BODY"] * len(lines)
    if rng.random() < 0.75:
        n, total = rng.randint(1, 120), rng.randint(20, 150)
        unit = "стр. стор. с. Страница Сторінка" if cyrillic else "p. S. pág. Page Página Seite Pag."
        unit, of = rng.choice(unit.split()), rng.choice(["из", "з"] if cyrillic else ["of", "de", "von", "sur"])
        number = rng.choice([f"{n}", f"— {n} —", f"– {n} –", f"- {n} -", f"[{n}]", f"{n} / {total}", f"{n}/{total}", f"{unit} {n}", f"{unit} {n} {of} {total}", f"{unit} {n}/{total}", f"({n})", f"· {n} ·"])
        title = " ".join([Cap(), *(rng.choice([word(3), word(2), Cap(2)]) for _ in range(rng.randint(0, 4)))])
        head = rng.choice([f"{title} — {Cap(4)}", f"{Cap(4).upper()} · {title}", f"{Cap(4)} · {title}", f"{title} – {Cap(4)}", f"{Cap(4)} | {title}"])
        if rng.random() < 0.15:
            head = head.upper()
        if rng.random() < 0.15:
            head = head.replace("o", "0").replace("о", "0").replace("l", "1")
        one = rng.choice([f"{head}   {number}", f"{number} | {head}", f"{head} | {number}", f"{number}   {head}", f"{head}  {number}"])
        extra = rng.choice([[(head, "HEADER")], [(number, "NUMBER")], [(number, "NUMBER")], [(one, "HEADER")], [(one, "HEADER")], [(head, "HEADER"), (number, "NUMBER")], [(number, "NUMBER"), (head, "HEADER")]])
        pad = "  " if rng.random() < 0.2 else ""
        block = [(pad + t, tag) for t, tag in extra]
        if rng.random() < 0.45:
            block = [("", "BREAK"), *block, ("", "BREAK")]
        elif rng.random() < 0.1:
            block = [*block, ("", "BREAK")]
        place = rng.choice([0, len(lines), *[rng.randint(1, max(1, len(lines) - 1))] * 4])
        lines[place:place] = [t for t, _ in block]
        tags[place:place] = [tag for _, tag in block]
    if rng.random() < 0.1:
        place = rng.randint(0, len(lines))
        lines[place:place], tags[place:place] = [""], ["BREAK"]
    return lines, tags


WEIGHTS = os.path.join(os.path.dirname(__file__), "scan_lines.npz")


@lru_cache(maxsize=1)
def line_model() -> Chain:
    """The model of lines as :func:`fitted`, from the file in which its weights are kept, or fitted anew."""
    return Chain.kept(WEIGHTS, LINE_TAGS) or fitted()


def fitted() -> Chain:
    rng = random.Random(23)
    pages = [_made_up_page(rng) for _ in range(2_500)]
    return Chain(LINE_TAGS).train([(line_features(lines), tags) for lines, tags in pages], epochs=5)


# ---- words --------------------------------------------------------------------------------------


def readings(word: str) -> set[str]:
    """What may have been printed where ``word`` was read: one mix-up undone, or two of them."""
    once = set()
    for seen, meant in MIXED_UP:
        at = word.find(seen)
        while at >= 0:
            once.add(word[:at] + meant + word[at + len(seen) :])
            at = word.find(seen, at + 1)
        if word.count(seen) > 1:
            once.add(word.replace(seen, meant))
    return once


class Speller:
    """What is known of the words of one text: their counts and right spellings."""

    def __init__(self, counts: dict[str, int], right: dict[str, str]):
        self.counts, self.rights = counts, right

    def right(self, word: str) -> str | None:
        """The right word if ``word`` is misread, None if it is not or cannot be told."""
        return self.rights.get(word)

    def whole(self, left: str, right: str, mark: str) -> str:
        """Two halves as one word, with the hyphen between them only if the corpus writes it so."""
        plain, hyphened = (left + right).lower(), f"{left}-{right}".lower()
        return hyphened if mark in "-‐‑" and self.counts.get(hyphened, 0) > self.counts.get(plain, 0) else plain


class Asked:
    """A speller that knows nothing and notes what it is asked."""

    def __init__(self) -> None:
        self.words: set[str] = set()
        self.joined: set[str] = set()

    def right(self, word: str) -> None:
        if len(word) > 2 and not word.isdigit():
            self.words.add(word)

    def whole(self, left: str, right: str, mark: str) -> str:
        plain, hyphened = (left + right).lower(), f"{left}-{right}".lower()
        self.joined |= {plain, hyphened}
        for half in (left, right):  # those of a word that keeps its hyphen
            for part in half.lower().split("-"):
                self.right(part)
        return plain


def repair(text: str, tags: list[str], speller: Speller | Asked) -> tuple[str, list[tuple[str, str]]]:
    """The paragraphs of a scanned text whose lines have these tags, and what was repaired as ``(kind, item)``."""
    lines = text.split("\n")
    found: list[tuple[str, str]] = []
    paragraphs: list[str] = []
    body = ""
    broke = False
    for line, tag in zip(lines, tags, strict=True):
        bare = line.strip()
        if not bare:
            broke = True
            continue
        number = _DRESSED.match(bare) if tag == "NUMBER" else None
        if tag == "NUMBER" and number:
            found.append(("page_number", str(int(number.group(1)))))
            continue
        if tag == "HEADER" or tag == "NUMBER":
            found.append(("header", bare))
            continue
        cut, rest = _CUT_LEFT.search(body), _CUT_RIGHT.match(bare)
        if cut and rest and not cut.group(1).isdigit():
            left, right = cut.group(1), rest.group(1)
            word = speller.whole(left, right, body.rstrip()[-1])
            fixed = "-".join(speller.right(p) or p for p in word.split("-"))
            found.append(("broken_word", fixed))
            joint = "-" if word == f"{left}-{right}".lower() else ""
            body = body[: cut.start()] + left + joint + bare
        elif broke and body.rstrip()[-1:] in tuple(".!?…:"):
            paragraphs.append(body)
            body = bare
        else:
            body = f"{body.rstrip()} {bare}" if body else bare
        broke = False
    if body:
        paragraphs.append(body)

    def spell(m: re.Match) -> str:
        right = speller.right(m.group().lower())
        if right is None:
            return m.group()
        found.append(("misread", right))
        return right.capitalize() if m.group()[0].isupper() else right

    return "\n\n".join(_WORD.sub(spell, p) for p in paragraphs), found


# ---- operators ----------------------------------------------------------------------------------


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``(w, n)``: how many texts of ``df`` hold each word and compound that more than one holds; words
    of digits only are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                low = text.lower()
                seen.update({w for w in _WORD.findall(low) if len(w) > 2 and not w.isdigit()})
                if "-" in low:
                    seen.update({w for w in _COMPOUND.findall(low) if not any(c.isdigit() for c in w)})
            if len(seen) > 100_000:
                yield _counts_batch(seen)
                seen = Counter()
        yield _counts_batch(seen)

    rows = pick(df, text=text_col).where("text is not null").mapInArrow(count, "w string, n bigint")
    return rows.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1")


def spellings(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """``(w, own, right)`` of every distinct word ``w`` of ``asked``: its count, and the reading of it
    that is far more frequent (at least 3 texts and 20 times as many), if there is one.  Two mix-ups
    are undone only in words of more than five characters that no second text holds."""

    def read(twice: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, forms = [], []
                for i, w in enumerate(batch.column(0).to_pylist()):
                    got = readings(w)
                    if twice:
                        got = {x for f in got for x in readings(f)} - {w}
                    at += [i] * len(got)
                    forms += got
                    if len(at) > 100_000:
                        yield batch_of(batch, at, forms)
                        at, forms = [], []
                yield batch_of(batch, at, forms)

        return run

    def batch_of(batch: pa.RecordBatch, at: list[int], forms: list[str]) -> pa.RecordBatch:
        took = batch.take(pa.array(at, type=pa.int64()))
        return pa.RecordBatch.from_arrays([took.column(0), took.column(1), pa.array(forms, type=pa.string())], names=["w", "own", "form"])

    def best(words: DataFrame, twice: bool) -> DataFrame:
        tried = words.mapInArrow(read(twice), "w string, own bigint, form string").join(counts.select(F.col("w").alias("form"), "n"), "form")
        fits = tried.where(F.col("n") >= F.greatest(F.lit(3), 20 * F.col("own")))
        return fits.groupBy("w").agg(F.max(F.struct("n", "form"))["form"].alias("right"))

    known = asked.join(counts, "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("own"))
    once = known.join(best(known.where("length(w) > 2"), False), "w", "left")
    once = stored(once, "readings")
    twice = best(once.where("right is null and own = 0 and length(w) > 5").select("w", "own"), True)
    return once.join(twice.withColumnRenamed("right", "other"), "w", "left").select("w", "own", F.coalesce("right", "other").alias("right"))


def _counts_batch(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.string()), pa.array(list(seen.values()), type=pa.int64())], names=["w", "n"])


def scanned(df: DataFrame, id_col: str = "id", source_col: str = "source", text_col: str = "text", engine_col: str = "ocr_engine") -> DataFrame:
    """``(id, text)`` of the rows of scanned sources, once per id: those with an engine on any row.

    Spellings of a source that look the same are one source.  Null sources are never scanned.
    """

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([level(s) for s in batch.column(0).to_pylist()], type=pa.string()), batch.column(1)], names=["source", "same", "engine"])

    rows = pick(df, id=id_col, source=source_col, text=text_col, engine=engine_col).where("source is not null and id is not null and text is not null")
    sources = pick(df, source=source_col, engine=engine_col).where("source is not null").groupBy("source").agg(F.max(F.trim(F.coalesce("engine", F.lit(""))) != "").alias("engine"))
    levelled = sources.mapInArrow(key, "source string, same string, engine boolean")
    chosen = levelled.join(levelled.where("engine").select("same").distinct(), "same", "left_semi").select("source")
    return spread(rows.join(chosen, "source", "left_semi").select("id", "text"), "id").groupBy("id").agg(F.min("text").alias("text"))


def _repaired(df: DataFrame, id_col: str, source_col: str, text_col: str, engine_col: str, findings: bool) -> DataFrame:
    model = df.sparkSession.sparkContext.broadcast(line_model())
    pages = scanned(df, id_col, source_col, text_col, engine_col)
    kind = dict(pages.dtypes)["id"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tags = model.value.decode_many([line_features(t.split("\n")) for t in texts])
            words, joined = [], []
            for t, tag in zip(texts, tags, strict=True):
                asked = Asked()
                repair(t, tag, asked)
                words.append(sorted(asked.words - asked.joined))
                joined.append(sorted(asked.joined))
            codes = ["".join(str(LINE_TAGS.index(x)) for x in tag) for tag in tags]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, type=pa.string()), pa.array(words, type=pa.list_(pa.string())), pa.array(joined, type=pa.list_(pa.string()))], names=["id", "text", "tags", "words", "joined"])

    lines = stored(pages.mapInArrow(label, f"id {kind}, text string, tags string, words array<string>, joined array<string>"), "scan-lines")
    held = lines.select("id", F.explode("words").alias("w"), F.lit(False).alias("whole")).unionByName(lines.select("id", F.explode("joined").alias("w"), F.lit(True).alias("whole")))
    counts = stored(word_counts(df, text_col), "word-counts")
    known = stored(spellings(held.select("w").distinct(), counts).where("right is not null or own > 0"), "spellings")
    # Of the words of a text only those come back that are misread or were cut.
    answers = held.join(known, "w").where("whole or right is not null").groupBy("id").agg(F.collect_list(F.struct("w", "own", "right")).alias("answers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, items = [], [], []
            for i, (text, codes, got) in enumerate(zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)), strict=True)):
                got = got or []
                speller = Speller({x["w"]: x["own"] for x in got}, {x["w"]: x["right"] for x in got if x["right"] is not None})
                clean, found = repair(text, [LINE_TAGS[int(c)] for c in codes], speller)
                for k, item in sorted(set(found)) if findings else [("text", clean)]:
                    at.append(i)
                    kinds.append(k)
                    items.append(item)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, type=pa.int64())), pa.array(kinds, type=pa.string()), pa.array(items, type=pa.string())], names=["id", "kind", "item"])

    return lines.select("id", "text", "tags").join(answers, "id", "left").mapInArrow(run, f"id {kind}, kind string, item string")


def repair_scans(df: DataFrame, id_col: str = "id", source_col: str = "source", text_col: str = "text", engine_col: str = "ocr_engine") -> DataFrame:
    """``(id, text)``: the text of every row of a scanned source as continuous paragraphs.

    Rows with a null id, source or text take no part; an empty text stays empty; rows that repeat
    an id count once (the smallest text).  Headers and page numbers are gone from the result.
    """
    return _repaired(df, id_col, source_col, text_col, engine_col, False).select("id", F.col("item").alias("text"))


def scan_findings(df: DataFrame, id_col: str = "id", source_col: str = "source", text_col: str = "text", engine_col: str = "ocr_engine") -> DataFrame:
    """``(id, kind, item)``: what :func:`repair_scans` repairs: broken_word, misread, header and
    page_number, each item once per id."""
    return _repaired(df, id_col, source_col, text_col, engine_col, True)
