"""Transcripts as clean, ordered speaker turns.

Every line is a sequence of tokens.  A linear-chain conditional random field, trained here on lines
made up in random layouts (its weights are kept in a file beside this one), tags each token as speaker, timestamp, annotation, filler, speech or
separator; the tags of a line are decoded by Viterbi.  It sees shapes, brackets, the pieces a line
falls into and how well a piece fits the names of the meeting, not a list of layouts or sounds.
Utterances and their labels are read off the tags, labels are held against the names of the
meeting, and Spark windows put utterances in order, complete times and speakers, and number the
turns.
"""

from __future__ import annotations

import os
import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import pick, spread, stored
from passagemill.llm.tagger import Chain

TAGS = ["SPEAKER", "TIME", "ANNOTATION", "FILLER", "SPEECH", "SEPARATOR"]
WINDOW_SECONDS = 120
LINES_TOGETHER = 2_000  #: lines tagged in one go

# Common hesitation sounds of the languages of the corpus.  They are one feature among
# others and left out of half the training lines, so that other sounds are told by shape and place.
FILLERS = "er erm err uh uhm um umm hmm hm mm mhm eh ehm em heu euh hum hein äh ähm öh öhm aeh mmm э ээ эээ э-э э-э-э эм ээм ммм мм хм гм а-а ее еее е-е ем емм".split()

_TOKEN = re.compile(
    r"\d{1,3}[:：]\d{2}(?:[:：]\d{2})?(?:[.,]\d{1,3})?(?!\d)|(?<![\w.])\d{1,2}\s?h\s?\d{1,2}\s?m(?:in)?\s?\d{1,2}\s?s(?!\w)|(?<![\w.])\d{1,3}\s?m(?:in)?\s?\d{1,2}\s?s(?!\w)|(?<![\w.])\d{1,3}['′’]\d{2}[\"″”]"
    r"|-->|->|→|-{2,}|={2,}|~{2,}|\*{1,3}|_{1,2}(?=\S)|>>+|#{1,6}(?=\s)|[^\W_]+(?:[-'’ʼ][^\W_]+)*|\t|\s+|.",
    re.DOTALL,
)
_TIME = re.compile(r"(?:(\d{1,3})[:：])?(\d{1,3})[:：](\d{2})(?:[.,](\d+))?$|(?:(\d{1,2})\s?h\s?)?(\d{1,3})\s?m(?:in)?\s?(\d{1,2})\s?s$|(\d{1,3})['′’](\d{2})[\"″”]$")
_PAIRS = {"[": "]", "(": ")", "<": ">", "{": "}", "*": "*", "♪": "♪", "_": "_", "~": "~", "【": "】", "（": "）"}
_DASHES = frozenset("-–—―")
_LEAD = frozenset("|>»•@·│")
_SOUND = re.compile(r"h?v{1,2}[hr]{0,2}m?r?|h?v{0,2}m|mh?v{0,2}m|v{1,2}m?h?v{0,2}m?|h{1,2}|pf|h?v{1,2}h?")
_CLASS = str.maketrans({**{c: "v" for c in "aeiouyäöüàâéèêëîïôûùœæåøáíóúаеёиоуыэюяіїєў"}, **{c: "h" for c in "hхгґ"}, **{c: "m" for c in "mnмнñ"}, **{c: "r" for c in "rр"}})


def clock(token: str) -> tuple[int | None, float] | None:
    """Hour (None if left out) and seconds within it of a time mark; None for other tokens."""
    m = _TIME.match(token)
    if not m:
        return None
    h, minute, second, part, h2, minute2, second2, minute3, second3 = m.groups()
    hour = h if h is not None else h2
    seconds = int(minute or minute2 or minute3) * 60 + int(second or second2 or second3) + (float(f"0.{part}") if part else 0.0)
    return (None if hour is None else int(hour)), seconds


def tokens(line: str) -> list[tuple[str, int, int]]:
    out, at = [], 0
    for t in _TOKEN.findall(line):
        end = at + len(t)
        if t == "\t" or not t.isspace():
            out.append((t, at, end))
        at = end
    return out


@lru_cache(maxsize=100_000)
def _shape(t: str) -> str:
    c = t[0]
    if c.isdigit():
        return "time" if _TIME.match(t) else f"num{min(len(t), 4)}" if t.isdigit() else "mix"
    if c.isalpha():
        if any(x.isdigit() for x in t):
            return "mix"
        return "I" if len(t) == 1 and c.isupper() else "UP" if t.isupper() else "Cap" if c.isupper() else "low"
    return "dash" if c in _DASHES and len(t) == 1 else "rule" if len(t) > 1 and c in "-=~" and ">" not in t else t


@lru_cache(maxsize=100_000)
def _sound(t: str) -> int:
    """How much a word looks like a hesitation: 3 with letters drawn out or no vowel, 2 by its
    letters, 1 if common words have such letters as well, 0 not at all."""
    low = t.lower()
    if len(low) > 9 or not low[0].isalpha() or any(c.isdigit() for c in low):
        return 0
    parts = [p for p in re.split(r"[-'’ʼ]", low) if p]
    classes = [p.translate(_CLASS) for p in parts]
    if not all(set(c) <= set("vhmrpf") for c in classes):
        return 0
    short = [re.sub(r"(.)\1+", r"\1", p) for p in parts]
    shapes = [s.translate(_CLASS) for s in short]
    if not all(_SOUND.fullmatch(s) for s in shapes) or sum(map(len, short)) > 6:
        return 0
    drawn = any(re.search(r"(.)\1\1|([hmхмэ])\2", p) for p in parts) or (len(parts) > 1 and len(set(short)) <= 2)
    if drawn or all("v" not in s for s in shapes):
        return 3
    return 2 if any(s[-1] in "hm" and s.translate(str.maketrans("", "", "v")) in ("h", "m", "hm", "hh") or s in ("vr", "vrm") for s in shapes) else 1


class Names:
    """What the words of labels are to the names of a meeting."""

    def __init__(self, roster: list[tuple[int, str]]):
        self.people = []
        for number, full in sorted(roster):
            p = _fold(full).split()
            if p:
                self.people.append((number, p))
        self.parts = {w for _, p in self.people for w in p}
        self.initials = {x for _, p in self.people for x in (p[0][0] + p[-1][0], p[-1][0] + p[0][0])}
        self.letters = {w[0] for w in self.parts}
        self.seen: dict[str, int] = {}
        self.found: dict[str, int] = {}

    def fit(self, t: str) -> int:
        """4 a name, 3 one with a slip or cut short, 2 the initials of someone, 1 the first letter of a name, 0 nothing."""
        got = self.seen.get(t)
        if got is None:
            w = _fold(t)
            if w in self.parts or "-" in w and any(x in self.parts for x in w.split("-")):
                got = 4
            elif len(w) >= 4 and any(_near(x, w) or len(w) < len(x) and x.startswith(w) for x in self.parts):
                got = 3
            elif len(w) == 2 and w in self.initials:
                got = 2
            else:
                got = int(len(w) == 1 and w in self.letters)
            self.seen[t] = got
        return got

    def who(self, label: str) -> int:
        got = self.found.get(label)
        if got is None:
            got = self.found[label] = _who(label, self.people)
        return got


def kind_of_line(toks: list[tuple[str, int, int]]) -> str:
    """``blank``, ``time`` (nothing but times), ``head`` (a time and at most five other words) or ``text``."""
    if not toks:
        return "blank"
    words = times = 0
    for t, _, _ in toks:
        if t[0].isalnum():
            if t[0].isdigit() and _TIME.match(t):
                times += 1
            else:
                words += 1
                if words > 5:
                    return "text"
    return "text" if not times else "head" if words else "time"


def features(toks: list[tuple[str, int, int]], before: str, after: str, names: Names, lexicon: frozenset[str] = frozenset(FILLERS)) -> tuple[list[tuple], list[int]]:
    """The items of a line to be tagged, as keys of their features, and to which item each token
    belongs.  ``before`` and ``after``: what the lines above and below are (:func:`kind_of_line`,
    ``none`` at the ends)."""
    n = len(toks)
    shapes = [_shape(t) for t, _, _ in toks]
    # Brackets of any kind, of at most eight tokens; those round a time do not count.
    zone, i = [""] * n, 0
    while i < n:
        close = _PAIRS.get(toks[i][0])
        if close:
            j = next((j for j in range(i + 1, min(n, i + 10)) if toks[j][0] == close), 0)
            if j > i and not any(shapes[x] == "time" for x in range(i + 1, j)):
                inside = [toks[x][0] for x in range(i + 1, j)]
                said = "N" if any(names.fit(x) >= 3 for x in inside) else "0" if not any(x[0].isalnum() for x in inside) else "D" if any(x[0].isdigit() for x in inside) else "v" if inside[0] == "v" and len(inside) > 1 else "w"
                for x in range(i, j + 1):
                    zone[x] = toks[i][0] + said
                i = j
        i += 1
    # Pieces between times, brackets and marks.
    piece, kinds, cut, now = [0] * n, [], [False] * n, -1
    open_piece = False
    left = "start"
    pieces: list[list] = []  # [left, right, tokens]
    many = 0
    for i, (t, a, b) in enumerate(toks):
        s = shapes[i]
        spaced = (i == 0 or toks[i - 1][2] < a) or i + 1 == n or b < toks[i + 1][1]
        ends = i + 1 == n or b < toks[i + 1][1]
        mark = ""
        if s == "time":
            mark = "T"
        elif zone[i] and (t in _PAIRS or t in ")]}>】）") and (i == 0 or zone[i - 1] != zone[i] or i + 1 == n or zone[i + 1] != zone[i] or t in ")]}>】）"):
            mark = t
        elif t in "[](){}<>" or s == "rule" or t in ("-->", "->", "→", "\t", "*", "**", "***", "__", "_") or t[0] in "#" or t[:2] == ">>" or (len(t) == 1 and t in _LEAD):
            mark = t[:2]
        elif s == "dash" and spaced and many < 9:
            mark = "dash"
        elif t in ":：" and ends and many < 9:
            mark = ":"
        if mark:
            if open_piece:
                pieces[-1][1] = mark
                open_piece = False
            left = mark
            cut[i] = True
            piece[i] = len(pieces) - 1
        else:
            if not open_piece:
                pieces.append([left, "end", []])
                open_piece = True
            pieces[-1][2].append(i)
            piece[i] = len(pieces) - 1
        many += s[0].isalnum() if s else 0
    facts = []
    for lf, rt, at in pieces:
        words = [toks[x][0] for x in at if toks[x][0][0].isalnum()]
        fits = [names.fit(w) for w in words] if len(words) < 6 else []
        size = min(len(words), 4) if len(words) < 5 else 5 if len(words) < 8 else 6
        named = 0 if not fits else 2 if all(fits) and max(fits) >= 2 else 1 if any(f >= 3 for f in fits) else 0
        title = 1 if words and all(shapes[x] in ("Cap", "UP", "I") or shapes[x][:3] == "num" for x in at if toks[x][0][0].isalnum()) else 0
        digit = any(w[0].isdigit() for w in words[:6])
        sounds = bool(words) and all(_sound(w) or w.lower() in lexicon for w in words[:8]) and len(words) <= 8
        facts.append((lf, rt, size, named, title, digit, sounds))
    times = [i for i, s in enumerate(shapes) if s == "time"]
    first = -1
    for x in times:  # a time after a long piece is part of what is said
        if not any(f[2] >= 6 for f in facts[: max(0, piece[x] + 1)] if f) or x == times[0] == 0:
            first = x
        break
    head = first >= 0
    last_time = first
    for x in times:
        if head and x > last_time and x - last_time <= 3:
            last_time = x
    rest_sound = all(_sound(t) or t.lower() in lexicon for i, (t, _, _) in enumerate(toks) if t[0].isalnum() and not zone[i] and shapes[i] != "time" and not (facts and piece[i] >= 0 and facts[piece[i]][3]))
    total = len(pieces)
    ordinal, count = [], 0
    for (lf, rt, at), f in zip(pieces, facts, strict=True):
        ordinal.append(min(count, 3))
        count += bool(f[2]) and not zone[at[0]]
    out, owner, plain = [], [], False
    for i, (t, _, _) in enumerate(toks):
        p = piece[i]
        f = facts[p] if p >= 0 else ("", "", 0, 0, 0, False, False)
        word = t[0].isalnum()
        sound = 0
        if not cut[i]:
            if word:
                sound = 1 + (t.lower() in lexicon) * 4 + _sound(t)
            # Ordinary words of a long piece in a row are one item.
            if plain and f[2] == 6 and sound < 2 and not zone[i]:
                owner.append(len(out) - 1)
                continue
        plain = f[2] == 6 and sound == 1 and not zone[i] and not cut[i]
        nxt = facts[p + 1] if cut[i] and p + 1 < total else None
        owner.append(len(out))
        out.append(
            (
                shapes[i], cut[i], zone[i], "" if not head else "<" if i < first else ">" if i > last_time else "=", f, nxt[2:] if nxt else None, ordinal[p] if p >= 0 else 0, p + 1 == total,
                before, after, sound, names.fit(t) if sound and f[2] < 6 else 0,
                toks[i - 1][0] if i and not toks[i - 1][0][0].isalnum() else "w" if i else "start", toks[i + 1][0] if i + 1 < n and not toks[i + 1][0][0].isalnum() else "w" if i + 1 < n else "end", rest_sound,
            )
        )
    return out, owner


def expand(key: tuple) -> list[str]:
    """The features of a token from what :func:`features` saw of it."""
    shape, cut, zone, side, (left, right, size, named, title, digit, sounds), nxt, order, last, before, after, sound, fit, prev, after_it, rest = key
    if cut:
        out = [f"c|{shape}", f"c|{shape}|{side}", f"c|{shape}|z{zone}", f"c|{shape}|{size}|{named}", f"c|z{zone}|{side}|{order}", f"c|next{nxt}|{shape}", f"c|{shape}|{last}|{order}", f"c|z{zone[:1]}", f"c|z{zone[1:]}|{named}"]
        return [*out, f"c|{shape}|{side}|{size}|{named}|{title}"]
    out = [
        "b", f"s={shape}", f"z={zone}", f"z={zone[:1]}", f"z={zone[1:]}", f"z={zone[1:]}|{side}|{order}|{named}", f"side={side}|o{order}|n{named}", f"side={side}|o{order}|size{size}|t{title}",
        f"l={left}|r={right}", f"l={left}|r={right}|n{named}|t{title}", f"r={right}|size{size}|n{named}|t{title}|d{digit}", f"l={left}|size{size}|n{named}|{side}", f"size{size}|n{named}|t{title}|last{last}|{side}", f"size{size}|d{digit}|t{title}|r={right}|{side}",
        f"before={before}|o{order}|size{size}|n{named}|r={right}", f"after={after}|o{order}|size{size}|n{named}|r={right}|{side}", f"fit{fit}|o{order}", f"fit{fit}|n{named}|size{size}", f"n{named}|sounds{sounds}",
        f"snd{sound}|{sounds}", f"snd{sound}|{rest}|n{named}", f"snd{sound}|{prev}|{after_it}", f"snd{sound}|{after_it}", f"snd{sound}|{shape}|size{size}", f"p={prev}|{shape}", f"a={after_it}|{shape}",
    ]
    return out


# ---- training lines ---------------------------------------------------------------------------

_LATIN, _CYRILLIC = "ba ve li tor mun ske dra fi qua pre zol han ul ne me er in un he am".split(), "ба ве ли тор мун ске дра фи ква пре зол хан ул не на он им мы".split()
_CLOCKS = ("m:ss", "mm:ss", "h:mm:ss", "hh:mm:ss", "hh:mm:ss.f", "total", "units")
_WRAPS = ("", "[]", "()", "<>", "{}", "**")
_AFTER_TIME = (" ", " - ", " – ", " — ", ": ", " | ", "\t", " > ", ", ")
_AFTER_NAME = (": ", " - ", " – ", " — ", " | ", "\t", " > ", ">> ", "; ")
_DRESS = ("{}", "{}", "{}", "**{}**", "*{}*", "<v {}>", "[{}]", "({})", "@{}", "- {}", ">> {}", "# {}", "__{}__", "<{}>")
_BRACKETS = ("[{}]", "({})", "<{}>", "*{}*", "{{{}}}", "**{}**", "_{}_", "♪ {} ♪", "[{}]", "({})")


def _made_up_lines(rng: random.Random, keep: float = 1.0, part: int = 0) -> list[tuple[str, str, list[tuple[str, str]], list[tuple[int, str]]]]:
    """One utterance as lines: ``(what the line above was, the line below, pieces with tags, names)``.

    Layouts are put together at random: dress and place of time and name, marks between them, line
    ends.  ``part`` 1 takes only every third of the dresses and marks, -1 only the others."""
    some = lambda xs: [x for i, x in enumerate(xs) if not part or (i % 3 == 1) == (part > 0)] or list(xs)
    syllables = rng.choice([_LATIN, _LATIN, _CYRILLIC])
    word = lambda n=3: "".join(rng.choice(syllables) for _ in range(rng.randint(1, n)))
    name = lambda: (rng.choice(syllables[:13]) + rng.choice(syllables[:13]) + (rng.choice(syllables[:13]) if rng.random() < 0.4 else "")).capitalize()
    people = [(name(), name()) for _ in range(rng.randint(2, 6))]
    roster = [(i, f"{a} {b}") for i, (a, b) in enumerate(people, 1)]

    def sound() -> str:
        if rng.random() < 0.6:
            return rng.choice(FILLERS)
        v = rng.choice("aeouäöé" if syllables is _LATIN else "аоэеиу")
        h, m = ("h", "m") if syllables is _LATIN else ("х", "м")
        return rng.choice([v * rng.randint(2, 4), f"{v}{h}", f"{v}{h}{h}", f"{v}{m}", f"{v}{m}{m}", f"{h}{m}", f"{h}{m}{m}", m * rng.randint(2, 4), f"{v}{h}{m}", f"{v}-{v}", f"{m}{h}{m}", f"{h}{v}{m}", f"{h}{v}{h}", f"{m}-{h}{m}", f"{v}{h}-{h}{v}{h}", f"{v}r", f"{v}r{m}"])

    def note() -> tuple[str, str]:
        inner = " ".join(word() for _ in range(rng.choice([1, 1, 2, 3])))
        if rng.random() < 0.3:
            inner = inner[0].upper() + inner[1:]
        if rng.random() < 0.1:
            return rng.choice(["♪ ♪", "♪", "(…)", "[...]", "***", "* * *"]), "ANNOTATION"
        return rng.choice(some(_BRACKETS) if part else _BRACKETS).format(inner), "ANNOTATION"

    def sounds() -> list[tuple[str, str]]:
        many = rng.choice([1, 1, 2, 2, 3])
        out = [(sound() + (rng.choice([",", "...", "", "…"]) if i + 1 < many else rng.choice(["...", ".", "", "…", "?"])), "FILLER") for i in range(many)]
        if rng.random() < 0.6:
            out[0] = (out[0][0].capitalize(), "FILLER")
        return out

    def speech() -> list[tuple[str, str]]:
        kind = rng.random()
        if kind < 0.12:
            return [note()]
        if kind < 0.28:
            return sounds()
        if kind < 0.34:
            return [*sounds(), note()] if rng.random() < 0.7 else [note(), *sounds()]
        out: list[tuple[str, str]] = []
        for j in range(rng.choice([1, 1, 2, 2]) if rng.random() < 0.12 else rng.randint(3, 16)):
            extra = rng.random()
            if extra < 0.08:
                out.append((sound() + rng.choice(["", ",", "..."]), "FILLER"))
            elif extra < (0.18 if j < 3 else 0.11):
                out.append(note())
            text = word() if rng.random() < 0.8 else rng.choice([str(rng.randint(1, 99999)), f"{rng.choice(['AP', 'TKT', 'KB'])}{rng.choice('-/ ')}{rng.randint(100, 9999999)}", f"{rng.randint(1, 28):02}.0{rng.randint(1, 9)}.2024", f"2024-0{rng.randint(1, 9)}-11", name(), f"({name()}, {rng.randint(1, 999)})", f"{word()}-{word()}", f"{rng.randint(0, 23)}:{rng.randint(10, 59)}", f"{word()}:", f"— {word()}", f"l'{word()}", word().capitalize(), f"«{word()}»"])
            while _sound(text) and (j < 2 or rng.random() < 0.5):
                text += rng.choice(syllables[:13])
            if j < 2:
                text = text.rstrip(":")
            if j == 0 or (j < 4 and rng.random() < 0.15):
                text = text[0].upper() + text[1:]
            if j and rng.random() < 0.03:
                text = rng.choice(rng.choice(people))
            out.append((text, "SPEECH"))
        out.append((rng.choice([".", "?", "...", "", ";", "!"]), "SPEECH"))
        return out

    def label() -> str:
        first, last = rng.choice(people)
        odd = rng.random()
        if odd < 0.3:
            return rng.choice([f"{name()} {rng.randint(1, 9)}", f"{name()} {word()}", f"{word().capitalize()} {word()}", name(), word().capitalize(), f"{word()} {name()}", f"{name()} {name()}"])
        slip = last[:-2] + last[-1] + last[-2]
        full = rng.choice([f"{first} {last}"] * 5 + [f"{last}, {first}", f"{last} {first}", f"{first[0]}. {last}", f"{last} {first[0]}.", f"{first} {last[0]}.", f"{last}, {first[0]}.", first, last, f"{first} {last}".upper(), f"{first}  {last}".lower(), first[0] + last[0], f"{first[0]}.{last[0]}.", f"{first} {slip}", f"{first} {last[:-1]}", f"{last.upper()} {first}", f"{word(1).capitalize()}. {first} {last}", f"{word(1).capitalize()} {last}"])
        return full + rng.choice([""] * 8 + [" (guest)", " (remote)", " (mic 2)", " (ext.)", f" ({word()})", f" [{word()}]", f", {word()}"])

    m, s, h = rng.randint(0, 59), rng.randint(0, 59), rng.randint(0, 2)
    style = rng.choice(some(_CLOCKS[:6]) if rng.random() < 0.95 else _CLOCKS)
    time = {"m:ss": f"{m}:{s:02}", "mm:ss": f"{m:02}:{s:02}", "h:mm:ss": f"{h}:{m:02}:{s:02}", "hh:mm:ss": f"{h:02}:{m:02}:{s:02}", "hh:mm:ss.f": f"{h:02}:{m:02}:{s:02}.{rng.randint(0, 999):03}", "total": f"{h * 60 + m}:{s:02}", "units": rng.choice([f"{h}h{m:02}m{s:02}s", f"{m}m{s:02}s", f"{m}'{s:02}\""])}[style]
    who = label() if rng.random() < 0.75 else None
    above, below = rng.choice(["blank", "blank", "text", "none"]), rng.choice(["blank", "blank", "head", "time", "none", "text"])
    T, P, S = "TIME", "SEPARATOR", "SPEAKER"
    wrap = rng.choice(some(_WRAPS))
    marked = [(wrap[0] if wrap != "**" else "**", P), (time, T), (wrap[-1] if wrap != "**" else "**", P)] if wrap else [(time, T)]
    dress = rng.choice(some(_DRESS)).split("{}")
    after_name = rng.choice(some(_AFTER_NAME))
    if dress[1][:1] in ("]", ")", ">", "*") and dress[1] != "**" and dress[0] != "<v " and rng.random() < 0.7:
        after_name = ":"  # brackets alone are a name only if it is one of the meeting
    elif dress[1] and who and dress[0] != "<v " and not any(Names(roster).fit(x) >= 2 for x in re.findall(r"\w+", who)):
        dress = ["", ""]
    said = speech()
    after_time = rng.choice(some(_AFTER_TIME))
    if wrap == "" and after_time == " ":
        after_time = " - "

    def named(mark: str) -> list[tuple[str, str]]:
        if who is None:
            return []
        return [*([(dress[0], P)] if dress[0].strip() else []), (who, S), *([(dress[1], P)] if dress[1].strip() else []), (mark, P)]

    layout = rng.randrange(10)
    rows: list[tuple[str, str, list[tuple[str, str]]]] = []
    if layout in (0, 1):  # time, name, speech
        end = "" if dress[1] and after_name != ":" and rng.random() < 0.5 else after_name
        rows.append((above, below, [*marked, (after_time if wrap == "" or rng.random() < 0.3 else " ", P), *named(end), *([(" ", P)] if who else []), *said]))
    elif layout in (2, 3):  # name, time, speech
        lead = rng.choice([" ", after_name, " - "])
        rows.append((above, below, [*named(lead), *marked, (after_time if wrap == "" or not who or rng.random() < 0.5 else rng.choice([": ", " "]), P), *said]))
    elif layout == 4:  # a line of times
        line = [*marked, (" --> ", P), (time[:-1] + str(rng.randint(0, 9)), T)] if "f" in style else marked
        rows += [(above, "text", line), ("time", below, [*named("" if dress[1] else after_name), *said])]
    elif layout in (5, 6):  # a line of name and time
        order = [*named(rng.choice([" ", " ", after_name])), *marked] if rng.random() < 0.7 or not who else [*marked, (rng.choice([" ", after_time]), P), *named("")]
        rows += [(above, "text", order), ("head" if who else "time", below, said)]
    elif layout == 7:  # times from and to
        a, b = f"{h:02}:{m:02}:{s:02}.{rng.randint(0, 999):03}", f"{h:02}:{m:02}:59.{rng.randint(0, 999):03}"
        if rng.random() < 0.4:
            a, b = a.replace(".", ","), b.replace(".", ",")
        if rng.random() < 0.3:  # a running number
            rows.append((above, "time", [(str(rng.randint(1, 400)), P)]))
            above = "text"
        rows.append((above, "text", [(a, T), (" --> ", P), (b, T)]))
        cut = rng.randint(1, len(said)) if rng.random() < 0.2 else len(said)
        rows.append(("time", below, [*([("<v ", P), (who, S), (">", P)] if who else []), *said[:cut], *([("</v>", P)] if who and cut == len(said) else [])]))
        if cut < len(said):
            rows.append(("text", below, [*said[cut:], *([("</v>", P)] if who else [])]))
    elif layout == 8:  # a name without a time
        rows.append((above, below, [*named(after_name), *said]))
    else:
        inner = " ".join(word() for _ in range(rng.choice([1, 1, 2])))
        rows.append((above, below, [(rng.choice([f"--- {inner} ---", f"[{inner} {word()}]", f"-- {inner} --", f"*** {inner} ***", f"=== {inner.capitalize()} ===", f"~~ {inner} ~~"]), "ANNOTATION")]))
    if layout != 9 and rng.random() < 0.3:
        rows.append(("text", below, speech()))
    return [(b, a, pieces, roster) for b, a, pieces in rows]


def _spelt(pieces: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """A made-up line as text, and which tag each stretch of it has."""
    text, spans, last = "", [], ""
    for piece, tag in pieces:
        if not piece:
            continue
        tight = not text or tag == "SEPARATOR" or last == "SEPARATOR" or (tag == "SPEECH" and piece in (".", "?", "...", ";", "!"))
        glue = "" if tight else " "
        spans.append((len(text) + len(glue), len(text) + len(glue) + len(piece), tag))
        text += glue + piece
        last = tag
    return text, spans


def examples(rng: random.Random, many: int, part: int = 0) -> list[tuple[list[tuple], list[str]]]:
    """Tagged lines; the list of sounds is hidden from half of them."""
    out = []
    for _ in range(many):
        known = frozenset(f for f in FILLERS if rng.random() < 0.5) if rng.random() < 0.7 else frozenset()
        for before, after, pieces, roster in _made_up_lines(rng, part=part):
            text, spans = _spelt(pieces)
            toks = tokens(text)
            if toks:
                items, owner = features(toks, before, after, Names(roster), known)
                tags = [next((tag for a, b, tag in spans if a <= start < b), "SEPARATOR") for _, start, _ in toks]
                out.append((items, [tags[owner.index(i)] for i in range(len(items))]))
    return out


WEIGHTS = os.path.join(os.path.dirname(__file__), "transcript_tagger.npz")


@lru_cache(maxsize=1)
def trained() -> Chain:
    """The tagger as :func:`fitted`, from the file in which its weights are kept, or fitted anew without it."""
    return Chain.kept(WEIGHTS, TAGS, expand) or fitted()


def fitted() -> Chain:
    """The tagger, fitted on made-up lines; the same in every process."""
    return Chain(TAGS, expand).train(examples(random.Random(17), 4_500), epochs=4, batch=64)


# ---- speakers ---------------------------------------------------------------------------------


@lru_cache(maxsize=200_000)
def _fold(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c) or c == "̆")
    return " ".join(unicodedata.normalize("NFKC", plain).replace("ё", "е").split())


def one_slip(a: str, b: str) -> bool:
    """Whether at most one letter is changed, added, left out, or swapped with the next."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _near(name: str, word: str) -> bool:
    return len(name) >= 5 and len(word) >= 4 and one_slip(name, word)


# Forms of address and titles that stand before names.
_ADDRESS = frozenset("mr mrs ms miss dr prof professor sir herr frau hr fr m mme mlle monsieur madame sr sra srta don dona senor senora г-н г-жа господин госпожа пан пани др проф ing dipl eng".split())


def _who(label: str, people: list[tuple[int, list[str]]]) -> int:
    bare = re.sub(r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " ", re.split(r"[<>]", label.lstrip("<> "))[0])
    bare = re.sub(r"(?<=[^\W\d_A-ZА-ЯЁІЇЄҐ])(?=[A-ZА-ЯЁІЇЄҐ])", " ", bare)  # names written together
    parts = [p for p in re.split(r"[\s,./_@|:;*#\"«»“”–—-]+", _fold(bare)) if p]
    if not parts or len(parts) > 8 or not people:
        return 0
    bare_parts = [p for p in parts if p not in _ADDRESS] or parts

    def fits(words: list[str], tests: list) -> int:
        for test in tests:
            got = [n for n, p in people if test(p[0], p[-1], p)]
            if got:
                return got[0]
        return 0

    for words in ([bare_parts, parts] if bare_parts != parts else [parts]):
        joined = "".join(words)
        tests = [
            lambda g, s, p, w=words: sorted(w) == sorted(p),
            lambda g, s, p, w=words: len(w) > 2 and g != s and g in w and s in w,
        ]
        if len(words) == 2:
            a, b = words
            for i, whole in ((a, b), (b, a)):
                if len(i) == 1:
                    tests += [lambda g, s, p, i=i, x=whole: s == x and g[0] == i, lambda g, s, p, i=i, x=whole: g == x and s[0] == i, lambda g, s, p, i=i, x=whole: (_near(s, x) and g[0] == i) or (_near(g, x) and s[0] == i)]
            if len(a) == len(b) == 1:
                tests += [lambda g, s, p, a=a, b=b: (g[0], s[0]) == (a, b), lambda g, s, p, a=a, b=b: (s[0], g[0]) == (a, b)]
            if min(len(a), len(b)) > 1:
                for x, y in ((a, b), (b, a)):
                    tests += [
                        lambda g, s, p, x=x, y=y: one_slip(f"{g} {s}", f"{x} {y}") and len(g) + len(s) >= 6,
                        lambda g, s, p, x=x, y=y: one_slip(g, x) and one_slip(s, y) and len(g) + len(s) >= 9,
                        lambda g, s, p, x=x, y=y: (g == x and len(y) >= 2 and s.startswith(y)) or (s == y and len(x) >= 2 and g.startswith(x)),
                    ]
        elif len(words) == 1:
            a = words[0]
            tests += [lambda g, s, p, a=a: a in (g, s)]
            if len(a) == 2:
                tests += [lambda g, s, p, a=a: a == g[0] + s[0], lambda g, s, p, a=a: a == s[0] + g[0]]
            tests += [
                lambda g, s, p, a=a: a in (g + s, s + g),
                lambda g, s, p, a=a: len(a) >= 4 and a in (g[0] + s, s + g[0], g + s[0]),
                lambda g, s, p, a=a: _near(g, a) or _near(s, a),
                lambda g, s, p, a=a: len(a) >= 8 and (one_slip(g + s, a) or one_slip(s + g, a)),
            ]
        got = fits(words, tests)
        if got:
            return got
        # Words beside a name are a role or a place only where they are plainly no other name.
        if len(words) == 3 and len(joined) > 8:
            for drop in range(3):
                got = fits(words, [lambda g, s, p, w=[x for k, x in enumerate(words) if k != drop]: (one_slip(g, w[0]) and one_slip(s, w[1])) or (one_slip(s, w[0]) and one_slip(g, w[1]))])
                if got:
                    return got
            short = [x for x in words if len(x) > 1]
            if len(short) == 1:  # a name with two initials
                got = fits(words, [lambda g, s, p, x=short[0]: s == x or _near(s, x), lambda g, s, p, x=short[0]: g == x])
                if got:
                    return got
    return 0


def who_is(label: str, roster: list[tuple[int, str]]) -> int:
    """The number of the participant a label names: by full name in either order, name with an
    initial, one name, initials, or names written together, with or without a form of address or a
    remark; with at most one slip in names of five letters or more.  0 for nobody; the smallest
    number if several fit equally well."""
    return Names(roster).who(label)


# ---- utterances -------------------------------------------------------------------------------


def utterances(body: str, roster: list[tuple[int, str]], model: Chain) -> list[dict]:
    """The utterances of one section, see :func:`all_utterances`."""
    return all_utterances([(body, Names(roster))], model)[0]


def all_utterances(sections: list[tuple[str, Names]], model: Chain) -> list[list[dict]]:
    """The utterances of each section in the order they stand: hour (None if left out), seconds, the
    label (None if there is none) and the words said."""
    lines: list[tuple[int, str, list, list[int]]] = []
    keys: list[list] = []
    for at, (body, names) in enumerate(sections):
        rows = body.split("\n")
        cut = [tokens(r) for r in rows]
        kinds = ["none", *[kind_of_line(t) for t in cut], "none"]
        for i, (line, toks) in enumerate(zip(rows, cut, strict=True)):
            if toks:
                items, owner = features(toks, kinds[i], kinds[i + 2], names)
                lines.append((at, line, toks, owner))
                keys.append(items)
    out: list[list[dict]] = [[] for _ in sections]
    for (at, line, toks, owner), tags in zip(lines, model.decode_many(keys), strict=True):
        _read_line(out[at], line, toks, [tags[i] for i in owner])
    return out


def _read_line(out: list[dict], line: str, toks: list[tuple[str, int, int]], tags: list[str]) -> None:
    times = [x for x in (clock(t) for (t, _, _), tag in zip(toks, tags, strict=True) if tag == "TIME") if x]
    speaker: list[tuple[int, int]] = []
    last = 0
    spoken = next((i for i, tag in enumerate(tags) if tag == "SPEECH"), len(tags))
    for i in (i for i, tag in enumerate(tags[:spoken]) if tag == "SPEAKER"):  # the first run before what is said; only brackets, commas and full stops may stand within it
        if speaker and any(toks[j][0] not in "().,[]-" for j in range(last + 1, i)):
            break
        speaker.append(toks[i][1:])
        last = i
    if sum(line[a:b][0].isalnum() for a, b in speaker) > 6:
        speaker, spoken = [], -1  # no name is that long
    said = [x for i, (x, tag) in enumerate(zip(toks, tags, strict=True)) if tag == "SPEECH" or (tag == "SPEAKER" and i > spoken)]
    if times:
        out.append({"hour": times[0][0], "second": times[0][1], "label": None, "words": 0, "text": ""})
    if out:
        now = out[-1]
        if speaker and now["label"] is None and not now["words"]:
            now["label"] = line[speaker[0][0] : speaker[-1][1]]
        words = sum(t[0].isalnum() for t, _, _ in said)
        if words:
            now["words"] += words
            now["text"] += (" " if now["text"] else "") + _clean(line, said)


def _clean(line: str, said: list[tuple[str, int, int]]) -> str:
    """The tagged words as running text: space between tokens as in the line, none left at cuts."""
    text, last = "", None
    for t, a, b in said:
        if last is not None and a > last:
            text += " "
        text += t
        last = b
    return re.sub(r"\s+([,.;?!…])", r"\1", re.sub(r"^[\s,.;…]+", "", text)).strip()


def section_turns(found: list[dict], names: Names) -> list[dict]:
    """The turns of one section: spoken utterances in the order of time, each without a label under
    the speaker before it, joined while the speaker is the same.  Those that open the section
    without a label are a turn whose speaker is None.

    Windows begin at whole multiples of two minutes, so that marks without the hour never cross one
    within a section.
    """
    turns: list[dict] = []
    now = None
    spoken = [u for u in found if u["words"]]
    for u in sorted(spoken, key=lambda u: (u["hour"] or 0) * 3600 + u["second"]):
        if u["label"] is not None:
            now = names.who(u["label"])
        if turns and turns[-1]["speaker"] == now:
            turns[-1]["text"] += f" {u['text']}"
        else:
            turns.append({"speaker": now, "hour": u["hour"], "second": int(u["second"]), "text": u["text"]})
    return turns


def speaker_turns(sections: DataFrame, speakers: DataFrame) -> DataFrame:
    """``(parent_id, turn_no int, speaker_no int, start_second int, text)``: the turns of every
    transcript section, i.e. of every section but number 0 of the sources in ``speakers``.

    Sections with a null body, source or id have no turns; repeated sections count once (of
    different rows with one id, that with the greatest body).  Without a window in ``prefixes``
    (null or another form) the hour comes from the nearest section that has one.  A section of
    nothing but sounds has no turns, nor has an empty table.  Other columns are ignored.

    Bodies are read section by section; only one narrow row a section meets those of its source.
    """
    given = pick(sections, parent_id="parent_id", source="source", section_index="section_index", prefixes="prefixes", body="body")
    given = given.where("parent_id is not null and source is not null and body is not null and section_index > 0")
    window = F.regexp_extract(F.concat_ws(" ", "prefixes"), r"\[(\d+(?::\d{2}){1,2})\s*[–—-]", 1)
    once = given.groupBy("parent_id").agg(F.max(F.struct("body", "source", "section_index", window.alias("window"))).alias("x")).select("parent_id", "x.*")
    named = pick(speakers, source="source", speaker_no="speaker_no", full_name="full_name").where("source is not null and speaker_no is not null and full_name is not null").distinct()
    rosters = named.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("speaker_no", "full_name"))).alias("roster"))
    shared = sections.sparkSession.sparkContext.broadcast(trained())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        meetings: dict[str, Names] = {}
        for batch in batches:
            at: list[int] = []
            cols: list[list] = [[], [], [], [], []]
            todo: list[tuple[str, Names]] = []
            size, done = 0, 0
            for i, (source, body, roster) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                if source not in meetings:
                    if len(meetings) > 2_000:
                        meetings.clear()
                    meetings[source] = Names([(r["speaker_no"], r["full_name"]) for r in roster])
                todo.append((body, meetings[source]))
                size += body.count("\n") + 1
                if size >= LINES_TOGETHER or i + 1 == batch.num_rows:
                    for (_, names), found in zip(todo, all_utterances(todo, model), strict=True):
                        for n, t in enumerate(section_turns(found, names), 1):
                            at.append(done)
                            for col, v in zip(cols, (n, t["hour"], t["second"], t["speaker"], t["text"]), strict=True):
                                col.append(v)
                        done += 1
                    todo, size = [], 0
            take = pa.array(at, type=pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(take) for j in (0, 1, 2, 4)), *(pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True))], names=["parent_id", "source", "section_index", "window", "turn_no", "hour", "second", "speaker_no", "text"])

    rows = once.join(rosters, "source").select("parent_id", "source", F.col("section_index").cast("int"), "body", "window", "roster")
    said = stored(spread(rows, "parent_id").mapInArrow(read, "parent_id string, source string, section_index int, window string, turn_no int, hour int, second int, speaker_no int, text string"), "turns")

    clock = F.reverse(F.split("window", ":"))
    start = F.when(F.col("window") != "", F.get(clock, F.lit(0)).cast("int") + 60 * F.get(clock, F.lit(1)).cast("int") + 3600 * F.coalesce(F.get(clock, F.lit(2)).cast("int"), F.lit(0)))
    # One narrow row a section: when its source began by its window, and who spoke last in it.
    brief = said.groupBy("parent_id", "source", "section_index").agg(F.first(start - WINDOW_SECONDS * F.col("section_index")).alias("base"), F.max_by("speaker_no", "turn_no").alias("last"))
    order = Window.partitionBy("source").orderBy("section_index", "parent_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = brief.select(
        "parent_id",
        F.coalesce("base", F.last("base", ignorenulls=True).over(before), F.first("base", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))).alias("base"),
        F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(0)).alias("carried"),
    )
    guess = F.col("base") + WINDOW_SECONDS * F.col("section_index") + WINDOW_SECONDS // 2
    hour = F.coalesce("hour", F.greatest(F.lit(0), F.round((guess - F.col("second")) / 3600)), F.lit(0)).cast("int")
    known = said.join(filled, "parent_id").withColumn("start_second", hour * 3600 + F.col("second")).withColumn("speaker_no", F.coalesce("speaker_no", "carried"))
    # A carried speaker may be that of the second turn, which is then the same turn.
    opening = F.max_by("speaker_no", F.when(F.col("turn_no") <= 2, -F.col("turn_no")))
    second = F.max(F.when(F.col("turn_no") == 2, F.col("speaker_no")))
    same = known.where("turn_no <= 2").groupBy("parent_id").agg(opening.alias("x"), second.alias("y")).where("x = y").select("parent_id", F.lit(1).alias("less"))
    numbered = known.join(same, "parent_id", "left").withColumn("turn_no", F.greatest(F.lit(1), F.col("turn_no") - F.coalesce("less", F.lit(0))))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_second", "text"))), lambda x: x["text"]), " ")
    return numbered.groupBy("parent_id", "turn_no").agg(F.first("speaker_no").alias("speaker_no"), F.min("start_second").alias("start_second"), text.alias("text"))
