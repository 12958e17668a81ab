"""Documents with HTML, Markdown, wiki or LaTeX markup as clean text of labelled blocks.

A text is read into leaves: stretches that stand on their own, each with the path of markup around
it.  A recurrent labeller (a bidirectional LSTM in numpy) reads the whole sequence of leaves of a
document, each as a vector of its tag path, the signs its lines begin with and its hashed words, and
gives each leaf a kind: heading, paragraph, list, code, formula, table, or none (comments, scripts, anchors, labels,
templates standing alone).  Leaves are cleaned of their markup and put together by kind.

The labeller is fitted on documents made up in the four notations; the weights are kept in a file
beside this one (``python -m passagemill.llm.models`` fits them again).
"""

from __future__ import annotations

import html
import os
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import pick, spread

KINDS = ["paragraph", "heading", "list", "code", "formula", "table", "none"]
#: Whether a text holds markup at all (checked in the JVM, before any Python).
HOLDS_MARKUP = (
    r"(?m)</?[a-zA-Z][a-zA-Z0-9]*(\s[^<>]*)?/?>|<!--|&(?:[a-zA-Z]{2,8}|#\d+|#x[0-9a-fA-F]+);"
    r"|^ {0,3}#{1,6} \S|^ {0,3}(?:```|~~~)|^ {0,3}[^\s|][^\n]*\n {0,3}(?:={3,}|-{3,})[ \t]*$|^ {0,3}[-*+] +[^\s\d—–-]|^ {0,3}1[.)] \S[^\n]*\n(?:[ \t]+[^\n]*\n)*2[.)] \S|^\|.*\|[ \t]*$|^h[1-6]\. \S|^=+ [^=\n]+ =+[ \t]*$"
    r"|\[\[|\]\(|\{\{|\{\||'''?\S|\*\*\S|(?<!\w)__\S|(?<![\w`])`[^`\n]+`|~~\S|(?<!\w)_[^_\s][^_\n]*_(?!\w)|(?<!\w)\*[^*\s][^*\n]*\*(?!\w)"
    r"|\[https?://\S+ |^\[[^\]\n]+\]: \S|^__[A-Z]+__|\\(?:begin|end|section|subsection|subsubsection|emph|textbf|underline|href|footnote|cite|label|ref|item|textit|url)\b|\\\[|\\\(|\$\$"
)

_HTML_BLOCK = "p div h1 h2 h3 h4 h5 h6 ul ol table pre style script math blockquote section article header footer nav figure dl form".split()
_BLOCK_TAG = re.compile(rf"<(/?)({'|'.join(sorted(_HTML_BLOCK, key=len, reverse=True))}|html|body|head|a name)\b([^<>]*)>|<!--.*?-->|<!DOCTYPE[^>]*>|<meta\b[^<>]*>|<title\b[^<>]*>.*?</title>|<br\s*/?>\s*<br\s*/?>", re.IGNORECASE | re.DOTALL)
_ATOMIC = {"ul", "ol", "table", "pre", "style", "script", "math", "dl"}
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_LIST_ITEM = re.compile(r"^\s*(?:[-+*•]|\d{1,3}[.)]|[*#]{1,4})\s+\S")
_WIKI_ITEM = re.compile(r"^[*#:;]{1,5}\s*\S")
_ENVIRONMENT = re.compile(r"^\s*\\begin\{([a-zA-Z*]+)\}")


class Leaf:
    __slots__ = ("text", "path", "seen")

    def __init__(self, text: str, path: str):
        self.text, self.path = text, path
        self.seen: list[int] | None = None  # its vector's positions, once asked for


def leaves(text: str) -> list[Leaf]:
    """The stretches of a text that stand on their own, in reading order.

    Cuts are made at the borders of block tags, fences, environments, display formulas and wiki
    tables, at blank lines, and before and after heading lines, tables and list items; items that
    follow each other are one leaf.
    """
    out: list[Leaf] = []
    plain: list[str] = []
    lines = text.split("\n")

    def flush() -> None:
        if plain:
            body = "\n".join(plain)
            if body.strip():
                out.append(Leaf(body, "text"))
            plain.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        bare = line.strip()
        fence = _FENCE.match(line)
        env = _ENVIRONMENT.match(line)
        low = bare.lower()
        if fence:
            flush()
            mark, j = fence.group(1), i + 1
            while j < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$", lines[j]):
                j += 1
            out.append(Leaf("\n".join(lines[i : j + 1]), "fence"))
            i = j + 1
        elif env:
            flush()
            name, depth, j = env.group(1), 0, i
            while j < len(lines):
                depth += lines[j].count(f"\\begin{{{name}}}") - lines[j].count(f"\\end{{{name}}}")
                if depth <= 0:
                    break
                j += 1
            if name == "document":
                i += 1
                continue
            out.append(Leaf("\n".join(lines[i : j + 1]), f"env:{name.rstrip('*')}"))
            i = j + 1
        elif re.match(r"\{(code|noformat)\b[^{}]*\}", low):
            flush()
            close = "{" + re.match(r"\{(\w+)", low).group(1) + "}"
            j = i + (close not in low[1:])
            while j < len(lines) and j > i and close not in lines[j].lower():
                j += 1
            out.append(Leaf("\n".join(lines[i : j + 1]), "brace"))
            i = j + 1
        elif bare.startswith("{|"):
            flush()
            j = i
            while j < len(lines) and not lines[j].strip().startswith("|}"):
                j += 1
            out.append(Leaf("\n".join(lines[i : j + 1]), "wikitable"))
            i = j + 1
        elif re.match(r"<(source|syntaxhighlight|nowiki|code)\b", low) and not re.match(r"<code>[^<]*</code>\s*\S", low):
            flush()
            name = re.match(r"<(\w+)", low).group(1)
            j = i
            while j < len(lines) and f"</{name}>" not in lines[j].lower():
                j += 1
            out.append(Leaf("\n".join(lines[i : j + 1]), f"tag:{name}"))
            i = j + 1
        elif bare.startswith("$$") or bare.startswith("\\["):
            flush()
            close = "$$" if bare.startswith("$$") else "\\]"
            j = i
            rest = bare[2:]
            while close not in rest and j + 1 < len(lines):
                j += 1
                rest = lines[j]
            out.append(Leaf("\n".join(lines[i : j + 1]), "display"))
            i = j + 1
        elif bare.startswith("<") and _BLOCK_TAG.match(bare):
            flush()
            i = _html(lines, i, out)
        elif not bare:
            flush()
            i += 1
        elif re.match(r"^ {0,3}#{1,6}\s+\S", line) and not _hash_list(lines, i):
            flush()
            out.append(Leaf(line, "hash"))
            i += 1
        elif re.match(r"^=+[^=].*=+\s*$", bare) or re.match(r"^h[1-6]\.\s+\S", bare):
            flush()
            out.append(Leaf(line, "equals" if bare[0] == "=" else "hdot"))
            i += 1
        elif re.match(r"^\\(?:sub)*(?:section|paragraph|chapter|part)\*?\{", bare):
            flush()
            out.append(Leaf(line, "section"))
            i += 1
        elif i + 1 < len(lines) and re.match(r"^\s*(={3,}|-{3,})\s*$", lines[i + 1]) and not plain and not bare.startswith("|"):
            flush()
            out.append(Leaf("\n".join(lines[i : i + 2]), "underlined"))
            i += 2
        elif bare.startswith("|") and bare.count("|") >= 2:
            flush()
            j = i
            while j < len(lines) and lines[j].strip().startswith("|"):
                j += 1
            out.append(Leaf("\n".join(lines[i:j]), "pipes"))
            i = j
        elif _LIST_ITEM.match(line) or _WIKI_ITEM.match(line) and not bare.startswith("**"):
            flush()
            j = i
            while j < len(lines) and lines[j].strip() and (_LIST_ITEM.match(lines[j]) or _WIKI_ITEM.match(lines[j]) or lines[j][:1].isspace()):
                j += 1
            out.append(Leaf("\n".join(lines[i:j]), "items"))
            i = j
        elif re.match(r"^\[[^\]]+\]:\s+\S+", bare) or re.match(r"^__[A-Z]+__\s*$", bare) or re.match(r"^\\(?:label|centering|maketitle|tableofcontents|newpage|documentclass|usepackage|bibliography)\b", bare) or re.match(r"^\{\{.*\}\}\s*$", bare) or re.match(r"^\[\[(?:Category|Kategorie|Категория|Категорія|Catégorie|Categoría|File|Image)\s*:.*\]\]\s*$", bare, re.IGNORECASE) or re.match(r"^%", bare) or re.match(r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$", bare):
            flush()
            out.append(Leaf(line, "alone"))
            i += 1
        elif bare.startswith("<!--"):
            flush()
            j = i
            while j < len(lines) and "-->" not in lines[j]:
                j += 1
            out.append(Leaf("\n".join(lines[i : j + 1]), "comment"))
            i = j + 1
        else:
            plain.append(line)
            i += 1
    flush()
    return out


def _hash_list(lines: list[str], i: int) -> bool:
    """A lone '#' opens a wiki item, not a heading, where items follow each other or the line is long."""
    here = re.match(r"^#\s+(\S.*)", lines[i])
    if not here:
        return False
    near = [lines[j] for j in (i - 1, i + 1) if 0 <= j < len(lines)]
    return any(re.match(r"^#{1,3}[*#:]*\s+\S", x) for x in near)


def _html(lines: list[str], i: int, out: list[Leaf]) -> int:
    """Leaves of a stretch of HTML from line ``i`` on; the number of the line after it."""
    text = "\n".join(lines[i:])
    pos = 0
    while True:
        m = _BLOCK_TAG.match(text, pos)
        if not m:
            break
        if m.group(2) is None:
            out.append(Leaf(m.group(), "comment"))
            pos = m.end()
        else:
            closing, name = m.group(1), m.group(2).lower()
            if name in ("html", "body", "head", "section", "article", "header", "footer", "nav", "figure", "form") or closing:
                pos = m.end()
            elif name == "a name":
                end = re.compile(r"</a>", re.IGNORECASE).search(text, m.end())
                pos = end.end() if end else m.end()
                out.append(Leaf(text[m.start() : pos], "tag:a"))
            else:
                end = _end_of(text, m, name)
                out.append(Leaf(text[m.start() : end], f"tag:{name}"))
                pos = end
        skip = re.compile(r"[ \t]*\n?[ \t]*").match(text, pos)
        if _BLOCK_TAG.match(text, skip.end()):
            pos = skip.end()
        elif text[pos : skip.end()].find("\n") < 0 and text[pos : pos + 1] not in ("", "\n"):
            stop = _BLOCK_TAG.search(text, pos)
            gap = text.find("\n\n", pos)
            end = min(x for x in (stop.start() if stop else len(text), gap if gap >= 0 else len(text)))
            if text[pos:end].strip():
                out.append(Leaf(text[pos:end], "text"))
            pos = end
            if stop and stop.start() == end:
                continue
            break
        else:
            break
    used = text[:pos].count("\n")
    rest = text[pos:].split("\n", 1)[0]
    if rest.strip():
        lines[i + used] = rest
        return i + used
    return i + used + 1


def _end_of(text: str, m: re.Match, name: str) -> int:
    """Where an element ends: at its end tag (nested ones counted), or, where that is missing or
    left out, at the next block or blank line; at the end of a cut text."""
    tags = re.compile(rf"<(/?){name}\b[^<>]*>", re.IGNORECASE)
    depth = 1
    if name in _ATOMIC:
        for t in tags.finditer(text, m.end()):
            depth += -1 if t.group(1) else 1
            if depth == 0:
                return t.end()
        return len(text)
    for t in _BLOCK_TAG.finditer(text, m.end()):
        if t.group(2) is None:
            continue
        if t.group(2).lower() == name and t.group(1):
            return t.end()
        if name == "p" or t.group(1):
            return t.start() if not t.group(1) or t.group(2).lower() in ("body", "html") else t.start()
        inner = text[m.end() : t.start()].strip()
        if t.group(2).lower() != name and inner:
            return t.start()
        if t.group(2).lower() == name:
            return t.start()
    gap = text.find("\n\n", m.end())
    return gap if gap >= 0 and name == "p" else len(text)


# ---- vectors --------------------------------------------------------------------------------------

WIDTH = 2_048  #: slots of hashed words, signs and tag paths
_TAGS = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)|\\begin\{([a-zA-Z]+)|<(!--)")
_WORDS = re.compile(r"\\?[^\W\d_]+|\d+|[^\w\s]+")


def _sign(line: str) -> str:
    """How a line begins: its first signs with letters and digits as kinds, whether it is indented."""
    bare = line.strip()
    head = re.match(r"[^\w\s]{1,4}|\d+[.)]?|\\?[^\W\d_]+", bare)
    start = head.group() if head else ""
    kind = "a" if start[:1].isalpha() else "9" + start[-1:] if start[:1].isdigit() else start
    return f"{'>' if line[:1].isspace() else ''}{kind}{' ' if bare[len(start) : len(start) + 1] == ' ' else ''}"


def slots(leaf: Leaf) -> list[int]:
    """The positions that are 1 in a leaf's vector: its tag path, how its lines begin and end, its
    length, and all of its words and signs, hashed."""
    if leaf.seen is not None:
        return leaf.seen
    text = leaf.text
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    tags = [next(filter(None, t)).lower() for t in _TAGS.findall(text)]
    names = [f"path={'/'.join(tags[:n])}" for n in (1, 2)] + [f"tag={t}" for t in set(tags[:12])]
    names += [f"first={_sign(lines[0])}", f"last={_sign(lines[-1])}", *{f"line={_sign(x)}" for x in lines[1:40]}]
    names += [f"end={text.rstrip()[-1:] if not text.rstrip()[-1:].isalnum() else 'a'}", f"chars={min(8, len(text) // 40)}", f"lines={min(4, len(lines))}"]
    names += [f"w={w.lower()[:24]}" if not w[0].isdigit() else "w=9" for w in set(_WORDS.findall(text))]
    leaf.seen = sorted({xxhash.xxh3_64_intdigest(x) % WIDTH for x in names})
    return leaf.seen


class Labeller:
    """A bidirectional LSTM over leaves with a softmax at each, in numpy."""

    def __init__(self, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = draw(WIDTH, 4 * hidden) * 2
            self.p[f"u{d}"] = draw(hidden, 4 * hidden)
            self.p[f"b{d}"] = np.zeros(4 * hidden, dtype=np.float32)
        self.p["wo"] = draw(2 * hidden, len(KINDS))
        self.p["bo"] = np.zeros(len(KINDS), dtype=np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        n, steps, h = x.shape[0], x.shape[1], self.hidden
        state, cell = np.zeros((n, h), dtype=np.float32), np.zeros((n, h), dtype=np.float32)
        out, trace = np.zeros((n, steps, h), dtype=np.float32), []
        inputs = x @ self.p[f"w{d}"] + self.p[f"b{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[:, t] + state @ self.p[f"u{d}"]
            i, f, o = (1 / (1 + np.exp(-np.clip(z[:, k * h : (k + 1) * h] + (1.0 if k == 1 else 0.0), -20, 20))) for k in range(3))
            g = np.tanh(z[:, 3 * h :])
            new = f * cell + i * g
            m = mask[:, t, None]
            tanh = np.tanh(new)
            trace.append((t, state, cell, i, f, o, g, tanh, m))
            cell = m * new + (1 - m) * cell
            state = m * (o * tanh) + (1 - m) * state
            out[:, t] = state
        return out, trace

    def scores(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        fwd, ft = self._run(x, mask, "f")
        bwd, bt = self._run(x, mask, "b")
        both = np.concatenate([fwd, bwd], axis=2)
        return both @ self.p["wo"] + self.p["bo"], (both, ft, bt)

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, past: dict, rate: float) -> float:
        """One step of back-propagation through time with Adagrad; the loss before it."""
        z, (both, ft, bt) = self.scores(x, mask)
        z = np.exp(z - z.max(axis=2, keepdims=True))
        prob = z / z.sum(axis=2, keepdims=True)
        n, steps, h = x.shape[0], x.shape[1], self.hidden
        rows, cols = np.indices(y.shape)
        loss = float(-(np.log(prob[rows, cols, y] + 1e-9) * mask).sum() / mask.sum())
        dz = prob
        dz[rows, cols, y] -= 1
        dz *= mask[:, :, None] / n
        flat = x.reshape(-1, x.shape[2]).T
        g = {"wo": np.einsum("nth,ntk->hk", both, dz), "bo": dz.sum(axis=(0, 1))}
        dboth = dz @ self.p["wo"].T
        for d, trace, part in (("f", ft, dboth[:, :, :h]), ("b", bt, dboth[:, :, h:])):
            dw_in = np.zeros((n, steps, 4 * h), dtype=np.float32)
            du = np.zeros_like(self.p[f"u{d}"])
            ds, dc = np.zeros((n, h), dtype=np.float32), np.zeros((n, h), dtype=np.float32)
            for t, state, cell, i, f, o, gg, tanh, m in reversed(trace):
                ds = ds + part[:, t]
                dh = ds * m
                dnew = dc * m + dh * o * (1 - tanh**2)
                dzt = np.concatenate([dnew * gg * i * (1 - i), dnew * cell * f * (1 - f), dh * tanh * o * (1 - o), dnew * i * (1 - gg**2)], axis=1)
                dw_in[:, t] = dzt
                du += state.T @ dzt
                ds = ds * (1 - m) + dzt @ self.p[f"u{d}"].T
                dc = dc * (1 - m) + dnew * f
            g[f"w{d}"], g[f"u{d}"], g[f"b{d}"] = flat @ dw_in.reshape(-1, 4 * h), du, dw_in.sum(axis=(0, 1))
        for k, v in g.items():
            past[k] = past.get(k, 1e-6) + v**2
            self.p[k] -= rate * v / np.sqrt(past[k])
        return loss

    def label(self, docs: list[list[Leaf]]) -> list[list[int]]:
        """The kinds of the leaves of each document; documents of like length go together."""
        out: list[list[int]] = [[] for _ in docs]
        order = sorted((i for i, d in enumerate(docs) if d), key=lambda i: len(docs[i]))
        lo = 0
        while lo < len(order):
            many = 1
            while many < 64 and lo + many < len(order) and (many + 1) * len(docs[order[lo + many]]) <= 4_000:
                many += 1
            part = order[lo : lo + many]
            lo += many
            x, mask = batch_of([docs[i] for i in part])
            best = self.scores(x, mask)[0].argmax(axis=2)
            for row, i in enumerate(part):
                out[i] = best[row, : len(docs[i])].tolist()
        return out


def batch_of(docs: list[list[Leaf]]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(d) for d in docs)
    x, mask = np.zeros((len(docs), steps, WIDTH), dtype=np.float32), np.zeros((len(docs), steps), dtype=np.float32)
    for i, d in enumerate(docs):
        mask[i, : len(d)] = 1
        for t, leaf in enumerate(d):
            x[i, t, slots(leaf)] = 1
    return x, mask


# ---- made-up documents ------------------------------------------------------------------------------


def _made_up(rng: random.Random) -> str:
    """Blocks in one notation with the kind of each: ``\\x00kind\\x00`` stands before every block."""
    alphabet = rng.choice(["ba ve li tor mun ske dra fi pre zol han ul", "ба ве ли тор мун ске дра фи пре зол хан ул"]).split()
    word = lambda n=3: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, n)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    code = lambda: f"{rng.choice(['AP', 'KB', 'INV'])}{rng.choice('-/ ')}{rng.randint(99, 9999999)}"
    notations = ["markdown", "html", "wiki", "latex"]
    main = note = rng.choice(notations)

    def inline(t: str) -> str:
        x = {
            "markdown": [f"**{t}**", f"_{t}_", f"[{t}](https://x.example/1)", f"`{t}`", f"~~{t}~~", f"![{t}](data:image/png;base64,xx==)", f"***{t}***"],
            "html": [f"<b>{t}</b>", f'<a href="https://x.example">{t}</a>', f"{t}<br/>", f"&laquo;{t}&raquo;", f"<em>{t}</em>", f"{t}&nbsp;&mdash;", f'<span style="color:#444">{t}</span>', f"{t}<sup>2</sup>", f"$x_1$ {t}"],
            "wiki": [f"'''{t}'''", f"''{t}''", f"[[{word()}|{t}]]", f"[https://x.example/1 {t}]", f"{{{{nobr|{t}}}}}", f"{t}<ref>{code()}</ref>"],
            "latex": [f"\\emph{{{t}}}", f"\\href{{https://x.example}}{{{t}}}", f"\\underline{{{t}}}", f"{t}\\footnote{{{code()}}}", f"{t}~\\cite{{k12}}", f"\\textbf{{{t}}}", f"${word()}^2$ {t}"],
        }[note]
        return rng.choice(x)

    def sentence() -> str:
        w = [rng.choice([word(), word(), word(), code(), inline(word()) if rng.random() < 0.4 else word()]) for _ in range(rng.randint(6, 20))]
        w[0] = w[0][0].upper() + w[0][1:]
        return " ".join(w) + rng.choice([".", ".", ".", "?", " (Abc, 12)."])

    formula = rng.choice([f"E = {rng.randint(1, 99)} \\cdot k_{{{word()}}}^2 - {rng.randint(1, 99)}", f"\\sum_{{i=1}}^{{{rng.randint(1, 99)}}} x_i \\le 7", f"R_{{{word()}}} = \\frac{{3}}{{1 + r}}", f"\\sqrt{{a^2 + 11}} > b", "D_t = D_0 - t \\times 12 / 23"])
    snippet = rng.choice([f"{word()} = fetch(\"{word()}\", limit=12)\n# keep the newest\n{word()}.sort(key=lambda x: -x[9 % 7])", f"SELECT {word()}, SUM({word()}) FROM ledger_1 WHERE {word()} > 5 GROUP BY {word()};", f"#!/bin/sh\ncp -r /srv/{word()} /srv/{word()}\necho \"moved 7\"", f"<config name=\"{word()}\">\n  <limit>5</limit>\n</config>", f"for row in load('{word()}.csv'):\n    if row['a'] < {rng.randint(1, 99)}:\n        report(row)", f"{{\n  \"{word()}\": {rng.randint(1, 99999)},\n  \"{word()}\": [{rng.randint(1, 99)}, 3]\n}}", f"if {word()} > {rng.randint(1, 99)}:\n    {word()}({word()}, '{word()}')\nelse:\n    {word()} += 1", f"{word()} {{\n  {word()}: {rng.randint(1, 99)}px;\n}}", f"$ {word()} --{word()} {rng.randint(1, 99)}"])
    rows = [[words(1, 3), code(), rng.choice([word(), "NaN", "12"])] for _ in range(rng.randint(2, 5))]
    items = [f"{words(3, 8).capitalize()} {code()}" for _ in range(rng.randint(1, 5))]
    title = rng.choice(["", f"{rng.randint(1, 9)}.{rng.randint(1, 9)} ", f"{rng.randint(1, 12)}. "]) + words(2, 5).capitalize()

    def block(kind: str) -> str:
        if kind == "paragraph":
            glue = rng.choice([" ", " ", "\n"])
            p = glue.join(sentence() for _ in range(rng.randint(1, 4)))
            if note == "html":
                a = rng.choice(["<p>", '<p class="body">', "<P>", "<div>"])
                return a + p + (rng.choice(["</p>", "</p>", ""]) if "p" in a.lower()[:2] else "</div>")
            return p
        if kind == "heading":
            n = rng.randint(1, 4)
            return {"markdown": rng.choice([f"{'#' * n} {title}", f"{'#' * n} **{title}**", f"{'#' * n} {title} {'#' * n}", f"{title}\n{'=' * 12}", f"{title}\n{'-' * 12}"]), "html": rng.choice([f"<h{n}>{title}</h{n}>", f'<h{n} id="s1">{title}</h{n}>', f"<H{n}><span>{title}</span></H{n}>"]), "wiki": rng.choice([f"{'=' * (n + 1)} {title} {'=' * (n + 1)}", f"h{n}. {title}"]), "latex": rng.choice([f"\\section{{{title}}}", f"\\subsection*{{{title}}}", f"\\subsubsection{{{title}}}"])}[note]
        if kind == "list":
            sub = code()
            mark = rng.choice(["-", "*", "+", None])
            nested = rng.random() < 0.3
            if note == "markdown":
                return "\n".join(f"{mark or f'{i}.'} {x}" + (f"\n{rng.choice(['    ', '   '])}- {sub}" if nested and i == 1 else "") for i, x in enumerate(items, 1))
            if note == "html":
                tag, shut = rng.choice(["ul", "ol"]), rng.choice(["</li>", ""])
                return f"<{tag}>\n" + "\n".join(f"<li>{x}" + (f"<ul><li>{sub}</li></ul>" if nested and i == 0 else "") + shut for i, x in enumerate(items)) + f"\n</{tag}>"
            if note == "wiki":
                m = rng.choice("*#")
                return "\n".join(f"{m} {x}" + (f"\n{m}{m} {sub}" if nested and i == 0 else "") for i, x in enumerate(items))
            tag = rng.choice(["itemize", "enumerate"])
            return f"\\begin{{{tag}}}\n" + "\n".join(f"  \\item {x}" for x in items) + f"\n\\end{{{tag}}}"
        if kind == "code":
            if note == "markdown":
                f = rng.choice(["```", "~~~", "````", "~~~~", "`````"])
                return f"{f}{rng.choice(['', '', 'python', 'sql', 'json', ' ' + word()])}\n{snippet}\n{f}"
            if note == "html":
                return rng.choice(["<pre><code>{}</code></pre>", '<pre><code class="language-x">{}</code></pre>', "<pre>{}</pre>"]).format(html.escape(snippet))
            if note == "wiki":
                return rng.choice(["{code}\n{}\n{code}", "<source>\n{}\n</source>", '<syntaxhighlight lang="text">\n{}\n</syntaxhighlight>', "<pre>\n{}\n</pre>"]).replace("{}", snippet)
            env = rng.choice(["verbatim", "lstlisting"])
            return f"\\begin{{{env}}}\n{snippet}\n\\end{{{env}}}"
        if kind == "formula":
            if note == "html":
                return rng.choice([f'<div class="math">\\[{formula}\\]</div>', f"<p>$${formula}$$</p>", f"<math><annotation>{html.escape(formula)}</annotation></math>", f'<div class="math">$${formula}$$</div>'])
            if note == "wiki":
                return rng.choice(["", ":"]) + f"<math>{formula}</math>"
            return rng.choice([f"$${formula}$$", f"\\[{formula}\\]", f"$$\n{formula}\n$$", f"\\[\n{formula}\n\\]", *([f"\\begin{{equation}}\n{formula}\n\\end{{equation}}", f"\\begin{{align*}}\n{formula}\n\\end{{align*}}"] if note == "latex" else [])])
        if kind == "table":
            if note == "markdown":
                return "\n".join(["| " + " | ".join(rows[0]) + " |", "| --- | :-: | ---: |", *("| " + " | ".join(r) + " |" for r in rows[1:])])
            if note == "html":
                d = rng.choice("dh")
                return "<table border=1>\n" + "\n".join("<tr>" + "".join(f"<t{d}>{c}</t{d}>" for c in r) + "</tr>" for r in rows) + "\n</table>"
            if note == "wiki":
                return '{| class="wikitable"\n! ' + " !! ".join(rows[0]) + "\n" + "\n".join("|-\n| " + " || ".join(r) for r in rows[1:]) + "\n|}"
            return "\\begin{tabular}{lll}\n" + " \\\\\n".join(" & ".join(r) for r in rows) + "\n\\end{tabular}"
        return rng.choice({"markdown": ["[TOC]", "---", "* * *", f"[{word()}]: <https://x.example/{word()}> \"{word()}\"", f"[{rng.randint(1, 99)}]: https://wiki.x.example/x", f"<!-- Slide number: {rng.randint(1, 30)} -->", f"<!-- {words(1, 3)} {rng.randint(1, 99999)} -->"], "html": [f"<!-- {words(1, 2)} {rng.randint(1, 99999)} -->", f"<script>var {word()}={rng.randint(1, 99999)};</script>", f"<style>.c{rng.randint(1, 99999)}{{margin:0}}</style>", f'<a name="a{rng.randint(1, 99999)}"></a>', f'<a name="{word()}"></a>', f'<meta name="{word()}" content="{word()}">', "<!DOCTYPE html>", f"<title>{words(1, 4)}</title>"], "wiki": ["__TOC__", "__NOTOC__", f"{{{{{word().capitalize()}}}}}", f"[[{rng.choice(['File', 'Image'])}:{word()}.png|thumb|{words(1, 3)}]]", f"[[{rng.choice(['Kategorie', 'Категория', 'Catégorie', 'Categoría', 'Категорія'])}:{word()}]]", f"{{{{Infobox|id={rng.randint(1, 99)}}}}}", f"[[Category:{word()}]]", "<!-- note -->"], "latex": [f"\\label{{sec:{rng.randint(1, 99999)}}}", f"% {words(1, 3)} {rng.randint(1, 9999)}", "\\centering", f"\\usepackage{{{word()}}}", f"\\usepackage[{word()}]{{{word()}}}", f"\\documentclass[11pt]{{{word()}}}", rng.choice(["\\maketitle", "\\tableofcontents", "\\newpage"]), f"\\bibliography{{{word()}}}", f"\\label{{tab:{word()}}}"]}[note])

    kinds = rng.choices(KINDS, [6, 2, 2, 1.3, 1.3, 1.5, 1.5], k=rng.randint(1, 9))
    mixed = rng.random() < 0.4
    out = []
    for k in kinds:
        note = rng.choice(notations) if mixed and rng.random() < 0.4 else main
        out.append((block(k), k))
    note = main
    if rng.random() < 0.35:  # a text cut short, as a retrieval unit is
        last, k = out[-1]
        out[-1] = (last[: max(12, int(len(last) * rng.uniform(0.3, 1)))], k)
    glue = "\n\n" if note != "html" or rng.random() < 0.6 else "\n"
    return glue.join(f"\x00{k}\x00{b}" for b, k in out)


WEIGHTS = os.path.join(os.path.dirname(__file__), "markup_labeller.npz")


@lru_cache(maxsize=1)
def labeller() -> Labeller:
    """The labeller as :func:`trained` fits it, from the file in which its weights are kept; fitted anew
    where the file is missing or of another shape."""
    if os.path.exists(WEIGHTS):
        kept, net = np.load(WEIGHTS), Labeller()
        if all(k in kept and kept[k].shape == v.shape for k, v in net.p.items()):
            net.p = {k: kept[k].astype(np.float32) for k in net.p}
            return net
    return trained()


def made_up_leaves(rng: random.Random, many: int) -> list[tuple[list[Leaf], list[int]]]:
    """Leaves of made-up documents with their kinds."""
    docs: list[tuple[list[Leaf], list[int]]] = []
    while len(docs) < many:
        marked = _made_up(rng)
        parts = re.split(r"\x00(\w+)\x00", marked)[1:]
        text = re.sub(r"\x00\w+\x00", "", marked)
        spans, at = [], 0
        for kind, body in zip(parts[::2], parts[1::2], strict=True):
            spans.append((at, at + len(body), KINDS.index(kind)))
            at += len(body)
        found = leaves(text)
        place, kinds = 0, []
        for leaf in found:
            start = text.find(leaf.text[:40].strip(), place)
            start = max(start, place)
            kinds.append(next((k for a, b, k in spans if a <= start < b), KINDS.index("paragraph")))
            place = start + 1
        if found:
            docs.append((found, kinds))
    return docs


def trained(many: int = 8_000, epochs: int = 8) -> Labeller:
    """Fit the labeller on made-up documents; the same in every process."""
    docs = sorted(made_up_leaves(random.Random(31), many), key=lambda d: len(d[0]))
    net, past = Labeller(), {}
    order = np.random.default_rng(3)
    for epoch in range(epochs):
        batches = [docs[i : i + 32] for i in range(0, len(docs), 32)]
        for b in order.permutation(len(batches)):
            x, mask = batch_of([d for d, _ in batches[b]])
            y = np.zeros(mask.shape, dtype=np.int64)
            for i, (_, k) in enumerate(batches[b]):
                y[i, : len(k)] = k
            net.step(x, mask, y, past, 0.1 if epoch < epochs - 3 else 0.03)
    return net


# ---- clean text ---------------------------------------------------------------------------------------


def _inline(text: str) -> str:
    t = re.sub(r"<!--.*?-->|<ref\b[^<>]*/>|<ref\b.*?</ref>|<(script|style)\b.*?</\1>", "", text, flags=re.DOTALL | re.IGNORECASE)
    t = re.sub(r"</?[a-zA-Z][^<>]*>", "", re.sub(r"<br\s*/?>", "\n", t, flags=re.IGNORECASE))
    t = re.sub(r"!\[([^\]]*)\]\([^()]*\)", r"\1", t)
    t = re.sub(r"\[([^\]\[]*)\]\([^()]*\)", r"\1", t)
    t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", t)
    t = re.sub(r"\[https?://\S+ ([^\]]*)\]", r"\1", t)
    t = re.sub(r"\{\{(?:[^{}|]*\|)*([^{}|]*)\}\}", r"\1", t)
    t = re.sub(r"\\(?:footnote|cite|label|ref)\{[^{}]*\}", "", t)
    t = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\(?:emph|textbf|textit|underline|texttt|url)\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"'''?|\*\*\*|\*\*|~~|(?<!\w)__|__(?!\w)|(?<!\w)_(?=\S)|(?<=\S)_(?!\w)|`", "", t)
    return html.unescape(t).replace(" ", " ").replace("~", " ").strip()


def clean(leaf: Leaf, kind: str) -> str:
    """A leaf without its markup, with what tells its kind: ``# `` before headings, ``- `` before
    items, fences around code, ``$$`` around formulas, pipes between cells."""
    text = leaf.text
    if kind == "none":
        return ""
    if kind == "code":
        body = re.sub(r"^\s*(?:```|~~~).*\n|\n\s*(?:```|~~~)+\s*$", "", text)
        body = re.sub(r"</?(?:pre|code|source|syntaxhighlight|nowiki)\b[^<>]*>|\\(?:begin|end)\{(?:verbatim|lstlisting|minted)\}", "", body, flags=re.IGNORECASE)
        return "```\n" + (html.unescape(body) if leaf.path.startswith("tag:pre") else body).strip("\n") + "\n```"
    if kind == "formula":
        body = re.sub(r"</?[a-zA-Z][^<>]*>|\$\$|\\\[|\\\]|\\(?:begin|end)\{(?:equation|align|gather|displaymath)\*?\}", "", text)
        return f"$$ {html.unescape(body).strip()} $$"
    if kind == "table":
        if "<t" in text.lower():
            rows = [re.findall(r"<t[dh]\b[^<>]*>(.*?)(?=</?t[dhr]\b|</table|$)", r, re.DOTALL | re.IGNORECASE) for r in re.split(r"<tr\b[^<>]*>", text, flags=re.IGNORECASE)[1:]]
        elif "tabular" in text:
            rows = [r.split("&") for r in re.sub(r"\\(?:begin|end)\{tabular\}(?:\{[^{}]*\})?|\\hline", "", text).split("\\\\") if r.strip()]
        elif text.lstrip().startswith("{|"):
            rows = [re.split(r"!!|\|\|", r.lstrip("|! ")) for r in text.split("\n")[1:] if r.strip() and not r.startswith(("|-", "|}"))]
        else:
            rows = [r.strip().strip("|").split("|") for r in text.split("\n") if r.strip() and not re.match(r"^[\s|:-]+$", r)]
        return "\n".join("| " + " | ".join(_inline(c) for c in r) + " |" for r in rows if r)
    if kind == "list":
        if "<li" in text.lower():
            items = re.split(r"<li\b[^<>]*>", text, flags=re.IGNORECASE)[1:]
        elif "\\item" in text:
            items = re.split(r"\\item\b", re.sub(r"\\(?:begin|end)\{[^{}]*\}", "", text))[1:]
        else:
            items = [re.sub(r"^\s*(?:[-+*•]|\d{1,3}[.)]|[*#:;]{1,5})\s*", "", x) for x in text.split("\n") if x.strip()]
        return "\n".join("- " + " ".join(_inline(x).split()) for x in items if _inline(x))
    body = re.sub(r"^\s*#{1,6}\s+|^\s*=+\s*(?=\S)|\s*=+\s*$|^h[1-6]\.\s+|\n\s*(?:={3,}|-{3,})\s*$", "", text) if kind == "heading" else text
    body = re.sub(r"\\(?:sub)*(?:section|paragraph|chapter)\*?\{(.*)\}\s*$", r"\1", body.strip()) if kind == "heading" else body
    body = " ".join(_inline(body).split())
    return f"# {body}" if kind == "heading" and body else body


def blocks(docs: list[str], net: Labeller) -> list[list[tuple[str, str]]]:
    """``(kind, clean text)`` of the blocks of each text."""
    read = [leaves(_decoded(t)) for t in docs]
    out = []
    for found, kinds in zip(read, net.label(read), strict=True):
        rows = []
        for leaf, k in zip(found, kinds, strict=True):
            text = clean(leaf, KINDS[k])
            if KINDS[k] != "none" and text.strip("#-`$| \n"):
                rows.append((KINDS[k], text))
        out.append(rows)
    return out


def _decoded(text: str) -> str:
    """HTML that was escaped as a whole (tags as entities) is unescaped once."""
    if re.search(r"&lt;/?(?:p|h[1-6]|div|ul|ol|table|pre)\b", text, re.IGNORECASE) and not re.search(r"<(?:p|h[1-6]|div|ul|ol|table|pre)\b", text, re.IGNORECASE):
        return html.unescape(text)
    return text


def labelled_blocks(df: DataFrame, key_col: str, text_col: str, only_markup: bool = True) -> DataFrame:
    """``(key, block_no int, kind, text)``: the blocks of each text, from 1 in reading order.

    With ``only_markup``, texts without any markup give no rows.  Null keys and texts take no part,
    a text of white space has no blocks, repeated keys count once (the smallest text).
    """
    shared = df.sparkSession.sparkContext.broadcast(labeller())
    rows = pick(df, key=key_col, text=text_col).where("key is not null and text is not null")
    if only_markup:
        rows = rows.where(F.col("text").rlike(HOLDS_MARKUP))
    rows = spread(rows, "key").groupBy("key").agg(F.min("text").alias("text"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                at, number, kinds, texts = [], [], [], []
                for i, found in enumerate(blocks(part.column(1).to_pylist(), shared.value)):
                    for n, (k, t) in enumerate(found, 1):
                        at.append(i)
                        number.append(n)
                        kinds.append(k)
                        texts.append(t)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, type=pa.int64())), pa.array(number, type=pa.int32()), pa.array(kinds, type=pa.string()), pa.array(texts, type=pa.string())], names=["key", "block_no", "kind", "text"])

    return rows.mapInArrow(run, f"key {kind}, block_no int, kind string, text string")


def clean_text(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """``(key, text)``: each text as its clean blocks, a blank line between them; texts without
    markup keep their paragraphs.  Null, empty and repeated rows as in :func:`labelled_blocks`."""
    found = labelled_blocks(df, key_col, text_col, only_markup=False)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n\n")
    return found.groupBy("key").agg(text.alias("text"))
