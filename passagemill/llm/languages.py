"""Languages of documents and of the stretches of mixed ones.

A text is cut into sentences.  A sentence is the average of hashed embeddings of its words and of
their character n-grams; a linear softmax turns it into probabilities.  Embeddings and softmax are
trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows.
A temperature fitted on held-out sentences calibrates the confidence.  A stretch below the rejection
limit, or with too little running text in it (names, codes, numbers, single foreign words), takes
the language of what is around it and never makes a segment of its own.  Neighbouring sentences in
one language are weighed together, however short each of them is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm.common import pick

LANGUAGES = ("de", "en", "es", "fr", "ru", "uk")
TRAIN_ROWS = 4_000  #: labelled rows the classifier is fitted on, at most
FIRST_SENTENCES = 4_000  #: sentences of the first fit, about, which only sorts out wrong labels
BUCKETS = 1 << 15
DIMENSIONS = 16
REJECT = 0.6  #: a stretch whose calibrated confidence is lower is undecided
LEAST_TEXT = 4  #: plain words a stretch must have to be running text,
CODE_COST = 3  #: beyond this many for each code, number or capital in it,
ENOUGH = 7  #: words of a stretch from which its confidence counts in full
LONG = 10  #: up to this many: so many words are running text whatever else stands between them

# Names of the languages as labels give them, in lower case.
NAMES = {
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "немецкий", "німецька"],
    "en": ["en", "eng", "english", "englisch", "anglais", "inglés", "английский", "англійська"],
    "es": ["es", "spa", "spanish", "spanisch", "espagnol", "español", "espanol", "castellano", "испанский", "іспанська"],
    "fr": ["fr", "fra", "fre", "french", "französisch", "français", "francais", "francés", "французский", "французька"],
    "ru": ["ru", "rus", "russian", "russisch", "russe", "ruso", "русский", "російська"],
    "uk": ["uk", "ukr", "ukrainian", "ukrainisch", "ukrainien", "ucraniano", "украинский", "українська"],
}
_BY_NAME = {name: lang for lang, names in NAMES.items() for name in names}

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|\n\s*\n\s*|\n(?=\s*(?:[-*+#|<]|\d+[.)] ))|\s+[/|—–]\s+|(?<=</p>)|(?<=</li>)|(?<=</td>)")
_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"\W*[^\W\d_]+(?:[-'’][^\W\d_]+)*\W*")
_TAG = re.compile(r"<[^<>]{1,200}>|https?://\S+|&\w+;|\\[a-z]+")


def label_language(label: str | None) -> str | None:
    """The language a label names: a code of two or three letters, with or without a region, or a
    name in one of several languages; None if it names none of :data:`LANGUAGES`."""
    if label is None:
        return None
    text = label.strip().lower()
    return _BY_NAME.get(text) or _BY_NAME.get(re.split(r"[-_ .(]", text, maxsplit=1)[0])


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each stretch between sentence ends, blank lines, lines that begin like list items, and spaced dashes or slashes."""
    out, lo = [], 0
    for m in _SENTENCE.finditer(text):
        if m.start() > lo and text[lo : m.start()].strip():
            out.append((lo, m.start()))
        lo = m.end()
    if text[lo:].strip():
        out.append((lo, len(text)))
    return out


def make_up(text: str) -> tuple[int, int]:
    """How many plain words a stretch has, and how many other tokens: with digits or signs in them, or in capitals."""
    plain = other = 0
    for t in text.split():
        if any(c.isalnum() for c in t):
            if _PLAIN.fullmatch(t) and not (t.isupper() and len(t) > 1):
                plain += 1
            else:
                other += 1
        elif t not in "-–—.,;:!?…":
            other += 1
    return plain, other


def running(text: str, words: int) -> int:
    """How much running text a stretch is: its plain words less what its codes cost, :data:`LONG` for
    any with as many words."""
    plain, other = make_up(text)
    return LONG if words >= LONG else plain - CODE_COST * other


class Hasher:
    """Bucket numbers of words: the word itself, and its n-grams of 2 to 4 characters with borders."""

    def __init__(self) -> None:
        self.known: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        got = self.known.get(w)
        if got is None:
            x = f"<{w}>"
            grams = {x, *(x[i : i + n] for n in (2, 3, 4) for i in range(len(x) - n + 1))}
            got = np.array(sorted({xxhash.xxh3_64_intdigest(g) % BUCKETS for g in grams}), dtype=np.int32)
            if len(self.known) < 50_000:
                self.known[w] = got
        return got

    def __call__(self, text: str) -> list[np.ndarray]:
        return [self.word(w) for w in _LETTERS.findall(_TAG.sub(" ", text).lower())]


@dataclass
class Model:
    """Word scores are additive: a word's row is its averaged n-gram embedding times the softmax
    weights, so that a sentence is the mean of its words' rows plus the bias."""

    table: np.ndarray  # BUCKETS x languages: embedding times weights
    bias: np.ndarray
    temperature: float = 1.0

    def word_rows(self, hasher: Hasher, cache: dict[str, np.ndarray], text: str) -> list[np.ndarray]:
        rows = []
        for w in _LETTERS.findall(_TAG.sub(" ", text).lower()):
            row = cache.get(w)
            if row is None:
                row = self.table[hasher.word(w)].mean(axis=0)
                if len(cache) < 200_000:
                    cache[w] = row
            rows.append(row)
        return rows

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        """Languages' probabilities for a sentence with these words; even ones for none."""
        if not rows:
            return np.full(len(self.bias), 1.0 / len(self.bias))
        z = (np.mean(rows, axis=0) + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def held_back(p: float, words: int, enough: int, languages: int = len(LANGUAGES)) -> float:
    """A probability drawn to even ones where there are fewer than ``enough`` words."""
    few = min(1.0, words / enough)
    return few * p + (1 - few) / languages


def train(examples: list[tuple[str, int]], epochs: int | None = None, rate: float = 0.1, seed: int = 5) -> Model:
    """Fit embeddings and softmax on ``(sentence, language number)`` by SGD in small batches; the
    temperature on every tenth example, which is held out."""
    rng, hasher = np.random.default_rng(seed), Hasher()
    n_langs = len(LANGUAGES)
    bags = []
    for text, y in examples:
        words = hasher(text)
        if len(words) >= 3:
            ids = np.concatenate(words)
            weight = np.concatenate([np.full(len(w), 1.0 / (len(w) * len(words)), dtype=np.float32) for w in words])
            bags.append((ids, weight, y))
    embed = (rng.standard_normal((BUCKETS, DIMENSIONS)) * 0.1).astype(np.float32)
    soft = np.zeros((DIMENSIONS, n_langs), dtype=np.float32)
    bias = np.zeros(n_langs, dtype=np.float32)
    past_embed, past_soft = np.full(BUCKETS, 1e-6, dtype=np.float32), np.full_like(soft, 1e-6)
    held, fitted = bags[::10], [b for i, b in enumerate(bags) if i % 10]
    if not fitted:
        fitted = held
    share = np.bincount([b[2] for b in fitted], minlength=n_langs) / max(1, len(fitted))
    heft = np.where(share > 0, 1 / np.sqrt(n_langs * np.maximum(share, 1e-3)), 0).astype(np.float32)  # rare languages weigh more
    for _ in range(epochs or min(6, max(3, 40_000 // max(1, len(fitted))))):
        order = rng.permutation(len(fitted))
        for lo in range(0, len(order), 32):
            batch = [fitted[i] for i in order[lo : lo + 32]]
            owner = np.repeat(np.arange(len(batch)), [len(b[0]) for b in batch])
            ids, weight = np.concatenate([b[0] for b in batch]), np.concatenate([b[1] for b in batch])
            hidden = np.zeros((len(batch), DIMENSIONS), dtype=np.float32)
            np.add.at(hidden, owner, embed[ids] * weight[:, None])
            z = hidden @ soft + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            p = z / z.sum(axis=1, keepdims=True)
            y = np.array([b[2] for b in batch])
            target = np.full_like(p, 0.05 / n_langs)  # labels are partly wrong
            target[np.arange(len(y)), y] += 0.95
            grad = (p - target) * heft[y][:, None] / len(batch)
            step = (grad @ soft.T)[owner] * weight[:, None]
            g_soft = hidden.T @ grad
            past_soft += g_soft**2
            soft -= rate * g_soft / np.sqrt(past_soft)
            bias -= 0.1 * rate * grad.sum(axis=0)
            np.add.at(past_embed, ids, (step**2).mean(axis=1))
            np.add.at(embed, ids, -rate * step / np.sqrt(past_embed[ids])[:, None])
    model = Model(embed @ soft, bias)
    scores = [(model.table[ids] * weight[:, None]).sum(axis=0) + bias for ids, weight, _ in held]
    if scores:
        z, y = np.array(scores), np.array([b[2] for b in held])
        right = z.argmax(axis=1) == y  # calibrated on held-out sentences whose label the model shares or not

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean())

        model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss) if right.any() else 1.0
    return model


def fit(texts: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = TRAIN_ROWS) -> Model:
    """Train on at most about ``rows`` labelled rows, twice: the second time without the sentences
    on which the first model and the label differ, since part of the labels is wrong."""
    given = pick(labels, id=id_col, label=label_col).where("id is not null and label is not null")
    share = min(1.0, rows / max(1, given.count()))
    chosen = given.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) < int(share * 1_000_000)).dropDuplicates(["id"])
    got = pick(texts, id=id_col, text=text_col).where("text is not null").join(F.broadcast(chosen), "id").select("id", "text", "label").dropDuplicates(["id"]).toArrow()
    table = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2).to_pylist(), strict=True))
    labelled = [([text[a:b] for a, b in sentences(text)], LANGUAGES.index(lang)) for _, text, label in table if (lang := label_language(label)) is not None]
    return fit_on(labelled)


def fit_on(labelled: list[tuple[list[str], int]]) -> Model:
    """Two fits on the sentences of labelled texts."""
    examples = [(t, y) for texts, y in labelled for t in texts[:6]]
    first = train(examples[:: max(1, len(examples) // FIRST_SENTENCES)])
    hasher, cache = Hasher(), {}
    agreed = [(t, y) for t, y in examples if first.probabilities(first.word_rows(hasher, cache, t)).argmax() == y]
    return train(agreed)


@dataclass
class Segment:
    start: int
    end: int
    language: int
    confidence: float


def segments(model: Model, hasher: Hasher, cache: dict, text: str, reject: float = REJECT) -> list[Segment]:
    """Longest runs of sentences in one language; undecided sentences join their neighbours."""
    spans = sentences(text)
    if not spans:
        return []
    probs, sizes = [], []
    for a, b in spans:
        rows = model.word_rows(hasher, cache, text[a:b])
        probs.append(model.probabilities(rows))
        sizes.append(len(rows))
    best = [int(p.argmax()) for p in probs]
    total = sum(p * n for p, n in zip(probs, sizes, strict=True)) if any(sizes) else probs[0]
    # Neighbours in one language are weighed together, over those without any word between them.
    stretches: list[list[int]] = []
    for i in range(len(spans)):
        if sizes[i] and probs[i].max() >= reject:
            if stretches and best[stretches[-1][-1]] == best[i]:
                stretches[-1].append(i)
            else:
                stretches.append([i])
    sure = [False] * len(spans)
    for at in stretches:
        n = sum(sizes[i] for i in at)
        mean = sum(float(probs[i].max()) * sizes[i] for i in at) / n
        if held_back(mean, n, ENOUGH) >= reject and sum(running(text[slice(*spans[i])], sizes[i]) for i in at) >= LEAST_TEXT:
            for i in at:
                sure[i] = True
    if not any(sure):
        lang = int(np.argmax(total))
        return [Segment(spans[0][0], spans[-1][1], lang, held_back(float(total[lang] / max(1e-9, total.sum())), sum(sizes), 2))]
    lang = best[sure.index(True)]
    found: list[tuple[int, list[int]]] = []
    for i in range(len(spans)):
        if sure[i]:
            lang = best[i]
        if found and found[-1][0] == lang:
            found[-1][1].append(i)
        else:
            found.append((lang, [i]))
    out = []
    for lang, at in found:
        own = [i for i in at if sure[i]]
        conf = sum(probs[i][lang] * sizes[i] for i in own) / sum(sizes[i] for i in own)
        out.append(Segment(spans[at[0]][0], spans[at[-1]][1], lang, float(conf)))
    return out


def detect_languages(df: DataFrame, model: Model, id_col: str = "id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """``(id, segment_no int, lang, confidence double, start int, end int, segments int)``.

    One row per segment, from 1; ``lang`` is null where even the best confidence is below
    ``reject`` (no words, an unknown language).  Null texts give no rows, and neither do texts of
    white space; rows that repeat an id are each labelled, equal rows come out equal.
    """
    kind = dict(pick(df, id=id_col).dtypes)["id"]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, cache, known = Hasher(), {}, shared.value
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                got = segments(known, hasher, cache, text, reject)
                for n, s in enumerate(got, 1):
                    at.append(i)
                    rows.append((n, LANGUAGES[s.language] if s.confidence >= reject else None, s.confidence, s.start, s.end, len(got)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, type=pa.int64())), *(pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True))], names=["id", "segment_no", "lang", "confidence", "start", "end", "segments"])

    rows = pick(df, id=id_col, text=text_col).where("text is not null")
    return rows.mapInArrow(label, f"id {kind}, segment_no int, lang string, confidence double, start int, end int, segments int")


def wrong_labels(df: DataFrame, labels: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``(id, segment_no, lang)`` of every labelled text whose label is null, names no language or
    another one than the text's, and of every labelled text that mixes languages.

    Labels without a text and texts without a label give no rows; of rows that repeat an id the
    smallest text counts.
    """
    spark: SparkSession = df.sparkSession
    model = fit(df, labels, id_col, text_col, label_col)
    given = pick(labels, id=id_col, label=label_col).where("id is not null").dropDuplicates(["id"])
    texts = pick(df, id=id_col, text=text_col).where("text is not null").join(given, "id")
    once = texts.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    names = spark.createDataFrame([(name, lang) for name, lang in _BY_NAME.items()], "name string, named string")
    found = detect_languages(once.select("id", "text"), model, "id", "text").where("lang is not null")
    key = F.lower(F.trim("label"))
    head = F.regexp_extract(key, r"^([^-_ .(]*)", 1)
    exact, short = names.select(F.col("name").alias("n1"), F.col("named").alias("by_name")), names.select(F.col("name").alias("n2"), F.col("named").alias("by_head"))
    named = given.withColumn("n1", key).withColumn("n2", head).join(F.broadcast(exact), "n1", "left").join(F.broadcast(short), "n2", "left").select("id", F.coalesce("by_name", "by_head").alias("named"))
    return found.join(named, "id").where((F.col("segments") > 1) | F.col("named").isNull() | (F.col("named") != F.col("lang"))).select("id", "segment_no", "lang")
