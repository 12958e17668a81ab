"""Passages of held-out items inside a corpus: rare n-grams as seeds, then local alignment.

The items are a small table with a checked size and are broadcast.  The corpus counts of their
n-grams are taken over all documents; of every window of an item the rarest n-gram that occurs at
all is a seed, and so is each one that is about as rare as those (what the copies of the item have
of their own, not phrases that everyone uses).  A run of ``least_run`` equal words holds a whole
window and so a seed: verbatim passages are never missed; an edited copy is missed only if all it
keeps are phrases far more frequent than the item's rare ones.  A pair with a seed in common is
dropped where a bound on its score shows that it cannot come out: no alignment gains more than
MATCH for a word of the document that the item has, and each other word within it costs.  What
remains is aligned by Smith-Waterman over words; the score finds edited copies, and the longest run
of equal words tells verbatim ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import pick
from passagemill.llm.word_sets import words

MAX_ITEM_MB = 64  #: items beyond this are refused: they are meant to be a small held-out set
MATCH, MISMATCH, GAP = 2, -1, -1
ROOM = 32  #: places between texts that are searched together, at least ``n`` and ``least_run``
WORDS_TOGETHER = 200_000  #: words of documents searched in one go


class _Items:
    """The items as word numbers, their n-grams as ranks, and the items that have each.

    An n-gram is ranked step by step, each pair of (rank of the first words, next word) among those
    of the items, so that no number grows with the vocabulary."""

    def __init__(self, rows: list[tuple[object, str]], n: int):
        self.n = n
        self.worth: dict[int, np.ndarray] = {}
        self.keys = [k for k, _ in rows]
        self.number: dict[str, int] = {}
        self.words = [np.array([self.number.setdefault(w, len(self.number)) for w in words(text)], dtype=np.int64) for _, text in rows]
        self.base = max(2, len(self.number))
        self.steps: list[np.ndarray] = []
        rank = self.words
        for j in range(1, n):
            pairs = [r[:-1] * self.base + w[j:] for r, w in zip(rank, self.words, strict=True)]
            self.steps.append(np.unique(np.concatenate([*pairs, np.zeros(0, dtype=np.int64)])))
            rank = [np.searchsorted(self.steps[-1], p) for p in pairs]
        self.grams = rank
        self.many = len(self.steps[-1]) if self.steps else self.base
        # All items one after another, with room between them, and where each begins.
        room = np.full(ROOM, -2, dtype=np.int64)
        self.line = np.concatenate([room, *[x for w in self.words for x in (w, room)]])
        self.begin = np.cumsum([ROOM, *[len(w) + ROOM for w in self.words]])[:-1] if rows else np.zeros(0, dtype=np.int64)
        self.use([(np.arange(len(g)), np.ones(len(g), dtype=bool)) for g in self.grams])

    def use(self, seeds: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Take the n-grams at these places of each item as its seeds; the second array tells rare ones."""
        none = np.zeros(0, dtype=np.int64)
        gram = np.concatenate([*[g[at] for g, (at, _) in zip(self.grams, seeds, strict=True)], none])
        owner = np.repeat(np.arange(len(seeds)), np.array([len(at) for at, _ in seeds], dtype=np.int64))
        order = np.argsort(gram, kind="stable")
        self.owner, self.place = owner[order], np.concatenate([*[at for at, _ in seeds], none])[order]
        self.is_rare = np.concatenate([*[r for _, r in seeds], none.astype(bool)])[order]
        self.first = np.searchsorted(gram[order], np.arange(self.many + 1))

    def pack(self, ids: np.ndarray) -> np.ndarray:
        """The rank of each n-gram of a text; -1 where it is none of the items'."""
        rank = ids
        for j, known in enumerate(self.steps, 1):
            if len(rank) < 2:
                return np.zeros(0, dtype=np.int64)
            first, follow = rank[:-1], ids[j:]
            key = np.where((first < 0) | (follow < 0), -1, first * self.base + follow)
            at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            rank = np.where(known[at] == key, at, -1) if len(known) else np.full(len(key), -1, dtype=np.int64)
        return rank

    def of(self, text: str) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, -1) for w in words(text)], dtype=np.int64)

    def occurrences(self, texts: list[np.ndarray]) -> np.ndarray:
        """How often each n-gram stands in texts given with room between them."""
        ranks = self.pack(np.concatenate([*texts, np.zeros(0, dtype=np.int64)]))
        return np.bincount(ranks[ranks >= 0], minlength=self.many)

    def hits(self, ids: np.ndarray, least_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place in ids, item, run)`` of every seed met in texts that stand one after another with
        room between them.  A seed that is not rare counts only within ``least_run`` equal words;
        ``run`` is how many words round the seed are equal, as far as the room goes."""
        ranks = self.pack(ids)
        at = np.flatnonzero(ranks >= 0)
        first = self.first[ranks[at]]
        each = self.first[ranks[at] + 1] - first
        entry = np.repeat(first, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        place, item = np.repeat(at, each), self.owner[entry]
        run = np.full(len(place), self.n)
        here = self.begin[item] + self.place[entry]
        for step, end in ((1, self.n), (-1, -1)):
            alive = np.arange(len(place))
            for far in range(ROOM):
                a = ids[place[alive] + end + step * far]
                alive = alive[(a == self.line[here[alive] + end + step * far]) & (a >= 0)]
                if not len(alive):
                    break
                run[alive] += 1
        keep = self.is_rare[entry] | (run >= least_run)
        return place[keep], item[keep], run[keep]

    def rare(self, counts: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The seeds of each item: of each window of ``width`` n-grams the rarest that occurs, and all
        that are at most twice as frequent as these are at the median, which are its rare ones."""
        out = []
        for grams in self.grams:
            count = np.where(counts[grams] > 0, counts[grams], np.iinfo(np.int64).max)
            lows = np.unique([lo + int(count[lo : lo + width].argmin()) for lo in range(max(1, len(grams) - width + 1))]) if len(grams) else np.zeros(0, dtype=np.int64)
            lows = lows[counts[grams[lows]] > 0]
            rare = count <= 2 * int(np.median(count[lows])) if len(lows) else np.zeros(len(grams), dtype=bool)
            chosen = np.union1d(lows, np.flatnonzero(rare)).astype(np.int64)
            out.append((chosen, rare[chosen]))
        return out

    def regions(self, item: int, where: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
        """The parts of a text (from ``lo`` to ``hi``) in which an alignment through one of the places
        can lie: what it skips costs, so that it reaches no further than three times the item."""
        reach = 3 * len(self.words[item])
        gaps = np.flatnonzero(np.diff(where) > 2 * reach + self.n)
        return [(max(lo, int(a) - reach), min(hi, int(z) + self.n + reach)) for a, z in zip(where[[0, *(gaps + 1)]], where[[*gaps, len(where) - 1]], strict=True)]

    def stretches(self, item: int, ids: np.ndarray, least: int) -> list[np.ndarray]:
        """The parts of ``ids`` that hold every alignment with the item of a score of ``least``.

        Summing what each word can gain, no alignment ends higher than the sum has risen over its
        lowest so far, and none is better for what comes before a new lowest.
        """
        if item not in self.worth:
            if len(self.worth) >= 1_000:
                self.worth.clear()
            worth = np.full(len(self.number) + 1, max(MISMATCH, GAP), dtype=np.int8)
            worth[self.words[item]] = MATCH
            self.worth[item] = worth  # its last is that of words that no item has
        total = self.worth[item][ids].cumsum(dtype=np.int64)
        lowest = np.minimum.accumulate(np.minimum(total, 0))
        rise = total - lowest
        if not len(rise) or rise.max() < least:
            return []
        high = np.flatnonzero(rise >= least)
        lows = np.flatnonzero(total == lowest)
        edges = np.searchsorted(lows, high)
        first = np.append(-1, lows)[edges] + 1
        ends = np.append(lows, len(ids))
        return [ids[x : ends[e]] for x, e in zip(*np.unique(np.stack([first, edges]), axis=1))]


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Most consecutive equal words of two sequences of word numbers (-1 equals nothing)."""
    best, row = 0, np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        if x < 0:
            row = np.zeros(len(b) + 1, dtype=np.int64)
            continue
        new = np.zeros(len(b) + 1, dtype=np.int64)
        new[1:] = np.where(b == x, row[:-1] + 1, 0)
        best = max(best, int(new.max()))
        row = new
    return best


def align(a: np.ndarray, b: np.ndarray) -> int:
    """The Smith-Waterman score of two sequences of word numbers with linear gaps."""
    best, row = 0, np.zeros(len(b) + 1, dtype=np.int64)
    slope = np.arange(len(b) + 1) * -GAP
    for x in a:
        new = np.zeros(len(b) + 1, dtype=np.int64)
        new[1:] = np.maximum(row[:-1] + np.where((b == x) & (x >= 0), MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + slope) - slope  # gaps along the row
        best = max(best, int(new.max()))
        row = new
    return best


def many(pairs: list[tuple[np.ndarray, np.ndarray]], runs: bool = False) -> np.ndarray:
    """:func:`align` of each pair, or :func:`longest_run`, by diagonals of many pairs at once."""
    out = np.zeros(len(pairs), dtype=np.int64)
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][1]))
    while order:
        group = order[-256:]
        group = group[-max(1, 4_000_000 // max(1, len(pairs[group[-1]][1]))) :]
        del order[-len(group) :]
        m, l = max(len(pairs[i][0]) for i in group), max(len(pairs[i][1]) for i in group)  # noqa: E741
        kind = np.int16 if MATCH * m < 30_000 else np.int32
        a, b = np.full((m, len(group)), -3, dtype=np.int32), np.full((l + 2 * m, len(group)), -2, dtype=np.int32)
        for col, i in enumerate(group):
            a[: len(pairs[i][0]), col] = pairs[i][0]
            b[m + l - len(pairs[i][1]) : m + l, col] = pairs[i][1][::-1]
        old, last, new = (np.zeros((m + 1, len(group)), dtype=kind) for _ in range(3))
        top = np.zeros((m, len(group)), dtype=kind)
        for d in range(l + m - 1):
            same = a == b[m + l - 1 - d : 2 * m + l - 1 - d]
            here = new[1:]
            if runs:
                np.multiply(old[:-1] + kind(1), same, out=here)
            else:
                np.add(old[:-1], np.where(same, kind(MATCH), kind(MISMATCH)), out=here)
                np.maximum(here, np.maximum(last[:-1], last[1:]) + kind(GAP), out=here)
                np.maximum(here, kind(0), out=here)
            np.maximum(top, here, out=top)
            old, last, new = last, new, old
        out[group] = top.max(axis=0, initial=0)
    return out


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 4, least_run: int = 12, least_score: int = 20) -> DataFrame:
    """``(doc_id, item_id, run int, score int)``: documents that hold a passage of an item.

    ``run`` is the longest run of consecutive equal words, ``score`` that of the best local
    alignment; pairs with a seed in common and ``run >= least_run`` or ``score >= least_score``
    come out, once each.  The documents are read twice: to count the items' n-grams and to search
    for the rare ones.  Null ids and texts and texts without words take
    no part, nor do items of fewer than ``n`` words; empty tables give no rows.  Repeated rows count once.
    """
    spark = docs.sparkSession
    given = pick(items, item_id=item_id, text=item_text).where("item_id is not null and text is not null").distinct()
    rows = given.select("item_id", "text").toArrow()
    if max(n, least_run) > ROOM:
        raise ValueError(f"n and least_run are at most {ROOM}")
    if rows.nbytes > MAX_ITEM_MB * 1_000_000:
        raise ValueError(f"the items take {rows.nbytes / 1e6:.0f} MB, more than {MAX_ITEM_MB}")
    kind = dict(given.dtypes)["item_id"]
    id_kind = dict(pick(docs, doc_id=doc_id).dtypes)["doc_id"]
    table = sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
    found_in = _Items(table, n)
    shared = spark.sparkContext.broadcast(found_in)
    corpus = pick(docs, doc_id=doc_id, text=text).where("doc_id is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = shared.value
        total = np.zeros(it.many, dtype=np.int64)
        room, line, size = np.full(ROOM, -1, dtype=np.int64), [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                line += [it.of(t), room]
                size += len(line[-2])
                if size > WORDS_TOGETHER:
                    total += it.occurrences(line)
                    line, size = [], 0
        total += it.occurrences(line)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "c"])

    # A row per n-gram of the items at most: bounded as they are.
    counted = corpus.select("text").mapInArrow(count, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(found_in.many, dtype=np.int64)
    counts[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    found_in.use(found_in.rare(counts, max(1, least_run - n + 1)))
    shared = spark.sparkContext.broadcast(found_in)

    least = max(1, min(least_score, MATCH * least_run))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, room = shared.value, np.full(ROOM, -1, dtype=np.int64)
        for batch in batches:
            line, begin, size, last = [room], [], ROOM, batch.num_rows - 1
            first = 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                begin.append(size)
                line += [it.of(t), room]
                size += len(line[-2]) + ROOM
                if size > WORDS_TOGETHER or i == last:
                    yield judged(it, batch.column(0).slice(first), np.concatenate(line), np.array(begin))
                    line, begin, size, first = [room], [], ROOM, i + 1

    def judged(it: _Items, ids_of: pa.Array, line: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
        place, item, run = it.hits(line, least_run)
        doc = np.searchsorted(begin, place, "right") - 1
        order = np.lexsort((place, item, doc))
        place, item, run, doc = place[order], item[order], run[order], doc[order]
        cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
        ends = np.append(begin[1:], len(line)) - ROOM
        todo: list[tuple[int, int, int]] = []
        parts: list[tuple[int, np.ndarray]] = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
            if hi > lo:
                d, x = int(doc[lo]), int(item[lo])
                found = [y for a, z in it.regions(x, place[lo:hi], int(begin[d]), int(ends[d])) for y in it.stretches(x, line[a:z], least)]
                if found:
                    parts += [(len(todo), y) for y in found]
                    todo.append((d, x, int(run[lo:hi].max())))
        score, longest = np.zeros(len(todo), dtype=np.int64), np.array([r for _, _, r in todo], dtype=np.int64)
        np.maximum.at(score, [x for x, _ in parts], many([(it.words[todo[x][1]], y) for x, y in parts]))
        exact = [(x, y) for x, y in parts if score[x] >= least]
        np.maximum.at(longest, [x for x, _ in exact], many([(it.words[todo[x][1]], y) for x, y in exact], runs=True))
        keep = np.flatnonzero((longest >= least_run) | (score >= least_score))
        picked = ids_of.take(pa.array([todo[x][0] for x in keep], type=pa.int64()))
        named = pa.array([it.keys[todo[x][1]] for x in keep], type=rows.schema.field(0).type)
        return pa.RecordBatch.from_arrays([picked, named, pa.array(longest[keep], type=pa.int32()), pa.array(score[keep], type=pa.int32())], names=["doc_id", "item_id", "run", "score"])

    found = corpus.mapInArrow(search, f"doc_id {id_kind}, item_id {kind}, run int, score int")
    return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("score").alias("score"))
