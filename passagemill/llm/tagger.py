"""A linear-chain conditional random field over sequences of feature sets: the likelihood of the
whole label sequence is maximised by Adagrad over small batches (forward-backward), labels are
decoded by Viterbi.  All in numpy, many sequences at once, for models trained where they run.

An item is a list of feature strings, or a key that ``expand`` turns into one; scores of keys are
remembered, so that equal items are scored once."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

import numpy as np

REMEMBERED = 400_000  #: keys whose scores are kept in memory; beyond it the memory is emptied
BATCH = 512  #: sequences decoded together


class Chain:
    """Labels for sequences whose items are lists of feature strings."""

    def __init__(self, labels: list[str], expand: Callable | None = None):
        self.labels, self.expand = labels, expand
        self.known: dict = {}
        self.table = np.zeros((0, len(labels)))
        self.number: dict[str, int] = {}
        self.weights = np.zeros((1, len(labels)))  # row 0: features never seen
        self.moves = np.zeros((len(labels), len(labels)))
        self.first = np.zeros(len(labels))

    def _score(self, features: Sequence[str]) -> np.ndarray:
        get = self.number.get
        return self.weights[[get(f, 0) for f in features]].sum(axis=0)

    def scores(self, items: Sequence) -> np.ndarray:
        """A row of scores for each item."""
        if self.expand is None:
            return np.array([self._score(x) for x in items]).reshape(-1, len(self.labels))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, at = self.known, []
        for key in items:
            row = known.get(key)
            if row is None:
                row = known[key] = len(known)
                if row >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros((len(self.table) + 1_000, len(self.labels)))])
                self.table[row] = self._score(self.expand(key))
            at.append(row)
        return self.table[at]

    def decode_many(self, sequences: list) -> list[list[str]]:
        """The best labels of every sequence (Viterbi), those of like length side by side."""
        out: list[list[str]] = [[] for _ in sequences]
        order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
        for lo in range(0, len(order), BATCH):
            group = order[lo : lo + BATCH]
            sizes = np.array([len(sequences[i]) for i in group])
            n, last = int(sizes.max()), len(self.labels)
            emit = np.zeros((len(group), n, last))
            emit[np.arange(n) < sizes[:, None]] = self.scores([x for i in group for x in sequences[i]])
            emit = emit.transpose(1, 0, 2)
            score, back = emit[0] + self.first, np.zeros((n, len(group), last), dtype=np.int8)
            for t in range(1, n):
                via = score[:, :, None] + self.moves
                back[t] = via.argmax(axis=1)
                score = np.where((t < sizes)[:, None], via.max(axis=1) + emit[t], score)
            at, path = score.argmax(axis=1), np.zeros((n, len(group)), dtype=np.int64)
            for t in range(n - 1, -1, -1):
                path[t] = at
                if t:
                    at = np.where(t < sizes, back[t][np.arange(len(group)), at], at)
            for col, i in enumerate(group):
                out[i] = [self.labels[x] for x in path[: sizes[col], col]]
        return out

    def decode(self, items: list) -> list[str]:
        return self.decode_many([items])[0]

    def train(self, examples: list[tuple[list, list[str]]], epochs: int = 8, seed: int = 1, rate: float = 0.3, batch: int = 48, ridge: float = 1e-6) -> Chain:
        """Fit on ``(items, labels)`` pairs."""
        expand = self.expand or (lambda x: x)
        label = {x: i for i, x in enumerate(self.labels)}
        rows: dict = {}
        coded = []
        for items, labels in examples:
            if items:
                lists = []
                for x in items:
                    key = tuple(x) if isinstance(x, list) else x
                    if key not in rows:
                        rows[key] = [self.number.setdefault(f, len(self.number) + 1) for f in expand(x)]
                    lists.append(rows[key])
                coded.append((lists, np.array([label[y] for y in labels])))
        k, n = len(self.labels), len(self.number) + 1
        wide = max((len(r) for r in rows.values()), default=1)
        w, m, s = np.zeros((n, k)), np.zeros((k, k)), np.zeros(k)
        gw, gm, gs = np.full((n, k), 1e-2), np.full((k, k), 1e-2), np.full(k, 1e-2)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            shuffled = rng.permutation(len(coded))
            for lo in range(0, len(shuffled), batch):
                group = sorted((coded[i] for i in shuffled[lo : lo + batch]), key=lambda x: len(x[0]))
                sizes = np.array([len(y) for _, y in group])
                t, b = int(sizes.max()), len(group)
                index, gold = np.zeros((t, b, wide), dtype=np.int64), np.zeros((t, b), dtype=np.int64)
                for col, (lists, y) in enumerate(group):
                    gold[: len(y), col] = y
                    for at, r in enumerate(lists):
                        index[at, col, : len(r)] = r
                live = np.arange(t)[:, None] < sizes
                emit = w[index].sum(axis=2)
                single, pairs = _marginals(emit, m, s, sizes)
                hot = np.eye(k)[gold]
                grad = np.where(live[:, :, None], single - hot, 0.0)
                both = live[1:]
                gold_pairs = np.zeros((k, k))
                np.add.at(gold_pairs, (gold[:-1][both], gold[1:][both]), 1.0)
                used = index[live].ravel()
                flat = np.repeat(grad[live], wide, axis=0)
                dw = np.stack([np.bincount(used, flat[:, j], minlength=n) for j in range(k)], axis=1) / b + ridge * w
                dw[0] = 0
                dm, ds = (pairs - gold_pairs) / b, grad[0].sum(axis=0) / b
                for x, d, g in ((w, dw, gw), (m, dm, gm), (s, ds, gs)):
                    g += d * d
                    x -= rate * d / np.sqrt(g)
        self.weights, self.moves, self.first = w, m, s
        self.known.clear()
        return self


    def keep(self, path: str) -> None:
        """Write the fitted weights to a file."""
        names = sorted(self.number, key=self.number.__getitem__)
        np.savez_compressed(path, names=np.frombuffer("\0".join(names).encode(), dtype=np.uint8), weights=self.weights.astype(np.float32), moves=self.moves, first=self.first)

    @classmethod
    def kept(cls, path: str, labels: list[str], expand: Callable | None = None) -> Chain | None:
        """The model of a file; None if there is none, or one with other labels."""
        if not os.path.exists(path):
            return None
        found, model = np.load(path), cls(labels, expand)
        if found["first"].shape != (len(labels),):
            return None
        model.number = {name: i for i, name in enumerate(found["names"].tobytes().decode().split("\0"), 1)}
        model.weights, model.moves, model.first = found["weights"].astype(np.float64), found["moves"], found["first"]
        return model


def _marginals(emit: np.ndarray, moves: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each label at each place, and the expected number of each move, of padded
    sequences (place, sequence, label)."""
    t, b, k = emit.shape
    step = np.exp(moves)
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    ahead, behind = np.zeros((t, b, k)), np.ones((t, b, k))
    ahead[0] = e[0] * np.exp(first)
    ahead[0] /= ahead[0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        x = (ahead[i - 1] @ step) * e[i]
        ahead[i] = x / x.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        x = (e[i + 1] * behind[i + 1]) @ step.T
        x /= x.sum(axis=1, keepdims=True)
        behind[i] = np.where((i + 1 < sizes)[:, None], x, 1.0)
    single = ahead * behind
    single /= single.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(1, t):
        p = ahead[i - 1][:, :, None] * step * (e[i] * behind[i])[:, None, :]
        p /= p.sum(axis=(1, 2), keepdims=True)
        pairs += p[i < sizes].sum(axis=0)
    return single, pairs
