"""Linear-chain conditional random field over sequences of active feature numbers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

Items = Sequence[Sequence[int]]
"""The active features of each item of a sequence."""


@dataclass
class Crf:
    """Scores: weights[feature][label], moves[from][to], and moves from and to the outside of a sequence."""

    weights: list[list[float]]
    moves: list[list[float]]
    first: list[float]
    last: list[float]

    def scores(self, features: Sequence[int]) -> list[float]:
        rows = [self.weights[f] for f in features]
        return [sum(column) for column in zip(*rows, strict=True)] if rows else [0.0] * len(self.first)

    def viterbi(self, items: Items, first: Sequence[float] | None = None, last: Sequence[float] | None = None) -> list[int]:
        """The best labels; ties go to the smaller label."""
        if not items:
            return []
        labels = range(len(self.first))
        score = [a + b for a, b in zip(first or self.first, self.scores(items[0]), strict=True)]
        back = []
        for features in items[1:]:
            here, own, came = [], self.scores(features), []
            for y in labels:
                best = max(labels, key=lambda x, y=y: score[x] + self.moves[x][y])
                came.append(best)
                here.append(score[best] + self.moves[best][y] + own[y])
            score = here
            back.append(came)
        y = max(labels, key=lambda x: score[x] + (last or self.last)[x])
        path = [y]
        for came in reversed(back):
            path.append(y := came[y])
        return path[::-1]

    def lead(self, features: Sequence[int], label: int) -> float:
        """By how much an item's own score favours the label over any other."""
        own = self.scores(features)
        return own[label] - max(s for y, s in enumerate(own) if y != label)

    def most_moves(self, label: int) -> float:
        """What another label can gain at most over this one from the two moves around an item."""
        others = [z for z in range(len(self.first)) if z != label]
        into = [self.first, *self.moves]
        out = [self.last, *map(list, zip(*self.moves, strict=True))]
        return max(max(row[z] - row[label] for row in into) + max(row[z] - row[label] for row in out) for z in others)


def viterbi_many(scores: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Best labels of sequences of one length at once: scores[sequence, item, label], first and last[sequence, label];
    ties go to the smaller label."""
    score, back = first + scores[:, 0], []
    for t in range(1, scores.shape[1]):
        through = score[:, :, None] + moves
        back.append(through.argmax(axis=1))
        score = through.max(axis=1) + scores[:, t]
    path = [(score + last).argmax(axis=1)]
    for came in reversed(back):
        path.append(np.take_along_axis(came, path[-1][:, None], axis=1)[:, 0])
    return np.stack(path[::-1], axis=1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(sequences: Sequence[Items], labels: Sequence[Sequence[int]], n_features: int, n_labels: int,
        epochs: int = 60, rate: float = 0.1, ridge: float = 1e-4) -> Crf:
    """Maximum likelihood by forward-backward and Adam, over all sequences at once, grouped by length."""
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(sequences):
        if len(s):
            groups.setdefault(len(s), []).append(i)
    batches = []
    for n, members in sorted(groups.items()):
        width = max(len(f) for i in members for f in sequences[i])
        active = np.full((len(members), n, width), n_features)      # one spare feature pads
        for r, i in enumerate(members):
            for t, f in enumerate(sequences[i]):
                active[r, t, : len(f)] = f
        batches.append((active, np.array([labels[i] for i in members])))
    values = [np.zeros((n_features + 1, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels), np.zeros(n_labels)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    total = max(1, sum(y.size for _, y in batches))
    one = np.eye(n_labels)
    for step in range(1, epochs + 1):
        grads = [ridge * v for v in values]
        weights, moves, first, last = values
        for active, y in batches:
            own = weights[active].sum(axis=2)
            n = own.shape[1]
            ahead, behind = [own[:, 0] + first], [np.zeros_like(own[:, 0]) + last]
            for t in range(1, n):
                ahead.append(_log_sum(ahead[-1][:, :, None] + moves, 1) + own[:, t])
                behind.append(_log_sum(moves + (own[:, n - t] + behind[-1])[:, None, :], 2))
            behind.reverse()
            whole = _log_sum(ahead[-1] + last, 1)
            off = np.exp(np.stack(ahead, 1) + np.stack(behind, 1) - whole[:, None, None]) - one[y]
            for w in range(active.shape[2]):
                np.add.at(grads[0], active[:, :, w], off / total)
            grads[2] += off[:, 0].sum(0) / total
            grads[3] += off[:, -1].sum(0) / total
            for t in range(1, n):
                both = ahead[t - 1][:, :, None] + moves + (own[:, t] + behind[t])[:, None, :] - whole[:, None, None]
                grads[1] += (np.exp(both).sum(0) - np.einsum("ra,rb->ab", one[y[:, t - 1]], one[y[:, t]])) / total
        grads[0][-1] = 0
        for value, grad, (m, v) in zip(values, grads, moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return Crf(values[0][:-1].tolist(), *[v.tolist() for v in values[1:]])
