"""Linear-chain conditional random fields over ragged batches of chains, in NumPy.

The model is small and fixed in size (a hashed weight table and a transition matrix), so it is
fitted on a bounded sample and broadcast; scoring is a map over all rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

#: Words in a chain at most; longer sentences are cut, so that a batch takes a bounded number of steps.
LONGEST = 128


@dataclass
class Features:
    """`single`: one feature per word for each array; `many`: one per letter, `counts` letters per word."""
    single: list[np.ndarray]
    many: np.ndarray | None = None
    counts: np.ndarray | None = None

    @property
    def n(self) -> int:
        return len(self.single[0])


@dataclass
class Crf:
    weights: np.ndarray
    transitions: np.ndarray
    extra: dict = field(default_factory=dict)

    @classmethod
    def blank(cls, bits: int, states: int) -> "Crf":
        return cls(np.zeros((1 << bits, states), np.float32), np.zeros((states, states), np.float32))

    def emissions(self, f: Features) -> np.ndarray:
        out = self.weights[f.single[0]].copy()
        for idx in f.single[1:]:
            out += self.weights[idx]
        if f.many is not None and f.n:
            first = np.cumsum(f.counts) - f.counts
            out += np.add.reduceat(self.weights[f.many], first, axis=0) / np.sqrt(f.counts)[:, None].astype(np.float32)
        return out

    def marginals(self, f: Features, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        return forward_backward(self.emissions(f), first, size, self.transitions)[0]


def forward_backward(emissions, first, size, transitions, pairs: bool = False):
    """`(marginals, expected transitions)`: posterior of each state at each word.

    Chains are worked longest first, all at once, one step per position. Both passes are
    normalised at each step, so a chain of any length neither overflows nor vanishes.
    """
    n, k = emissions.shape
    expected = np.zeros((k, k))
    if not n:
        return np.zeros((0, k), np.float32), expected
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    order = np.argsort(-size, kind="stable")
    at, left = first[order], size[order]
    active = np.searchsorted(-left, -np.arange(1, left[0] + 1), side="right")  # chains with a word at each step
    alpha = np.empty_like(e)
    f = e[at] / e[at].sum(axis=1, keepdims=True)
    alpha[at] = f
    for t in range(1, left[0]):
        rows = at[:active[t]] + t
        f = (f[:active[t]] @ move) * e[rows]
        f /= f.sum(axis=1, keepdims=True)
        alpha[rows] = f
    beta = np.ones_like(e)
    for t in range(left[0] - 1, 0, -1):
        rows = at[:active[t]] + t
        later = e[rows] * beta[rows]
        if pairs:
            joint = alpha[rows - 1][:, :, None] * move[None] * later[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = later @ move.T
        beta[rows - 1] = b / b.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    return gamma / gamma.sum(axis=1, keepdims=True), expected


def fit(parts: Iterable[tuple[Features, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], bits: int, states: int,
        epochs: int = 5, rate: float = 0.5, decay: float = 1e-6) -> Crf:
    """Maximum conditional likelihood by AdaGrad; `parts`: minibatches `(features, first, size, labels, importance)`,
    gone through once an epoch, so they may be made as they are asked for.

    Labels are states per word, and `importance` weighs each word's term in the gradient.
    """
    model = Crf.blank(bits, states)
    seen_w, seen_t = np.full_like(model.weights, 1e-2), np.full_like(model.transitions, 1e-2)
    eye = np.eye(states, dtype=np.float32)
    for _ in range(epochs):
        for f, first, size, labels, importance in parts:
            if not f.n:
                continue
            gamma, expected = forward_backward(model.emissions(f), first, size, model.transitions, pairs=True)
            slope = ((eye[labels] - gamma) * importance[:, None]).astype(np.float64)
            idx = np.concatenate([*f.single] if f.many is None else [*f.single, f.many])
            grad = np.empty_like(model.weights, dtype=np.float64)
            for s in range(states):  # one state at a time: each letter has a value for every state
                values = [np.tile(slope[:, s], len(f.single))]
                if f.many is not None:
                    values.append(np.repeat(slope[:, s] / np.sqrt(f.counts), f.counts))
                grad[:, s] = np.bincount(idx, weights=np.concatenate(values), minlength=1 << bits)
            grad = (grad / f.n * 100).astype(np.float32) - decay * model.weights
            seen_w += grad * grad
            model.weights += rate * grad / np.sqrt(seen_w)
            inside = np.ones(f.n, dtype=bool)
            inside[first] = False
            to = np.flatnonzero(inside)
            counted = np.bincount(labels[to - 1].astype(np.int64) * states + labels[to], minlength=states * states).reshape(states, states)
            move = ((counted - expected) / f.n * 100).astype(np.float32)
            seen_t += move * move
            model.transitions += 0.2 * rate * move / np.sqrt(seen_t)
    return model
