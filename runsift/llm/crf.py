"""A linear-chain conditional random field over many chains at once, in numpy.

Chains of different lengths are laid out by position: position t of all chains
that are at least t + 1 long is one block, so every step of the recursions is a
few array operations, and the work is the number of elements.
"""

from __future__ import annotations

import numpy as np


class Chains:
    """Order of the elements of ragged chains by position."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        first = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max()) if len(lengths) else 0
        live = np.searchsorted(-lengths[order], -np.arange(longest), side="left")  # chains longer than t
        self.blocks = [first[order[:n]] + t for t, n in enumerate(live)]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class LinearChain:
    """Weights of features per label, of neighbouring labels, and of the first label."""

    def __init__(self, labels: int, features: int, forbidden: list[tuple[int, int]] = (), not_first: list[int] = ()):
        self.weights = np.zeros((features, labels))
        self.steps = np.zeros((labels, labels))
        self.start = np.zeros(labels)
        self.step_mask = np.zeros((labels, labels))
        self.start_mask = np.zeros(labels)
        for a, b in forbidden:
            self.step_mask[a, b] = -1e4
        self.start_mask[list(not_first)] = -1e4

    def _tables(self, x: np.ndarray):
        return (x @ self.weights.astype(x.dtype)).astype(float), self.steps + self.step_mask, self.start + self.start_mask

    def marginals(self, x: np.ndarray, chains: Chains, pairs: bool = False, weight: np.ndarray | None = None):
        """Probability of each label of each element by forward-backward; with ``pairs`` also the expected label pairs, weighted."""
        emit, steps, start = self._tables(x)
        ahead, behind = np.empty_like(emit), np.zeros_like(emit)
        for t, at in enumerate(chains.blocks):
            if t == 0:
                ahead[at] = start + emit[at]
            else:
                before = ahead[chains.blocks[t - 1][: len(at)]]
                ahead[at] = emit[at] + _logsumexp(before[:, :, None] + steps, 1)
        for t in range(len(chains.blocks) - 1, 0, -1):
            at = chains.blocks[t]
            behind[chains.blocks[t - 1][: len(at)]] = _logsumexp(steps + (emit[at] + behind[at])[:, None, :], 2)
        both = ahead + behind
        total = _logsumexp(both, 1)
        p = np.exp(both - total[:, None])
        if not pairs:
            return p
        expected = np.zeros_like(steps)
        for t in range(1, len(chains.blocks)):
            at = chains.blocks[t]
            before = chains.blocks[t - 1][: len(at)]
            joint = ahead[before][:, :, None] + steps + (emit[at] + behind[at])[:, None, :] - total[at][:, None, None]
            expected += np.exp(joint).sum(axis=0) if weight is None else np.tensordot(weight[at], np.exp(joint), 1)
        return p, expected

    def fit(self, x: np.ndarray, y: np.ndarray, chains: Chains, penalty: float = 1.0, rounds: int = 100, rate: float = 0.1,
            weight: np.ndarray | None = None) -> "LinearChain":
        """Penalised maximum likelihood by Adam steps over the whole sample; ``weight`` is that of the chain of each element."""
        if not len(x):
            return self
        gold = np.eye(self.weights.shape[1])[y]
        weight = np.ones(len(x)) if weight is None else weight
        seen = np.zeros_like(self.steps)
        for t in range(1, len(chains.blocks)):
            at = chains.blocks[t]
            np.add.at(seen, (y[chains.blocks[t - 1][: len(at)]], y[at]), weight[at])
        params = [self.weights, self.steps, self.start]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for k in range(1, rounds + 1):
            p, expected = self.marginals(x, chains, pairs=True, weight=weight)
            off = (gold - p) * weight[:, None]
            first = chains.blocks[0]
            grads = [x.T @ off, seen - expected, off[first].sum(axis=0)]
            for i, (param, grad) in enumerate(zip(params, grads)):
                grad = (grad - penalty * param) / weight.sum()
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                param += rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
        return self

    def viterbi(self, x: np.ndarray, chains: Chains) -> np.ndarray:
        """The likeliest labels of each chain."""
        emit, steps, start = self._tables(x)
        if chains.blocks:
            emit[chains.blocks[0]] += start
        return _paths(emit, steps, chains)

    def viterbi_mostly_out(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``viterbi`` for the labels out (0), begin (1), inside (2) with 0 -> 2 forbidden, for long chains that are mostly out.

        An element is certainly out if, whatever the labels beside it, out in
        place of its label (and begin in place of inside after it) scores more.
        What is left between such elements is decoded with them as fixed ends.
        """
        emit, steps, start = self._tables(x)
        n = len(emit)
        following = np.append(emit[1:, 1] - emit[1:, 2], 0.0)
        inside_next = following + min(0.0, (steps[1] - steps[2]).min())
        certain = np.ones(n, bool)
        for label, before in ((1, [0, 1, 2]), (2, [1, 2])):
            entry = (steps[before, 0] - steps[before, label]).min()
            if label == 1:
                entry = min(entry, start[0] - start[1])
            leave = min(0.0, (steps[0, :2] - steps[label, :2]).min())
            rest = np.minimum(leave, steps[0, 1] - steps[label, 2] + inside_next)
            certain &= emit[:, 0] - emit[:, label] + entry + rest > 1e-6
        lengths = np.asarray(lengths, np.int64)
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        ends = np.cumsum(lengths)
        first[ends - lengths], last[ends - 1] = True, True
        open_at = np.flatnonzero(~certain)
        out = np.zeros(n, np.int64)
        if not len(open_at):
            return out
        cut = np.append(True, (np.diff(open_at) > 1) | first[open_at[1:]])
        opens, closes = open_at[cut], open_at[np.append(cut[1:], True)]
        emit[opens] += np.where(first[opens][:, None], start, steps[0])
        emit[closes] += np.where(last[closes][:, None], 0.0, steps[:, 0])
        out[open_at] = _paths(emit[open_at], steps, Chains(closes - opens + 1))
        return out


def _paths(emit: np.ndarray, steps: np.ndarray, chains: Chains) -> np.ndarray:
    back = np.zeros(emit.shape, np.int64)
    score = np.empty_like(emit)
    for t, at in enumerate(chains.blocks):
        if t == 0:
            score[at] = emit[at]
        else:
            ways = score[chains.blocks[t - 1][: len(at)]][:, :, None] + steps
            back[at] = ways.argmax(axis=1)
            score[at] = emit[at] + ways.max(axis=1)
    out = score.argmax(axis=1)
    for t in range(len(chains.blocks) - 1, 0, -1):
        at = chains.blocks[t]
        out[chains.blocks[t - 1][: len(at)]] = back[at, out[at]]
    return out
