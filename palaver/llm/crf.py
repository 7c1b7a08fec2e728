"""A linear-chain conditional random field on numpy: training by full gradients, decoding by Viterbi, both over batches of sequences."""

from __future__ import annotations

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Crf:
    """State 0 also stands before the first and behind the last token of a sequence."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray) -> None:
        self.weights, self.transitions = weights, transitions

    def gains(self, scores: np.ndarray) -> np.ndarray:
        """For each position of scores [position, state], the most that a path can gain there over one that stays in state 0, by the score and the move into it."""
        moves = (self.transitions - self.transitions[0, 0]).max(0).astype(scores.dtype)
        return (scores[:, 1:] + moves[1:]).max(1).astype(float) - scores[:, 0]

    def open(self, gains: np.ndarray) -> np.ndarray:
        """Positions of a sequence that may be in another state than 0 on a best path, by the gains of all of them.

        A stretch of other states gains at most the sum of its gains and what the move back
        into state 0 adds.  A position is open if that is not below 0 for some stretch with
        it; any other is in state 0 on every best path, so the sequence falls apart there.
        """
        total = np.concatenate([[0.0], np.cumsum(gains)])
        least = np.minimum.accumulate(total[:-1])
        most = np.maximum.accumulate(total[:0:-1])[::-1]
        back = (self.transitions[1:, 0] - self.transitions[0, 0]).max()
        return most - least + back > -1e-2  # what rounding may hide

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best states [sequence, position] of padded scores [sequence, position, state], which are features times weights."""
        n, width, _ = scores.shape
        order = np.argsort(-lengths, kind="stable")  # so those that go on at a position come first
        inside = [*np.searchsorted(-lengths[order], -np.arange(width), side="left").tolist(), 0]
        moves = self.transitions.astype(scores.dtype)
        best = np.ascontiguousarray(scores[order].transpose(1, 2, 0))  # [position, state, sequence]
        best[0] += moves[0][:, None]
        for t in range(1, width):
            m = inside[t]
            best[t, :, :m] += (best[t - 1, :, None, :m] + moves[:, :, None]).max(0)
        out = np.zeros((n, width), np.int16)
        state = np.zeros(n, int)  # of the position behind
        for t in range(width - 1, -1, -1):
            m = inside[t]
            state[:m] = (best[t, :, :m] + moves[:, state[:m]]).argmax(0)
            out[order[:m], t] = state[:m]
        return out


def train(features: np.ndarray, lengths: np.ndarray, states: np.ndarray, n_states: int, steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> Crf:
    """Maximum likelihood with weight decay by Adam, from zero weights; the same table always gives the same model."""
    order = np.argsort(-lengths, kind="stable")  # so those that go on at a position come first
    features, lengths, states = features[order], lengths[order], states[order]
    n, width, n_features = features.shape
    known = np.arange(width)[None, :] < lengths[:, None]
    inside, flat = known.astype(float), features[known]
    gold = np.eye(n_states)[states] * inside[..., None]
    gold_weights = flat.T @ gold[known]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    rows = np.arange(n)
    alive = known.sum(0).tolist()
    np.add.at(gold_moves, (0, states[:, 0]), 1)
    np.add.at(gold_moves, (states[rows, lengths - 1], 0), 1)
    params = [np.zeros((n_features, n_states)), np.zeros((n_states, n_states))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, steps + 1):
        weights, moves = params
        scores = np.zeros((n, width, n_states))
        scores[known] = flat @ weights
        forward, backward = np.zeros((n, width, n_states)), np.zeros((n, width, n_states))
        forward[:, 0] = moves[0] + scores[:, 0]
        for t in range(1, width):
            m = alive[t]
            forward[:m, t] = _logsumexp(forward[:m, t - 1, :, None] + moves, 1) + scores[:m, t]
        backward[rows, lengths - 1] = moves[:, 0]
        for t in range(width - 2, -1, -1):
            m = alive[t + 1]
            backward[:m, t] = _logsumexp(moves[None] + (scores[:m, t + 1] + backward[:m, t + 1])[:, None, :], 2)
        total = _logsumexp(forward[rows, lengths - 1] + moves[:, 0], 1)
        node = np.exp(forward + backward - total[:, None, None]) * inside[..., None]
        expected_moves = np.zeros_like(moves)
        for t in range(1, width):
            m = alive[t]
            joint = np.exp(forward[:m, t - 1, :, None] + moves + (scores[:m, t] + backward[:m, t])[:, None, :] - total[:m, None, None])
            expected_moves += joint.sum(0)
        expected_moves[0] += node[:, 0].sum(0)
        expected_moves[:, 0] += node[rows, lengths - 1].sum(0)
        gradients = [(gold_weights - flat.T @ node[known]) / n - decay * weights, (gold_moves - expected_moves) / n - decay * moves]
        for p, g, m in zip(params, gradients, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Crf(*params)
