"""Linear-chain conditional random fields in numpy, over batches of equally long padded chains."""

from __future__ import annotations

import numpy as np


def padded(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of flat ``values`` (n, L) laid out as (chains, longest, L), and the mask of real places."""
    longest = int(lengths.max(initial=0))
    mask = np.arange(longest)[None, :] < lengths[:, None]
    out = np.zeros((len(lengths), longest, values.shape[1]), values.dtype)
    out[mask] = values
    return out, mask


def forward_backward(scores: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors (chains, T, L), expected transition counts (L, L) and the summed log partition.

    Probabilities are rescaled at each place, so long chains neither over- nor underflow.
    """
    n, t, k = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e, m = np.exp(scores - top), np.exp(trans - trans.max())
    alpha, scale = np.empty_like(e), np.ones((n, t), e.dtype)
    a = e[:, 0]
    for i in range(t):
        if i:
            a = np.where(mask[:, i, None], (alpha[:, i - 1] @ m) * e[:, i], alpha[:, i - 1])
        s = a.sum(axis=1, keepdims=True)
        alpha[:, i] = a / s
        scale[:, i] = np.where(mask[:, i], s[:, 0], 1)
    post, expected = np.empty_like(e), np.zeros((k, k))
    beta = np.ones((n, k), e.dtype)
    post[:, t - 1] = alpha[:, t - 1]
    for i in range(t - 2, -1, -1):
        live = mask[:, i + 1]
        right = e[:, i + 1] * beta / scale[:, i + 1, None]
        pair = alpha[live, i].T @ right[live] if live.any() else 0
        expected += pair * m
        beta = np.where(live[:, None], right @ m.T, beta)
        p = alpha[:, i] * beta
        post[:, i] = p / p.sum(axis=1, keepdims=True)
    partition = float((np.log(scale) * mask).sum() + (top[:, :, 0] * mask).sum() + trans.max() * (mask[:, 1:].sum()))
    return post, expected, partition


def posteriors(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Posteriors of whole chains of any length, laid end to end in ``scores`` (n, labels), as forward_backward gives them.

    Chains are ordered by length, so that at each place those still running are the first ones: alpha and beta
    are carried along them and nothing is padded.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    running = np.searchsorted(-size, -np.arange(int(size.max(initial=0)) + 1), "left").tolist()
    e, m = np.exp(scores - scores.max(axis=1, keepdims=True)), np.exp(trans - trans.max()).astype(scores.dtype)
    alpha, scale = np.empty_like(e), np.empty((len(e), 1), e.dtype)
    a = np.zeros((0, e.shape[1]), e.dtype)
    for t in range(len(running) - 1):
        rows = starts[: running[t]] + t
        a = e[rows] * (a[: running[t]] @ m) if t else e[rows]
        s = a.sum(axis=1, keepdims=True)
        a = a / s
        alpha[rows], scale[rows] = a, s
    out = alpha
    beta = np.ones((len(starts), e.shape[1]), e.dtype)
    for t in range(len(running) - 3, -1, -1):
        n = running[t + 1]
        rows = starts[:n] + t
        beta[:n] = (e[rows + 1] * beta[:n] / scale[rows + 1]) @ m.T
        p = alpha[rows] * beta[:n]
        out[rows] = p / p.sum(axis=1, keepdims=True)
    return out


def viterbi(scores: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best label of each place (chains, T); ties go to the smaller label; padding repeats the last label."""
    n, t, k = scores.shape
    best, back = scores[:, 0].copy(), np.zeros((n, t, k), np.int16)
    for i in range(1, t):
        step = best[:, :, None] + trans[None]
        arg = step.argmax(axis=1)
        reached = np.take_along_axis(step, arg[:, None, :], 1)[:, 0] + scores[:, i]
        live = mask[:, i, None]
        back[:, i] = np.where(live, arg, np.arange(k)[None])
        best = np.where(live, reached, best)
    path = np.zeros((n, t), np.int16)
    path[:, t - 1] = best.argmax(axis=1)
    for i in range(t - 1, 0, -1):
        path[:, i - 1] = np.take_along_axis(back[:, i], path[:, i, None].astype(np.int64), 1)[:, 0]
    return path


class Adam:
    """The optimiser's state for one parameter array."""

    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, value: np.ndarray, grad: np.ndarray) -> None:
        """In place, along the gradient (ascent)."""
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad * grad - self.v)
        value += self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit(features: np.ndarray, owner: np.ndarray, unique: int, n_features: int, words: np.ndarray, labels: np.ndarray, lengths: np.ndarray, k: int, *, rounds: int = 60, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (n_features, k) and transitions (k, k) of most penalised likelihood.

    ``features``/``owner``: feature ids of the unique words and the word each belongs to; ``words``,
    ``labels``: word and label of each place, chains of ``lengths`` laid end to end.
    """
    w, trans = np.zeros((n_features, k)), np.zeros((k, k))
    opt_w, opt_t = Adam(w.shape, rate), Adam(trans.shape, rate)
    gold = np.zeros((unique, k))
    np.add.at(gold, (words, labels), 1)
    ends = np.cumsum(lengths)
    inner = np.ones(len(words), bool)
    inner[ends - 1] = False
    at = np.nonzero(inner)[0]
    seen = np.zeros((k, k))
    np.add.at(seen, (labels[at], labels[at + 1]), 1)
    n = max(1, len(words))
    for _ in range(rounds):
        emission = np.stack([np.bincount(owner, w[features, j], unique) for j in range(k)], axis=1)
        x, mask = padded(emission[words], lengths)
        post, expected, _ = forward_backward(x, mask, trans)
        got = np.stack([np.bincount(words, post[mask][:, j], unique) for j in range(k)], axis=1)
        diff = (gold - got) / n
        grad = np.stack([np.bincount(features, diff[owner, j], n_features) for j in range(k)], axis=1)
        opt_w.step(w, grad - decay * w / len(w) ** 0.5)
        opt_t.step(trans, (seen - expected) / n - decay * trans)
    return w, trans
