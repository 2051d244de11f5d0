"""Hashed n-gram indicators of texts, and a linear hinge-loss model on them.

The features of a text are the distinct values of: its words, pairs of
neighbouring words, word beginnings (five bytes) and word ends (two bytes, with
case), each hashed to one of ``2**BITS`` places, and a few places for how many
neighbouring words are equal and how many words are distinct.  Where asked for,
a word beginning (of five or seven bytes) that 2, 3 or 5 words have gives a
place of its own for each.
"""

from __future__ import annotations

import numpy as np

from inventra.llm.words import _BYTE, _BYTE_LOWER, U, join_texts, mix, prefix_hash, slices, span_hash, window_hashes, word_bounds

BITS = 18
SIZE = 1 << BITS
_SHIFT = U(64 - BITS)


#: How many words must share a beginning for a feature of its own.
OFTEN = (2, 3, 5)


def features(texts: list[bytes | None], often: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of each text, in order of text, and where each text's
    begin (one more entry for the end).  Each text has some."""
    out, sizes = [], []
    for a, b in slices(texts):
        data, starts = join_texts(texts[a:b])
        start, end = word_bounds(data)
        lower, cased = prefix_hash(data, _BYTE_LOWER), prefix_hash(data, _BYTE)
        word = span_hash(lower, start, end)
        first = np.searchsorted(start, starts)
        count = np.diff(first)
        pair = window_hashes(word, 2)
        same = np.concatenate((word[1:] == word[:-1], [False])) if len(word) else np.zeros(0, bool)
        kinds = [word, np.append(pair, np.zeros(min(1, len(word)), U)), span_hash(lower, start, np.minimum(start + 5, end)) + U(1), span_hash(cased, np.maximum(end - 2, start), end) + U(2)]
        if often:
            starts_of = [kinds[2], span_hash(lower, start, np.minimum(start + 7, end)) + U(3)]
        kinds = [(mix(x) >> _SHIFT).astype(np.int32) for x in kinds]
        extra = mix(np.arange(64, dtype=U) + U(77))
        for i in range(b - a):
            f, g = first[i], first[i + 1]
            n = int(count[i])
            own = [kinds[0][f:g], kinds[1][f : max(f, g - 1)], kinds[2][f:g], kinds[3][f:g]]
            equal = int(same[f : max(f, g - 1)].sum())
            distinct = len(np.unique(kinds[0][f:g]))
            marks = [min(12, equal.bit_length()), 13 + (8 * distinct // n if n else 9), 30 + min(20, n.bit_length())]
            own.append((extra[marks] >> _SHIFT).astype(np.int32))
            if often:
                for beginning in starts_of:
                    held, many = np.unique(beginning[f:g], return_counts=True)
                    own += [(mix(held[many >= k] + U(100 + k)) >> _SHIFT).astype(np.int32) for k in OFTEN]
            place = np.unique(np.concatenate(own))
            out.append(place)
            sizes.append(len(place))
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), np.cumsum([0, *sizes])


def margins(weight: np.ndarray, bias: float, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each text's margin; its indicators are scaled to unit length."""
    if len(first) < 2:
        return np.zeros(0)
    return np.add.reduceat(weight[place], first[:-1]) / np.sqrt(np.diff(first)) + bias


def log_count_ratios(place: np.ndarray, first: np.ndarray, label: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Naive Bayes: log of each place's share among positive texts over that
    among negative ones.  ``label`` may be soft (0 to 1)."""
    each = np.repeat(label, np.diff(first))
    up = smooth + np.bincount(place, each, SIZE)
    down = smooth + np.bincount(place, 1 - each, SIZE)
    return np.log(up / (label.sum() + 2 * smooth)) - np.log(down / ((1 - label).sum() + 2 * smooth))


def dual_descent(place, first, sign, cost, scale, epochs=8, seed=7) -> tuple[np.ndarray, float]:
    """Weights of the hinge-loss linear model by dual coordinate descent.

    Row i is ``scale`` at its places over the root of their number, and 1 for
    the bias; ``sign`` is 1 or -1, ``cost`` each row's bound on its dual."""
    n = len(sign)
    size = np.diff(first)
    rows = [place[first[i] : first[i + 1]] for i in range(n)]
    values = [scale[r] / np.sqrt(len(r)) for r in rows]
    square = np.array([float(v @ v) for v in values]) + 1
    alpha, weight, bias = np.zeros(n), np.zeros(len(scale)), 0.0
    order = np.arange(n)
    rng = np.random.default_rng(seed)
    assert (size > 0).all()
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order.tolist():
            r, v = rows[i], values[i]
            gradient = sign[i] * (float(weight[r] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                weight[r] += step * v
                bias += step
                alpha[i] = new
    return weight, bias


def fitted(place, first, label, strength=1.0) -> tuple[np.ndarray, float]:
    """The model folded into one weight per place: ratios times hinge weights."""
    label = np.asarray(label, float)
    ratio = log_count_ratios(place, first, label)
    sign = np.where(label >= 0.5, 1.0, -1.0)
    sure = np.abs(2 * label - 1)
    weight, bias = dual_descent(place, first, sign, strength * sure, ratio)
    return weight * ratio, bias


def logistic(margin: np.ndarray, label: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of the probability of label 1 given a margin (Platt)."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def rows_of(place: np.ndarray, first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [place[first[i] : first[i + 1]] for i in pick]
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.cumsum([0, *map(len, parts)])


def held_margins(place, first, label, folds=3, **more) -> np.ndarray:
    """Each row's margin by a model that didn't learn from it."""
    n = len(first) - 1
    out = np.zeros(n)
    for f in range(folds):
        other, own = np.flatnonzero(np.arange(n) % folds != f), np.flatnonzero(np.arange(n) % folds == f)
        if len(own):
            weight, bias = fitted(*rows_of(place, first, other), label[other], **more)
            out[own] = margins(weight, bias, *rows_of(place, first, own))
    return out
