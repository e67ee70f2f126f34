"""Compact windows of token sequences, in numpy."""

from __future__ import annotations

import numpy as np


def sliding_min(x: np.ndarray, t: int) -> np.ndarray:
    """Least of each t consecutive values, by doubling."""
    have, width = x, 1
    while width * 2 <= t:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    rest = t - width
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def compact_windows(x: np.ndarray, edges: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions c, and first and last positions l and r, of the compact windows that hold t values or more.

    x has the values of several sequences one after another, sequence i from edges[i] to
    edges[i + 1]. Of distinct values, each subsequence of t or more lies within [l, r] of
    exactly one window with c inside it, and its least value is x[c]. Neighbouring windows of
    equal least values become one, with c at one of them, so runs of repeats stay one window.

    Only values that are least of some t neighbours have such windows. Their nearest lesser
    values come from the Cartesian tree of these values alone, for distances of t or more; for
    lesser distances the places where the sliding minimum changes have them.
    """
    empty = np.zeros(0, np.int64)
    if len(x) < t:
        return empty, empty, empty
    # a start i is live if its t values lie in one sequence
    n = np.diff(edges)
    long_ = n >= t
    total = np.where(long_, n - t + 1, 0)
    if not total.sum():
        return empty, empty, empty
    starts = np.repeat(edges[:-1], total) + np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    owner = np.repeat(np.arange(len(n)), total)
    least = sliding_min(x, t)[starts]
    change = np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])))
    head = np.flatnonzero(change)
    tail = np.append(head[1:], len(least)) - 1
    value, seq = least[head], owner[head]
    lo, hi = starts[head], starts[tail]  # subsequences of t values from lo to hi on have this minimum
    # the place of the minimum: within the last t values of the first and the first t of the last subsequence
    c = _place(x, value, hi, lo, t)
    left, right = np.maximum(lo, edges[seq]), hi + t - 1
    left, right = _stretch(c, value, seq, left, right, edges, t)
    return c, left, right


def _place(x: np.ndarray, value: np.ndarray, first: np.ndarray, last: np.ndarray, t: int) -> np.ndarray:
    """The first position of value from `first` on (a run of equal minima has one among them up to last + t - 1)."""
    c = first.copy()
    todo = np.flatnonzero(x[c] != value)
    while len(todo):
        c[todo] += 1
        todo = todo[x[c[todo]] != value[todo]]
    return c


def _stretch(c, value, seq, left, right, edges, t):
    """Carry left and right on to the nearest lesser values, where these are t or more away."""
    l_out, r_out = left.copy(), right.copy()
    cs, vs, ss = c.tolist(), value.tolist(), seq.tolist()
    stack: list[int] = []
    at = -1
    for k, v in enumerate(vs):
        if ss[k] != at:
            for j in stack:
                r_out[j] = edges[ss[j] + 1] - 1
            stack, at = [], ss[k]
        while stack and vs[stack[-1]] > v:
            j = stack.pop()
            if cs[k] - cs[j] >= t:
                r_out[j] = cs[k] - 1
        if left[k] <= cs[k] - t + 1:
            l_out[k] = min(left[k], cs[stack[-1]] + 1 if stack else edges[at])
        stack.append(k)
    for j in stack:
        r_out[j] = edges[ss[j] + 1] - 1
    return l_out, r_out
