"""Sequence ratios of many pairs of strings at once.

The ratio of two strings is twice the characters in matching blocks over all characters.
Blocks are found by taking the longest common run, of equal ones the first in the first
string, then in the second, and going on to the left and to the right of it. All pairs
go through each step together as arrays of code points.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Cells of the tables of common runs held at once.
_CELLS = 1 << 21
#: From this length on frequent characters are passed over by the usual definition; such pairs are compared one by one.
_LONG = 200


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in strings], np.int64)
    out = np.full((len(strings), int(size.max(initial=0))), -1, np.int32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out, size


def shared_letters(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each two rows of code points (-1 behind their ends) the characters that they share, order aside."""
    n = np.zeros(len(x), np.int64)
    for c in np.unique(x[x >= 0]):
        n += np.minimum((x == c).sum(1), (y == c).sum(1))
    return n


def _longest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in each row of ``x`` and of ``y``, and length, of the first longest common run."""
    n, best = len(x), np.zeros(len(x), np.int32)
    at_x, at_y = np.zeros(n, np.int64), np.zeros(n, np.int64)
    run = np.zeros((n, y.shape[1] + 1), np.int32)
    for i in range(x.shape[1]):
        run[:, 1:] = np.where((x[:, i, None] == y) & (y >= 0), run[:, :-1] + 1, 0)
        j = run.argmax(1)
        found = run[np.arange(n), j]
        more = found > best
        best[more], at_x[more], at_y[more] = found[more], i + 1 - found[more], j[more] - found[more]
    return at_x, at_y, best


def _cut(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Columns ``lo`` to ``hi`` of each row, -1 behind them."""
    at = lo[:, None] + np.arange(int((hi - lo).max(initial=0)))[None, :]
    return np.where(at < hi[:, None], np.take_along_axis(codes, np.minimum(at, codes.shape[1] - 1), 1), -1)


def _matched(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Characters in matching blocks of each two rows."""
    total = np.zeros(len(x), np.int64)
    todo = (np.arange(len(x)), np.zeros(len(x), np.int64), nx.copy(), np.zeros(len(x), np.int64), ny.copy())
    while len(todo[0]):
        left = []
        step = max(1, _CELLS // max(1, int((todo[4] - todo[3]).max()) + 1))
        for k in range(0, len(todo[0]), step):
            row, a, b, c, d = (t[k : k + step] for t in todo)
            i, j, n = _longest(_cut(x[row], a, b), _cut(y[row], c, d))
            np.add.at(total, row, n)
            for part in ((row, a, a + i, c, c + j), (row, a + i + n, b, c + j + n, d)):
                keep = (n > 0) & (part[2] > part[1]) & (part[4] > part[3])
                left.append([p[keep] for p in part])
        todo = tuple(np.concatenate(t) for t in zip(*left, strict=True))
    return total


def ratios(a: list[str], b: list[str], least: float = 0.0) -> np.ndarray:
    """The ratio of each pair; 0 where shared letters alone show that it is below ``least``."""
    out = np.zeros(len(a))
    if not len(a):
        return out
    names = {s: i for i, s in enumerate(dict.fromkeys([*a, *b]))}
    pair = np.array([names[s] for s in a], np.int64) * len(names) + np.array([names[s] for s in b], np.int64)
    distinct, back = np.unique(pair, return_inverse=True)
    i, j = distinct // len(names), distinct % len(names)
    codes, size = _codes(list(names))
    score = np.ones(len(distinct))
    total = size[i] + size[j]
    long = size[j] >= _LONG
    strings = list(names)
    for k in np.flatnonzero(long):
        score[k] = SequenceMatcher(None, strings[i[k]], strings[j[k]]).ratio()
    few = np.flatnonzero(~long & (total > 0))
    for k in range(0, len(few), 1 << 16):
        at = few[k : k + (1 << 16)]
        bound = 2 * shared_letters(codes[i[at]], codes[j[at]]) / total[at]
        score[at[bound < least]] = 0
        at = at[bound >= least]
        if len(at):
            score[at] = 2 * _matched(codes[i[at]], size[i[at]], codes[j[at]], size[j[at]]) / total[at]
    return score[back]
