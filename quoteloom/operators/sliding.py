"""Trailing windows of quantities that have no inverse: runs, serial moments.

Answers for ``along_path``: one row per observation at every stage, constant work per observation. Runs come from prefix counts and a
sparse table over whole runs. Sums are never taken as differences of long prefix sums, which would leave float dust where
a window is constant: the tile is cut into cells as long as the window, so a window is the end of one cell and the beginning of
the next, and two arrays of sums inside cells (from each row to the cell's end, from its beginning to each row) add up to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quoteloom.operators.paths import Path, RangeExtreme, _trailing


@dataclass(frozen=True)
class Runs:
    """Runs of equal direction among the changes of ``column`` inside the trailing window, the observation's own row included."""

    column: str
    span: int
    own: bool = True

    def answers(self) -> dict[str, str]:
        return {n: "double" for n in ("run_mean", "run_max", "run_current", "up_up", "down_down")}

    def ask(self, path: Path, now: np.ndarray, known: dict) -> dict[str, np.ndarray]:
        start, end = _trailing(path, now, known, self.span, True)
        change = np.sign(np.diff(path.column[self.column].astype(np.float64), prepend=np.nan))
        moved = np.nonzero(np.nan_to_num(change) != 0)[0]  # rows that moved, in order
        sign = change[moved]
        out = {n: np.zeros(len(now)) for n in self.answers()}
        if not len(moved):
            return out
        new = np.ones(len(sign), bool)
        new[1:] = sign[1:] != sign[:-1]
        run, begin = np.cumsum(new) - 1, np.nonzero(new)[0]
        length = np.diff(np.append(begin, len(sign)))
        lo, hi = np.searchsorted(moved, start + 1), np.searchsorted(moved, end)  # the first row of a window has no change in it
        who = np.nonzero(hi > lo)[0]
        lo, hi = lo[who], hi[who]
        first, last = run[lo], run[hi - 1]
        head = np.minimum(begin[first] + length[first], hi) - lo
        tail = hi - np.maximum(begin[last], lo)
        whole = RangeExtreme(length.astype(np.float64)).over(first + 1, last)
        current = sign[hi - 1]
        out["run_mean"][who] = (hi - lo) / (last - first + 1)
        out["run_max"][who] = np.maximum(np.maximum(head, tail), np.maximum(whole, 0))
        out["run_current"][who] = current * tail
        for name, s in (("up_up", 1.0), ("down_down", -1.0)):
            one = sign == s
            count = np.concatenate([[0], np.cumsum(one)])
            pairs = np.concatenate([[0], np.cumsum(one[1:] & one[:-1])])  # pairs whose second move comes before
            origins = count[hi] - count[lo] - (current == s)
            out[name][who] = (pairs[hi - 1] - pairs[lo]) / np.maximum(origins, 1)
        return out


class CellSums:
    """Sums over windows that reach from a cell into the next one at most, without subtraction."""

    def __init__(self, begin: np.ndarray, n: int):
        self.begin = begin  # first row of each cell
        self.end = np.append(begin[1:], n)
        self.cell = np.repeat(np.arange(len(begin)), self.end - begin)

    def of(self, values: np.ndarray, start: np.ndarray, end: np.ndarray, later: bool = False) -> np.ndarray:
        """Sum of rows start .. end - 1, with ``later`` without the first of them; a NaN counts as nothing.

        A window inside one cell must begin where the cell begins or end where it ends.
        """
        v = np.nan_to_num(values)
        upto, onward, behind = np.empty(len(v)), np.empty(len(v)), np.empty(len(v))
        for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True):
            upto[a:b] = np.cumsum(v[a:b])
            onward[a:b] = np.cumsum(v[a:b][::-1])[::-1]
            behind[a] = 0.0
            behind[a + 1 : b] = np.cumsum(v[a + 1 : b])  # without the cell's first row
        out = np.zeros(len(start))
        who = np.nonzero(end > start + later)[0]
        s, e = start[who], end[who]
        first, last = self.cell[s], self.cell[e - 1]
        head = np.where(self.cell[s + later] == first, onward[s + later], 0.0)
        begins = s == self.begin[first]
        out[who] = np.where(last > first, head + upto[e - 1], np.where(begins, (behind if later else upto)[e - 1], head))
        return out

    def squares(self, values: np.ndarray, group: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sum of squared sums of ``group`` rows each, counted from the window's start; the last group may be shorter."""
        v = np.nan_to_num(values)
        n = len(v)
        sums = v.copy()
        for k in range(1, min(group, n)):
            sums[: n - k] += v[k:]
        square = sums * sums  # right where a whole group stands
        upto, onward = np.zeros(n), np.zeros(n)
        for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True):
            for k in range(min(group, b - a)):
                upto[a + k : b : group] = np.cumsum(square[a + k : b : group])
                inside = np.arange(a + k, b - group + 1, group)  # groups that end inside the cell
                onward[inside] = np.cumsum(square[inside][::-1])[::-1]
        out = np.zeros(len(start))
        who = np.nonzero(end > start)[0]
        s, e = start[who], end[who]
        border = np.minimum(self.end[self.cell[s]], e)
        cut = border < self.end[self.cell[s]]  # the window ends inside its first cell, so it begins with it
        whole = (border - s) // group  # groups inside the first cell
        inner = np.where(whole > 0, np.where(cut, upto[np.maximum(s + (whole - 1) * group, 0)], onward[s]), 0.0)
        at = s + whole * group
        across = ~cut & (at < border) & (at + group <= e)  # a group over the border
        inner += np.where(across, square[np.minimum(at, n - 1)], 0.0)
        further = across | (~cut & (at == border))
        at = np.where(across, at + group, at)
        more = np.where(further, (e - at) // group, 0)  # groups behind it
        inner += np.where(more > 0, upto[np.clip(at + (more - 1) * group, 0, n - 1)], 0.0)
        at = at + more * group
        rest = np.zeros(len(who))
        for k in range(group - 1):
            rest += np.where(at + k < e, v[np.minimum(at + k, n - 1)], 0.0)
        out[who] = inner + rest * rest
        return out


@dataclass(frozen=True)
class SerialMoments:
    """Sums over the rows of ``[T - span, T]``: count, values, squares, neighbours' products and squared sums of ``group`` rows."""

    column: str
    span: int
    group: int
    own: bool = True

    def answers(self) -> dict[str, str]:
        return {n: "double" for n in ("_n", "_s", "_ss", "_x", "_xx", "_y", "_yy", "_xy", "_gg")}

    def ask(self, path: Path, now: np.ndarray, known: dict) -> dict[str, np.ndarray]:
        start = np.searchsorted(path.us, now - self.span, "left")
        end = np.searchsorted(path.us, now, "right")
        d = path.column[self.column].astype(np.float64)
        if not len(d):
            return {n: np.zeros(len(now)) for n in self.answers()}
        # cells one longer than the window, which counts both of its ends
        begin = np.nonzero(np.diff(path.us // (self.span + 1), prepend=-1 << 62))[0]
        cells, before = CellSums(begin, len(d)), np.concatenate([[np.nan], d[:-1]])
        early = np.maximum(end - 1, start)
        return {
            "_n": (end - start).astype(np.float64),
            "_s": cells.of(d, start, end),
            "_ss": cells.of(d * d, start, end),
            "_x": cells.of(d, start, early),
            "_xx": cells.of(d * d, start, early),
            "_y": cells.of(d, start, end, later=True),
            "_yy": cells.of(d * d, start, end, later=True),
            "_xy": cells.of(d * before, start, end, later=True),
            "_gg": cells.squares(d, self.group, start, end),
        }
