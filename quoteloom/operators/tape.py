"""Microstructure of sampled observations straight from the ticks: questions for ``along_path``.

All of them look at the ticks of ``[T - span, T]`` up to the observation's own; a change belongs to a window if both of its ticks do.
Counts are differences of whole-number prefix sums, which are exact; sums of squares are added up inside cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quoteloom.operators.paths import FirstReach, Path, RangeExtreme, _trailing
from quoteloom.operators.sliding import CellSums


def _signs(path: Path, column: str) -> np.ndarray:
    """Sign of each row's change against the row before it; 0 for the first."""
    v = path.column[column].astype(np.float64)
    out = np.zeros(len(v))
    out[1:] = np.sign(v[1:] - v[:-1])
    return out


def _between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of rows start + 1 .. end - 1 are flagged."""
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return upto[np.maximum(end, np.minimum(start + 1, len(flags)))] - upto[np.minimum(start + 1, len(flags))]


def _shares(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.where(of > 0, count / np.maximum(of, 1), 0.0)


@dataclass(frozen=True)
class Flow:
    """Ticks and signed imbalance of their changes per window: ``rate_<name>``, ``imbalance_<name>``."""

    column: str
    windows: tuple[tuple[str, int], ...]
    own: bool = True

    def answers(self) -> dict[str, str]:
        return {f"{k}_{n}": "double" for n, _ in self.windows for k in ("rate", "imbalance")}

    def ask(self, path: Path, now: np.ndarray, known: dict) -> dict[str, np.ndarray]:
        sign, out = _signs(path, self.column), {}
        end = path.through(known)
        for name, span in self.windows:
            start = np.searchsorted(path.us, now - span, "left")
            up, down = _between(sign > 0, start, end), _between(sign < 0, start, end)
            out[f"rate_{name}"] = (end - start).astype(np.float64)
            out[f"imbalance_{name}"] = (up - down) / np.maximum(up + down, 1)
        return out


@dataclass(frozen=True)
class Changes:
    """Share of a window's changes that moved ``column`` at all: ``name``."""

    name: str
    column: str
    span: int
    own: bool = True

    def answers(self) -> dict[str, str]:
        return {self.name: "double"}

    def ask(self, path: Path, now: np.ndarray, known: dict) -> dict[str, np.ndarray]:
        start, end = _trailing(path, now, known, self.span, True)
        moved = _between(_signs(path, self.column) != 0, start, end)
        return {self.name: _shares(moved, end - start - 1)}


@dataclass(frozen=True)
class Arrivals:
    """Mean gap between the ticks of a window and its variation, in units of ``unit``; without a gap the window itself and 0."""

    name: str
    column: str
    span: int
    unit: int
    own: bool = True

    def answers(self) -> dict[str, str]:
        return {f"{self.name}_mean": "double", f"{self.name}_cv": "double"}

    def ask(self, path: Path, now: np.ndarray, known: dict) -> dict[str, np.ndarray]:
        start, end = _trailing(path, now, known, self.span, True)
        gaps = end - start - 1
        if not len(path.us):
            return {f"{self.name}_mean": np.full(len(now), self.span / self.unit), f"{self.name}_cv": np.zeros(len(now))}
        some, last = gaps > 0, len(path.us) - 1
        total = np.where(some, path.us[np.clip(end - 1, 0, last)] - path.us[np.clip(start, 0, last)], 0)
        mean = np.where(some, total / np.maximum(gaps, 1), self.span) / self.unit
        gap = np.diff(path.us, prepend=path.us[:1]) / self.unit
        begin = np.nonzero(np.diff(path.us // (self.span + 1), prepend=-1 << 62))[0]
        squares = CellSums(begin, len(path.us)).of(gap * gap, start, end, later=True)
        variance = np.maximum(squares / np.maximum(gaps, 1) - mean * mean, 0.0)
        return {f"{self.name}_mean": mean, f"{self.name}_cv": np.where(some & (mean > 0), np.sqrt(variance) / np.maximum(mean, 1e-300), 0.0)}


@dataclass(frozen=True)
class LocalExtremes:
    """High and low of a window, and how long ago each first stood, in units of ``unit``."""

    column: str
    span: int
    unit: int
    own: bool = True

    def answers(self) -> dict[str, str]:
        return {n: "double" for n in ("local_high", "local_low", "since_high", "since_low")}

    def ask(self, path: Path, now: np.ndarray, known: dict) -> dict[str, np.ndarray]:
        start, end = _trailing(path, now, known, self.span, True)
        out = {}
        for name, sign in (("high", 1), ("low", -1)):
            best = path.index(RangeExtreme, self.column, sign).over(start, end)
            at = path.index(FirstReach, self.column, sign).within(start, end, np.where(np.isinf(best), np.nan, best))
            when = path.us[np.maximum(at, 0)] if len(path.us) else np.zeros(len(at))
            out[f"local_{name}"] = np.where(at >= 0, best * sign, np.nan)
            out[f"since_{name}"] = np.where(at >= 0, (now - when) / self.unit, np.nan)
        return out
