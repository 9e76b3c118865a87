"""Questions about the path after an observation: range extremes, neighbours in time, first passages.

Spark deals path and observations into tiles of time, each path row also into the earlier tiles from which it can be seen, so all
questions of all observations cost one shuffle of the path. In a task the tile's path is indexed once:

* extremes of any range: prefix and suffix extremes inside blocks of ``SMALL`` rows and a sparse table of power-of-two
  ranges over the blocks, so a range is two overlapping lookups and two ends;
* rank of a value in a range and value of a rank there: a wavelet matrix;
* first row of a range that reaches a level: a tree of extremes of aligned power-of-two ranges, climbed and descended; an
  opened cell returns its half, never its rows.

All observations of a tile are answered together, array by array; no pairs of observations and path rows are made, so the work per
observation grows with the logarithm of the density only. Many short series share a task's group: their rows stand one series after the other
in the same indexes, and a time is looked up inside its own series, so the number of groups follows the rows and not the series.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteloom.functions.timing import DAY, cell

SMALL = 16
TILE_ROWS = 500_000
MINUTE_US = 60_000_000
FEWEST = 16  # series that must fit into a group on average; fewer are dealt too unevenly by their hash
_NONE = -1


class RangeExtreme:
    """Maximum of any range of rows (of the negated values: minimum); -inf over an empty one."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        blocks = max(1, -(-n // SMALL))
        self.values = np.full(blocks * SMALL, -np.inf)
        self.values[:n] = values
        square = self.values.reshape(blocks, SMALL)
        self.prefix = np.maximum.accumulate(square, axis=1).ravel()
        self.suffix = np.maximum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [square.max(axis=1)]
        while 2 << (len(self.table) - 1) <= blocks:
            below, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.maximum(below[:-half], below[half:]))

    def over(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Maximum of rows start .. end - 1."""
        out = np.full(len(start), -np.inf)
        first, last = start // SMALL, (end - 1) // SMALL
        apart = np.nonzero((end > start) & (last > first))[0]
        out[apart] = np.maximum(self.suffix[start[apart]], self.prefix[end[apart] - 1])
        inner = apart[last[apart] - first[apart] > 1]
        lo, count = first[inner] + 1, last[inner] - first[inner] - 1
        level = np.frexp(count.astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            who = inner[level == k]
            at, n = lo[level == k], count[level == k]
            out[who] = np.maximum(out[who], np.maximum(self.table[k][at], self.table[k][at + n - (1 << k)]))
        near = np.nonzero((end > start) & (last == first))[0]
        for step in range(SMALL):
            near = near[start[near] + step < end[near]]
            out[near] = np.maximum(out[near], self.values[start[near] + step])
        return out


class FirstReach:
    """First row of a range whose value is at least a level."""

    def __init__(self, values: np.ndarray):
        size = 1 << max(0, (max(len(values), 1) - 1).bit_length())
        lowest = np.full(size, -np.inf)
        lowest[: len(values)] = values
        self.levels = [lowest]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2).max(axis=1))
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in self.levels])])
        self.flat = np.concatenate(self.levels)
        self.steps = 0  # looks at cells, for tests

    def within(self, start: np.ndarray, end: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Row number, or -1; a NaN level is never reached."""
        out = np.full(len(start), _NONE)
        at, height = start.astype(np.int64).copy(), np.zeros(len(start), np.int64)
        live = np.nonzero((end > start) & ~np.isnan(level))[0]
        top = len(self.levels) - 1
        while len(live):
            self.steps += len(live)
            p, k = at[live], height[live]
            hit = self.flat[self.starts[k] + (p >> k)] >= level[live]
            done = hit & (k == 0)
            out[live[done]] = p[done]
            p = np.where(hit, p, p + (1 << k))
            up = ~hit & (k < top) & ((p >> k) & 1 == 0)
            height[live], at[live] = np.where(hit, k - 1, k + up), p
            live = live[~done & (p < end[live])]
        return out


class Orders:
    """A wavelet matrix: how many of any range of rows lie below a value, and which value has a given rank there.

    Values are numbered in order and dealt by one bit of the number per level, highest first; a level keeps how many
    zeros stand before each row. NaN rows are left out.
    """

    def __init__(self, values: np.ndarray):
        there = ~np.isnan(values)
        self.before = np.concatenate([[0], np.cumsum(there)])
        self.values, code = np.unique(values[there], return_inverse=True)
        self.zeros = []
        for bit in range(max(0, len(self.values) - 1).bit_length() - 1, -1, -1):
            low = (code >> bit & 1) == 0
            self.zeros.append((bit, np.concatenate([[0], np.cumsum(low)]).astype(np.int32)))
            code = np.concatenate([code[low], code[~low]])

    def count(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.maximum(self.before[np.maximum(end, start)] - self.before[start], 0)

    def _step(self, upto: np.ndarray, lo: np.ndarray, hi: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, ...]:
        zlo, zhi = upto[lo].astype(np.int64), upto[hi].astype(np.int64)
        return zhi - zlo, np.where(ones, upto[-1] + lo - zlo, zlo), np.where(ones, upto[-1] + hi - zhi, zhi)

    def below(self, start: np.ndarray, end: np.ndarray, value: np.ndarray, equal: bool = False) -> np.ndarray:
        """Rows of start .. end - 1 with a smaller value (``equal``: or the same)."""
        code = np.searchsorted(self.values, value, "right" if equal else "left")
        lo, hi = self.before[start], self.before[np.maximum(end, start)]
        whole, out = code >= len(self.values), np.zeros(len(start), np.int64)
        out[whole] = (hi - lo)[whole]
        for bit, upto in self.zeros:
            ones = (code >> bit & 1) == 1
            zeros, lo, hi = self._step(upto, lo, hi, ones)
            out += np.where(ones & ~whole, zeros, 0)
        return out

    def ranked(self, start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of a rank (from 0) among the rows of a range; the rank must exist."""
        lo, hi, rank = self.before[start], self.before[end], rank.copy()
        code = np.zeros(len(start), np.int64)
        for bit, upto in self.zeros:
            zeros = upto[hi].astype(np.int64) - upto[lo]
            ones = rank >= zeros
            rank -= np.where(ones, zeros, 0)
            code |= ones.astype(np.int64) << bit
            _, lo, hi = self._step(upto, lo, hi, ones)
        return self.values[code]


class Path:
    """The path rows of a tile in order of time and tie, with the indexes that questions ask for.

    Where several series share the tile, ``series`` and ``asked`` number those of the rows and of the observations, and all
    rows lie between the times of ``reach``: series follow each other, each on its own stretch of ``line``.
    """

    def __init__(self, rows: pa.Table, order: list[str], series: np.ndarray | None = None, asked: np.ndarray | None = None, reach: tuple[int, int] = (0, 0)):
        by = [(c, "ascending") for c in order]
        if series is not None:
            rows, by = rows.append_column("_series", pa.array(series)), [("_series", "ascending"), *by]
        rows = rows.sort_by(by)
        self.column = {c: rows[c].to_numpy() for c in rows.column_names if not pa.types.is_nested(rows.schema.field(c).type)}
        self.us, self.order = self.column[order[0]].astype(np.int64), order
        self.asked, self.reach = asked, reach
        self.first, self.last = 0, len(self.us)  # the rows of each observation's series
        if series is not None:
            self.line = self.us - reach[0] + self.column["_series"] * _stretch(reach)
            self.first, self.last = (self.row(np.full(len(asked), t), side) for t, side in zip(reach, ("left", "right"), strict=True))
        self._made: dict = {}

    def row(self, us: np.ndarray, side: str) -> np.ndarray:
        """Where a time of each observation falls among the rows of its series; an unknown time is behind them."""
        if self.asked is None:
            return np.searchsorted(self.us, us, side)
        lo, hi = self.reach
        inside = np.clip(np.where(np.isnan(us), hi, us), lo, hi).astype(np.int64) - lo
        return np.searchsorted(self.line, inside + self.asked * _stretch(self.reach), side)

    def values(self, column: str, sign: int) -> np.ndarray:
        v = self.column[column].astype(np.float64) * sign
        return np.where(np.isnan(v), -np.inf, v)

    def index(self, kind, column: str, sign: int):
        key = (kind, column, sign)
        if key not in self._made:
            self._made[key] = kind(self.values(column, sign))
        return self._made[key]

    def orders(self, column: str) -> Orders:
        if column not in self._made:
            self._made[column] = Orders(self.column[column].astype(np.float64))
        return self._made[column]

    def through(self, known: dict) -> np.ndarray:
        """Path rows up to and with each observation in the whole order (time and ties)."""
        n, asked = len(self.us), len(known[self.order[0]])
        parts = [np.concatenate([self.column[c], known[c]]) for c in self.order]
        if self.asked is not None:
            parts.insert(0, np.concatenate([self.column["_series"], self.asked]))
        by = np.lexsort((np.repeat([0, 1], [n, asked]), *reversed(parts)))
        upto = np.empty(n + asked, np.int64)
        upto[by] = np.cumsum(by < n)
        return upto[n:]

    def take(self, column: str, at: np.ndarray) -> np.ndarray:
        """Values at row numbers as doubles, NaN at -1."""
        v = self.column[column]
        return np.where(at >= 0, v[np.maximum(at, 0)].astype(np.float64), np.nan) if len(v) else np.full(len(at), np.nan)


def _stretch(reach: tuple[int, int]) -> int:
    return reach[1] - reach[0] + 1


class Ranged:
    """A question answered by ranges of rows alone, so that several series may share the indexes."""


@dataclass(frozen=True)
class Extreme(Ranged):
    """``kind`` (max or min) of a path column over (T, end) or (T, end]; NaN without rows. ``end`` names a column of the observation or of an earlier answer."""

    name: str
    kind: str
    column: str
    end: str
    inclusive: bool = True

    def answers(self) -> dict[str, str]:
        return {self.name: "double"}

    def ask(self, path: Path, now: np.ndarray, known: dict) -> dict[str, np.ndarray]:
        start = path.row(now, "right")
        end = path.row(known[self.end], "right" if self.inclusive else "left")
        sign = 1 if self.kind == "max" else -1
        found = path.index(RangeExtreme, self.column, sign).over(start, end) * sign
        return {self.name: np.where(np.isinf(found), np.nan, found)}


@dataclass(frozen=True)
class Neighbour(Ranged):
    """First path row at or after ``due`` (``ahead``), or the last at or before it, if within ``tolerance``; ``columns`` maps outputs to path columns."""

    due: str
    columns: dict[str, str]
    tolerance: int
    ahead: bool = True
    times: tuple[str, ...] = ()  # outputs that are whole microseconds

    def answers(self) -> dict[str, str]:
        return {n: "long" if n in self.times else "double" for n in self.columns}

    def ask(self, path: Path, now: np.ndarray, known: dict) -> dict[str, np.ndarray]:
        due = known[self.due]
        at = path.row(due, "left") if self.ahead else path.row(due, "right") - 1
        there = np.nonzero((at >= path.first) & (at < path.last))[0]
        there = there[np.abs(path.us[at[there]] - due[there]) <= self.tolerance]
        row = np.full(len(due), _NONE)
        row[there] = at[there]
        return {n: _whole(path, c, row) if n in self.times else path.take(c, row) for n, c in self.columns.items()}


@dataclass(frozen=True)
class Touch(Ranged):
    """First path row of (T, end] whose column reaches the level of the observation; gives ``<name>_<c>`` for ``carry``."""

    name: str
    column: str
    op: str
    level: str
    end: str
    carry: tuple[str, ...]
    times: tuple[str, ...] = ("us", "seq")
    otherwise: str | None = None  # the end where ``end`` is not known

    def answers(self) -> dict[str, str]:
        return {f"{self.name}_{c}": "long" if c in self.times else "double" for c in self.carry}

    def ask(self, path: Path, now: np.ndarray, known: dict) -> dict[str, np.ndarray]:
        until = known[self.end]
        if self.otherwise:
            until = np.where(np.isnan(until.astype(np.float64)), known[self.otherwise], until)
        start, end = path.row(now, "right"), path.row(until, "right")
        sign = 1 if self.op == ">=" else -1
        row = path.index(FirstReach, self.column, sign).within(start, end, known[self.level] * sign)
        return {f"{self.name}_{c}": _whole(path, c, row) if c in self.times else path.take(c, row) for c in self.carry}


def _trailing(path: Path, now: np.ndarray, known: dict, span: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``[T - span, T)``, or with ``own`` those up to the observation's own row."""
    start = path.row(now - span, "left")
    return start, np.maximum(path.through(known) if own else path.row(now, "left"), start)


@dataclass(frozen=True)
class TrailingRank(Ranged):
    """How many values of the trailing window there are, below the observation's ``value``, and equal to it."""

    name: str
    column: str
    value: str
    span: int
    own: bool = False

    def answers(self) -> dict[str, str]:
        return {f"{self.name}_{x}": "long" for x in ("count", "below", "equal")}

    def ask(self, path: Path, now: np.ndarray, known: dict) -> dict[str, np.ndarray]:
        start, end = _trailing(path, now, known, self.span, self.own)
        index, value = path.orders(self.column), known[self.value].astype(np.float64)
        usable = ~np.isnan(value)
        below = np.where(usable, index.below(start, end, value), 0)
        upto = np.where(usable, index.below(start, end, value, equal=True), 0)
        return {f"{self.name}_count": index.count(start, end), f"{self.name}_below": below, f"{self.name}_equal": upto - below}


@dataclass(frozen=True)
class TrailingQuantile(Ranged):
    """Quantile of the trailing window with linear interpolation; NaN over an empty one or fewer than ``least`` values."""

    name: str
    column: str
    q: float
    span: int
    own: bool = False
    least: int = 1

    def answers(self) -> dict[str, str]:
        return {self.name: "double"}

    def ask(self, path: Path, now: np.ndarray, known: dict) -> dict[str, np.ndarray]:
        start, end = _trailing(path, now, known, self.span, self.own)
        index = path.orders(self.column)
        n = index.count(start, end)
        who = np.nonzero(n >= max(1, self.least))[0]
        out = np.full(len(now), np.nan)
        at = self.q * (n[who] - 1)
        lower = np.floor(at).astype(np.int64)
        a = index.ranked(start[who], end[who], lower)
        b = index.ranked(start[who], end[who], np.minimum(lower + 1, n[who] - 1))
        share = at - lower
        out[who] = (1 - share) * a + share * b
        return {self.name: out}


def _whole(path: Path, column: str, at: np.ndarray) -> np.ndarray:
    """Whole numbers at row numbers, masked at -1."""
    v = path.column[column].astype(np.int64)
    found = v[np.maximum(at, 0)] if len(v) else np.zeros(len(at), np.int64)
    return np.ma.masked_array(found, at < 0)


def _arrow(values: np.ndarray, kind: str) -> pa.Array:
    if isinstance(values, np.ma.MaskedArray):
        return pa.array(values.data, pa.int64(), mask=np.ma.getmaskarray(values))
    return pa.array(values, pa.int64() if kind == "long" else pa.float64(), from_pandas=True)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers as they are, others as doubles with NaN for null."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy().astype(np.int64)
    return column.cast(pa.float64()).to_numpy()


def _density(path: DataFrame, keys: list[str], us: str, unit: int) -> tuple[int, int, int]:
    """Rows of the densest cell of ``unit`` and of the longest series, and how many series there are; counts combine before the shuffle."""
    n = F.col("_n")
    counts = path.groupBy(*keys, cell(us, unit).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    each = counts.groupBy(*keys).agg(F.max(n).alias("_n"), F.sum(n).alias("_all"))
    dense, longest, series = each.agg(F.max(n), F.max("_all"), F.count(F.lit(1))).first()
    return dense or 1, longest or 1, series


def _numbered(rows: pa.Table, mine: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the series of path rows and observations."""
    number = np.zeros(rows.num_rows + mine.num_rows, np.int64)
    for i, k in enumerate(keys):
        theirs = rows[f"_key{i}"]
        both = pa.chunked_array([*theirs.chunks, *mine[k].cast(theirs.type).chunks], theirs.type)
        code = both.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        number = np.unique(number * (int(code.max()) + 1) + code, return_inverse=True)[1]
    return number[: rows.num_rows], number[rows.num_rows :]


def along_path(
    obs: DataFrame, path: DataFrame, keys, questions: list, ahead: int = 0, us: str = "us", order=("us", "seq"), width: int | None = None, back: int = 0
) -> DataFrame:
    """Observations with the answers to ``questions`` about the path rows in ``[T - back, T + ahead]``.

    ``ahead`` bounds every end and due time, tolerance included, ``back`` every trailing span. A tile is ``width`` wide: by default the
    stretch in which the densest series has about ``TILE_ROWS`` rows, at least as long as a row is seen, so a path row goes to two tiles at most.
    Series of so few rows that ``FEWEST`` of them stay within ``TILE_ROWS`` are answered together, if all questions are ``Ranged``.
    """
    keys, order = list(keys), list(order)
    if width is None and ahead + back < DAY:
        dense, most, series = _density(path, keys, order[0], MINUTE_US)
        width = max(ahead + back, MINUTE_US, min(DAY, int(TILE_ROWS / dense) * MINUTE_US))
    else:
        width = width or ahead + back
        most, _, series = _density(path, keys, order[0], width)
        most *= 1 + -(-(ahead + back) // width)  # a tile holds the rows of those around it
    together = min(TILE_ROWS // most, (1 << 62) // (width + ahead + back + 2) // 8)
    parts = -(-series // together) if together >= FEWEST and series > 1 and all(isinstance(q, Ranged) for q in questions) else None
    needed: list[str] = []
    answers: dict[str, str] = {}
    for q in questions:
        used = list(q.columns.values()) if isinstance(q, Neighbour) else [q.column, *(q.carry if isinstance(q, Touch) else ())]
        needed += used
        answers |= q.answers()
    columns = [c for c in dict.fromkeys([*order, *needed]) if c not in keys]
    tiles = F.explode(F.sequence(cell(F.col(order[0]) - ahead, width), cell(F.col(order[0]) + back, width)))
    # new names: path and observations may come from one table
    seen = path.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[F.col(x).alias(x) for x in columns], tiles.alias("_cell"))
    asked = obs.withColumn("_tile", cell(us, width))
    types = {"long": T.LongType(), "double": T.DoubleType()}
    schema = T.StructType([*obs.schema.fields, *[T.StructField(n, types[k]) for n, k in answers.items()]])
    names = obs.columns
    inputs = {c for q in questions for f in ("end", "due", "level", "otherwise", "value") if (c := getattr(q, f, None)) in names}
    if any(getattr(q, "own", False) for q in questions):
        inputs |= set(order)

    def indexed(rows: pa.Table, mine: pa.Table) -> Path:
        if not parts:
            return Path(rows, order)
        here = rows["_cell"][0].as_py()
        reach = (here * width - back - 1, (here + 1) * width + ahead)
        return Path(rows.select(columns), order, *_numbered(rows, mine, keys), reach)

    def answer(rows: pa.Table, mine: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return _empty(mine, names, answers)
        index = indexed(rows, mine) if rows.num_rows else None
        known = {c: _numbers(mine[c]) for c in {us, *inputs}}
        now = known[us]
        found: dict[str, np.ndarray] = {}
        for q in questions:
            if index is None:
                got = {n: np.ma.masked_all(len(now), np.int64) if k == "long" else np.full(len(now), np.nan) for n, k in q.answers().items()}
            else:
                got = q.ask(index, now, known)
                if parts:  # a series without rows here has no answers
                    none = index.first == index.last
                    got = {n: np.ma.masked_where(none, v) if q.answers()[n] == "long" else np.where(none, np.nan, v) for n, v in got.items()}
            found |= got
            known |= {n: np.where(np.ma.getmaskarray(v), np.nan, v.data) if isinstance(v, np.ma.MaskedArray) else v for n, v in got.items()}
        out = mine.select(names)
        for n, kind in answers.items():
            out = out.append_column(n, _arrow(found[n], kind))
        return out

    if not parts:
        return seen.groupBy(*[f"_key{i}" for i in range(len(keys))], "_cell").cogroup(asked.groupBy(*keys, "_tile")).applyInArrow(answer, schema)
    # the same type on both sides: a hash depends on it
    dealt = {k: F.col(k).cast(path.schema[k].dataType) for k in keys}
    seen = seen.withColumn("_part", F.pmod(F.xxhash64(*[f"_key{i}" for i in range(len(keys))]), F.lit(parts)))
    asked = asked.withColumn("_part", F.pmod(F.xxhash64(*dealt.values()), F.lit(parts)))
    return seen.groupBy("_part", "_cell").cogroup(asked.groupBy("_part", "_tile")).applyInArrow(answer, schema)


def _empty(mine: pa.Table, names: list[str], answers: dict[str, str]) -> pa.Table:
    out = mine.select(names).slice(0, 0)
    for n, kind in answers.items():
        out = out.append_column(n, pa.array([], pa.int64() if kind == "long" else pa.float64()))
    return out
