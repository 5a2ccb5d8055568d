"""Recursions over streams without a stream in one task.

What a recursion does to its state over a stretch of rows is a function that can be
written down: for an affine recursion a matrix and a vector, for a one-sided envelope a
rising line of pieces. Each time bucket of a stream finds its own function from its rows
alone; over the table of buckets, one row for each, the functions are applied one behind
the other, which gives the state that each bucket begins with; then each bucket runs
once more from there. Rows are dealt once by stream and bucket, as in ordering.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import BUCKET, bucketed
from .streams import Stream

Columns = dict[str, np.ndarray]


class Chain(Protocol):
    """A recursion. cuts are where segments (stretches of one bucket in a batch) begin, with the batch's length behind them."""

    start: list[float]
    made: dict[str, int]  # name of a column -> place in the state

    def summaries(self, cols: Columns, cuts: np.ndarray, carry: np.ndarray | None) -> list[np.ndarray]:
        """The function of each segment; carry is that of the first one's rows in earlier batches."""

    def apply(self, summary: np.ndarray, state: np.ndarray) -> np.ndarray: ...

    def run(self, cols: Columns, cuts: np.ndarray, states: list[np.ndarray]) -> np.ndarray:
        """States after each row (rows x state), from the state that each segment begins with."""


def affine_scan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x[n] = a[n] @ x[n - 1] + b[n] from zero, for matrices a (n, d, d) and b (n, d, c): in about 2 sqrt(n) steps, each over sqrt(n) lanes."""
    n, d, c = b.shape
    steps = max(1, int(np.ceil(np.sqrt(n))))
    lanes = -(-n // steps)
    pad = lanes * steps - n
    if pad:
        a = np.concatenate([a, np.broadcast_to(np.eye(d), (pad, d, d))])
        b = np.concatenate([b, np.zeros((pad, d, c))])
    a, b = a.reshape(lanes, steps, d, d), b.reshape(lanes, steps, d, c)
    x, p = np.empty_like(b), np.empty_like(a)
    x[:, 0], p[:, 0] = b[:, 0], a[:, 0]
    for i in range(1, steps):
        x[:, i] = a[:, i] @ x[:, i - 1] + b[:, i]
        p[:, i] = a[:, i] @ p[:, i - 1]
    begins = np.zeros((lanes, d, c))
    for m in range(1, lanes):
        begins[m] = p[m - 1, -1] @ begins[m - 1] + x[m - 1, -1]
    return (x + p @ begins[:, None]).reshape(lanes * steps, d, c)[:n]


@dataclass(frozen=True)
class Affine:
    """state = a @ state + b for each row; maps gives a (d, d) or (rows, d, d), and b (rows, d), from the columns."""

    start: list[float]
    maps: Callable[[Columns], tuple[np.ndarray, np.ndarray]]
    made: dict[str, int]

    def _both(self, cols: Columns) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.maps(cols)
        return (np.broadcast_to(a, (len(b), *a.shape)) if a.ndim == 2 else a).astype(float, copy=True), b.astype(float, copy=True)

    def summaries(self, cols: Columns, cuts: np.ndarray, carry: np.ndarray | None) -> list[np.ndarray]:
        a, b = self._both(cols)
        d = len(self.start)
        x = np.concatenate([a, b[:, :, None]], 2)  # matrix and vector side by side
        first = cuts[:-1]
        if carry is not None:
            x[0] = a[0] @ carry.reshape(d, d + 1) + np.pad(b[0][:, None], ((0, 0), (d, 0)))
        inner = np.ones(len(b), bool)
        inner[first] = False
        x[inner, :, :d] = 0
        a[first] = 0
        return list(affine_scan(a, x)[cuts[1:] - 1].reshape(len(first), -1))

    def apply(self, summary: np.ndarray, state: np.ndarray) -> np.ndarray:
        d = len(self.start)
        x = summary.reshape(d, d + 1)
        return x[:, :d] @ state + x[:, d]

    def run(self, cols: Columns, cuts: np.ndarray, states: list[np.ndarray]) -> np.ndarray:
        a, b = self._both(cols)
        first = cuts[:-1]
        b[first] += np.einsum("nij,nj->ni", a[first], np.array(states))
        a[first] = 0
        return affine_scan(a, b[:, :, None])[:, :, 0]


@dataclass(frozen=True)
class Envelope:
    """A level that follows the size of a column's values, by one share of the difference where it rises and another where it falls.

    Both are rising functions of the level, so a stretch of rows is a rising line of
    pieces: places where the level may begin, the levels that these end at, and the
    slope beyond the last. A row adds a bend only where its value lies within what the
    line still spans, which shrinks with every row.
    """

    column: str
    attack: float
    decay: float
    made: dict[str, int]
    start: list[float] = (0.0,)

    def summaries(self, cols: Columns, cuts: np.ndarray, carry: np.ndarray | None) -> list[np.ndarray]:
        x, out = np.abs(cols[self.column]).tolist(), []
        up, down = self.attack, self.decay
        for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            places, levels, slope = [0.0], [0.0], 1.0
            if k == 0 and carry is not None:
                half = (len(carry) - 1) // 2
                places, levels, slope = carry[:half].tolist(), carry[half:-1].tolist(), float(carry[-1])
            for v in x[i:j]:
                if v != v:
                    continue
                if slope < 1e-30:  # no level that a stream may have gets here
                    slope = 0.0
                if v > levels[-1]:
                    if slope:
                        places.append(places[-1] + (v - levels[-1]) / slope)
                        levels.append(v)
                elif v > levels[0]:
                    at = next(m for m in range(1, len(levels)) if levels[m] >= v)
                    if levels[at] > v:
                        places.insert(at, places[at - 1] + (places[at] - places[at - 1]) * (v - levels[at - 1]) / (levels[at] - levels[at - 1]))
                        levels.insert(at, v)
                levels = [y + (up if v > y else down) * (v - y) for y in levels]
                slope *= 1 - (up if v > levels[-1] else down)
                if len(levels) > 32:  # pieces that have become flat
                    keep = [m for m in range(len(levels)) if m in (0, len(levels) - 1) or levels[m - 1] < levels[m] or levels[m] < levels[m + 1]]
                    places, levels = [places[m] for m in keep], [levels[m] for m in keep]
            out.append(np.array([*places, *levels, slope]))
        return out

    def apply(self, summary: np.ndarray, state: np.ndarray) -> np.ndarray:
        half = (len(summary) - 1) // 2
        places, levels = summary[:half], summary[half:-1]
        beyond = max(float(state[0]) - places[-1], 0.0)
        return np.array([float(np.interp(state[0], places, levels)) + (summary[-1] * beyond if beyond else 0.0)])

    def run(self, cols: Columns, cuts: np.ndarray, states: list[np.ndarray]) -> np.ndarray:
        x, out = np.abs(cols[self.column]).tolist(), []
        for i, j, s in zip(cuts[:-1], cuts[1:], states, strict=True):
            level = float(s[0])
            for v in x[i:j]:
                if v == v:
                    level += (self.attack if v > level else self.decay) * (v - level)
                out.append(level)
        return np.array(out)[:, None]


@dataclass(frozen=True)
class Kept:
    """The last kept value of a column, where a row is kept if it differs from that by more than a threshold; nulls never are.

    Over a stretch of rows the levels that keep none of them are those near enough to
    its least and its greatest value; a level that drops out at a row goes on from that
    row's value. So a stretch is a list of least and greatest values so far, each with
    the level that those which drop out there end with, and one for a stream that has
    kept nothing yet. Levels are compared with these values just as a row is with its
    level, so rounding is the same; bounds of levels would round otherwise.
    Once no level is near enough to both, no later row adds to the list.
    """

    column: str
    threshold: float
    made: dict[str, int]
    start: list[float] = (float("nan"), 0.0)

    def _end(self, x: list[float], i: int, known: dict[int, float]) -> float:
        """The level after all of x if row i is kept."""
        path, last = [i], x[i]
        for j in range(i + 1, len(x)):
            if abs(x[j] - last) > self.threshold:
                if j in known:
                    last = known[j]
                    break
                path.append(j)
                last = x[j]
        known.update(dict.fromkeys(path, last))
        return last

    def summaries(self, cols: Columns, cuts: np.ndarray, carry: np.ndarray | None) -> list[np.ndarray]:
        values, out = cols[self.column], []
        apart = 2 * self.threshold * (1 + 1e-9)  # more than any rounding
        for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = values[i:j]
            x = part[~np.isnan(part)].tolist()
            known: dict[int, float] = {}
            steps: list[list[float]] = []
            low, high, none = np.inf, -np.inf, self._end(x, 0, known) if x else np.nan
            for n, v in enumerate(x):
                if high - low > apart:
                    break
                if v < low or v > high:
                    low, high = min(low, v), max(high, v)
                    steps.append([low, high, self._end(x, n, known)])
            if k == 0 and carry is not None:
                own = np.array([none, *[v for step in steps for v in step]])
                before = carry[1:].reshape(-1, 3)
                first = self.apply(own, np.array([carry[0], 0.0]))[0]
                low, high = before[-1][:2] if len(before) else (np.inf, -np.inf)
                moved = [[a, b, self.apply(own, np.array([c, 0.0]))[0]] for a, b, c in before]
                steps = moved + [[min(low, a), max(high, b), c] for a, b, c in steps if (a < low or b > high) and not high - low > apart]
                none = first
            out.append(np.array([none, *[v for step in steps for v in step]]))
        return out

    def apply(self, summary: np.ndarray, state: np.ndarray) -> np.ndarray:
        v = float(state[0])
        if v != v:
            return np.array([summary[0], 0.0])
        steps = summary[1:].reshape(-1, 3)
        out = np.flatnonzero((v - steps[:, 0] > self.threshold) | (steps[:, 1] - v > self.threshold))
        return np.array([steps[out[0], 2] if len(out) else v, 0.0])

    def run(self, cols: Columns, cuts: np.ndarray, states: list[np.ndarray]) -> np.ndarray:
        x, out = cols[self.column].tolist(), np.zeros((cuts[-1], 2))
        for i, j, s in zip(cuts[:-1], cuts[1:], states, strict=True):
            last = float(s[0])
            for n in range(i, j):
                kept = x[n] == x[n] and (last != last or abs(x[n] - last) > self.threshold)
                last = x[n] if kept else last
                out[n] = last, kept
        return out


def _cuts(first: np.ndarray) -> tuple[np.ndarray, bool]:
    """Where segments begin and end, and whether the first goes on one of the batch before."""
    begins = np.flatnonzero(first)
    going = not first[0]
    return np.concatenate([[0] if going else [], begins, [len(first)]]).astype(np.int64), going


def _numbers(b: pa.RecordBatch, inputs: Sequence[str]) -> Columns:
    return {c: b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in inputs}


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))


def _summarise(chain: Chain, keys: list[str], inputs: list[str]):
    names = [*keys, BUCKET]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, carry = None, None

        def row(own: pa.RecordBatch, summaries: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*own.columns, _lists(summaries)], names=[*names, "__summary"])

        for b in batches:
            if not len(b):
                continue
            cuts, going = _cuts(b.column("__n").to_numpy() == 1)
            if held is not None and not going:
                yield row(held, [carry])
            found = chain.summaries(_numbers(b, inputs), cuts, carry if going else None)
            if len(found) > 1:
                yield row(b.select(names).take(pa.array(cuts[:-2])), found[:-1])
            held, carry = b.select(names).slice(cuts[-2], 1), found[-1]
        if held is not None:
            yield row(held, [carry])

    return run


def _incoming(chain: Chain, keys: list[str]):
    names = [*keys, BUCKET]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.array(chain.start)
        for b in batches:
            first, summaries, out = b.column("__n").to_numpy() == 1, b.column("__summary").to_pylist(), []
            for f, s in zip(first, summaries, strict=True):
                state = np.array(chain.start) if f else state
                out.append(state)
                state = chain.apply(np.array(s), state)
            yield pa.RecordBatch.from_arrays([*b.select(names).columns, _lists(out)], names=[*names, "__state"])

    return run


def _finish(chain: Chain, kept: list[str], inputs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            if not len(b):
                continue
            cuts, going = _cuts(b.column("__n").to_numpy() == 1)
            begins = [np.array(b.column("__state")[int(i)].as_py()) for i in cuts[:-1]]
            states = chain.run(_numbers(b, inputs), cuts, [carry, *begins[1:]] if going else begins)
            carry = states[-1]
            yield pa.RecordBatch.from_arrays([*b.select(kept).columns, *[pa.array(states[:, k]) for k in chain.made.values()]], names=[*kept, *chain.made])

    return run


def chained(df: DataFrame, s: Stream, chain: Chain, inputs: list[str]) -> DataFrame:
    """df with the chain's columns: what its recursion over each stream's rows holds after each row.

    inputs are numeric columns that it reads; a null is NaN there. Rows without a time
    belong to no stream and are left out.
    """
    keys = [*s.keys]
    inside = Window.partitionBy(*keys, BUCKET).orderBy(s.ts, *s.ties)
    rows = bucketed(df, s.ts, s.unit, keys).repartition(*[F.col(k) for k in keys], F.col(BUCKET))
    place = {f.name: f for f in rows.schema.fields}
    part = T.StructType([place[c] for c in (*keys, BUCKET)])
    floats = T.ArrayType(T.DoubleType())
    order = [*keys, BUCKET, s.ts, *s.ties]
    own = rows.select(*dict.fromkeys([*order, *inputs])).withColumn("__n", F.row_number().over(inside)).sortWithinPartitions(*order)
    table = own.mapInArrow(_summarise(chain, keys, inputs), T.StructType([*part.fields, T.StructField("__summary", floats)]))
    line = Window.partitionBy(*keys).orderBy(BUCKET)
    table = table.withColumn("__n", F.row_number().over(line)).sortWithinPartitions(*keys, BUCKET)
    begins = table.mapInArrow(_incoming(chain, keys), T.StructType([*part.fields, T.StructField("__state", floats)]))
    names = {c: f"__r_{c}" for c in (*keys, BUCKET)}
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    joined = rows.join(begins.withColumnsRenamed(names), same).drop(*names.values())
    joined = joined.withColumn("__n", F.row_number().over(inside)).sortWithinPartitions(*order)
    kept = [c for c in df.columns if c not in chain.made]
    return joined.mapInArrow(_finish(chain, kept, inputs), T.StructType([*[place[c] for c in kept], *[T.StructField(c, T.DoubleType()) for c in chain.made]]))
