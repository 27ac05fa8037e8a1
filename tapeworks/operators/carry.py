"""Exact state of smoothing recurrences between the chunks of a long series.

Every smoothing here waits for ``limit`` known values, takes a seed from them and then fades:
``y = (1-alpha)*y + alpha*x`` over known values. Over a chunk of ``m`` known values this is an
affine map of ``y``, so a chunk is summed up by ``m``, by what it adds to a faded zero, and by its
first ``limit`` values, which matter while the seed is still open. Summaries compose, so the state
before each chunk follows from one row a chunk; a chunk continues from it as if it had seen all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Chunks whose summaries are folded by one task; longer series fold blocks of them first.
FAN = 1000
#: A faded value below this is nothing: doubles lose their digits a little further down.
NOTHING = 1e-280


@dataclass(frozen=True)
class Smoothing:
    """``first``: the first value seeds, shown after ``period`` values. ``mean``: the mean of the first
    ``period`` values. ``floored``: their running mean, floored, is shown from the start and seeds."""

    alpha: float
    period: int
    seed: str = "first"
    floor: float = 0.0

    @property
    def limit(self) -> int:
        return 1 if self.seed == "first" else self.period

    def start(self, head: np.ndarray) -> float:
        return max(float(np.mean(head)), self.floor) if self.seed == "floored" else float(np.mean(head))


def fade(x: np.ndarray, alpha: float) -> np.ndarray:
    """y0 = x0; y = (1-alpha)*y + alpha*x."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


@dataclass(frozen=True)
class Summary:
    """A stretch of known values: how many, the first ``limit`` of them, and what they add to a faded zero."""

    m: int
    head: np.ndarray
    add: float

    @staticmethod
    def of(v: np.ndarray, how: Smoothing) -> Summary:
        return Summary(len(v), v[: how.limit], float(fade(np.concatenate(([0.0], v)), how.alpha)[-1]))

    def then(self, other: Summary, how: Smoothing) -> Summary:
        keep = (1 - how.alpha) ** other.m
        return Summary(self.m + other.m, np.concatenate((self.head, other.head))[: how.limit], keep * self.add + other.add)


@dataclass(frozen=True)
class State:
    """What a smoothing knows: values seen, the first ``limit`` of them, and ``y`` once those are there."""

    n: int = 0
    head: np.ndarray = field(default_factory=lambda: np.empty(0))
    y: float = float("nan")

    def after(self, s: Summary, how: Smoothing) -> State:
        a, q = how.alpha, how.limit - self.n
        head = np.concatenate((self.head, s.head))[: how.limit]
        if q <= 0:
            return State(self.n + s.m, self.head, (1 - a) ** s.m * self.y + s.add)
        if s.m < q:
            return State(self.n + s.m, head)
        early = a * (1 - a) ** np.arange(s.m - 1, s.m - q - 1, -1.0) @ s.head[:q]  # these went into the seed
        return State(self.n + s.m, head, (1 - a) ** (s.m - q) * how.start(head) + s.add - float(early))

    def run(self, v: np.ndarray, how: Smoothing) -> np.ndarray:
        """The smoothed known values; NaN where nothing is shown."""
        q, out = how.limit - self.n, np.full(len(v), np.nan)
        if how.seed == "floored" and q > 0:
            seen = np.concatenate((self.head, v[:q]))
            out[:q] = np.maximum(np.cumsum(seen) / np.arange(1, len(seen) + 1), how.floor)[self.n :]
        if q <= 0:
            out[:] = fade(np.concatenate(([self.y], v)), how.alpha)[1:]
        elif len(v) >= q:
            out[q - 1 :] = fade(np.concatenate(([how.start(np.concatenate((self.head, v[:q])))], v[q:])), how.alpha)
        if how.seed == "first":
            out[: max(0, how.period - 1 - self.n)] = np.nan
        return out


class Chunk:
    """Ordered rows of one chunk, with the row before it, as recurrence bodies see them.

    Smoothings are told apart by the order of their calls. ``level`` says how many others a
    smoothing's input went through. Below ``upto`` smoothings run from the carried states; at it they
    are summed up; what lies above is not known yet.
    """

    def __init__(self, rows: pd.DataFrame, lead: pd.DataFrame | None = None, states: dict[int, State] | None = None,
                 upto: int | None = None) -> None:
        self.rows, self.lead, self.states, self.upto = rows, lead, states or {}, upto
        self.summaries: dict[int, tuple[Smoothing, Summary]] = {}
        self.calls = 0

    def __getitem__(self, col: str) -> np.ndarray:
        return self.rows[col].to_numpy(float)

    def constant(self, col: str):
        return self.rows[col].iloc[0]

    def before(self, col: str) -> np.ndarray:
        """The column one row earlier."""
        first = float(self.lead[col].iloc[-1]) if self.lead is not None and len(self.lead) else np.nan
        return np.concatenate(([first], self[col][:-1]))

    def smooth(self, x: np.ndarray, how: Smoothing, level: int = 0) -> np.ndarray:
        """Smoothed known values of ``x``; NaN at unknown ones and while warming."""
        call, self.calls = self.calls, self.calls + 1
        out, seen = np.full(len(x), np.nan), ~np.isnan(x)
        if self.upto is None or level < self.upto:
            out[seen] = self.states.get(call, State()).run(x[seen], how)
        elif level == self.upto:
            self.summaries[call] = (how, Summary.of(x[seen], how))
        return out


_HOW = "call INT, alpha DOUBLE, period INT, seed STRING, floor DOUBLE"
SUMMARY = f"{_HOW}, m BIGINT, head ARRAY<DOUBLE>, add DOUBLE"
STATE = "call INT, n BIGINT, head ARRAY<DOUBLE>, y DOUBLE"


def summary_rows(chunk: Chunk) -> pd.DataFrame:
    rows = [(c, h.alpha, h.period, h.seed, h.floor, s.m, s.head.tolist(), s.add) for c, (h, s) in chunk.summaries.items()]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMARY.split(", ")])


def states_of(rows: pd.DataFrame) -> dict[int, State]:
    return {r.call: State(int(r.n), np.asarray(r.head, float), np.nan if r.y is None else float(r.y)) for r in rows.itertuples()}


def _folded(pdf: pd.DataFrame) -> Iterator[tuple[int, Smoothing, Summary]]:
    for r in pdf.itertuples():
        yield r.call, Smoothing(r.alpha, r.period, r.seed, r.floor), Summary(int(r.m), np.asarray(r.head, float), r.add)


def carried(summaries: DataFrame, keys: list[str], chunks: int) -> DataFrame:
    """States before every chunk from (keys, _chunk, summary); a task folds at most ``FAN`` rows, and
    a key's blocks of them."""
    schema = {c: summaries.schema[c] for c in keys}
    head = StructType(list(schema.values()))
    step = StructType([*head.fields, *StructType.fromDDL(f"_chunk BIGINT, {STATE}").fields])
    total = StructType([*head.fields, *StructType.fromDDL(f"_block BIGINT, {SUMMARY}").fields])

    def walk(pdf: pd.DataFrame, state: State, at: str) -> pd.DataFrame:
        pdf, out = pdf.sort_values(at), []
        key = [pdf[c].iloc[0] for c in keys]
        for place, (call, how, s) in zip(pdf[at], _folded(pdf)):
            out.append((*key, place, call, state.n, state.head.tolist(), state.y))
            state = state.after(s, how)
        return pd.DataFrame(out, columns=step.names)

    if chunks <= FAN:
        return summaries.groupBy(*keys, "call").applyInPandas(lambda pdf: walk(pdf, State(), "_chunk"), step)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, both = pdf.sort_values("_chunk"), None
        for _, how, s in _folded(pdf):
            both = s if both is None else both.then(s, how)
        first = pdf.iloc[:1]
        return first.assign(m=both.m, head=[both.head.tolist()], add=both.add)[total.names]

    blocked = summaries.withColumn("_block", F.floor(F.col("_chunk") / FAN))
    blocks = blocked.groupBy(*keys, "call", "_block").applyInPandas(join, total)
    starts = blocks.groupBy(*keys, "call").applyInPandas(lambda pdf: walk(pdf, State(), "_block"), step).withColumnRenamed("_chunk", "_block")
    group = [*keys, "call", "_block"]

    def go_on(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        return walk(rows, states_of(start)[int(rows["call"].iloc[0])], "_chunk")

    return blocked.groupBy(*group).cogroup(starts.groupBy(*group)).applyInPandas(go_on, step)
