"""Ordered series that stay parallel when one key holds most of the rows.

A series is a set of rows with keys and a dense position ``k``. When the longest series is
short (a measured bound) every operator is a plain window over the keys. Beyond that bound
series are cut into chunks of ``rows_per_chunk`` positions:

* ``windowed``  bounded frames: each chunk gets a copy of its neighbours' edge rows;
* ``running``   prefix aggregates: local prefix per chunk, a prefix over one summary row per
                chunk, and an equi join that adds the carry;
* ``kernel``    smoothing recurrences: each chunk continues from the exact state before it,
                composed from one summary row per chunk (see ``carry``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeworks.operators.carry import SUMMARY, Chunk, carried, states_of, summary_rows
from tapeworks.storage import materialize, materialize_counted

ROWS_PER_CHUNK = 100_000


@dataclass(frozen=True)
class Series:
    df: DataFrame
    keys: tuple[str, ...]
    max_rows: int
    rows_per_chunk: int
    settled: bool = False

    @property
    def chunked(self) -> bool:
        return self.max_rows > self.rows_per_chunk

    def with_df(self, df: DataFrame) -> Series:
        return replace(self, df=df, settled=False)

    def with_columns(self, cols: dict[str, Column]) -> Series:
        return self.with_df(self.df.withColumns(cols))

    def settle(self) -> Series:
        """Cut the plan before it is used more than once."""
        return self if self.settled else replace(self, df=materialize(self.df), settled=True)

    def _spread(self, back: int, ahead: int) -> DataFrame:
        """Rows copied to every chunk that may look at them; ``_home`` marks the original."""
        n = self.rows_per_chunk
        low = F.greatest(F.floor((F.col("k") - ahead) / n), F.lit(0))
        high = F.least(F.floor((F.col("k") + back) / n), F.lit((self.max_rows - 1) // n))
        return self.df.withColumn("_chunk", F.explode(F.sequence(low, high))).withColumn(
            "_home", F.col("_chunk") == F.floor(F.col("k") / n)
        )

    def windowed(self, build: Callable[[WindowSpec], dict[str, Column]], *, back: int = 0,
                 ahead: int = 0) -> Series:
        """Columns whose frames reach at most ``back``/``ahead`` positions away."""
        if not self.chunked:
            w = Window.partitionBy(*self.keys).orderBy("k")
            return self.with_columns(build(w))
        w = Window.partitionBy(*self.keys, "_chunk").orderBy("k")
        out = self._spread(back, ahead).withColumns(build(w))
        return self.with_df(out.where("_home").drop("_chunk", "_home"))

    def running(self, specs: dict[str, tuple[str, Column]]) -> Series:
        """Unbounded-preceding aggregates; kinds: sum, count, max, min, first, last.

        first and last skip NULLs.
        """
        if not self.chunked:
            w = Window.partitionBy(*self.keys).orderBy("k").rowsBetween(
                Window.unboundedPreceding, 0)
            return self.with_columns({o: _prefix(kind, c, w) for o, (kind, c) in specs.items()})
        part = [*self.keys, "_chunk"]
        base = self.settle().df.withColumn("_chunk", F.floor(F.col("k") / self.rows_per_chunk))
        inner = Window.partitionBy(*part).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        local = base.withColumns({o: _prefix(kind, c, inner) for o, (kind, c) in specs.items()})
        totals = base.groupBy(*part).agg(
            *[_total(kind, c).alias(f"_t_{o}") for o, (kind, c) in specs.items()]
        )
        outer = Window.partitionBy(*self.keys).orderBy("_chunk").rowsBetween(
            Window.unboundedPreceding, -1)
        merge = {"count": "sum"}
        carry = totals.select(*part, *[
            _prefix(merge.get(kind, kind), F.col(f"_t_{o}"), outer).alias(f"_c_{o}")
            for o, (kind, _) in specs.items()
        ])
        joined = local.join(carry, part, "left").withColumns(
            {o: _combine(kind, F.col(f"_c_{o}"), F.col(o)) for o, (kind, _) in specs.items()}
        )
        return self.with_df(joined.drop("_chunk", *[f"_c_{o}" for o in specs])).settle()

    def kernel(self, fn: Callable[[Chunk], dict[str, object]], ddl: str, *, levels: int = 1) -> Series:
        """Columns of smoothing recurrences; ``fn`` sees one chunk in order. A series of one chunk starts
        from nothing; of several, each level of smoothings is summed up, carried and then continued."""
        schema = StructType([*self.df.schema.fields, *StructType.fromDDL(ddl).fields])
        names, keys = schema.names, list(self.keys)
        if not self.chunked:
            def alone(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values("k", ignore_index=True)
                return pdf.assign(**fn(Chunk(pdf)))[names]

            return self.with_df(self.df.groupBy(*keys).applyInPandas(alone, schema))

        rows, part = self.settle()._spread(1, 0), [*keys, "_chunk"]
        summary = StructType([*(rows.schema[c] for c in part), *StructType.fromDDL(SUMMARY).fields])

        def chunk(pdf: pd.DataFrame, states: pd.DataFrame | None, upto: int | None) -> Chunk:
            pdf = pdf.sort_values("k", ignore_index=True)
            home = pdf["_home"].to_numpy(bool)
            return Chunk(pdf[home].reset_index(drop=True), pdf[~home], {} if states is None else states_of(states), upto)

        def summed(pdf: pd.DataFrame, states: pd.DataFrame | None, upto: int) -> pd.DataFrame:
            c = chunk(pdf, states, upto)
            if not len(c.rows):  # a copied edge row behind the end of a shorter series
                return pd.DataFrame(columns=summary.names)
            fn(c)
            return summary_rows(c).assign(**{k: pdf[k].iloc[0] for k in part})[summary.names]

        def resumed(pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
            c = chunk(pdf, states, None)
            return c.rows.assign(**fn(c))[names] if len(c.rows) else pd.DataFrame(columns=names)

        def at_level(level: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
            return lambda pdf, own: summed(pdf, own, level)

        states = None
        for level in range(levels):
            if states is None:
                found = rows.groupBy(*part).applyInPandas(lambda pdf: summed(pdf, None, 0), summary)
            else:
                found = rows.groupBy(*part).cogroup(states.groupBy(*part)).applyInPandas(at_level(level), summary)
            more = materialize(carried(found, keys, -(-self.max_rows // self.rows_per_chunk)))
            states = more if states is None else states.union(more)
        return self.with_df(rows.groupBy(*part).cogroup(states.groupBy(*part)).applyInPandas(resumed, schema))


def index_series(df: DataFrame, keys: tuple[str, ...] = ("symbol", "timeframe"), *,
                 order: str = "ts", tie: str | None = None, bucket: Column | None = None,
                 rows_per_chunk: int = ROWS_PER_CHUNK) -> Series:
    """Write ``df`` once, measure its longest series and number the rows from 0.

    ``tie`` orders rows of equal ``order``; without it their order is arbitrary.

    ``bucket`` must be monotone in ``order`` (default: the calendar month); long series are
    numbered per bucket plus an offset from the counts of the earlier buckets.
    """
    stored, n = materialize_counted(df)
    longest, by = n, [order] if tie is None else [order, tie]
    if n > rows_per_chunk:
        longest = stored.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if longest <= rows_per_chunk:
        w = Window.partitionBy(*keys).orderBy(*by)
        out = stored.withColumn("k", F.row_number().over(w).cast("bigint") - 1)
        return Series(out, keys, max(longest, 1), rows_per_chunk)
    cut = F.date_trunc("month", F.col(order)) if bucket is None else bucket
    tagged = stored.withColumn("_b", cut)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy(*keys, "_b").count().select(
        *keys, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off")
    )
    inner = Window.partitionBy(*keys, "_b").orderBy(*by)
    out = (
        tagged.withColumn("_r", F.row_number().over(inner))
        .join(offsets, [*keys, "_b"])
        .withColumn("k", F.col("_r") + F.col("_off") - 1)
        .drop("_b", "_r", "_off")
    )
    return Series(out, keys, longest, rows_per_chunk).settle()


def _prefix(kind: str, c: Column, w: WindowSpec) -> Column:
    if kind == "first":
        return F.first(c, ignorenulls=True).over(w)
    if kind == "last":
        return F.last(c, ignorenulls=True).over(w)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](c).over(w)


def _total(kind: str, c: Column) -> Column:
    at = F.when(c.isNotNull(), F.col("k"))
    if kind == "first":
        return F.min_by(c, at)
    if kind == "last":
        return F.max_by(c, at)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](c)


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(carry + local, local, carry)
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(carry, local) if kind == "first" else F.coalesce(local, carry)
