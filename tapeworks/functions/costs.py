"""Execution-cost expressions. Prices are ``*_price``, distances are ``*_pips``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.dims import NEWS_MULTIPLIER, SESSION_MULTIPLIERS, STRESS_FACTORS


@dataclass(frozen=True)
class CostTerms:
    """Columns (or literals) of one cost profile joined with its instrument."""

    spread_floor_pips: Column | float
    commission: Column | float
    slippage_fixed_pips: Column | float
    slippage_atr_k: Column | float
    pip_value: Column | float

    @staticmethod
    def from_columns() -> CostTerms:
        return CostTerms(
            F.col("spread_floor_pips"), F.col("commission_per_side_per_lot"),
            F.col("slippage_fixed_pips"), F.col("slippage_atr_k"), F.col("pip_value_per_lot"),
        )

    @staticmethod
    def literal(floor: float, commission: float, fixed: float, k: float,
                pip_value: float) -> CostTerms:
        return CostTerms(floor, commission, fixed, k, pip_value)


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def session_multiplier(session: Column) -> Column:
    """1.0 for unknown or missing sessions."""
    out = F.lit(1.0)
    for name, mult in SESSION_MULTIPLIERS.items():
        if mult != 1.0:
            out = F.when(session == name, mult).otherwise(out)
    return out


def _market(session: Column, news: Column, stress: Column) -> Column:
    return session_multiplier(session) * F.when(news, NEWS_MULTIPLIER).otherwise(1.0) * stress


def spread_cost_pips(t: CostTerms, *, realized: Column, session: Column, news: Column,
                     stress: Column) -> Column:
    """Paid once per round trip; never below the floor."""
    base = F.greatest(F.coalesce(realized, F.lit(0.0)), _c(t.spread_floor_pips))
    return base * _market(session, news, stress)


def slippage_pips(t: CostTerms, *, atr_pips: Column, is_stop: Column, session: Column,
                  news: Column, stress: Column) -> Column:
    """One fill; doubled on stops."""
    fill = atr_pips * t.slippage_atr_k + t.slippage_fixed_pips
    return fill * F.when(is_stop, 2.0).otherwise(1.0) * _market(session, news, stress)


def round_trip_pips(t: CostTerms, *, atr_pips: Column, session: Column | None = None,
                    realized: Column | None = None, exit_on_stop: Column | bool = False,
                    news: Column | bool = False, stress: Column | float = 1.0) -> Column:
    """Spread plus entry and exit slippage."""
    session, realized = _c(session).cast("string"), _c(realized).cast("double")
    exit_on_stop, news, stress = _c(exit_on_stop), _c(news), _c(stress)
    fill = dict(atr_pips=atr_pips, session=session, news=news, stress=stress)
    return (
        spread_cost_pips(t, realized=realized, session=session, news=news, stress=stress)
        + slippage_pips(t, is_stop=F.lit(False), **fill)
        + slippage_pips(t, is_stop=exit_on_stop, **fill)
    )


def round_trip_currency(t: CostTerms, *, lots: Column | float = 1.0, **kw) -> Column:
    """Pip cost in account currency plus both commissions; stress leaves commission alone."""
    return round_trip_pips(t, **kw) * t.pip_value * lots + _c(t.commission) * 2.0 * lots


def stress_sweep(df: DataFrame, factors: tuple[float, ...] = STRESS_FACTORS) -> DataFrame:
    """One copy of each row per stress factor."""
    return df.withColumn("stress", F.explode(F.array(*[F.lit(f) for f in factors])))


def price_to_pips(delta: Column, pip_size: Column) -> Column:
    return delta / pip_size


def pips_to_price(pips: Column, pip_size: Column) -> Column:
    return pips * pip_size
