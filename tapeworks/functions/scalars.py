"""Scalar column expressions of the signal and trade domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mid_price(ask: Column, bid: Column) -> Column:
    return (ask + bid) / 2


def normalize_symbol(s: Column) -> Column:
    """Canonical 'XXX/YYY' from canonical, underscore or compact spelling; NULL otherwise."""
    slashed = F.replace(s, F.lit("_"), F.lit("/"))
    compact = F.concat(F.substring(s, 1, 3), F.lit("/"), F.substring(s, 4, 3))
    return F.when(slashed.contains("/"), slashed).when(F.length(s) == 6, compact)


def pip_size_heuristic(symbol: Column) -> Column:
    up = F.upper(symbol)
    return (
        F.when(up.contains("JPY"), 0.01)
        .when(up.contains("XAU") | up.contains("GOLD"), 0.1)
        .when(up.contains("XAG") | up.contains("SILVER"), 0.01)
        .otherwise(0.00001)
    )


def signal_id(symbol: Column, ts: Column, source: Column) -> Column:
    """First 16 hex digits of sha256 over 'symbol|iso instant|source'; the instant has its six
    fraction digits unless they are zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    iso = F.concat(whole, part, F.lit("+00:00"))
    return F.substring(F.sha2(F.concat_ws("|", symbol, iso, source), 256), 1, 16)


def _scaled(raw: Column, ceiling: int, full: int) -> Column:
    """Half-even rounding of raw*ceiling/full, capped at the ceiling."""
    return F.least(F.bround(raw * ceiling / full).cast("int"), F.lit(ceiling))


def score_structure(trend: Column, h1: Column, m15: Column, ceiling: int = 30) -> Column:
    on = trend != "FLAT"
    raw = (
        F.when(on, 15).otherwise(0)
        + F.when(on & (h1 == trend), 10).otherwise(0)
        + F.when(on & (m15 == trend), 5).otherwise(0)
    )
    return _scaled(raw, ceiling, 30)


def score_momentum(entry: Column, sl: Column, tp: Column, ceiling: int = 30) -> Column:
    raw = (
        F.when(entry.isNotNull(), 15).otherwise(0)
        + F.when(sl.isNotNull(), 10).otherwise(0)
        + F.when(tp.isNotNull(), 5).otherwise(0)
    )
    return _scaled(raw, ceiling, 30)


def score_session(ts: Column, ceiling: int = 20) -> Column:
    """Fixed UTC hours: overlap 20, London 16, New York 14, Asia 8, weekend 0."""
    h = F.hour(ts)
    raw = (
        F.when(F.weekday(ts) >= 5, 0)
        .when(h.between(13, 16), 20)
        .when(h.between(8, 12), 16)
        .when(h.between(17, 21), 14)
        .when(h < 8, 8)
        .otherwise(0)
    )
    return _scaled(raw, ceiling, 20)


def stop_pips(entry: Column, sl: Column, pip: float) -> Column:
    return F.abs(entry - sl) / pip


def reward_risk(entry: Column, sl: Column, tp: Column, pip: float) -> Column:
    risk = stop_pips(entry, sl, pip)
    return F.when(risk > 0, F.abs(tp - entry) / pip / risk)


def score_cost(entry: Column, sl: Column, tp: Column, ceiling: int = 20, *, pip: float = 0.1,
               min_sl_pips: float = 15.0, min_rr: float = 1.5) -> Column:
    ok = entry.isNotNull() & sl.isNotNull()
    raw = F.when(stop_pips(entry, sl, pip) >= min_sl_pips, 10).otherwise(0) + F.when(
        reward_risk(entry, sl, tp, pip) >= min_rr, 10
    ).otherwise(0)
    return F.when(ok, _scaled(raw, ceiling, 20)).otherwise(0)


def score_label(total: Column) -> Column:
    return F.when(total >= 70, "HIGH").when(total >= 50, "MEDIUM").otherwise("LOW")


def confidence_bucket(pct: Column, n: Column) -> Column:
    return (
        F.when(n < 20, "Unproven").when(pct >= 0.65, "High").when(pct >= 0.52, "Moderate")
        .otherwise("Low")
    )


def wilson_lower(wins: Column, n: Column, z: float = 1.645) -> Column:
    """Lower bound of the Wilson interval, clipped to 0..1."""
    p, z2 = wins / n, z * z
    centre = p + F.lit(z2) / (n * 2)
    half = F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z2) / (n * n * 4)) * z
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (centre - half) / (F.lit(z2) / n + 1)))


def bars_held(seconds: Column, bar_seconds: int = 14_400) -> Column:
    return F.bround(seconds / bar_seconds).cast("int")


def lifecycle_status(exit_kind: Column) -> Column:
    return (
        F.when(exit_kind == "EXIT_TP", "win").when(exit_kind == "EXIT_SL", "loss")
        .when(exit_kind == "EXIT_SIGNAL", "expired")
    )


def weights_valid(*weights: Column) -> Column:
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    return total == 100


def content_hash(payload: Column) -> Column:
    """sha256 of a struct's JSON; declare struct fields in sorted order."""
    return F.sha2(F.to_json(payload), 256)


def normalize_names(a: Column, aliases: dict[str, str] | None = None) -> Column:
    """Trim, upper-case, drop blanks, apply aliases, sort and deduplicate."""
    out = F.transform(a, lambda s: F.upper(F.trim(s)))
    for src, dst in (aliases or {}).items():
        out = F.transform(out, _renamer(src, dst))
    return F.array_sort(F.array_distinct(F.filter(out, lambda s: s != "")))


def prefs_json(prefs: Column) -> Column:
    """Preferences as JSON text with sorted arrays."""
    return F.to_json(F.struct(
        F.array_sort(prefs["pairs"]).alias("pairs"), F.array_sort(prefs["sessions"]).alias("sessions"),
        prefs["min_score"].alias("min_score")))


def weights_json(structure: Column, momentum: Column, session: Column, cost: Column) -> Column:
    """Score weights as JSON text; NULL unless they sum to 100."""
    body = F.to_json(F.struct(
        structure.alias("structure"), momentum.alias("momentum"), session.alias("session"), cost.alias("cost")))
    return F.when(weights_valid(structure, momentum, session, cost), body)


def _renamer(src: str, dst: str):
    return lambda s: F.when(s == src, dst).otherwise(s)


def falsy(col: Column) -> Column:
    """Number in a price event's text; NULL when absent, unparseable or 0."""
    return F.nullif(col.try_cast("double"), F.lit(0.0))
