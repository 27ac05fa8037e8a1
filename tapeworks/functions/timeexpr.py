"""Session, calendar and bar-grid expressions over UTC timestamps (JVM-side only)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.dims import SESSIONS

_ZONES = {name: (tz, start, end) for name, tz, start, end in SESSIONS}
NEW_YORK = "America/New_York"


def _minute_of_day(local: Column) -> Column:
    return F.hour(local) * 60 + F.minute(local)


def bar_floor(ts: Column, minutes: int) -> Column:
    """Start of the epoch-aligned interval that holds ``ts``."""
    step = minutes * 60_000_000
    us = F.unix_micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(step)))


def next_bar_close(ts: Column, minutes: int) -> Column:
    """First interval boundary strictly after ``ts``."""
    step = minutes * 60_000_000
    us = F.unix_micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(step)) + F.lit(step))


def in_session(ts: Column, name: str) -> Column:
    """Local wall time inside the session's [start, end); bounds are whole hours, so one hour
    lookup decides."""
    tz, start, end = _ZONES[name]
    return F.hour(F.from_utc_timestamp(ts, tz)).isin(*range(start, end))


def active_sessions(ts: Column) -> Column:
    """Array of active sessions; OVERLAP is appended while London and New York overlap."""
    overlap = in_session(ts, "LONDON") & in_session(ts, "NEWYORK")
    slots = [F.when(in_session(ts, n), F.lit(n)) for n, *_ in SESSIONS]
    slots.append(F.when(overlap, F.lit("OVERLAP")))
    return F.filter(F.array(*slots), lambda s: s.isNotNull())


def primary_session(ts: Column) -> Column:
    """OVERLAP > LONDON > NEWYORK > ASIA, NULL off-hours."""
    london, ny = in_session(ts, "LONDON"), in_session(ts, "NEWYORK")
    return (
        F.when(london, F.when(ny, "OVERLAP").otherwise("LONDON"))
        .when(ny, "NEWYORK")
        .when(in_session(ts, "ASIA"), "ASIA")
    )


def session_bounds(day: Column, name: str) -> tuple[Column, Column]:
    """UTC [start, end) of a session for a local calendar day."""
    tz, start, end = _ZONES[name]
    midnight = day.cast("timestamp")

    def at(hour: int) -> Column:
        return F.to_utc_timestamp(midnight + F.make_dt_interval(hours=F.lit(hour)), tz)

    return at(start), at(end)


def overlap_bounds(day: Column) -> tuple[Column, Column]:
    """UTC intersection of London and New York for a local day; NULLs when empty."""
    ls, le = session_bounds(day, "LONDON")
    ns, ne = session_bounds(day, "NEWYORK")
    start, end = F.greatest(ls, ns), F.least(le, ne)
    return F.when(start < end, start), F.when(start < end, end)


def coarse_market_open(ts: Column) -> Column:
    """Closed from Friday 21:00 to Sunday 21:00 UTC."""
    wd, minute = F.weekday(ts), _minute_of_day(ts)
    closed = (wd == 5) | ((wd == 4) & (minute >= 1260)) | ((wd == 6) & (minute < 1260))
    return ~closed


def trading_day(ts: Column) -> Column:
    """New York date that rolls at 17:00 local."""
    return F.to_date(F.from_utc_timestamp(ts, NEW_YORK) - F.expr("INTERVAL 17 HOURS"))


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday of any year, in integer arithmetic: the paschal full moon from the
    place in the lunar cycle and the century's corrections, then the Sunday after it."""
    y = year.cast("int")
    century, cycle = F.floor(y / 100), y % 19
    solar, lunar = century - F.floor(century / 4), F.floor((8 * century + 13) / 25)
    epact = (19 * cycle + solar - lunar + 15) % 30
    full = epact - F.when((epact == 29) | ((epact == 28) & (cycle > 10)), 1).otherwise(0)  # days after 21 March
    moon = F.date_add(F.make_date(y, F.lit(3), F.lit(21)), full.cast("int"))
    return F.date_add(moon, (7 - (F.weekday(moon) + 1) % 7).cast("int"))


def _kind(day: Column, m: Column, d: Column, wd: Column) -> Column:
    """'closed', 'half' or NULL. Weekday rules become day-of-month ranges: the n-th weekday
    of a month lies in days 7n-6 .. 7n."""
    md = m * 100 + d
    mon, thu, fri = wd == 0, wd == 3, wd == 4
    closed = (
        md.isin(101, 1225, 1226)
        | ((md == 704) & (wd < 5)) | ((md == 703) & fri) | ((md == 705) & mon)
        | (thu & md.between(1122, 1128))
        | (mon & (md.between(115, 121) | md.between(215, 221) | md.between(525, 531)
                  | md.between(901, 907)))
        | (fri & m.isin(3, 4) & (F.date_add(day, 2) == easter(F.year(day))))
    )
    half = (fri & md.between(1123, 1129)) | (md == 1224)
    return F.when(closed, "closed").when(half, "half")


def holiday_kind(day: Column) -> Column:
    """Closure kind of a local date under the computed US/UK calendar."""
    return _kind(day, F.month(day), F.dayofmonth(day), F.weekday(day))


def holiday_calendar(years: DataFrame, year: str = "year") -> DataFrame:
    """One row per closure or half day of each given year."""
    day = F.explode(
        F.sequence(F.make_date(F.col(year), F.lit(1), F.lit(1)),
                   F.make_date(F.col(year), F.lit(12), F.lit(31)))
    )
    return (
        years.select(F.col(year), day.alias("day"))
        .withColumn("kind", holiday_kind(F.col("day")))
        .where(F.col("kind").isNotNull())
    )


def with_market_open(df: DataFrame, ts: str = "ts", out: str = "is_open",
                     calendar: DataFrame | None = None) -> DataFrame:
    """Holiday- and DST-aware openness of a UTC instant.

    The local time and its parts are staged as projections, so each is computed once per row
    inside one generated stage. ``calendar`` (day, kind) replaces the computed holidays.
    """
    keep = df.columns
    local = F.col("_local")
    df = df.withColumn("_local", F.from_utc_timestamp(F.col(ts), NEW_YORK))
    df = df.withColumns({
        "_day": F.to_date(local), "_m": F.month(local), "_d": F.dayofmonth(local),
        "_wd": F.weekday(local), "_min": _minute_of_day(local),
    })
    if calendar is None:
        df = df.withColumn("_kind", _kind(*[F.col(c) for c in ("_day", "_m", "_d", "_wd")]))
    else:
        dim = calendar.select(F.col("day").alias("_day"), F.col("kind").alias("_kind"))
        df = df.join(dim, "_day", "left")
    kind, wd, minute = F.coalesce(F.col("_kind"), F.lit("")), F.col("_wd"), F.col("_min")
    shut = (
        (kind == "closed") | (wd == 5) | ((wd == 4) & (minute >= 1020))
        | ((kind == "half") & (minute >= 720)) | ((wd == 6) & (minute < 1020))
    )
    return df.select(*keep, (~shut).alias(out))


def next_weekday_time(ts: Column, weekday: int, hour: int) -> Column:
    """Next given weekday (Mon=0) at a UTC hour, strictly after ``ts``."""
    ahead = F.pmod(F.lit(weekday) - F.weekday(ts), F.lit(7)).cast("int")
    slot = F.date_add(F.to_date(ts), ahead).cast("timestamp") + F.make_dt_interval(
        hours=F.lit(hour)
    )
    return F.when(slot <= ts, slot + F.make_dt_interval(days=F.lit(7))).otherwise(slot)


def next_business_time(ts: Column, hour: int) -> Column:
    """Next Mon-Fri occurrence of a UTC hour, strictly after ``ts``."""
    late = _minute_of_day(ts) * 60 + F.second(ts) >= hour * 3600
    day = F.date_add(F.to_date(ts), F.when(late, 1).otherwise(0))
    skip = F.when(F.weekday(day) == 5, 2).when(F.weekday(day) == 6, 1).otherwise(0)
    return F.date_add(day, skip).cast("timestamp") + F.make_dt_interval(hours=F.lit(hour))


# Recurring report events (name -> rule kind and arguments, UTC).
SCHEDULE = [
    ("BAR_CLOSE_15M", "bar", 15, None),
    ("MARKET_OPEN", "weekday", 6, 22),
    ("MARKET_CLOSE", "weekday", 4, 21),
    ("WEEKLY_REPORT", "weekday", 4, 21),
    ("LONDON_OPEN", "business", 8, None),
    ("NY_OPEN", "business", 13, None),
    ("DAILY_REPORT", "business", 20, None),
    ("MARKET_UPDATE_4H", "bar", 240, None),
]


def next_events(ts: Column) -> tuple[Column, Column]:
    """Earliest next event time and the array of all events that share it."""
    slots = []
    for name, kind, a, b in SCHEDULE:
        at = {
            "bar": lambda a=a, b=b: next_bar_close(ts, a),
            "weekday": lambda a=a, b=b: next_weekday_time(ts, a, b),
            "business": lambda a=a, b=b: next_business_time(ts, a),
        }[kind]()
        slots.append((name, at))
    earliest = F.least(*[at for _, at in slots])
    names = F.filter(
        F.array(*[F.when(at == earliest, F.lit(n)) for n, at in slots]), lambda s: s.isNotNull()
    )
    return earliest, names


def display_utc_and_tehran(ts: Column) -> Column:
    """'YYYY-MM-DD HH:MM UTC / HH:MM IRST'."""
    tehran = F.date_format(F.from_utc_timestamp(ts, "Asia/Tehran"), "HH:mm")
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC / "), tehran, F.lit(" IRST"))
