"""Dates, clock times, calendar periods and exact durations."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import expr as E
from .expr import Context, Expr, arg, lit


def _date(c: Context, v: Column) -> bool:
    return isinstance(c.type(v), T.DateType)


def _part(f: Any) -> Any:
    return lambda x: Expr(lambda c: f(arg(x)(c)).cast("long"))


year, month, day, yday = _part(F.year), _part(F.month), _part(F.dayofmonth), _part(F.dayofyear)
isoweek = _part(F.weekofyear)
week = _part(lambda v: F.floor((F.dayofyear(v) - 1) / 7) + 1)
isoyear = _part(lambda v: F.year(F.date_add(v.cast("date"), 3 - F.weekday(v))))
days_in_month = _part(lambda v: F.dayofmonth(F.last_day(v.cast("date"))))


def _clock(f: Any) -> Any:
    return lambda x: Expr(lambda c: F.lit(0).cast("long") if _date(c, arg(x)(c)) else f(arg(x)(c)).cast("long"))


hour, minute = _clock(F.hour), _clock(F.minute)


def second(x: Any) -> Expr:
    return Expr(lambda c: F.lit(0.0) if _date(c, arg(x)(c)) else F.extract(F.lit("SECOND"), arg(x)(c)).cast("double"))


def leap_year(x: Any) -> Expr:
    def build(c: Context) -> Column:
        v = arg(x)(c)
        y = v if isinstance(c.type(v), T.NumericType) else F.year(v)
        return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))

    return Expr(build)


DAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
LONG_DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def wday(x: Any, *, label: bool = False, abbr: bool = True, week_start: int = 7) -> Expr:
    number = lambda c: F.pmod(F.weekday(arg(x)(c)) + 1 - week_start, F.lit(7)) + 1
    if not label:
        return Expr(lambda c: number(c).cast("long"))
    names = DAYS if abbr else LONG_DAYS
    turned = [names[(week_start + i) % 7] for i in range(7)]
    out = Expr(lambda c: F.element_at(F.array(*[F.lit(n) for n in turned]), number(c).cast("int")))
    out.factor = lambda c: (out(c), tuple(turned))
    return out


def quarter(x: Any, type: str = "quarter", *, fiscal_start: int = 1) -> Expr:
    def build(c: Context) -> Column:
        v = arg(x)(c)
        m = F.pmod(F.month(v) - fiscal_start, F.lit(12))
        q = (F.floor(m / 3) + 1).cast("long")
        y = F.year(v) + F.when((F.month(v) >= fiscal_start) & F.lit(fiscal_start > 1), 1).otherwise(0)
        if type == "quarter":
            return q
        if type == "year.quarter":
            return (y + q / 10).cast("double")
        first = F.add_months(F.trunc(v.cast("date"), "month"), -(F.pmod(m, F.lit(3))))
        if type == "date_first":
            return first
        if type == "date_last":
            return F.date_sub(F.add_months(first, 3), 1)
        start = y - (1 if fiscal_start > 1 else 0)
        if type == "year_start/end":
            return F.concat(F.coalesce(start.cast("string"), F.lit("NA")), F.lit("/"), F.coalesce((start + 1).cast("string").substr(3, 2), F.lit("NA")), F.lit(" Q"), F.coalesce(q.cast("string"), F.lit("NA")))
        raise ValueError(f"no quarter type {type!r}")

    return Expr(build)


UNITS = ("second", "minute", "hour", "day", "week", "month", "bimonth", "quarter", "halfyear", "year")


def _unit(unit: str) -> tuple[int, str]:
    parts = unit.split()
    n, name = (int(parts[0]), parts[1]) if len(parts) == 2 else (1, parts[0])
    name = name.rstrip("s") if name not in UNITS else name
    if name not in UNITS:
        raise ValueError(f"no unit {unit!r}: one of {', '.join(UNITS)}")
    if n < 1 or (n > 1 and name == "week"):
        raise ValueError(f"no multiples {unit!r}")
    wide = {"bimonth": (2, "month"), "quarter": (3, "month"), "halfyear": (6, "month")}
    k, base = wide.get(name, (1, name))
    return n * k, base


def _floored(c: Context, v: Column, unit: str, week_start: int) -> Column:
    n, name = _unit(unit)
    is_date = _date(c, v)
    d = v.cast("date")
    if name in ("month", "year"):
        months = (F.year(v) * 12 + F.month(v) - 1) if name == "month" else F.year(v)
        months = F.floor(months / n) * n
        y, m = (F.floor(months / 12), F.pmod(months, F.lit(12)) + 1) if name == "month" else (months, F.lit(1))
        out = F.make_date(y.cast("int"), m.cast("int"), F.lit(1))
    elif name == "week":
        out = F.date_sub(d, F.pmod(F.weekday(v) + 1 - week_start, F.lit(7)))
    elif name == "day":
        out = d if n == 1 else F.date_add(F.trunc(d, "month"), (F.floor((F.dayofmonth(v) - 1) / n) * n).cast("int"))
    else:
        if is_date:
            return v
        size = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000}[name] * n
        micros = F.timestamp_diff("MICROSECOND", d.cast("timestamp_ntz"), v.cast("timestamp_ntz"))
        out = F.timestamp_add("MICROSECOND", (F.floor(micros / size) * size).cast("long"), d.cast("timestamp_ntz"))
        return out.cast(c.type(v))
    return out if is_date else out.cast("timestamp_ntz").cast(c.type(v))


def _next(c: Context, floor: Column, unit: str) -> Column:
    n, name = _unit(unit)
    kind = c.type(floor)
    if name in ("month", "year"):
        out = F.add_months(floor.cast("date"), n * (12 if name == "year" else 1))
    elif name in ("week", "day"):
        out = F.date_add(floor.cast("date"), n * (7 if name == "week" else 1))
    else:
        return F.timestamp_add(name.upper(), F.lit(n), floor.cast("timestamp_ntz")).cast(kind)
    return out if isinstance(kind, T.DateType) else out.cast("timestamp_ntz").cast(kind)


def floor_date(x: Any, unit: str = "day", *, week_start: int = 7) -> Expr:
    return Expr(lambda c: _floored(c, arg(x)(c), unit, week_start))


def ceiling_date(x: Any, unit: str = "day", *, week_start: int = 7) -> Expr:
    """The next boundary; clock times on one stay, dates on one move on."""

    def build(c: Context) -> Column:
        v = arg(x)(c)
        low = _floored(c, v, unit, week_start)
        up = _next(c, low, unit)
        if _date(c, v):
            return v if _unit(unit)[1] in ("second", "minute", "hour") else up
        return F.when(low == v, v).otherwise(up)

    return Expr(build)


def round_date(x: Any, unit: str = "day", *, week_start: int = 7) -> Expr:
    def build(c: Context) -> Column:
        v = arg(x)(c)
        low = _floored(c, v, unit, week_start)
        up = _next(c, low, unit)
        far = lambda a, b: F.timestamp_diff("MICROSECOND", a.cast("timestamp_ntz"), b.cast("timestamp_ntz"))
        return F.when(far(low, v) < far(v, up), low).otherwise(up)

    return Expr(build)


#: strftime directives and the patterns for them.
DIRECTIVES = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "p": "a", "I": "hh", "f": "SSSSSS", "e": "d",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "z": "xx", "Z": "z", "h": "MMM", "n": "\n", "t": "\t",
}


def java_format(format: str) -> str:
    out, text, i = [], "", 0
    while i < len(format):
        if format[i] == "%" and i + 1 < len(format):
            if format[i + 1] == "%":
                text += "%"
            else:
                if text:
                    out.append(_literal(text))
                    text = ""
                out.append(DIRECTIVES[format[i + 1]])
            i += 2
        else:
            text += format[i]
            i += 1
    return "".join([*out, _literal(text)])


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if any(ch.isalpha() for ch in text) else text.replace("'", "''")


def date_format(x: Any, format: str = "%Y-%m-%d") -> Expr:
    return Expr(lambda c: F.date_format(arg(x)(c).cast("timestamp_ntz") if _date(c, arg(x)(c)) else arg(x)(c), java_format(format)))


def make_date(year: Any = 1970, month: Any = 1, day: Any = 1) -> Expr:
    """Missing where there is no such day."""
    parts = [arg(p) for p in (year, month, day)]
    return Expr(lambda c: F.try_make_timestamp_ntz(*[p(c).cast("int") for p in parts], F.lit(0), F.lit(0), F.lit(0)).cast("date"))


def make_datetime(year: Any = 1970, month: Any = 1, day: Any = 1, hour: Any = 0, min: Any = 0, sec: Any = 0, *, tz: str = "UTC") -> Expr:
    """Parts out of range roll over."""
    y, mo, d, h, mi, s = (arg(p) for p in (year, month, day, hour, min, sec))

    def build(c: Context) -> Column:
        months = (y(c) * 12 + mo(c) - 1).cast("int")
        base = F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
        base = F.date_add(base, (d(c) - 1).cast("int")).cast("timestamp_ntz")
        micros = ((h(c) * 3600 + mi(c) * 60).cast("double") + s(c)) * 1_000_000
        return F.timestamp_add("MICROSECOND", F.round(micros).cast("long"), base)

    return Expr(build)


def excel_numeric_to_date(date_num: Any, *, date_system: str = "modern", include_time: bool = False, round_seconds: bool = True, tz: str = "UTC") -> Expr:
    """Serial numbers of spreadsheets; the modern system's day 60 never was."""

    def build(c: Context) -> Column:
        v = arg(date_num)(c).cast("double")
        whole = F.floor(v).cast("int")
        if date_system == "modern":
            days = F.date_add(F.lit("1899-12-31").cast("date"), F.when(whole > 60, whole - 1).when(whole < 60, whole))
        else:
            days = F.date_add(F.lit("1904-01-01").cast("date"), whole)
        if not include_time:
            return days
        seconds = (v - F.floor(v)) * 86400
        micros = (F.round(seconds) if round_seconds else seconds) * 1_000_000
        return F.timestamp_add("MICROSECOND", micros.cast("long"), days.cast("timestamp_ntz"))

    return Expr(build)


def date_seq(from_: Any, to: Any = None, by: Any = None, total_size: int | None = None) -> Any:
    """Dates by a step; a list for Python dates, else an array expression."""
    by = by or "day"
    if isinstance(from_, dt.date) and (to is None or isinstance(to, dt.date)):
        step = by if isinstance(by, (Period, int)) else _period_of(by)
        step = days(step) if isinstance(step, int) else step
        out, i = [], 0
        while len(out) < total_size if to is None else True:
            at = step.times(i).shift_date(from_)
            if to is not None and at > to:
                break
            out.append(at)
            i += 1
        return out
    step = by if isinstance(by, Period) else days(by) if isinstance(by, int) else _period_of(by)
    return Expr(lambda c: F.sequence(arg(from_)(c), arg(to)(c), step.interval()))


def seq(start: Any, end: Any, by: Any = "day") -> Any:
    return date_seq(start, end, by)


def today(tzone: str = "UTC") -> dt.date:
    return dt.datetime.now(ZoneInfo(tzone)).date()


def now(tzone: str = "UTC") -> dt.datetime:
    return dt.datetime.now(ZoneInfo(tzone)).replace(tzinfo=None)


def with_tz(x: Any, tzone: str = "UTC") -> Expr:
    """The clock of another zone at the same instant; naive clocks are UTC's."""
    return Expr(lambda c: F.convert_timezone(F.lit("UTC"), F.lit(tzone), arg(x)(c).cast("timestamp_ntz")))


def force_tz(x: Any, tzone: str = "UTC", *, roll_dst: tuple[str, str] = ("NA", "post")) -> Expr:
    """The instant, as UTC's clock, at which a zone's clock shows x. roll_dst: what to do with
    times that the clock skips, and with those it shows twice: NA, pre, boundary or post."""

    zone = ZoneInfo(tzone)
    skipped, twice = roll_dst

    def instant(t: dt.datetime) -> dt.datetime | None:
        early, late = (t.replace(tzinfo=zone, fold=i).astimezone(dt.UTC).replace(tzinfo=None) for i in (0, 1))
        if early == late:
            return early
        if early < late:  # shown twice
            return None if twice == "NA" else early if twice == "pre" else late
        return None if skipped == "NA" else late if skipped == "pre" else early

    @F.pandas_udf(T.TimestampNTZType())
    def forced(v: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(t) else instant(t.to_pydatetime()) for t in v], dtype="datetime64[us]")

    return Expr(lambda c: forced(arg(x)(c).cast("timestamp_ntz")))


@dataclass(frozen=True)
class Period:
    """A span of the calendar: months, then days, then the clock."""

    months: int = 0
    days: int = 0
    seconds: float = 0

    def __add__(self, o: Any) -> Any:
        if isinstance(o, Period):
            return Period(self.months + o.months, self.days + o.days, self.seconds + o.seconds)
        return o + self

    def __neg__(self) -> Period:
        return self.times(-1)

    def __mul__(self, k: int) -> Period:
        return self.times(k)

    __rmul__ = __mul__

    def __sub__(self, o: Period) -> Period:
        return self + -o

    def times(self, k: int) -> Period:
        return Period(self.months * k, self.days * k, self.seconds * k)

    def __shift__(self, x: Expr, sign: int) -> Expr:
        return add_with_rollback(x, self.times(sign))

    def interval(self) -> Column:
        if self.months:
            return F.make_ym_interval(F.lit(0), F.lit(self.months))
        return F.make_dt_interval(F.lit(self.days), F.lit(0), F.lit(0), F.lit(self.seconds))

    def shift_date(self, d: dt.date) -> dt.date:
        m = d.year * 12 + d.month - 1 + self.months
        y, m = divmod(m, 12)
        last = (dt.date(y + m // 11, (m + 1) % 12 + 1, 1) - dt.timedelta(1)).day
        return dt.date(y, m + 1, min_(d.day, last)) + dt.timedelta(self.days)


def min_(a: int, b: int) -> int:
    return a if a < b else b


def years(n: int = 1) -> Period:
    return Period(12 * n)


def months(n: int = 1) -> Period:
    return Period(n)


def weeks(n: int = 1) -> Period:
    return Period(0, 7 * n)


def days(n: int = 1) -> Period:
    return Period(0, n)


def hours(n: int = 1) -> Period:
    return Period(0, 0, 3600 * n)


def minutes(n: int = 1) -> Period:
    return Period(0, 0, 60 * n)


def seconds(n: float = 1) -> Period:
    return Period(0, 0, n)


PERIODS = {"year": years, "month": months, "week": weeks, "day": days, "hour": hours, "minute": minutes, "second": seconds, "quarter": lambda n=1: months(3 * n)}


def _period_of(text: str) -> Period:
    parts = text.split()
    n, unit = (int(parts[0]), parts[1]) if len(parts) == 2 else (1, parts[0])
    return PERIODS[unit.rstrip("s")](n)


def period(num: Any = None, units: str = "second", **parts: Any) -> Period:
    out = PERIODS[units.rstrip("s")](num) if num is not None else Period()
    for unit, n in parts.items():
        out = out + PERIODS[unit.rstrip("s")](n)
    return out


def add_with_rollback(x: Any, period: Period, *, roll_to_first: bool = False) -> Expr:
    """Months first, a day that the month lacks becoming its last (or the next month's first),
    then days, then the clock."""

    def build(c: Context) -> Column:
        v = arg(x)(c)
        kind = c.type(v)
        is_date = isinstance(kind, T.DateType)
        d = v.cast("date")
        moved = F.add_months(d, period.months) if period.months else d
        if roll_to_first and period.months:
            moved = F.when(F.dayofmonth(moved) < F.dayofmonth(d), F.date_add(moved, 1)).otherwise(moved)
        moved = F.date_add(moved, period.days) if period.days else moved
        if is_date and not period.seconds:
            return moved
        micros = F.lit(0) if is_date else F.timestamp_diff("MICROSECOND", d.cast("timestamp_ntz"), v.cast("timestamp_ntz"))
        out = F.timestamp_add("MICROSECOND", micros + F.lit(int(period.seconds * 1_000_000)), moved.cast("timestamp_ntz"))
        return out if is_date else out.cast(kind)

    return Expr(build)


class Duration(Expr):
    """An exact span, a day-time interval as a column."""

    def __init__(self, micros: Any):
        self.micros = micros
        super().__init__(lambda c: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (lit(micros)(c) / 1_000_000).cast("decimal(18,6)")))

    def __shift__(self, x: Expr, sign: int) -> Expr:
        if isinstance(x, Duration):
            return Duration(lit(x.micros) + sign * lit(self.micros)) if isinstance(self.micros, Expr) or isinstance(x.micros, Expr) else Duration(x.micros + sign * self.micros)

        def build(c: Context) -> Column:
            v = arg(x)(c)
            if _date(c, v) and not isinstance(self.micros, Expr) and self.micros % 86_400_000_000 == 0:
                return F.date_add(v, int(sign * self.micros // 86_400_000_000))
            return F.timestamp_add("MICROSECOND", (sign * lit(self.micros)(c)).cast("long"), v.cast("timestamp_ntz"))

        return Expr(build)


#: Seconds in each unit of exact time.
EXACT = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2629800, "year": 31557600}


def duration(num: Any = None, units: str = "second", **parts: Any) -> Duration:
    total: Any = 0
    for unit, n in ([(units, num)] if num is not None else []) + list(parts.items()):
        size = EXACT[unit.rstrip("s")] * 1_000_000
        total = total + (arg(n) * size if isinstance(n, (str, Expr)) else n * size)
    return Duration(total)


def _exact(unit: str) -> Any:
    return lambda x=1: duration(x, unit)


dseconds, dminutes, dhours, ddays, dweeks, dmonths, dyears = (_exact(u) for u in EXACT)


def as_duration(x: Any) -> Expr:
    if isinstance(x, Period):
        return Duration((x.months * EXACT["month"] + x.days * 86400 + x.seconds) * 1_000_000)
    if isinstance(x, (int, float)):
        return Duration(x * 1_000_000)

    def build(c: Context) -> Column:
        v = arg(x)(c)
        return v if isinstance(c.type(v), T.DayTimeIntervalType) else Duration(E.Expr(lambda k: v * 1_000_000))(c)

    return Expr(build)


def time_length(x: Any, unit: str = "second") -> Expr:
    def build(c: Context) -> Column:
        if isinstance(x, Duration) and not isinstance(x.micros, Expr):
            return F.lit(x.micros / 1_000_000 / EXACT[unit.rstrip("s")])
        v = arg(x)(c)
        origin = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", origin, origin + v) / (1_000_000 * EXACT[unit.rstrip("s")])

    return Expr(build)
