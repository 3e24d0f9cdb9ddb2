"""Conversion and parsing. as_*() are strict: a value they can't convert fails the plan; the
parse_*() functions and the date readers give missing values, which problems() lists."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dates import force_tz, java_format
from .expr import Context, Expr, arg


class ConversionError(ValueError):
    """Values that a strict conversion can't take."""


@dataclass(frozen=True)
class Locale:
    decimal_mark: str = "."
    grouping_mark: str = ","
    encoding: str = "utf-8"


def locale(decimal_mark: str = ".", grouping_mark: str = ",", encoding: str = "utf-8") -> Locale:
    if decimal_mark == grouping_mark or len(decimal_mark) != 1 or len(grouping_mark) != 1:
        raise ValueError("the marks are two different characters")
    return Locale(decimal_mark, grouping_mark, encoding)


def _converter(name: str, strict: bool, expected: str, f: Callable[..., Column]) -> Callable[..., Expr]:
    def outer(x: Any, *args: Any, **options: Any) -> Expr:
        hard = options.pop("strict", strict)
        x = arg(x)

        def plain(c: Context) -> tuple[Column, Column]:
            v = x(c)
            return v, f(c, v, *args, **options)

        def build(c: Context) -> Column:
            v, out = plain(c)
            if not hard:
                return out
            message = F.concat(F.lit(f"{name}() can't convert "), v.cast("string"))
            return F.when(v.isNotNull() & out.isNull(), F.raise_error(message).cast(c.type(out))).otherwise(out)

        made = Expr(build)
        if not hard:
            made.failed = lambda c: ((v := plain(c))[0], v[0].isNotNull() & v[1].isNull(), expected)
        return made

    outer.__name__ = name
    return outer


def _text(c: Context, v: Column) -> bool:
    return isinstance(c.type(v), T.StringType)


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _double(c: Context, v: Column, locale: Locale | None = None) -> Column:
    if not _text(c, v):
        return v.cast("double")
    s = F.trim(v)
    if locale and locale.decimal_mark != ".":
        s = F.translate(s, locale.decimal_mark, ".")
    special = F.lower(s)
    return (
        F.when(s.rlike(NUMBER), s.try_cast("double")).when(special.isin("nan"), F.lit(float("nan"))).when(special.isin("inf", "+inf", "infinity"), F.lit(float("inf"))).when(special.isin("-inf", "-infinity"), F.lit(float("-inf")))
    )


def _integer(c: Context, v: Column, locale: Locale | None = None) -> Column:
    if not _text(c, v):
        return F.when(v.cast("double") == F.floor(v.cast("double")), v.cast("long")) if c.floats(v) else v.cast("long")
    s = F.trim(v)
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("long"))


def _logical(true: list[str], false: list[str]) -> Callable[..., Column]:
    def f(c: Context, v: Column) -> Column:
        if not _text(c, v):
            return v.cast("boolean")
        return F.when(v.isin(true), True).when(v.isin(false), False)

    return f


def _number(c: Context, v: Column, locale: Locale | None = None) -> Column:
    """The first number of a messy text; grouping marks inside it are skipped."""
    if not _text(c, v):
        return v.cast("double")
    k = locale or Locale()
    g, d = re.escape(k.grouping_mark), re.escape(k.decimal_mark)
    found = F.regexp_substr(v, F.lit(rf"-?(\d[\d{g}]*({d}\d*)?|{d}\d+)([eE][+-]?\d+)?"))
    plain = F.translate(found, k.grouping_mark, "")
    return (F.translate(plain, k.decimal_mark, ".") if k.decimal_mark != "." else plain).try_cast("double")


def _character(c: Context, v: Column, true: str = "true", false: str = "false") -> Column:
    if isinstance(c.type(v), T.BooleanType):
        return F.when(v, true).when(~v, false)
    return v.cast("string")


def _numeric(c: Context, v: Column, unit: str | None = None) -> Column:
    if isinstance(c.type(v), T.DayTimeIntervalType):
        from .dates import time_length

        return time_length(Expr(lambda k: v), unit or "second")(c)
    if isinstance(c.type(v), T.DateType):
        return F.datediff(v, F.lit("1970-01-01").cast("date")).cast("double")
    return _double(c, v)


def _iso_date(c: Context, v: Column) -> Column:
    if not _text(c, v):
        return v.cast("date")
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v.try_cast("date"))


def _iso_time(c: Context, v: Column) -> Column:
    if not _text(c, v):
        return v.cast("timestamp_ntz")
    zoned = v.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    shape = v.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$")
    bare = F.regexp_replace(v, r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    sign = F.regexp_extract(v, r"([+-])\d{2}:?\d{2}$", 1)
    away = F.regexp_extract(v, r"[+-](\d{2}):?\d{2}$", 1).try_cast("int") * 60 + F.regexp_extract(v, r"[+-]\d{2}:?(\d{2})$", 1).try_cast("int")
    moved = F.timestamp_add("MINUTE", -F.coalesce(F.when(sign == "-", -away).otherwise(away), F.lit(0)), bare)
    return F.when(shape & zoned, moved).when(shape, bare)


as_character = _converter("as_character", True, "text", _character)
as_string = as_character
as_double = _converter("as_double", True, "a double", _double)
as_numeric = _converter("as_numeric", True, "a number", _numeric)
as_integer = _converter("as_integer", True, "a whole number", _integer)
as_logical = _converter("as_logical", True, "a logical", _logical(["TRUE", "T", "true", "True"], ["FALSE", "F", "false", "False"]))
as_date = _converter("as_date", True, "an ISO date", _iso_date)
as_datetime = _converter("as_datetime", True, "an ISO date and time", _iso_time)
parse_double = _converter("parse_double", False, "a double", _double)
parse_integer = _converter("parse_integer", False, "an integer", _integer)
_TRUE, _FALSE = ["true", "TRUE", "True", "t", "T", "1"], ["false", "FALSE", "False", "f", "F", "0"]
parse_logical = _converter("parse_logical", False, "a logical", _logical(_TRUE, _FALSE))
parse_number = _converter("parse_number", False, "a number", _number)


def _formatted(kind: str) -> Callable[..., Column]:
    def f(c: Context, v: Column, format: str, cutoff: int | None = None) -> Column:
        out = F.try_to_timestamp(F.trim(v), F.lit(java_format(format)))
        if "%z" in format:
            return out.cast("timestamp_ntz").cast(kind)
        return out.cast("timestamp_ntz").cast(kind)

    return f


parse_date = _converter("parse_date", False, "a date", _formatted("date"))
parse_datetime = _converter("parse_datetime", False, "a date and time", _formatted("timestamp_ntz"))


def _time_of_day(c: Context, v: Column, format: str = "") -> Column:
    """As a day-time interval: Spark has no time type of its own by default."""
    m = r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?\s*([aApP][mM])?\s*$"
    h, mi = F.regexp_extract(v, m, 1).try_cast("int"), F.regexp_extract(v, m, 2).try_cast("int")
    s = F.coalesce(F.nullif(F.regexp_extract(v, m, 3), F.lit("")), F.lit("0")).try_cast("decimal(8,6)")
    half = F.lower(F.regexp_extract(v, m, 4))
    h = F.when(half == "", h).otherwise(h % 12 + F.when(half == "pm", 12).otherwise(0))
    return F.when(v.rlike(m) & (h < 24) & (mi < 60) & (s < 60), F.make_dt_interval(F.lit(0), h, mi, s))


parse_time = _converter("parse_time", False, "a time of day", _time_of_day)

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _ordered(c: Context, order: str, cutoff: int | None, v: Column) -> Column:
    """A date whose parts come in an order, with any marks between, or as bare digits. Steps
    that several others read are columns of their own, so that each runs once."""
    fast = c.keep(_plain(order, v))
    s = c.keep(F.when(fast.isNull(), F.lower(F.trim(v))))
    named = rf"(?<![a-z])({'|'.join(MONTHS)})[a-z]*\.?"
    name = F.regexp_extract(s, named, 1)
    number = F.lpad(((F.instr(F.lit("".join(MONTHS)), name) + 2) / 3).cast("int").cast("string"), 2, "0")
    s = F.when(s.rlike("[a-z]"), F.regexp_replace(F.when(name != "", F.regexp_replace(s, F.lit(named), F.concat(F.lit(" "), number, F.lit(" ")))).otherwise(s), r"(\d)(st|nd|rd|th)(?![a-z])", "$1")).otherwise(s)
    s = c.keep(F.trim(s))
    width = {"y": r"(?:\d{4}|\d{2})", "m": r"\d{1,2}", "d": r"\d{1,2}"}
    apart = "^" + r"[\s\-/.,_:年月]+".join(width[p] for p in order) + r"[\s\-/.,_:年月日]*$"
    digits = c.keep(F.when(s.rlike(apart), F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0))))
    full, short = sum({"y": 4}.get(p, 2) for p in order), 2 * len(order)
    bare = F.when(s.rlike(rf"^(\d{{{full}}}|\d{{{short}}})$"), s)

    def pick(p: str) -> Column:
        before = order[: order.index(p)]
        long_at, short_at = 1 + sum({"y": 4}.get(q, 2) for q in before), 1 + 2 * len(before)
        tight = F.when(F.length(bare) == full, F.substring(bare, long_at, 4 if p == "y" else 2)).otherwise(F.substring(bare, short_at, 2))
        return F.coalesce(F.get(digits, F.lit(order.index(p))), tight)

    year = c.keep(pick("y"))
    y = F.when(F.length(year) == 4, year.try_cast("int"))
    if cutoff is not None:
        two = year.try_cast("int")
        y = F.when(F.length(year) == 4, two).when(F.length(year) == 2, F.when(two <= cutoff, two + 2000).otherwise(two + 1900))
    d = pick("d").try_cast("int") if "d" in order else F.lit(1)
    return F.coalesce(fast, F.try_make_timestamp_ntz(y, pick("m").try_cast("int"), d, F.lit(0), F.lit(0), F.lit(0)).cast("date"))


def _plain(order: str, v: Column) -> Column:
    """Dates of ten characters with padded parts and single marks, without a pattern."""
    if sorted(order) != ["d", "m", "y"]:
        return F.lit(None).cast("date")
    at, start = {}, 1
    for p in order:
        at[p] = F.substring(v, start, 4 if p == "y" else 2)
        start += 5 if p == "y" else 3
    marks = [5, 8] if order[0] == "y" else [3, 8] if order[1] == "y" else [3, 6]
    ok = F.length(v) == 10
    for m in marks:
        ok = ok & F.substring(v, m, 1).isin("-", "/", ".", " ")
    return F.when(ok, F.concat(at["y"], F.lit("-"), at["m"], F.lit("-"), at["d"]).try_cast("date"))


def _dates(order: str) -> Callable[..., Expr]:
    def f(c: Context, v: Column, cutoff: int | None = None) -> Column:
        return _ordered(c, order, cutoff, v.cast("string")) if not isinstance(c.type(v), (T.DateType, T.TimestampNTZType, T.TimestampType)) else v.cast("date")

    return f


ymd, mdy, dmy, ym = (_converter(o, False, f"a date as {o}", _dates(o)) for o in ("ymd", "mdy", "dmy", "ym"))


def _moments(order: str, clock: str) -> Callable[..., Column]:
    def f(c: Context, v: Column, tz: str = "UTC", truncated: int = 0, cutoff: int | None = None) -> Column:
        s = c.keep(F.trim(v.cast("string")))
        out = None
        for k in range(len(clock), len(clock) - 1 - truncated, -1):
            part = {3: r"(\d{1,2})\D+(\d{1,2})\D+(\d{1,2}(?:\.\d+)?)", 2: r"(\d{1,2})\D+(\d{1,2})", 1: r"(\d{1,2})", 0: ""}[max(k, 0)]
            whole = rf"^(.*?)[\sT,_:]+{part}\s*([aApP][mM])?\s*(?:Z|UTC)?$" if k > 0 else r"^(.*)$"
            fields = c.keep(F.when(s.rlike(whole), F.array(*[F.regexp_extract(s, whole, i + 1) for i in range(max(k, 0) + 1 + (k > 0))])))
            date = _ordered(c, order, cutoff, F.get(fields, F.lit(0)))
            n = [F.get(fields, F.lit(i + 1)) for i in range(max(k, 0))]
            h = n[0].try_cast("int") if k > 0 else F.lit(0)
            half = F.lower(F.get(fields, F.lit(k + 1))) if k > 0 else F.lit("")
            h = F.when(half == "", h).otherwise(h % 12 + F.when(half == "pm", 12).otherwise(0))
            mi = n[1].try_cast("int") if k > 1 else F.lit(0)
            sec = n[2].try_cast("double") if k > 2 else F.lit(0.0)
            ok = fields.isNotNull() & (h < 24) & (mi < 60) & (sec < 61)
            micros = F.round((h * 3600 + mi * 60 + sec) * 1_000_000).cast("long")
            got = F.when(ok, F.timestamp_add("MICROSECOND", micros, date.cast("timestamp_ntz")))
            out = got if out is None else F.coalesce(out, got)
        out = c.keep(out)
        return out if tz == "UTC" else force_tz(Expr(lambda k: out), tz)(c)

    return f


def _moment(name: str) -> Callable[..., Expr]:
    order, clock = name.split("_")
    return _converter(name, False, f"a date and time as {name}", _moments(order, clock))


ymd_hms, ymd_hm, ymd_h, mdy_hms, mdy_hm, mdy_h, dmy_hms, dmy_hm, dmy_h = (_moment(f"{o}_{c}") for o in ("ymd", "mdy", "dmy") for c in ("hms", "hm", "h"))


def _any_order(c: Context, v: Column, orders: Any, tz: str = "UTC", truncated: int = 0, exact: bool = False, cutoff: int | None = None) -> Column:
    """The first order that fits a value, those with more fields first."""
    names = [re.sub(r"[^a-zA-Z]", "", o) for o in ([orders] if isinstance(orders, str) else orders)]
    out = []
    for name in sorted(names, key=len, reverse=True):
        date, clock = re.match(r"([ymd]+)(.*)", name).groups()
        clock = clock.lower()
        out.append(_moments(date, clock)(c, v, tz, truncated, cutoff) if clock else _ordered(c, date, cutoff, v.cast("string")).cast("timestamp_ntz"))
    return F.coalesce(*out)


parse_date_time = _converter("parse_date_time", False, "a date and time", _any_order)
