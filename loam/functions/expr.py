"""Deferred expressions.

An :class:`Expr` knows how to become a Column in a :class:`Context`, so one expression
serves as a plain projection, as an aggregate of ``summarise`` or as a window over the
groups of ``mutate`` and ``filter``. Windows are never nested: each becomes a hidden column
of the context's DataFrame, and Catalyst merges those that share their partitioning.
"""

from __future__ import annotations

import datetime as dt
import itertools
import math
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = "__loam_"
_fresh = itertools.count()


def hidden(kind: str) -> str:
    return f"{HIDDEN}{kind}{next(_fresh)}"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def falling(c: Column, kind: T.DataType) -> list[Column] | None:
    """Columns that rise where c falls; None of types without such."""
    if isinstance(kind, T.IntegralType):
        return [F.bitwise_not(c)]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [~F.isnan(c), -c]
    if isinstance(kind, T.DecimalType):
        return [-c]
    if isinstance(kind, T.BooleanType):
        return [~c]
    if isinstance(kind, T.DateType):
        return [F.bitwise_not(F.unix_date(c))]
    if isinstance(kind, T.TimestampType):
        return [F.bitwise_not(F.unix_micros(c))]
    if kind in (T.StringType(), T.BinaryType()):  # other digits, and of two that begin alike the longer first
        return [F.concat(F.translate(F.hex(c.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))]
    return None


class Context:
    """Where an expression is evaluated. order: sort Columns of the rows; place: columns
    that together rise with the rows, if there are such."""

    def __init__(self, df: DataFrame, groups: Iterable[str] = (), order: Iterable[Column] = (), place: list[Column] | None = None, aggregate: bool = False, rowwise: bool = False, levels: dict | None = None):
        self.df, self.groups, self.order, self.place = df, list(groups), list(order), place
        self.aggregate, self.rowwise, self.levels = aggregate, rowwise, levels or {}
        self.problems: list = []

    def type(self, c: Column) -> T.DataType:
        return self.df.select(c.alias("x")).schema[0].dataType

    def floats(self, c: Column) -> bool:
        return isinstance(self.type(c), (T.FloatType, T.DoubleType))

    def known(self, c: Column) -> Column:
        """Not a number becomes missing."""
        return F.nanvl(c, F.lit(None)) if self.floats(c) else c

    def keep(self, c: Column, kind: str = "w") -> Column:
        name = hidden(kind)
        self.df = self.df.withColumn(name, c)
        return F.col(name)

    def window(self, order: list[Column] | None = None, whole: bool = True):
        w = Window.partitionBy(*[quoted(g) for g in self.groups])
        if order is not None:
            w = w.orderBy(*order) if order else w.orderBy(F.lit(1))
            w = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing if whole else 0)
        return w

    def over(self, c: Column, order: list[Column] | None = None, whole: bool = False) -> Column:
        return self.keep(c.over(self.window(order, whole)))

    def ranked(self, c: Column, order: list[Column]) -> Column:
        """Ranking functions have no frame of their own."""
        w = Window.partitionBy(*[quoted(g) for g in self.groups]).orderBy(*(order or [F.lit(1)]))
        return self.keep(c.over(w))

    def rows(self) -> Context:
        """The context in which the arguments of an aggregate are evaluated."""
        if not self.aggregate:
            return self
        out = Context.__new__(_Inner)
        out.__dict__["of"] = self
        return out

    def position(self) -> Column:
        """A column that rises with the rows."""
        if self.place:
            return self.place[0] if len(self.place) == 1 else F.struct(*[c.alias(f"p{i}") for i, c in enumerate(self.place)])
        w = Window.partitionBy(*[quoted(g) for g in self.groups]).orderBy(*(self.order or [F.monotonically_increasing_id()]))
        return self.keep(F.row_number().over(w))

    def whole(self, c: Column) -> Column:
        """One aggregate function over the group: as it is in an aggregation, else a window."""
        return c if self.aggregate else self.over(c)

    def reduce(self, make: Callable[..., Column], *args: Expr) -> Column:
        """An expression of aggregates of args over the group, each of them given to whole()."""
        inner = self.rows()
        return make(self, *[a(inner) for a in args])


class _Inner(Context):
    """Row context inside an aggregate; its hidden columns go to the outer one's DataFrame."""

    def __getattr__(self, name: str) -> Any:
        return getattr(self.__dict__["of"], name)

    def __setattr__(self, name: str, value: Any) -> None:
        setattr(self.__dict__["of"], name, value)

    @property
    def aggregate(self) -> bool:
        return False


class Expr:
    def __init__(self, build: Callable[[Context], Column], name: str | None = None, level: str | None = None):
        self.build, self.name, self.level = build, name, level

    def __call__(self, context: Context) -> Column:
        return self.build(context)

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use &, | and ~, and parentheses around comparisons")

    def __hash__(self) -> int:
        return id(self)

    def __add__(self, o):
        return binary(lambda a, b: a + b, self, o)

    def __radd__(self, o):
        return binary(lambda a, b: a + b, o, self)

    def __sub__(self, o):
        return binary(lambda a, b: a - b, self, o)

    def __rsub__(self, o):
        return binary(lambda a, b: a - b, o, self)

    def __mul__(self, o):
        return binary(lambda a, b: a * b, self, o)

    __rmul__ = __mul__

    def __pow__(self, o):
        return binary(F.pow, self, o)

    def __truediv__(self, o):
        return binary(divided, self, o)

    def __rtruediv__(self, o):
        return binary(divided, o, self)

    def __floordiv__(self, o):
        return binary(floor_divided, self, o)

    def __mod__(self, o):
        return binary(lambda a, b: F.when(b != 0, a - b * F.floor(divided(a, b))), self, o)

    def __eq__(self, o):  # noqa: D105
        return binary(lambda a, b: a == b, self, o)

    def __ne__(self, o):
        return binary(lambda a, b: a != b, self, o)

    def __lt__(self, o):
        return binary(lambda a, b: a < b, self, o)

    def __le__(self, o):
        return binary(lambda a, b: a <= b, self, o)

    def __gt__(self, o):
        return binary(lambda a, b: a > b, self, o)

    def __ge__(self, o):
        return binary(lambda a, b: a >= b, self, o)

    def __and__(self, o):
        return binary(lambda a, b: a & b, self, o)

    __rand__ = __and__

    def __or__(self, o):
        return binary(lambda a, b: a | b, self, o)

    __ror__ = __or__

    def __invert__(self):
        return Expr(lambda c: ~self(c))

    def __neg__(self):
        return Expr(lambda c: -self(c))

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        from . import methods

        if name not in methods.METHODS:
            raise AttributeError(f"expressions have no method {name!r}; there are: {', '.join(sorted(methods.METHODS))}")
        return lambda *a, **k: methods.METHODS[name](self, *a, **k)

    def __getitem__(self, key):
        return Expr(lambda c: self(c)[key] if isinstance(key, str) else F.get(self(c), key))


class Descending:
    def __init__(self, of: Expr):
        self.of = of


def divided(a: Column, b: Column) -> Column:
    """IEEE division: by zero gives infinities, and zero by zero not a number."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).when(a.isNotNull(), F.lit(math.nan))
    return F.when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def floor_divided(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.floor(divided(a, b)))


def col(name: str) -> Expr:
    return Expr(lambda c: quoted(name), name=name)


def lit(value: Any) -> Expr:
    if isinstance(value, Expr):
        return value
    if isinstance(value, Column):
        return Expr(lambda c: value)
    if isinstance(value, (dt.datetime,)):
        return Expr(lambda c: F.lit(value).cast("timestamp_ntz" if value.tzinfo is None else "timestamp"))
    if isinstance(value, (list, tuple)):
        return Expr(lambda c: F.array(*[lit(v)(c) for v in value]))
    if hasattr(value, "__expr__"):
        return value.__expr__()
    return Expr(lambda c: F.lit(value))


def arg(x: Any) -> Expr:
    """A data argument: text names a column."""
    return col(x) if isinstance(x, str) else lit(x)


def binary(f: Callable[[Column, Column], Column], a: Any, b: Any) -> Expr:
    for x, y, sign in ((a, b, 1), (b, a, 1)):
        if hasattr(y, "__shift__") and isinstance(x, Expr):
            minus = f is not None and f(_Probe(), _Probe()) == "-"
            return y.__shift__(x, -1 if minus else 1)
    a, b = lit(a), lit(b)
    return Expr(lambda c: f(a(c), b(c)))


class _Probe:
    """Tells whether an operator is a sum or a difference."""

    def __add__(self, o):
        return "+"

    def __sub__(self, o):
        return "-"


def desc(x: Any) -> Descending:
    return Descending(arg(x))


def sort_keys(context: Context, keys: Iterable[Any]) -> list[Column]:
    """Sort Columns; missing values and not-a-number last either way, factors by level."""
    out = []
    for key in keys:
        down, e = isinstance(key, Descending), key.of if isinstance(key, Descending) else arg(key)
        c = e(context)
        if e.name in context.levels:
            c = F.array_position(F.array(*[F.lit(v) for v in context.levels[e.name]]), c)
        c = context.known(c)
        out.append(c.desc_nulls_last() if down else c.asc_nulls_last())
    return out


# Aggregates. Missing values propagate unless na_rm.


def _aggregate(make: Callable[[Column], Column], clean: bool = False) -> Callable[..., Expr]:
    def outer(x: Any, *, na_rm: bool = False) -> Expr:
        x = arg(x)

        def build(c: Context) -> Column:
            def of(inner: Context, v: Column) -> Column:
                v = inner.known(v) if clean else v
                if isinstance(inner.type(v), T.BooleanType):
                    v = v.cast("int")
                out = inner.whole(make(v))
                return out if na_rm else F.when(inner.whole(F.count(v)) == inner.whole(F.count(F.lit(1))), out)

            return c.reduce(of, x)

        return Expr(build)

    return outer


mean = _aggregate(F.mean)
median = _aggregate(F.median)
std = sd = _aggregate(F.stddev_samp)
var = _aggregate(F.var_samp)
min = _aggregate(F.min, clean=True)
max = _aggregate(F.max, clean=True)


def n() -> Expr:
    return Expr(lambda c: c.reduce(lambda inner: inner.whole(F.count(F.lit(1)))))


def sum(x: Any, *, na_rm: bool = False, min_count: int | None = None) -> Expr:
    x = arg(x)

    def of(inner: Context, v: Column) -> Column:
        if isinstance(inner.type(v), T.BooleanType):
            v = v.cast("long")
        zero = F.lit(0).cast(inner.type(v)) if not isinstance(inner.type(v), T.NullType) else F.lit(0)
        total = F.coalesce(inner.whole(F.sum(v)), zero)
        if min_count is not None:
            total = F.when(inner.whole(F.count(v)) >= min_count, total)
        return total if na_rm else F.when(inner.whole(F.count(v)) == inner.whole(F.count(F.lit(1))), total)

    return Expr(lambda c: c.reduce(of, x))


def _logical(any_: bool) -> Callable[..., Expr]:
    def outer(x: Any, *, na_rm: bool = False) -> Expr:
        def of(inner: Context, v: Column) -> Column:
            hit = F.coalesce(inner.whole(F.bool_or(v)) if any_ else ~inner.whole(F.bool_and(v)), F.lit(False))
            unknown = F.lit(False) if na_rm else inner.whole(F.count(v)) < inner.whole(F.count(F.lit(1)))
            return F.when(hit, any_).when(~unknown, not any_)

        return Expr(lambda c: c.reduce(of, arg(x)))

    return outer


any, all = _logical(True), _logical(False)


def quantile(x: Any, q: float = 0.5, *, na_rm: bool = False) -> Expr:
    return _aggregate(lambda v: F.percentile(v, F.lit(q)))(x, na_rm=na_rm)


def count(x: Any) -> Expr:
    return Expr(lambda c: c.reduce(lambda inner, v: inner.whole(F.count(v)), arg(x)))


def n_distinct(*values: Any, na_rm: bool = False) -> Expr:
    def build(c: Context) -> Column:
        def of(inner: Context, *vs: Column) -> Column:
            missing = vs[0].isNull()
            for v in vs[1:]:
                missing = missing | v.isNull()
            row = vs[0] if len(vs) == 1 else F.when(~missing, F.struct(*vs)) if na_rm else F.struct(*vs)
            # a window can't count distinct values, but can collect them
            found = inner.whole(F.count_distinct(row)) if c.aggregate else F.size(inner.whole(F.collect_set(row)))
            gap = F.coalesce(inner.whole(F.max(missing.cast("int"))), F.lit(0)) if len(vs) == 1 and not na_rm else F.lit(0)
            return (found + gap).cast("long")

        return c.reduce(of, *[arg(v) for v in values])

    return Expr(build)


def _placed(pick: str) -> Callable[..., Expr]:
    def outer(x: Any, *, order_by: Any = None, default: Any = None, na_rm: bool = False) -> Expr:
        x = arg(x)

        def build(c: Context) -> Column:
            inner = c.rows()
            v = x(inner)
            if order_by is None:
                at = inner.position()
            else:
                at = inner.ranked(F.row_number(), sort_keys(inner, order_by if isinstance(order_by, (list, tuple)) else [order_by]) + inner.order)
            held = F.when(v.isNotNull(), at) if na_rm else at
            of = F.min_by if pick == "first" else F.max_by
            out = c.whole(of(v, held)) if na_rm else c.whole(of(F.struct(v.alias("v")), held))["v"]
            return out if default is None else F.coalesce(out, F.lit(default))

        return Expr(build)

    return outer


first, last = _placed("first"), _placed("last")


def nth(x: Any, k: int, *, order_by: Any = None, default: Any = None, na_rm: bool = False) -> Expr:
    x = arg(x)

    def build(c: Context) -> Column:
        inner = c.rows()
        v = x(inner)
        keys = [] if order_by is None else sort_keys(inner, order_by if isinstance(order_by, (list, tuple)) else [order_by])
        keys = keys + (inner.order or [inner.position()])
        if na_rm:
            keys = [v.isNull().asc(), *keys]
        at = inner.ranked(F.row_number(), keys)
        if k < 0:  # from the end
            size = F.count(v) if na_rm else F.count(F.lit(1))
            wanted = inner.over(size) + (k + 1)
        else:
            wanted = F.lit(k)
        out = c.whole(F.max(F.when(at == wanted, v)))
        return out if default is None else F.coalesce(out, F.lit(default))

    return Expr(build)


def single_value(x: Any, missing: Any = None, **_: Any) -> Expr:
    """The one distinct value of a group; an error if there are several."""

    def of(inner: Context, v: Column) -> Column:
        low, high = inner.whole(F.min(v)), inner.whole(F.max(v))
        return F.when(low != high, F.raise_error(F.lit("more than one distinct value in a group")).cast(inner.type(v))).otherwise(high)

    out = Expr(lambda c: c.reduce(of, arg(x)))
    return out if missing is None else coalesce(out, missing)


# Ranks and other functions of the rows' order.


def _key(context: Context, x: Any) -> tuple[Column, list[Column]]:
    """The ranked value and its sort Column."""
    e = x.of if isinstance(x, Descending) else arg(x)
    c = context.known(e(context))
    return c, sort_keys(context, [x])


def row_number(x: Any = None) -> Expr:
    def build(c: Context) -> Column:
        if x is None:
            return c.ranked(F.row_number(), c.order or [c.position()]).cast("long")
        v, keys = _key(c, x)
        return F.when(v.isNotNull(), c.ranked(F.row_number(), keys + c.order)).cast("long")

    return Expr(build)


def _rank(f: Callable[[], Column]) -> Callable[[Any], Expr]:
    def outer(x: Any) -> Expr:
        def build(c: Context) -> Column:
            v, keys = _key(c, x)
            return F.when(v.isNotNull(), c.ranked(f(), keys)).cast("long")

        return Expr(build)

    return outer


min_rank, dense_rank = _rank(F.rank), _rank(F.dense_rank)


def percent_rank(x: Any) -> Expr:
    def build(c: Context) -> Column:
        v, _ = _key(c, x)
        return divided(min_rank(x)(c) - 1, c.over(F.count(v)) - 1)

    return Expr(build)


def cume_dist(x: Any) -> Expr:
    def build(c: Context) -> Column:
        v, keys = _key(c, x)
        w = Window.partitionBy(*[quoted(g) for g in c.groups]).orderBy(*keys).rangeBetween(Window.unboundedPreceding, 0)
        return F.when(v.isNotNull(), c.keep(F.count(v).over(w)) / c.over(F.count(v)))

    return Expr(build)


def ntile(x: Any, k: int) -> Expr:
    def build(c: Context) -> Column:
        v, _ = _key(c, x)
        return F.floor((row_number(x)(c) - 1) * k / c.over(F.count(v))).cast("long") + 1

    return Expr(build)


def _shifted(f: Callable[..., Column]) -> Callable[..., Expr]:
    def outer(x: Any, n: int = 1, default: Any = None, *, order_by: Any = None) -> Expr:
        def build(c: Context) -> Column:
            keys = c.order or [c.position()]
            if order_by is not None:
                keys = sort_keys(c, order_by if isinstance(order_by, (list, tuple)) else [order_by]) + c.order
            v = arg(x)(c)
            if default is None:
                return c.ranked(f(v, n), keys)
            w = c.ranked(f(F.struct(v.alias("v")), n), keys)
            return F.when(w.isNull(), F.lit(default)).otherwise(w["v"])

        return Expr(build)

    return outer


lead, lag = _shifted(F.lead), _shifted(F.lag)


def _running(f: Callable[[Column], Column], guard: bool = True) -> Callable[[Any], Expr]:
    """Over the rows so far; missing from the first missing value on."""

    def outer(x: Any) -> Expr:
        def build(c: Context) -> Column:
            v = arg(x)(c)
            keys = c.order or [c.position()]
            out = c.over(f(v), keys)
            return F.when(c.over(F.count(F.when(v.isNull(), 1)), keys) == 0, out) if guard else out

        return Expr(build)

    return outer


cumsum = cum_sum = _running(F.sum)
cummean = _running(F.mean)
cummin = cum_min = _running(F.min)
cummax = cum_max = _running(F.max)
cumprod = cum_prod = _running(F.product)


def _running_logical(any_: bool) -> Callable[[Any], Expr]:
    def outer(x: Any) -> Expr:
        def build(c: Context) -> Column:
            v, keys = arg(x)(c), c.order or [c.position()]
            hit = F.coalesce(c.over(F.bool_or(v == F.lit(any_)), keys), F.lit(False))
            unknown = c.over(F.count(F.when(v.isNull(), 1)), keys) > 0
            return F.when(hit, any_).when(~unknown, not any_)

        return Expr(build)

    return outer


cumany, cumall = _running_logical(True), _running_logical(False)


def consecutive_id(*values: Any) -> Expr:
    def build(c: Context) -> Column:
        keys = c.order or [c.position()]
        row = F.struct(*[arg(v)(c).alias(f"v{i}") for i, v in enumerate(values)])
        new = c.ranked(F.lag(row), keys)
        changed = F.when(new.isNull() | ~row.eqNullSafe(new), 1).otherwise(0)
        return c.over(F.sum(c.keep(changed)), keys).cast("long")

    return Expr(build)


def rolling_mean(x: Any, size: int) -> Expr:
    def build(c: Context) -> Column:
        w = Window.partitionBy(*[quoted(g) for g in c.groups]).orderBy(*(c.order or [c.position()])).rowsBetween(1 - size, 0)
        v = arg(x)(c)
        return F.when(c.keep(F.count(v).over(w)) == size, c.keep(F.mean(v).over(w)))

    return Expr(build)


def order_by(order: Any, e: Expr) -> Expr:
    """A window expression as if rows were sorted by another key."""

    def build(c: Context) -> Column:
        keys = sort_keys(c, order if isinstance(order, (list, tuple)) else [order])
        held, place = c.order, c.place
        c.order, c.place = keys + held, None
        try:
            return e(c)
        finally:
            c.order, c.place = held, place

    return Expr(build)


def with_order(order: Any, fn: Callable[..., Expr], x: Any, *args: Any, **kwargs: Any) -> Expr:
    return order_by(order, fn(x, *args, **kwargs))


def scale(x: Any, center: bool = True, scale: bool = True) -> Expr:
    def build(c: Context) -> Column:
        v = c.known(arg(x)(c).cast("double"))
        out = v - c.over(F.mean(v)) if center else v
        if scale:
            size = c.over(F.stddev_samp(v)) if center else F.sqrt(c.over(F.sum(v * v)) / (c.over(F.count(v)) - 1))
            out = divided(out, size)
        return out

    return Expr(build)


def rescale(x: Any, to: tuple[float, float] = (0, 1)) -> Expr:
    def build(c: Context) -> Column:
        v = c.known(arg(x)(c).cast("double"))
        lo, hi = c.over(F.min(v)), c.over(F.max(v))
        a, b = to
        return F.when(lo == hi, F.when(v.isNotNull(), F.lit((a + b) / 2))).otherwise((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * (b - a) + a)

    return Expr(build)


def cur_group_id() -> Expr:
    def build(c: Context) -> Column:
        if not c.groups:
            return F.lit(1).cast("long")
        keys = c.df.select(*[quoted(g) for g in c.groups]).distinct()
        w = Window.orderBy(*[quoted(g).asc_nulls_last() for g in c.groups])
        name = hidden("g")
        keys = keys.select(*[quoted(g).alias(f"{HIDDEN}k{i}") for i, g in enumerate(c.groups)], F.row_number().over(w).cast("long").alias(name))
        on = None
        for i, g in enumerate(c.groups):
            x = quoted(g).eqNullSafe(F.col(f"{HIDDEN}k{i}"))
            on = x if on is None else on & x
        c.df = c.df.join(keys, on).drop(*[f"{HIDDEN}k{i}" for i in range(len(c.groups))])
        return F.first(F.col(name)) if c.aggregate else F.col(name)

    return Expr(build)


# Conditions and replacements.


def if_else(condition: Any, true: Any, false: Any, *, missing: Any = None) -> Expr:
    a, t, f, m = arg(condition), lit(true), lit(false), lit(missing)
    return Expr(lambda c: F.when((k := a(c)).isNull(), m(c)).when(k, t(c)).otherwise(f(c)))


def case_when(*cases: tuple[Any, Any], default: Any = None, unmatched: str = "default") -> Expr:
    def build(c: Context) -> Column:
        out = None
        for test, value in cases:
            out = (F if out is None else out).when(lit(test)(c), lit(value)(c))
        if unmatched == "error":
            return out.otherwise(F.raise_error(F.lit("a row matches no case")))
        return out.otherwise(lit(default)(c))

    return Expr(build)


def _is(v: Column, of: Any) -> Column:
    of = list(of) if isinstance(of, (list, tuple, set, frozenset)) else [of]
    out = v.isin(*[x for x in of if x is not None])
    out = F.coalesce(out, F.lit(False))
    return out | v.isNull() if None in of else out


def case_match(x: Any, *cases: tuple[Any, Any], default: Any = None) -> Expr:
    def build(c: Context) -> Column:
        v, out = arg(x)(c), None
        for of, value in cases:
            out = (F if out is None else out).when(_is(v, of), lit(value)(c))
        return out.otherwise(lit(default)(c))

    return Expr(build)


def _pairs(cases: tuple, from_: Any, to: Any) -> list[tuple[Any, Any]]:
    return [*cases, *(zip(from_, to, strict=True) if from_ is not None else ())]


def recode(x: Any, mapping: dict, *, default: Any = None, missing: Any = None) -> Expr:
    def build(c: Context) -> Column:
        v = arg(x)(c)
        out = F.when(v.isNull(), lit(missing)(c))
        for k, value in mapping.items():
            out = out.when(v == k, lit(value)(c))
        return out.otherwise(v if default is None else lit(default)(c))

    return Expr(build)


def recode_values(x: Any, *cases: tuple, from_: Any = None, to: Any = None, default: Any = None, unmatched: str = "default") -> Expr:
    pairs = _pairs(cases, from_, to)
    return case_when(*[(Expr(lambda c, of=of: _is(arg(x)(c), of)), value) for of, value in pairs], default=default, unmatched=unmatched)


def replace_values(x: Any, *cases: tuple, from_: Any = None, to: Any = None) -> Expr:
    return recode_values(x, *cases, from_=from_, to=to, default=arg(x))


def replace_when(x: Any, *cases: tuple) -> Expr:
    return case_when(*cases, default=arg(x))


def when_any(*conditions: Any, na_rm: bool = False) -> Expr:
    return _joined(conditions, na_rm, False)


def when_all(*conditions: Any, na_rm: bool = False) -> Expr:
    return _joined(conditions, na_rm, True)


def _joined(conditions: tuple, na_rm: bool, all_: bool) -> Expr:
    def build(c: Context) -> Column:
        out = F.lit(all_)
        for k in conditions:
            v = lit(k)(c)
            v = F.coalesce(v, F.lit(all_)) if na_rm else v
            out = out & v if all_ else out | v
        return out

    return Expr(build)


def coalesce(*values: Any) -> Expr:
    return Expr(lambda c: F.coalesce(arg(values[0])(c), *[lit(v)(c) for v in values[1:]]))


def na_if(x: Any, y: Any) -> Expr:
    return Expr(lambda c: F.nullif(arg(x)(c), lit(y)(c)))


def near(x: Any, y: Any, *, tolerance: float = 1.490116e-08) -> Expr:
    return Expr(lambda c: F.abs(arg(x)(c) - lit(y)(c)) <= tolerance)


def between_values(x: Any, left: Any, right: Any, *, bounds: str = "[]") -> Expr:
    def build(c: Context) -> Column:
        v, lo, hi = arg(x)(c), lit(left)(c), lit(right)(c)
        return (v >= lo if bounds[0] == "[" else v > lo) & (v <= hi if bounds[1] == "]" else v < hi)

    return Expr(build)


def is_na(x: Any) -> Expr:
    return Expr(lambda c: c.known(arg(x)(c)).isNull())


def is_nan(x: Any) -> Expr:
    return Expr(lambda c: F.coalesce(F.isnan(v), F.lit(False)) if c.floats(v := arg(x)(c)) else F.lit(False))


def is_finite(x: Any) -> Expr:
    return Expr(lambda c: F.coalesce(F.abs(c.known(arg(x)(c)).cast("double")) < math.inf, F.lit(False)))


def is_infinite(x: Any) -> Expr:
    return Expr(lambda c: F.coalesce(F.abs(c.known(arg(x)(c)).cast("double")) == math.inf, F.lit(False)))


# Numbers.


def _elementwise(f: Callable[[Context, Column], Column]) -> Callable[[Any], Expr]:
    return lambda x: Expr(lambda c: f(c, arg(x)(c)))


abs = _elementwise(lambda c, v: F.abs(v))
floor = _elementwise(lambda c, v: F.floor(v).cast(c.type(v)))
ceiling = _elementwise(lambda c, v: F.ceil(v).cast(c.type(v)))
sqrt = _elementwise(lambda c, v: F.sqrt(v))
exp = _elementwise(lambda c, v: F.exp(v))
log10 = _elementwise(lambda c, v: F.log10(v))


def log(x: Any, base: float = math.e) -> Expr:
    return Expr(lambda c: F.ln(arg(x)(c)) if base == math.e else F.ln(arg(x)(c)) / math.log(base))


def round(x: Any, digits: int = 0) -> Expr:
    """To the nearer of the two decimal neighbours as stored, ties to the even digit."""

    def build(c: Context) -> Column:
        v = arg(x)(c)
        if not c.floats(v):
            if digits >= 0:
                return v
            unit = 10**-digits
            return (F.rint(v / F.lit(unit)) * unit).cast(c.type(v))
        if digits >= 0:
            size = F.lit(10.0**digits)
            low, high = F.floor(F.abs(v) * size) / size, F.ceil(F.abs(v) * size) / size
            even = F.floor(F.abs(v) * size)
        else:
            size = F.lit(10.0**-digits)
            low, high = F.floor(F.abs(v) / size) * size, F.ceil(F.abs(v) / size) * size
            even = F.floor(F.abs(v) / size)
        down, up = F.abs(v) - low, high - F.abs(v)
        near_ = F.when((down < up) | ((down == up) & (even % 2 == 0)), low).otherwise(high)
        plain = F.abs(v) < 1e15
        return F.when(plain, F.signum(v) * near_).otherwise(v)

    return Expr(build)


def round_half_up(x: Any, digits: int = 0) -> Expr:
    size = 10.0**digits
    return Expr(lambda c: F.signum(v := arg(x)(c).cast("double")) * (F.floor(F.abs(v) * size + 0.5 + 1.5e-8) / size))


def signif_half_up(x: Any, digits: int = 6) -> Expr:
    def build(c: Context) -> Column:
        v = arg(x)(c).cast("double")
        size = F.pow(F.lit(10.0), digits - F.ceil(F.log10(F.abs(F.nullif(v, F.lit(0.0))))))
        return F.when(v == 0, v).otherwise(F.signum(v) * F.floor(F.abs(v) * size + 0.5 + 1.5e-8) / size)

    return Expr(build)


def round_to_fraction(x: Any, denominator: int, digits: Any = None) -> Expr:
    out = Expr(lambda c: F.rint(arg(x)(c) * denominator) / denominator)
    if digits is None:
        return out
    return round(out, int(math.ceil(math.log10(denominator))) + 1 if digits == "auto" else digits)


def _extreme(f: Callable[..., Column]) -> Callable[..., Expr]:
    def outer(*args: Any, na_rm: bool = False) -> Expr:
        def build(c: Context) -> Column:
            vs = [c.known(arg(a)(c)) for a in args]
            if len(vs) == 1:
                return vs[0]
            if na_rm:
                return f(*vs)
            missing = vs[0].isNull()
            for v in vs[1:]:
                missing = missing | v.isNull()
            return F.when(~missing, f(*vs))

        return Expr(build)

    return outer


pmin, pmax = _extreme(F.least), _extreme(F.greatest)
