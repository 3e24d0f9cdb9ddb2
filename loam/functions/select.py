"""Choosing columns by name, place and type, and applying functions to many of them."""

from __future__ import annotations

import difflib
import operator
import re
from collections.abc import Callable, Iterable
from contextvars import ContextVar
from functools import reduce
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import expr as E


class ColumnNotFoundError(KeyError):
    """A column that the frame lacks."""

    def __init__(self, name: str, columns: Iterable[str]):
        columns = list(columns)
        near = difflib.get_close_matches(name, columns, 3)
        super().__init__(f"no column {name!r}" + (f"; did you mean {' or '.join(near)}?" if near else "") + f" Columns: {', '.join(columns)}")

    def __str__(self) -> str:
        return self.args[0]


class Selector:
    """A choice that is made once the columns are known. find: (frame) -> names in order."""

    def __init__(self, find: Callable[[Any], list[str]]):
        self.find = find

    def __or__(self, other: Any) -> Selector:
        return Selector(lambda f: list(dict.fromkeys([*self.find(f), *resolve(f, [other])])))

    def __and__(self, other: Any) -> Selector:
        return Selector(lambda f: [x for x in self.find(f) if x in resolve(f, [other])])

    def __sub__(self, other: Any) -> Selector:
        return Selector(lambda f: [x for x in self.find(f) if x not in resolve(f, [other])])

    def __invert__(self) -> Selector:
        return Selector(lambda f: [x for x in f.columns if x not in self.find(f)])

    def __neg__(self) -> Minus:
        return Minus(self)


class Minus:
    def __init__(self, of: Any):
        self.of = of


def resolve(frame: Any, specs: Iterable[Any]) -> list[str]:
    """Names that specs choose, in order: names (a leading - excludes), Selectors, positions
    from 1, columns, or lists of these. If the first spec excludes, all others are chosen."""
    out: dict[str, None] = {}
    for i, spec in enumerate(specs):
        minus = isinstance(spec, Minus)
        spec = spec.of if minus else spec
        if isinstance(spec, str) and spec.startswith("-") and spec not in frame.columns:
            minus, spec = True, spec[1:]
        if isinstance(spec, Selector):
            names = spec.find(frame)
        elif isinstance(spec, str):
            if spec not in frame.columns:
                raise ColumnNotFoundError(spec, frame.columns)
            names = [spec]
        elif isinstance(spec, E.Expr) and spec.name:
            names = resolve(frame, [spec.name])
        elif isinstance(spec, bool):
            raise TypeError("a position, a name or a selector is needed")
        elif isinstance(spec, int):
            minus = minus or spec < 0
            names = [frame.columns[abs(spec) - 1]]
        elif isinstance(spec, slice):
            a, b = frame.columns.index(spec.start), frame.columns.index(spec.stop)
            names = frame.columns[a : b + 1] if a <= b else frame.columns[b : a + 1][::-1]
        elif isinstance(spec, (list, tuple, set)):
            names = resolve(frame, spec)
        elif callable(spec):
            names = where(spec).find(frame)
        else:
            raise TypeError(f"{spec!r} doesn't choose columns")
        if minus:
            if i == 0:
                out = dict.fromkeys(frame.columns)
            for name in names:
                out.pop(name, None)
        else:
            out |= dict.fromkeys(names)
    return list(out)


def _named(test: Callable[[str], bool]) -> Selector:
    return Selector(lambda f: [x for x in f.columns if test(x)])


def _texts(match: Any, test: Callable[[str, str], bool], ignore_case: bool) -> Selector:
    many = [match] if isinstance(match, str) else list(match)
    fold = str.lower if ignore_case else str
    return Selector(lambda f: list(dict.fromkeys(x for m in many for x in f.columns if test(fold(x), fold(m)))))


def everything() -> Selector:
    return _named(lambda x: True)


def starts_with(match: Any, *, ignore_case: bool = True) -> Selector:
    return _texts(match, str.startswith, ignore_case)


def ends_with(match: Any, *, ignore_case: bool = True) -> Selector:
    return _texts(match, str.endswith, ignore_case)


def contains(match: Any, *, ignore_case: bool = True) -> Selector:
    return _texts(match, operator.contains, ignore_case)


def matches(pattern: str, *, ignore_case: bool = True) -> Selector:
    found = re.compile(pattern, re.I if ignore_case else 0)
    return _named(lambda x: bool(found.search(x)))


def num_range(prefix: str, values: Iterable[int], *, width: int | None = None) -> Selector:
    names = [f"{prefix}{str(v).zfill(width or 0)}" for v in values]
    return Selector(lambda f: [x for x in names if x in f.columns])


def col_range(first: Any, last: Any) -> Selector:
    return Selector(lambda f: resolve(f, [slice(resolve(f, [first])[0], resolve(f, [last])[0])]))


cols_between = col_range


def all_of(names: Iterable[str]) -> Selector:
    return Selector(lambda f: resolve(f, list(names)))


def any_of(names: Iterable[str]) -> Selector:
    return Selector(lambda f: [x for x in names if x in f.columns])


def where(predicate: Callable[[Any], bool]) -> Selector:
    return Selector(lambda f: [x for x in f.columns if (is_categorical_in(f, x) if predicate is is_categorical else predicate(f.schema[x].dataType))])


def last_col(offset: int = 0) -> Selector:
    return Selector(lambda f: [f.columns[-1 - offset]])


def group_cols() -> Selector:
    return Selector(lambda f: list(f.groups))


def _kind(*kinds: type, but: tuple[type, ...] = ()) -> Callable[[Any], bool]:
    return lambda dtype: isinstance(dtype, kinds) and not isinstance(dtype, but or ())


is_numeric = _kind(T.NumericType)
is_integer = _kind(T.IntegralType)
is_float = _kind(T.FloatType, T.DoubleType)
is_string = is_character = _kind(T.StringType)
is_boolean = is_bool = _kind(T.BooleanType)
is_datetime = _kind(T.DateType, T.TimestampType, T.TimestampNTZType)
is_temporal = _kind(T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)


def is_categorical(dtype: Any) -> bool:
    """Factors are text with levels, which a frame knows; see where()."""
    return False


def is_categorical_in(frame: Any, name: str) -> bool:
    return name in frame.levels


_column: ContextVar[str] = ContextVar("column")


def cur_column() -> str:
    """The name that across() is at."""
    return _column.get()


class Across:
    """Expressions for many columns. expand(frame) -> {name: Expr}."""

    def __init__(self, selector: Any, fns: Any, names: str | None = None, unpack: bool = False):
        self.selector, self.fns, self.names = selector, fns, names

    def expand(self, frame: Any) -> dict[str, E.Expr]:
        chosen = [x for x in resolve(frame, [self.selector]) if x not in frame.groups]
        fns = self.fns if isinstance(self.fns, dict) else {getattr(f, "__name__", str(i + 1)): f for i, f in enumerate(self.fns)} if isinstance(self.fns, (list, tuple)) else {None: self.fns}
        template = self.names or ("{col}" if None in fns else "{col}_{fn}")
        out = {}
        for name in chosen:
            for label, fn in fns.items():
                token = _column.set(name)
                try:
                    out[template.format(col=name, fn=label)] = E.lit(fn(E.col(name)))
                finally:
                    _column.reset(token)
        return out


def across(selector: Any, fns: Any, *, names: str | None = None, unpack: bool = False) -> Across:
    return Across(selector, fns, names, unpack)


class Columns(E.Expr):
    """A choice of columns as one expression: a struct, and the numbers of each row together."""

    def __init__(self, selectors: tuple[Any, ...], rowwise: bool = False):
        self.selectors = selectors
        super().__init__(lambda c: F.struct(*[E.quoted(x) for x in self.find(c)]))

    def find(self, context: E.Context) -> list[str]:
        return resolve(_View(context), self.selectors or (everything(),))

    def across_row(self, how: str, na_rm: bool = False) -> E.Expr:
        return E.Expr(lambda c: horizontal(how, [c.known(E.quoted(x)) for x in self.find(c)], na_rm))

    def __getattr__(self, name: str):
        if name in HORIZONTAL:
            return lambda na_rm=False: self.across_row(name, na_rm)
        return super().__getattr__(name)


class _View:
    def __init__(self, context: E.Context):
        self.schema = context.df.schema
        self.columns = [x for x in context.df.columns if not x.startswith(E.HIDDEN)]
        self.groups, self.levels = context.groups, context.levels


HORIZONTAL = ("sum", "mean", "min", "max", "median", "std", "any", "all", "first", "last")


def horizontal(how: str, vs: list[Any], na_rm: bool) -> Any:
    missing = reduce(lambda a, b: a | b, [v.isNull() for v in vs])
    held = reduce(lambda a, b: a + b, [v.isNotNull().cast("long") for v in vs])
    if how in ("sum", "mean"):
        total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0)) for v in vs])
        out = total if how == "sum" else E.divided(total, held)
    elif how in ("min", "max"):
        out = (F.least if how == "min" else F.greatest)(*vs) if len(vs) > 1 else vs[0]
    elif how in ("first", "last"):
        return vs[0] if how == "first" else vs[-1]
    elif how in ("any", "all"):
        op = operator.or_ if how == "any" else operator.and_
        return reduce(op, [F.coalesce(v, F.lit(how == "all")) for v in vs] if na_rm else vs)
    else:
        array = F.array_sort(F.filter(F.array(*[v.cast("double") for v in vs]), lambda x: x.isNotNull()))
        size = F.size(array)
        if how == "median":
            out = (F.get(array, F.floor((size - 1) / 2).cast("int")) + F.get(array, F.floor(size / 2).cast("int"))) / 2
        else:
            mean = F.aggregate(array, F.lit(0.0), lambda a, x: a + x) / F.nullif(size, F.lit(0))
            out = F.sqrt(F.aggregate(array, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.nullif(size - 1, F.lit(0)))
    return out if na_rm else F.when(~missing, out)


def pick(*selectors: Any) -> Columns:
    return Columns(selectors)


def c_across(*selectors: Any) -> Columns:
    return Columns(selectors, rowwise=True)


def _row_names(c: E.Context, cols: tuple) -> list[str]:
    """The columns that selectors, or pick() of some, stand for; without any, the numbers."""
    picked = [x for x in cols if isinstance(x, Columns)]
    rest = [x for x in cols if not isinstance(x, Columns)]
    names = [x for p in picked for x in p.find(c)]
    return names + (resolve(_View(c), rest or (where(is_numeric),)) if rest or not picked else [])


def row_sums(*cols: Any, na_rm: bool = False, min_count: int | None = None) -> E.Expr:
    def build(c: E.Context) -> Any:
        vs = [c.known(E.quoted(x)) for x in _row_names(c, cols)]
        out = horizontal("sum", vs, na_rm)
        if min_count is not None:
            out = F.when(reduce(lambda a, b: a + b, [v.isNotNull().cast("long") for v in vs]) >= min_count, out)
        return out

    return E.Expr(build)


def row_means(*cols: Any, na_rm: bool = False) -> E.Expr:
    def build(c: E.Context) -> Any:
        vs = [c.known(E.quoted(x)) for x in _row_names(c, cols)]
        held = reduce(lambda a, b: a + b, [v.isNotNull().cast("long") for v in vs])
        return F.when(held > 0, horizontal("mean", vs, na_rm))

    return E.Expr(build)


def _every(op: Callable[[Any, Any], Any]) -> Callable[[Any, Callable], E.Expr]:
    def outer(selector: Any, predicate: Callable[[E.Expr], E.Expr]) -> E.Expr:
        return E.Expr(lambda c: reduce(op, [E.lit(predicate(E.col(x)))(c) for x in resolve(_View(c), [selector])]))

    return outer


if_any, if_all = _every(operator.or_), _every(operator.and_)


def cur_group() -> E.Expr:
    """The keys of the row's group, as a struct."""
    return E.Expr(lambda c: F.struct(*[E.quoted(g) for g in c.groups]))


def cur_group_rows() -> E.Expr:
    """Places of rows in the frame, from 0."""

    def build(c: E.Context) -> Any:
        held, c.groups = c.groups, []
        try:
            return c.ranked(F.row_number(), c.order or [c.position()]).cast("long") - 1
        finally:
            c.groups = held

    return E.Expr(build)
