"""Factors: text columns with an ordered list of levels, which the frame keeps.

A function here gives a column and its new levels. Where levels depend on the data, one
aggregation by level runs on the cluster and only the levels come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import expr as E
from .expr import Context, Expr, arg


def _factor(make: Callable[[Context, Column, tuple[str, ...]], tuple[Column, Any]]) -> Callable[[Any], Expr]:
    def outer(f: Any) -> Expr:
        x = arg(f)

        def factor(c: Context) -> tuple[Column, tuple[str, ...]]:
            inner = getattr(x, "factor", None)
            if inner is not None:
                v, levels = inner(c)
            else:
                v = x(c)
                levels = tuple(c.levels[x.name]) if x.name in c.levels else _sorted_levels(c, v)
            v = v.cast("string")
            out, new = make(c, v, levels)
            return out, tuple(new)

        out = Expr(lambda c: factor(c)[0], name=None)
        out.factor = factor
        return out

    return outer


def _values(c: Context, v: Column, *aggregates: Column) -> list[Any]:
    """A row for each level that occurs: the level, then the aggregates."""
    return [tuple(r) for r in c.df.groupBy(v.alias("level")).agg(F.count(F.lit(1)).alias("n"), *aggregates).filter("level IS NOT NULL").collect()]


def _sorted_levels(c: Context, v: Column) -> tuple[str, ...]:
    kind = c.type(v)
    got = [r[0] for r in c.df.select(v.alias("v")).filter("v IS NOT NULL").distinct().collect()]
    got = sorted(got)
    return tuple(got) if isinstance(kind, T.StringType) else tuple(str(x) for x in got)


def _appearance(c: Context, v: Column) -> list[str]:
    """No sort of the rows: the least of the last part within each level and the parts before it,
    which are few for rows in file order, then the least of all parts."""
    *outer, inner = c.place or [c.position()]
    names = [f"p{i}" for i in range(len(outer))]
    least = c.df.groupBy(v.alias("level"), *[p.alias(n) for p, n in zip(outer, names, strict=True)]).agg(F.min(inner).alias("last")).filter("level IS NOT NULL")
    first = least.groupBy("level").agg(F.min(F.struct(*names, "last")).alias("at"))
    return [r["level"] for r in first.agg(F.sort_array(F.collect_list(F.struct("at", "level"))).alias("seen")).first()["seen"]]


def as_factor(x: Any) -> Expr:
    """Levels in the order of appearance; of numbers, in theirs."""
    x = arg(x)

    def factor(c: Context) -> tuple[Column, tuple[str, ...]]:
        v = x(c)
        if x.name in c.levels:
            return v, tuple(c.levels[x.name])
        levels = _sorted_levels(c, v) if isinstance(c.type(v), T.NumericType) else tuple(_appearance(c, v))
        return v.cast("string"), levels

    out = Expr(lambda c: factor(c)[0])
    out.factor = factor
    return out


def _moved(levels: tuple[str, ...], moved: list[str], after: float) -> list[str]:
    rest = [x for x in levels if x not in moved]
    at = len(rest) if after == math.inf else int(after)
    return [*rest[:at], *moved, *rest[at:]]


def fct_relevel(f: Any, *levels: Any, after: float = 0) -> Expr:
    def make(c: Context, v: Column, old: tuple[str, ...]) -> tuple[Column, list[str]]:
        moved = [y for x in levels for y in (x(list(old)) if callable(x) else [x])]
        return v, _moved(old, [x for x in moved if x in old], after)

    return _factor(make)(f)


def _by_summary(f: Any, value: Callable[[Context], Column], default: float, desc: bool) -> Expr:
    def make(c: Context, v: Column, old: tuple[str, ...]) -> tuple[Column, list[str]]:
        got = {r[0]: r[2] for r in _values(c, v, value(c).alias("x"))}
        key = lambda x: default if got.get(x) is None else got[x]
        return v, sorted(old, key=key, reverse=desc)

    return _factor(make)(f)


def fct_reorder(f: Any, x: Any, fun: Any = E.median, *, na_rm: bool | None = None, default: float = math.inf, desc: bool = False, **kwargs: Any) -> Expr:
    def value(c: Context) -> Column:
        k = E.Context(c.df, aggregate=True, order=c.order, place=c.place)
        return fun(x, na_rm=na_rm is not False, **kwargs)(k)

    return _by_summary(f, value, default, desc)


def last2(x: Any, y: Any) -> Expr:
    """y at the greatest x."""
    return Expr(lambda c: c.reduce(lambda i, a, b: i.whole(F.max_by(b, a)), arg(x), arg(y)))


def first2(x: Any, y: Any) -> Expr:
    return Expr(lambda c: c.reduce(lambda i, a, b: i.whole(F.min_by(b, a)), arg(x), arg(y)))


def fct_reorder2(f: Any, x: Any, y: Any, fun: Any = last2, *, na_rm: bool | None = None, default: float = -math.inf, desc: bool = True, **kwargs: Any) -> Expr:
    return _by_summary(f, lambda c: fun(x, y)(E.Context(c.df, aggregate=True, order=c.order, place=c.place)), default, desc)


def _weights(c: Context, v: Column, w: Any) -> dict[str, float]:
    total = F.count(F.lit(1)) if w is None else F.sum(arg(w)(c))
    return {r[0]: r[2] or 0 for r in _values(c, v, total.alias("w"))}


def fct_infreq(f: Any, w: Any = None, *, ordered: bool | None = None) -> Expr:
    def make(c: Context, v: Column, old: tuple[str, ...]) -> tuple[Column, list[str]]:
        got = _weights(c, v, w)
        return v, sorted(old, key=lambda x: -got.get(x, 0))

    return _factor(make)(f)


def fct_inorder(f: Any, *, ordered: bool | None = None) -> Expr:
    def make(c: Context, v: Column, old: tuple[str, ...]) -> tuple[Column, list[str]]:
        seen = _appearance(c, v)
        return v, [*seen, *[x for x in old if x not in seen]]

    return _factor(make)(f)


def fct_rev(f: Any) -> Expr:
    return _factor(lambda c, v, old: (v, old[::-1]))(f)


def _mapped(v: Column, old: tuple[str, ...], to: dict[str, str | None]) -> tuple[Column, list[str]]:
    out = None
    for a, b in to.items():
        if a != b:
            out = (F if out is None else out).when(v == a, F.lit(b))
    out = v if out is None else out.otherwise(v)
    return out, [x for x in dict.fromkeys(to.get(a, a) for a in old) if x is not None]


def fct_recode(f: Any, **levels: Any) -> Expr:
    """new="old"; the name NULL removes levels."""
    to = {a: (None if new == "NULL" else new) for new, olds in levels.items() for a in ([olds] if isinstance(olds, str) else olds)}
    return _factor(lambda c, v, old: _mapped(v, old, to))(f)


def fct_collapse(f: Any, *, other_level: str | None = None, **levels: Any) -> Expr:
    to = {a: new for new, olds in levels.items() for a in ([olds] if isinstance(olds, str) else olds)}

    def make(c: Context, v: Column, old: tuple[str, ...]) -> tuple[Column, list[str]]:
        every = to if other_level is None else {a: to.get(a, other_level) for a in old}
        out, new = _mapped(v, old, every)
        if other_level in new:
            new = [*[x for x in new if x != other_level], other_level]
        return out, new

    return _factor(make)(f)


def _lumped(keep: Callable[[dict[str, float]], set[str]], f: Any, w: Any, other: str) -> Expr:
    def make(c: Context, v: Column, old: tuple[str, ...]) -> tuple[Column, list[str]]:
        kept = keep(_weights(c, v, w))
        out, new = _mapped(v, old, {a: a if a in kept else other for a in old})
        return out, [*[x for x in new if x != other], other] if other in new else new

    return _factor(make)(f)


def fct_lump_n(f: Any, n: int, w: Any = None, *, other_level: str = "Other", ties_method: str = "min") -> Expr:
    def keep(got: dict[str, float]) -> set[str]:
        sign = -1 if n > 0 else 1
        rank = {x: sum(sign * y < sign * got[x] for y in got.values()) + 1 for x in got}
        return {x for x in got if rank[x] <= abs(n)}

    return _lumped(keep, f, w, other_level)


def fct_lump_prop(f: Any, prop: float, w: Any = None, *, other_level: str = "Other") -> Expr:
    return _lumped(lambda got: {x for x in got if got[x] > prop * sum(got.values())}, f, w, other_level)


def fct_lump_min(f: Any, min: float, w: Any = None, *, other_level: str = "Other") -> Expr:
    return _lumped(lambda got: {x for x in got if got[x] >= min}, f, w, other_level)


def fct_drop(f: Any, only: Any = None) -> Expr:
    def make(c: Context, v: Column, old: tuple[str, ...]) -> tuple[Column, list[str]]:
        seen = {r[0] for r in _values(c, v)}
        gone = [x for x in old if x not in seen and (only is None or x in only)]
        return v, [x for x in old if x not in gone]

    return _factor(make)(f)


def fct_expand(f: Any, *levels: str, after: float = math.inf) -> Expr:
    return _factor(lambda c, v, old: (v, _moved(old, [x for x in levels if x not in old], after)))(f)


def fct_na_value_to_level(f: Any, level: str = "(Missing)") -> Expr:
    return _factor(lambda c, v, old: (F.coalesce(v, F.lit(level)), [*[x for x in old if x != level], level]))(f)


def fct_na_level_to_value(f: Any, extra_levels: Any = None) -> Expr:
    gone = [extra_levels] if isinstance(extra_levels, str) else list(extra_levels or ["(Missing)"])
    return _factor(lambda c, v, old: (F.when(~v.isin(gone), v), [x for x in old if x not in gone]))(f)
