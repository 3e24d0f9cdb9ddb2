"""Verbs on columns: choose, name, move, make."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from ..frame import Frame, Key, Verb, verb
from ..functions import expr as E
from ..functions import select as S
from .rows import transient


def expanded(f: Frame, specs: tuple[Any, ...], named: dict[str, Any]) -> dict[str, Any]:
    """New columns in order: across() and dicts among specs, then keywords."""
    out: dict[str, Any] = {}
    for spec in specs:
        if isinstance(spec, S.Across):
            out |= spec.expand(f)
        elif isinstance(spec, dict):
            out |= spec
        elif isinstance(spec, E.Expr) and spec.name:
            out[spec.name] = spec
        else:
            raise TypeError(f"{spec!r} makes no column")
    return out | named


def renamed(f: Frame, names: dict[str, str]) -> Frame:
    """names: {old: new}. Groups, levels and order follow."""
    of = lambda x: names.get(x, x)
    return f.but(
        df=f.df.withColumnsRenamed(names), groups=tuple(map(of, f.groups)), levels={of(k): v for k, v in f.levels.items()}, order=tuple(Key(of(k.column), k.down) for k in f.order)
    )


@verb
def select(f: Frame, /, *cols: Any, **renames: str) -> Frame:
    names = S.resolve(f, cols) if cols else []
    new = {(old.name if isinstance(old, E.Expr) else old): k for k, old in renames.items()}
    f.need(*new)
    names = [*names, *[x for x in new if x not in names]]
    names = [*[g for g in f.groups if g not in names], *names]
    out = renamed(f, new) if new else f
    return out.but(df=out.visible(out.df, [new.get(x, x) for x in names]), totals={})


@verb
def drop(f: Frame, /, *cols: Any) -> Frame:
    gone = S.resolve(f, cols)
    if any(g in gone for g in f.groups):
        raise ValueError("a grouping column can't be dropped")
    return f.but(df=f.visible(f.df, [x for x in f.columns if x not in gone]), totals={})


@verb
def rename(f: Frame, /, **new: Any) -> Frame:
    old = {(v.name if isinstance(v, E.Expr) else v): k for k, v in new.items()}
    f.need(*old)
    return renamed(f, old)


@verb
def rename_with(f: Frame, /, fn: Callable[[str], str], *cols: Any) -> Frame:
    names = S.resolve(f, cols) if cols else f.columns
    return renamed(f, {x: fn(x) for x in names})


@verb
def set_names(f: Frame, /, *names: Any) -> Frame:
    flat = [y for x in names for y in (x if isinstance(x, (list, tuple)) else [x])]
    if len(flat) != len(f.columns):
        raise ValueError(f"{len(f.columns)} names are needed")
    return renamed(f, dict(zip(f.columns, flat, strict=True)))


@verb
def relocate(f: Frame, /, *cols: Any, before: Any = None, after: Any = None) -> Frame:
    moved = S.resolve(f, cols)
    return f.but(df=f.visible(f.df, _moved(f, f.columns, moved, before, after)))


def _moved(f: Frame, names: list[str], moved: list[str], before: Any, after: Any) -> list[str]:
    rest = [x for x in names if x not in moved]
    if before is not None:
        at = min(rest.index(x) for x in S.resolve(f, [before]) if x in rest)
    elif after is not None:
        at = max(rest.index(x) for x in S.resolve(f, [after]) if x in rest) + 1
    else:
        at = 0
    return [*rest[:at], *moved, *rest[at:]]


@verb
def mutate(f: Frame, /, *specs: Any, by: Any = None, keep: str = "all", before: Any = None, after: Any = None, **named: Any) -> Frame:
    """Adds or replaces columns, left to right. Aggregates are those of the row's group; None
    deletes a column; text is a value."""
    groups = transient(f, by)
    f = f.placed()
    new = expanded(f, specs, named)
    names, levels, found = list(f.columns), dict(f.levels), list(f.problems_)
    c = f.context(groups)
    used: set[str] = set()
    for name, value in new.items():
        if name in groups and value is None:
            raise ValueError("a grouping column can't be deleted")
        if value is None:
            names = [x for x in names if x != name]
            levels.pop(name, None)
            continue
        if isinstance(value, (list, tuple)):
            value = _by_position(c, value)
        factor = getattr(value, "factor", None)
        if factor is not None:
            column, levels[name] = factor(c)
        else:
            e = E.lit(value)
            if hasattr(e, "failed"):
                found.append((c.df, name, e, c.order))
            column = e(c)
            levels.pop(name, None)
        c.levels = levels
        c.df = c.df.withColumn(name, column)
        names += [name] * (name not in names)
        used.add(name)
    fresh = [x for x in new if x in names]
    if keep in ("none", "unused", "used"):
        held = set() if keep == "none" else _inputs(f, new) if keep == "used" else set(names) - _inputs(f, new)
        names = [x for x in names if x in held or x in groups or x in fresh]
    if before is not None or after is not None:
        names = _moved(f, names, [x for x in fresh if x not in f.columns], before, after)
    out = f.but(df=c.df, levels=levels, problems_=tuple(found), totals={})
    return out.but(df=out.visible(c.df, names))


def _by_position(c: E.Context, values: Any) -> E.Expr:
    held = F.array(*[F.lit(v) for v in values])
    return E.Expr(lambda k: F.get(held, (k.ranked(F.row_number(), k.order or [k.position()]) - 1).cast("int")))


def _inputs(f: Frame, new: dict[str, Any]) -> set[str]:
    """Columns that the expressions read."""
    out = set()
    for value in new.values():
        if isinstance(value, E.Expr):
            tree = value(f.context())._jc.toString()
            out |= {x for x in f.columns if re.search(rf"(?<!\w){re.escape(x)}(?!\w)", tree)}
    return out


@verb
def transmute(f: Frame, /, *specs: Any, by: Any = None, **named: Any) -> Frame:
    return mutate(*specs, by=by, keep="none", **named)(f)


def make_clean_names(names: list[str], *, case: str = "snake", unique: bool = True) -> list[str]:
    """Names of letters, digits and underscores, in one of several cases."""
    signs = {"%": "_percent_", "#": "_number_", "'": "", '"': ""}
    out: list[str] = []
    for name in names:
        for sign, word in signs.items():
            name = name.replace(sign, word)
        name = re.sub(r"([a-z\d])([A-Z])", r"\1_\2", name)
        name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
        words = [w.lower() for w in re.split(r"\W+|_+", name) if w] or ["x"]
        if words[0][0].isdigit():
            words[0] = "x" + words[0]
        joined = {
            "snake": lambda w: "_".join(w), "kebab": lambda w: "-".join(w), "camel": lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), "pascal": lambda w: "".join(x.capitalize() for x in w),
            "screaming_snake": lambda w: "_".join(w).upper(), "upper": lambda w: "_".join(w).upper(), "lower": lambda w: "".join(w), "title": lambda w: " ".join(x.capitalize() for x in w),
        }[case](words)
        made, k = joined, 2
        while unique and made in out:
            made, k = f"{joined}_{k}", k + 1
        out.append(made)
    return out


@verb
def clean_names(f: Frame, /, *, case: str = "snake", unique: bool = True) -> Frame:
    return set_names(*make_clean_names(f.columns, case=case, unique=unique))(f)


def names(data: Any) -> list[str]:
    return _frame(data).columns


colnames = names


def _frame(data: Any) -> Frame:
    from ..frame import tidy

    return tidy(data)


def ncol(data: Any) -> int:
    return len(_frame(data).columns)


def nrow(data: Any) -> int:
    return _frame(data).df.count()


def dim(data: Any) -> tuple[int, int]:
    return nrow(data), ncol(data)


def dtypes(data: Any) -> dict[str, Any]:
    f = _frame(data)
    return {x: f.schema[x].dataType for x in f.columns}


@verb
def summary(f: Frame, /, *, percentiles: Any = None) -> Frame:
    """A row for each column: counts, distinct values and, of numbers, the usual statistics."""
    from pyspark.sql import types as T

    shares = [0.25, 0.5, 0.75] if percentiles is None else list(percentiles)
    labels = [f"{100 * p:g}%" for p in shares]
    parts = []
    for x in f.columns:
        q, kind = E.quoted(x), f.schema[x].dataType
        number = isinstance(kind, T.NumericType)
        none = F.lit(None).cast("double")
        ordered = not isinstance(kind, (T.ArrayType, T.StructType, T.MapType))
        parts.append(
            F.struct(
                F.lit(x).alias("column"), F.count(q).alias("count"), F.sum(q.isNull().cast("long")).alias("null_count"), F.count_distinct(q).alias("n_unique"),
                (F.mean(q) if number else none).alias("mean"), (F.stddev_samp(q) if number else none).alias("std"), (F.min(q).cast("string") if ordered else F.lit(None).cast("string")).alias("min"),
                *[(F.percentile(q, F.lit(p)) if number else none).alias(label) for p, label in zip(shares, labels, strict=True)],
                (F.max(q).cast("string") if ordered else F.lit(None).cast("string")).alias("max"),
            )
        )
    return Frame(f.df.agg(F.array(*parts).alias("all")).select(F.inline("all")))


describe = summary


@verb
def pull(f: Frame, /, var: Any = -1, *, name: Any = None) -> Any:
    """One column's values, in order, or a dict by the names in another."""
    at = lambda v: f.columns[v - 1 if v > 0 else v] if isinstance(v, int) else v
    x = at(var)
    f.need(x)
    rows = f.but().df.orderBy(*[k.sort() for k in f.order]) if f.order else f.df
    if name is None:
        return [r[0] for r in rows.select(E.quoted(x)).collect()]
    return {r[0]: r[1] for r in rows.select(E.quoted(at(name)), E.quoted(x)).collect()}


@verb
def with_spark(f: Frame, /, fn: Callable[[Any], Any]) -> Frame:
    """Whatever fn makes of the DataFrame."""
    return Frame(fn(f.to_spark()))


def pipe(*steps: Any) -> Verb:
    def run(f: Frame) -> Any:
        for step in steps:
            f = step(f)
        return f

    return Verb("pipe", run)
