"""Frames on top of each other and side by side, set operations, and changes by key."""

from __future__ import annotations

import operator
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import Frame, Key, tidy, verb
from ..functions import expr as E

WIDER = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def _common(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in WIDER and type(b) in WIDER:
        return max(a, b, key=lambda t: WIDER.index(type(t)))
    return T.StringType()


@verb
def bind_rows(f: Frame, /, *others: Any, id: str | None = None) -> Frame:
    """Rows of all frames by column name; what a frame lacks is missing, types are widened."""
    frames = [f, *[tidy(o) for x in others for o in (x if isinstance(x, (list, tuple)) else [x])]]
    names = list(dict.fromkeys(c for x in frames for c in x.columns))
    kinds = {c: reduce(_common, [x.schema[c].dataType for x in frames if c in x.columns]) for c in names}
    part, place = E.hidden("b"), E.hidden("o")
    parts = []
    for i, x in enumerate(frames):
        x = x.placed()
        columns = [(E.quoted(c) if c in x.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names]
        single = x.order[0] if len(x.order) == 1 and not x.order[0].down and isinstance(x.schema[x.order[0].column].dataType, T.LongType) else None
        at = E.quoted(single.column) if single else F.row_number().over(Window.orderBy(*[k.sort() for k in x.order])).cast("long")
        extra = [F.lit(str(i + 1)).alias(id)] if id else []
        parts.append(x.df.select(*extra, *columns, F.lit(i).alias(part), at.alias(place)))
    levels: dict[str, tuple[str, ...]] = {}
    for c in names:
        if all(c in x.levels for x in frames if c in x.columns):
            levels[c] = tuple(dict.fromkeys(v for x in frames if c in x.columns for v in x.levels[c]))
    return Frame(reduce(DataFrame.unionByName, parts), f.groups, (Key(part), Key(place)), levels=levels)


@verb
def bind_cols(f: Frame, /, *others: Any) -> Frame:
    """Columns side by side, by row position; frames of one row are repeated."""
    frames = [f, *[tidy(o) for o in others]]
    every = [c for x in frames for c in x.columns]
    out: DataFrame | None = None
    names: list[str] = []
    at, seen = E.hidden("o"), 0
    sizes = [x.df.count() for x in frames]
    if len({s for s in sizes if s != 1}) > 1:
        raise ValueError(f"frames of {sizes} rows can't stand side by side")
    for x, size in zip(frames, sizes, strict=True):
        x = x.placed()
        new = []
        for c in x.columns:
            seen += 1
            new.append(c if every.count(c) == 1 else f"{c}_{seen}")
        names += new
        columns = [E.quoted(c).alias(n) for c, n in zip(x.columns, new, strict=True)]
        if size == 1 and max(sizes) > 1:
            part = x.df.select(*columns)
            out = part if out is None else out.crossJoin(part)
            continue
        part = x.df.select(*columns, F.row_number().over(Window.orderBy(*[k.sort() for k in x.order])).alias(at))
        if out is None or at not in out.columns:
            out = part if out is None else out.crossJoin(part)
        else:
            out = out.join(part, at)
    order = (Key(at),) if at in out.columns else ()
    return Frame(out.select(*[E.quoted(n) for n in names], *[k.column for k in order]), order=order)


def _aligned(f: Frame, right: Any) -> tuple[DataFrame, DataFrame]:
    y = tidy(right)
    if set(y.columns) != set(f.columns):
        raise ValueError("the frames have different columns")
    return f.to_spark(), y.to_spark().select(*[E.quoted(c) for c in f.columns])


@verb
def union_all(f: Frame, /, right: Any) -> Frame:
    return bind_rows(right)(f)


@verb
def union(f: Frame, /, right: Any) -> Frame:
    from .rows import distinct

    _aligned(f, right)
    return distinct()(bind_rows(right)(f))


def _present(f: Frame, right: Any, kind: str) -> Frame:
    """Distinct rows of f that right has, or hasn't; missing values match."""
    from .rows import distinct

    _, b = _aligned(f, right)
    other = b.distinct().withColumnsRenamed({c: f"{E.HIDDEN}y{i}" for i, c in enumerate(f.columns)})
    on = reduce(operator.and_, [E.quoted(c).eqNullSafe(F.col(f"{E.HIDDEN}y{i}")) for i, c in enumerate(f.columns)])
    f = f.placed()
    return distinct()(f.but(df=f.df.join(other, on, kind)))


@verb
def intersect(f: Frame, /, right: Any) -> Frame:
    return _present(f, right, "left_semi")


@verb
def setdiff(f: Frame, /, right: Any) -> Frame:
    return _present(f, right, "left_anti")


@verb
def symdiff(f: Frame, /, right: Any) -> Frame:
    a, b = _aligned(f, right)
    both = a.withColumn(E.HIDDEN, F.lit(0)).union(b.withColumn(E.HIDDEN, F.lit(1)))
    out = both.groupBy(*[E.quoted(c) for c in f.columns]).agg(F.min(E.HIDDEN).alias("lo"), F.max(E.HIDDEN).alias("hi")).filter("lo = hi")
    return Frame(out.select(*[E.quoted(c) for c in f.columns]), f.groups)


@verb
def setequal(f: Frame, /, right: Any) -> bool:
    return symdiff(right)(f).df.isEmpty()


def _by(f: Frame, y: Frame, by: Any) -> list[str]:
    keys = [y.columns[0]] if by is None else [by] if isinstance(by, str) else list(by)
    f.need(*keys, *y.columns)
    return keys


def _unique(y: Frame, keys: list[str]) -> DataFrame:
    """y, which fails if its keys repeat."""
    c, g = E.hidden("c"), E.hidden("g")
    df = y.df.withColumn(c, F.count(F.lit(1)).over(Window.partitionBy(*[E.quoted(k) for k in keys])))
    df = df.withColumn(g, F.when(F.col(c) > 1, F.raise_error(F.lit("keys of y repeat")).cast("int"))).filter(F.col(g).isNull())
    return df.select(*[E.quoted(k) for k in y.columns])


def _renamed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[E.quoted(c).alias(f"{E.HIDDEN}y_{c}") for c in names], F.lit(1).alias(f"{E.HIDDEN}y"))


def _on(keys: list[str]) -> Any:
    return reduce(operator.and_, [E.quoted(k).eqNullSafe(E.quoted(f"{E.HIDDEN}y_{k}")) for k in keys])


def _matching(f: Frame, right: Any, by: Any, unmatched: str, how: str) -> Frame:
    y = tidy(right)
    keys = _by(f, y, by)
    f = f.placed()
    other = _renamed(y.df.distinct() if how == "delete" else _unique(y, keys), y.columns)
    gate = None
    if unmatched == "error":
        lone = _renamed(y.df, y.columns).join(f.df.select(*[E.quoted(k) for k in keys]).distinct(), _on(keys), "left_anti")
        gate = lone.agg(F.when(F.count(F.lit(1)) > 0, F.raise_error(F.lit("a key of y isn't in x")).cast("int")).alias(f"{E.HIDDEN}gate"))
    joined = f.df.join(other, _on(keys), "left_anti" if how == "delete" else "left")
    if gate is not None:  # one row, which fails or not
        joined = joined.crossJoin(gate).filter(F.col(f"{E.HIDDEN}gate").isNull()).drop(f"{E.HIDDEN}gate")
    if how == "delete":
        return f.but(df=joined)
    mark = F.col(f"{E.HIDDEN}y").isNotNull()
    out = []
    for c in f.df.columns:
        if c in y.columns and c not in keys:
            new = E.quoted(f"{E.HIDDEN}y_{c}").cast(f.schema[c].dataType)
            known = F.nanvl(E.quoted(c), F.lit(None)) if isinstance(f.schema[c].dataType, (T.FloatType, T.DoubleType)) else E.quoted(c)
            out.append((F.when(mark, new).otherwise(E.quoted(c)) if how == "update" else F.coalesce(known, new)).alias(c))
        else:
            out.append(E.quoted(c))
    return f.but(df=joined.select(*out))


@verb
def rows_insert(f: Frame, /, right: Any, *, by: Any = None, conflict: str = "error") -> Frame:
    y = tidy(right)
    keys = _by(f, y, by)
    old = f.df.select(*[E.quoted(k).alias(f"{E.HIDDEN}y_{k}") for k in keys]).distinct()
    if conflict == "ignore":
        return bind_rows(y.but(df=y.df.join(old, _on(keys), "left_anti")))(f)
    marked = y.df.join(old.withColumn(f"{E.HIDDEN}m", F.lit(1)), _on(keys), "left")
    g = E.hidden("g")
    checked = marked.withColumn(g, F.when(F.col(f"{E.HIDDEN}m").isNotNull(), F.raise_error(F.lit("a key of y is in x already")).cast("int"))).filter(F.col(g).isNull())
    return bind_rows(y.but(df=checked.select(*[E.quoted(c) for c in y.df.columns])))(f)


@verb
def rows_append(f: Frame, /, right: Any) -> Frame:
    y = tidy(right)
    f.need(*y.columns)
    return bind_rows(y)(f)


@verb
def rows_update(f: Frame, /, right: Any, *, by: Any = None, unmatched: str = "error") -> Frame:
    return _matching(f, right, by, unmatched, "update")


@verb
def rows_patch(f: Frame, /, right: Any, *, by: Any = None, unmatched: str = "error") -> Frame:
    return _matching(f, right, by, unmatched, "patch")


@verb
def rows_upsert(f: Frame, /, right: Any, *, by: Any = None) -> Frame:
    y = tidy(right)
    keys = _by(f, y, by)
    old = f.df.select(*[E.quoted(k).alias(f"{E.HIDDEN}y_{k}") for k in keys]).distinct()
    new = y.but(df=y.df.join(old, _on(keys), "left_anti"))
    return bind_rows(new)(_matching(f, y, by, "ignore", "update"))


@verb
def rows_delete(f: Frame, /, right: Any, *, by: Any = None, unmatched: str = "error") -> Frame:
    y = tidy(right)
    keys = [y.columns[0]] if by is None else [by] if isinstance(by, str) else list(by)
    return _matching(f, y.but(df=y.df.select(*[E.quoted(k) for k in keys])), keys, unmatched, "delete")
