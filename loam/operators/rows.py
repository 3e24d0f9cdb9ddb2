"""Verbs on rows: keep, sort, take, sample."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import Frame, Key, verb
from ..functions import expr as E
from ..functions import select as S


def transient(f: Frame, by: Any) -> tuple[str, ...]:
    """Groups of this verb alone: those of the frame, or by."""
    if by is None:
        return f.groups
    if f.groups or f.rowwise:
        raise ValueError("by= can't be combined with a grouped or rowwise frame")
    return tuple(S.resolve(f, by if isinstance(by, (list, tuple)) else [by]))


def _tested(f: Frame, predicates: tuple[Any, ...], by: Any) -> tuple[E.Context, Column]:
    c = f.context(transient(f, by))
    out = None
    for p in predicates:
        v = E.lit(p)(c)
        out = v if out is None else out & v
    return c, F.lit(True) if out is None else out


@verb
def filter(f: Frame, /, *predicates: Any, by: Any = None) -> Frame:
    c, test = _tested(f, predicates, by)
    return f.but(df=f.visible(c.df.filter(test)), totals={})


@verb
def filter_out(f: Frame, /, *predicates: Any, by: Any = None) -> Frame:
    """Rows for which the predicates aren't all true; unknown ones stay."""
    c, test = _tested(f, predicates, by)
    return f.but(df=f.visible(c.df.filter(F.coalesce(~test, F.lit(True)))), totals={})


@verb
def arrange(f: Frame, /, *keys: Any, by_group: bool = False) -> Frame:
    """Stable; missing values and not-a-number last both ways. Nothing is sorted until rows
    leave the engine or a verb depends on their order."""
    f = f.placed()
    c = f.context()
    keys = ([E.col(g) for g in f.groups] if by_group else []) + list(keys)
    new = []
    for key in keys:
        down = isinstance(key, E.Descending)
        e = key.of if down else E.arg(key)
        v = e(c)
        if e.name in c.levels:
            v = F.array_position(F.array(*[F.lit(x) for x in c.levels[e.name]]), v)
        new.append(Key((name := E.hidden("k")), down))
        c.df = c.df.withColumn(name, c.known(v))
    out = f.but(df=c.df, order=(*new, *f.order))
    return out.but(df=out.visible(out.df))


@verb
def distinct(f: Frame, /, *cols: Any, keep_all: bool = False, maintain_order: bool = True, **computed: Any) -> Frame:
    """The first row of each combination. Without an order to keep, a plain deduplication."""
    if computed:
        from .columns import mutate

        f = mutate(**computed)(f)
    keys = list(dict.fromkeys([*f.groups, *S.resolve(f, cols), *computed])) or f.columns
    names = f.columns if keep_all else keys
    if not maintain_order and not keep_all:
        return f.but(df=f.df.select(*[E.quoted(x) for x in keys]).distinct(), order=())
    f = f.placed()
    w = Window.partitionBy(*[E.quoted(x) for x in keys]).orderBy(*[k.sort() for k in f.order])
    at = E.hidden("r")
    df = f.df.withColumn(at, F.row_number().over(w)).filter(F.col(at) == 1)
    return f.but(df=f.visible(df, names))


def _sized(n: int | None, prop: float | None, size: Column) -> Column:
    """Rows to take of a group: negative numbers leave so many out."""
    if n is not None and prop is not None:
        raise ValueError("give n or prop, not both")
    if prop is not None:
        return F.floor(size * (prop if prop >= 0 else 1 + prop))
    n = 1 if n is None else n
    return F.lit(n) if n >= 0 else F.greatest(size + n, F.lit(0))


def _grouped(f: Frame, groups: tuple[str, ...], by: Any) -> Frame:
    """Rows group by group: in the order of keys, or of first appearance."""
    if not groups or by is not None:
        return f
    return arrange(*groups)(f)


def _first(f: Frame, keys: list[Column], n: int | None, prop: float | None, by: Any, rank: Column | None = None) -> Frame:
    groups = transient(f, by)
    part = Window.partitionBy(*[E.quoted(g) for g in groups])
    at, size = E.hidden("r"), E.hidden("n")
    df = f.df.withColumn(at, (F.row_number() if rank is None else rank).over(part.orderBy(*keys)))
    if prop is not None or (n or 0) < 0:
        df = df.withColumn(size, F.count(F.lit(1)).over(part))
        df = df.filter(F.col(at) <= _sized(n, prop, F.col(size)))
    else:
        df = df.filter(F.col(at) <= (1 if n is None else n))
    return _grouped(f.but(df=f.visible(df)), groups, by)


@verb
def slice_head(f: Frame, /, *, n: int | None = None, prop: float | None = None, by: Any = None) -> Frame:
    f = f.placed()
    if not transient(f, by) and prop is None and (n or 0) >= 0:
        return f.but(df=f.df.orderBy(*[k.sort() for k in f.order]).limit(1 if n is None else n))
    return _first(f, [k.sort() for k in f.order], n, prop, by)


@verb
def slice_tail(f: Frame, /, *, n: int | None = None, prop: float | None = None, by: Any = None) -> Frame:
    f = f.placed()
    back = [E.quoted(k.column).asc_nulls_first() if k.down else E.quoted(k.column).desc_nulls_first() for k in f.order]
    if not transient(f, by) and prop is None and (n or 0) >= 0:
        return f.but(df=f.df.orderBy(*back).limit(1 if n is None else n))
    return _first(f, back, n, prop, by)


@verb
def head(f: Frame, /, n: int = 6) -> Frame:
    return slice_head(n=n)(f)


@verb
def slice_min(f: Frame, /, order_by: Any, **options: Any) -> Frame:
    return _ranked(f, order_by, False, **options)


@verb
def slice_max(f: Frame, /, order_by: Any, **options: Any) -> Frame:
    return _ranked(f, order_by, True, **options)


def _ranked(f: Frame, order_by: Any, down: bool, *, n: int | None = None, prop: float | None = None, with_ties: bool = True, na_rm: bool = False, by: Any = None) -> Frame:
    """The n least or greatest rows of each group by min-rank; missing values rank last."""
    f = f.placed()
    groups = transient(f, by)
    c = f.context(groups)
    name = E.hidden("k")
    df = c.df.withColumn(name, c.known(E.arg(order_by)(c)))
    if na_rm:
        df = df.filter(F.col(name).isNotNull())
    key = Key(name, down)
    sorted_ = f.but(df=df, order=(key, *f.order))
    keys = [key.sort()] if with_ties else [k.sort() for k in sorted_.order]
    if not groups and not with_ties and prop is None and (n or 0) >= 0:
        return sorted_.but(df=df.orderBy(*keys).limit(1 if n is None else n))
    return _first(sorted_, keys, n, prop, by, F.rank() if with_ties else None)


@verb
def slice(f: Frame, /, *rows: int, by: Any = None) -> Frame:
    """Positions from 1; negative ones leave rows out."""
    rows = [x for r in rows for x in (r if isinstance(r, (list, tuple, range)) else [r])]
    if {r > 0 for r in rows if r} == {True, False}:
        raise ValueError("positions must be all positive or all negative")
    f = f.placed()
    groups = transient(f, by)
    at = E.hidden("r")
    w = Window.partitionBy(*[E.quoted(g) for g in groups]).orderBy(*[k.sort() for k in f.order])
    df = f.df.withColumn(at, F.row_number().over(w))
    test = F.col(at).isin([abs(r) for r in rows])
    df = df.filter(~test if rows and rows[0] < 0 else test)
    return _grouped(f.but(df=f.visible(df)), groups, by)


@verb
def slice_sample(f: Frame, /, *, n: int | None = None, prop: float | None = None, weight_by: Any = None, replace: bool = False, seed: int | None = None, by: Any = None) -> Frame:
    """Exactly n rows of each group, or all. Weighted draws without replacement take the
    least of -log(u) / w; draws with replacement look up uniform numbers in running weights."""
    f = f.placed()
    groups = transient(f, by)
    c = f.context(groups)
    u = F.rand() if seed is None else F.rand(seed)
    if replace:
        w = E.arg(weight_by)(c).cast("double") if weight_by is not None else F.lit(1.0)
        part = Window.partitionBy(*[E.quoted(g) for g in groups])
        hi, all_, size, wname = (E.hidden(x) for x in "htnw")
        df = c.df.withColumn(wname, w).withColumn(hi, F.sum(wname).over(part.orderBy(*[k.sort() for k in f.order]).rowsBetween(Window.unboundedPreceding, 0)))
        df = df.withColumns({all_: F.sum(wname).over(part), size: F.count(F.lit(1)).over(part)})
        wanted = df.groupBy(*[E.quoted(g) for g in groups]).agg(F.first(all_).alias("t"), F.first(size).alias("s"))
        draws = wanted.withColumn("d", F.explode(F.sequence(F.lit(1), _sized(n, prop, F.col("s")).cast("int")))).filter("d >= 1")
        draws = draws.withColumn("u", u * F.col("t")).withColumnsRenamed({g: f"{E.HIDDEN}g{i}" for i, g in enumerate(groups)})
        on = (F.col("u") >= F.col(hi) - F.col(wname)) & (F.col("u") < F.col(hi))
        for i, g in enumerate(groups):
            on = on & E.quoted(g).eqNullSafe(F.col(f"{E.HIDDEN}g{i}"))
        return f.but(df=f.visible(df.join(draws, on)))
    key = u
    if weight_by is not None:
        w = E.arg(weight_by)(c).cast("double")
        w = F.when(w.isNull() | F.isnan(w) | (w < 0) | (w == math.inf), F.raise_error(F.lit("weights must be finite and not negative")).cast("double")).otherwise(w)
        key = F.when(w > 0, -F.ln(F.greatest(u, F.lit(1e-300))) / F.nullif(w, F.lit(0.0))).otherwise(F.lit(math.inf))
    name = E.hidden("u")
    g = f.but(df=c.df.withColumn(name, key))
    return _first(g, [F.col(name).asc()], n, prop, by)


@verb
def sample_n(f: Frame, /, n: int, *, seed: int | None = None) -> Frame:
    return slice_sample(n=n, seed=seed)(f)


@verb
def sample_frac(f: Frame, /, frac: float, *, seed: int | None = None) -> Frame:
    return slice_sample(prop=frac, seed=seed)(f)


@verb
def drop_na(f: Frame, /, *cols: Any) -> Frame:
    names = S.resolve(f, cols) or f.columns
    return f.but(df=f.df.dropna(subset=names), totals={})


@verb
def get_dupes(f: Frame, /, *cols: Any) -> Frame:
    """Rows whose keys repeat, with dupe_count, most repeated first."""
    keys = S.resolve(f, cols) or f.columns
    if "dupe_count" in f.columns:
        raise ValueError("there is a column dupe_count already")
    w = Window.partitionBy(*[E.quoted(x) for x in keys])
    df = f.df.withColumn("dupe_count", F.count(F.lit(1)).over(w)).filter("dupe_count > 1")
    names = [*keys, "dupe_count", *[x for x in f.columns if x not in keys]]
    return f.but(df=f.visible(df, names), order=(Key("dupe_count", True), *[Key(x) for x in keys], *f.order))
