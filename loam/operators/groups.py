"""Groups, summaries and counts."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, Key, verb
from ..functions import expr as E
from ..functions import select as S
from .columns import expanded, mutate
from .rows import transient


@verb
def group_by(f: Frame, /, *cols: Any, add: bool = False, drop: bool | None = None, **computed: Any) -> Frame:
    if computed:
        f = mutate(**computed)(f.but(groups=()) if not add else f)
    names = [*(f.groups if add else ()), *S.resolve(f, cols), *computed]
    return f.but(groups=tuple(dict.fromkeys(names)), rowwise=False, drop=f.drop if drop is None else drop)


@verb
def ungroup(f: Frame, /, *cols: Any) -> Frame:
    gone = S.resolve(f, cols) if cols else list(f.groups)
    return f.but(groups=tuple(g for g in f.groups if g not in gone), rowwise=False)


@verb
def rowwise(f: Frame, /, *cols: Any) -> Frame:
    return f.but(rowwise=True, groups=tuple(S.resolve(f, cols)))


@verb
def with_groups(f: Frame, /, cols: Any, fn: Callable[[Frame], Frame]) -> Frame:
    out = fn(group_by(*(cols if isinstance(cols, (list, tuple)) else [cols]))(f))
    return out.but(groups=tuple(g for g in f.groups if g in out.columns), rowwise=f.rowwise)


def by_keys(f: Frame, df: DataFrame, groups: tuple[str, ...], left: tuple[str, ...]) -> Frame:
    """A frame of summaries in the order of its keys, those of factors by level."""
    order, drop = [], []
    for g in groups:
        if g in f.levels:
            drop.append(name := E.hidden("l"))
            df = df.withColumn(name, F.array_position(F.array(*[F.lit(v) for v in f.levels[g]]), E.quoted(g)))
            order.append(Key(name))
        else:
            order.append(Key(g))
    return Frame(df, left, tuple(order), levels={g: f.levels[g] for g in groups if g in f.levels}, drop=f.drop)


def every_level(f: Frame, df: DataFrame, groups: tuple[str, ...], fill: dict[str, Any]) -> DataFrame:
    """df with rows for combinations of factor levels that don't occur."""
    factors = [g for g in groups if g in f.levels]
    if f.drop or not factors:
        return df
    spark = df.sparkSession
    grid = None
    for g in groups:
        part = spark.createDataFrame([(v,) for v in f.levels[g]], f"`{g}` string") if g in f.levels else df.select(E.quoted(g)).distinct()
        grid = part if grid is None else grid.crossJoin(part)
    on = None
    right = df.withColumnsRenamed({g: f"{E.HIDDEN}{g}" for g in groups})
    for g in groups:
        x = E.quoted(g).eqNullSafe(E.quoted(f"{E.HIDDEN}{g}"))
        on = x if on is None else on & x
    out = grid.join(right, on, "full")
    out = out.select(*[F.coalesce(E.quoted(g), E.quoted(f"{E.HIDDEN}{g}")).alias(g) for g in groups], *[E.quoted(x) for x in df.columns if x not in groups])
    return out.fillna({k: v for k, v in fill.items() if v is not None})


@verb
def summarise(f: Frame, /, *specs: Any, by: Any = None, groups: str | None = None, **named: Any) -> Frame:
    """A row for each group, sorted by keys, missing last; with by=, ungrouped and in the order
    of first appearance. Later summaries may use earlier ones."""
    keys = transient(f, by)
    new = expanded(f, specs, named)
    if f.rowwise:
        out = mutate(**new)(f.but(groups=()))
        return out.but(df=out.visible(out.df, [*f.groups, *new]), groups=f.groups, rowwise=False)
    if by is not None:
        f = f.placed()
    c = f.context(keys, aggregate=True)
    # Summaries that use earlier ones follow in another projection.
    aggregates: dict[str, Column] = {}
    later: dict[str, E.Expr] = {}
    made: set[str] = set()
    for name, value in new.items():
        e = E.lit(value)
        column = e(c)
        if _reads(column, made) or later and _reads(column, set(later)):
            later[name] = e
        else:
            aggregates[name] = column
        made.add(name)
    extra = []
    if by is not None and f.order and not f.order[0].down:
        extra = [F.min(E.quoted(f.order[0].column)).alias(first := E.hidden("f"))]
    columns = [a.alias(x) for x, a in aggregates.items()] + extra
    if keys or columns:
        df = c.df.groupBy(*[E.quoted(k) for k in keys]).agg(*(columns or [F.first(F.lit(1)).alias(E.hidden("x"))]))
    else:
        df = c.df.limit(1)
    for name, e in later.items():
        # of one row each, so that aggregates of summaries are these themselves
        k = E.Context(df, keys, levels=f.levels)
        k.rowwise = True
        df = df.withColumn(name, _single(e, df))
    empty = {name: 0 for name, v in new.items() if getattr(v, "zero", False)}
    df = every_level(f, df, keys, empty)
    left = () if by is not None or groups == "drop" else keys if groups in ("keep", "rowwise") else keys[:-1]
    out = by_keys(f, df, keys, left)
    if extra:
        out = out.but(order=(Key(first),))
    names = [*keys, *new]
    return out.but(df=out.visible(out.df, names), rowwise=groups == "rowwise")


def _single(e: E.Expr, df: DataFrame) -> Column:
    return e(E.Context(df, aggregate=False))


def _reads(column: Column, names: set[str]) -> bool:
    import re

    text = column._jc.toString()
    return any(re.search(rf"(?<![\w.]){re.escape(x)}(?![\w(])", text) for x in names)


summarize = summarise


@verb
def reframe(f: Frame, /, *specs: Any, by: Any = None, **named: Any) -> Frame:
    """Any number of rows for each group: aggregates and other values are repeated, arrays give
    a row for each element."""
    from pyspark.sql import types as T

    keys = transient(f, by)
    new = expanded(f, specs, named)
    out = summarise(groups="drop", **new)(f.but(groups=keys)) if keys else summarise(**new)(f)
    lists = [x for x in new if isinstance(out.schema[x].dataType, T.ArrayType)]
    if not lists:
        return out.but(groups=())
    rows = E.hidden("z")
    df = out.df.withColumn(rows, F.explode(F.arrays_zip(*[E.quoted(x) for x in lists])))
    df = df.select(*[E.quoted(x) if x not in lists else E.quoted(rows)[x].alias(x) for x in out.df.columns])
    return out.but(df=df, groups=())


def _free(name: str | None, taken: list[str]) -> str:
    if name is not None:
        return name
    name = "n"
    while name in taken:
        name += "n"
    return name


def _counted(f: Frame, keys: tuple[str, ...], wt: Any, sort: bool, name: str | None, left: tuple[str, ...]) -> Frame:
    name = _free(name, list(keys))
    c = f.context(keys, aggregate=True)
    v = F.count(F.lit(1)) if wt is None else F.coalesce(F.sum(E.arg(wt)(c.rows())), F.lit(0))
    df = c.df.groupBy(*[E.quoted(k) for k in keys]).agg(v.alias(name))
    df = every_level(f, df, keys, {name: 0})
    out = by_keys(f, df, keys, left)
    return out.but(order=(Key(name, True), *out.order)) if sort else out


@verb
def count(f: Frame, /, *cols: Any, wt: Any = None, sort: bool = False, name: str | None = None, drop: bool | None = None, **computed: Any) -> Frame:
    if computed:
        f = mutate(**computed)(f)
    keys = tuple(dict.fromkeys([*f.groups, *S.resolve(f, cols), *computed]))
    return _counted(f.but(drop=f.drop if drop is None else drop), keys, wt, sort, name, f.groups)


@verb
def tally(f: Frame, /, *, wt: Any = None, sort: bool = False, name: str | None = None) -> Frame:
    return _counted(f, f.groups, wt, sort, name, f.groups[:-1])


@verb
def add_count(f: Frame, /, *cols: Any, wt: Any = None, sort: bool = False, name: str | None = None, **computed: Any) -> Frame:
    if computed:
        f = mutate(**computed)(f)
    keys = tuple(dict.fromkeys([*f.groups, *S.resolve(f, cols), *computed]))
    name = _free(name, f.columns)
    out = mutate(**{name: E.n() if wt is None else E.sum(wt, na_rm=True)})(f.but(groups=keys)).but(groups=f.groups)
    return out.placed().but(order=(Key(name, True), *out.placed().order), df=out.placed().df) if sort else out


@verb
def add_tally(f: Frame, /, **options: Any) -> Frame:
    return add_count(**options)(f)


@verb
def group_data(f: Frame, /) -> Frame:
    """Keys and, in .rows, the positions of their rows from 1."""
    f = f.placed()
    at = f.context(()).order
    from pyspark.sql import Window

    df = f.df.withColumn(E.hidden("p"), F.lit(0))
    name = E.hidden("r")
    df = f.df.withColumn(name, F.row_number().over(Window.orderBy(*at)))
    out = df.groupBy(*[E.quoted(g) for g in f.groups]).agg(F.array_sort(F.collect_list(name)).alias(".rows"))
    return by_keys(f, out, f.groups, ())


@verb
def group_keys(f: Frame, /) -> Frame:
    return by_keys(f, f.df.select(*[E.quoted(g) for g in f.groups]).distinct(), f.groups, ())


@verb
def group_rows(f: Frame, /) -> list[list[int]]:
    out = group_data()(f)
    return [list(r[".rows"]) for r in out.to_spark(sort=True).collect()]


@verb
def group_size(f: Frame, /) -> list[int]:
    out = _counted(f, f.groups, None, False, "n", ())
    return [r["n"] for r in out.to_spark(sort=True).collect()]


@verb
def group_indices(f: Frame, /) -> list[int]:
    out = mutate(**{"i": E.cur_group_id()})(f)
    return [r["i"] for r in out.to_spark(sort=True).collect()]


@verb
def group_vars(f: Frame, /) -> list[str]:
    return list(f.groups)


groups = group_vars


@verb
def n_groups(f: Frame, /) -> int:
    return f.df.select(*[E.quoted(g) for g in f.groups]).distinct().count() if f.groups else 1


@verb
def group_trim(f: Frame, /) -> Frame:
    from ..functions.factors import fct_drop

    return mutate(**{g: fct_drop(g) for g in f.groups if g in f.levels})(f.but(groups=())).but(groups=f.groups)


def _keys(f: Frame) -> list[dict[str, Any]]:
    return [r.asDict() for r in group_keys()(f).to_spark(sort=True).collect()]


def _part(f: Frame, key: dict[str, Any]) -> Frame:
    df = f.df
    for k, v in key.items():
        df = df.filter(E.quoted(k).eqNullSafe(F.lit(v)))
    return f.but(df=df, groups=())


@verb
def group_split(f: Frame, /, *cols: Any) -> list[Frame]:
    f = group_by(*cols)(f) if cols else f
    return [_part(f, key) for key in _keys(f)]


@verb
def group_map(f: Frame, /, fn: Callable[..., Any], *cols: Any) -> list[Any]:
    f = group_by(*cols)(f) if cols else f
    return [fn(_part(f, key), key) for key in _keys(f)]


@verb
def group_walk(f: Frame, /, fn: Callable[..., Any]) -> Frame:
    for key in _keys(f):
        fn(_part(f, key), key)
    return f


@verb
def group_modify(f: Frame, /, fn: Callable[..., Any], *cols: Any, schema: Any = None) -> Frame:
    """fn takes a group without its keys, and its key. Given a schema it runs on pandas frames
    in parallel, else it's a pipeline on frames, whose results are bound together."""
    f = group_by(*cols)(f) if cols else f
    keys = list(f.groups)
    if schema is not None:
        def run(pdf: Any) -> Any:
            key = {k: pdf[k].iloc[0] for k in keys}
            out = fn(pdf.drop(columns=keys), key)
            for i, k in enumerate(keys):
                out.insert(i, k, key[k])
            return out

        kinds = ", ".join(f"`{k}` {f.schema[k].dataType.simpleString()}" for k in keys)
        return Frame(f.to_spark().groupBy(*[E.quoted(k) for k in keys]).applyInPandas(run, f"{kinds}, {schema}"), f.groups, tuple(Key(k) for k in keys))
    from .binds import bind_rows

    parts = []
    for key in _keys(f):
        from .columns import drop

        out = fn(drop(*keys)(_part(f, key)), key)
        df = out.to_spark().select(*[F.lit(v).cast(f.schema[k].dataType).alias(k) for k, v in key.items()], "*")
        parts.append(Frame(df))
    return bind_rows(*parts[1:])(parts[0]).but(groups=f.groups)


@verb
def group_nest(f: Frame, /, *cols: Any, name: str = "data") -> Frame:
    f = group_by(*cols)(f) if cols else f
    f = f.placed()
    rest = [x for x in f.columns if x not in f.groups]
    df = f.df.groupBy(*[E.quoted(g) for g in f.groups]).agg(nested(f, rest).alias(name))
    return by_keys(f, df, f.groups, ())


def nested(f: Frame, names: list[str], fields: dict[str, str] | None = None) -> Column:
    """Rows of a group as an array of structs, in order."""
    fields = fields or {}
    at = [(F.col(k.column)).alias(f"o{i}") for i, k in enumerate(f.order) if not k.down]
    rows = F.collect_list(F.struct(*at, F.struct(*[E.quoted(x).alias(fields.get(x, x)) for x in names]).alias("row")))
    return F.transform(F.array_sort(rows) if at else rows, lambda s: s["row"])


@verb
def nest_by(f: Frame, /, *cols: Any, name: str = "data") -> Frame:
    out = group_nest(*cols, name=name)(f)
    return out.but(rowwise=True, groups=tuple(x for x in out.columns if x != name))
