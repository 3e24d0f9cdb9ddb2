"""Frequency tables, their adornments, and cleaning."""

from __future__ import annotations

import operator
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import Frame, Key, tidy, verb
from ..functions import expr as E
from ..functions import select as S
from .columns import set_names


def _label(f: Frame, name: str) -> Column:
    """A value as a table shows it."""
    v = E.quoted(name)
    if isinstance(f.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(v.isNull(), "NA_").when(F.isnan(v), "NaN").otherwise(v.cast("string"))
    return F.when(v.isNull(), "NA_").when(v.cast("string") == "", "emptystring_").otherwise(v.cast("string"))


@verb
def tabyl(f: Frame, /, column: str, column2: str | None = None, column3: str | None = None, *, show_na: bool = True, show_missing_levels: bool = True) -> Any:
    """Counts of one column with their shares; of two, a table of counts; of three, a dict of
    such tables."""
    f = f.but(groups=())
    if column3 is not None:
        keys = [r[0] for r in f.df.select(_label(f, column3).alias("k")).distinct().orderBy("k").collect()]
        return {k: tabyl(column, column2, show_na=show_na)(f.but(df=f.df.filter(_label(f, column3) == k))) for k in keys if show_na or k != "NA_"}
    if not show_na:
        f = f.but(df=f.df.filter(reduce(operator.and_, [E.quoted(c).isNotNull() for c in (column, column2) if c])))
    from .groups import by_keys, every_level

    if column2 is None:
        df = f.df.groupBy(E.quoted(column)).agg(F.count(F.lit(1)).alias("n"))
        if show_missing_levels:
            df = every_level(f.but(drop=False), df, (column,), {"n": 0})
        total = df.agg(F.sum("n").alias("all"), F.sum(F.when(E.quoted(column).isNotNull(), F.col("n"))).alias("valid"))
        df = df.crossJoin(F.broadcast(total))  # one row
        gaps = not f.df.filter(E.quoted(column).isNull()).isEmpty()
        columns = {"percent": E.divided(F.col("n"), F.col("all"))}
        if gaps and show_na:
            columns["valid_percent"] = F.when(E.quoted(column).isNotNull(), E.divided(F.col("n"), F.col("valid")))
        out = by_keys(f, df.withColumns(columns), (column,), ())
        return out.but(df=out.visible(out.df, [column, "n", *columns]), totals={"tabyl": True})
    names = [r[0] for r in f.df.select(_label(f, column2).alias("k")).distinct().orderBy("k").collect()]
    if column2 in f.levels and show_missing_levels:
        names = [*f.levels[column2], *[x for x in names if x not in f.levels[column2]]]
    names = sorted(names, key=lambda x: x in ("NA_", "NaN", "emptystring_")) if column2 not in f.levels else names
    df = f.df.groupBy(E.quoted(column)).agg(*[F.sum(F.when(_label(f, column2) == x, 1.0).otherwise(0.0)).alias(x) for x in names])
    if show_missing_levels:
        df = every_level(f.but(drop=False), df, (column,), dict.fromkeys(names, 0.0))
    return by_keys(f, df, (column,), ()).but(totals={"tabyl": True, "counts": None})


def _numbers(f: Frame, cols: Any = None) -> list[str]:
    """The numeric columns after the first, or those chosen."""
    if cols is not None:
        return S.resolve(f, cols if isinstance(cols, (list, tuple)) else [cols])
    return [c for c in f.columns[1:] if isinstance(f.schema[c].dataType, T.NumericType)]


def _remember(f: Frame) -> dict[str, Any]:
    return {**f.totals, "counts": f.totals.get("counts") or f}


@verb
def adorn_totals(f: Frame, /, where: Any = "row", *, fill: str = "-", na_rm: bool = True, name: str = "Total", cols: Any = None) -> Frame:
    where = [where] if isinstance(where, str) else list(where)
    chosen = _numbers(f, cols)
    out, marks = f.placed(), dict(f.totals)
    if "row" in where:
        last = E.hidden("t")
        sums = out.df.agg(*[(F.sum(E.quoted(c)) if na_rm else F.when(F.count(E.quoted(c)) == F.count(F.lit(1)), F.sum(E.quoted(c)))).cast(f.schema[c].dataType).alias(c) for c in chosen])
        first = f.columns[0]
        row = sums.select(
            F.lit(name).alias(first), *[E.quoted(c) if c in chosen else (F.lit(fill) if isinstance(f.schema[c].dataType, T.StringType) else F.lit(None).cast(f.schema[c].dataType)).alias(c) for c in f.columns[1:]], F.lit(1).alias(last)
        )
        df = out.df.withColumn(first, E.quoted(first).cast("string")).withColumn(last, F.lit(0)).unionByName(row, allowMissingColumns=True)
        out = out.but(df=df, order=(Key(last), *out.order))
        marks["row"] = last
    if "col" in where:
        total = reduce(operator.add, [F.coalesce(E.quoted(c), F.lit(0)) if na_rm else E.quoted(c) for c in chosen])
        out = out.but(df=out.df.withColumn(name, total))
        out = out.but(df=out.visible(out.df, [*f.columns, name]))
        marks["col"] = name
    return out.but(totals={**_remember(out), **marks, "counts": out})


@verb
def adorn_percentages(f: Frame, /, denominator: str = "row", *, na_rm: bool = True, cols: Any = None) -> Frame:
    chosen = _numbers(f, cols)
    counts = [c for c in chosen if c != f.totals.get("col")]
    mark = f.totals.get("row")
    df = f.df
    if denominator == "row":
        total = reduce(operator.add, [F.coalesce(E.quoted(c), F.lit(0)) for c in counts])
        df = df.withColumns({c: E.divided(E.quoted(c), total) for c in chosen})
    else:
        body = df.filter(F.col(mark) == 0) if mark else df
        sums = body.agg(*[F.sum(E.quoted(c)).alias(f"{E.HIDDEN}s_{c}") for c in chosen])
        df = df.crossJoin(F.broadcast(sums))  # one row
        of = {c: E.quoted(f"{E.HIDDEN}s_{c}") for c in chosen}
        if denominator == "all":
            all_ = reduce(operator.add, [of[c] for c in counts])
            of = dict.fromkeys(chosen, all_)
        df = df.withColumns({c: E.divided(E.quoted(c), of[c]) for c in chosen})
    return f.but(df=df, totals={**_remember(f)})


def _rounded(v: Column, digits: int, rounding: str) -> Column:
    e = E.Expr(lambda c: v)
    return (E.round if rounding == "half to even" else E.round_half_up)(e, digits)


@verb
def adorn_rounding(f: Frame, /, digits: int = 1, rounding: str = "half to even", *, cols: Any = None) -> Frame:
    c = f.context(())
    new = {x: _rounded(E.quoted(x), digits, rounding)(c) for x in _numbers(f, cols)}
    return f.but(df=f.df.withColumns(new), totals=_remember(f))


@verb
def adorn_pct_formatting(f: Frame, /, digits: int = 1, rounding: str = "half to even", affix_sign: bool = True, *, cols: Any = None) -> Frame:
    c = f.context(())
    new = {}
    for x in _numbers(f, cols):
        v = _rounded(E.quoted(x) * 100, digits, rounding)(c)
        new[x] = F.when(E.quoted(x).isNotNull(), F.concat(F.format_string(f"%.{digits}f", v), F.lit("%" if affix_sign else "")))
    keep = f.columns[1:] if cols is None else S.resolve(f, cols if isinstance(cols, (list, tuple)) else [cols])
    return f.but(df=f.df.withColumns({x: v for x, v in new.items() if x in keep and x != "n"}), totals=_remember(f))


@verb
def adorn_ns(f: Frame, /, position: str = "rear", *, ns: Any = None, format_func: Any = None, cols: Any = None) -> Frame:
    """Counts pasted beside the percentages; both tables are of report size."""
    counts = tidy(ns) if ns is not None else f.totals["counts"]
    first = f.columns[0]
    chosen = [c for c in (S.resolve(f, cols if isinstance(cols, (list, tuple)) else [cols]) if cols is not None else f.columns[1:]) if c in counts.columns and isinstance(counts.schema[c].dataType, T.NumericType)]
    n = counts.df.select(E.quoted(first).cast("string").alias(f"{E.HIDDEN}k"), *[E.quoted(c).cast("long").cast("string").alias(f"{E.HIDDEN}n_{c}") for c in chosen])
    if not chosen:
        return f
    wide = n.agg(*[F.max(F.length(E.quoted(f"{E.HIDDEN}n_{c}"))).alias(c) for c in chosen]).first()
    df = f.df.join(n, E.quoted(first).cast("string").eqNullSafe(F.col(f"{E.HIDDEN}k")), "left")
    new = {}
    for c in chosen:
        count = F.lpad(E.quoted(f"{E.HIDDEN}n_{c}"), wide[c] or 1, " ")
        own = E.quoted(c).cast("string")
        new[c] = F.concat(own, F.lit(" ("), count, F.lit(")")) if position == "rear" else F.concat(count, F.lit(" ("), own, F.lit(")"))
    return f.but(df=f.visible(df.withColumns(new)))


@verb
def adorn_title(f: Frame, /, placement: str = "top", row_name: str | None = None, col_name: str | None = None) -> Frame:
    first = row_name or f.columns[0]
    if placement == "combined":
        return set_names(f"{first}/{col_name or ''}", *f.columns[1:])(f)
    top = E.hidden("h")
    f = f.placed()
    texts = f.df.select(*[E.quoted(c).cast("string").alias(c) for c in f.columns], *[k.column for k in f.order], F.lit(1).alias(top))
    head = f.df.sparkSession.createDataFrame([(first, *f.columns[1:], 0)], ", ".join([*[f"`{c}` string" for c in f.columns], f"{top} int"]))
    out = Frame(texts.unionByName(head, allowMissingColumns=True), order=(Key(top), *f.order))
    return set_names("", col_name or "", *[" " * (i + 1) for i in range(len(f.columns) - 2)])(out)


# Cleaning.


def _present(f: Frame, c: str) -> Column:
    v = E.quoted(c)
    return (F.nanvl(v, F.lit(None)) if isinstance(f.schema[c].dataType, (T.FloatType, T.DoubleType)) else v).isNotNull()


@verb
def remove_empty(f: Frame, /, which: Any = "both", *, cutoff: float = 1) -> Frame:
    """Rows, then columns, of which nothing is present; with a cutoff, not more than that share."""
    which = ["rows", "cols"] if which == "both" else [which] if isinstance(which, str) else list(which)
    if "rows" in which:
        held = reduce(operator.add, [_present(f, c).cast("int") for c in f.columns])
        f = f.but(df=f.df.filter(held > 0 if cutoff == 1 else held / len(f.columns) > cutoff))
    if "cols" in which:
        row = f.df.agg(F.count(F.lit(1)), *[F.sum(_present(f, c).cast("long")) for c in f.columns]).first()
        total = row[0] or 0
        keep = [c for i, c in enumerate(f.columns) if (row[i + 1] or 0) > 0 and (cutoff == 1 or (row[i + 1] or 0) / max(total, 1) > cutoff)]
        f = f.but(df=f.visible(f.df, keep))
    return f


@verb
def remove_constant(f: Frame, /, *, na_rm: bool = False) -> Frame:
    row = f.df.agg(*[(F.count_distinct(E.quoted(c)) + (F.lit(0) if na_rm else F.coalesce(F.max(E.quoted(c).isNull().cast("int")), F.lit(0)))) for c in f.columns]).first()
    return f.but(df=f.visible(f.df, [c for i, c in enumerate(f.columns) if row[i] > 1]))


@verb
def find_header(f: Frame, /, *, value: Any = None, column: Any = 1) -> int:
    """The 1-based row without missing values, or with a value in a column."""
    from pyspark.sql import Window

    f = f.placed()
    name = f.columns[column - 1] if isinstance(column, int) else column
    test = E.quoted(name) == value if value is not None else reduce(operator.and_, [_present(f, c) for c in f.columns])
    at = f.df.withColumn(E.HIDDEN + "r", F.row_number().over(Window.orderBy(*[k.sort() for k in f.order]))).filter(test).agg(F.min(E.HIDDEN + "r")).first()[0]
    if at is None:
        raise ValueError("no such row")
    return at


@verb
def row_to_names(f: Frame, /, row_number: Any, *, remove_row: bool = True, remove_rows_above: bool = True, value: Any = None, column: Any = None) -> Frame:
    from pyspark.sql import Window

    f = f.placed()
    n = find_header(value=value, column=column or 1)(f) if row_number == "find_header" else row_number
    at = E.hidden("r")
    df = f.df.withColumn(at, F.row_number().over(Window.orderBy(*[k.sort() for k in f.order])))
    head = df.filter(F.col(at) == n).first()
    keep = F.col(at) > n if remove_row and remove_rows_above else F.col(at) != n if remove_row else F.col(at) >= n if remove_rows_above else F.lit(True)
    return set_names(*[str(head[c]) for c in f.columns])(f.but(df=f.visible(df.filter(keep))))


def describe_class(x: Any, *, strict_description: bool = True) -> str:
    kinds = {T.StringType: "character", T.BooleanType: "logical", T.DoubleType: "numeric", T.FloatType: "numeric", T.LongType: "integer", T.IntegerType: "integer", T.ShortType: "integer", T.ByteType: "integer", T.DateType: "Date", T.TimestampType: "POSIXct, POSIXt", T.TimestampNTZType: "POSIXct, POSIXt", T.ArrayType: "list", T.StructType: "list"}
    return kinds.get(type(x), type(x).__name__)


def compare_df_cols(*frames: Any, return_: str = "all", bind_method: str = "bind_rows", strict_description: bool = False, **named: Any) -> Frame:
    """The class of each column in each frame."""
    every = {**{f"df_{i + 1}": tidy(x) for i, x in enumerate(frames)}, **{k: tidy(v) for k, v in named.items()}}
    names = sorted({c for f in every.values() for c in f.columns})
    rows = []
    for c in names:
        kinds = [describe_class(f.schema[c].dataType) if c in f.columns else None for f in every.values()]
        known = [k for k in kinds if k] if bind_method == "bind_rows" else kinds
        same = len(set(known)) == 1
        if return_ == "all" or (return_ == "match") == same:
            rows.append((c, *kinds))
    spark = next(iter(every.values())).df.sparkSession
    return tidy(spark.createDataFrame(rows, ", ".join(["column_name string", *[f"`{k}` string" for k in every]])))


def compare_df_cols_same(*frames: Any, bind_method: str = "bind_rows", verbose: bool = True, **named: Any) -> bool:
    return compare_df_cols(*frames, return_="mismatch", bind_method=bind_method, **named).df.isEmpty()


@verb
def get_one_to_one(f: Frame, /) -> list[list[str]]:
    """Groups of columns that determine each other, from one aggregation."""
    cs = f.columns
    key = lambda *of: F.count_distinct(F.struct(*[E.quoted(c) for c in of]))
    pairs = [(a, b) for i, a in enumerate(cs) for b in cs[i + 1 :]]
    row = f.df.agg(*[key(c) for c in cs], *[key(a, b) for a, b in pairs]).first()
    one = dict(zip(cs, row[: len(cs)], strict=True))
    out: list[list[str]] = []
    for (a, b), n in zip(pairs, row[len(cs) :], strict=True):
        if n == one[a] == one[b]:
            home = next((g for g in out if a in g or b in g), None)
            if home is None:
                out.append([a, b])
            else:
                home += [c for c in (a, b) if c not in home]
    return out
