"""Frames: a DataFrame with what the verbs need to know about it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr as E
from .functions.select import ColumnNotFoundError

VERBS: dict[str, Callable[..., Any]] = {}


@dataclass(frozen=True)
class Key:
    """A part of the rows' order: a column, hidden or not, and its direction."""

    column: str
    down: bool = False

    def sort(self) -> Column:
        c = E.quoted(self.column)
        return c.desc_nulls_last() if self.down else c.asc_nulls_last()

    def rising(self, df: DataFrame) -> list[Column] | None:
        """Columns that rise, the first before the next, as this part falls or rises; None of types without such."""
        c = E.quoted(self.column)
        parts = E.falling(c, df.schema[self.column].dataType) if self.down else [c]
        return parts and [c.isNull(), *parts]


@dataclass(frozen=True, eq=False)
class Frame:
    """Immutable. order: how rows are sorted when it matters; its hidden columns cost nothing
    until a verb reads them, as Spark prunes them. wide: the frame before a select, for
    verbs that may still use columns it left out."""

    df: DataFrame
    groups: tuple[str, ...] = ()
    order: tuple[Key, ...] = ()
    rowwise: bool = False
    drop: bool = True
    levels: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ordered: frozenset[str] = frozenset()
    problems_: tuple[DataFrame, ...] = ()
    totals: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        # Order keys get hidden copies, so that visible columns may go or change.
        plain = [k for k in self.order if not k.column.startswith(E.HIDDEN)]
        if plain:
            names = {k.column: E.hidden("o") for k in plain}
            object.__setattr__(self, "df", self.df.withColumns({h: E.quoted(c) for c, h in names.items()}))
            object.__setattr__(self, "order", tuple(Key(names.get(k.column, k.column), k.down) for k in self.order))

    @property
    def columns(self) -> list[str]:
        return [x for x in self.df.columns if not x.startswith(E.HIDDEN)]

    @property
    def schema(self) -> Any:
        return self.df.schema

    def but(self, **changes: Any) -> Frame:
        return replace(self, **changes)

    def context(self, groups: tuple[str, ...] | None = None, aggregate: bool = False) -> E.Context:
        me = self.placed()
        keys = [k.sort() for k in me.order]
        parts = [k.rising(me.df) for k in me.order]
        place = [E.quoted(me.order[0].column)] if len(parts) == 1 and not me.order[0].down else [x for p in parts for x in p] if all(parts) else None
        return E.Context(me.df, self.groups if groups is None else groups, keys, place, aggregate, self.rowwise, self.levels)

    def placed(self) -> Frame:
        """With an order, if need be that of the plan as it is now."""
        if self.order or self.df.isStreaming:
            return self
        name = E.hidden("o")
        return self.but(df=self.df.withColumn(name, F.monotonically_increasing_id()), order=(Key(name),))

    def visible(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        """df with the columns named, and the hidden ones that the order needs."""
        names = self.columns if names is None else names
        held = [k.column for k in self.order if k.column not in names and k.column in df.columns]
        return df.select(*[E.quoted(x) for x in dict.fromkeys([*names, *held])])

    def to_spark(self, sort: bool = False) -> DataFrame:
        df = self.df.orderBy(*[k.sort() for k in self.order]) if sort and self.order else self.df
        return df.select(*[E.quoted(x) for x in self.columns])

    def __rshift__(self, step: Any) -> Any:
        return step(self)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_") or name not in VERBS:
            raise AttributeError(name)
        return lambda *a, **k: VERBS[name](*a, **k)(self)

    def need(self, *names: str) -> None:
        for x in names:
            if x not in self.columns:
                raise ColumnNotFoundError(x, self.columns)


class Verb:
    """A step of a pipe that waits for its frame."""

    def __init__(self, name: str, run: Callable[[Frame], Any]):
        self.name, self.run = name, run

    def __call__(self, data: Any) -> Any:
        return self.run(tidy(data))

    def __rrshift__(self, data: Any) -> Any:
        return self(data)

    def __rshift__(self, step: Any) -> Verb:
        return Verb("pipe", lambda f: step(self.run(f)))


def verb(f: Callable[..., Any]) -> Callable[..., Any]:
    """Makes f(frame, ...) a verb: f(...) waits for a frame; with a frame first, it runs."""

    @wraps(f)
    def outer(*args: Any, **kwargs: Any) -> Any:
        return Verb(f.__name__, lambda frame: f(frame, *args, **kwargs))

    VERBS[f.__name__.rstrip("_")] = outer
    return outer


def tidy(data: Any = None, **columns: Any) -> Any:
    """A frame from a frame, a DataFrame, pandas, Arrow, a list of dicts or columns by name."""
    if data is None and not columns:
        return Verb("tidy", lambda f: f)
    if isinstance(data, Frame):
        return data
    if hasattr(data, "__tidy__"):
        return tidy(data.__tidy__())
    if isinstance(data, DataFrame):
        return Frame(data)
    spark = SparkSession.active()
    if data is None or isinstance(data, dict):
        import pyarrow as pa

        made = {**(data or {}), **columns}
        size = max((len(v) for v in made.values() if isinstance(v, (list, tuple))), default=1)
        data = pa.table({k: list(v) if isinstance(v, (list, tuple)) else [v] * size for k, v in made.items()})
    df = spark.createDataFrame(data)
    name = E.hidden("o")
    return Frame(df.withColumn(name, F.monotonically_increasing_id()), order=(Key(name),))
