"""Methods of expressions, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import expr as e


def _plain(f):
    return lambda x, *a: e.Expr(lambda c: f(x(c), *a))


METHODS = {
    "mean": e.mean, "sum": e.sum, "min": e.min, "max": e.max, "median": e.median, "std": e.std, "var": e.var, "count": e.count, "n_unique": e.n_distinct, "first": e.first, "last": e.last,
    "any": e.any, "all": e.all, "quantile": e.quantile, "cum_sum": e.cumsum, "cumsum": e.cumsum, "cum_max": e.cummax, "cum_min": e.cummin, "cum_prod": e.cumprod, "rolling_mean": e.rolling_mean,
    "shift": lambda x, n=1: e.lag(x, n) if n >= 0 else e.lead(x, -n), "diff": lambda x, n=1: x - e.lag(x, n), "rank": e.min_rank,
    "arg_sort": lambda x: e.row_number(x) - 1, "abs": e.abs, "ceil": e.ceiling, "floor": e.floor, "sqrt": e.sqrt, "exp": e.exp, "log10": e.log10, "log": e.log,
    "round": lambda x, digits=0: e.Expr(lambda c: F.bround(x(c), digits)), "is_null": _plain(lambda v: v.isNull()), "is_not_null": _plain(lambda v: v.isNotNull()), "is_nan": e.is_nan,
    "is_in": lambda x, values: e.Expr(lambda c: x(c).isin(list(values))), "is_between": e.between_values, "fill_null": lambda x, v: e.coalesce(x, v),
    "fill_nan": lambda x, v: e.Expr(lambda c: F.nanvl(x(c), e.lit(v)(c))), "cast": _plain(lambda v, t: v.cast(t)), "replace": lambda x, mapping: e.recode(x, mapping), "alias": lambda x, name: e.Expr(x.build, name=name),
}
