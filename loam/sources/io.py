"""Readers and writers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame, Key, tidy, verb
from ..functions import convert as C
from ..functions import expr as E


def _spark() -> SparkSession:
    return SparkSession.active()


def _paths(source: Any) -> list[str]:
    return [str(x) for x in (source if isinstance(source, (list, tuple)) else [source])]


def _in_file_order(df: DataFrame) -> Frame:
    """Row order by file and place in it; these columns cost nothing unless they are read."""
    path, row = E.hidden("f"), E.hidden("o")
    df = df.withColumns({path: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})
    return Frame(df, order=(Key(path), Key(row)))


def scan_parquet(source: Any, **options: Any) -> Frame:
    return _in_file_order(_spark().read.options(**options).parquet(*_paths(source)))


def scan_ipc(source: Any, **options: Any) -> Frame:
    """Arrow files, each read in a task of its own. Paths are those of a file system that all
    executors mount."""
    import pyarrow.ipc

    spark = _spark()
    names = [str(p) for x in _paths(source) for p in (sorted(Path(x).parent.glob(Path(x).name)) if re.search(r"[*?\[]", x) else [x])]

    def opened(name: str) -> Any:
        try:
            return pa.ipc.open_file(pa.memory_map(name))
        except pa.ArrowInvalid:
            return None

    reader = opened(names[0])
    schema = reader.schema if reader else pa.ipc.open_stream(pa.memory_map(names[0])).schema
    from pyspark.sql.pandas.types import from_arrow_schema

    def read(batches: Any) -> Any:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                r = opened(name)
                if r is None:
                    yield from pa.ipc.open_stream(pa.memory_map(name))
                else:
                    for i in range(r.num_record_batches):
                        yield r.get_batch(i)

    files = spark.createDataFrame([(n,) for n in names], "name string").repartition(len(names))
    return tidy(files.mapInArrow(read, from_arrow_schema(schema)))


GUESSED = 100
#: Column types by letter or name.
KINDS = {
    "c": None, "character": None, "d": C.parse_double, "double": C.parse_double, "i": C.parse_integer, "integer": C.parse_integer, "l": C.parse_logical, "logical": C.parse_logical,
    "n": C.parse_number, "number": C.parse_number, "D": C.ymd, "date": C.ymd, "T": C.ymd_hms, "datetime": C.ymd_hms,
}


def _after(lines: int) -> Any:
    """Text and file of the lines past the first ones of each file. A file's blocks are read in
    order within a task, so its first lines are the first of its block from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        whole: dict[str, bool] = {}
        for batch in batches:
            path, start, length, size = (batch.column(i) for i in range(1, 5))
            first = start.to_numpy() == 0
            new = np.ones(len(first), bool)
            new[1:] = (first[1:] != first[:-1]) | pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False) if len(first) else []
            keep, runs = np.ones(len(first), bool), np.append(np.flatnonzero(new), len(first)).tolist()
            for a, b in zip(runs[:-1], runs[1:], strict=True):
                if first[a]:
                    p = path[a].as_py()
                    keep[a : min(b, a + max(lines - seen.get(p, 0), 0))] = False
                    seen[p] = seen.get(p, 0) + b - a
                    whole[p] = length[a].as_py() >= size[a].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0), path], names=["value", "p"]).filter(pa.array(keep))
        for p, n in seen.items():
            if n < lines and not whole[p]:
                raise ValueError(f"the lines to skip go beyond the first block of {p}; raise spark.sql.files.maxPartitionBytes")

    return run


def _csv(source: Any, *, col_types: Any = None, na: Any = None, skip: int | None = None, comment: str | None = None, trim_ws: bool = False, id: str | None = None, encoding: str = "utf-8", strict: bool = False, locale: Any = None, delim: str | None = None, guess: bool, col_names: Any = True) -> Frame:
    if encoding.lower().replace("-", "") != "utf8":
        raise ValueError("only UTF-8 can be read")
    spark = _spark()
    reader = spark.read.option("sep", delim or ",").option("quote", '"').option("escape", '"').option("multiLine", False).option("ignoreLeadingWhiteSpace", trim_ws).option("ignoreTrailingWhiteSpace", trim_ws).option("nullValue", "\0").option("emptyValue", "")
    if comment:
        reader = reader.option("comment", comment)
    if skip:
        # the header is the line after those skipped, of each file
        first = spark.read.text(_paths(source)[0]).limit(skip + 1).collect()[skip][0]
        names = [x.strip().strip('"') for x in first.split(delim or ",")]
        place = ("file_path", "file_block_start", "file_block_length", "file_size")
        whole = spark.read.text(_paths(source)).select("value", *[F.col(f"_metadata.{c}") for c in place])
        df = whole.mapInArrow(_after(skip + 1), "value string, p string").select(F.from_csv("value", ", ".join(f"`{x}` string" for x in names), {"sep": delim or ",", "quote": '"', "escape": '"'}).alias("r"), "p")
        df = df.select("r.*", *([F.col("p").alias(id)] if id else []))
        f = tidy(df)
    else:
        df = reader.option("header", col_names is True).csv(_paths(source))
        if id:
            df = df.withColumn(id, F.col("_metadata.file_path"))
        f = tidy(df)
    names = [x for x in f.columns if x != id]
    missing = ["", "NA"] if na is None and guess else [""] if na is None else [na] if isinstance(na, str) else list(na)
    clean = {}
    for x in names:
        v = F.trim(E.quoted(x)) if trim_ws else E.quoted(x)
        clean[x] = F.when(~v.isin(missing), v)
    f = f.but(df=f.df.withColumns(clean))
    kinds = dict(zip(names, col_types, strict=False)) if isinstance(col_types, str) else dict(col_types or {})
    if guess:
        sample = f.df.select(*[E.quoted(x) for x in names]).limit(GUESSED)
        tests = {"l": _logical, "i": lambda v: v.rlike(r"^[+-]?\d{1,18}$"), "d": lambda v: v.rlike(C.NUMBER) | v.isin("NaN", "Inf", "-Inf"), "D": lambda v: v.rlike(r"^\d{4}-\d{2}-\d{2}$"), "T": lambda v: v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")}
        row = sample.agg(*[F.coalesce(F.bool_and(t(E.quoted(x))), F.lit(False)).alias(f"{k}{i}") for i, x in enumerate(names) for k, t in tests.items()]).first()
        for i, x in enumerate(names):
            kinds.setdefault(x, next((k for k in tests if row[f"{k}{i}"]), "c"))
    from ..operators.columns import mutate

    change = {x: KINDS[k](x, strict=strict, **({"locale": locale} if locale and k in ("d", "n", "double", "number") else {})) for x, k in kinds.items() if x in names and KINDS.get(k)}
    return mutate(**change)(f) if change else f


def _logical(v: Any) -> Any:
    return v.isin("TRUE", "FALSE", "true", "false", "T", "F", "True", "False")


def scan_csv(source: Any, **options: Any) -> Frame:
    return _csv(source, guess=False, **options)


def read_csv(source: Any, *, trim_ws: bool = True, **options: Any) -> Frame:
    """As scan_csv, with column types guessed from the first rows. Later values that don't fit
    are missing, and problems() has them."""
    return _csv(source, guess=True, trim_ws=trim_ws, **options)


def read_tsv(source: Any, **options: Any) -> Frame:
    return read_csv(source, delim="\t", **options)


def read_delim(source: Any, delim: str, **options: Any) -> Frame:
    return read_csv(source, delim=delim, **options)


def read_excel(path: Any, sheet: Any = None, *, skip: int | None = None, **options: Any) -> Frame:
    """One sheet; needs pandas and openpyxl on the driver, as workbooks are small."""
    import pandas as pd

    which = 0 if sheet is None else sheet - 1 if isinstance(sheet, int) else sheet
    return tidy(pd.read_excel(path, sheet_name=which, skiprows=skip, **options))


def excel_sheets(path: Any) -> list[str]:
    import pandas as pd

    return pd.ExcelFile(path).sheet_names


@verb
def write_csv(f: Frame, /, path: Any, **options: Any) -> Frame:
    """A folder of part files in row order."""
    f.to_spark(sort=True).write.mode("overwrite").options(header=True, escape='"', **options).csv(str(path))
    return f


@verb
def write_parquet(f: Frame, /, path: Any, **options: Any) -> Frame:
    f.to_spark().write.mode("overwrite").option("compression", "zstd").options(**options).parquet(str(path))
    return f


@verb
def write_ipc(f: Frame, /, path: Any, **options: Any) -> Frame:
    """One Arrow file, streamed through the driver a partition at a time."""
    import pyarrow as pa

    df = f.to_spark(sort=True)
    table = df.limit(0).toArrow()
    with pa.OSFile(str(path), "wb") as out, pa.ipc.new_file(out, table.schema) as sink:
        rows: list[Any] = []
        for row in df.toLocalIterator():
            rows.append(row.asDict(recursive=True))
            if len(rows) == 10_000:
                sink.write_table(pa.Table.from_pylist(rows, table.schema))
                rows = []
        sink.write_table(pa.Table.from_pylist(rows, table.schema))
    return f


@verb
def write_excel(f: Frame, /, path: Any, *, worksheet: str = "Sheet1", sheets: dict[str, Any] | None = None, **options: Any) -> Frame:
    """Sheets of report size; text that starts with = stays text."""
    import pandas as pd

    with pd.ExcelWriter(path, **options) as out:
        for name, x in (sheets or {worksheet: f}).items():
            pdf = tidy(x).to_spark(sort=True).toPandas()
            pdf.map(lambda v: "'" + v if isinstance(v, str) and v.startswith("=") else v).to_excel(out, sheet_name=name, index=False)
    return f


@verb
def collect(f: Frame, /, as_: str = "pandas", *, columns: Any = None, arrow_backed: bool = False, engine: str = "auto", dtype: Any = None, order: str = "fortran", writable: bool = False, allow_copy: bool = True) -> Any:
    """The rows in order: pandas (``arrow_backed`` or not), arrow, rows or numpy (of ``dtype``,
    in ``order``). Spark is the only engine, so ``engine`` is "auto"; rows that come from it are
    always copies, so ``allow_copy`` can't be False."""
    from ..functions.select import resolve

    if as_ not in ("pandas", "arrow", "rows", "numpy"):
        raise ValueError(f"as_ is 'pandas', 'arrow', 'rows' or 'numpy', not {as_!r}")
    if engine != "auto":
        raise ValueError(f"no engine {engine!r}: Spark runs every plan")
    if not allow_copy:
        raise ValueError("rows collected from Spark are copies")
    if order not in ("fortran", "c"):
        raise ValueError("order is 'fortran' or 'c'")
    if as_ != "numpy" and (dtype is not None or writable):
        raise ValueError("dtype and writable are for as_='numpy'")
    if arrow_backed and as_ != "pandas":
        raise ValueError("arrow_backed is for as_='pandas'")

    df = f.to_spark(sort=True)
    if columns is not None:
        df = df.select(*[E.quoted(c) for c in resolve(f, columns if isinstance(columns, (list, tuple)) else [columns])])
    if as_ == "arrow":
        return df.toArrow()
    if as_ == "rows":
        return df.collect()
    if as_ == "numpy":
        import numpy as np

        out = np.array(np.column_stack([c.to_numpy(zero_copy_only=False) for c in df.toArrow().columns]), dtype=dtype, order="F" if order == "fortran" else "C")
        out.flags.writeable = writable
        return out
    if arrow_backed:
        import pandas as pd

        return df.toArrow().to_pandas(types_mapper=pd.ArrowDtype)
    return df.toPandas()


@verb
def to_numpy(f: Frame, /, *, columns: Any = None, dtype: Any = None, order: str = "fortran", writable: bool = False, allow_copy: bool = True, engine: str = "auto") -> Any:
    return collect(as_="numpy", columns=columns, dtype=dtype, order=order, writable=writable, allow_copy=allow_copy, engine=engine)(f)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. If that is unset, one of our own, and on
    a cluster, whose executors wouldn't see it, an error."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or "/tmp/checkpoints/loam").rstrip("/")


@verb
def compute(f: Frame, /, *, engine: str = "auto") -> Frame:
    """Runs the plan now and goes on from a checkpoint in the shared folder."""
    if engine != "auto":
        raise ValueError(f"no engine {engine!r}: Spark runs every plan")
    spark = f.df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return f.but(df=f.df.checkpoint())


@verb
def peek(f: Frame, /, n: int | None = None) -> Frame:
    print(f.to_spark(sort=True).limit(n or options.rows).toPandas())
    return f


@verb
def glimpse(f: Frame, /, n: int = 10) -> Frame:
    rows = f.to_spark(sort=True).limit(n).collect()
    for c in f.columns:
        print(f"$ {c} <{f.schema[c].dataType.simpleString()}> " + ", ".join(str(r[c]) for r in rows))
    return f


@verb
def view(f: Frame, /, *, n: int = 10_000, digits: int | None = None, hide: Any = None) -> Any:
    """The first ``n`` rows as pandas, numbers rounded to ``digits``, without the columns of
    ``hide``. There is no explorer, and so no height and no live view."""
    from ..functions.select import resolve

    df = f.to_spark(sort=True).limit(n)
    if hide is not None:
        df = df.drop(*resolve(f, hide if isinstance(hide, (list, tuple)) else [hide]))
    out = df.toPandas()
    return out if digits is None else out.round(digits)


class Options:
    rows: int = 10

    def __call__(self, **new: Any) -> Options:
        for k, v in new.items():
            setattr(self, k, v)
        return self


options = Options()


@verb
def explain(f: Frame, /, mode: str = "formatted") -> Frame:
    f.to_spark().explain(mode)
    return f


@verb
def problems(f: Frame, /) -> Frame:
    """Values that parsers couldn't take: row, column, original, expected."""
    from pyspark.sql import Window

    parts = []
    for df, column, e, order in f.problems_:
        c = E.Context(df, order=order)
        v, bad, expected = e.failed(c)
        row = F.row_number().over(Window.orderBy(*(order or [F.monotonically_increasing_id()]))).cast("long")
        part = c.df.select(row.alias("row"), F.lit(column).alias("column"), v.cast("string").alias("original"), F.lit(expected).alias("expected"), bad.alias("bad"))
        parts.append(part.filter("bad").drop("bad"))
    if not parts:
        return Frame(f.df.sparkSession.createDataFrame([], "row long, column string, original string, expected string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return Frame(out)


@verb
def stop_for_problems(f: Frame, /) -> Frame:
    some = problems()(f).df.limit(5).collect()
    if some:
        raise C.ConversionError("; ".join(f"row {r.row}, {r.column}: {r.original!r} isn't {r.expected}" for r in some))
    return f
