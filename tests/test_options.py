"""Options that don't hold are refused, and patterns go by their keyword."""

import datetime as dt

import numpy as np
import pytest

from loam import api as t
from loam.api import col


@pytest.fixture(scope="module")
def small(spark):
    return t.tidy(spark.createDataFrame([(1, "ab", 1.25), (2, "cb", 2.75)], "k long, s string, x double"))


def test_patterns_by_keyword(small):
    got = small >> t.transmute(
        a=t.str_detect("s", pattern="a"), b=t.str_starts("s", pattern="c"), c=t.str_ends("s", pattern="b"), d=t.str_replace("s", pattern="b", replacement="x"), e=t.str_extract("s", pattern="[ac]"), f=t.str_remove("s", pattern="b"),
        g=t.str_locate("s", pattern="b")["start"], h=t.str_split_i("s", pattern="b", i=1), i=t.str_match("s", pattern="(.)b")["group_1"], j=t.str_remove_all("s", pattern="[ab]"), z=t.str_ilike("s", pattern="A%"),
    )
    rows = [tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in got >> t.collect("rows")]
    assert rows == [(True, False, True, "ax", "a", "a", 2, "a", "a", "", True), (False, True, True, "cx", "c", "c", 2, "c", "c", "c", False)]
    assert t.str_subset(["ab", "c"], pattern="a") == ["ab"] and t.str_which(["ab", "c"], pattern="c") == [2]


def test_options_of_collecting(small):
    m = small >> t.to_numpy(columns=["k", "x"], dtype="float32", order="c")
    assert m.dtype == np.float32 and m.flags.c_contiguous and not m.flags.writeable and m.tolist() == [[1, 1.25], [2, 2.75]]
    assert (small >> t.to_numpy(columns=["k"], writable=True)).flags.writeable
    assert str((small >> t.collect("pandas", arrow_backed=True)).dtypes["k"]).endswith("[pyarrow]")
    for bad in ({"as_": "table"}, {"engine": "gpu"}, {"dtype": "int8"}, {"arrow_backed": True, "as_": "rows"}, {"allow_copy": False}, {"order": "z"}):
        with pytest.raises(ValueError):
            small >> t.collect(**bad)
    with pytest.raises(TypeError):
        small >> t.collect(dtpye="int8")
    with pytest.raises(TypeError):
        small >> t.view(height=3)
    with pytest.raises(ValueError):
        small >> t.compute(engine="gpu")
    assert list((small >> t.view(n=1, digits=1, hide="s")).columns) == ["k", "x"]


@pytest.mark.parametrize("unit", ["season", "2 weeks", "decade", "0 days"])
def test_units_that_are_no_units(small, unit):
    with pytest.raises(ValueError, match="no "):
        small >> t.mutate(d=t.floor_date(t.make_date(2024, 1, 1), unit)) >> t.collect("rows")


def test_units_that_are(small):
    day = dt.date(2024, 8, 15)
    for unit, want in (("month", dt.date(2024, 8, 1)), ("2 months", dt.date(2024, 7, 1)), ("quarter", dt.date(2024, 7, 1)), ("year", dt.date(2024, 1, 1)), ("week", dt.date(2024, 8, 11))):
        rows = small >> t.transmute(d=t.floor_date(t.lit(day), unit)) >> t.collect("rows")
        assert {r["d"] for r in rows} == {want}, unit


def test_row_sums_of_picked_columns(small):
    rows = small >> t.transmute(a=t.row_sums(t.pick("k", "x")), b=t.row_means(t.pick("k"), "x")) >> t.collect("rows")
    assert [(r["a"], r["b"]) for r in rows] == [(2.25, 1.125), (4.75, 2.375)]


def test_shared_folder_is_asked_for_on_a_cluster():
    from loam.sources.io import shared_folder

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())
