"""Rules that are easy to get wrong, on small frames."""

import datetime as dt
import math

import pytest

from loam import api as t

col = t.col


def values(frame, *names):
    got = frame.to_spark(sort=True).collect()
    return [r[0] if len(names) == 1 else tuple(r) for r in (tuple(row[n] for n in names) for row in got)]


def table(spark, schema, *rows):
    df = spark.createDataFrame(list(rows), schema).coalesce(1)
    return t.tidy(df)


def test_sort_is_stable_and_puts_missing_last(spark):
    f = table(spark, "id long, x double", (1, 2.0), (2, None), (3, 2.0), (4, 1.0), (5, math.nan))
    assert values(f >> t.arrange("x"), "id") == [4, 1, 3, 2, 5]
    assert values(f >> t.arrange(t.desc("x")), "id") == [1, 3, 4, 2, 5]


def test_missing_values_propagate_unless_removed(spark):
    f = table(spark, "g string, x double", ("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0))
    out = f >> t.group_by("g") >> t.summarise(m=t.mean("x"), r=t.mean("x", na_rm=True), s=t.sum("x"))
    assert values(out, "g", "m", "r", "s") == [("a", None, 1.0, None), ("b", 3.0, 3.0, 6.0)]


def test_running_functions_stop_at_the_first_missing_value(spark):
    f = table(spark, "i long, x double", (1, 1.0), (2, None), (3, 2.0))
    assert values(f >> t.arrange("i") >> t.mutate(s=t.cumsum("x"), m=t.cummean("x")), "s", "m") == [(1.0, 1.0), (None, None), (None, None)]


def test_consecutive_id_counts_runs_with_missing_values(spark):
    f = table(spark, "i long, x double", *enumerate([None, None, 1.0, None, None, 2.0]))
    assert values(f >> t.arrange("i") >> t.mutate(r=t.consecutive_id("x")), "r") == [1, 1, 2, 3, 3, 4]


@pytest.mark.parametrize(("x", "digits", "want"), [(2.675, 2, 2.67), (0.125, 2, 0.12), (-2.675, 2, -2.67), (0.5, 0, 0.0), (1.5, 0, 2.0), (2.5, 0, 2.0), (1234.0, -2, 1200.0)])
def test_rounding(spark, x, digits, want):
    assert values(table(spark, "x double", (x,)) >> t.mutate(y=t.round("x", digits)), "y") == [want]


def test_division_and_remainder(spark):
    f = table(spark, "a long, b long", (7, 3), (-7, 3), (7, -3), (1, 0), (0, 0))
    got = values(f >> t.mutate(q=col("a") / col("b"), r=col("a") % col("b")), "q", "r")
    assert [r for _, r in got[:3]] == [1, 2, -2]
    assert got[3][0] == math.inf and math.isnan(got[4][0])


def test_ntile_and_ranks_leave_missing_values_out(spark):
    f = table(spark, "i long, x long", *[(i, i) for i in range(10)], (10, None))
    got = values(f >> t.arrange("i") >> t.mutate(q=t.ntile("x", 4), p=t.percent_rank("x")), "q", "p")
    assert [q for q, _ in got] == [1, 1, 1, 2, 2, 3, 3, 3, 4, 4, None] and got[9][1] == 1.0


def test_joins_match_missing_keys_and_add_suffixes(spark):
    x = table(spark, "k string, v long", ("a", 1), (None, 2))
    y = table(spark, "k string, v long", (None, 3), ("b", 4))
    out = x >> t.full_join(y, by="k")
    assert out.columns == ["k", "v_x", "v_y"]
    assert values(out, "k", "v_x", "v_y") == [("a", 1, None), (None, 2, 3), ("b", None, 4)]
    assert values(x >> t.inner_join(y, by="k", na_matches="never"), "k") == []


def test_join_guards(spark):
    x, y = table(spark, "k long", (1,), (2,)), table(spark, "k long, v long", (1, 1), (1, 2))
    assert values(x >> t.left_join(y, by="k", multiple="first"), "k", "v") == [(1, 1), (2, None)]
    with pytest.raises(Exception, match="matches several"):
        values(x >> t.left_join(y, by="k", relationship="one-to-one"), "k")
    with pytest.raises(Exception, match="no match"):
        values(x >> t.inner_join(y, by="k", unmatched="error"), "k")


@pytest.mark.parametrize(("how", "want"), [("ge", [(1, None), (5, 4), (9, 8)]), ("gt", [(1, None), (5, 4), (9, 8)]), ("le", [(1, 4), (5, 8), (9, None)]), ("lt", [(1, 4), (5, 8), (9, None)])])
def test_nearest_match(spark, how, want):
    x, y = table(spark, "a long", (1,), (5,), (9,)), table(spark, "b long", (4,), (8,))
    assert values(x >> t.left_join(y, by=t.join_by(t.closest(getattr(t, how)("a", "b")))), "a", "b") == want


def test_changes_by_key_check_their_keys(spark):
    x = table(spark, "k long, v string", (1, "a"), (2, None), (None, "c"))
    new = table(spark, "k long, v string", (2, "n"), (None, "m"))
    assert values(x >> t.rows_patch(new, by="k"), "v") == ["a", "n", "c"]
    assert values(x >> t.rows_update(new, by="k"), "v") == ["a", "n", "m"]
    assert values(x >> t.rows_delete(new, by="k"), "k") == [1]
    lone = table(spark, "k long, v string", (9, "z"))
    for change in (t.rows_update, t.rows_patch, t.rows_delete):
        with pytest.raises(Exception, match="isn't in x"):
            values(x >> change(lone, by="k"), "k", "v")
    with pytest.raises(Exception, match="in x already"):
        values(x >> t.rows_insert(new, by="k"), "k")
    with pytest.raises(Exception, match="repeat"):
        values(x >> t.rows_update(table(spark, "k long, v string", (1, "p"), (1, "q")), by="k"), "v")


def test_slices_by_group(spark):
    f = table(spark, "g long, x long", (2, 1), (1, 2), (2, 3), (None, 4), (1, 5))
    assert values(f >> t.group_by("g") >> t.slice_tail(n=1), "g", "x") == [(1, 5), (2, 3), (None, 4)]
    assert values(f >> t.slice_head(n=1, by="g"), "x") == [1, 2, 4]


def test_fill_complete_and_pivots(spark):
    f = table(spark, "i long, k string, v double", (1, "a", 1.0), (2, "b", None), (3, "a", 3.0))
    assert values(f >> t.arrange("i") >> t.fill("v"), "v") == [1.0, 1.0, 3.0]
    assert len(values(f >> t.complete("i", "k"), "i")) == 6
    wide = f >> t.pivot_wider(names_from="k", values_from="v")
    assert wide.columns == ["i", "a", "b"]
    assert values(wide >> t.pivot_longer(["a", "b"], values_drop_na=True), "i", "name", "value") == [(1, "a", 1.0), (3, "a", 3.0)]
    twice = table(spark, "i long, k string, v long", (1, "a", 1), (1, "a", 2))
    assert values(twice >> t.pivot_wider(names_from="k", values_from="v"), "a") == [[1, 2]]


def test_factor_order_rules_sorts_counts_and_empty_groups(spark):
    f = table(spark, "s string", ("low",), ("high",), ("low",)) >> t.mutate(s=t.fct_expand(t.fct_relevel("s", "low"), "none"))
    assert values(f >> t.count("s"), "s", "n") == [("low", 2), ("high", 1)]
    assert values(f >> t.group_by("s", drop=False) >> t.summarise(n=t.n()), "s") == ["low", "high", "none"]


def test_text(spark):
    f = table(spark, "s string", ("don't STOP",), (None,))
    assert values(f >> t.mutate(s=t.str_to_title("s")), "s") == ["Don'T Stop", None]
    assert values(f >> t.mutate(s=t.str_replace("s", "(n).(t)", r"\2\1")), "s")[0] == "dotn STOP"
    assert values(f >> t.mutate(s=t.str_glue("<{s}>")), "s") == ["<don't STOP>", "<NA>"]
    assert values(f >> t.mutate(s=t.str_pad(t.str_sub("s", 1, 3), 6, "both", "*")), "s")[0] == "*don**"
    assert t.str_sort(["a10", "a2", None], numeric=True) == ["a2", "a10", None]


def test_dates(spark):
    f = table(spark, "d date", (dt.date(2024, 1, 31),))
    out = f >> t.mutate(a=col("d") + t.months(1), b=t.ceiling_date("d", "month"), c=col("d") + t.ddays(2), e=t.wday("d", label=True), q=t.quarter("d", fiscal_start=11))
    assert values(out, "a", "b", "c", "e", "q") == [(dt.date(2024, 2, 29), dt.date(2024, 2, 1), dt.date(2024, 2, 2), "Wed", 1)]
    assert t.date_seq(dt.date(2024, 1, 31), by="month", total_size=3) == [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 31)]


def test_parsers_keep_what_failed(spark):
    f = table(spark, "s string", ("2024-02-30",), ("Jan 5th, 2024",), ("1,234.5 kg",))
    out = f >> t.mutate(a=t.mdy("s"), b=t.parse_number("s"), c=t.ymd("s"))
    assert values(out, "a", "b", "c")[1][0] == dt.date(2024, 1, 5) and values(out, "b")[2] == 1234.5 and values(out, "c")[0] is None
    assert len((out >> t.problems()).to_spark().collect()) == 2 + 0 + 3
    with pytest.raises(Exception, match="as_integer"):
        values(f >> t.mutate(s=t.as_integer("s")), "s")


def test_clock_changes(spark):
    f = table(spark, "x timestamp_ntz", (dt.datetime(2024, 3, 10, 2, 30),), (dt.datetime(2024, 7, 1, 12, 0),))
    assert values(f >> t.mutate(y=t.force_tz("x", "America/New_York")), "y") == [None, dt.datetime(2024, 7, 1, 16, 0)]


def test_csv_round_trip(spark, tmp_path):
    f = table(spark, "id long, s string", (1, "a,b"), (2, None))
    f >> t.write_csv(tmp_path / "x.csv")
    got = t.read_csv(str(tmp_path / "x.csv"))
    assert sorted(values(got, "id", "s"), key=str) == [(1, "a,b"), (2, None)]


def test_ipc_round_trip(spark, tmp_path):
    f = table(spark, "id long, s string", (1, "a"), (2, None))
    f >> t.write_ipc(tmp_path / "x.arrow")
    assert sorted(values(t.scan_ipc(str(tmp_path / "x.arrow")), "id")) == [1, 2]


def test_reports(spark):
    f = table(spark, "x string", ("b",), ("a",), ("a",), (None,))
    out = f >> t.tabyl("x")
    assert values(out, "x", "n", "percent", "valid_percent") == [("a", 2, 0.5, 2 / 3), ("b", 1, 0.25, 1 / 3), (None, 1, 0.25, None)]
    two = table(spark, "a string, b string", ("x", "p"), ("x", "q"), ("y", "p")) >> t.tabyl("a", "b") >> t.adorn_totals() >> t.adorn_percentages() >> t.adorn_pct_formatting(0) >> t.adorn_ns()
    assert values(two, "a", "p") == [("x", "50% (1)"), ("y", "100% (1)"), ("Total", "67% (2)")]


def test_rowwise_and_columns(spark):
    f = table(spark, "a double, b double", (1.0, 3.0), (2.0, None))
    assert values(f >> t.mutate(s=t.row_sums("a", "b", na_rm=True), m=t.pick("a", "b").mean(), x=t.pmax("a", "b", na_rm=True)), "s", "m", "x") == [(4.0, 2.0, 3.0), (2.0, None, 2.0)]


def test_missing_columns_are_named_with_suggestions(spark):
    with pytest.raises(KeyError, match="did you mean"):
        table(spark, "alpha long", (1,)) >> t.select("alpah")
    with pytest.raises(TypeError):
        bool(col("x") > 1)


def test_stream_runs_verbs(spark, sf_dir, tmp_path):
    from loam.streaming.windows import windowed

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type", "value")
    f = t.tidy(stream) >> t.filter(col("value") > 0)
    q = windowed(f, "ts", "1 day", late="1 hour", n=t.n()).writeStream.format("memory").queryName("days").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM days").first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").filter("value > 0").count()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    f = t.scan_parquet(f"{sf_dir}/lineitem.parquet") >> t.filter(col("l_quantity") > 49) >> t.group_by("l_returnflag") >> t.summarise(n=t.n())
    plan = f.to_spark()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49" in plan and "l_comment" not in plan and "l_tax" not in plan


def test_levels_by_appearance_sort_no_rows(spark, tmp_path):
    rows = [("b", 1, -1.5, "ab"), ("a", 5, float("inf"), "abc"), (None, 9, 3.0, "zz"), ("a", -(2**31), None, ""), ("d", 2**31 - 1, 0.0, "a"), ("c", None, 2.0, None)]
    spark.createDataFrame(rows, "f string, i int, x double, s string").coalesce(1).write.parquet(f"{tmp_path}/rows")
    frame = t.scan_parquet(f"{tmp_path}/rows")
    for order in ([], ["i"], [t.desc("i")], ["x"], [t.desc("x")], ["s"], [t.desc("s")], [t.desc("s"), "i"]):
        ordered = frame >> t.arrange(*order) if order else frame
        seen = [r.f for r in ordered.to_spark(sort=True).collect()]
        c = ordered.context()
        at = c.position()
        assert "Window" not in plan_of(c.df.select(at.alias("at")))
        assert (ordered >> t.mutate(f=t.fct_inorder("f"))).levels["f"] == tuple(dict.fromkeys(x for x in seen if x))
        got = (ordered >> t.summarise(first=t.first("f"), last=t.last("f"))).to_spark()
        assert tuple(got.first()) == (seen[0], seen[-1])
        assert "Window" not in plan_of(got)
    grouped = frame >> t.mutate(k=t.lit(1)) >> t.group_by("f") >> t.mutate(g=t.fct_inorder("f"))
    assert grouped.levels["g"] == ("b", "a", "d", "c")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()
