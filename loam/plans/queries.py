"""A query for each operator or family, and DuckDB SQL for the same rows.

Queries name their columns, and round sums of doubles, so that both engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import api as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
col, n = t.col, t.n


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Callable[[str], t.Frame]], t.Frame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(lambda table: t.scan_parquet(f"{sf_dir}/{table}.parquet"))
            return out.to_spark() if isinstance(out, t.Frame) else out

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add


def money(e):
    return t.round_half_up(e, 2)


@query("tpch_q1", """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS sum_disc,
    floor(avg(l_quantity) * 1e6 + 0.5) / 1e6 AS avg_qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def _(T):
    return (
        T("lineitem") >> t.filter(col("l_shipdate").cast("date") <= __import__("datetime").date(1998, 9, 2)) >> t.mutate(d=col("l_extendedprice") * (1 - col("l_discount"))) >> t.group_by("l_returnflag", "l_linestatus")
        >> t.summarise(n=n(), sum_qty=t.sum("l_quantity"), sum_disc=t.round_half_up(t.sum("d")), avg_qty=t.round_half_up(t.mean("l_quantity"), 6), groups="drop")
    )


@query("filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def _(T):
    return T("orders") >> t.filter(col("o_orderstatus") == "F", col("o_totalprice") > 100000) >> t.select("o_orderkey")


@query("filter_grouped", "SELECT o_orderkey, o_custkey FROM orders QUALIFY o_totalprice > avg(o_totalprice) OVER (PARTITION BY o_custkey)")
def _(T):
    return T("orders") >> t.group_by("o_custkey") >> t.filter(col("o_totalprice") > t.mean("o_totalprice")) >> t.ungroup() >> t.select("o_orderkey", "o_custkey")


@query("filter_out", "SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false)")
def _(T):
    return T("orders") >> t.mutate(s=t.na_if("o_orderstatus", "P")) >> t.filter_out(col("s") == "F") >> t.select("o_orderkey")


@query("arrange_slice_head", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def _(T):
    return T("customer") >> t.arrange(t.desc("c_acctbal"), "c_custkey") >> t.slice_head(n=20) >> t.select("c_custkey", "c_acctbal")


@query("distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def _(T):
    return T("customer") >> t.distinct("c_nationkey", "c_mktsegment", maintain_order=False)


@query("distinct_keep_all", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def _(T):
    return T("orders") >> t.arrange("o_orderkey") >> t.distinct("o_custkey", keep_all=True) >> t.select("o_custkey", "o_orderkey")


@query("slice", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IN (1, 3)")
def _(T):
    return T("orders") >> t.arrange("o_orderkey") >> t.slice(1, 3, by="o_custkey") >> t.select("o_custkey", "o_orderkey")


@query("slice_negative", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <> 2")
def _(T):
    return T("orders") >> t.arrange("o_orderkey") >> t.group_by("o_custkey") >> t.slice(-2) >> t.ungroup() >> t.select("o_custkey", "o_orderkey")


@query("slice_tail", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def _(T):
    return T("events") >> t.arrange("event_id") >> t.group_by("user_id") >> t.slice_tail(n=3) >> t.ungroup() >> t.select("user_id", "event_id")


@query("slice_prop", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= floor(count(*) OVER (PARTITION BY user_id) * 0.25)")
def _(T):
    return T("events") >> t.arrange("event_id") >> t.slice_head(prop=0.25, by="user_id") >> t.select("user_id", "event_id")


@query("slice_min", "SELECT c_nationkey, c_custkey FROM customer QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) <= 3")
def _(T):
    return T("customer") >> t.group_by("c_nationkey") >> t.slice_min("c_acctbal", n=3) >> t.ungroup() >> t.select("c_nationkey", "c_custkey")


@query("slice_max", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(T):
    return T("orders") >> t.arrange("o_orderkey") >> t.slice_max("o_totalprice", n=10, with_ties=False) >> t.select("o_orderkey", "o_totalprice")


@query("head", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 6")
def _(T):
    return T("nation") >> t.arrange("n_nationkey") >> t.head() >> t.select("n_nationkey")


@query("slice_sample", "SELECT c_nationkey, least(count(*), 5) AS n FROM customer GROUP BY c_nationkey")
def _(T):
    return T("customer") >> t.slice_sample(n=5, seed=1, by="c_nationkey") >> t.count("c_nationkey")


@query("sample_n", "SELECT 12::BIGINT AS n")
def _(T):
    return T("orders") >> t.sample_n(12, seed=3) >> t.tally()


@query("sample_frac", "SELECT o_orderstatus, CAST(floor(count(*) * 0.1) AS BIGINT) AS n FROM orders GROUP BY ALL")
def _(T):
    return T("orders") >> t.group_by("o_orderstatus") >> t.sample_frac(0.1, seed=3) >> t.tally()


@query("drop_na", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'")
def _(T):
    return T("orders") >> t.mutate(s=t.na_if("o_orderstatus", "P")) >> t.drop_na("s") >> t.select("o_orderkey")


@query("get_dupes", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS dupe_count, l_partkey FROM lineitem QUALIFY dupe_count > 1")
def _(T):
    return T("lineitem") >> t.select("l_orderkey", "l_linenumber", "l_partkey") >> t.get_dupes("l_orderkey", "l_linenumber")


@query("select_rename", "SELECT c_custkey AS id, c_mktsegment, c_name FROM customer")
def _(T):
    return T("customer") >> t.select("c_mktsegment", t.starts_with("c_n") - "c_nationkey", id="c_custkey") >> t.relocate("id")


@query("drop_rename_with", "SELECT n_nationkey AS N_NATIONKEY, n_name AS N_NAME FROM nation")
def _(T):
    return T("nation") >> t.drop("n_regionkey") >> t.rename_with(str.upper)


@query("selectors", "SELECT c_custkey, c_nationkey, c_acctbal, c_name FROM customer")
def _(T):
    return T("customer") >> t.select(t.where(t.is_numeric), t.any_of(["c_name", "zzz"])) >> t.relocate(t.last_col())


@query("rename_set_names", "SELECT r_regionkey AS k, r_name AS name FROM region")
def _(T):
    return T("region") >> t.rename(name="r_name") >> t.set_names("k", "name")


@query("clean_names", "SELECT r_regionkey AS region_key, r_name AS percent_name FROM region")
def _(T):
    return T("region") >> t.set_names("Region Key", "% Name") >> t.clean_names()


@query("mutate_grouped", "SELECT o_orderkey, floor(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) * 1e6 + 0.5) / 1e6 AS share, count(*) OVER (PARTITION BY o_custkey) AS k FROM orders")
def _(T):
    return T("orders") >> t.group_by("o_custkey") >> t.mutate(share=t.round_half_up(col("o_totalprice") / t.sum("o_totalprice"), 6), k=n()) >> t.ungroup() >> t.select("o_orderkey", "share", "k")


@query("mutate_sequential", "SELECT o_orderkey, o_orderkey * 2 AS a, o_orderkey * 2 + 1 AS b FROM orders")
def _(T):
    return T("orders") >> t.transmute(o_orderkey=col("o_orderkey"), a=col("o_orderkey") * 2, b=col("a") + 1)


@query("summarise_by", "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL")
def _(T):
    return T("orders") >> t.summarise(by="o_orderpriority", n=n(), top=t.max("o_totalprice"), customers=t.n_distinct("o_custkey"))


@query("summarise_missing", """SELECT o_orderpriority, CAST(CASE WHEN count(x) = count(*) THEN sum(x) END AS BIGINT) AS propagated, CAST(sum(x) AS BIGINT) AS removed, CAST(count(x) AS BIGINT) AS held,
    CASE WHEN count(x) = count(*) THEN min(x) END AS least, max(x) AS greatest FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 OR o_orderpriority < '3' THEN o_orderkey END AS x FROM orders) GROUP BY ALL""")
def _(T):
    x = t.if_else((col("o_orderkey") % 7 != 0) | (col("o_orderpriority") < "3"), col("o_orderkey"), None)
    return T("orders") >> t.mutate(x=x) >> t.group_by("o_orderpriority") >> t.summarise(propagated=t.sum("x"), removed=t.sum("x", na_rm=True), held=t.sum(~t.is_na("x")), least=t.min("x"), greatest=t.max("x", na_rm=True))


@query("aggregates", """SELECT c_mktsegment, floor(avg(c_acctbal) * 100 + 0.5) / 100 AS m, floor(median(c_acctbal) * 100 + 0.5) / 100 AS med, floor(stddev_samp(c_acctbal) * 100 + 0.5) / 100 AS sd,
    floor(var_samp(c_acctbal) + 0.5) AS v, bool_or(c_acctbal < -900) AS some, bool_and(c_acctbal > -1000) AS every FROM customer GROUP BY ALL""")
def _(T):
    return T("customer") >> t.group_by("c_mktsegment") >> t.summarise(m=money(t.mean("c_acctbal")), med=money(t.median("c_acctbal")), sd=money(t.sd("c_acctbal")), v=t.round_half_up(t.var("c_acctbal")), some=t.any(col("c_acctbal") < -900), every=t.all(col("c_acctbal") > -1000))


@query("first_last_nth", "SELECT user_id, first(event_id ORDER BY event_id) AS a, last(event_id ORDER BY event_id) AS b, list(event_id ORDER BY event_id)[3] AS c, last(event_type ORDER BY value, event_id) AS d FROM events GROUP BY user_id")
def _(T):
    return T("events") >> t.arrange("event_id") >> t.group_by("user_id") >> t.summarise(a=t.first("event_id"), b=t.last("event_id"), c=t.nth("event_id", 3), d=t.last("event_type", order_by="value"))


@query("summarise_nested", "SELECT o_custkey, floor(sum(abs(o_totalprice - m)) + 0.5) AS spread FROM (SELECT *, avg(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) GROUP BY o_custkey")
def _(T):
    return T("orders") >> t.group_by("o_custkey") >> t.summarise(spread=t.round_half_up(t.sum(t.abs(col("o_totalprice") - t.mean("o_totalprice")))))


@query("reframe", "SELECT c_mktsegment, unnest([min(c_custkey), max(c_custkey)]) AS k FROM customer GROUP BY c_mktsegment")
def _(T):
    return T("customer") >> t.reframe(by="c_mktsegment", k=t.lit([t.min("c_custkey"), t.max("c_custkey")]))


@query("count", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def _(T):
    return T("orders") >> t.count("o_orderstatus", "o_orderpriority", sort=True)


@query("count_weighted", "SELECT l_returnflag, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL")
def _(T):
    return T("lineitem") >> t.count("l_returnflag", wt="l_quantity", name="qty")


@query("tally", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _(T):
    return T("orders") >> t.group_by("o_orderstatus") >> t.tally()


@query("add_count", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def _(T):
    return T("orders") >> t.add_count("o_custkey") >> t.select("o_orderkey", "n")


@query("add_tally", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders")
def _(T):
    return T("orders") >> t.group_by("o_orderstatus") >> t.add_tally() >> t.ungroup() >> t.select("o_orderkey", "n")


@query("group_keys", "SELECT DISTINCT o_orderstatus FROM orders")
def _(T):
    return T("orders") >> t.group_by("o_orderstatus") >> t.group_keys()


@query("group_indices", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) AS g FROM orders")
def _(T):
    return T("orders") >> t.group_by("o_orderpriority") >> t.mutate(g=t.cur_group_id()) >> t.ungroup() >> t.select("o_orderkey", "g")


@query("group_modify", "SELECT o_orderstatus, count(*) AS rows, max(o_totalprice) AS top FROM orders GROUP BY ALL")
def _(T):
    import pandas as pd

    return T("orders") >> t.select("o_orderstatus", "o_totalprice") >> t.group_by("o_orderstatus") >> t.group_modify(lambda x, key: pd.DataFrame({"rows": [len(x)], "top": [x.o_totalprice.max()]}), schema="rows long, top double")


@query("group_nest", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
def _(T):
    return T("customer") >> t.group_nest("c_mktsegment") >> t.unnest("data") >> t.count("c_mktsegment")


@query("ranks", """SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn, rank() OVER (w) AS mr, dense_rank() OVER (w) AS dr, round(percent_rank() OVER (w), 9) AS pr,
    round(cume_dist() OVER (w), 9) AS cd, CAST(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1) * 4 / count(*) OVER (PARTITION BY c_nationkey)) AS BIGINT) + 1 AS q
    FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)""")
def _(T):
    return (
        T("customer") >> t.arrange("c_custkey") >> t.group_by("c_nationkey")
        >> t.mutate(rn=t.row_number("c_acctbal"), mr=t.min_rank("c_acctbal"), dr=t.dense_rank("c_acctbal"), pr=t.round(t.percent_rank("c_acctbal"), 9), cd=t.round(t.cume_dist("c_acctbal"), 9), q=t.ntile("c_acctbal", 4))
        >> t.ungroup() >> t.select("c_custkey", "rn", "mr", "dr", "pr", "cd", "q")
    )


@query("lead_lag", "SELECT event_id, lag(event_id) OVER w AS a, lead(event_id, 2, -1) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _(T):
    return T("events") >> t.arrange("event_id") >> t.group_by("user_id") >> t.mutate(a=t.lag("event_id"), b=t.lead("event_id", 2, -1)) >> t.ungroup() >> t.select("event_id", "a", "b")


@query("running", """SELECT event_id, CAST(CASE WHEN nulls = 0 THEN s END AS BIGINT) AS s, CASE WHEN nulls = 0 THEN mx END AS mx FROM (SELECT event_id, sum(x) OVER w AS s, max(x) OVER w AS mx, count(*) FILTER (x IS NULL) OVER w AS nulls
    FROM (SELECT *, CASE WHEN event_id % 50 <> 7 THEN event_id END AS x FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))""")
def _(T):
    return T("events") >> t.mutate(x=t.if_else(col("event_id") % 50 != 7, col("event_id"), None)) >> t.arrange("event_id") >> t.group_by("user_id") >> t.mutate(s=t.cumsum("x"), mx=t.cummax("x")) >> t.ungroup() >> t.select("event_id", "s", "mx")


@query("cumall_cumany", "SELECT event_id, bool_and(value < 200) OVER w AS a, bool_or(value > 200) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def _(T):
    return T("events") >> t.arrange("event_id") >> t.group_by("user_id") >> t.mutate(a=t.cumall(col("value") < 200), b=t.cumany(col("value") > 200)) >> t.ungroup() >> t.select("event_id", "a", "b")


@query("consecutive_id", """SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)
    THEN 1 ELSE 0 END AS c FROM events)""")
def _(T):
    return T("events") >> t.arrange("event_id") >> t.group_by("user_id") >> t.mutate(run=t.consecutive_id("event_type")) >> t.ungroup() >> t.select("event_id", "run")


@query("scaling", """SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w, 6) AS z, round((c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w), 6) AS r
    FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""")
def _(T):
    return T("customer") >> t.group_by("c_mktsegment") >> t.mutate(z=t.round(t.scale("c_acctbal"), 6), r=t.round(t.rescale("c_acctbal"), 6)) >> t.ungroup() >> t.select("c_custkey", "z", "r")


@query("conditions", """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS a, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 1 ELSE 0 END AS b,
    CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE o_orderstatus END AS c, coalesce(nullif(o_orderstatus, 'P'), 'none') AS d, o_totalprice BETWEEN 1000 AND 50000 AS e FROM orders""")
def _(T):
    return T("orders") >> t.transmute(
        o_orderkey=col("o_orderkey"), a=t.case_when((col("o_totalprice") > 200000, "high"), (col("o_totalprice") > 100000, "mid"), default="low"), b=t.case_match("o_orderstatus", (["F", "O"], 1), default=0),
        c=t.recode("o_orderstatus", {"P": "pending"}), d=t.coalesce(t.na_if("o_orderstatus", "P"), "none"), e=t.between_values("o_totalprice", 1000, 50000),
    )


@query("row_numbers_across", "SELECT l_orderkey, l_partkey, round(l_quantity + l_discount, 4) AS total, least(l_quantity, l_tax) AS lo, greatest(l_quantity, l_tax) AS hi FROM lineitem")
def _(T):
    return T("lineitem") >> t.transmute(l_orderkey=col("l_orderkey"), l_partkey=col("l_partkey"), total=t.round(t.row_sums("l_quantity", "l_discount"), 4), lo=t.pmin("l_quantity", "l_tax"), hi=t.pmax("l_quantity", "l_tax"))


@query("across", "SELECT l_returnflag, max(l_quantity) AS l_quantity_hi, min(l_quantity) AS l_quantity_lo, max(l_tax) AS l_tax_hi, min(l_tax) AS l_tax_lo FROM lineitem GROUP BY ALL")
def _(T):
    return T("lineitem") >> t.group_by("l_returnflag") >> t.summarise(t.across(["l_quantity", "l_tax"], {"hi": t.max, "lo": t.min}))


@query("if_any_if_all", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE (l_discount > 0.07 OR l_tax > 0.07) AND (l_quantity > 10 AND l_extendedprice > 10)")
def _(T):
    return T("lineitem") >> t.filter(t.if_any(["l_discount", "l_tax"], lambda x: x > 0.07), t.if_all(["l_quantity", "l_extendedprice"], lambda x: x > 10)) >> t.select("l_orderkey", "l_partkey", "l_linenumber")


@query("arithmetic", """SELECT o_orderkey, (o_orderkey - 700) / 9 AS q, CAST(floor((o_orderkey - 700) / 9) AS BIGINT) AS w, CAST((o_orderkey - 700) - floor((o_orderkey - 700) / 9) * 9 AS BIGINT) AS r FROM orders""")
def _(T):
    x = col("o_orderkey") - 700
    return T("orders") >> t.transmute(o_orderkey=col("o_orderkey"), q=x / 9, w=x // 9, r=x % 9)


JOINED = "FROM orders o {} JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 5000"


def _rich(T):
    return T("customer") >> t.filter(col("c_acctbal") > 5000) >> t.select("c_custkey", "c_name")


for _kind, _sql in (("left_join", "LEFT"), ("inner_join", "")):
    query(_kind, f"SELECT o.o_orderkey, o.o_custkey, c.c_name {JOINED.format(_sql)}")(lambda T, k=_kind: T("orders") >> t.select("o_orderkey", "o_custkey") >> getattr(t, k)(_rich(T), by={"o_custkey": "c_custkey"}))
query("right_join", "SELECT o.o_orderkey, c.c_custkey AS o_custkey, c.c_name FROM orders o RIGHT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON o.o_custkey = c.c_custkey")(
    lambda T: T("orders") >> t.select("o_orderkey", "o_custkey") >> t.right_join(_rich(T), by={"o_custkey": "c_custkey"})
)
query("full_join", "SELECT o.o_orderkey, coalesce(o.o_custkey, c.c_custkey) AS o_custkey, c.c_name FROM orders o FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON o.o_custkey = c.c_custkey")(
    lambda T: T("orders") >> t.select("o_orderkey", "o_custkey") >> t.full_join(_rich(T), by={"o_custkey": "c_custkey"})
)
query("semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")(lambda T: T("orders") >> t.semi_join(_rich(T), by={"o_custkey": "c_custkey"}) >> t.select("o_orderkey"))
query("anti_join", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")(lambda T: T("orders") >> t.anti_join(_rich(T), by={"o_custkey": "c_custkey"}) >> t.select("o_orderkey"))
query("cross_join", "SELECT n_name, r_name FROM nation, region")(lambda T: T("nation") >> t.select("n_name") >> t.cross_join(T("region") >> t.select("r_name")))
query("nest_join", "SELECT r_regionkey, count(n_nationkey) AS k FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")(
    lambda T: T("region") >> t.nest_join(T("nation"), by={"r_regionkey": "n_regionkey"}, name="d") >> t.unnest("d", keep_empty=True) >> t.group_by("r_regionkey") >> t.summarise(k=t.sum(~t.is_na("n_nationkey")))
)


@query("inequality_join", "SELECT e.event_id, p.event_id AS event_id_y FROM events e JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts < p.ts WHERE e.event_type = 'error'")
def _(T):
    errors = T("events") >> t.filter(col("event_type") == "error") >> t.select("user_id", "event_id", "ts")
    bought = T("events") >> t.filter(col("event_type") == "purchase") >> t.select("user_id", "event_id", "ts")
    return errors >> t.inner_join(bought, by=t.join_by("user_id", t.lt("ts", "ts"))) >> t.select(event_id="event_id_x", event_id_y="event_id_y")


@query("closest_join", """SELECT e.event_id, p.event_id AS last_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
    ON e.user_id = p.user_id AND e.ts >= p.ts""")
def _(T):
    errors = T("events") >> t.filter(col("event_type") == "error") >> t.select("user_id", "event_id", "ts")
    bought = T("events") >> t.filter(col("event_type") == "purchase") >> t.select("user_id", last_id="event_id", at="ts")
    return errors >> t.left_join(bought, by=t.join_by("user_id", t.closest(t.ge("ts", "at")))) >> t.select("event_id", "last_id")


@query("overlaps_join", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_size <= b.p_size + 1 AND a.p_size + 1 >= b.p_size")
def _(T):
    x = T("part") >> t.transmute(a=col("p_partkey"), lo=col("p_size"), hi=col("p_size") + 1)
    y = T("part") >> t.transmute(b=col("p_partkey"), start=col("p_size"), end=col("p_size") + 1)
    return x >> t.inner_join(y, by=t.join_by(t.overlaps("lo", "hi", "start", "end"))) >> t.select("a", "b")


query("bind_cols", "SELECT r_regionkey, r_name, r_name AS again FROM region")(lambda T: T("region") >> t.arrange("r_regionkey") >> t.bind_cols(T("region") >> t.arrange("r_regionkey") >> t.select(again="r_name")))
# Set operations and changes by key: all parts against all parts with their sizes raised to 20 at least, and changes
# for twice each key, half of which there are.

WHOLE = "(SELECT p_partkey, p_brand, p_size FROM part)", "(SELECT p_partkey, p_brand, greatest(p_size, 20) AS p_size FROM part)"
CHANGES = "(SELECT 2 * p_partkey AS p_partkey, 99 AS p_size FROM part)"
FRESH = f"SELECT p_partkey, NULL, p_size FROM {CHANGES} WHERE p_partkey NOT IN (SELECT p_partkey FROM part)"
CHANGED = f"SELECT a.p_partkey, p_brand, coalesce({{}}) AS p_size FROM part a LEFT JOIN {CHANGES} b ON a.p_partkey = b.p_partkey"


def _part(T):
    return T("part") >> t.select("p_partkey", "p_brand", "p_size")


def _raised(T):
    return _part(T) >> t.mutate(p_size=t.if_else(col("p_size") < 20, 20, col("p_size")))


def _changes(T):
    return T("part") >> t.transmute(p_partkey=col("p_partkey") * 2, p_size=t.lit(99))


for _name, _op in (("union", "UNION"), ("union_all", "UNION ALL"), ("bind_rows", "UNION ALL"), ("intersect", "INTERSECT"), ("setdiff", "EXCEPT")):
    query(_name, f"SELECT * FROM {WHOLE[0]} {_op} SELECT * FROM {WHOLE[1]}")(lambda T, k=_name: _part(T) >> getattr(t, k)(_raised(T)))
query("symdiff", f"(SELECT * FROM {WHOLE[0]} EXCEPT SELECT * FROM {WHOLE[1]}) UNION (SELECT * FROM {WHOLE[1]} EXCEPT SELECT * FROM {WHOLE[0]})")(lambda T: _part(T) >> t.symdiff(_raised(T)))
query("rows_update", CHANGED.format("b.p_size, a.p_size"))(lambda T: _part(T) >> t.rows_update(_changes(T), by="p_partkey", unmatched="ignore"))
query("rows_patch", CHANGED.format("nullif(a.p_size, 7), b.p_size"))(lambda T: _part(T) >> t.mutate(p_size=t.na_if("p_size", 7)) >> t.rows_patch(_changes(T), by="p_partkey", unmatched="ignore"))
query("rows_insert", f"SELECT * FROM {WHOLE[0]} UNION ALL {FRESH}")(lambda T: _part(T) >> t.rows_insert(_changes(T), by="p_partkey", conflict="ignore"))
query("rows_append", f"SELECT * FROM {WHOLE[0]} UNION ALL SELECT p_partkey, NULL, p_size FROM {CHANGES}")(lambda T: _part(T) >> t.rows_append(_changes(T)))
query("rows_upsert", f"{CHANGED.format('b.p_size, a.p_size')} UNION ALL {FRESH}")(lambda T: _part(T) >> t.rows_upsert(_changes(T), by="p_partkey"))
query("rows_delete", f"SELECT * FROM {WHOLE[0]} WHERE p_partkey NOT IN (SELECT p_partkey FROM {CHANGES})")(lambda T: _part(T) >> t.rows_delete(_changes(T), by="p_partkey", unmatched="ignore"))



# Missing data, grids, shapes.

GAPS = "(SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS kind FROM events)"


def _gaps(T):
    return T("events") >> t.transmute(event_id=col("event_id"), user_id=col("user_id"), kind=t.if_else(col("event_id") % 3 == 0, col("event_type"), None))


query("replace_na", f"SELECT event_id, coalesce(kind, 'none') AS kind FROM {GAPS}")(lambda T: _gaps(T) >> t.replace_na({"kind": "none"}) >> t.select("event_id", "kind"))
for _way, _order in (("down", "event_id"), ("up", "event_id DESC")):
    query(f"fill_{_way}", f"SELECT event_id, last_value(kind IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY {_order} ROWS UNBOUNDED PRECEDING) AS kind FROM {GAPS}")(
        lambda T, w=_way: _gaps(T) >> t.arrange("event_id") >> t.fill("kind", direction=w, by="user_id") >> t.select("event_id", "kind")
    )
query("expand", "SELECT s.o_orderstatus, p.o_orderpriority FROM (SELECT DISTINCT o_orderstatus FROM orders) s, (SELECT DISTINCT o_orderpriority FROM orders) p")(lambda T: T("orders") >> t.expand("o_orderstatus", "o_orderpriority"))
query("complete", """WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT a.l_returnflag, b.l_linestatus, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT l_returnflag FROM c) a CROSS JOIN (SELECT DISTINCT l_linestatus FROM c) b LEFT JOIN c ON a.l_returnflag = c.l_returnflag AND b.l_linestatus = c.l_linestatus""")(
    lambda T: T("lineitem") >> t.count("l_returnflag", "l_linestatus") >> t.complete("l_returnflag", "l_linestatus", fill={"n": 0})
)
query("expand_nesting", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")(lambda T: T("customer") >> t.expand(t.nesting("c_nationkey", "c_mktsegment")))
query("crossing", "SELECT a.r_name, b.x FROM region a, (SELECT unnest([1, 2]) AS x) b")(lambda T: t.crossing(T("region") >> t.select("r_name"), x=[2, 1, 2]) >> t.mutate(x=col("x").cast("int")))
query("uncount", "SELECT p_partkey, CAST(i AS INTEGER) AS i FROM part, range(1, 51) r(i) WHERE i <= p_size")(lambda T: T("part") >> t.select("p_partkey", "p_size") >> t.uncount("p_size", id="i"))
query("pivot_longer", "SELECT l_orderkey, l_partkey, unnest(['discount', 'tax']) AS kind, unnest([l_discount, l_tax]) AS rate FROM lineitem")(
    lambda T: T("lineitem") >> t.select("l_orderkey", "l_partkey", "l_discount", "l_tax") >> t.pivot_longer(["l_discount", "l_tax"], names_to="kind", values_to="rate", names_prefix="l_")
)
query("pivot_longer_value", "SELECT c_custkey, unnest(['a', 'b']) AS set, unnest([c_acctbal, -c_acctbal]) AS bal, unnest([c_nationkey, c_nationkey + 1]) AS key FROM customer")(
    lambda T: T("customer") >> t.transmute(c_custkey=col("c_custkey"), bal_a=col("c_acctbal"), bal_b=-col("c_acctbal"), key_a=col("c_nationkey"), key_b=col("c_nationkey") + 1) >> t.pivot_longer(["bal_a", "bal_b", "key_a", "key_b"], names_to=[".value", "set"], names_sep="_")
)
query("pivot_wider", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY ALL")(
    lambda T: T("orders") >> t.count("o_orderpriority", "o_orderstatus") >> t.pivot_wider(names_from="o_orderstatus", values_from="n", values_fill=0, names_sort=True)
)
query("pivot_wider_fn", "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS q_F, sum(l_quantity) FILTER (l_linestatus = 'O') AS q_O FROM lineitem GROUP BY ALL")(
    lambda T: T("lineitem") >> t.pivot_wider(id_cols="l_returnflag", names_from="l_linestatus", values_from="l_quantity", names_prefix="q_", values_fn="sum", names_sort=True)
)
query("separate", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS rank, split_part(o_orderpriority, '-', 2) AS word FROM orders")(
    lambda T: T("orders") >> t.select("o_orderkey", "o_orderpriority") >> t.separate("o_orderpriority", ["rank", "word"], sep="-", extra="drop", fill="right") >> t.mutate(word=t.coalesce("word", ""))
)
query("separate_wider_delim", "SELECT c_custkey, split_part(c_name, '#', 1) AS a, split_part(c_name, '#', 2) AS b FROM customer")(
    lambda T: T("customer") >> t.select("c_custkey", "c_name") >> t.separate_wider_delim("c_name", ["a", "b"], "#", too_few="align_start") >> t.mutate(b=t.coalesce("b", ""))
)
query("separate_wider_regex", "SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)', 1) AS w, regexp_extract(c_name, '([0-9]+)$', 1) AS d FROM customer")(
    lambda T: T("customer") >> t.select("c_custkey", "c_name") >> t.separate_wider_regex("c_name", [("w", "[A-Za-z]+"), (None, "[^0-9]*"), ("d", "[0-9]+")])
)
query("separate_wider_position", "SELECT c_custkey, substr(c_name, 1, 3) AS a, substr(c_name, 4, 2) AS b FROM customer")(
    lambda T: T("customer") >> t.select("c_custkey", "c_name") >> t.separate_wider_position("c_name", {"a": 3, "b": 2}, too_many="drop")
)
query("separate_longer_delim", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS p_name FROM part")(lambda T: T("part") >> t.select("p_partkey", "p_name") >> t.separate_longer_delim("p_name", " "))
query("separate_longer_position", "SELECT n_nationkey, substr(n_name, i, 3) AS n_name FROM nation, range(1, 60, 3) r(i) WHERE i <= length(n_name)")(lambda T: T("nation") >> t.select("n_nationkey", "n_name") >> t.separate_longer_position("n_name", 3))
query("unite", "SELECT n_nationkey, n_name || '-' || n_regionkey AS label FROM nation")(lambda T: T("nation") >> t.unite("label", "n_name", "n_regionkey", sep="-"))
query("nest_unnest", "SELECT n_regionkey, n_name FROM nation")(lambda T: T("nation") >> t.select("n_regionkey", "n_name") >> t.nest("d", cols="n_name") >> t.unnest("d"))
query("unnest_longer", "SELECT vec_id, i AS k, embedding[i] AS v FROM embeddings, range(1, 65) r(i)")(
    lambda T: T("embeddings") >> t.select("vec_id", "embedding") >> t.unnest_longer("embedding", values_to="v", indices_to="k") >> t.mutate(k=col("k").cast("bigint"))
)
query("chop_unchop", "SELECT n_regionkey, n_nationkey FROM nation")(lambda T: T("nation") >> t.select("n_regionkey", "n_nationkey") >> t.chop("n_nationkey") >> t.unchop("n_nationkey"))
query("hoist", "SELECT vec_id, embedding[2] AS second FROM embeddings")(lambda T: T("embeddings") >> t.hoist("embedding", second=[2]) >> t.select("vec_id", "second"))
query("pack_unpack", "SELECT n_regionkey, n_nationkey, n_name FROM nation")(lambda T: T("nation") >> t.pack("p", "n_nationkey", "n_name") >> t.unpack("p"))

# Reports.

query("tabyl", "SELECT c_mktsegment, count(*) AS n, count(*) / sum(count(*)) OVER () AS percent FROM customer GROUP BY ALL")(lambda T: T("customer") >> t.tabyl("c_mktsegment"))
query("tabyl2_totals", """SELECT coalesce(o_orderpriority, 'Total') AS o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS F, count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS O, count(*) FILTER (o_orderstatus = 'P')::DOUBLE AS P
    FROM orders GROUP BY ROLLUP (o_orderpriority)""")(lambda T: T("orders") >> t.tabyl("o_orderpriority", "o_orderstatus") >> t.adorn_totals())
query("adorn_percentages", """SELECT o_orderpriority, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 9) AS F, round(count(*) FILTER (o_orderstatus = 'O') / count(*), 9) AS O, round(count(*) FILTER (o_orderstatus = 'P') / count(*), 9) AS P
    FROM orders GROUP BY ALL""")(lambda T: T("orders") >> t.tabyl("o_orderpriority", "o_orderstatus") >> t.adorn_percentages() >> t.adorn_rounding(9))
query("remove_constant", "SELECT n_nationkey FROM nation")(lambda T: T("nation") >> t.transmute(n_nationkey=col("n_nationkey"), same=t.lit(1)) >> t.remove_constant())
query("remove_empty", "SELECT n_nationkey FROM nation")(lambda T: T("nation") >> t.transmute(n_nationkey=col("n_nationkey"), none=t.na_if(t.lit(1), 1)) >> t.remove_empty())
query("summary", "SELECT 'n_nationkey' AS \"column\", count(*) AS count, CAST(0 AS BIGINT) AS null_count, count(DISTINCT n_nationkey) AS n_unique, avg(n_nationkey) AS mean FROM nation")(
    lambda T: T("nation") >> t.select("n_nationkey") >> t.summary() >> t.select("column", "count", "null_count", "n_unique", "mean")
)

# Factors.

query("fct_infreq", "SELECT c_mktsegment, n, CAST(row_number() OVER (ORDER BY n DESC, c_mktsegment) AS BIGINT) AS place FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)")(
    lambda T: T("customer") >> t.mutate(c_mktsegment=t.fct_infreq("c_mktsegment")) >> t.count("c_mktsegment") >> t.mutate(place=t.row_number())
)
query("fct_lump_n", """SELECT CASE WHEN rank() OVER (ORDER BY n DESC) <= 2 THEN c_mktsegment ELSE 'Other' END AS s, n FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)""")(
    lambda T: T("customer") >> t.mutate(s=t.fct_lump_n("c_mktsegment", 2)) >> t.count("s", "c_mktsegment") >> t.select("s", "n")
)
query("fct_recode_rev", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' ELSE o_orderstatus END AS s, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END::BIGINT AS place, count(*) AS n FROM orders GROUP BY ALL")(
    lambda T: T("orders") >> t.mutate(s=t.fct_rev(t.fct_recode(t.fct_relevel("o_orderstatus", "F"), done="F"))) >> t.count("s") >> t.mutate(place=t.row_number())
)
query("fct_reorder", "SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY median(o_totalprice)) AS BIGINT) AS place FROM orders GROUP BY o_orderpriority")(
    lambda T: T("orders") >> t.mutate(o_orderpriority=t.fct_reorder("o_orderpriority", "o_totalprice")) >> t.count("o_orderpriority") >> t.transmute(o_orderpriority=col("o_orderpriority"), place=t.row_number())
)

# Text.


def columns(table, key, sql, **made):
    """A query of one row for each row of a table, and SQL for its columns."""
    name = sql.pop("name")
    query(name, f"SELECT {key}, " + ", ".join(f"{v} AS {k}" for k, v in sql.items()) + f" FROM {table}")(lambda T: T(table) >> t.transmute(**{key: col(key)}, **made))


x, d = "p_name", "c_name"
columns("part", "p_partkey", {"name": "str_detect", "a": "contains(p_name, 'an')", "b": "regexp_matches(p_name, '^[a-m]')", "c": "starts_with(p_name, 'p')", "e": "ends_with(p_name, 'e')", "f": "CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS BIGINT)", "g": "p_name LIKE '%re%'"},
    a=t.str_detect(x, t.fixed("an")), b=t.str_detect(x, "^[a-m]"), c=t.str_starts(x, t.fixed("p")), e=t.str_ends(x, t.fixed("e")), f=t.str_count(x, "[aeiou]"), g=t.str_like(x, "%re%"))
columns("part", "p_partkey", {"name": "str_sub_pad", "a": "length(p_name)", "b": "substr(p_name, 2, 3)", "c": "substr(p_name, -3)", "e": "CASE WHEN length(p_brand) < 12 THEN lpad(p_brand, 12, '*') ELSE p_brand END", "f": "repeat(p_brand, 2)", "g": "CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 5) || '...' ELSE p_name END"},
    a=t.str_length(x), b=t.str_sub(x, 2, 4), c=t.str_sub(x, -3, -1), e=t.str_pad("p_brand", 12, pad="*"), f=t.str_dup("p_brand", 2), g=t.str_trunc(x, 8))
columns("part", "p_partkey", {"name": "str_replace", "a": "regexp_replace(p_name, '[aeiou]', '-')", "b": "regexp_replace(p_name, '[aeiou]', '-', 'g')", "c": "replace(p_name, 'a', '.')", "e": r"regexp_replace(p_name, '(\w)(\w)', '\2\1')", "f": "regexp_replace(p_name, '[aeiou]', '', 'g')"},
    a=t.str_replace(x, "[aeiou]", "-"), b=t.str_replace_all(x, "[aeiou]", "-"), c=t.str_replace_all(x, t.fixed("a"), "."), e=t.str_replace(x, r"(\w)(\w)", r"\2\1"), f=t.str_remove_all(x, "[aeiou]"))
columns("part", "p_partkey", {"name": "str_case", "a": "upper(p_name)", "b": "lower(p_type)", "c": "upper(p_name[1]) || lower(p_name[2:])", "e": "lower(replace(p_type, ' ', '_'))", "f": "lower(replace(p_type, ' ', '-'))"},
    a=t.str_to_upper(x), b=t.str_to_lower("p_type"), c=t.str_to_sentence(x), e=t.str_to_snake(t.str_to_lower("p_type")), f=t.str_to_kebab(t.str_to_lower("p_type")))
columns("part", "p_partkey", {"name": "str_extract_split", "a": "nullif(regexp_extract(p_name, '[aeiou]+'), '')", "b": "len(regexp_extract_all(p_name, '[aeiou]'))::INTEGER", "c": "string_split(p_name, ' ')[1]", "e": "string_split(p_name, ' ')[-1]", "f": "p_brand || '/' || p_size", "g": "'part ' || p_name || ' of ' || p_size"},
    a=t.str_extract(x, "[aeiou]+"), b=t.Expr(lambda c: __import__("pyspark.sql.functions", fromlist=["size"]).size(t.str_extract_all(x, "[aeiou]")(c))), c=t.str_split_i(x, " ", 1), e=t.word(x, -1), f=t.str_c(col("p_brand"), col("p_size"), sep="/"), g=t.str_glue("part {p_name} of {p_size}"))
columns("part", "p_partkey", {"name": "str_trim_squish", "a": "trim('  ' || p_name || ' ')", "b": "p_brand || ' ' || p_brand", "c": "'a\\.b'", "e": "coalesce(nullif(p_brand, 'Brand#11'), 'NA')"},
    a=t.str_trim(t.str_c("  ", col(x), " ")), b=t.str_squish(t.str_c("  ", col("p_brand"), "   ", col("p_brand"))), c=t.str_escape(t.lit("a.b")), e=t.str_replace_na(t.na_if("p_brand", "Brand#11")))
query("str_flatten", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY ALL")(lambda T: T("nation") >> t.arrange("n_nationkey") >> t.group_by("n_regionkey") >> t.summarise(names=t.str_flatten_comma("n_name")))
columns("part", "p_partkey", {"name": "str_locate_match", "a": "nullif(instr(p_name, 'a'), 0)", "b": "nullif(regexp_extract(p_name, '([a-z])([a-z])', 2), '')"}, a=t.str_locate(x, t.fixed("a"))["start"], b=t.str_match(x, "([a-z])([a-z])")["group_2"])

# Dates.

o = "o_orderdate"
columns("orders", "o_orderkey", {"name": "date_parts", "a": "year(o_orderdate)", "b": "month(o_orderdate)", "c": "day(o_orderdate)", "e": "dayofweek(o_orderdate) + 1", "f": "dayofyear(o_orderdate)", "g": "week(o_orderdate)", "h": "quarter(o_orderdate)", "i": "isoyear(o_orderdate)", "j": "(dayofyear(o_orderdate) - 1) // 7 + 1", "k": "day(last_day(o_orderdate))"},
    a=t.year(o), b=t.month(o), c=t.day(o), e=t.wday(o), f=t.yday(o), g=t.isoweek(o), h=t.quarter(o), i=t.isoyear(o), j=t.week(o), k=t.days_in_month(o))
columns("events", "event_id", {"name": "date_clock", "a": "hour(ts)", "b": "minute(ts)", "c": "date_trunc('hour', ts)", "e": "date_trunc('month', ts)::TIMESTAMP", "f": "ts + INTERVAL 36 HOUR"},
    a=t.hour("ts"), b=t.minute("ts"), c=t.floor_date("ts", "hour"), e=t.floor_date("ts", "month"), f=col("ts") + t.dhours(36))
columns("orders", "o_orderkey", {"name": "date_rounding", "a": "date_trunc('month', o_orderdate)::DATE", "b": "(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE", "c": "(o_orderdate::DATE - CAST(dayofweek(o_orderdate) AS INTEGER))", "e": "date_trunc('year', o_orderdate)::DATE"},
    a=t.floor_date(col(o).cast("date"), "month"), b=t.ceiling_date(col(o).cast("date"), "month"), c=t.floor_date(col(o).cast("date"), "week"), e=t.floor_date(col(o).cast("date"), "year"))
columns("orders", "o_orderkey", {"name": "periods", "a": "(o_orderdate::DATE + INTERVAL 1 MONTH)::DATE", "b": "(o_orderdate::DATE - INTERVAL 10 DAY)::DATE", "c": "(o_orderdate::DATE + INTERVAL 2 YEAR)::DATE"},
    a=col(o).cast("date") + t.months(1), b=col(o).cast("date") - t.days(10), c=col(o).cast("date") + t.years(2))
columns("orders", "o_orderkey", {"name": "date_format", "a": "strftime(o_orderdate, '%Y/%m/%d')", "b": "strftime(o_orderdate, '%d.%m.%y')"}, a=t.date_format(o, "%Y/%m/%d"), b=t.date_format(o, "%d.%m.%y"))
columns("part", "p_partkey", {"name": "make_date", "a": "make_date(2000 + p_size, 1 + p_size % 12, 1 + p_size % 28)", "b": "TIMESTAMP '2020-01-01' + to_days(p_size - 1)"}, a=t.make_date(col("p_size") + 2000, col("p_size") % 12 + 1, col("p_size") % 28 + 1), b=t.make_datetime(2020, 1, "p_size"))
columns("part", "p_partkey", {"name": "excel_dates", "a": "DATE '1899-12-30' + CAST(p_size + 100 AS INTEGER)"}, a=t.excel_numeric_to_date(col("p_size") + 100))

# Conversion.

columns("orders", "o_orderkey", {"name": "as_convert", "a": "o_orderkey::DOUBLE", "b": "o_orderkey", "c": "o_orderdate::DATE", "e": "o_orderkey % 2 = 0", "f": "o_orderkey::VARCHAR"},
    a=t.as_double(col("o_orderkey").cast("string")), b=t.as_integer(col("o_orderkey").cast("string")), c=t.as_date(t.date_format(o)), e=t.as_logical(t.if_else(col("o_orderkey") % 2 == 0, "TRUE", "FALSE")), f=t.as_character("o_orderkey"))
columns("orders", "o_orderkey", {"name": "parse", "a": "o_orderkey::DOUBLE", "b": "o_orderdate::DATE", "c": "o_orderdate::DATE", "e": "o_orderdate::DATE", "f": "date_trunc('second', o_orderdate)", "g": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END"},
    a=t.parse_number(t.str_c("USD ", col("o_orderkey"), " net")), b=t.ymd(t.date_format(o, "%Y-%m-%d")), c=t.mdy(t.date_format(o, "%m/%d/%Y")), e=t.dmy(t.date_format(o, "%d %B %Y")), f=t.ymd_hms(t.date_format(o, "%Y-%m-%d %H:%M:%S")),
    g=t.parse_integer(t.if_else(col("o_orderkey") % 2 == 0, col("o_orderkey").cast("string"), "none")))
query("problems", "SELECT CAST(o_orderkey AS VARCHAR) || 'x' AS original, 'v' AS \"column\", 'an integer' AS expected FROM orders WHERE o_orderkey % 1000 = 0")(
    lambda T: T("orders") >> t.mutate(v=t.parse_integer(t.str_c(col("o_orderkey"), t.if_else(col("o_orderkey") % 1000 == 0, "x", "")))) >> t.problems() >> t.select("original", "column", "expected")
)
columns("customer", "c_custkey", {"name": "rounding", "a": "round(c_acctbal / 3, 2)", "b": "round(c_acctbal, 0)", "c": "floor(c_acctbal)", "e": "ceil(c_acctbal)", "f": "abs(c_acctbal)"}, a=t.round(col("c_acctbal") / 3, 2), b=t.round_half_up("c_acctbal"), c=t.floor("c_acctbal"), e=t.ceiling("c_acctbal"), f=t.abs("c_acctbal"))
columns("orders", "o_orderkey", {"name": "missing_tests", "a": "o_orderstatus = 'P'", "b": "o_totalprice < 1e9", "c": "false"}, a=t.is_na(t.na_if("o_orderstatus", "P")), b=t.is_finite("o_totalprice"), c=t.is_nan("o_totalprice"))
columns("customer", "c_custkey", {"name": "recode_values", "a": "CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'AUTOMOBILE' THEN 'a' ELSE c_mktsegment END", "b": "c_acctbal > 0 OR c_nationkey > 10", "c": "abs(c_acctbal - 100) <= 500", "e": "CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END"},
    a=t.replace_values("c_mktsegment", ("BUILDING", "b"), ("AUTOMOBILE", "a")), b=t.when_any(col("c_acctbal") > 0, col("c_nationkey") > 10), c=t.near("c_acctbal", 100, tolerance=500), e=t.replace_when("c_acctbal", (col("c_acctbal") < 0, 0.0)))


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(T):
    from ..streaming.windows import windowed

    out = windowed(T("events") >> t.mutate(ts=col("ts").cast("timestamp")), "ts", "1 day", by=("event_type",), n=n())
    return out.selectExpr("CAST(window_start AS TIMESTAMP_NTZ) AS window_start", "event_type", "n")

# More of the same families.

columns("part", "p_partkey", {"name": "str_split_fixed", "a": "string_split(p_name, ' ')[1]", "b": "coalesce(array_to_string(string_split(p_name, ' ')[2:], ' '), '')"},
    a=t.str_split_fixed(x, " ", 2)[0], b=t.str_split_fixed(x, " ", 2)[1])
columns("part", "p_partkey", {"name": "str_equal_width", "a": "upper(p_name) = upper(p_name)", "b": "length(p_name)", "c": "p_name = 'x'"}, a=t.str_equal(x, t.str_to_upper(x), ignore_case=True), b=t.str_width(x), c=t.str_equal(x, "x"))
columns("documents", "doc_id", {"name": "str_wrap", "a": "regexp_replace(text, '\\s+', '', 'g')"}, a=t.str_remove_all(t.str_wrap("text", 60), r"\s+"))
columns("part", "p_partkey", {"name": "str_locate_all", "a": "len(regexp_extract_all(p_name, 'e'))::BIGINT"}, a=t.Expr(lambda c: __import__("pyspark.sql.functions", fromlist=["size"]).size(t.str_locate_all(x, "e")(c)).cast("long")))
columns("part", "p_partkey", {"name": "str_match_all", "a": "len(regexp_extract_all(p_name, '([a-z])([aeiou])'))::BIGINT"}, a=t.Expr(lambda c: __import__("pyspark.sql.functions", fromlist=["size"]).size(t.str_match_all(x, "([a-z])([aeiou])")(c)).cast("long")))
columns("part", "p_partkey", {"name": "str_camel_remove", "a": "regexp_replace(p_name, '[aeiou]', '')", "b": "p_name ILIKE '%AN%'", "c": "lower(p_name) = p_name"}, a=t.str_remove(x, "[aeiou]"), b=t.str_ilike(x, "%AN%"), c=t.str_detect(x, "[A-Z]", negate=True))
columns("customer", "c_custkey", {"name": "str_rank", "a": "rank() OVER (ORDER BY c_mktsegment)"}, a=t.str_rank("c_mktsegment"))
columns("orders", "o_orderkey", {"name": "leap_halves", "a": "(year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0", "b": "CASE WHEN hour(o_orderdate) < 12 THEN o_orderdate::DATE ELSE o_orderdate::DATE + 1 END::TIMESTAMP", "c": "date_trunc('quarter', o_orderdate)::TIMESTAMP", "e": "second(o_orderdate)::DOUBLE"},
    a=t.leap_year(o), b=t.round_date(o, "day"), c=t.floor_date(o, "quarter"), e=t.second(o))
columns("orders", "o_orderkey", {"name": "durations", "a": "(o_orderkey % 100) / 60.0::DOUBLE", "b": "o_orderdate + to_seconds(o_orderkey % 100 * 86400)", "c": "o_orderdate + INTERVAL 90 MINUTE"},
    a=t.time_length(t.duration(col("o_orderkey") % 100, "second"), "minute"), b=col(o) + t.duration(col("o_orderkey") % 100, "day"), c=col(o) + t.dminutes(90))
columns("orders", "o_orderkey", {"name": "fiscal_quarter", "a": "((month(o_orderdate) - 7 + 12) % 12) // 3 + 1", "b": "date_trunc('quarter', o_orderdate)::DATE"}, a=t.quarter(o, fiscal_start=7), b=t.quarter(o, "date_first"))
columns("orders", "o_orderkey", {"name": "time_zones", "a": "timezone('America/New_York', timezone('UTC', o_orderdate))"}, a=t.with_tz(o, "America/New_York"))
columns("orders", "o_orderkey", {"name": "parse_moments", "a": "date_trunc('minute', o_orderdate)", "b": "date_trunc('hour', o_orderdate)", "c": "date_trunc('second', o_orderdate)", "e": "date_trunc('month', o_orderdate)::DATE"},
    a=t.mdy_hm(t.date_format(o, "%m/%d/%Y %H:%M")), b=t.dmy_h(t.date_format(o, "%d-%m-%Y %H")), c=t.parse_datetime(t.date_format(o, "%Y.%m.%d %H-%M-%S"), "%Y.%m.%d %H-%M-%S"), e=t.ym(t.date_format(o, "%Y-%m")))
columns("orders", "o_orderkey", {"name": "parse_date_time", "a": "CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('second', o_orderdate) ELSE o_orderdate::DATE::TIMESTAMP END"},
    a=t.parse_date_time(t.if_else(col("o_orderkey") % 2 == 0, t.date_format(o, "%Y-%m-%d %H:%M:%S"), t.date_format(o, "%d/%m/%Y")), ["ymd HMS", "dmy"]))
columns("orders", "o_orderkey", {"name": "parse_logical_date", "a": "o_orderkey % 2 = 0", "b": "o_orderdate::DATE", "c": "date_trunc('second', o_orderdate)", "e": "(o_orderkey / 10)::DOUBLE"},
    a=t.parse_logical(t.if_else(col("o_orderkey") % 2 == 0, "true", "0")), b=t.parse_date(t.date_format(o, "%d.%m.%Y"), "%d.%m.%Y"), c=t.as_datetime(t.str_c(t.date_format(o, "%Y-%m-%d"), "T", t.date_format(o, "%H:%M:%S"), "Z")), e=t.parse_double(t.str_replace((col("o_orderkey") / 10).cast("string"), t.fixed("."), ","), locale=t.locale(",", ".")))
columns("customer", "c_custkey", {"name": "significant_digits", "a": "round_even(c_acctbal * 4, 0) / 4", "b": "c_acctbal"}, a=t.round_to_fraction("c_acctbal", 4), b=t.signif_half_up("c_acctbal", 12))
query("row_means", "SELECT l_orderkey, l_partkey, round((l_quantity + l_tax) / 2, 6) AS m FROM lineitem")(lambda T: T("lineitem") >> t.transmute(l_orderkey=col("l_orderkey"), l_partkey=col("l_partkey"), m=t.round(t.row_means("l_quantity", "l_tax"), 6)))
query("rowwise", "SELECT l_orderkey, l_partkey, greatest(l_discount, l_tax) AS hi FROM lineitem")(
    lambda T: T("lineitem") >> t.select("l_orderkey", "l_partkey", "l_discount", "l_tax") >> t.rowwise() >> t.mutate(hi=t.c_across("l_discount", "l_tax").max()) >> t.ungroup() >> t.select("l_orderkey", "l_partkey", "hi")
)
query("with_groups", "SELECT o_orderkey, o_totalprice = max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders")(lambda T: T("orders") >> t.with_groups("o_custkey", t.mutate(top=col("o_totalprice") == t.max("o_totalprice"))) >> t.select("o_orderkey", "top"))
query("nest_by", "SELECT n_regionkey, CAST(count(*) AS INTEGER) AS k FROM nation GROUP BY ALL")(lambda T: T("nation") >> t.nest_by("n_regionkey") >> t.ungroup() >> t.with_spark(lambda df: df.selectExpr("n_regionkey", "size(data) AS k")))
query("group_data", "SELECT n_regionkey, n_nationkey + 1 AS row FROM nation")(lambda T: T("nation") >> t.arrange("n_nationkey") >> t.group_by("n_regionkey") >> t.group_data() >> t.unnest_longer(".rows", values_to="row"))
query("order_by", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY value, event_id) AS a FROM events")(
    lambda T: T("events") >> t.arrange("event_id") >> t.group_by("user_id") >> t.mutate(a=t.order_by("value", t.lag("event_id"))) >> t.ungroup() >> t.select("event_id", "a")
)
query("cummean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id), 9) AS m FROM events")(lambda T: T("events") >> t.arrange("event_id") >> t.group_by("user_id") >> t.mutate(m=t.round(t.cummean("value"), 9)) >> t.ungroup() >> t.select("event_id", "m"))
query("single_value", "SELECT n_regionkey, min(r_name) AS r FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")(lambda T: T("nation") >> t.left_join(T("region"), by={"n_regionkey": "r_regionkey"}) >> t.summarise(by="n_regionkey", r=t.single_value("r_name")))
query("case_when_error_free", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS s FROM orders")(
    lambda T: T("orders") >> t.transmute(o_orderkey=col("o_orderkey"), s=t.recode_values("o_orderstatus", from_=["F", "O", "P"], to=[1, 2, 3], unmatched="error"))
)
query("between_join", "SELECT p.p_partkey, b.band FROM part p JOIN (SELECT 1 AS lo, 10 AS hi, 'small' AS band UNION ALL SELECT 11, 50, 'large') b ON p.p_size BETWEEN b.lo AND b.hi")(
    lambda T: T("part") >> t.inner_join(t.tidy({"lo": [1, 11], "hi": [10, 50], "band": ["small", "large"]}), by=t.join_by(t.between("p_size", "lo", "hi"))) >> t.select("p_partkey", "band")
)
query("within_join", "SELECT p.p_partkey FROM part p JOIN (SELECT 5 AS lo, 20 AS hi) b ON p.p_size >= b.lo AND p.p_size + 1 <= b.hi")(
    lambda T: T("part") >> t.mutate(up=col("p_size") + 1) >> t.inner_join(t.tidy({"lo": [5], "hi": [20]}), by=t.join_by(t.within("p_size", "up", "lo", "hi"))) >> t.select("p_partkey")
)
query("full_seq", "SELECT unnest(range(0, 5))::BIGINT AS k")(lambda T: T("region") >> t.summarise(k=t.first(t.full_seq("r_regionkey", 1))) >> t.unnest_longer("k") >> t.mutate(k=col("k").cast("bigint")))
query("expand_grid", "SELECT r_regionkey, n_nationkey FROM region, nation")(lambda T: t.expand_grid(T("region") >> t.select("r_regionkey"), T("nation") >> t.select("n_nationkey")))
query("fct_collapse", "SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'home' ELSE 'other' END AS s, count(*) AS n FROM customer GROUP BY ALL")(
    lambda T: T("customer") >> t.mutate(s=t.fct_collapse("c_mktsegment", home=["BUILDING", "FURNITURE"], other_level="other")) >> t.count("s")
)
query("fct_inorder_na", "SELECT coalesce(nullif(o_orderstatus, 'P'), '(Missing)') AS s, count(*) AS n FROM orders GROUP BY ALL")(lambda T: T("orders") >> t.mutate(s=t.na_if("o_orderstatus", "P")) >> t.mutate(s=t.fct_na_value_to_level(t.fct_inorder("s"))) >> t.count("s"))
query("fct_lump_prop", "SELECT CASE WHEN n > 0.2 * sum(n) OVER () THEN c_mktsegment ELSE 'Other' END AS s, n FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)")(
    lambda T: T("customer") >> t.mutate(s=t.fct_lump_prop("c_mktsegment", 0.2)) >> t.count("s", "c_mktsegment") >> t.select("s", "n")
)
query("fct_reorder2", "SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY arg_max(c_acctbal, c_custkey) DESC) AS BIGINT) AS place FROM customer GROUP BY ALL")(
    lambda T: T("customer") >> t.mutate(c_mktsegment=t.fct_reorder2("c_mktsegment", "c_custkey", "c_acctbal")) >> t.count("c_mktsegment") >> t.transmute(c_mktsegment=col("c_mktsegment"), place=t.row_number())
)
query("adorn_pct", "SELECT c_mktsegment, count(*) AS n, printf('%.0f%%', round_even(100 * count(*) / sum(count(*)) OVER (), 0)) AS percent FROM customer GROUP BY ALL")(lambda T: T("customer") >> t.tabyl("c_mktsegment") >> t.adorn_pct_formatting(0))
query("row_to_names", "SELECT n_name AS \"NATION_0\", n_comment AS header FROM (SELECT n_nationkey, n_name, 'c' AS n_comment FROM nation) WHERE n_nationkey > 0")(
    lambda T: T("nation") >> t.arrange("n_nationkey") >> t.transmute(a=col("n_name"), b=t.if_else(col("n_nationkey") == 0, "header", "c")) >> t.row_to_names(1)
)
query("compare_df_cols", "SELECT 'r_name' AS column_name, 'character' AS df_1, NULL::VARCHAR AS df_2 UNION ALL SELECT 'r_regionkey', 'integer', NULL UNION ALL SELECT 'n_name', NULL, 'character' UNION ALL SELECT 'n_nationkey', NULL, 'integer' UNION ALL SELECT 'n_regionkey', NULL, 'integer'")(
    lambda T: t.compare_df_cols(T("region"), T("nation"))
)
query("separate_convert", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1)::BIGINT AS k FROM orders")(lambda T: T("orders") >> t.select("o_orderkey", "o_orderpriority") >> t.separate("o_orderpriority", ["k", None], sep="-", convert=True, extra="drop") >> t.select("o_orderkey", "k"))
query("unnest_wider", "SELECT event_id, event_type AS s_kind, value AS s_v FROM events")(lambda T: T("events") >> t.pack("s", "event_type", "value") >> t.select("event_id", "s") >> t.unnest_wider("s", names_sep="_") >> t.rename(s_kind="s_event_type", s_v="s_value"))
query("pivot_spec", "SELECT c_custkey, unnest(['nationkey', 'acctbal']) AS k, unnest([c_nationkey::DOUBLE, c_acctbal]) AS v FROM customer")(
    lambda T: T("customer") >> t.select("c_custkey", "c_nationkey", "c_acctbal") >> t.pivot_longer_spec(t.build_longer_spec(T("customer"), ["c_nationkey", "c_acctbal"], names_to="k", values_to="v", names_prefix="c_"))
)


@query("session_windows", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) WHERE gap IS NULL OR gap > INTERVAL 2 HOUR GROUP BY ALL")
def _(T):
    from ..streaming.windows import sessions

    out = sessions(T("events") >> t.mutate(ts=col("ts").cast("timestamp")), "ts", "2 hours", by=("user_id",), n=n())
    return t.tidy(out) >> t.count("user_id", name="sessions")


# Readers and sinks, there and back.


def _place(name):
    """A new folder that all executors see, gone when Spark's JVM ends."""
    import uuid

    from ..sources.io import shared_folder

    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


CUSTOMERS = "SELECT c_custkey::BIGINT AS c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"


def _customers(T):
    return T("customer") >> t.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def _typed(f):
    return f >> t.mutate(c_custkey=col("c_custkey").cast("bigint"), c_acctbal=col("c_acctbal").cast("double"))


def _back(T, read, **options):
    path = _place("customers")
    _customers(T) >> t.write_csv(path, **options)
    return _typed(read(path))


query("write_csv_read_csv", CUSTOMERS)(lambda T: _back(T, t.read_csv))
query("write_csv_scan_csv", CUSTOMERS)(lambda T: _back(T, t.scan_csv))
query("read_tsv", CUSTOMERS)(lambda T: _back(T, t.read_tsv, sep="\t"))
query("read_delim", CUSTOMERS)(lambda T: _back(T, lambda p: t.read_delim(p, "|"), sep="|"))


@query("write_parquet_scan_parquet", CUSTOMERS)
def _(T):
    path = _place("customers")
    _customers(T) >> t.write_parquet(path)
    return _typed(t.scan_parquet(path))


@query("compute", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL")
def _(T):
    return T("orders") >> t.select("o_custkey") >> t.compute() >> t.count("o_custkey")


@query("collect_pull", "SELECT count(*)::BIGINT AS n, sum(n_nationkey)::BIGINT AS keys, max(n_name) AS last FROM nation")
def _(T):
    nation = T("nation") >> t.arrange("n_name")
    keys = nation >> t.to_numpy(columns=["n_nationkey"], dtype="int64", order="c")
    return t.tidy({"n": [len(nation >> t.collect("arrow"))], "keys": [int(keys.sum())], "last": [list(nation >> t.pull("n_name"))[-1]]})


@query("dimensions", "SELECT count(*)::BIGINT AS rows, 5::BIGINT AS columns, 's_suppkey' AS first FROM supplier")
def _(T):
    f = T("supplier") >> t.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal") >> t.mutate(z=col("s_nationkey"))
    assert t.dim(f) == (t.nrow(f), t.ncol(f)) and t.names(f) == t.colnames(f) == list(t.dtypes(f))
    return t.tidy({"rows": [t.nrow(f)], "columns": [t.ncol(f)], "first": [t.names(f)[0]]})


# Groups.

query("summarize", "SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY ALL")(lambda T: T("orders") >> t.summarize(by="o_custkey", top=t.max("o_totalprice")))
query("std", "SELECT o_orderstatus, floor(stddev_samp(o_totalprice) * 100 + 0.5) / 100 AS a FROM orders GROUP BY ALL")(lambda T: T("orders") >> t.summarise(by="o_orderstatus", a=money(t.std("o_totalprice"))))


@query("group_facts", "SELECT n_regionkey, count(*)::BIGINT AS size, (SELECT count(DISTINCT n_regionkey) FROM nation)::BIGINT AS groups, list(n_nationkey + 1 ORDER BY n_nationkey)::BIGINT[] AS rows FROM nation GROUP BY ALL")
def _(T):
    g = T("nation") >> t.arrange("n_nationkey") >> t.group_by("n_regionkey")
    keys = list(g >> t.group_keys() >> t.pull("n_regionkey"))
    assert (g >> t.group_vars()) == (g >> t.groups()) == ["n_regionkey"]
    indices = g >> t.group_indices()
    size = g >> t.group_size()
    assert [indices.count(i + 1) for i in range(len(keys))] == list(size)
    return t.tidy({"n_regionkey": [int(k) for k in keys], "size": list(size), "groups": [g >> t.n_groups()] * len(keys), "rows": [list(r) for r in g >> t.group_rows()]})


@query("group_split", "SELECT n_regionkey, max(n_name) AS last FROM nation GROUP BY ALL")
def _(T):
    parts = T("nation") >> t.arrange("n_nationkey") >> t.group_by("n_regionkey") >> t.group_split()
    first, *rest = [p >> t.ungroup() >> t.summarise(by="n_regionkey", last=t.max("n_name")) for p in parts]
    return first >> t.bind_rows(*rest)


@query("group_map", "SELECT n_regionkey, count(*)::BIGINT AS n FROM nation GROUP BY ALL")
def _(T):
    seen = []
    g = T("nation") >> t.group_by("n_regionkey")
    g >> t.group_walk(lambda d, *k: seen.append(t.nrow(d)))
    parts = g >> t.group_map(lambda d, *k: t.nrow(d))
    assert sorted(seen) == sorted(parts)
    keys = list(g >> t.group_keys() >> t.pull("n_regionkey"))
    return t.tidy({"n_regionkey": [int(k) for k in keys], "n": [int(p) for p in parts]})


# Selection.

query("selector_patterns", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")(lambda T: T("customer") >> t.select(t.ends_with("key"), t.contains("NAME"), t.matches("^c_acct")))
query("selector_ranges", "SELECT c_custkey, c_name, c_nationkey FROM customer")(lambda T: T("customer") >> t.select("c_custkey", "c_name", "c_nationkey", "c_acctbal") >> t.select(t.col_range("c_custkey", "c_nationkey")))
query("selector_between", "SELECT c_name, c_nationkey FROM customer")(lambda T: T("customer") >> t.select("c_custkey", "c_name", "c_nationkey", "c_acctbal") >> t.select(t.cols_between("c_name", "c_nationkey")))
query("selector_all_of", "SELECT c_mktsegment, c_custkey FROM customer")(lambda T: T("customer") >> t.select(t.all_of(["c_mktsegment", "c_custkey"])))
query("selector_everything", "SELECT * FROM region")(lambda T: T("region") >> t.select(t.everything()))
query("selector_num_range", "SELECT r_regionkey AS x1, r_regionkey * 2 AS x2 FROM region")(lambda T: T("region") >> t.transmute(x1=col("r_regionkey"), x2=col("r_regionkey") * 2, x10=col("r_regionkey") * 10) >> t.select(t.num_range("x", [1, 2])))
query("selector_group_cols", "SELECT o_orderstatus, o_orderpriority FROM orders")(lambda T: T("orders") >> t.group_by("o_orderstatus", "o_orderpriority") >> t.select(t.group_cols()) >> t.ungroup())
query("predicates_number", "SELECT l_orderkey, l_partkey FROM lineitem")(lambda T: T("lineitem") >> t.select("l_orderkey", "l_partkey", "l_tax", "l_returnflag") >> t.select(t.where(t.is_integer)))
query("predicates_float", "SELECT l_tax FROM lineitem")(lambda T: T("lineitem") >> t.select("l_orderkey", "l_partkey", "l_tax", "l_returnflag") >> t.select(t.where(t.is_float)))
query("predicates_string", "SELECT l_returnflag FROM lineitem")(lambda T: T("lineitem") >> t.select("l_orderkey", "l_partkey", "l_tax", "l_returnflag") >> t.select(t.where(t.is_string), t.where(t.is_character)))
query("predicates_boolean", "SELECT o_totalprice > 1000 AS big FROM orders")(lambda T: T("orders") >> t.transmute(o_orderkey=col("o_orderkey"), big=col("o_totalprice") > 1000) >> t.select(t.where(t.is_boolean), t.where(t.is_bool)))
query("predicates_time", "SELECT o_orderdate FROM orders")(lambda T: T("orders") >> t.select("o_orderkey", "o_orderdate") >> t.select(t.where(t.is_temporal)))
query("pick", "SELECT o_custkey, o_orderkey, o_custkey + o_orderkey AS s FROM orders")(lambda T: T("orders") >> t.select("o_custkey", "o_orderkey") >> t.mutate(s=t.row_sums(t.pick("o_custkey", "o_orderkey"))))

# Conditions and joins.

columns("lineitem", "l_orderkey", {"name": "when_all", "a": "l_tax > 0.02 AND l_discount > 0.02", "b": "l_tax = 0"}, a=t.when_all(col("l_tax") > 0.02, col("l_discount") > 0.02), b=t.is_infinite(col("l_quantity") / col("l_tax")))
query("equality_join_by", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda T: T("nation") >> t.inner_join(T("region"), by=t.join_by(t.eq("n_regionkey", "r_regionkey"))) >> t.select("n_name", "r_name"))
query("le_gt_join", "SELECT a.s_suppkey, count(*) AS k FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal <= b.s_acctbal AND a.s_suppkey > b.s_suppkey GROUP BY ALL")(
    lambda T: T("supplier") >> t.inner_join(T("supplier") >> t.select(n2="s_nationkey", b2="s_acctbal", k2="s_suppkey"), by=t.join_by(t.eq("s_nationkey", "n2"), t.le("s_acctbal", "b2"), t.gt("s_suppkey", "k2"))) >> t.count("s_suppkey", name="k")
)
query("setequal", "SELECT true AS same, false AS less")(lambda T: t.tidy({"same": [T("nation") >> t.setequal(T("nation") >> t.arrange(t.desc("n_name")))], "less": [T("nation") >> t.setequal(T("nation") >> t.filter(col("n_nationkey") > 3))]}))

# Reshaping and reports.

query("pivot_wider_spec", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY ALL")(
    lambda T: (lambda c: c >> t.pivot_wider_spec(t.check_pivot_spec(t.build_wider_spec(c, names_from="o_orderstatus", values_from="n")), values_fill=0))(T("orders") >> t.count("o_custkey", "o_orderstatus"))
)
query("unnest_auto", "SELECT n_regionkey, n_name FROM nation")(lambda T: T("nation") >> t.select("n_regionkey", "n_name") >> t.chop("n_name") >> t.unnest_auto("n_name"))
query("find_header", "SELECT 2::BIGINT AS row")(lambda T: t.tidy({"row": [t.tidy({"a": ["x", "id", "1"], "b": ["", "name", "z"]}) >> t.find_header(value="id")]}))
query("compare_df_cols_same", "SELECT true AS a, false AS b")(lambda T: t.tidy({"a": [t.compare_df_cols_same(T("nation"), T("nation"), verbose=False)], "b": [t.compare_df_cols_same(T("nation"), T("nation") >> t.mutate(n_name=t.lit(1)), verbose=False)]}))
query("make_clean_names", "SELECT unnest(['first_name', 'x_2', 'first_name_2']) AS name")(lambda T: t.tidy({"name": t.make_clean_names(["First Name", "x 2", "First.Name"])}))

# Dates.

columns("orders", "o_orderkey", {"name": "clock_parsers", "a": "date_trunc('minute', o_orderdate)", "b": "date_trunc('hour', o_orderdate)", "c": "date_trunc('second', o_orderdate)", "e": "date_trunc('hour', o_orderdate)", "f": "date_trunc('second', o_orderdate)", "g": "date_trunc('minute', o_orderdate)"},
    a=t.ymd_hm(t.date_format(o, "%Y-%m-%d %H:%M")), b=t.ymd_h(t.date_format(o, "%Y/%m/%d %H")), c=t.mdy_hms(t.date_format(o, "%m/%d/%Y %H:%M:%S")), e=t.mdy_h(t.date_format(o, "%m-%d-%Y %H")), f=t.dmy_hms(t.date_format(o, "%d.%m.%Y %H:%M:%S")), g=t.dmy_hm(t.date_format(o, "%d/%m/%Y %H:%M")))
columns("orders", "o_orderkey", {"name": "clock_periods", "a": "o_orderdate + INTERVAL 14 DAY", "b": "o_orderdate + INTERVAL 5 HOUR", "c": "o_orderdate + INTERVAL 90 MINUTE", "e": "o_orderdate - INTERVAL 30 SECOND", "f": "o_orderdate + INTERVAL 26 HOUR"},
    a=col(o) + t.weeks(2), b=col(o) + t.hours(5), c=col(o) + t.minutes(90), e=col(o) - t.seconds(30), f=col(o) + t.period(days=1, hours=2))
columns("orders", "o_orderkey", {"name": "add_with_rollback", "a": "o_orderdate + INTERVAL 1 MONTH"}, a=t.add_with_rollback(o, t.months(1)))
columns("orders", "o_orderkey", {"name": "exact_durations", "a": "o_orderdate + INTERVAL 90 SECOND", "b": "o_orderdate + INTERVAL 36 HOUR", "c": "o_orderdate - INTERVAL 7 DAY", "e": "o_orderdate + INTERVAL 31557600 SECOND", "f": "o_orderdate + INTERVAL 2629800 SECOND"},
    a=col(o) + t.dseconds(90), b=col(o) + t.ddays(1.5), c=col(o) - t.dweeks(1), e=col(o) + t.dyears(1), f=col(o) + t.dmonths(1))
query("date_seq", "SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 1 WEEK))::DATE AS d")(lambda T: t.tidy({"d": list(t.date_seq(__import__("datetime").date(2024, 1, 1), __import__("datetime").date(2024, 3, 1), by="week"))}))

# Factors and text.

query("fct_lump_min", "SELECT CASE WHEN count(*) OVER (PARTITION BY o_orderstatus) >= 1000 THEN o_orderstatus ELSE 'Other' END AS s, o_orderkey FROM orders")(lambda T: T("orders") >> t.transmute(o_orderkey=col("o_orderkey"), s=t.fct_lump_min("o_orderstatus", 1000)))
query("fct_drop_expand", "SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY ALL")(lambda T: T("customer") >> t.mutate(s=t.fct_drop(t.fct_expand(t.as_factor("c_mktsegment"), "NONE"))) >> t.count("s"))
query("fct_na_level_to_value", "SELECT nullif(o_orderstatus, 'P') AS s, count(*) AS n FROM orders GROUP BY ALL")(lambda T: T("orders") >> t.mutate(s=t.fct_na_level_to_value("o_orderstatus", "P")) >> t.count("s"))
columns("part", "p_partkey", {"name": "str_pattern_kinds", "a": "contains(lower(p_name), 'an')", "b": "regexp_matches(lower(p_name), '^[a-m]')", "c": "length(p_name)::BIGINT", "e": "len(string_split(p_name, ' '))::BIGINT", "f": "string_split(p_name, ' ')", "g": "p_size::VARCHAR", "h": "p_size::DOUBLE"},
    a=t.str_detect(x, pattern=t.coll("AN", ignore_case=True)), b=t.str_detect(x, pattern=t.regex("^[A-M]", ignore_case=True)), c=t.str_count(x, pattern=t.boundary("character")), e=t.str_count(x, pattern=r"\S+"), f=t.str_split(x, pattern=" "), g=t.as_string("p_size"), h=t.as_numeric(t.as_string("p_size")))
columns("part", "p_partkey", {"name": "str_keywords", "a": "regexp_replace(p_name, '[aeiou]', '-')", "b": "p_name LIKE '%re%'", "c": "regexp_extract_all(p_name, '[aeiou]')", "e": "upper(p_name[1]) || p_name[2:]"},
    a=t.str_replace(x, pattern="[aeiou]", replacement="-"), b=t.str_like(x, pattern="%re%"), c=t.str_extract_all(x, pattern="[aeiou]"), e=t.str_c(t.str_to_upper(t.str_sub(x, 1, 1)), t.str_sub(x, 2)))
query("str_flatten_last", "SELECT n_regionkey, string_agg(n_name, '/' ORDER BY n_nationkey) AS names FROM nation GROUP BY ALL")(lambda T: T("nation") >> t.arrange("n_nationkey") >> t.group_by("n_regionkey") >> t.summarise(names=t.str_flatten("n_name", "/")))


@query("str_vectors", "SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) AS BIGINT) AS place, contains(n_name, 'AN') AS has FROM nation")
def _(T):
    names = list(T("nation") >> t.pull("n_name"))
    ordered = t.str_sort(names)
    assert ordered == [names[i - 1] for i in t.str_order(names)] and sorted(t.str_unique(names + names)) == sorted(names)
    some = t.str_subset(ordered, pattern="AN")
    assert some == [ordered[i - 1] for i in t.str_which(ordered, pattern="AN")]
    return t.tidy({"n_name": ordered, "place": list(range(1, len(ordered) + 1)), "has": [n in some for n in ordered]})


query("str_glue_data", "SELECT unnest(['a is 1', 'b is 2']) AS s")(lambda T: t.tidy({"s": t.str_glue_data({"k": ["a", "b"], "v": [1, 2]}, "{k} is {v}")}))
query("str_split_1", "SELECT unnest(['a', 'b', 'c']) AS s")(lambda T: t.tidy({"s": t.str_split_1("a,b,c", ",")}))
