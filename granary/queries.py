"""One query for each operator, with the SQL that gives the same rows.

Each entry is (key, function of a table reader, SQL). Double sums are rounded,
as their last bits depend on the order of addition. Where NULLs are needed
they are made in the input, before the operator under test.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import Expr, avg, col, count, count_star, date, lit, max_, min_, sum_
from granary.operators import Order, Relation
from granary.plans.lower import lower
from granary.plans.sqltext import parse
from granary.sources import CSV, TBL, DelimitedOptions, load_frame

Tables = Callable[[str], Relation]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """A reader of the star schema; ship and order dates become DATE, as the engine has no timestamps."""

    def read(name: str) -> Relation:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        for c in ("l_shipdate", "o_orderdate"):
            if c in df.columns:
                df = df.withColumn(c, F.col(c).cast("date"))
        return Relation(df)

    return read


_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority"


def _reloaded(r: Relation, options: DelimitedOptions, missing: str = "false") -> Relation:
    """The rows of orders, written as delimited lines and loaded; the priority is NULL where missing holds."""
    last = F.when(F.expr(missing), F.lit(None)).otherwise(F.col("o_orderpriority"))
    text = [F.coalesce(c.cast("string"), F.lit(options.null_token)) for c in (*map(F.col, r.df.columns[:-1]), last)]
    end = F.lit(options.delimiter if options.trailing_delimiter else "")
    return Relation(load_frame(r.df.select(F.concat(F.concat_ws(options.delimiter, *text), end)), r.df.schema, options))


def _rounded(r: Relation, places: int, *names: str) -> Relation:
    return Relation(r.df.withColumns({n: F.round(n, places) for n in names}))


def _holes(t: Tables) -> Relation:
    """Orders with a NULL price for every third key and a NULL status for every fifth."""
    return Relation(
        t("orders").df.select(
            "o_orderkey", "o_custkey",
            F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"),
            F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"),
        )
    )


HOLES = """(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status FROM orders)"""


def q1(t: Tables, before: str = "1998-09-02") -> Relation:
    price, discount, tax = col("l_extendedprice"), col("l_discount"), col("l_tax")
    out = (
        t("lineitem")
        .filter(col("l_shipdate") <= date(before))
        .aggregate(
            ["l_returnflag", "l_linestatus"],
            [
                sum_(col("l_quantity")).alias("sum_qty"),
                sum_(price).alias("sum_base_price"),
                sum_(price * (lit(1.0) - discount)).alias("sum_disc_price"),
                sum_(price * (lit(1.0) - discount) * (lit(1.0) + tax)).alias("sum_charge"),
                avg(col("l_quantity")).alias("avg_qty"),
                avg(price).alias("avg_price"),
                avg(discount).alias("avg_disc"),
                count_star().alias("count_order"),
            ],
        )
    )
    sums = ("sum_qty", "sum_base_price", "sum_disc_price", "sum_charge")
    out = _rounded(_rounded(out, 2, *sums), 6, "avg_qty", "avg_price", "avg_disc")
    return out.order_by("l_returnflag", "l_linestatus")


Q1_SQL = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
    round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
    round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
    round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price,
    round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1998-09-02' GROUP BY ALL ORDER BY 1, 2"""


def q6(t: Tables, year: int = 1996) -> Relation:
    ship = col("l_shipdate")
    wanted = (ship >= date(f"{year}-01-01")) & (ship < date(f"{year + 1}-01-01"))
    wanted &= col("l_discount").between(0.05, 0.07) & (col("l_quantity") < 24.0)
    total = sum_(col("l_extendedprice") * col("l_discount")).alias("revenue")
    return _rounded(t("lineitem").filter(wanted).aggregate(aggs=[total]), 2, "revenue")


def _q6_sql(year: int) -> str:
    return f"""SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
    WHERE CAST(l_shipdate AS DATE) >= DATE '{year}-01-01' AND CAST(l_shipdate AS DATE) < DATE '{year + 1}-01-01'
    AND l_discount BETWEEN 0.05::DOUBLE AND 0.07::DOUBLE AND l_quantity < 24"""


def _sql(text: str) -> Callable[[Tables], Relation]:
    return lambda t: lower(parse(text), t)


def _keep(table: str, predicate: Expr, *columns: str) -> Callable[[Tables], Relation]:
    return lambda t: t(table).filter(predicate).project(*columns)


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_LINE_SQL = ", ".join(_LINE)
_EVENTS = [count_star().alias("n"), sum_(col("event_id")).alias("ids")]


def _null_keys(t: Tables) -> Relation:
    left = Relation(
        t("orders").df.select("o_orderkey", F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("k"))
    )
    right = Relation(
        t("customer").df.select("c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("ck"))
    )
    return left.join(right, [("k", "ck")])


def _multi_key(t: Tables) -> Relation:
    right = t("lineitem").aggregate(["l_partkey", "l_suppkey"], [count_star().alias("n")])
    left = t("lineitem").project("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return left.join(right, [("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey")])


def _pushed(t: Tables) -> Relation:
    joined = t("lineitem").join(t("orders"), [("l_orderkey", "o_orderkey")])
    kept = joined.filter((col("l_quantity") > 45.0) & (col("o_orderpriority") == "1-URGENT"))
    return _rounded(
        kept.aggregate(["o_orderstatus"], [count_star().alias("n"), sum_(col("l_quantity")).alias("qty")]), 2, "qty"
    )


_ALL: list[tuple[str, Callable[[Tables], Relation], str]] = [
    # Scans and projection: S9 S10 P2 P3 P4 P5 P6 E1 E2 E3 E14
    ("scan_select_star", lambda t: t("nation"), "SELECT * FROM nation"),
    ("scan_pruned", lambda t: t("customer").project("c_custkey", "c_acctbal"), "SELECT c_custkey, c_acctbal FROM customer"),
    ("project_arith",
     lambda t: t("lineitem").project(
         "l_orderkey", (col("l_quantity") * 2).alias("q2"), (col("l_linenumber") + 1).alias("next_line"),
         (col("l_orderkey") - col("l_partkey")).alias("gap"),
         (col("l_extendedprice") * (lit(1.0) - col("l_discount"))).alias("net")),
     "SELECT l_orderkey, l_quantity * 2 AS q2, l_linenumber + 1 AS next_line, l_orderkey - l_partkey AS gap, "
     "l_extendedprice * (1 - l_discount) AS net FROM lineitem"),
    ("project_default_names", lambda t: t("region").project("r_name", col("r_regionkey") + 1, col("r_regionkey") * 2),
     "SELECT r_name, r_regionkey + 1 AS expr1, r_regionkey * 2 AS expr2 FROM region"),
    # Predicates: P1 P7 E4-E13 E17 E18
    ("filter_eq_str", _keep("orders", col("o_orderpriority") == "1-URGENT", "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'"),
    ("filter_ne", _keep("orders", col("o_orderstatus") != "F", "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"),
    ("filter_compare_str", _keep("part", col("p_brand") >= "Brand#3", "p_partkey"), "SELECT p_partkey FROM part WHERE p_brand >= 'Brand#3'"),
    ("filter_range", _keep("lineitem", (col("l_quantity") > 10.0) & (col("l_quantity") <= 12.0), *_LINE), f"SELECT {_LINE_SQL} FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 12"),
    ("filter_between", _keep("part", col("p_size").between(5, 9), "p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 9"),
    ("filter_literal_compare", _keep("region", lit(1) < lit(2), "r_name"), "SELECT r_name FROM region WHERE 1 < 2"),
    ("filter_3vl_and", lambda t: _holes(t).filter((col("price") > 1000.0) & (col("status") == "F")).project("o_orderkey"), f"SELECT o_orderkey FROM {HOLES} WHERE price > 1000 AND status = 'F'"),
    ("filter_3vl_or", lambda t: _holes(t).filter((col("price") > 150000.0) | (col("status") == "F")).project("o_orderkey"), f"SELECT o_orderkey FROM {HOLES} WHERE price > 150000 OR status = 'F'"),
    ("filter_3vl_not", lambda t: _holes(t).filter(~((col("price") > 1000.0) & (col("status") == "F"))).project("o_orderkey"), f"SELECT o_orderkey FROM {HOLES} WHERE NOT (price > 1000 AND status = 'F')"),
    ("filter_null_literal", lambda t: t("orders").filter(col("o_custkey") == None).project("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey = NULL"),  # noqa: E711
    ("date_filter", lambda t: t("orders").filter(col("o_orderdate") >= "1997-06-01").project("o_orderkey", "o_orderdate"), "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE o_orderdate >= DATE '1997-06-01'"),
    ("date_plus_int", lambda t: t("orders").project("o_orderkey", (col("o_orderdate") + 30).alias("due"), (col("o_orderdate") - 1).alias("eve")), "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS due, CAST(o_orderdate AS DATE) - 1 AS eve FROM orders"),
    # Aggregation: A1-A17
    ("agg_global", lambda t: _rounded(t("orders").aggregate(aggs=[count_star().alias("n"), count(col("o_orderkey")).alias("n_keys"), sum_(col("o_custkey")).alias("s"), min_(col("o_totalprice")).alias("lo"), max_(col("o_totalprice")).alias("hi"), avg(col("o_totalprice")).alias("mean")]), 4, "mean"),
     "SELECT count(*) AS n, count(o_orderkey) AS n_keys, CAST(sum(o_custkey) AS BIGINT) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean FROM orders"),
    ("agg_global_empty", lambda t: t("orders").filter(col("o_orderkey") < 0).aggregate(aggs=[count_star().alias("n"), sum_(col("o_custkey")).alias("s"), min_(col("o_totalprice")).alias("lo"), avg(col("o_totalprice")).alias("mean")]),
     "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, min(o_totalprice) AS lo, avg(o_totalprice) AS mean FROM orders WHERE o_orderkey < 0"),
    ("agg_group_single", lambda t: t("events").aggregate(["event_type"], _EVENTS), "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1"),
    ("agg_group_multi", lambda t: t("events").aggregate(["user_id", "event_type"], _EVENTS), "SELECT user_id, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2"),
    ("agg_group_expr", lambda t: t("lineitem").aggregate([col("l_linenumber") * 10], [count_star(), max_(col("l_quantity"))]), "SELECT l_linenumber * 10 AS expr0, count(*) AS count_star, max(l_quantity) AS max FROM lineitem GROUP BY 1"),
    ("agg_over_expr", lambda t: _rounded(t("lineitem").aggregate(["l_suppkey"], [sum_(col("l_extendedprice") * (lit(1.0) - col("l_discount"))).alias("net")]), 2, "net"), "SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem GROUP BY 1"),
    ("agg_group_null_key", lambda t: _holes(t).aggregate(["status"], [count_star().alias("n"), sum_(col("o_orderkey")).alias("s")]), f"SELECT status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM {HOLES} GROUP BY 1"),
    ("agg_group_no_aggs", lambda t: t("orders").aggregate(["o_orderstatus", "o_orderpriority"]), "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY 1, 2"),
    ("agg_count_col_nulls", lambda t: _holes(t).aggregate(["o_custkey"], [count_star().alias("n"), count(col("price")).alias("n_price"), min_(col("price")).alias("lo")]), f"SELECT o_custkey, count(*) AS n, count(price) AS n_price, min(price) AS lo FROM {HOLES} GROUP BY 1"),
    ("agg_all_null_group", lambda t: _holes(t).aggregate([(col("o_orderkey") * 1).alias("k")], [count(col("price")).alias("n"), sum_(col("price")).alias("s")]), f"SELECT o_orderkey * 1 AS k, count(price) AS n, sum(price) AS s FROM {HOLES} GROUP BY 1"),
    ("agg_min_max_date", lambda t: t("lineitem").aggregate(["l_returnflag"], [min_(col("l_shipdate")).alias("lo"), max_(col("l_shipdate")).alias("hi")]), "SELECT l_returnflag, min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem GROUP BY 1"),
    ("agg_partial_final", lambda t: Relation(t("lineitem").df.repartition(8)).aggregate(["l_partkey"], [count_star().alias("n"), sum_(col("l_linenumber")).alias("s")]), "SELECT l_partkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1"),
    # Joins: J1-J6
    ("join_inner", lambda t: t("orders").join(t("customer"), [("o_custkey", "c_custkey")]).project("o_orderkey", "o_custkey", "c_custkey", "c_name"), "SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    ("join_multi_key", _multi_key, f"SELECT {_LINE_SQL.replace('l_', 'a.l_')}, b.l_partkey AS l_partkey_r, b.l_suppkey AS l_suppkey_r, n FROM lineitem a JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey"),
    ("join_null_keys", _null_keys, "SELECT o_orderkey, k, c_name, ck FROM (SELECT o_orderkey, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey END AS k FROM orders) JOIN (SELECT c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS ck FROM customer) ON k = ck"),
    ("join_fanout", lambda t: t("nation").join(t("customer"), [("n_nationkey", "c_nationkey")]).project("n_name", "c_custkey"), "SELECT n_name, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey"),
    ("join_no_match", lambda t: t("region").join(t("nation").filter(col("n_regionkey") > 99), [("r_regionkey", "n_regionkey")]).project("r_name", "n_name"), "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey AND n_regionkey > 99"),
    ("join_filter_pushdown", _pushed, "SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45 AND o_orderpriority = '1-URGENT' GROUP BY 1"),
    # Order, top-N, limit: O1-O6
    ("sort_asc", lambda t: t("customer").project("c_custkey", "c_acctbal").order_by("c_acctbal", "c_custkey"), "SELECT c_custkey, c_acctbal FROM customer ORDER BY 2, 1"),
    ("sort_desc", lambda t: t("part").project("p_partkey", "p_name").order_by(Order("p_name", descending=True), "p_partkey"), "SELECT p_partkey, p_name FROM part ORDER BY 2 DESC, 1"),
    ("sort_nulls_last", lambda t: _holes(t).project("o_orderkey", "price").top_n(40, Order("price", descending=True), "o_orderkey"), f"SELECT o_orderkey, price FROM {HOLES} ORDER BY price DESC NULLS LAST, 1 LIMIT 40"),
    ("sort_nulls_first", lambda t: _holes(t).project("o_orderkey", "status").top_n(40, Order("status", nulls_first=True), "o_orderkey"), f"SELECT o_orderkey, status FROM {HOLES} ORDER BY status ASC NULLS FIRST, 1 LIMIT 40"),
    ("topn_asc", lambda t: t("orders").project("o_orderkey", "o_totalprice").top_n(17, "o_totalprice", "o_orderkey"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2, 1 LIMIT 17"),
    ("topn_desc", lambda t: t("events").project("event_id", "value").top_n(25, Order("value", descending=True), "event_id"), "SELECT event_id, value FROM events ORDER BY 2 DESC, 1 LIMIT 25"),
    ("topn_zero", lambda t: t("events").project("event_id").top_n(0, "event_id"), "SELECT event_id FROM events LIMIT 0"),
    ("limit_n", lambda t: t("lineitem").project((col("l_linenumber") * 0).alias("zero")).limit(5), "SELECT l_linenumber * 0 AS zero FROM lineitem LIMIT 5"),
    ("sort_bool", lambda t: t("orders").project((col("o_totalprice") > 100000.0).alias("dear"), "o_orderkey").top_n(40, "dear", Order("o_orderkey", descending=True)), "SELECT o_totalprice > 100000 AS dear, o_orderkey FROM orders ORDER BY 1, 2 DESC LIMIT 40"),
    ("sort_int32", lambda t: t("customer").project("c_nationkey", "c_custkey").top_n(40, Order("c_nationkey", descending=True), "c_custkey"), "SELECT c_nationkey, c_custkey FROM customer ORDER BY 1 DESC, 2 LIMIT 40"),
    ("sort_date", lambda t: t("orders").project("o_orderdate", "o_orderkey").top_n(40, "o_orderdate", "o_orderkey"), "SELECT CAST(o_orderdate AS DATE) AS o_orderdate, o_orderkey FROM orders ORDER BY 1, 2 LIMIT 40"),
    ("join_three_on_one_name", lambda t: t("customer").project(col("c_nationkey").alias("k"), "c_custkey").join(t("supplier").project(col("s_nationkey").alias("k"), "s_suppkey"), [("k", "k")]).join(t("nation").project(col("n_nationkey").alias("k"), "n_name"), [("k_r", "k")]).aggregate(["k", "k_r2", "n_name"], [count_star()]), "SELECT c_nationkey AS k, n_nationkey AS k_r2, n_name, count(*) AS count_star FROM customer, supplier, nation WHERE c_nationkey = s_nationkey AND s_nationkey = n_nationkey GROUP BY ALL"),
    # Loaders: the table as lines of text, read back
    ("load_csv", lambda t: _reloaded(t("orders"), CSV), f"SELECT {_ORDERS} FROM orders"),
    ("load_csv_null_token", lambda t: _reloaded(t("orders"), DelimitedOptions(delimiter=";", null_token="\\N"), "o_orderstatus = 'F'"), "SELECT " + _ORDERS.replace("o_orderpriority", "CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority") + " FROM orders"),
    ("load_tbl", lambda t: _reloaded(t("orders"), TBL), f"SELECT {_ORDERS} FROM orders"),
    # Whole statements
    ("tpch_q1", q1, Q1_SQL),
    ("tpch_q6", q6, _q6_sql(1996)),
    ("tpch_q6_empty_window", lambda t: q6(t, 1994), _q6_sql(1994)),
    ("sql_filter_order", _sql("SELECT o_orderkey, o_totalprice p FROM orders WHERE o_totalprice > 1000 AND NOT o_orderstatus = 'F' ORDER BY p DESC, o_orderkey LIMIT 30"), "SELECT o_orderkey, o_totalprice AS p FROM orders WHERE o_totalprice > 1000 AND NOT o_orderstatus = 'F' ORDER BY p DESC, o_orderkey LIMIT 30"),
    ("sql_group", _sql("SELECT event_type, sum(event_id), count(*), min(value) AS lo FROM events WHERE value BETWEEN 10 AND 150 GROUP BY event_type ORDER BY event_type"), "SELECT event_type, CAST(sum(event_id) AS BIGINT) AS sum, count(*) AS count_star, min(value) AS lo FROM events WHERE value BETWEEN 10 AND 150 GROUP BY 1"),
    ("sql_group_expr", _sql("SELECT l_linenumber + 1 AS line, max(l_quantity) FROM lineitem WHERE l_shipdate < DATE '1998-01-01' GROUP BY l_linenumber + 1"), "SELECT l_linenumber + 1 AS line, max(l_quantity) AS max FROM lineitem WHERE l_shipdate < DATE '1998-01-01' GROUP BY 1"),
    ("sql_star", _sql("SELECT * FROM region WHERE region.r_regionkey >= 2 OR FALSE"), "SELECT * FROM region WHERE r_regionkey >= 2"),
    ("sql_q6", lambda t: _rounded(lower(parse("SELECT sum(l_extendedprice * l_discount) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"), t), 2, "revenue"), _q6_sql(1996)),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda s, d, f=f: f(tables(s, d)).df) for name, f, _ in _ALL}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _ALL}
