"""Literal cases for every operator, the SQL front end, the loader and the plans."""

import datetime as dt
import random

import duckdb
import pytest

import granary as g
from granary import queries
from granary.functions import date
from granary.operators import Order, Relation
from granary.plans import inspect
from granary.plans.sqltext import parse
from granary.sources import CSV, TBL, DelimitedOptions, load_delimited, load_frame, load_lines
from granary.types import schema


def rel(spark, ddl, *rows):
    return Relation(spark.createDataFrame(list(rows), ddl))


def rows(r):
    return [tuple(x) for x in r.df.collect()]


def visits():
    """Made-up restaurant visits: a shop, a day, seats and a bill, each but the shop sometimes missing."""
    rng = random.Random(20)
    some = lambda v: None if rng.random() < 0.1 else v
    day = lambda: dt.date(2019, 5, 1) + dt.timedelta(days=rng.randrange(900))
    return [
        (n, rng.choice(["harbour", "mill", "old town", "station"]), some(day()), some(rng.randrange(1, 9)), some(rng.randrange(2000) / 8))
        for n in range(120)
    ]


VISITS = "visit int, shop string, day date, seats int, bill double"


@pytest.fixture(scope="module")
def engine(spark):
    e = g.Engine(spark)
    e.add("visits", e.spark.createDataFrame(visits(), VISITS))
    return e


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("CREATE TABLE visits (visit INTEGER, shop VARCHAR, day DATE, seats INTEGER, bill DOUBLE)")
    db.executemany("INSERT INTO visits VALUES (?, ?, ?, ?, ?)", visits())
    return db


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT visit, shop FROM visits WHERE seats <= 2 AND NOT shop = 'mill' ORDER BY shop, visit",
        "SELECT shop, count(*), count(bill), max(seats) FROM visits WHERE day >= DATE '2020-01-01' GROUP BY shop ORDER BY shop",
        "SELECT visit, bill * 2 - seats AS left_over FROM visits WHERE bill BETWEEN 20 AND 80 ORDER BY visit",
        "SELECT seats, sum(bill * (1 - 0.25)) AS net, avg(bill) AS mean FROM visits GROUP BY seats ORDER BY seats",
        "SELECT visit, bill FROM visits ORDER BY bill DESC, visit LIMIT 7",
        "SELECT min(bill), max(bill), min(day) FROM visits WHERE shop = 'harbour' OR seats = 8",
        "select visits.visit as v from visits where not (seats between 2 and 7) order by v",
        "SELECT visit, day FROM visits WHERE day < DATE '2019-09-01' ORDER BY day DESC, visit",
        "SELECT seats + 1 AS more, count(*) AS n FROM visits WHERE bill > 100 GROUP BY seats + 1 ORDER BY more",
    ],
)
def test_statements_equal_duckdb(engine, duck, sql):
    got, want = [tuple(r) for r in engine.query(sql).rows], duck.execute(sql).fetchall()
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert x == pytest.approx(y) if all(isinstance(v, (int, float)) for v in y) else x == y


def test_default_names(engine):
    assert engine.sql("SELECT seats - 2, avg(bill), count(*), avg(seats) FROM visits GROUP BY seats - 2").df.columns == ["expr0", "avg", "count_star", "avg_1"]
    assert engine.sql("SELECT shop, bill * 3 FROM visits").df.columns == ["shop", "expr1"]


@pytest.mark.parametrize(
    ("sql", "error"),
    [
        ("SELECT colour FROM visits", g.BindError), ("SELECT shop FROM cinemas", g.BindError), ("SELECT , shop FROM visits", g.ParseError),
        ("PICK shop FROM visits", g.ParseError), ("SELECT -seats FROM visits", g.ParseError), ("SELECT shop FROM visits; ", g.ParseError),
        ("SELECT max(bill) * 2 FROM visits", g.ParseError), ("SELECT shop FROM visits WHERE max(bill) > 9", g.ParseError),
        ("SELECT shop FROM visits ORDER BY seats * 2", g.UnsupportedPlanError), ("SELECT shop FROM visits ORDER BY day", g.BindError),
        ("SELECT day, avg(bill) FROM visits GROUP BY shop", g.BindError), ("SELECT shop FROM visits WHERE seats", g.BindError),
        ("SELECT shop FROM visits WHERE seats = 'four'", g.BindError), ("SELECT DISTINCT shop FROM visits", g.BindError),
        ("SELECT shop FROM visits LIMIT 2.0", g.ParseError), ("SELECT shop FROM visits, cinemas", g.ParseError),
        ("SELECT shop FROM visits WHERE seats < 123456789012345678901", g.ParseError), ("SELECT cinemas.shop FROM visits", g.BindError),
        ("SELECT shop FROM visits WHERE day > DATE '2019-04-31'", g.ParseError),
    ],
)
def test_sql_errors(engine, sql, error):
    with pytest.raises(error):
        engine.query(sql)


@pytest.mark.parametrize("func", ["sum", "avg", "min", "max"])
def test_unsupported_aggregate_types(spark, func):
    r = rel(spark, "s string, b boolean, d date", ("a", True, dt.date(2020, 1, 1)))
    for c in ("s", "b") + (("d",) if func in ("sum", "avg") else ()):
        with pytest.raises(g.BindError):
            r.aggregate(aggs=[g.functions.Aggregate(func, g.col(c))])
    assert Relation(r.df, extended=True).aggregate(aggs=[g.max_(g.col("s"))]).df.collect()[0][0] == "a"


def test_three_valued_logic(spark):
    v = {"T": True, "F": False, "N": None}
    data = [(k, v[a], v[b]) for k, (a, b) in enumerate(zip("TTTFFFNNN", "TFNTFNTFN", strict=True))]
    r = rel(spark, "i int, l boolean, r boolean", *data)
    out = r.project("i", (g.col("l") & g.col("r")).alias("a"), (g.col("l") | g.col("r")).alias("o"), (~g.col("l")).alias("n"))
    got = sorted(rows(out))
    assert [x[1] for x in got] == [v[c] for c in "TFNFFFNFN"]
    assert [x[2] for x in got] == [v[c] for c in "TTTTFNTNN"]
    assert [x[3] for x in got] == [v[c] for c in "FFFTTTNNN"]


def test_null_propagation_and_widths(spark):
    r = rel(spark, "a int, b int", (10, 1), (None, 2), (3, 3))
    assert rows(r.project((g.col("a") + g.col("b")).alias("x"), (g.col("a") > 5).alias("y"))) == [(11, True), (None, None), (6, False)]
    assert rows(rel(spark, "a bigint", (2**40,)).project((g.col("a") * 3).alias("x"))) == [(3 * 2**40,)]


def test_integer_arithmetic_wraps_in_the_engine_only(spark):
    e = g.Engine(spark)
    e.add("w", e.spark.createDataFrame([(2**31 - 1, 2**63 - 1), (1, 1)], "a int, b bigint"))
    assert e.query("SELECT a + 1 FROM w WHERE a > 1").get(0, 0) == -(2**31)
    assert e.query("SELECT sum(b) FROM w").get(0, 0) == -(2**63)
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_arithmetic_against_a_model(spark):
    rng = random.Random(7)
    data = [(rng.randrange(-(2**31), 2**31), rng.randrange(-(2**31), 2**31)) for _ in range(300)]
    e = g.Engine(spark)
    e.add("m", e.spark.createDataFrame(data, "a int, b int"))

    def wrap(x):
        return (x + 2**31) % 2**32 - 2**31

    got = [tuple(r) for r in e.query("SELECT a + b, a - b, a * b, a < b FROM m").rows]
    assert got == [(wrap(a + b), wrap(a - b), wrap(a * b), a < b) for a, b in data]


def test_date_arithmetic(spark):
    r = rel(spark, "d date", (dt.date(2021, 1, 31),))
    assert rows(r.project((g.col("d") + 1).alias("x"), (date("1970-01-01") + 18628).alias("y"))) == [(dt.date(2021, 2, 1), dt.date(2021, 1, 1))]
    with pytest.raises(g.BindError):
        r.project((g.col("d") - g.col("d")).alias("x"))


def test_aggregates(spark):
    r = rel(spark, "x int", (10,), (20,), (30,), (None,), (40,))
    x = g.col("x")
    every = [g.count_star(), g.count(x), g.sum_(x), g.min_(x), g.max_(x), g.avg(x)]
    assert rows(r.aggregate(aggs=every)) == [(5, 4, 100, 10, 40, 25.0)]
    assert rows(r.filter(x > 99).aggregate(aggs=every)) == [(0, 0, None, None, None, None)]
    k = rel(spark, "k int, v int", (1, 5), (None, 6), (1, 7), (None, 8))
    assert sorted(rows(k.aggregate(["k"], [g.sum_(g.col("v"))])), key=str) == [(1, 12), (None, 14)]
    wide = Relation(spark.range(1000).selectExpr("3000000 AS v"))
    assert rows(wide.aggregate(aggs=[g.sum_(g.col("v"))])) == [(3_000_000_000,)]


def test_partitioning_does_not_change_integer_aggregates(spark):
    df = spark.range(50_000).selectExpr("id % 100 AS k", "id AS v")
    aggs = [g.sum_(g.col("v")), g.count_star()]
    got = [sorted(rows(Relation(df.repartition(n)).aggregate(["k"], aggs))) for n in (1, 7, 32)]
    assert got[0] == got[1] == got[2]


def test_joins(spark):
    build = rel(spark, "k int, b int", (1, 100), (None, 999), (1, 101))
    probe = rel(spark, "k int, p int", (1, 10), (None, 20), (5, 50))
    assert sorted(rows(probe.join(build, [("k", "k")]))) == [(1, 10, 1, 100), (1, 10, 1, 101)]
    assert probe.join(build, [("k", "k")]).df.columns == ["k", "p", "k_r", "b"]
    two = rel(spark, "a int, b int", (1, 1), (1, 2), (2, 1))
    other = rel(spark, "c int, d int", (1, 2), (2, 2), (1, 1))
    assert len(rows(other.join(two, [("c", "a"), ("d", "b")]))) == 2
    assert rows(probe.join(build.filter(g.col("b") < 0), [("k", "k")])) == []


def test_order_and_top_n(spark):
    r = rel(spark, "x int", (3,), (None,), (1,), (None,), (2,))
    assert [x for (x,) in rows(r.order_by("x"))] == [1, 2, 3, None, None]
    assert [x for (x,) in rows(r.order_by(Order("x", descending=True)))] == [3, 2, 1, None, None]
    assert [x for (x,) in rows(r.order_by(Order("x", nulls_first=True)))] == [None, None, 1, 2, 3]
    rng = random.Random(3)
    many = rel(spark, "x int", *[(rng.randrange(10**6),) for _ in range(3000)])
    assert rows(many.top_n(17, "x")) == rows(many.order_by("x"))[:17]
    assert rows(many.top_n(0, "x")) == []
    assert len(rows(r.limit(100))) == 5


ITEM = schema(id="INT32", name="VARCHAR", price="DOUBLE", d="DATE")


def test_loader(spark, tmp_path):
    got = load_lines(spark, ["1,apple,1.50,2021-01-01", "", "2,,,\r"], ITEM)
    assert [tuple(r) for r in got.collect()] == [(1, "apple", 1.5, dt.date(2021, 1, 1)), (2, None, None, None)]
    p = tmp_path / "t.tbl"
    p.write_text("1|hello|\n2|wo\"rld|\n")
    assert [tuple(r) for r in load_delimited(spark, str(p), schema(a="INT32", b="VARCHAR"), TBL).collect()] == [(1, "hello"), (2, 'wo"rld')]
    p.write_text("a\n10\n20\n")
    assert sorted(r.a for r in load_delimited(spark, str(p), schema(a="INT32"), DelimitedOptions(has_header=True)).collect()) == [10, 20]
    flags = load_lines(spark, ["1,t", "0,FALSE"], schema(a="BOOL", b="BOOL")).collect()
    assert [tuple(r) for r in flags] == [(True, True), (False, False)]
    token = load_lines(spark, ["NA,", "1,x"], schema(a="INT32", b="VARCHAR"), DelimitedOptions(null_token="NA")).collect()
    assert [tuple(r) for r in token] == [(None, ""), (1, "x")]
    p.write_text("")
    assert load_delimited(spark, str(p), ITEM).count() == 0
    p.write_text("".join(f"{i}\n" for i in range(4101)))
    assert load_delimited(spark, str(p), schema(a="INT64")).count() == 4101


@pytest.mark.parametrize(("lines", "kind"), [(["1,2", "3"], "INT32"), (["12x,1"], "INT32"), (["2021-13-01,1"], "DATE"), (["+1,1"], "INT32"), (["2147483648,1"], "INT32"), (["yes,1"], "BOOL")])
def test_loader_errors(spark, lines, kind):
    with pytest.raises(g.LoadError):
        load_lines(spark, lines, schema(a=kind, b="INT32"), CSV)


def test_missing_file(spark):
    with pytest.raises(g.IoError):
        load_delimited(spark, "/nowhere/at/all.csv", ITEM)


def test_print(spark):
    text = str(rel(spark, "id int, d date, b boolean, s string", (7, dt.date(2021, 3, 15), True, None)).collect())
    assert text == "id | d | b | s\n7 | 2021-03-15 | true | NULL\n"


def test_plan_shapes(spark, sf):
    e = g.Engine(spark)
    e.add_directory(sf, ["orders", "lineitem"])
    top = e.sql("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 1 + 2 ORDER BY o_custkey LIMIT 10").df
    assert "TakeOrderedAndProject" in inspect.physical(top)
    assert "GreaterThan(o_custkey,3)" in inspect.pushed_filters(top)[0]
    assert sorted(inspect.read_columns(top)[0]) == ["o_custkey", "o_orderkey"]
    joined = e.table("lineitem").join(e.table("orders"), [("l_orderkey", "o_orderkey")])
    both = joined.filter((g.col("l_quantity") > 5.0) & (g.col("o_custkey") < 3)).df
    assert all("Than" in f for f in inspect.pushed_filters(both))
    assert inspect.exchanges(e.sql("SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus").df) == 1


def test_parser_desugars_between():
    e = parse("SELECT a FROM t WHERE a BETWEEN 1 AND 9").where
    assert (e.op, e.left.op, e.right.op) == ("AND", ">=", "<=")


def test_joins_in_a_row_on_one_name(spark):
    a, b, c = (rel(spark, f"k int, {n} string", (1, n), (2, n)) for n in "xyz")
    out = a.join(b, [("k", "k")]).join(c, [("k", "k")])
    assert out.df.columns == ["k", "x", "k_r", "y", "k_r2", "z"]
    assert sorted(rows(out.project("k_r", "k_r2", "z"))) == [(1, 1, "z"), (2, 2, "z")]
    taken = rel(spark, "k int, k_r int", (1, 5))
    assert a.join(taken, [("k", "k")]).df.columns == ["k", "x", "k_r2", "k_r"]


def test_a_field_may_hold_any_character(spark, tmp_path):
    (tmp_path / "odd.csv").write_text("n,t\n1,a\u0001b\n")
    out = load_delimited(spark, str(tmp_path / "odd.csv"), spark.createDataFrame([], "n int, t string").schema, DelimitedOptions(has_header=True))
    assert [tuple(r) for r in out.collect()] == [(1, "a\u0001b")]


def test_pushed_filters_are_whole(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    for k in range(12):
        df = df.filter(f"l_orderkey <> {k} and l_partkey <> {k}")
    (pushed,) = inspect.pushed_filters(df)
    assert pushed.count("l_orderkey") >= 12 and "..." not in pushed


def test_an_aggregate_over_joins_makes_no_joined_rows(spark):
    hot = Relation(spark.range(300_000).selectExpr("1 AS k", "id AS a"))
    out = hot.join(Relation(hot.df.selectExpr("k", "a AS b")), [("k", "k")]).join(rel(spark, "k int, n string", (1, "x"), (2, "y")), [("k_r", "k")])
    got = out.aggregate(["k", "n"], [g.count_star(), g.count(g.col("b")), g.min_(g.col("a")), g.max_(g.col("b"))])
    assert inspect.optimized(got.df).split("Join")[-1].count("Aggregate") == 3
    assert rows(got) == [(1, "x", 90_000_000_000, 90_000_000_000, 0, 299_999)]


@pytest.mark.parametrize("keys", [["k"], ["n", g.col("j_r") + 1], ["a", "b"], []])
def test_aggregates_over_joins_equal_those_over_the_joined_rows(spark, keys):
    rng = random.Random(5)
    some = lambda v: None if rng.random() < 0.2 else v
    make = lambda n: [(some(rng.randrange(4)), some(rng.randrange(3)), some(rng.randrange(-9, 9)), some(rng.randrange(64) / 8)) for _ in range(n)]
    left, right = rel(spark, "k int, j int, a int, x double", *make(60)), rel(spark, "K bigint, j int, b bigint, y double", *make(50))
    tags = rel(spark, "J int, n string", (0, "o"), (1, "p"), (1, None), (9, "q"))
    for joined in (left.join(right, [("k", "K")]).join(tags, [("j", "J")]), left.join(right.join(tags, [("J", "j")], broadcast=True), [("K", "k"), ("j", "j")])):
        c = {x.lower(): g.col(x) for x in joined.df.columns}
        aggs = [g.count_star(), g.functions.Aggregate("count", g.lit(None)), g.sum_(c["a"] * c["b"]).alias("ab"), g.avg(c["x"] + c["y"]).alias("xy")]
        for name in "abxy":
            aggs += [f(c[name]).alias(f"{name}{k}") for k, f in enumerate((g.count, g.sum_, g.min_, g.max_, g.avg))]
        got, want = joined.aggregate(keys, aggs), Relation(joined.df).aggregate(keys, aggs)
        assert [(f.name, f.dataType) for f in got.df.schema] == [(f.name, f.dataType) for f in want.df.schema]
        assert len(rows(want)) > 0
        for x, y in zip(sorted(rows(got), key=str), sorted(rows(want), key=str), strict=True):
            assert x == pytest.approx(y)
        if keys:
            assert sorted(rows(joined.aggregate(keys)), key=str) == sorted(rows(Relation(joined.df).aggregate(keys)), key=str)
        empty = left.filter(g.col("a") > 99).join(right, [("k", "k")])
        some_aggs = [g.count_star(), g.sum_(g.col("b")), g.avg(g.col("x")), g.count(g.col("y"))]
        assert rows(empty.aggregate(aggs=some_aggs)) == [(0, None, None, 0)]


def _loaded_orders(spark, sf, monkeypatch, name):
    """The rows of a loader query, and the optimized plan of each job of its load."""
    plans, frame = [], type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: (plans.append(inspect.optimized(df)), collect(df))[1])
    return queries.queries()[name](spark, sf), plans


def test_a_tbl_load_splits_each_line_once_a_pass(spark, sf, monkeypatch):
    out, plans = _loaded_orders(spark, sf, monkeypatch, "load_tbl")
    assert [p.count("split(") for p in [*plans, inspect.optimized(out)]] == [1, 1]
    assert [p.count("concat_ws(") for p in [*plans, inspect.optimized(out)]] == [1, 1]
    assert not any("Limit" in p for p in plans)


def test_a_load_with_a_null_token_splits_each_line_once_a_pass(spark, sf, monkeypatch):
    out, plans = _loaded_orders(spark, sf, monkeypatch, "load_csv_null_token")
    assert [p.count("split(") for p in [*plans, inspect.optimized(out)]] == [1, 1]
    assert [p.count("concat_ws(") for p in [*plans, inspect.optimized(out)]] == [1, 1]


def test_a_csv_load_splits_each_line_once_a_pass(spark, sf, monkeypatch):
    out, plans = _loaded_orders(spark, sf, monkeypatch, "load_csv")
    assert [p.count("split(") for p in [*plans, inspect.optimized(out)]] == [1, 1]
    assert [p.count("concat_ws(") for p in [*plans, inspect.optimized(out)]] == [1, 1]


def test_the_first_bad_line_is_named(spark):
    lines = spark.range(0, 4000, 1, 7).selectExpr("if(id in (2900, 3100), 'x' || id || ',1', id || ',1') AS line")
    with pytest.raises(g.LoadError, match="column a: not INT64, in line 'x2900,1'"):
        load_frame(lines, schema(a="INT64", b="INT32"))
    good = load_frame(lines.filter("line not like 'x%'"), schema(a="INT64", b="INT32"))
    assert sorted(r.a for r in good.collect()) == [k for k in range(4000) if k not in (2900, 3100)]
