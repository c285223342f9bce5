"""Functions and operators on small tables, against plain Python."""

import pytest
from pyspark.sql import functions as F

from concord.functions import arith, text
from concord.operators import collections as co, folds, graph, merge, verbs, vet
from concord.plans import Schema, contains, enum, kind, len_, max_, min_, mulof, neq, nof, pattern, rest, unique, when
from concord.plans.constraint import Constraint
from concord.plans.schema import Field


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("a,b", [(7, 2), (-7, 2), (7, -2), (-7, -2), (6, 3), (0, 5)])
def test_integer_division(spark, a, b):
    x, y = F.lit(a).cast("long"), F.lit(b).cast("long")
    assert one(spark, arith.div(x, y)) == int(a / b)
    assert one(spark, arith.rem(x, y)) == a - b * int(a / b)
    assert one(spark, arith.mod(x, y)) == a % b


def test_arithmetic_refuses(spark):
    zero, big = F.lit(0).cast("long"), F.lit(1e200)
    for c in (arith.div(F.lit(1).cast("long"), zero), arith.mod(F.lit(1).cast("long"), zero), arith.mul(big, big, "float", "float"), arith.div(F.lit(1.0), F.lit(0.0), "float", "float")):
        with pytest.raises(Exception, match="divide_by_zero|float_overflow"):
            one(spark, c)
    with pytest.raises(TypeError, match="exact_float_mix"):
        arith.add(F.lit(1), F.lit(1), "float", "biginteger")
    with pytest.raises(TypeError, match="inexact_divide"):
        arith.div(F.lit(1), F.lit(1), "bigdecimal", "integer")


@pytest.mark.parametrize(
    "got,want",
    [
        (lambda: text.upper(F.lit("héllo"), 1, 2), "hÉLlo"),
        (lambda: text.upper(F.lit("hello"), -2), "helLO"),
        (lambda: text.upper(F.lit("ab"), 9, 2), "ab"),
        (lambda: text.translate(F.lit("abcd"), "abc", "x"), "xxxd"),
        (lambda: text.translate(F.lit("aab"), "aa", "xy"), "yyb"),
        (lambda: text.translate(F.lit("a-z"), "a-c"), "-z"),
        (lambda: text.rep(F.lit("aa"), "a*", "-"), "-"),
        (lambda: text.rep(F.lit("baac"), "a*", "-"), "-b-c-"),
        (lambda: text.rep(F.lit("a1b22"), r"(\d)", "<$1$$>"), "a<1$>b<2$><2$>"),
        (lambda: text.esc(F.lit("it's"), "sql"), "it''s"),
        (lambda: text.esc(F.lit("a b+c"), "uri"), "a%20b%2Bc"),
        (lambda: text.esc(F.lit("it's"), "shell"), "'it'\\''s'"),
        (lambda: text.nom(F.lit("parseHTTPResponse2x"), "snake"), "parse_http_response2x"),
        (lambda: text.nom(F.lit("user_id"), "pascal", ["ID"]), "UserID"),
        (lambda: text.nom(F.lit("user id"), "camel"), "userId"),
        (lambda: text.join(F.array(F.lit("a"), F.lit("b")), "-"), "a-b"),
    ],
)
def test_text(spark, got, want):
    assert one(spark, got()) == want


def test_split(spark):
    assert one(spark, text.split(F.lit("a..b"), ".")) == ["a", "", "b"]
    assert one(spark, text.split(F.lit("aé"), "")) == ["a", "é"]
    assert one(spark, text.split(F.lit(""), "")) == [""]
    assert one(spark, text.split(F.lit("a1b22c"), r"\d+", pattern=True)) == ["a", "b", "c"]


def test_escapes_round_trip_and_refuse(spark):
    s = "a'b\"c\\d\n<&>\té"
    for v in ("json", "sq", "sql", "shell", "xml", "uri"):
        assert one(spark, text.usc(text.esc(F.lit(s), v), v)) == s, v
    for v, bad in (("sql", "a'b"), ("json", "\\q"), ("xml", "&nope;"), ("shell", "x")):
        with pytest.raises(Exception, match="usc_malformed"):
            one(spark, text.usc(F.lit(bad), v))
    with pytest.raises(ValueError, match="not portable"):
        text.rep(F.lit("a"), "(?=a)", "")


def test_escapes_over_escapes_compute_their_argument_once(spark):
    c = F.col("argument")
    for v in ("json", "xml", "sql", "uri", "shell"):
        c = text.usc(text.esc(c, v), v)
    assert str(c).count("argument") == 1
    rows = ["", "'", "''", "a'''b\"", "\\", "\\n&amp;%20+", "".join(map(chr, range(32))), "é\u2028😀", None]
    df = spark.createDataFrame([(x,) for x in rows], "argument string")
    assert [r[0] for r in df.select(c).collect()] == rows
    for bad in ("'", "a'''b"):
        with pytest.raises(Exception, match="usc_malformed"):
            one(spark, text.usc(F.lit(bad), "sql"))


def test_predicates_agree_with_the_driver(spark):
    rows = [(1, 1.0, "a", [1, 2], {"a": 1}), (10, 2.5, "", [1, 1], {}), (-3, 0.3, "mm", [], {"a": 5, "b": 9}), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i long, f double, s string, l array<long>, m map<string,long>")
    cases = {
        "i": [min_(1), kind("integer") & neq(10), mulof(5), kind("float"), enum(1, -3), nof(1, min_(5), max_(0)), when(min_(5), max_(9)), kind("integer") | kind("null")],
        "f": [mulof(0.1), kind("number") & max_(2.0), kind("integer")],
        "s": [kind("string"), pattern("^m+$"), len_(2), min_("b"), len_(max_(1))],
        "l": [unique(), len_(min_(1)), contains(min_(2)), contains(min_(1), 2)],
        "m": [rest(max_(8)), rest(max_(8), "b"), len_(2)],
    }
    for col, cs in cases.items():
        for c in cs:
            got = [r["x"] for r in df.select(c.test(F.col(col), df.schema[col].dataType).alias("x")).collect()]
            want = [c.admits(v) if v is not None else c.kinds is not None and "null" in c.kinds for v in (r[list(cases).index(col)] for r in rows)]
            assert got == want, (col, c.canon())


def test_vet_findings_do_not_depend_on_partitions(spark):
    df = spark.range(100).select(F.col("id").alias("a"), F.when(F.col("id") % 7 != 0, F.col("id") % 5).alias("b"))
    s = Schema.of(a=kind("integer") & min_(10), b=Field(kind("integer") & max_(3)), c=kind("string"), closed=False)
    one_, many = (sorted(map(tuple, vet.findings(df.repartition(n), s, ["a"]).collect()), key=str) for n in (1, 8))
    assert one_ == many
    assert len([r for r in one_ if r[1] == "a"]) == 10 and len([r for r in one_ if r[1] == "c"]) == 100
    assert vet.verdict(df, Schema.of(a=kind("integer"))).first()["verdict"] == "valid"
    assert vet.verdict(df, Schema.of(b=kind("integer"))).first()["verdict"] == "incomplete"
    assert vet.verdict(df, Schema.of(b=kind("integer")), partial=True).first()["verdict"] == "valid"
    assert vet.verdict(df, s).first()["verdict"] == "invalid"
    assert not vet.findings(df, Schema(), ["a"]).count()


def test_folds_of_nothing(spark):
    none = spark.range(0)
    assert folds.fold(none, n=folds.total(F.col("id"))).first()["n"] == 0
    with pytest.raises(Exception, match="aggregate_empty"):
        folds.fold(none, n=folds.least(F.col("id"))).first()


def test_refusals(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    with pytest.raises(Exception, match="pick_key"):
        co.pick(df, "v").collect()
    with pytest.raises(Exception, match="match_none"):
        df.select(co.match((F.col("v") == "a", F.lit(1)))).collect()
    with pytest.raises(Exception, match="sort_key"):
        co.sort(df, "v", "k").collect()
    assert co.where(df, F.col("v") != "x").count() == 1


def test_meet_laws(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 5)], "k long, s string, n long")
    b = spark.createDataFrame([(2, "z", 5), (3, "w", 1)], "k long, s string, n long")
    rows = lambda df: sorted(map(tuple, df.select("k", "s", "n", F.array_join("conflict", ",")).collect()), key=str)
    assert rows(merge.meet(a, b, ["k"])) == rows(merge.meet(b, a, ["k"])) == [(1, "x", None, ""), (2, None, 5, "s"), (3, "w", 1, "")]
    assert rows(merge.meet(a, a, ["k"])) == [(1, "x", None, ""), (2, "y", 5, "")]
    swap = {"added": "removed", "removed": "added", "changed": "changed"}
    x = {(r["k"], r["path"], swap[r["change"]], r["right"], r["left"]) for r in merge.diff(a, b, ["k"]).collect()}
    assert x == {(r["k"], r["path"], r["change"], r["left"], r["right"]) for r in merge.diff(b, a, ["k"]).collect()}
    assert not merge.diff(a, a, ["k"]).count()


def test_ranked_defaults(spark):
    one_, two, none = F.lit(1), F.lit(2), F.lit(None).cast("int")
    assert one(spark, merge.ranked((2, two), (0, none), (1, one_))) == 1
    assert one(spark, merge.ranked_clash((1, one_), (1, two)))
    assert not one(spark, merge.ranked_clash((0, one_), (1, one_), (1, two)))


def test_graph(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "r", "d"), ("x", "r", "y")], "src string, rel string, dst string")
    assert sorted(r["node"] for r in graph.cycle_nodes(e, "r").collect()) == ["a", "b", "c"]
    assert not graph.acyclic(e) and graph.acyclic(e.where("src = 'x'"))
    got = {(r["node"], r["steps"]) for r in graph.reaches(e, spark.createDataFrame([("a",)], "s string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {(r["node"], r["layer"]) for r in graph.layers(e).collect()} == {("x", 0), ("y", 1)}
    links = spark.createDataFrame([("n1", 5), ("n1", 6), ("n2", 7)], "dst string, v long")
    met = {r["k"]: (r["v"], r["conflict"]) for r in graph.link_flow(links, spark.createDataFrame([("n1", None), ("n2", 7)], "k string, v long"), "dst", "k", "v").collect()}
    assert met["n2"] == (7, []) and met["n1"][1] == ["v"]


def test_hash_ignores_order(spark):
    df = spark.range(50).withColumn("t", F.col("id").cast("string"))
    assert verbs.table_hash(df).first() == verbs.table_hash(df.orderBy(F.desc("id"))).first() != verbs.table_hash(df.limit(49)).first()
    assert Constraint().canon() == "any"


def test_output(spark):
    from concord.functions.output import Output

    assert one(spark, Output(places=1).write(F.lit(0.25))) == 0.2 and one(spark, Output(significant=2).write(F.lit(1250.0))) == 1200.0
    assert one(spark, Output(kind="string").write(F.lit(3.0))) == "3" and one(spark, Output(drop_empty=True).write(F.lit(""))) is None
    with pytest.raises(ValueError):
        Output(places=1, significant=1)


def test_schema_wrappers(spark):
    from concord.plans import schema as sc

    s = sc.prefer(sc.hide(sc.close(Schema.of(a=kind("integer"), b=Field(kind("string"), optional=True))), "a"), b="x")
    df = spark.createDataFrame([(1, None, True)], "a long, b string, c boolean")
    assert [r["path"] for r in vet.findings(df, s, []).collect()] == ["c"]
    assert s.fill(df).first()["b"] == "x" and s.visible(df).columns == ["b", "c"]
    assert not vet.findings(df, sc.open_(s), []).count() and [k for k, _ in sc.copy(s, "b").fields] == ["b"]
    assert sc.infer(df).get("a").constraint == kind("integer") and sc.lift({"k": 1}).admits({"k": 2})
    met = merge.meet(df.drop("c"), df.drop("c"), ["a"]).first()
    assert met["conflict"] == [] and contains(enum(1)).admits([1]) and unique().admits([1]) and rest(max_(1)).admits({}) and not when(min_(0), neq(1)).admits(1)
    assert len_(1).admits("a") and mulof(2).admits(4) and nof(0, pattern("^a")).admits("b")
