"""Lists, graphs, reports, views, formats and schemas on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from concord import queries
from concord.functions import arith, components as cmp, text
from concord.operators import collections as co, graph, merge, verbs, vet
from concord.plans import ANY, Schema, enum, fmt, kind, max_, min_
from concord.plans.formats import NAMES, PATTERNS
from concord.plans.jsonschema import constraint_in, schema_in, schema_out, upgrade
from concord.plans import schema as sch
from concord.plans.schema import Field, Link, outcome, subsumes, subsumes_in
from concord.sources import readers


def edges(spark, pairs):
    return spark.createDataFrame([(a, "r", b) for a, b in pairs], "src string, rel string, dst string")


def test_nodes_between_cycles_are_on_none(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "m"), ("m", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("x", "a"), ("s", "s")])
    assert {r["node"] for r in graph.cycle_nodes(e).collect()} == {"a", "b", "c", "d", "s"}
    assert {(r["node"], ">".join(r["path"])) for r in graph.cycles(e).collect()} == {("b", "b>a>b"), ("d", "d>c>d"), ("s", "s>s")}
    assert not graph.acyclic(e) and graph.acyclic(edges(spark, [("a", "b"), ("b", "c")])) and graph.cycle_nodes(edges(spark, [])).count() == 0


def test_components_are_those_of_a_plain_search(spark):
    rng = random.Random(1)
    for n in (6, 9):
        pairs = {(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(n + 3)}
        reach = {a: {b for x, b in pairs if x == a} for a in map(str, range(n))}
        for _ in range(n):
            reach = {a: bs | {c for b in bs for c in reach[b]} for a, bs in reach.items()}
        want = {a: max(b for b in reach if a in reach[b] and b in reach[a]) for a in reach if a in reach[a]}
        assert {r["node"]: r["component"] for r in graph.components(edges(spark, sorted(pairs))).collect()} == want


def test_flow_goes_to_the_end_and_around(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("d", "c"), ("e", "f")])
    values = spark.createDataFrame([("a", "1"), ("b", None), ("c", None), ("d", "1"), ("e", "1"), ("f", "2")], "node string, v string")
    got = {r["node"]: (r["v"], list(r["conflict"])) for r in graph.flow(e, values, "node", "v").collect()}
    assert got == {"a": ("1", []), "b": ("1", []), "c": ("1", []), "d": ("1", []), "e": ("1", []), "f": (None, ["v"])}


def test_multiples_are_read_by_their_digits(spark):
    rows = [0.02, 0.0200000000000001, 0.06, 1e30, 3e30, 1e300, float("nan"), float("inf"), None, -0.04, 7.0, 9.0, 2.0**60, 0.0]
    df = spark.createDataFrame([(x,) for x in rows], "x double")
    got = [tuple(r) for r in df.select(arith.is_multiple(F.col("x"), 0.02), arith.is_multiple(F.col("x"), 3)).collect()]
    assert [a for a, _ in got][:3] == [True, False, True] and [a for a, _ in got][6:10] == [False, False, False, True]
    assert [b for _, b in got][3:6] == [False, True, False] and [b for _, b in got][10:] == [False, True, False, True]
    exact = spark.createDataFrame([("12.30",), ("0.00",)], "x string").select(F.col("x").cast("decimal(20,2)").alias("x"))
    assert [r[0] for r in exact.select(arith.is_multiple(F.col("x"), "0.3")).collect()] == [True, True]


def test_plus_of_kinds(spark):
    df = spark.createDataFrame([(1, "a", True, [1], None)], "i long, s string, b boolean, l array<int>, n string")
    row = df.select(arith.plus(F.col("i"), F.col("s"), "integer", "string"), arith.plus(F.col("b"), F.lit(False), "boolean", "boolean"), arith.plus(F.col("l"), F.col("l"), "list", "list"), arith.plus(F.col("s"), F.col("n"), "string", "string"), arith.negative(F.col("i"))).first()
    assert tuple(row) == ("1a", True, [1, 1], None, -1)
    for bad in (("boolean", "integer"), ("list", "string"), ("map", "map"), ("float", "bigdecimal")):
        with pytest.raises(TypeError):
            arith.plus(F.col("i"), F.col("i"), *bad)


def test_json_escapes_are_json(spark):
    raw = "".join(map(chr, range(32))) + 'q"\\/é\u2028'
    df = spark.createDataFrame([(raw,), ("plain",), (None,)], "x string")
    got = [r[0] for r in df.select(text.esc(F.col("x"), "json")).collect()]
    assert json.loads(f'"{got[0]}"') == raw and got[1:] == ["plain", None]
    assert df.select(text.usc(text.esc(F.col("x"), "json"), "json")).first()[0] == raw


FORMS = {
    "date": (["2024-02-29", "2000-02-29", "1999-12-31"], ["2024-02-31", "1900-02-29", "2023-02-29", "2024-13-01", "24-01-01"]),
    "time": (["12:00:00Z", "23:59:60Z", "00:29:60+00:30", "01:02:03.5+05:30"], ["24:00:00Z", "12:00:60Z", "12:00:00"]),
    "date-time": (["1998-12-31T23:59:60Z", "2024-02-29t01:02:03z"], ["2023-02-29T00:00:00Z", "2024-01-01"]),
    "duration": (["P4DT12H30M5S", "P2W", "PT1M", "P1Y2M"], ["P", "PT", "P1D2H", "P2W1D", "P1YT", "4D"]),
    "email": (["a.b@c.example", '"a b"@c', "a@[127.0.0.1]"], ["a..b@c", ".a@c", "a@", "a b@c"]),
    "idn-email": (["실례@실례.테스트"], ["2962"]),
    "hostname": (["a.example", "x" * 63], ["-a.example", "a_b", "x" * 64, ".".join(["x" * 60] * 5)]),
    "idn-hostname": (["실례.테스트", "a.example"], ["〮x y", "-a"]),
    "ipv4": (["255.0.9.10"], ["256.0.0.1", "1.2.3", "01.2.3.4"]),
    "ipv6": (["::", "::1", "1::8", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "a::b:c:1.2.3.4"], ["1:2:3:4:5:6:7:8:9", "1:::2", "::12345", "1:2:3:4:5:6:7", "::1.2.3", "1:2:3:4:5:6:7:8::"]),
    "uri": (["http://a.example/b?c=d#e", "urn:x:y", "http://[::1]:80/", "mailto:a@b"], ["//a/b", "a b", "http:// x", "http://[::1", "%41:x"]),
    "uri-reference": (["", "/a", "//a/b", "#x", "a?b"], ["a b", "\\\\x", "1:x y"]),
    "iri": (["http://ƒøø.example/?∂=ø"], ["/ƒ", "http://a b"]),
    "iri-reference": (["âππ", "#ƒ"], ["#ƒr\\gm"]),
    "uuid": (["2EB8AA08-AA98-11EA-B4AA-73B441D16380"], ["2eb8aa08aa9811eab4aa73b441d16380"]),
    "uri-template": (["http://a/{x}/{+y,z:3*}".replace(":3*", ":3"), "x{?q*}"], ["{", "{x", "a}", "{x y}"]),
    "json-pointer": (["", "/a~1b/0", "/"], ["a", "/~2"]),
    "relative-json-pointer": (["0", "1/a", "2#"], ["01", "-1", "/a", "1a"]),
    "regex": (["^a+[b-c]\\d$", ""], ["^(a", "a{2,1}", "*"]),
}


def test_formats(spark):
    assert set(FORMS) == set(NAMES) == set(PATTERNS)
    for name, (good, bad) in FORMS.items():
        c = fmt(name)
        df = spark.createDataFrame([(x,) for x in [*good, *bad]], "x string")
        got = [r[0] for r in df.select(c.test(F.col("x"), df.schema["x"].dataType)).collect()]
        assert got == [True] * len(good) + [False] * len(bad), (name, list(zip([*good, *bad], got)))
        assert [c.admits(x) for x in [*good, *bad]] == got, name


def test_lists_met_by_position(spark):
    df = spark.createDataFrame([([1, None, 3], [None, 2, 4]), ([1], [1, 2]), ([], []), (None, [1])], "a array<int>, b array<int>")
    got = [(r["m"]["list"], r["m"]["conflict"]) for r in df.select(merge.meet_lists(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [([1, 2, None], [2]), ([1, 2], [1]), ([], []), ([1], [])]


def test_elements_rows_and_index_of_all_rows(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "x array<int>")
    assert [tuple(r) for r in df.select(co.at(F.col("x"), 0), co.at(F.col("x"), -1), co.at(F.col("x"), 5), co.at(F.col("x"), -4)).collect()] == [(1, 3, None, None), (None,) * 4, (None,) * 4]
    rows = spark.createDataFrame([(i, i * 7 % 100) for i in range(100)], "pos int, k int").repartition(7)
    assert [co.row_at(rows, i).first()["pos"] for i in (0, 3, -1)] == [0, 3, 99] and co.row_at(rows, 100).count() == 0
    told = co.key_index(rows, ["k", "pos"]).collect()
    assert {(r["k"], int(r["key"])) for r in told} == {(k, k) for k in range(100)} and co.key_index(rows.limit(0), ["k"]).count() == 0
    desc = co.key_index(rows, [F.desc("k")]).where("key = '0'").first()
    assert desc["k"] == 99


def test_nested_emission(spark):
    rows = [("a", None, 1, "A"), ("b", "a", 2, "B"), ("c", "a", 1, "C"), ("d", "c", 1, "D<"), ("x", "none", 1, "X"), ("e", None, 2, "E")]
    df = spark.createDataFrame(rows, "key string, parent string, i int, name string")
    body = [F.concat(F.lit("<"), "name"), F.lit("children"), F.lit("end")]
    got = co.emit_tree(df, "key", "parent", (F.col("name") == "B", [F.col("name")]), (F.lit(True), body), order=["i"], indent="-", replace=[("D", "d")], variant="xml").orderBy("root", "pos").collect()
    assert [(r["root"], r["depth"], r["line"]) for r in got] == [
        ("a", 0, "&lt;A"), ("a", 1, "-&lt;C"), ("a", 2, "--&lt;d&lt;"), ("a", 2, "--end"), ("a", 1, "-end"), ("a", 1, "-B"), ("a", 0, "end"), ("e", 0, "&lt;E"), ("e", 0, "end"),
    ]


def test_report(spark):
    df = spark.createDataFrame([(i, float(i), None if i % 2 else "x") for i in range(10)], "id int, v double, old string")
    s = Schema.of(v=kind("float") & max_(5.0), old=Field(kind("string"), optional=True, deprecated="use new"), need=Field(enum("a"), defaults=((1, "a"),)))
    got = vet.report(df, s, ["id"], max_errors=2).collect()
    assert sorted((r["pointer"], r["severity"], r["more"]) for r in got) == [("/0/old", "warning", 3), ("/2/old", "warning", 3), ("/6/v", "error", 2), ("/7/v", "error", 2)]
    assert vet.report(df, s, ["id"], at=["v"]).count() == 4 and {r["path"] for r in vet.report(df, s, ["id"], fill=False).collect()} == {"v", "old", "need"}


def test_outcome_and_profiles(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 1.0, 5.0, None)], "x double")
    old, new = Schema.of(x=Field(kind("float") & min_(0.0), optional=True), unique=(("x",),)), Schema.of(x=kind("float") & max_(4.0))
    r = outcome(df, old, new).first()
    assert (r["rows"], r["old"], r["new"], r["lost"], r["gained"], r["verdict"]) == (4, 3, 2, 2, 1, "breaking")
    wide = Schema.of(x=kind("float"), unique=(("x",),))
    tight = Schema.of(x=kind("float") & min_(0.0))
    assert subsumes(wide, tight) == "does_not_subsume" and subsumes_in("values", wide, tight) == "subsumes"
    assert subsumes_in("values", tight, wide) == "does_not_subsume" and subsumes_in("shape", tight, wide) == "subsumes"


def test_views(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "b")], "u int, t int, s string")
    assert {tuple(r) for r in verbs.states(df, ["u"], ["t"], "s").collect()} == {(None, "a", 1), (None, "b", 1), ("a", "b", 1), ("b", "a", 1)}
    assert tuple(verbs.loss(df.where("u = 1"), df, "u").first()) == (1, 1)
    assert [tuple(r) for r in verbs.ladder(df, "t", [2]).orderBy("rung").collect()] == [(0, None, 2), (1, 2, 2)]


def test_variant_views(spark):
    df = spark.createDataFrame([(1, '{"b": 1, "a": {"c": "x", "d": [1]}, "e": null}')], "id int, j string").select("id", F.parse_json("j").alias("v"))
    assert df.select(co.member_keys(F.col("v"))).first()[0] == ["a", "b", "e"]
    assert df.select(co.member_types(F.col("v"))).first()[0] == {"a": "map", "b": "integer", "e": "null"}
    assert {(r["path"], r["text"]) for r in co.leaves(df, "v", ["id"], 2).collect()} == {("$.b", "1"), ("$.a.c", '"x"'), ("$.a.d", "[1]"), ("$.e", "null")}


def test_references_and_earlier_drafts():
    x = {"definitions": {"n": {"type": "integer", "minimum": 1, "exclusiveMinimum": True}}, "properties": {"a": {"$ref": "#/definitions/n"}, "b": {"type": "string"}}, "required": ["a"], "dependencies": {"b": ["c"]}}
    assert upgrade(x)["$defs"]["n"] == {"type": "integer", "exclusiveMinimum": 1} and upgrade(x)["dependentRequired"] == {"b": ["c"]}
    s = schema_in(x)
    assert s.get("a").constraint.admits(2) and not s.get("a").constraint.admits(1)
    c = constraint_in(upgrade({"type": "object", "dependencies": {"b": ["c"], "d": {"required": ["e"]}}}))
    assert [c.admits(v) for v in ({}, {"b": 1}, {"b": 1, "c": 2}, {"d": 1}, {"d": 1, "e": 1})] == [True, False, True, False, True]
    with pytest.raises(ValueError, match="circle"):
        constraint_in({"$defs": {"a": {"anyOf": [{"$ref": "#/$defs/a"}, {"type": "null"}]}}, "$ref": "#/$defs/a"})
    with pytest.raises(ValueError, match="nowhere"):
        constraint_in({"$ref": "#/$defs/none"})
    assert schema_out(schema_in({"properties": {"a": {"type": "integer"}}}))["properties"]["a"] == {"type": "integer"} or ANY


def test_components_props():
    assert cmp.copyfiles({"from": "a", "replace": {"x": "y"}})["props"]["replace"] == {"x": "y"}
    with pytest.raises(ValueError):
        cmp.listitems({"item": "i"}, [cmp.slot("s")])


def test_moved_typed_and_annotated_fields(spark):
    s = Schema.of(a=Field(kind("integer"), deprecated="use b", meta=(("unit", "m"),), ident=True), t=kind("string"))
    df = spark.createDataFrame([(1, "x")], "a int, t string")
    told = sch.riders(sch.annotate(df, s))
    assert told == {"a": {"deprecated": "use b", "meta": {"unit": "m"}, "ident": True}}
    moved = sch.move(s, "a", "b")
    assert [p for p, _, _ in moved.rules(df.withColumnRenamed("a", "b"))] == ["a", "b", "t"] and vet.counts(df, moved).where("n > 0").count() == 2
    assert sch.types(s, "t").visible(df).columns == ["a"] and vet.counts(df.drop("t"), sch.types(s, "t")).where("n > 0").count() == 0
    with pytest.raises(ValueError, match="meta"):
        s & Schema.of(a=Field(meta=(("unit", "cm"),)))
    with pytest.raises(ValueError, match="move"):
        sch.move(s, "a", "t")
    links = Schema.of(links=(Link("o", "orders", "id"),))
    assert sch.declarations(links, ("next",), {"o": "of"}) == {"next": {"target": None, "acyclic": True, "inverse": None}, "o": {"target": "orders.id", "acyclic": False, "inverse": "of"}}


def test_paths_meet(spark):
    df = spark.createDataFrame([("a.b", "a.b.c"), ("a.b.c", "a"), ("a.b", "a.bc"), (None, "a"), ("", "a"), ("a", "a")], "x string, y string")
    assert [r[0] for r in df.select(verbs.path_meet(F.col("x"), F.col("y"))).collect()] == ["a.b.c", "a.b.c", None, "a", "a", "a"]
    assert df.select(verbs.path_of(F.lit("p"), F.col("x"))).collect()[3][0] is None


def test_documents_in_memory_and_by_root(spark, tmp_path):
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "conf.toml").write_text("port = 1\n")
    one = lambda df: df.select(F.to_json("value")).first()[0]
    roots = [f"{tmp_path}/one", f"{tmp_path}/two"]
    assert one(readers.resolve(spark, "conf.toml", roots)) == '{"port":1}'
    assert one(readers.resolve(spark, "conf.toml", roots, {"conf.toml": "port = 2"})) == '{"port":2}'
    with pytest.raises(ValueError, match="include_missing"):
        readers.resolve(spark, "none.json", roots)
    with pytest.raises(ValueError, match="include_extension"):
        readers.read_memory(spark, {"a.csv": ""})
    text_ = readers.with_vars('{"a": $a, "b": "$$x", "c": $b}', {"a": 'q"', "b": None})
    assert json.loads(text_) == {"a": 'q"', "b": "$x", "c": None} and one(readers.read_memory(spark, {"x.json": text_})) == '{"a":"q\\"","b":"$x","c":null}'
    with pytest.raises(ValueError, match="var_missing"):
        readers.with_vars("$z", {})


def test_emission_into_lists(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [])], "id int, x array<int>")
    got = co.emit_children(df, F.col("x"), (lambda x: x == 2, lambda x: [F.lit("two"), F.lit("2")]), (lambda x: F.lit(True), lambda x: [x]), order=["id"]).collect()
    assert [tuple(r) for r in got] == [(1, 0, "1"), (1, 1, "two"), (1, 2, "2"), (1, 3, "3")]


def test_members_of_one_key_are_emitted_abreast(spark, tmp_path):
    df = spark.createDataFrame([(1, [(2, "a"), (1, "b"), (1, "c")]), (2, []), (3, None)], "id int, x array<struct<k:int,v:string>>")
    rule = (lambda x: F.lit(True), lambda x: [x["v"], F.upper(x["v"])])
    assert [r["line"] for r in co.emit_children(df, F.col("x"), rule).collect()] == ["a", "A", "b", "B", "c", "C"]
    assert [tuple(r) for r in co.emit_children(df, F.col("x"), rule, key=lambda x: x["k"]).collect()] == [(i, x) for i, x in enumerate(["b", "c", "B", "C", "a", "A"])]

    import duckdb

    rows = [(1, 1, 7, "R"), (1, 1, 7, "R"), (1, 1, 7, "A"), (1, 1, 8, None), (1, None, 9, "R"), (1, 2, None, "N"), (None, 1, 7, "R"), (2, 1, 1, "N")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    got = [tuple(r) for r in queries.QUERIES["emit_children"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(con.execute(queries.ORACLE["emit_children"]).fetchall(), key=str) and len(got) == 12


def test_capped_brings_no_whole_group_to_one_task(spark):
    rows = [(g, i * 37 % 1500) for g in ("a", "b", None) for i in range(1500)] + [("c", 1)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(5)
    for most in (0, 1, 3, 1200):
        for by in (["g"], []):
            groups = [[r for r in rows if r[0] == g] for g in ("a", "b", "c", None)] if by else [rows]
            want = [(*r, max(len(x) - most, 0)) for x in groups for r in sorted(x, key=lambda r: (r[1], r[0] or ""))[:most]]
            assert sorted(map(tuple, co.capped(df, most, ["i", "g"], by).collect()), key=str) == sorted(want, key=str), (most, by)
    # A count over a window holds its whole group; a rank alone is cut before rows are dealt.
    plan = co.capped(df, 3, ["i"], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "count(1) windowspec" not in plan
