import json

import pytest
from pyspark.sql import functions as F

from concord import queries
from concord.functions import components as cmp, grammar

SPAN = 'span = hour ":" hour\nhour = 1*2digits\ndigits = %x30-39\n'


def test_tree():
    t = grammar.Grammar(SPAN).parse("7:30")
    assert (t["rule"], t["src"]) == ("span", "7:30") and [k["src"] for k in t["kids"]] == ["7", "30"] and t["kids"][0]["kids"][0] == {"rule": "digits", "src": "7", "kids": []}


@pytest.mark.parametrize("text", ["", "1:", "1 : 2", "x", "1:2:3", "123:4"])
def test_refused(text):
    with pytest.raises(grammar.GrammarError, match="parse_failed"):
        grammar.Grammar(SPAN).parse(text)


@pytest.mark.parametrize("source,text", [("v = 1*d\nd = %x30-39\n", "7" * 100_000), ("v = *(1*d)\nd = %x30-39\n", "7" * 20_000), ("v = *d *d *d\nd = %x30-39\n", "7" * 2_000), ('v = *( d / d d )\nd = %x30-39\n', "7" * 2_000)])
def test_long_texts_have_an_answer(source, text):
    g = grammar.Grammar(source)
    assert g.admits(text) and not g.admits(text + "x") and g.parse(text)["src"] == text


def test_deep_texts_and_rules_that_call_themselves():
    g = grammar.Grammar('e = "(" e ")" / "x"\n')
    assert g.admits("(" * 30_000 + "x" + ")" * 30_000) and not g.admits("(" * 30_000 + "x" + ")" * 29_999)
    deep = g.parse("(" * 2_000 + "x" + ")" * 2_000)
    assert grammar.tree_json(deep).count('"rule"') == 2_001
    assert grammar.Grammar('a = a "x" / "y"\n').admits("y")


def test_grammars_read_what_a_plain_reader_reads():
    """Against all texts that a small grammar makes, made one by one."""
    rng = __import__("random").Random(1)

    def make(node, rules, depth):
        kind = node[0]
        if kind == "text":
            return {node[1]}
        if kind == "rule":
            return make(rules[node[1]], rules, depth - 1) if depth else set()
        if kind == "or":
            return set().union(*(make(x, rules, depth) for x in node[1]))
        if kind == "seq":
            out = {""}
            for x in node[1]:
                out = {a + b for a in out for b in make(x, rules, depth) if len(a + b) <= 5}
            return out
        _, item, low, high = node
        one, out, now = make(item, rules, depth), set(), {""}
        for n in range(7 if high is None else high + 1):
            out |= now if n >= low else set()
            now = {a + b for a in now for b in one if len(a + b) <= 5}
        return out

    def some(depth):
        kind = rng.choice(["str", "str", "or", "seq", "rep", "opt", "rule"]) if depth else "str"
        if kind == "str":
            return '%s"' + rng.choice(["a", "b", "ab", "ba"]) + '"'
        if kind == "rule":
            return "r1"
        if kind in ("or", "seq"):
            return "(" + (" / " if kind == "or" else " ").join(some(depth - 1) for _ in range(rng.randrange(1, 4))) + ")"
        return rng.choice(["*", "1*", "2*3", "*2"]) + some(depth - 1) if kind == "rep" and depth > 1 else "[" + some(depth - 1) + "]"

    texts = [""]
    for _ in range(5):
        texts = texts + [t + c for t in texts if len(t) == len(texts[-1]) for c in "ab"]
    for _ in range(150):
        source = f"r0 = {some(3)}\nr1 = {some(1).replace('r1', chr(34) + 'b' + chr(34))}\n"
        try:
            g = grammar.Grammar(source)
        except grammar.GrammarError:
            continue
        want = make(g.rules["r0"], g.rules, 6) - {""}
        assert {t for t in texts if t and g.admits(t)} == {t for t in want if len(t) <= 5}, source


def test_alternatives_repeats_and_case():
    g = grammar.Grammar('list = item *( "," item ) [ ";" ]\nitem = "ab" / %s"Cd" / 2*3DIGIT ; a comment\n')
    assert all(map(g.admits, ("ab", "AB,Cd", "12,345;"))) and not any(map(g.admits, ("cd", "1", "1234", "ab,")))


@pytest.mark.parametrize("source", ["", "v = ", "v = missing", "v = (a", "v = %d1A", "v = a\nv = b"])
def test_bad_grammars(source):
    with pytest.raises(grammar.GrammarError):
        grammar.abnf(source)


def test_columns(spark):
    df = spark.createDataFrame([("1:2",), (None,), ("12:34",)], "x string")
    got = [r["j"] and json.loads(r["j"])["src"] for r in df.select(F.to_json(grammar.parse(SPAN, F.col("x"))).alias("j")).collect()]
    assert got == ["1:2", None, "12:34"]
    assert [r[0] for r in df.select(grammar.parses(SPAN, F.concat("x", F.lit("!")))).collect()] == [False, False, False]


def test_components():
    tree = cmp.project(".", [cmp.folder("src", [cmp.file("a.js", ["x", ["y", cmp.content("z")]])])])
    assert tree["children"][0]["children"][0]["children"][0] == {"cmp": "Line", "props": {"src": "x"}, "children": []}
    assert cmp.rows(tree) == [("./src/a.js", 0, "x\n"), ("./src/a.js", 1, "y\n"), ("./src/a.js", 2, "z")]
    for bad in (lambda: cmp.folder("a", ["text"]), lambda: cmp.file({"nope": 1}), lambda: cmp.node("Line", "x", ["y"]), lambda: cmp.folder("a", [cmp.line("x")])):
        with pytest.raises(ValueError):
            bad()


def test_characters_of_wide_and_empty_ranges_and_trees_as_json():
    g = grammar.Grammar("t = *( wide / odd / DIGIT )\nwide = %x3A-10FFFF\nodd = %x20-22 / back\nback = %x0-1F\nnone = %x110000-110001\n")
    text = "a\"7 \\\n\x01 é😀"
    tree = g.parse(text)
    assert [(k["rule"], k["src"]) for k in tree["kids"]] == [("odd" if x in '" \n\x01' else "wide", x) for x in text if x != "7"] and json.loads(grammar.tree_json(tree)) == tree
    assert not g.admits("#") and not grammar.Grammar("t = none\nnone = %x110000-110001\n").admits("x") and not grammar.Grammar("t = %x39-30\n").admits("5")


def test_few_large_files_are_parsed_by_many_tasks(spark, tmp_path):
    rows = [(i, f"Customer#{i:09d}") for i in range(1, 201)]
    spark.createDataFrame(rows, "c_custkey long, c_name string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = queries.QUERIES["parse_grammar"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["c_custkey"], r["digits"], r["five"]) for r in got) == [(i, x[9:], x.endswith("5")) for i, x in rows]
    assert len({r["task"] for r in got}) > 4
