import itertools
from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st

from concord.plans import above, below, contains, empty, enum, fmt, kind, len_, max_, min_, mulof, must, neq, nof, pattern, rest, unique, when
from concord.plans.constraint import ANY, NOTHING, const, members
from concord.plans.jsonschema import constraint_in, constraint_out, schema_in, schema_out
from concord.plans.schema import Field, Schema, breaking, subsumes

ATOMS = [min_(0), min_("a"), max_(10), above(1), below(2), neq(1, 2), kind("integer"), kind("number"), kind("string"), const(5), const("m"), mulof(3), pattern("^m"), len_(1), ANY, enum(1, 2, "m")]
VALUES = [0, 1, 1.0, 2, 3, 5, 9, 10, 10.5, Decimal("1.5"), "", "a", "m", "mm", True, None, [], [1], [1, 1], {}, {"k": 1}]


def admitted(c):
    return [i for i, v in enumerate(VALUES) if c.admits(v)]


@pytest.mark.parametrize("a,b", list(itertools.combinations(ATOMS, 2)))
def test_meet_commutes_and_admits_the_intersection(a, b):
    assert (a & b).canon() == (b & a).canon()
    assert admitted(a & b) == [i for i in admitted(a) if i in admitted(b)]


@pytest.mark.parametrize("a", ATOMS)
def test_meet_is_idempotent(a):
    assert (a & a).canon() == a.canon()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(ATOMS), min_size=3, max_size=3))
def test_meet_associates(xs):
    a, b, c = xs
    assert admitted((a & b) & c) == admitted(a & (b & c))


def test_subsumption_never_lies():
    for a, b in itertools.product(ATOMS, ATOMS):
        if a.subsumes(b) is True:
            assert set(admitted(b)) <= set(admitted(a)), (a.canon(), b.canon())


def test_kinds_tell_leaves_apart_and_order_does_not():
    assert not (const(1) & const(1.0)).admits(1)
    assert neq(1).admits(1.0) and not neq(1).admits(1)
    assert min_(1).admits(1.0) and not above(1).admits(Decimal("1"))
    assert mulof(0.1).admits(0.3) and not mulof(0.1).admits(0.35)


def test_empty_meets():
    for c in (min_(5) & max_(3), kind("string") & min_(0), kind("integer") & above(1) & below(2), enum("A") & enum("B"), len_(min_(3)) & len_(max_(2))):
        assert c.is_empty() and c == NOTHING


def test_strings_are_not_empty_unless_said():
    assert not kind("string").admits("") and (kind("string") & empty()).admits("")


def test_late_atoms():
    assert unique().admits([1, 1.0]) and not unique().admits([1, 1])
    assert unique("id").admits([{"id": 1}, {"id": 2}]) and not unique("id").admits([{"id": 1}, {}])
    assert contains(kind("string"), 2).admits(["a", 1, "b"]) and not contains(kind("string")).admits([1])
    assert nof(1, min_(5), max_(3)).admits(9) and not nof(1, min_(5), max_(9)).admits(7)
    assert when(min_(5), mulof(5), mulof(2)).admits(10) and not when(min_(5), mulof(5), mulof(2)).admits(3)
    assert rest(kind("integer"), "a").admits({"a": "x", "b": 1}) and not rest(kind("integer")).admits({"a": "x"})
    assert must(min_(1), "at least one").admits(1) and members(a=min_(1)).admits({"a": 2}) and not members(a=min_(1)).admits({})


@pytest.mark.parametrize("name,good,bad", [("date", "2024-02-28", "2024-13-01"), ("email", "a.b@c.de", "a@"), ("ipv4", "10.0.0.255", "10.0.0.256"), ("uuid", "12345678-1234-1234-1234-123456789abc", "123"), ("hostname", "a-b.c", "-a")])
def test_formats(name, good, bad):
    assert fmt(name).admits(good) and not fmt(name).admits(bad)


def test_schema_meet_defaults_and_closing():
    a = Schema.of(n=Field(kind("integer") & min_(0), optional=True, defaults=((1, 5),)), closed=True)
    b = Schema.of(n=Field(max_(10), optional=False, defaults=((0, 50),)))
    m = a & b
    f = m.get("n")
    assert not f.optional and f.default() == (5,)  # 50 is not admitted, so the next rank decides
    with pytest.raises(ValueError, match="closed"):
        a & Schema.of(other=kind("string"))
    with pytest.raises(ValueError, match="disagree"):
        Field(kind("integer"), defaults=((0, 1), (0, 2))).default()


def test_evolution():
    old, new = Schema.of(a=kind("integer") & min_(0)), Schema.of(a=kind("integer"), b=Field(kind("string"), optional=True))
    assert subsumes(old, old) == "subsumes"
    assert breaking(old, Schema.of(a=kind("integer")))[""] == "compatible"
    assert breaking(old, new, "forward")["a"] == "widened" and breaking(new, old, "backward")[""] == "breaking"
    assert breaking(old, Schema.of(a=kind("integer") & min_(1)))["a"] == "narrowed"


@pytest.mark.parametrize("c", [kind("integer") & min_(1) & max_(5), kind("string") & len_(min_(2) & max_(4)), enum("a", 1), kind("list") & unique(), kind("number") & mulof(3), kind("string") & pattern("^a+$"), kind("integer") & neq(3), nof(1, min_(3), max_(5))])
def test_json_schema_round_trip(c):
    back = constraint_in(constraint_out(c))
    for v in [*VALUES, "ab", "aaaaa", 4]:
        if c.kinds is None or not isinstance(v, Decimal):
            assert back.admits(v) == c.admits(v) or v == "", (v, constraint_out(c))


def test_json_schema_of_records():
    s = Schema.of(a=kind("integer"), b=Field(kind("string"), optional=True), closed=True)
    out = schema_out(s)
    assert out["required"] == ["a"] and out["additionalProperties"] is False
    assert schema_out(schema_in(out))["required"] == ["a"]
    with pytest.raises(ValueError, match="keywords"):
        constraint_in({"$dynamicRef": "#x"})


def test_arms_say_themselves_whether_they_take_the_empty_text(spark):
    from pyspark.sql import functions as F

    from concord.plans.jsonschema import constraint_in

    c = constraint_in({"minItems": 1})
    df = spark.createDataFrame([("",), ("a",)], "x string")
    assert c.admits("") and not c.admits([]) and [r[0] for r in df.select(c.test(F.col("x"), df.schema["x"].dataType)).collect()] == [True, True]
