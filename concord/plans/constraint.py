"""The constraint algebra: atoms, their meet, emptiness, subsumption, admission, and the Column that tests a value.

A constraint is kept in a normal form: allowed kinds, an interval, excluded values, accumulated patterns and multiples,
a constraint on the size, and lists of late checks. The meet intersects intervals, unites exclusions, accumulates the
rest. A disjunction is a tuple of arms. Kinds are leaf-aware (1 is not 1.0), order is not.

Late checks (sizes, uniqueness, counts, conditions) speak about a whole value, so a plan must run them after merges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from ..functions import arith
from ..functions.text import is_pattern, patterns_are_valid, portable
from . import formats

NUMBERS = frozenset(("integer", "float", "biginteger", "bigdecimal"))
KINDS = NUMBERS | {"string", "boolean", "null", "map", "list"}
def kind_of(v: Any) -> str:
    if v is None:
        return "null"
    for t, name in ((bool, "boolean"), (str, "string"), (int, "integer"), (float, "float"), (dict, "map"), (list, "list"), (tuple, "list")):
        if isinstance(v, t):
            return name
    if isinstance(v, Decimal):
        return "biginteger" if v == v.to_integral_value() and v.as_tuple().exponent >= 0 else "bigdecimal"
    raise TypeError(f"no kind for {type(v).__name__}")


def _exact(v: Any) -> Any:
    """A number for comparison: floats as they print."""
    return Decimal(repr(v)) if isinstance(v, float) else Decimal(v) if isinstance(v, int) and not isinstance(v, bool) else v


def _comparable(a: Any, b: Any) -> bool:
    return (kind_of(a) in NUMBERS) == (kind_of(b) in NUMBERS) and (kind_of(a) == "string") == (kind_of(b) == "string")


def _lt(a: Any, b: Any) -> bool:
    return _exact(a) < _exact(b)


def _typed(v: Any) -> tuple[str, str]:
    return kind_of(v), json.dumps(v, sort_keys=True, default=str)


def same(a: Any, b: Any) -> bool:
    """Equality that tells the numeric leaves apart."""
    return _typed(a) == _typed(b)


class Empty(ValueError):
    """A meet that admits nothing."""


@dataclass(frozen=True)
class Constraint:
    kinds: frozenset[str] | None = None  # None: any
    lo: tuple[Any, bool] | None = None  # bound, whether it is admitted itself
    hi: tuple[Any, bool] | None = None
    excluded: tuple[Any, ...] = ()
    patterns: tuple[str, ...] = ()
    formats: tuple[str, ...] = ()
    multiples: tuple[Any, ...] = ()
    size: Constraint | None = None
    may_be_empty: bool = False
    unique: frozenset[str] | None = None  # "" is the member itself
    contains: tuple[tuple[Constraint, Constraint], ...] = ()
    musts: tuple[tuple[Constraint, str], ...] = ()
    nofs: tuple[tuple[Constraint, tuple[Constraint, ...]], ...] = ()
    whens: tuple[tuple[Constraint, Constraint, Constraint | None], ...] = ()
    rests: tuple[tuple[Constraint, tuple[str, ...]], ...] = ()
    keys: tuple[tuple[str, Constraint], ...] = ()  # members of a map
    arms: tuple[Constraint, ...] = ()
    value: tuple[Any, ...] = ()  # one concrete value
    impossible: bool = False

    # ---- meet and join

    def __and__(self, other: Constraint) -> Constraint:
        if self.impossible or other.impossible:
            return NOTHING
        if other.arms and not self.arms:
            return other & self
        if self.arms:
            rest_ = replace(self, arms=())
            own = [rest_ & a & b for a in self.arms for b in (other.arms or (replace(other, arms=()),))] if other.arms else [a & rest_ & other for a in self.arms]
            live = _distinct(a for a in own if not a.is_empty())
            return live[0] if len(live) == 1 else Constraint(arms=tuple(live)) if live else NOTHING
        bounds = [b[0] for b in (self.lo, self.hi, other.lo, other.hi) if b]
        if any(not _comparable(bounds[0], b) for b in bounds[1:]):
            return NOTHING
        kinds = self.kinds if other.kinds is None else other.kinds if self.kinds is None else self.kinds & other.kinds
        if self.value and other.value and not same(self.value[0], other.value[0]):
            return NOTHING
        out = Constraint(
            kinds=kinds,
            lo=_tighter(self.lo, other.lo, True),
            hi=_tighter(self.hi, other.hi, False),
            excluded=tuple(sorted(_unique([*self.excluded, *other.excluded]), key=_typed)),
            patterns=_merge(self.patterns, other.patterns),
            formats=_merge(self.formats, other.formats),
            multiples=_merge(self.multiples, other.multiples),
            size=self.size if other.size is None else other.size if self.size is None else self.size & other.size,
            may_be_empty=self.may_be_empty or other.may_be_empty,
            unique=self.unique if other.unique is None else other.unique if self.unique is None else self.unique | other.unique,
            contains=_merge(self.contains, other.contains),
            musts=_merge(self.musts, other.musts, order=False),
            nofs=(*self.nofs, *(n for n in other.nofs if n not in self.nofs)),
            whens=_merge(self.whens, other.whens),
            rests=_merge(self.rests, other.rests),
            keys=_merge_keys(self.keys, other.keys),
            value=self.value or other.value,
        )
        return NOTHING if out.is_empty() else out

    def __or__(self, other: Constraint) -> Constraint:
        arms = _distinct([*(self.arms or (self,)), *(other.arms or (other,))])
        arms = [a for a in arms if not a.is_empty()]
        return arms[0] if len(arms) == 1 else Constraint(arms=tuple(arms)) if arms else NOTHING

    def is_empty(self) -> bool:
        """Whether the constraint is known to admit nothing; bounds, kinds, values and sizes decide."""
        if self.impossible or self.kinds is not None and not self.kinds:
            return True
        if self.arms:
            return all(a.is_empty() for a in self.arms)
        if self.size is not None and (self.size & kind("integer") & min_(0)).impossible:
            return True
        bound = self.lo or self.hi
        if bound and self.kinds is not None:
            fits = NUMBERS if kind_of(bound[0]) in NUMBERS else frozenset(("string",))
            if not self.kinds & fits:
                return True
        if self.lo and self.hi:
            if not _comparable(self.lo[0], self.hi[0]) or _lt(self.hi[0], self.lo[0]):
                return True
            if _exact(self.lo[0]) == _exact(self.hi[0]) and not (self.lo[1] and self.hi[1]):
                return True
            if self.kinds == frozenset(("integer",)) and kind_of(self.lo[0]) in NUMBERS:
                lo, hi = _exact(self.lo[0]), _exact(self.hi[0])
                first = lo.to_integral_value(rounding="ROUND_FLOOR") + 1 if not self.lo[1] or lo != lo.to_integral_value() else lo
                if first > hi or first == hi and not self.hi[1]:
                    return True
        return bool(self.value) and not self.admits(self.value[0])

    # ---- admission on the driver

    def admits(self, v: Any) -> bool:
        if self.impossible:
            return False
        if self.arms:
            # Each arm says itself whether it takes the empty text.
            return any(a.admits(v) for a in self.arms) and replace(self, arms=(), may_be_empty=True).admits(v)
        k = kind_of(v)
        if self.value and not same(v, self.value[0]):
            return False
        if self.kinds is not None and k not in self.kinds:
            return False
        if k == "string" and v == "" and not self.may_be_empty and not self.value:
            return False
        for bound, low in ((self.lo, True), (self.hi, False)):
            if bound:
                if not _comparable(v, bound[0]) or k not in NUMBERS | {"string"}:
                    return False
                if _lt(v, bound[0]) if low else _lt(bound[0], v):
                    return False
                if _exact(v) == _exact(bound[0]) and not bound[1]:
                    return False
        if any(same(v, x) for x in self.excluded):
            return False
        for p in (*self.patterns, *(p for f in self.formats for p in formats.PATTERNS[f])):
            if k != "string" or not re.search(p.replace(r"\z", r"\Z"), v, re.ASCII):
                return False
        for f in self.formats:
            if k != "string" or len(v) > formats.LONGEST.get(f, len(v)) or f == "regex" and not is_pattern(v):
                return False
        for m in self.multiples:
            if k not in NUMBERS or _exact(v) % _exact(m) != 0:
                return False
        if self.size is not None and (k not in ("string", "list", "map") or not self.size.admits(len(v))):
            return False
        members = list(v.values()) if k == "map" else list(v) if k == "list" else None
        if self.unique is not None:
            if members is None:
                return False
            for key in self.unique:
                if key and not all(isinstance(m, dict) and key in m for m in members):
                    return False
                seen = [_typed(m[key] if key else m) for m in members]
                if len(set(seen)) < len(seen):
                    return False
        for c, n in self.contains:
            if members is None or not n.admits(sum(c.admits(m) for m in members)):
                return False
        for t, covers in self.rests:
            if k != "map" or not all(t.admits(x) for key, x in v.items() if key not in covers):
                return False
        for key, c in self.keys:
            if k != "map" or key not in v or not c.admits(v[key]):
                return False
        return (
            all(c.admits(v) for c, _ in self.musts)
            and all(n.admits(sum(c.admits(v) for c in cs)) for n, cs in self.nofs)
            and all((t if c.admits(v) else e or ANY).admits(v) for c, t, e in self.whens)
        )

    # ---- the test as a Column

    def test(self, c: Column, of: T.DataType) -> Column:
        """Whether a column's value is admitted; never null. The column's type stands for its kind."""
        return F.coalesce(reduce(lambda a, b: a & b, self._tests(c, of), F.lit(True)), F.lit(False))

    def _tests(self, c: Column, of: T.DataType) -> list[Column]:
        if self.impossible:
            return [F.lit(False)]
        out = [reduce(lambda a, b: a | b, [a.test(c, of) for a in self.arms])] if self.arms else []
        k = column_kind(of)
        null_ok = self.kinds is not None and "null" in self.kinds
        if self.kinds is not None and k is not None and k not in self.kinds:
            return [c.isNull() if null_ok else F.lit(False)]
        number, text, sized = k in NUMBERS, k == "string", k in ("string", "list", "map")
        no = F.lit(False)
        if not null_ok:
            out.append(c.isNotNull())
        if self.value:
            out.append(c == F.lit(self.value[0]) if kind_of(self.value[0]) == k or k in NUMBERS and kind_of(self.value[0]) in NUMBERS and k == "bigdecimal" else no)
        if text and not self.may_be_empty and not self.value and not self.arms:
            out.append(F.length(c) > 0)
        for bound, low in ((self.lo, True), (self.hi, False)):
            if bound:
                v, closed = bound
                if (kind_of(v) in NUMBERS) != number or (kind_of(v) == "string") != text:
                    return [no]
                x = F.lit(v)
                out.append((c >= x if closed else c > x) if low else (c <= x if closed else c < x))
        own = [x for x in self.excluded if kind_of(x) == k]
        if own:
            out.append(~c.isin(own))
        for p in (*self.patterns, *(p for f in self.formats for p in formats.PATTERNS[f])):
            out.append(c.rlike(portable(p)) if text else no)
        for f in self.formats:
            if not text:
                out.append(no)
            elif f == "regex":
                out.append(patterns_are_valid(c))
            elif f in formats.LONGEST:
                out.append(F.length(c) <= formats.LONGEST[f])
        for m in self.multiples:
            out.append(arith.is_multiple(c, m) if number else no)
        if self.size is not None:
            n = F.length(c) if text else F.size(c) if sized else None
            out.append(no if n is None else self.size.test(n.cast("long"), T.LongType()))
        members, inner = (F.map_values(c), of.valueType) if k == "map" and isinstance(of, T.MapType) else (c, of.elementType) if k == "list" else (None, None)
        for key in self.unique or ():
            if members is None:
                return [no]
            own_ = F.transform(members, _member(key)) if key else members
            if key:
                out.append(~F.exists(own_, lambda m: m.isNull()))
            out.append(F.size(F.array_distinct(own_)) == F.size(own_))
        for what, n in self.contains:
            if members is None:
                return [no]
            out.append(n.test(F.size(F.filter(members, _tester(what, inner))).cast("long"), T.LongType()))
        for t, covers in self.rests:
            if not isinstance(of, T.MapType):
                return [no]
            others = F.map_filter(c, _outside(covers))
            out.append(F.forall(F.map_values(others), _tester(t, of.valueType)))
        for key, what in self.keys:
            if isinstance(of, T.StructType):
                out.append(what.test(c[key], of[key].dataType) if key in of.names else no)
            elif isinstance(of, T.MapType):
                out.append(what.test(F.try_element_at(c, F.lit(key)), of.valueType))
            else:
                return [no]
        out += [m.test(c, of) for m, _ in self.musts]
        for n, cs in self.nofs:
            total = reduce(lambda a, b: a + b, [x.test(c, of).cast("long") for x in cs], F.lit(0).cast("long"))
            out.append(n.test(total, T.LongType()))
        out += [F.when(x.test(c, of), t.test(c, of)).otherwise((e or ANY).test(c, of)) for x, t, e in self.whens]
        return out

    # ---- order and text

    def subsumes(self, other: Constraint) -> bool | None:
        """Whether everything the other admits is admitted here; None where the rules cannot tell."""
        if other.is_empty():
            return True
        if self == ANY or self == other:
            return True
        if other.arms:
            got = [self.subsumes(a) for a in other.arms]
            return False if False in got else None if None in got else True
        if self.arms:
            got = [a.subsumes(other) for a in self.arms]
            if True in got:
                return True
            return None if None in got or not other.value else False
        if other.value:
            return self.admits(other.value[0])
        if self.value:
            return False
        late = (self.contains, self.musts, self.nofs, self.whens, self.rests, self.patterns, self.formats)
        if self.kinds is not None and (other.kinds is None or not other.kinds <= self.kinds):
            return False
        for mine, theirs, low in ((self.lo, other.lo, True), (self.hi, other.hi, False)):
            if mine and (theirs is None or _tighter(mine, theirs, low) != theirs):
                return False
        if any(other.admits(x) for x in self.excluded):
            return False
        if not set(self.multiples) <= set(other.multiples) and any(all(_exact(o) % _exact(m) != 0 for o in other.multiples) for m in self.multiples):
            return False
        if self.size is not None and (other.size is None or self.size.subsumes(other.size) is not True):
            return False if other.size is None else self.size.subsumes(other.size)
        if self.unique is not None and not self.unique <= (other.unique or frozenset()):
            return False
        if "string" in (other.kinds or KINDS) and other.may_be_empty and not self.may_be_empty:
            return False
        theirs_ = (other.contains, other.musts, other.nofs, other.whens, other.rests, other.patterns, other.formats)
        if any(x not in t for m, t in zip(late, theirs_, strict=True) for x in m):
            return None if any(theirs_) else False
        own = dict(other.keys)
        for key, c in self.keys:
            if key not in own:
                return False
            if (s := c.subsumes(own[key])) is not True:
                return s
        return True

    def canon(self) -> str:
        """One text for equal constraints."""
        if self.impossible:
            return "nil"
        if self.arms:
            return "|".join(sorted(a.canon() for a in self.arms))
        parts = [json.dumps(self.value[0], sort_keys=True, default=str)] if self.value else []
        if self.kinds is not None and not self.value:
            parts.append("number" if self.kinds == NUMBERS else "|".join(sorted(self.kinds)))
        for bound, (closed, open_) in ((self.lo, ("min", "above")), (self.hi, ("max", "below"))):
            if bound:
                parts.append(f"{closed if bound[1] else open_}({json.dumps(bound[0], default=str)})")
        if self.excluded:
            parts.append(f"neq({','.join(json.dumps(x, default=str) for x in self.excluded)})")
        parts += [f"re({json.dumps(p)})" for p in self.patterns] + [f"format({json.dumps(f)})" for f in self.formats] + [f"mulof({m})" for m in self.multiples]
        parts += ([f"len({self.size.canon()})"] if self.size is not None else []) + ["empty()"] * self.may_be_empty
        parts += [f"unique({json.dumps(k) if k else ''})" for k in sorted(self.unique or ())]
        parts += [f"contains({c.canon()},{n.canon()})" for c, n in self.contains] + [f"must({c.canon()},{json.dumps(m)})" for c, m in self.musts]
        parts += [f"nof({n.canon()},{','.join(c.canon() for c in cs)})" for n, cs in self.nofs]
        parts += [f"when({','.join(x.canon() for x in w if x is not None)})" for w in self.whens]
        parts += [f"rest({','.join([t.canon(), *k])})" for t, k in self.rests]
        parts += ["{" + ",".join(f"{json.dumps(k)}:{c.canon()}" for k, c in self.keys) + "}"] * bool(self.keys)
        return "&".join(parts) or "any"


def _member(key: str):
    return lambda m: m[key]


def _tester(c: Constraint, of: T.DataType):
    return lambda m: c.test(m, of)


def _outside(covers: tuple[str, ...]):
    return lambda key, _: ~key.isin(*covers) if covers else F.lit(True)


def _unique(xs: Iterable[Any]) -> list[Any]:
    return list({_typed(x): x for x in xs}.values())


def _distinct(xs: Iterable[Constraint]) -> list[Constraint]:
    return list(dict.fromkeys(xs))


def _merge(a: tuple, b: tuple, order: bool = True) -> tuple:
    both = dict.fromkeys((*a, *b))
    return tuple(sorted(both, key=_text) if order else both)


def _text(x: Any) -> str:
    return x.canon() if isinstance(x, Constraint) else "\x00".join(map(_text, x)) if isinstance(x, tuple) else str(x)


def _merge_keys(a: tuple, b: tuple) -> tuple:
    out = dict(a)
    for k, c in b:
        out[k] = out[k] & c if k in out else c
    return tuple(sorted(out.items()))


def _tighter(a: tuple | None, b: tuple | None, low: bool) -> tuple | None:
    if a is None or b is None:
        return a or b
    if not _comparable(a[0], b[0]):
        return None
    if _exact(a[0]) == _exact(b[0]):
        # One point: an open bound is tighter; the spelling of the lowest leaf stays.
        v = min(a[0], b[0], key=lambda x: arith.LEAVES.index(kind_of(x)) if kind_of(x) in NUMBERS else 0)
        return v, a[1] and b[1]
    return (b if _lt(a[0], b[0]) else a) if low else (a if _lt(a[0], b[0]) else b)


def column_kind(of: T.DataType) -> str | None:
    """The kind of a column type; None for one that may hold several."""
    if number := arith.leaf(of):
        return number
    for t, name in ((T.StringType, "string"), (T.BooleanType, "boolean"), (T.ArrayType, "list"), (T.MapType, "map"), (T.StructType, "map"), (T.NullType, "null")):
        if isinstance(of, t):
            return name
    return "string" if isinstance(of, T.DateType | T.TimestampType | T.TimestampNTZType) else None


ANY = Constraint()
NOTHING = Constraint(impossible=True)


def nothing() -> Constraint:
    return NOTHING


def kind(name: str) -> Constraint:
    if name == "any":
        return ANY
    return Constraint(kinds=NUMBERS if name == "number" else frozenset((name,)))


def const(v: Any) -> Constraint:
    return Constraint(kinds=frozenset((kind_of(v),)), value=(v,))


def enum(*vs: Any) -> Constraint:
    return reduce(lambda a, b: a | b, map(const, vs))


def min_(v: Any) -> Constraint:
    return Constraint(lo=(v, True))


def above(v: Any) -> Constraint:
    return Constraint(lo=(v, False))


def max_(v: Any) -> Constraint:
    return Constraint(hi=(v, True))


def below(v: Any) -> Constraint:
    return Constraint(hi=(v, False))


def neq(*vs: Any) -> Constraint:
    return Constraint(excluded=tuple(sorted(_unique(vs), key=_typed)))


def mulof(n: Any) -> Constraint:
    return Constraint(multiples=(n,))


def pattern(p: str) -> Constraint:
    portable(p)
    return Constraint(kinds=frozenset(("string",)), patterns=(p,))


def fmt(name: str) -> Constraint:
    if name not in formats.PATTERNS:
        raise ValueError(f"format {name!r}")
    return Constraint(kinds=frozenset(("string",)), formats=(name,), may_be_empty=name in formats.EMPTY)


def _count(n: int | Constraint | None) -> Constraint:
    return min_(1) if n is None else n if isinstance(n, Constraint) else const(n)


def len_(n: int | Constraint) -> Constraint:
    return Constraint(kinds=frozenset(("string", "list", "map")), size=_count(n))


def empty() -> Constraint:
    return Constraint(may_be_empty=True)


def unique(key: str = "") -> Constraint:
    return Constraint(kinds=frozenset(("list", "map")), unique=frozenset((key,)))


def contains(c: Constraint, n: int | Constraint | None = None) -> Constraint:
    return Constraint(kinds=frozenset(("list", "map")), contains=((c, _count(n)),))


def must(c: Constraint, message: str) -> Constraint:
    return Constraint(musts=((c, message),))


def nof(n: int | Constraint, *cs: Constraint) -> Constraint:
    return Constraint(nofs=((_count(n), cs),))


def when(c: Constraint, then: Constraint, otherwise: Constraint | None = None) -> Constraint:
    return Constraint(whens=((c, then, otherwise),))


def rest(c: Constraint, *covered: str) -> Constraint:
    return Constraint(kinds=frozenset(("map",)), rests=((c, tuple(sorted(covered))),))


def members(**keys: Constraint) -> Constraint:
    """A map that has these members."""
    return Constraint(kinds=frozenset(("map",)), keys=tuple(sorted(keys.items())))
