"""JSON Schema (2020-12) out of a schema, and the same subset back in; earlier drafts are brought up to it first.

References go to ``$defs`` and to places in the same document, as deep as they lead but not around in a circle: a
constraint is a finite value, so a schema that contains itself is refused.
"""

from __future__ import annotations

from typing import Any
from urllib.parse import unquote

from .constraint import (
    ANY, NUMBERS, Constraint, const, contains, empty, fmt, kind, len_, max_, members, min_, above, below, mulof, must, nof, nothing, pattern, rest, unique, when,
)
from .schema import Field, Schema

#: The dialect and the keywords below are those of the standard.
DIALECT = "https://json-schema.org/draft/2020-12/schema"
_OUT = {"string": "string", "integer": "integer", "float": "number", "biginteger": "integer", "bigdecimal": "number", "boolean": "boolean", "null": "null", "map": "object", "list": "array"}
_IN = {"string": kind("string") & empty(), "integer": kind("integer") | kind("biginteger"), "number": kind("number"), "boolean": kind("boolean"), "null": kind("null"), "object": kind("map"), "array": kind("list")}


def constraint_out(c: Constraint) -> dict[str, Any] | bool:
    """A constraint as a schema object; what JSON Schema cannot say is left out (uniqueness by a member's key)."""
    if c.impossible:
        return False
    if c.arms:
        if all(a.value for a in c.arms):
            return {"enum": [a.value[0] for a in c.arms]}
        return {"anyOf": [constraint_out(a) for a in c.arms]}
    if c.value:
        return {"const": c.value[0]}
    out: dict[str, Any] = {}
    if c.kinds is not None:
        names = ["number"] if c.kinds >= NUMBERS else []
        names += sorted({_OUT[k] for k in c.kinds} - ({"integer", "number"} if names else set()))
        out["type"] = names[0] if len(names) == 1 else names
    for bound, (closed, open_) in ((c.lo, ("minimum", "exclusiveMinimum")), (c.hi, ("maximum", "exclusiveMaximum"))):
        if bound and not isinstance(bound[0], str):
            out[closed if bound[1] else open_] = bound[0]
    more: list[Any] = []
    if c.excluded:
        more.append({"not": {"enum": list(c.excluded)}})
    if c.patterns:
        out["pattern"], rest_ = c.patterns[0], c.patterns[1:]
        more += [{"pattern": p} for p in rest_]
    if c.formats:
        out["format"] = c.formats[0]
    if c.multiples:
        out["multipleOf"], rest_ = c.multiples[0], c.multiples[1:]
        more += [{"multipleOf": m} for m in rest_]
    low, high = _range(c.size)
    word = "Items" if c.kinds == frozenset(("list",)) else "Properties" if c.kinds == frozenset(("map",)) else "Length"
    if low is not None:
        out["min" + word] = low
    if high is not None:
        out["max" + word] = high
    if c.kinds is not None and "string" in c.kinds and not c.may_be_empty:
        out["minLength"] = max(1, out.get("minLength", 0))
    if c.unique is not None and "" in c.unique:
        out["uniqueItems"] = True
    for what, n in c.contains:
        low, high = _range(n)
        item = {"contains": constraint_out(what)} | ({"minContains": low} if low is not None else {"minContains": 0}) | ({"maxContains": high} if high is not None else {})
        more.append(item)
    more += [constraint_out(m) for m, _ in c.musts]
    for n, cs in c.nofs:
        low, high = _range(n)
        each = [constraint_out(x) for x in cs]
        more.append({"oneOf": each} if (low, high) == (1, 1) else {"not": {"anyOf": each}} if high == 0 else {"anyOf": each} if low == 1 and high is None else {"allOf": each} if low == len(cs) else {})
    for a, b, e in c.whens:
        more.append({"if": constraint_out(a), "then": constraint_out(b)} | ({"else": constraint_out(e)} if e else {}))
    if c.keys:
        out["properties"], out["required"] = {k: constraint_out(x) for k, x in c.keys}, [k for k, _ in c.keys]
    for t, covers in c.rests:
        out.setdefault("properties", {k: True for k in covers})
        out["additionalProperties"] = constraint_out(t)
    if more:
        out["allOf"] = more
    return out or True


def _range(c: Constraint | None) -> tuple[int | None, int | None]:
    if c is None:
        return None, None
    if c.value:
        return c.value[0], c.value[0]
    return (c.lo[0] + (not c.lo[1]) if c.lo else None), (c.hi[0] - (not c.hi[1]) if c.hi else None)


def schema_out(s: Schema) -> dict[str, Any]:
    out: dict[str, Any] = {"$schema": DIALECT, "type": "object", "properties": {}}
    for name, f in s.fields:
        one = False if f.forbidden else constraint_out(f.constraint & s.spread)
        if isinstance(one, dict):
            if d := f.default():
                one = one | {"default": d[0]}
            if f.deprecated:
                one = one | {"deprecated": True}
        out["properties"][name] = one
    if need := [k for k, f in s.fields if not f.optional and not f.forbidden and not f.default()]:
        out["required"] = need
    if s.closed:
        out["additionalProperties"] = False
    return out


def _between(low: Any, high: Any) -> Constraint:
    c = ANY
    if low is not None:
        c = c & min_(int(low))
    return c & max_(int(high)) if high is not None else c


#: Keywords about one kind say nothing about others.
_ONLY = {
    frozenset(NUMBERS): ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"),
    frozenset(("string",)): ("pattern", "minLength", "maxLength"),
    frozenset(("list",)): ("minItems", "maxItems", "uniqueItems", "contains", "items"),
    frozenset(("map",)): ("properties", "required", "additionalProperties", "minProperties", "maxProperties", "dependentRequired", "dependentSchemas"),
}


def upgrade(x: Any) -> Any:
    """A schema of drafts 4 to 7 in the keywords of 2020-12; one of 2020-12 stays as it is."""
    if isinstance(x, list):
        return [upgrade(v) for v in x]
    if not isinstance(x, dict):
        return x
    out: dict[str, Any] = {}
    for k, v in x.items():
        if k in ("enum", "const", "default", "examples"):
            out[k] = v
        elif k == "definitions":
            out["$defs"] = {n: upgrade(d) for n, d in v.items()} | out.get("$defs", {})
        elif k == "id" and isinstance(v, str):
            out["$id"] = v
        elif k == "dependencies":
            for n, d in v.items():
                out.setdefault("dependentRequired" if isinstance(d, list) else "dependentSchemas", {})[n] = d if isinstance(d, list) else upgrade(d)
        elif k in ("properties", "$defs", "patternProperties", "dependentSchemas"):
            out[k] = out.get(k, {}) | {n: upgrade(d) for n, d in v.items()}
        elif k in ("exclusiveMinimum", "exclusiveMaximum") and isinstance(v, bool):
            continue  # draft 4: says of the bound beside it that it is open
        elif k in ("minimum", "maximum") and x.get("exclusive" + k.capitalize()) is True:
            out["exclusive" + k.capitalize()] = v
        elif k == "$ref" and isinstance(v, str):
            out[k] = v.replace("#/definitions/", "#/$defs/")
        elif k == "$schema":
            out[k] = DIALECT
        else:
            out[k] = upgrade(v)
    return out


def _at(whole: Any, ref: str) -> Any:
    """The place of a document that a reference names."""
    if not ref.startswith("#") or ref != "#" and not ref.startswith("#/"):
        raise ValueError(f"$ref {ref!r} leads out of the document")
    here = whole
    for part in ref.split("/")[1:]:
        part = unquote(part).replace("~1", "/").replace("~0", "~")
        try:
            here = here[int(part)] if isinstance(here, list) else here[part]
        except (KeyError, IndexError, ValueError, TypeError) as e:
            raise ValueError(f"$ref {ref!r} leads nowhere") from e
    return here


def constraint_in(x: dict[str, Any] | bool, whole: Any = None, within: tuple[str, ...] = ()) -> Constraint:
    """A schema object as a constraint; unknown keywords are refused. References are read in ``whole``."""
    if isinstance(x, bool):
        return ANY if x else nothing()
    whole = x if whole is None else whole

    def inner(y: dict[str, Any] | bool) -> Constraint:
        return constraint_in(y, whole, within)

    c = ANY & empty()
    if "$ref" in x:
        if x["$ref"] in within:
            raise ValueError(f"$ref {x['$ref']!r} leads around in a circle")
        c = c & constraint_in(_at(whole, x["$ref"]), whole, (*within, x["$ref"]))
    known = {"type", "enum", "const", "not", "anyOf", "oneOf", "allOf", "if", "then", "else", "format", "$schema", "title", "description", "default", "deprecated", "minContains", "maxContains", "$comment", "examples", "$ref", "$defs", "$id", "$anchor", "readOnly", "writeOnly", "contentMediaType", "contentEncoding"}
    known |= {k for ks in _ONLY.values() for k in ks}
    if bad := set(x) - known:
        raise ValueError(f"keywords {sorted(bad)}")
    if "type" in x:
        types = [x["type"]] if isinstance(x["type"], str) else x["type"]
        c = c & _any([_IN[t] for t in types])
    for kinds, words in _ONLY.items():
        if not any(w in x for w in words):
            continue
        own = ANY & empty()
        for w, f in (("minimum", min_), ("maximum", max_), ("exclusiveMinimum", above), ("exclusiveMaximum", below), ("multipleOf", mulof), ("pattern", pattern)):
            if w in x:
                own = own & f(x[w])
        for low, high in (("minLength", "maxLength"), ("minItems", "maxItems"), ("minProperties", "maxProperties")):
            if low in x or high in x:
                if low in words:
                    own = own & len_(_between(x.get(low), x.get(high)))
        if x.get("uniqueItems") and "uniqueItems" in words:
            own = own & unique()
        if "items" in words and "items" in x:
            own = own & contains(nof(0, inner(x["items"])), 0)
        if "contains" in words and "contains" in x:
            own = own & contains(inner(x["contains"]), _between(x.get("minContains", 1), x.get("maxContains")))
        if "properties" in words:
            props, need = x.get("properties", {}), x.get("required", [])
            own = own & Constraint(keys=tuple(sorted((k, inner(props.get(k, True))) for k in need)))
            for k, p in props.items():
                if k not in need:
                    own = own & when(members(**{k: ANY & (kind("null") | nof(0, kind("null")))}), members(**{k: inner(p)}))
            for k, needs in x.get("dependentRequired", {}).items():
                own = own & when(members(**{k: ANY & empty()}), members(**{n: ANY & empty() for n in needs}))
            for k, p in x.get("dependentSchemas", {}).items():
                own = own & when(members(**{k: ANY & empty()}), inner(p))
            if "additionalProperties" in x:
                own = own & rest(inner(x["additionalProperties"]), *props)
        others = Constraint(kinds=frozenset(("string", "boolean", "null", "map", "list", *NUMBERS)) - kinds, may_be_empty=True)
        c = c & (own & Constraint(kinds=kinds, may_be_empty=True) | others) if "type" not in x or set(kinds) != set(c.kinds or ()) else c & own
    if "enum" in x:
        c = c & _any([const(v) for v in x["enum"]])
    if "const" in x:
        c = c & const(x["const"])
    if "format" in x:
        c = c & (fmt(x["format"]) | nof(0, kind("string")))
    if "not" in x:
        c = c & nof(0, inner(x["not"]))
    for a in x.get("allOf", ()):
        c = c & must(inner(a), "allOf")
    if "anyOf" in x:
        c = c & nof(min_(1), *map(inner, x["anyOf"]))
    if "oneOf" in x:
        c = c & nof(1, *map(inner, x["oneOf"]))
    if "if" in x:
        c = c & when(inner(x["if"]), inner(x.get("then", True)), inner(x.get("else", True)))
    return c


def _any(cs: list[Constraint]) -> Constraint:
    out = nothing()
    for c in cs:
        out = out | c
    return out


def schema_in(x: dict[str, Any]) -> Schema:
    """A schema of records from an object schema, of any draft from 4 on."""
    x = upgrade(x)
    need = set(x.get("required", ()))
    fields = {}
    for k, p in x.get("properties", {}).items():
        d = ((0, p["default"]),) if isinstance(p, dict) and "default" in p else ()
        fields[k] = Field(constraint_in(p, x), optional=k not in need, forbidden=p is False, defaults=d, deprecated="deprecated" if isinstance(p, dict) and p.get("deprecated") else "")
    for k in need - set(fields):
        fields[k] = Field()
    return Schema(tuple(sorted(fields.items())), closed=x.get("additionalProperties") is False)
