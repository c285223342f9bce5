"""Schemas of records: fields with constraints, defaults by rank, optional, forbidden and closed; their meet and order."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .constraint import ANY, NOTHING, Constraint, same


@dataclass(frozen=True)
class Field:
    """One member of a record. ``defaults`` are (rank, value), the lowest rank wins; ``forbidden`` must be absent.

    ``deprecated``, ``meta`` (names and texts) and ``ident`` ride along: they say something and admit the same values.
    """

    constraint: Constraint = ANY
    optional: bool = False
    forbidden: bool = False
    defaults: tuple[tuple[int, Any], ...] = ()
    hidden: bool = False
    deprecated: str = ""
    meta: tuple[tuple[str, str], ...] = ()
    ident: bool = False

    def __and__(self, other: Field) -> Field:
        # Required wins over optional; a member forbidden on one side and required on the other cannot be.
        forbidden = self.forbidden or other.forbidden
        c = self.constraint & other.constraint
        if forbidden and not (self.optional or self.forbidden) or forbidden and not (other.optional or other.forbidden):
            c = NOTHING
        defaults = tuple(sorted(dict.fromkeys((*self.defaults, *other.defaults)), key=lambda d: d[0]))
        meta = dict(self.meta)
        for k, v in other.meta:
            if meta.setdefault(k, v) != v:
                raise ValueError(f"meta {k!r}: {meta[k]!r} and {v!r}")
        return Field(c, self.optional and other.optional, forbidden, defaults, self.hidden or other.hidden, self.deprecated or other.deprecated, tuple(sorted(meta.items())), self.ident or other.ident)

    def default(self) -> tuple[Any, ...]:
        """The value of the lowest rank that the constraint admits, as a tuple of one; equal ranks must agree."""
        for rank in sorted({r for r, _ in self.defaults}):
            own = [v for r, v in self.defaults if r == rank and self.constraint.admits(v)]
            if not own:
                continue
            if any(not same(v, own[0]) for v in own):
                raise ValueError(f"defaults of rank {rank} disagree: {own}")
            return (own[0],)
        return ()


@dataclass(frozen=True)
class Link:
    """A field whose values must be keys of another table."""

    field: str
    table: str
    key: str


@dataclass(frozen=True)
class Schema:
    """Fields of a record, rules about the whole table, and whether other fields are allowed."""

    fields: tuple[tuple[str, Field], ...] = ()
    closed: bool = False
    spread: Constraint = ANY  # met into every member
    unique: tuple[tuple[str, ...], ...] = ()
    links: tuple[Link, ...] = ()
    musts: tuple[tuple[str, str], ...] = ()  # SQL condition over the record, message

    @classmethod
    def of(cls, closed: bool = False, unique: tuple = (), links: tuple = (), musts: tuple = (), spread: Constraint = ANY, **fields: Constraint | Field) -> Schema:
        own = {k: v if isinstance(v, Field) else Field(v) for k, v in fields.items()}
        return cls(tuple(sorted(own.items())), closed, spread, unique, links, musts)

    def get(self, name: str) -> Field | None:
        return dict(self.fields).get(name)

    def __and__(self, other: Schema) -> Schema:
        own = dict(self.fields)
        for side, there in ((self, other), (other, self)):
            if side.closed:
                extra = {k for k, f in there.fields if k not in dict(side.fields) and not f.optional}
                if extra:
                    raise ValueError(f"closed: {sorted(extra)}")
        for k, f in other.fields:
            own[k] = own[k] & f if k in own else f
        if self.closed or other.closed:
            for side in (self, other):
                if side.closed:
                    own = {k: f for k, f in own.items() if k in dict(side.fields)}
        merge = lambda a, b: tuple(dict.fromkeys((*a, *b)))
        return Schema(tuple(sorted(own.items())), self.closed or other.closed, self.spread & other.spread, merge(self.unique, other.unique), merge(self.links, other.links), merge(self.musts, other.musts))

    def rules(self, df: DataFrame) -> list[tuple[str, str, Column]]:
        """(path, code, test) of every rule about one record, given the table's types; tests are never null."""
        types = {f.name: f.dataType for f in df.schema.fields}
        out: list[tuple[str, str, Column]] = []
        for name, f in self.fields:
            if name not in types:
                out.append((name, "absent", F.lit(f.optional or f.forbidden or bool(f.default()))))
                continue
            c = F.col(f"`{name}`")
            if f.forbidden:
                out.append((name, "forbidden", c.isNull()))
                continue
            test = (f.constraint & self.spread).test(c, types[name])
            filled = f.optional or bool(f.default())
            out.append((name, "constraint", c.isNull() | test if filled else test))
        if self.closed:
            out += [(name, "closed", F.lit(False)) for name in sorted(set(types) - {k for k, _ in self.fields})]
        elif self.spread != ANY:
            own = {k for k, _ in self.fields}
            out += [(name, "spread", self.spread.test(F.col(f"`{name}`"), t)) for name, t in types.items() if name not in own]
        return out + [(message, "must", F.coalesce(F.expr(sql), F.lit(False))) for sql, message in self.musts]

    def fill(self, df: DataFrame) -> DataFrame:
        """``df`` with defaults in place of missing values, where the field has one."""
        types = {f.name: f.dataType for f in df.schema.fields}
        for name, f in self.fields:
            if d := f.default():
                df = df.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit(d[0])) if name in types else F.lit(d[0]))
        return df

    def visible(self, df: DataFrame) -> DataFrame:
        """``df`` without hidden fields."""
        return df.drop(*[k for k, f in self.fields if f.hidden])


def subsumes(general: Schema, specific: Schema) -> str:
    """``subsumes``, ``does_not_subsume`` or ``undecided``: whether every record of the second fits the first."""
    unsure = False
    own = dict(specific.fields)
    for name, f in general.fields:
        there = own.get(name)
        if there is None:
            if f.forbidden and specific.closed or f.optional and (specific.closed or f.constraint == ANY):
                continue
            return "does_not_subsume"
        if f.forbidden != there.forbidden and not there.forbidden:
            return "does_not_subsume"
        if not f.optional and not f.forbidden and there.optional and not there.default():
            return "does_not_subsume"
        got = True if there.forbidden else (f.constraint & general.spread).subsumes(there.constraint & specific.spread)
        if got is False:
            return "does_not_subsume"
        unsure = unsure or got is None
    if general.closed and (not specific.closed or set(own) - {k for k, _ in general.fields}):
        return "does_not_subsume"
    if set(general.unique) - set(specific.unique) or set(general.links) - set(specific.links):
        return "does_not_subsume"
    if set(general.musts) - set(specific.musts):
        unsure = True
    return "undecided" if unsure else "subsumes"


def breaking(old: Schema, new: Schema, mode: str = "backward") -> dict[str, str]:
    """Verdict of an evolution: backward (old data fits the new schema), forward, full or none; fields to look at."""
    if mode not in ("backward", "forward", "full", "none"):
        raise ValueError(f"mode {mode!r}")
    asked = {"backward": [(new, old)], "forward": [(old, new)], "full": [(new, old), (old, new)], "none": []}[mode]
    got = [subsumes(a, b) for a, b in asked]
    verdict = "breaking" if "does_not_subsume" in got else "undecided" if "undecided" in got else "compatible"
    a, b = dict(old.fields), dict(new.fields)
    out = {"": verdict}
    for k in sorted(set(a) | set(b)):
        if k not in b:
            out[k] = "removed_deprecated" if a[k].deprecated else "removed"
        elif k not in a:
            out[k] = "added_optional" if b[k].optional or b[k].default() else "added_required"
        elif a[k] != b[k]:
            wide, narrow = b[k].constraint.subsumes(a[k].constraint), a[k].constraint.subsumes(b[k].constraint)
            out[k] = "widened" if wide and not narrow else "narrowed" if narrow and not wide else "equal" if wide and narrow else "changed"
    return out


#: What a comparison of two schemas may leave aside.
PROFILES = {"whole": frozenset(), "values": frozenset(("table",)), "shape": frozenset(("table", "constraints"))}


def subsumes_in(profile: str, general: Schema, specific: Schema) -> str:
    """:func:`subsumes` as a profile sees it: ``whole``, ``values`` (no rules about tables), ``shape`` (fields and kinds)."""
    aside = PROFILES[profile]

    def seen(s: Schema) -> Schema:
        if "table" in aside:
            s = replace(s, unique=(), links=(), musts=())
        if "constraints" in aside:
            bare = lambda c: Constraint(kinds=c.kinds, may_be_empty=True) if c.kinds is not None else ANY
            s = replace(s, fields=tuple((k, replace(f, constraint=bare(f.constraint))) for k, f in s.fields), spread=ANY)
        return s

    return subsumes(seen(general), seen(specific))


def outcome(df: DataFrame, old: Schema, new: Schema) -> DataFrame:
    """(rows, old, new, lost, gained, verdict): what an evolution does to a table's records.

    ``lost`` fit the old schema and not the new one, ``gained`` the other way; any lost record makes it ``breaking``.
    """

    def fits(s: Schema) -> Column:
        out = F.lit(True)
        for _, _, test in s.rules(df):
            out = out & test
        return out

    a, b = fits(old), fits(new)
    n = lambda c: F.count_if(c)
    got = df.select(a.alias("a"), b.alias("b")).agg(F.count("*").alias("rows"), n(F.col("a")).alias("old"), n(F.col("b")).alias("new"), n(F.col("a") & ~F.col("b")).alias("lost"), n(F.col("b") & ~F.col("a")).alias("gained"))
    return got.withColumn("verdict", F.when(F.col("lost") > 0, "breaking").otherwise("compatible"))


def infer(df: DataFrame) -> Schema:
    """The schema of a table's types: every field of its column's kind."""
    from .constraint import column_kind

    def one(of: T.DataType) -> Constraint:
        k = column_kind(of)
        return ANY if k is None else Constraint(kinds=frozenset((k,)))

    return Schema(tuple(sorted((f.name, Field(one(f.dataType), optional=f.nullable)) for f in df.schema.fields)))


def lift(v: Any) -> Constraint:
    """The parent type of an example: its kind, and for maps the types of its members."""
    from .constraint import kind_of

    k = kind_of(v)
    if k == "map":
        return Constraint(kinds=frozenset(("map",)), keys=tuple(sorted((n, lift(x)) for n, x in v.items())))
    return Constraint(kinds=frozenset((k,)))


def rename(schema: Schema, names: dict[str, str]) -> Schema:
    return replace(schema, fields=tuple(sorted((names.get(k, k), f) for k, f in schema.fields)))


def close(schema: Schema) -> Schema:
    """No other fields than its own."""
    return replace(schema, closed=True)


def open_(schema: Schema) -> Schema:
    """Other fields are allowed again."""
    return replace(schema, closed=False)


def hide(schema: Schema, *names: str) -> Schema:
    """Fields that are checked but not written."""
    return replace(schema, fields=tuple((k, replace(f, hidden=f.hidden or k in names)) for k, f in schema.fields))


def move(schema: Schema, old: str, new: str) -> Schema:
    """A field under another name; the old one must be absent from then on."""
    f = schema.get(old)
    if f is None or schema.get(new) is not None:
        raise ValueError(f"move: {old!r} to {new!r}")
    own = {k: v for k, v in schema.fields if k != old} | {new: f, old: Field(optional=True, forbidden=True)}
    return replace(schema, fields=tuple(sorted(own.items())))


def types(schema: Schema, *names: str) -> Schema:
    """Fields that say what values are like and are no data themselves: checked where they are, never asked for or written."""
    return replace(schema, fields=tuple((k, replace(f, hidden=True, optional=True) if k in names else f) for k, f in schema.fields))


def annotate(df: DataFrame, schema: Schema) -> DataFrame:
    """``df`` with each field's riders as its column's metadata, where writers and readers of tables keep them."""
    for k, f in schema.fields:
        told = {"deprecated": f.deprecated} if f.deprecated else {}
        told |= {"meta": dict(f.meta)} if f.meta else {}
        told |= {"ident": True} if f.ident else {}
        if told and k in df.columns:
            df = df.withMetadata(k, told)
    return df


def riders(df: DataFrame) -> dict[str, dict[str, Any]]:
    """The riders of a table's columns."""
    return {f.name: f.metadata for f in df.schema.fields if f.metadata}


def declarations(schema: Schema, acyclic: tuple[str, ...] = (), inverse: dict[str, str] | None = None) -> dict[str, dict[str, Any]]:
    """Relation to what is declared of it: its target, whether it must be acyclic, and its inverse."""
    back = inverse or {}
    names = sorted({link.field for link in schema.links} | set(acyclic) | set(back))
    target = {link.field: f"{link.table}.{link.key}" for link in schema.links}
    return {n: {"target": target.get(n), "acyclic": n in acyclic, "inverse": back.get(n)} for n in names}


def prefer(schema: Schema, rank: int = 0, **values: Any) -> Schema:
    """Defaults for fields, at a rank."""
    return replace(schema, fields=tuple((k, replace(f, defaults=(*f.defaults, (rank, values[k]))) if k in values else f) for k, f in schema.fields))


def copy(schema: Schema, *names: str) -> Schema:
    """Some of the fields, or all."""
    return replace(schema, fields=tuple((k, f) for k, f in schema.fields if not names or k in names))
