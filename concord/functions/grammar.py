"""Grammars: RFC 5234 ABNF compiled on the driver, and texts parsed by it into trees.

A tree is ``{rule, src, kids}`` as JSON, for each production that matched. The empty string parses under no grammar.
Alternatives are tried in order with backtracking, and repetitions take as much as they can. A number names exactly its
code points; a quoted string matches either case unless it is written ``%s"..."``.

A text is read by a machine of a few instructions, without recursion. A state (instruction, place, and what is open) with a
choice that has failed once is not tried again, and between two choices there is one way to go on, so the time is bounded by
the number of states, whatever the grammar; texts of any length have an answer. A rule that would call itself again at the
same place fails there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.encoder import encode_basestring

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_TOKEN = re.compile(
    r"""\s*(?:(?P<comment>;[^\n]*)|(?P<num>%[bdxBDX][0-9A-Fa-f]+(?:-[0-9A-Fa-f]+|(?:\.[0-9A-Fa-f]+)*))|(?P<str>(?:%[siSI])?"[^"]*")|(?P<rep>\d*\*\d*|\d+)|(?P<name>[A-Za-z][A-Za-z0-9-]*)|(?P<op>=/|[=/()\[\]]))"""
)
_CORE = {
    "alpha": ("range", ((65, 90), (97, 122))), "digit": ("range", ((48, 57),)), "hexdig": ("range", ((48, 57), (65, 70), (97, 102))), "dquote": ("range", ((34, 34),)),
    "sp": ("range", ((32, 32),)), "htab": ("range", ((9, 9),)), "wsp": ("range", ((32, 32), (9, 9))), "cr": ("range", ((13, 13),)), "lf": ("range", ((10, 10),)), "vchar": ("range", ((33, 126),)), "bit": ("range", ((48, 49),)),
}


class GrammarError(ValueError):
    """``parse_failed`` for a text, or a grammar that does not compile."""


class _Ranges:
    """Characters of ranges too wide to be listed."""

    def __init__(self, ranges: tuple[tuple[int, int], ...]):
        self.ranges = ranges

    def __contains__(self, c: str) -> bool:
        return any(lo <= ord(c) <= hi for lo, hi in self.ranges)


def _characters(ranges: tuple[tuple[int, int], ...]) -> frozenset[str] | _Ranges:
    if sum(max(0, hi - lo + 1) for lo, hi in ranges) > 1_000 or any(hi > 0x10FFFF for _, hi in ranges):
        return _Ranges(ranges)
    return frozenset(chr(c) for lo, hi in ranges for c in range(lo, hi + 1))


class Grammar:
    """A compiled grammar; the first rule is the one a text must be."""

    def __init__(self, source: str):
        self.source = source
        self.rules: dict[str, tuple] = {}
        logical = re.split(r"\n(?=[A-Za-z])", source.replace("\r\n", "\n").strip())
        for line in logical:
            tokens = self._tokens(line)
            if len(tokens) < 3 or tokens[0][0] != "name" or tokens[1][1] not in ("=", "=/"):
                raise GrammarError(f"no rule: {line!r}")
            self._at, self._ts = 2, tokens
            body = self._alternatives()
            if self._at != len(tokens):
                raise GrammarError(f"unread: {line!r}")
            name = tokens[0][1].lower()
            if tokens[1][1] == "=/":
                body = ("or", (self.rules.get(name, ("or", ())), body))
            elif name in self.rules:
                raise GrammarError(f"rule {name} twice")
            self.rules[name] = body
        if not self.rules:
            raise GrammarError("no rules")
        self.top = next(iter(self.rules))
        for name in self._names(tuple(self.rules.values())):
            if name not in self.rules and name not in _CORE:
                raise GrammarError(f"rule {name} is missing")
        self._analyse()
        self._code: list[tuple] = []
        self._entry: dict[str, int] = {}
        for name in dict.fromkeys([*self.rules, *self._names(tuple(self.rules.values()))]):
            self._entry[name] = self._compile(self.rules.get(name) or _CORE[name], self._put(("return",)))

    def _analyse(self) -> None:
        """Which rules can be empty, and which can call themselves before anything is read."""
        self._empty: set[str] = set()
        while more := {name for name, body in self.rules.items() if name not in self._empty and self._nullable(body)}:
            self._empty |= more
        first = {name: self._first(body) for name, body in self.rules.items()}
        self._left: set[str] = set()
        for name in first:
            seen, todo = set(), list(first[name])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo.extend(first.get(x, ()))
            if name in seen:
                self._left.add(name)

    def _nullable(self, node: tuple) -> bool:
        kind = node[0]
        if kind == "rule":
            return node[1] in self._empty
        if kind in ("or", "seq"):
            return (any if kind == "or" else all)(map(self._nullable, node[1]))
        return kind == "text" and not node[1] or kind == "rep" and (not node[2] or self._nullable(node[1]))

    def _first(self, node: tuple) -> set[str]:
        """The rules that a node may call before anything is read."""
        kind = node[0]
        if kind == "rule":
            return {node[1]}
        if kind == "rep":
            return self._first(node[1])
        if kind not in ("or", "seq"):
            return set()
        out: set[str] = set()
        for part in node[1]:
            out |= self._first(part)
            if kind == "seq" and not self._nullable(part):
                break
        return out

    def _put(self, *instruction: tuple) -> int:
        self._code.extend(instruction)
        return len(self._code) - 1

    def _compile(self, node: tuple, then: int) -> int:
        """The place of the first instruction for a node, after which the machine goes on at ``then``."""
        kind = node[0]
        if kind == "text":
            return self._put(("text", node[1], node[2], then))
        if kind == "range":
            return self._put(("range", _characters(node[1]), then))
        if kind == "rule":
            body = self.rules.get(node[1]) or _CORE[node[1]]
            if body[0] == "range":  # one character: nothing is opened for it
                own = node[1] in self.rules
                return self._put(("leaf", node[1], _characters(body[1]), then) if own else ("range", _characters(body[1]), then))
            return self._put(("call", node[1], then))
        if kind == "or":
            return self._put(("or", tuple(self._compile(arm, then) for arm in node[1])))
        if kind == "seq":
            for part in reversed(node[1]):
                then = self._compile(part, then)
            return then
        _, item, low, high = node
        again = self._put(("again",))
        turn = self._put(("turn", self._compile(item, again), low, high, then))
        self._code[again] = ("again", turn, self._nullable(item))
        return self._put(("start", turn, self._nullable(item)))

    @staticmethod
    def _tokens(line: str) -> list[tuple[str, str]]:
        out, i = [], 0
        while i < len(line.rstrip()):
            m = _TOKEN.match(line, i)
            if not m:
                raise GrammarError(f"at {line[i : i + 20]!r}")
            i = m.end()
            if m.lastgroup != "comment":
                out.append((m.lastgroup, m[m.lastgroup]))
        return out

    def _names(self, node: tuple) -> Iterator[str]:
        for x in node:
            if isinstance(x, tuple):
                if x[:1] == ("rule",):
                    yield x[1]
                else:
                    yield from self._names(x)

    def _peek(self) -> tuple[str, str]:
        return self._ts[self._at] if self._at < len(self._ts) else ("", "")

    def _alternatives(self) -> tuple:
        arms = [self._sequence()]
        while self._peek()[1] == "/" and self._peek()[0] == "op":
            self._at += 1
            arms.append(self._sequence())
        return arms[0] if len(arms) == 1 else ("or", tuple(arms))

    def _sequence(self) -> tuple:
        parts = []
        while self._peek()[0] and not (self._peek()[0] == "op" and self._peek()[1] in "/)]"):
            low, high = 1, 1
            if self._peek()[0] == "rep":
                a, star, b = self._peek()[1].partition("*")
                low, high = (int(a or 0), int(b) if b else None) if star else (int(a), int(a))
                self._at += 1
            item = self._element()
            parts.append(item if (low, high) == (1, 1) else ("rep", item, low, high))
        if not parts:
            raise GrammarError("an empty alternative")
        return parts[0] if len(parts) == 1 else ("seq", tuple(parts))

    def _element(self) -> tuple:
        kind, x = self._peek()
        self._at += 1
        if kind == "name":
            return ("rule", x.lower())
        if kind == "str":
            exact = x[:2].lower() == "%s"
            text = x[x.index('"') + 1 : -1]
            return ("text", text if exact else text.lower(), exact)
        if kind == "num":
            base, body = {"b": 2, "d": 10, "x": 16}[x[1].lower()], x[2:]
            try:
                if "-" in body:
                    lo, hi = (int(p, base) for p in body.split("-"))
                    return ("range", ((lo, hi),))
                return ("text", "".join(chr(int(p, base)) for p in body.split(".")), True)
            except ValueError as e:
                raise GrammarError(f"{x} names no code point") from e
        if x in ("(", "["):
            inner = self._alternatives()
            if self._peek()[1] != {"(": ")", "[": "]"}[x]:
                raise GrammarError("a group is open")
            self._at += 1
            return inner if x == "(" else ("rep", inner, 0, 1)
        raise GrammarError(f"at {x!r}")

    def _run(self, text: str) -> tuple | None:
        """The rules that opened and closed, as a chain from the last one back, of the first way that reads the whole text.

        ``open_`` is a chain of frames: a rule called (return place, rule, where) or a repetition (turns so far, where the
        turn began). The place is kept only where it matters: for rules that may call themselves before anything is read,
        and for turns that may be empty. Equal chains are one number, so that states can be remembered.
        """
        if not text:
            return None
        code, entry, own, n = self._code, self._entry, self.rules, len(text)
        frames: list[tuple] = [(-1, ())]
        known: dict[tuple, int] = {}

        def frame(above: int, body: tuple) -> int:
            at = known.get((above, body))
            if at is None:
                at = known[above, body] = len(frames)
                frames.append((above, body))
            return at

        seen: set[tuple[int, int, int]] = set()
        left = self._left
        first = frame(0, (-1, self.top, 0 if self.top in left else None))
        # States to try, the last one first: instruction, place, frames, rules so far.
        todo: list[tuple[int, int, int, tuple]] = [(entry[self.top], 0, first, ((), True, self.top, 0))]
        while todo:
            at, i, open_, trace = todo.pop()
            while True:
                op = code[at]
                kind = op[0]
                if kind == "leaf":
                    if i >= n or text[i] not in op[2]:
                        break
                    at = op[3]
                    trace = ((trace, True, op[1], i), False, op[1], i + 1)
                    i += 1
                elif kind == "text":
                    t = text[i : i + len(op[1])]
                    if (t if op[2] else t.lower()) != op[1]:
                        break
                    at, i = op[3], i + len(op[1])
                elif kind == "range":
                    if i >= n or text[i] not in op[1]:
                        break
                    at, i = op[2], i + 1
                elif kind == "or":
                    if (state := (at, i, open_)) in seen:
                        break
                    seen.add(state)
                    for arm in reversed(op[1][1:]):
                        todo.append((arm, i, open_, trace))
                    at = op[1][0]
                elif kind == "call":
                    x, name = open_, op[1]
                    if name in left:  # not again at the same place
                        while x and frames[x][1][1:] != (name, i):
                            x = frames[x][0]
                        if x:
                            break
                    open_ = frame(open_, (op[2], name, i if name in left else None))
                    at = entry[name]
                    trace = (trace, True, name, i) if name in own else trace
                elif kind == "return":
                    above, (back, name, _) = frames[open_]
                    trace = (trace, False, name, i) if name in own else trace
                    if back < 0:
                        if i == n:
                            return trace
                        break
                    at, open_ = back, above
                elif kind == "start":
                    open_ = frame(open_, (0, i if op[2] else None))
                    at = op[1]
                elif kind == "again":
                    above, (turns, began) = frames[open_]
                    low, high, then = code[op[1]][2:]
                    if i == began:  # an empty turn is as good as all that are still missing
                        at, open_ = then, above
                        continue
                    # Beyond the least number only a bound counts on.
                    open_ = frame(above, (turns + 1 if high is not None else min(turns + 1, low), i if op[2] else None))
                    at = op[1]
                else:
                    _, item, low, high, then = op
                    above, (turns, _) = frames[open_]
                    more = high is None or turns < high
                    if more and turns >= low:
                        if (state := (at, i, open_)) in seen:
                            break
                        seen.add(state)
                        todo.append((then, i, above, trace))
                    at, open_ = (item, open_) if more else (then, above)
        return None

    def parse(self, text: str) -> dict:
        """The tree of a whole text."""
        trace = self._run(text)
        if trace is None:
            raise GrammarError("parse_failed")
        steps = []
        while trace:
            trace, *step = trace
            steps.append(step)
        root: dict = {"kids": []}
        stack = [(root, 0)]
        for begins, name, i in reversed(steps):
            if begins:
                stack.append(({"rule": name, "src": "", "kids": []}, i))
            else:
                node, began = stack.pop()
                node["src"] = text[began:i]
                stack[-1][0]["kids"].append(node)
        return root["kids"][0]

    def admits(self, text: str) -> bool:
        return self._run(text) is not None


def tree_json(tree: dict) -> str:
    """A tree of any depth as JSON."""
    out: list[str] = []
    todo: list[dict | str] = [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        # Names of rules are letters, digits and dashes.
        out.append(f'{{"rule": "{x["rule"]}", "src": {encode_basestring(x["src"])}, "kids": [')
        if not x["kids"]:
            out.append("]}")
            continue
        todo.append("]}")
        for k in reversed(x["kids"]):
            todo += [k, ", "]
        todo.pop()
    return "".join(out)


def abnf(source: str) -> str:
    """The source of a grammar that compiles; any other is refused."""
    return Grammar(source).source


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The same rows dealt over tasks by columns whose values differ.

    Reading by a grammar takes far longer than reading from a file, and many short texts may come as one split.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def parse(source: str, text: Column) -> Column:
    """The tree of each text as a variant; a text that does not parse is an error."""
    g = Grammar(source)

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else tree_json(g.parse(x)))

    return F.parse_json(F.pandas_udf(run, "string")(text))


def parses(source: str, text: Column) -> Column:
    """Whether a text is one of the grammar; null is not."""
    g = Grammar(source)

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x is not None and g.admits(x))

    return F.pandas_udf(run, "boolean")(text)
