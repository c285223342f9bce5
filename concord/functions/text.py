"""Text functions: case runs, tr-like translation, splitting, replacement, escapes, and identifier styles."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F


def _once(s: Column, f: Callable[[Column], Column]) -> Column:
    """A function that names its argument several times, over a value computed once.

    A Column is put in wherever it is named: n functions that each name their argument m times, one over the other, would
    compute it m^n times. A lambda's variable holds the value instead.
    """
    return F.get(F.transform(F.array(s), f), F.lit(0))


def _run(s: Column, start: int | None, length: int | None, f) -> Column:
    """Applies f to a run of code points; a negative start counts from the end, a negative length takes all."""
    if start is None:
        return f(s)
    n = F.length(s)
    at = F.least(F.lit(start), n) if start >= 0 else F.greatest(n + start, F.lit(0))
    size = n - at if length is None or length < 0 else F.least(F.lit(length), n - at)
    cut = lambda a, b: F.substring(s, a, b)
    return F.concat(cut(F.lit(1), at), f(cut(at + 1, size)), cut(at + size + 1, n))


def upper(s: Column, start: int | None = None, length: int | None = None) -> Column:
    return _run(s, start, length, F.upper)


def lower(s: Column, start: int | None = None, length: int | None = None) -> Column:
    return _run(s, start, length, F.lower)


def expand_set(spec: str) -> str:
    """Characters of a set in which ``a-z`` is a range; a dash at an end is a dash."""
    out, i = [], 0
    while i < len(spec):
        if i + 2 < len(spec) and spec[i + 1] == "-":
            lo, hi = ord(spec[i]), ord(spec[i + 2])
            if lo > hi:
                raise ValueError(f"range {spec[i : i + 3]!r} runs backwards")
            out.extend(map(chr, range(lo, hi + 1)))
            i += 3
        else:
            out.append(spec[i])
            i += 1
    return "".join(out)


def translate(s: Column, source: str, to: str = "") -> Column:
    """Character by character; a short target repeats its last character, an empty one deletes; the last mapping wins."""
    src, dst = expand_set(source), expand_set(to)
    if dst:
        dst = dst[: len(src)] + dst[-1] * max(0, len(src) - len(dst))
        mapping = dict(zip(src, dst, strict=True))
        return F.translate(s, "".join(mapping), "".join(mapping.values()))
    return F.translate(s, "".join(dict.fromkeys(src)), "")


def split(s: Column, sep: str, pattern: bool = False) -> Column:
    """Fields between separators, empty ones kept; an empty separator gives the code points."""
    if sep == "":
        return F.when(s == "", F.array(F.lit(""))).otherwise(F.split(s, ""))
    return F.split(s, portable(sep) if pattern else re.escape(sep), -1)


_BAD = re.compile(r"\\[1-9]|\(\?[=!<]|\\[bBkpPAZGQE]")
_CLASSES = {"\\d": "[0-9]", "\\D": "[^0-9]", "\\w": "[A-Za-z0-9_]", "\\W": "[^A-Za-z0-9_]", "\\s": "[\\t\\n\\x0B\\f\\r ]", "\\S": "[^\\t\\n\\x0B\\f\\r ]", "\\z": "\\z"}


def portable(pattern: str) -> str:
    """A pattern of the linear subset for Java: ASCII classes spelled out, look-around and back references refused."""
    if m := _BAD.search(pattern):
        raise ValueError(f"rep_pattern: {m[0]!r} is not portable")
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in _CLASSES:
            body = _CLASSES[two]
            out.append(body[1:-1] if inside and not two[1].isupper() and two != "\\z" else body)
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            c = pattern[i]
            inside = True if c == "[" else False if c == "]" else inside
            out.append("[^\\n\\r]" if c == "." and not inside else c)
            i += 1
    return "".join(out)


def is_pattern(pattern: str) -> bool:
    """Whether a text is a pattern of the portable subset."""
    try:
        re.compile(portable(pattern).replace(r"\z", r"\Z"))
    except (ValueError, re.error, OverflowError, RecursionError):
        return False
    return True


def patterns_are_valid(s: Column) -> Column:
    """Whether each text is a pattern; null is not. A compiler decides, so this runs in Python, by batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x is not None and is_pattern(x)).astype(bool)

    return F.pandas_udf(run, "boolean")(s)


def rep(s: Column, pattern: str, sub: str) -> Column:
    """Replaces all matches; ``$1`` to ``$9`` are groups, ``$&`` is the match, ``$$`` a dollar sign.

    An empty match directly after another match is not replaced: rep("aa", "a*", "-") is "-".
    """
    java = portable(pattern)
    groups = re.compile(pattern).groups
    out, i = [], 0
    while i < len(sub):
        if sub[i] != "$":
            out.append("\\\\" if sub[i] == "\\" else sub[i])
            i += 1
            continue
        c = sub[i + 1 : i + 2]
        if c == "$":
            out.append("\\$")
        elif c == "&":
            out.append("$0")
        elif c.isdigit() and 1 <= int(c) <= groups:
            out.append(f"${c}")
        else:
            raise ValueError(f"rep_sub: ${c} names no group")
        i += 2
    if re.compile(pattern).match(""):
        # An empty match where the last match ended is none.
        java = rf"(?:{java})(?:(?!\G)|\A)"
    return F.regexp_replace(s, java, "".join(out))


#: Escapes by convention: pairs are replaced one after the other.
_ESCAPES: dict[str, tuple[tuple[str, str], ...]] = {
    "json": (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")),
    "sq": (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")),
    "sql": (("'", "''"),),
    "xml": (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")),
}


def esc(s: Column, variant: str = "json") -> Column:
    """A text as it stands inside a literal of a language."""
    if variant == "uri":
        return F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    if variant == "shell":
        return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    if variant == "regex":
        return F.regexp_replace(s, r"([\\^$.|?*+()\[\]{}/])", r"\\$1")
    if variant not in _ESCAPES:
        raise ValueError(f"esc_variant: {variant!r}")
    out = s
    for a, b in _ESCAPES[variant]:
        out = F.replace(out, F.lit(a), F.lit(b))
    if variant == "json":
        return _once(out, _controls)
    return out


def _controls(s: Column) -> Column:
    """The other control characters are rare: only texts that have one go through them."""
    spelled = s
    for c in (chr(c) for c in range(32) if chr(c) not in "\n\r\t\b\f"):
        spelled = F.replace(spelled, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return F.when(s.rlike("[\\x00-\\x07\\x0B\\x0E-\\x1F]"), spelled).otherwise(s)


def usc(s: Column, variant: str = "json") -> Column:
    """The text that :func:`esc` came from; malformed input is refused, null stays null."""
    return _once(s, lambda x: F.when(x.isNotNull(), _unescaped(x, variant)))


def _unescaped(s: Column, variant: str) -> Column:
    if variant == "sql":
        odd = F.replace(s, F.lit("''"), F.lit("")).contains("'")
        return F.when(~odd, F.replace(s, F.lit("''"), F.lit("'"))).otherwise(F.raise_error(F.lit("usc_malformed")))
    if variant == "uri":
        return F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))
    if variant == "shell":
        inner = F.substring(s, F.lit(2), F.length(s) - 2)
        return F.when(s.rlike("(?s)^'.*'$"), F.replace(inner, F.lit("'\\''"), F.lit("'"))).otherwise(F.raise_error(F.lit("usc_malformed")))
    if variant == "xml":
        bad = F.regexp_replace(s, "&(amp|lt|gt|quot|apos);", "").contains("&")
        out = s
        for a, b in reversed(_ESCAPES["xml"]):
            out = F.replace(out, F.lit(b), F.lit(a))
        return F.when(~bad, out).otherwise(F.raise_error(F.lit("usc_malformed")))
    if variant == "regex":
        return F.regexp_replace(s, r"\\([\\^$.|?*+()\[\]{}/])", "$1")
    if variant in ("json", "sq"):
        quote = '"' if variant == "json" else "'"
        bad = F.regexp_replace(s, r"\\(?:[nrtbf\\/" + quote + r"]|u[0-9A-Fa-f]{4})", "").contains("\\")
        inner = s if variant == "json" else F.replace(F.replace(s, F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"'))
        return F.when(~bad, F.from_json(F.concat(F.lit('{"x":"'), inner, F.lit('"}')), "x string")["x"]).otherwise(F.raise_error(F.lit("usc_malformed")))
    raise ValueError(f"esc_variant: {variant!r}")


def name_words(name: Column) -> Column:
    """The words of an identifier: split at separators and where the case changes, lower-cased."""
    x = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    x = F.regexp_replace(x, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.filter(F.split(x, "[^A-Za-z0-9]+"), lambda w: w != ""), F.lower)


STYLES = ("snake", "kebab", "camel", "pascal", "constant", "dot", "path", "title", "flat")


def nom(name: Column, style: str = "snake", acronyms: Sequence[str] = ()) -> Column:
    """An identifier in one of nine styles; acronyms keep their case where words are capitalised."""
    ws = name_words(name)

    def cap(w: Column) -> Column:
        out = F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
        for a in acronyms:
            out = F.when(w == a.lower(), F.lit(a)).otherwise(out)
        return out

    if style in ("snake", "kebab", "dot", "path", "flat"):
        return F.array_join(ws, {"snake": "_", "kebab": "-", "dot": ".", "path": "/", "flat": ""}[style])
    if style == "constant":
        return F.upper(F.array_join(ws, "_"))
    if style == "camel":
        return F.array_join(F.transform(ws, lambda w, i: F.when(i == 0, w).otherwise(cap(w))), "")
    if style in ("pascal", "title"):
        return F.array_join(F.transform(ws, cap), "" if style == "pascal" else " ")
    raise ValueError(f"style {style!r}")


def join(parts: Column, sep: str = "") -> Column:
    """Members in order; null members are refused."""
    return F.when(F.exists(parts, lambda x: x.isNull()), F.raise_error(F.lit("join_member"))).otherwise(F.array_join(parts, sep))
