"""Arithmetic on the four numeric leaves: integer, float, biginteger and bigdecimal.

Kinds follow the operands: integers with integers stay integers, anything with a float is a float, mixed exact operands
take the wider leaf. Refused, with an error that names the rule: a float mixed with a wide exact operand, a zero
divisor in any leaf, a float result that is not finite, division of decimals, and results that do not fit.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F, types as T

LEAVES = ("integer", "biginteger", "bigdecimal", "float")


def leaf(kind: T.DataType) -> str | None:
    """The numeric leaf of a column type; None for other types."""
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "integer"
    if isinstance(kind, T.FloatType | T.DoubleType):
        return "float"
    if isinstance(kind, T.DecimalType):
        return "bigdecimal" if kind.scale else "biginteger"
    return None


def result_leaf(a: str, b: str) -> str:
    """The leaf of a sum or product; refuses a float with a wide exact operand."""
    if a not in LEAVES or b not in LEAVES:
        raise TypeError("invalid-arg: both operands must be numbers")
    pair = {a, b}
    if "float" in pair:
        if pair & {"biginteger", "bigdecimal"}:
            raise TypeError("exact_float_mix: a float does not mix with a big number")
        return "float"
    return max(a, b, key=LEAVES.index)


def _raise(code: str) -> Column:
    return F.raise_error(F.lit(code))


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(float("inf")), x).when(x.isNull(), x).otherwise(_raise("float_overflow").cast("double"))


def _stored(x: Column, out: str) -> Column:
    return _finite(x) if out == "float" else x


def add(a: Column, b: Column, la: str = "integer", lb: str = "integer") -> Column:
    return _stored(a + b, result_leaf(la, lb))


def sub(a: Column, b: Column, la: str = "integer", lb: str = "integer") -> Column:
    return _stored(a - b, result_leaf(la, lb))


def mul(a: Column, b: Column, la: str = "integer", lb: str = "integer") -> Column:
    return _stored(a * b, result_leaf(la, lb))


def _divisor(b: Column, kind: str) -> Column:
    return F.when(b != 0, b).when(b.isNull(), b).otherwise(_raise("divide_by_zero").cast(kind))


def _no_decimal(la: str, lb: str) -> str:
    out = result_leaf(la, lb)
    if out == "bigdecimal":
        raise TypeError("inexact_divide: decimals are not divided")
    return out


_CAST = {"integer": "long", "biginteger": "decimal(38,0)", "float": "double"}


def div(a: Column, b: Column, la: str = "integer", lb: str = "integer") -> Column:
    """Integers truncate toward zero."""
    out = _no_decimal(la, lb)
    kind = _CAST[out]
    if out == "float":
        return _finite(a.cast(kind) / _divisor(b.cast(kind), kind))
    x, y = a.cast(kind), _divisor(b.cast(kind), kind)
    return F.call_function("div", x, y)


def rem(a: Column, b: Column, la: str = "integer", lb: str = "integer") -> Column:
    """The remainder with the sign of the dividend."""
    kind = _CAST[_no_decimal(la, lb)]
    return a.cast(kind) % _divisor(b.cast(kind), kind)


def mod(a: Column, b: Column, la: str = "integer", lb: str = "integer") -> Column:
    """The remainder with the sign of the divisor."""
    r, kind = rem(a, b, la, lb), _CAST[_no_decimal(la, lb)]
    return F.when((r != 0) & (F.signum(r) != F.signum(b.cast(kind))), r + b.cast(kind)).otherwise(r)


def upper(n: Column, of: str) -> Column:
    """The ceiling, in the leaf of the number."""
    return F.ceil(n).cast("double") if of == "float" else F.ceil(n) if of == "bigdecimal" else n


def lower(n: Column, of: str) -> Column:
    """The floor, in the leaf of the number."""
    return F.floor(n).cast("double") if of == "float" else F.floor(n) if of == "bigdecimal" else n


def places(n: Column, digits: int) -> Column:
    """Rounded for output, ties to even."""
    return F.bround(n, digits)


def significant(n: Column, digits: int) -> Column:
    """Rounded for output to so many significant digits, ties to even."""
    size = F.when(n == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(n))).cast("int"))
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - size)
    return F.rint(n * scale) / scale


def is_multiple(c: Column, n: int | float | str) -> Column:
    """Whether a number is a whole multiple of n; floats are read as they print, never through their binary form.

    Never null and never an error: null, not a number and what 38 digits cannot hold are no multiples. Floats below 2^53
    and a whole n need no digits, as their remainder is exact.
    """
    step = Decimal(str(n))
    if not step:
        return F.coalesce(c == 0, F.lit(False))
    text = c.cast("string")

    def by_digits(kind: str) -> Column:
        digits = text.try_cast(kind)
        # What the decimals do not hold whole is no multiple: the value must come back as it was.
        whole = digits.try_cast("double") == text.try_cast("double")
        return F.when(whole, (digits % F.lit(str(step)).cast(kind)) == 0)

    fine = by_digits("decimal(38,20)")
    if step != step.to_integral_value():
        return F.coalesce(fine, F.lit(False))
    wide = F.coalesce(fine, by_digits("decimal(38,0)"), F.lit(False))
    small = F.abs(text.try_cast("double")) < F.lit(float(2**53))
    return F.coalesce(F.when(small, text.try_cast("double") % F.lit(float(step)) == 0), wide) if abs(step) < 2**53 else wide


def plus(a: Column, b: Column, ka: str = "integer", kb: str = "integer") -> Column:
    """The sum of numbers, one list after another, either of two booleans; a text with anything but a list is text.

    Kinds are leaves, ``string``, ``list`` and ``boolean``; others, and a boolean with a number, are refused. What is
    missing stays missing.
    """
    if ka in LEAVES and kb in LEAVES:
        return add(a, b, ka, kb)
    plain = {*LEAVES, "string", "boolean"}
    if ka == kb == "list":
        return F.concat(a, b)
    if ka == kb == "boolean":
        return F.when(a.isNotNull() & b.isNotNull(), a | b)
    if "string" in (ka, kb) and {ka, kb} <= plain:
        return F.concat(a.cast("string"), b.cast("string"))
    raise TypeError(f"invalid-arg: {ka} + {kb}")


def negative(a: Column, of: str = "integer") -> Column:
    """A number with the other sign, in its leaf."""
    if of not in LEAVES:
        raise TypeError(f"invalid-arg: -{of}")
    return -a


def positive(a: Column, of: str = "integer") -> Column:
    if of not in LEAVES:
        raise TypeError(f"invalid-arg: +{of}")
    return a
