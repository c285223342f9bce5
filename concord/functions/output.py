"""How a value is written: rounding, kind, case and emptiness, applied at output and nowhere before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import arith


@dataclass(frozen=True)
class Output:
    """``places`` or ``significant`` digits (ties to even), ``kind`` string or number, ``case``, and whether empty text is left out."""

    places: int | None = None
    significant: int | None = None
    kind: str | None = None
    case: str | None = None
    drop_empty: bool = False

    def __post_init__(self) -> None:
        if self.places is not None and self.significant is not None:
            raise ValueError("places or significant, not both")
        if self.kind not in (None, "string", "number") or self.case not in (None, "upper", "lower", "title"):
            raise ValueError("kind is string or number, case is upper, lower or title")

    def write(self, c: Column) -> Column:
        if self.places is not None:
            c = arith.places(c, self.places)
        if self.significant is not None:
            c = arith.significant(c, self.significant)
        if self.kind == "string":
            # A whole float prints without its point and zero.
            c = F.regexp_replace(c.cast("string"), r"\.0$", "")
        if self.kind == "number":
            c = c.cast("double")
        if self.case:
            c = {"upper": F.upper, "lower": F.lower, "title": F.initcap}[self.case](c)
        return F.when(c != "", c) if self.drop_empty else c


def write_out(df: DataFrame, **records: Output) -> DataFrame:
    """``df`` with the named columns as they are written."""
    return df.select(*[records[n].write(F.col(f"`{n}`")).alias(n) if n in records else F.col(f"`{n}`") for n in df.columns])
