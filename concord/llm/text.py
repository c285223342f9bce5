"""Words as the operators count them: runs of anything but space and U+0009 to U+000D."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Not a word character.
BLANKS = "\t\n\x0b\x0c\r "
#: The regular expression of one word, for Java, Python and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z only; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order; no words for null."""
    x = F.coalesce(text, F.lit(""))
    for c in BLANKS[:-1]:
        x = F.replace(x, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(x, " "), "")


def lines(text: Column) -> Column:
    """The \\n-split lines of a text that have a word; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)
