"""String and token expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as blank.  Java's Unicode \s plus the four
# separator controls U+001C..U+001F, which Python's str.split() also treats as
# blank.
WS_CLASS = r"(?U)[\s\x{1c}-\x{1f}]"
TOKEN_PATTERN = r"\S+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Whitespace tokens (``\\S+`` matches) in text order."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), F.lit(0))


def squash_ws(text) -> Column:
    """Collapse every blank run to one space and trim (``' '.join(s.split())``)."""
    return F.trim(F.regexp_replace(_c(text), WS_CLASS + "+", " "))


def strip_ws(text) -> Column:
    """Remove leading and trailing blanks (``s.strip()``)."""
    return F.regexp_replace(_c(text), "^" + WS_CLASS + "+|" + WS_CLASS + "+$", "")


def control_prompt_expr(labels: list, sep: str = "\t", end: str = "\n\n") -> Column:
    """Labels joined by TAB then a blank line; a null label is an error, not a skip."""
    checked = [
        F.when(_c(c).isNull(), F.raise_error(F.lit(f"null label in control code column"))).otherwise(_c(c).cast("string"))
        for c in labels
    ]
    return F.concat(F.concat_ws(sep, *checked), F.lit(end))
