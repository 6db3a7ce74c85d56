"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Unicode calls white space, and the four information separators.
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def blank(c: Column) -> Column:
    """Null or white space only."""
    return F.coalesce(strip(c) == "", F.lit(True))


def date_text(c: Column) -> Column:
    """A node's text as dates are sought in it; null if blank. Brackets go before white space does."""
    bare = F.btrim(c, F.lit("/\\«[]»"))
    return F.when(~blank(c), F.translate(strip(bare), "\u00a0", " "))


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
