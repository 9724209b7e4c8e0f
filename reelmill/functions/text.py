from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The code points that count as whitespace for trimming (no-break
# spaces are not among them).
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007),
         *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000],
    )
)


def trim_ws(c: ColumnLike) -> Column:
    """Strip every kind of whitespace; plain ``trim`` strips U+0020 only."""
    return F.btrim(as_col(c), F.lit(WHITESPACE))


def contains_sub(c: ColumnLike, needle: str) -> Column:
    """Case-sensitive substring test; NULL stays NULL."""
    return as_col(c).contains(needle)


def contains_any(c: ColumnLike, needles: list[str]) -> Column:
    test = F.lit(False)
    for needle in needles:
        test = test | contains_sub(c, needle)
    return test


def split_literal(c: ColumnLike, separator: str) -> Column:
    r"""Split on a literal; ``\Q..\E`` keeps the regex engine from reading it."""
    return F.split(as_col(c), rf"\Q{separator}\E")


def cardinality(c: ColumnLike) -> Column:
    return F.array_size(as_col(c)).cast("bigint")


def regexp_group(c: ColumnLike, pattern: str, group: int = 1) -> Column:
    """Captured group, NULL without a match.  The group must not match empty."""
    return F.nullif(F.regexp_extract(as_col(c), pattern, group), F.lit(""))


def pad_left(c: ColumnLike, width: int, fill: str = "0") -> Column:
    """Left-pad, cutting longer input to ``width`` characters."""
    return F.lpad(as_col(c).cast("string"), width, fill)
