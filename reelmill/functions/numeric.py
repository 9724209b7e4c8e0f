from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, as_col


def round2(c: ColumnLike) -> Column:
    """Scale, round, unscale: 1.005 gives 1.0, as binary floating point has it."""
    return F.round(as_col(c) * 100, 0) / 100


def decade(year: ColumnLike) -> Column:
    y = as_col(year).cast("int")
    return y - y % 10


def safe_ratio(x: ColumnLike, y: ColumnLike) -> Column:
    """x / y, NULL when y is zero."""
    return as_col(x).cast("double") / F.nullif(as_col(y), F.lit(0))


def float_divide(x: ColumnLike, y: ColumnLike) -> Column:
    """IEEE division: x/0 is an infinity, 0/0 is NaN; neither raises under ANSI."""
    x, y = as_col(x), as_col(y)
    at_zero = (
        F.when(x > 0, F.lit(float("inf")))
        .when(x < 0, F.lit(float("-inf")))
        .otherwise(F.lit(float("nan")))
    )
    return F.when(y == 0, at_zero).otherwise(x / F.nullif(y, F.lit(0.0)))


def stddev_from_moments(n: ColumnLike, total: ColumnLike, squares: ColumnLike) -> Column:
    """Sample deviation from count, sum and sum of squares; NULL below two values.

    Meant for bounded values such as ratings: there the sums are exact or nearly
    so and the subtraction cannot lose more than a few last digits.
    """
    n, total, squares = as_col(n), as_col(total), as_col(squares)
    spread = F.greatest(squares - total * total / n, F.lit(0.0))
    return F.when(n > 1, F.sqrt(spread / F.nullif(n - 1, F.lit(0))))


def popularity(avg: ColumnLike, ratings: ColumnLike, tags: ColumnLike) -> Column:
    """Weighted score; a missing count weighs as one, a missing average as zero."""
    # Weights, log caps and the stand-ins for missing inputs.
    avg_weight, ratings_weight, tags_weight = 0.4, 0.3, 0.3
    ratings_cap, tags_cap = 10.0, 5.0

    def capped_log(count: ColumnLike, cap: float) -> Column:
        return F.least(F.ln(F.coalesce(as_col(count), F.lit(1)) + 1), F.lit(cap))

    score = (
        F.coalesce(as_col(avg), F.lit(0.0)) * avg_weight
        + capped_log(ratings, ratings_cap) * ratings_weight
        + capped_log(tags, tags_cap) * tags_weight
    )
    return round2(score)
