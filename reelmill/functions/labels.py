"""Classifications.  Order of the rules is part of each contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, as_col, contains_any

# Thresholds, words and labels that results must carry verbatim.
RATING_BANDS = [(4.5, "Excelente"), (3.5, "Bom"), (2.5, "Regular")]
LOWEST_BAND = "Ruim"

SENTIMENT_WORDS = [
    ("Positivo", ["love", "great", "best", "amazing", "excellent"]),
    ("Negativo", ["hate", "bad", "worst", "terrible", "awful"]),
]
NEUTRAL = "Neutro"

CATEGORY_WORDS = [
    ("Humor", ["funny", "comedy"]),
    ("Ação", ["action", "fight"]),
    ("Romance", ["romantic", "love"]),
    ("Terror", ["scary", "horror"]),
    ("Enredo", ["twist", "plot"]),
]
OTHER = "Outros"

USER_SEGMENTS = [(500, "Power User"), (100, "Active"), (20, "Regular")]
RATING_STYLES = [(4.0, "Generoso"), (3.0, "Equilibrado")]
CONSISTENCIES = [(1.5, "Polarizado"), (1.0, "Variado")]
ENGAGEMENTS = [(1000, "Alto"), (100, "Médio"), (10, "Baixo")]

GENRE_FLAGS = {
    "Action": "is_action",
    "Comedy": "is_comedy",
    "Drama": "is_drama",
    "Thriller": "is_thriller",
    "Romance": "is_romance",
    "Horror": "is_horror",
    "Sci-Fi": "is_scifi",
    "Animation": "is_animation",
    "Documentary": "is_documentary",
}
# The flags a movie's gold row carries, and the ones similarity counts.
SIMILARITY_FLAGS = list(GENRE_FLAGS.values())[:7]


def ladder(value: ColumnLike, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first step that ``value`` reaches; NULL reaches none."""
    value = as_col(value)
    label = F
    for floor, name in steps:
        label = label.when(value >= floor, name)
    return label.otherwise(otherwise)


def keyword_label(
    text: ColumnLike, rules: list[tuple[str, list[str]]], otherwise: str
) -> Column:
    """Label of the first rule one of whose words occurs anywhere in ``text``."""
    label = F
    for name, words in rules:
        label = label.when(contains_any(text, words), name)
    return label.otherwise(otherwise)


def rating_category(rating: ColumnLike) -> Column:
    return ladder(rating, RATING_BANDS, LOWEST_BAND)


def sentiment(lowered_tag: ColumnLike) -> Column:
    return keyword_label(lowered_tag, SENTIMENT_WORDS, NEUTRAL)


def tag_category(lowered_tag: ColumnLike) -> Column:
    return keyword_label(lowered_tag, CATEGORY_WORDS, OTHER)


def link_status(imdb: ColumnLike, tmdb: ColumnLike) -> Column:
    present = as_col(imdb).isNotNull().cast("int") + as_col(tmdb).isNotNull().cast("int")
    return F.element_at(
        F.array(F.lit("Missing"), F.lit("Partial"), F.lit("Complete")), present + 1
    )


def quality_tier(avg: ColumnLike, ratings: ColumnLike) -> Column:
    avg, ratings = as_col(avg), as_col(ratings)
    return (
        F.when((avg >= 4.0) & (ratings >= 100), "Blockbuster")
        .when((avg >= 3.5) & (ratings >= 50), "Popular")
        .when(avg >= 3.0, "Mediano")
        .when((avg < 3.0) & (ratings >= 20), "Impopular")
        .otherwise("Pouco Avaliado")
    )


def engagement_level(ratings: ColumnLike) -> Column:
    return ladder(ratings, ENGAGEMENTS, "Muito Baixo")


def user_segment(ratings: ColumnLike) -> Column:
    return ladder(ratings, USER_SEGMENTS, "Casual")


def rating_style(avg: ColumnLike) -> Column:
    return ladder(avg, RATING_STYLES, "Crítico")


def rating_consistency(stddev: ColumnLike) -> Column:
    return ladder(stddev, CONSISTENCIES, "Consistente")


def flag_signature(flags: list[str]) -> Column:
    """Pack nullable flags into an integer: per flag 10 for true, 01 for false,
    00 for NULL, so equal known flags share exactly one bit."""
    packed = F.lit(0)
    for i, flag in enumerate(flags):
        code = F.when(F.col(flag), 2 << 2 * i).when(~F.col(flag), 1 << 2 * i).otherwise(0)
        packed = packed + code
    return packed.cast("int")


def flag_similarity(a: ColumnLike, b: ColumnLike) -> Column:
    """How many flags two signatures agree on; a NULL flag agrees with nothing."""
    return F.bit_count(as_col(a).bitwiseAND(as_col(b))).cast("int")
