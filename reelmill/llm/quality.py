"""Quality rules: a threshold table compiled into one projection.

Everything is a built-in expression over one row: no shuffle, no user function.  The
measures are computed once per row in nested ``transform`` bindings, and the rules
are comparisons of measures, folded into one boolean.

Defined results: a null text counts as an empty one, which fails the base rules; an
empty table gives an empty result; repeated rows are judged one by one; only the
id and text columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as was by at an are this from or "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur "
    "el y los se del las por con no su para es al lo como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only if ``low <= 100 * part / whole <= high``; no whole, no verdict."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None


#: Length, symbol, stop-word and line ratios, in hundredths.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=50),
    Rule("stop_words", "n_stop_words", "n_words", low=2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90),
    Rule("cut_lines", "n_cut_lines", "n_lines", high=30),
)


def _repeated_words(words: Column, width: int) -> Column:
    """Words lying in a window of ``width`` words that the text has twice or more.

    Windows are compared by a 64-bit hash.  Only if two hashes agree are the
    windows sorted by hash, and neighbours compared word by word.
    """
    def window(i: Column) -> Column:
        return F.slice(words, i, F.lit(width))

    starts = F.sequence(F.lit(1), F.size(words) - (width - 1))

    def covered(at: Column) -> Column:
        # at: ascending starts of repeated windows; each adds what the last left over
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            at,
            zero,
            lambda acc, i: F.struct(
                (acc["n"] + F.least(F.lit(width), i + width - 1 - acc["end"])).alias("n"),
                (i + width - 1).alias("end"),
            ),
            lambda acc: acc["n"],
        )

    def among(ordered: Column) -> Column:
        def same(a: Column, j: Column) -> Column:
            b = F.get(ordered, j)
            return b.isNotNull() & (a["h"] == b["h"]) & (window(a["i"]) == window(b["i"]))

        twice = F.filter(
            ordered, lambda a, j: F.coalesce(same(a, j - 1), F.lit(False)) | F.coalesce(same(a, j + 1), F.lit(False))
        )
        return covered(F.sort_array(F.transform(twice, lambda a: a["i"])))

    def by_hash(hashes: Column) -> Column:
        numbered = F.transform(hashes, lambda h, j: F.struct(h.alias("h"), (j + 1).alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(F.sort_array(numbered), among)
        )

    hashed = F.transform(starts, lambda i: F.xxhash64(window(i)))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(let(hashed, by_hash))


def measures(text: Column) -> Column:
    """All measures of a text as one struct of longs."""
    text = F.coalesce(text, F.lit(""))

    def squeezed(s: Column) -> Column:
        return F.translate(s, SPACES, "")

    def over(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda l: squeezed(l) != "")
        def with_lines(lines: Column) -> Column:
            values = {
                "n_words": F.size(words),
                "word_chars": F.length(squeezed(text)),
                "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
                "n_lines": F.size(lines),
                "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
                "n_repeat_words": _repeated_words(words, WINDOW),
                "n_stop_words": F.size(
                    F.filter(words, lambda w: F.lower(F.translate(w, ".,;:!?", "")).isin(STOP_WORDS))
                ),
                "n_bullet_lines": F.size(F.filter(lines, lambda l: F.ltrim(l).rlike("^[-*•]"))),
                "n_cut_lines": F.size(
                    F.filter(lines, lambda l: F.rtrim(l).endswith("...") | F.rtrim(l).endswith("…"))
                ),
            }
            return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

        return let(lines, with_lines)

    return let(words_of(text), over)


def verdict(m: Column, rules: tuple[Rule, ...]) -> Column:
    """The rule table as one boolean: true if no rule speaks against the text."""
    keep = F.lit(True)
    for r in rules:
        part, whole = m[r.part] * 100, m[r.whole]
        if r.low is not None:
            keep = keep & ((whole == 0) | (part >= whole * r.low))
        if r.high is not None:
            keep = keep & ((whole == 0) | (part <= whole * r.high))
    return keep


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    min_words: int = 20,
    max_repeated_pct: int = 30,
) -> DataFrame:
    """Every document's measures, ``base_failed`` and ``kept``."""
    m = F.col("m")
    base_failed = (m["n_words"] < min_words) | (
        m["n_repeat_words"] * 100 > m["n_words"] * max_repeated_pct
    )
    return docs.select(F.col(id_col), measures(F.col(text_col)).alias("m")).select(
        id_col,
        "m.*",
        base_failed.alias("base_failed"),
        (~base_failed & verdict(m, rules)).alias("kept"),
    )
