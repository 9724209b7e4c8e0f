import pytest

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, id string, key string,"
    " score string, start string, length string, kept string, n_words string, component string"
)


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with further columns named like results."""

    def make(pairs, lang="en", source="src"):
        extra = ("x",) * 8
        rows = [(i, t, lang, source, None if t is None else len(t), *extra) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture
def strange():
    """Texts that tend to break things, under ids from 1."""
    words = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one"),
        (5, "the same text of a few words is here\nand a second line"),
        (6, "the same text of a few words is here\nand a second line"),
        (6, "the same text of a few words is here\nand a second line"),
        (7, "日本語 \U0001f600 naïve ÉCOLE \x00   'll  \r\n\x0b\x0c end"),
        (8, words),
        (9, "x" * 50_000),
        (None, "a row without an id"),
        (10, "#*$%&|<> !!! ... ??? <|endoftext|> <|im_end|>"),
    ]
