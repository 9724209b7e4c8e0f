"""Main texts of web pages, by templates deduced from the pages of a host.

A page is a row of tokens: tags and texts, each with its path of elements.  A token's
occurrence vector says how often each page of the host has it.  Tokens with equal vectors
that occur together in many pages are an equivalence class: they come from the template,
not from the data.  A class is valid if its tokens keep one order in the pages; valid
classes are nested into one another, and what lies between their tokens are the slots.
The main text is what remains in the slots within the template's articles; on pages that
name none, what remains in all slots but those around a main text and lists of links.

Three scans of the pages, none of which gathers a host:

1. Every page adds one hash of (page, count) per token; the sums are the fingerprints of
   the occurrence vectors, added up in tasks before they are shuffled.
2. Each page says for each class of its host whether it keeps the order.
3. Each page is cut at the tokens of the nested classes.

A host's template has a bounded size: a token of it is in ``share`` of the pages, so it
has at most 1 / share times the tokens of a mean page, however many pages there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import map_arrow
from .markup import ARTICLE, MAIN, OUT, PLAIN, Page, joined, parse

#: Least pages and share of a host's pages that have a class, and least tokens of one.
LEAST_PAGES, SHARE, LEAST_TOKENS = 3, 0.25, 3
#: Text within an article is the template's only if nearly all of so many pages have it.
SURE_PAGES, SURE_SHARE = 10, 0.9
#: A class is valid if so many of its pages keep its order.
ORDERLY = 0.95
#: Tokens of templates that are broadcast: some 16 MB.  Beyond, the join shuffles.
BROADCAST_TOKENS = 1_000_000
#: Partial sums a task holds before it hands them on.
HELD = 100_000

VECTORS = (
    "host string, token long, pages long, vector decimal(38,0), place decimal(38,0),"
    " low long, high long"
)
#: Stands for the page itself among its tokens: every page has it once.
PAGE = 0


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(host, F.lit(""))


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _counts(page: Page) -> dict[int, tuple[int, int]]:
    """Of each token its count and first place."""
    found: dict[int, tuple[int, int]] = {}
    for place, token in enumerate(page.tokens):
        count, first = found.get(token, (0, place))
        found[token] = (count + 1, first)
    return found


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """Per host and token: pages, the vector's fingerprint, the sum of first places.

    ``low`` and ``high`` are equal if all the pages are copies of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}

        def drain() -> pa.RecordBatch:
            rows = [(h, _signed(t), v[0], Decimal(v[1]), Decimal(v[2]), v[3], v[4]) for (h, t), v in held.items()]
            held.clear()
            kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.decimal128(38, 0)] * 2, pa.int64(), pa.int64()]
            names = [c.split()[0] for c in VECTORS.split(", ")]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = xxhash.xxh3_64_intdigest((html or "").encode("utf-8", "replace")) >> 1
                marks: dict[int, int] = {}
                for token, (count, first) in [(PAGE, (1, 0)), *_counts(parse(html)).items()]:
                    if count not in marks:
                        marks[count] = xxhash.xxh3_64_intdigest(f"{key} {count}".encode()) >> 4
                    sums = held.get((host, token))
                    if sums is None:
                        held[host, token] = [1, marks[count], first, key, key]
                    else:
                        sums[0] += 1
                        sums[1] += marks[count]
                        sums[2] += first
                        sums[3] = min(sums[3], key)
                        sums[4] = max(sums[4], key)
                if len(held) >= HELD:
                    yield drain()
        if held:
            yield drain()

    added = map_arrow(pages.select("host", "html"), run, VECTORS).groupBy("host", "token")
    return added.agg(
        *[F.sum(c).alias(c) for c in ("pages", "vector", "place")],
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def equivalence_classes(vectors: DataFrame, least_pages: int, share: float) -> DataFrame:
    """Tokens of equal vectors: host, number, pages, everywhere, tokens in their order."""
    frequent = stage(
        vectors.where((F.col("pages") >= least_pages) & (F.col("low") < F.col("high"))), "tokens"
    )
    hosts = frequent.where(F.col("token") == PAGE).select("host", F.col("pages").alias("of_host"))
    grouped = (
        frequent.where(F.col("token") != PAGE)
        .join(hosts, "host")
        .where(F.col("pages") >= F.col("of_host") * share)
        .groupBy("host", "vector", "pages", "of_host")
        # Bounded by 1 / share times the tokens of a mean page.
        .agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("placed"))
    )
    return grouped.where(F.size("placed") >= LEAST_TOKENS).select(
        "host",
        F.xxhash64("vector", "pages").alias("number"),
        "pages",
        (
            (F.col("pages") >= F.col("of_host") * SURE_SHARE) & (F.col("of_host") >= SURE_PAGES)
        ).alias("everywhere"),
        F.transform("placed", lambda p: p["token"]).alias("tokens"),
    )


def _with_templates(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """``pages`` with the classes of their host, widest spread first; null if none."""
    parts = F.struct(
        (-F.col("pages")).alias("rarity"),
        (-F.size("tokens")).alias("smallness"),
        "number",
        "everywhere",
        "tokens",
    )
    by_host = classes.groupBy("host").agg(F.sort_array(F.collect_list(parts)).alias("classes"))
    size = classes.agg(F.sum(F.size("tokens"))).first()[0] or 0
    return pages.join(F.broadcast(by_host) if size <= BROADCAST_TOKENS else by_host, "host", "left")


def _ordered(tokens: list[int], found: dict[int, tuple[int, int]]) -> list[int] | None:
    """The first places of a class's tokens if the page has them, equally often, in order."""
    places = [found[t] for t in tokens if t in found]
    if len(places) != len(tokens) or len({count for count, _ in places}) > 1:
        return None
    firsts = [first for _, first in places]
    return firsts if all(a < b for a, b in zip(firsts, firsts[1:], strict=False)) else None


def valid_classes(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes whose tokens stand in one order in nearly all pages that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orderly: dict[tuple[str, int], int] = {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for host, html, given in zip(*columns, strict=True):
                found = {_signed(t): x for t, x in _counts(parse(html)).items()} if given else {}
                for c in given or ():
                    if _ordered(c["tokens"], found) is not None:
                        at = (host, c["number"])
                        orderly[at] = orderly.get(at, 0) + 1
        if orderly:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in orderly], pa.string()),
                    pa.array([n for _, n in orderly], pa.int64()),
                    pa.array(list(orderly.values()), pa.int64()),
                ],
                names=["host", "number", "orderly"],
            )

    joined_up = _with_templates(pages.select("host", "html"), classes)
    seen = map_arrow(joined_up.where("classes is not null"), run, "host string, number long, orderly long")
    counted = seen.groupBy("host", "number").agg(F.sum("orderly").alias("orderly"))
    return classes.join(counted, ["host", "number"]).where(F.col("orderly") >= F.col("pages") * ORDERLY)


def nested(classes: list[dict], page: Page) -> tuple[set[int], set[int]]:
    """The template on one page: all its tokens, and those that nearly every page has.

    Classes come widest spread first.  One fits if its tokens stand in their order, and
    lie in one gap of every class taken before, or around all of it.
    """
    found = {_signed(t): x for t, x in _counts(page).items()}
    taken: list[np.ndarray] = []
    tokens: set[int] = set()
    everywhere: set[int] = set()
    for c in classes:
        firsts = _ordered(c["tokens"], found)
        if firsts is None:
            continue
        crossed = False
        for other in taken:
            gaps = np.searchsorted(other, [firsts[0], firsts[-1]])
            if gaps[0] != gaps[1]:
                inner = np.searchsorted(firsts, [other[0], other[-1]])
                crossed |= bool(inner[0] != inner[1])
        if crossed and found[c["tokens"][0]][0] == 1:
            continue
        taken.append(np.array(firsts))
        tokens.update(c["tokens"])
        if c["everywhere"]:
            everywhere.update(c["tokens"])
    return tokens, everywhere


def main_text(page: Page, classes: list[dict] | None) -> str:
    """What remains of a page in the slots of its main text."""
    template, everywhere = nested(classes or [], page)
    tokens = [_signed(t) for t in page.tokens]
    inside = [r for r in page.runs if r.standing != OUT]
    best = max((r.standing for r in inside if r.text.strip()), default=PLAIN)
    if best in (MAIN, ARTICLE):
        inside = [r for r in inside if r.standing == best]
        # Words that all pages of a host say in their articles are notices.
        data = {r.block for r in inside if r.text.strip() and tokens[r.token] not in everywhere}
        return joined([r for r in inside if r.block in data])
    # A block stays whole if any of it is data.
    said = [r for r in inside if r.text.strip()]
    data = {r.block for r in said if tokens[r.token] not in template}
    slot_of, slot = [], 0
    for t in tokens:
        slot += t in template
        slot_of.append(slot)
    chars: dict[int, list[int]] = {}
    for r in said:
        if tokens[r.token] not in template:
            chars.setdefault(slot_of[r.token], [0, 0])[r.linked] += len(r.text)
    links = {s for s, (plain, linked) in chars.items() if linked > plain}
    listed = {r.block for r in said if r.linked and slot_of[r.token] in links}
    return joined([r for r in inside if r.block in data - listed])


def extract_main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_pages: int = LEAST_PAGES,
    share: float = SHARE,
) -> DataFrame:
    """Per page: id, URL, text and n_chars, its code points.

    Text decodes character references; white space in a block is one space, blocks are
    joined by one.  Defined results: null and empty pages have an empty text; pages
    without a host in their URL, or without a URL, share the template of those; hosts of
    fewer than ``least_pages`` pages, or of copies only, have no template and their
    pages are one slot; repeated rows are extracted one by one; an empty table gives an
    empty one; further columns are not read.
    """
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{url_col}`").alias("url"),
        F.col(f"`{html_col}`").alias("html"),
        host_of(F.col(f"`{url_col}`")).alias("host"),
    )
    classes = stage(equivalence_classes(occurrence_vectors(rows), least_pages, share), "classes")
    valid = stage(valid_classes(rows, classes), "valid_classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(parse(html), given)
                for html, given in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["id", "url", "text", "n_chars"],
            )

    out = map_arrow(
        _with_templates(rows, valid).select("id", "url", "html", "classes"),
        run,
        f"id {id_type}, url {url_type}, text string, n_chars long",
    )
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
