"""Jaccard join of shingle sets by grouped prefixes.

Two documents link if their sets of word shingles have a Jaccard similarity of at least
3/4.  In any fixed order of shingles, the sets of two linked documents share one among
the first ``n // 4 + 1`` of their n shingles: their prefixes.

1. Order.  Shingles that are frequent come last, the most frequent at the very end;
   all others go by hash.  Frequent ones are counted over all documents: each block of
   texts reports those that two of its sets have, and reports are added up.  What is
   spread so thinly that no block has it twice is met in a sample of all sets by hash,
   whose shingles are counted one and all.  The order decides on work only, never on
   results, so the table of frequent shingles may hold the ``ranked`` most frequent
   ones, which bounds what tasks get a copy of; other frequent ones are marked in a
   bitmap of fixed size and come after those that are not.
2. Groups.  Documents with equal sets are a class, classes of equal size with equal
   prefixes are a group, and only groups enter the join.
3. Stars.  Among the groups that share a prefix shingle, all are paired with the
   smallest; a group keeps the pair with most common shingles.  Members of a group are
   paired with its first.  Pairs are verified on whole texts, and links make components.
4. Rest.  Only lists that still hold groups of several components are joined: what
   differs from a list's main component against all of the list.  Pairs of groups that
   pass the filters on size and common prefix shingles are expanded to their
   members of different components, and verified.  Pairs within a component need no test, so
   no link between components is lost and no group is expanded into all its pairs.

Defined results: null, empty and blank texts have no shingles and are linked with
nothing; equal sets link; rows with equal ids are one document in the graph; a null id
has no component; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import release, stage
from .common import all_of, broadcast_if_small, map_arrow, named
from .components import components
from .shingles import shingle_sets

#: Sets whose shingles are counted together.
BLOCK_SETS, BLOCK_SHINGLES = 1 << 14, 1 << 20
#: One of so many sets has all of its shingles counted.
SAMPLED = 16
#: Bits of a shingle that mark it among the frequent ones without a rank: 8 MB of marks.
MARK_BITS = 26


def prefix_length(n):
    """Of a set's n shingles, how many a linked set must share one of."""
    return n // 4 + 1


def linked(common, n, m):
    """Common shingles of sets of n and m that make 3/4 of their union."""
    return 7 * common >= 3 * (n + m)


# --- 1. order ---------------------------------------------------------------------


class Frequent(NamedTuple):
    """The most frequent shingles, rarest first, and marks of places for all others."""

    ranked: np.ndarray
    marks: np.ndarray | None

    def classes(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from shingles to their order (0: rare, 1: marked, then by rank)."""
        by_token = np.argsort(self.ranked, kind="stable")
        known = self.ranked[by_token]
        rank_of = (by_token + 2).astype(np.int64)

        def of(tokens: np.ndarray) -> np.ndarray:
            order = np.zeros(len(tokens), np.int64)
            if self.marks is not None:
                bits = len(self.marks).bit_length() + 2
                place = (tokens.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                order += self.marks[place >> 3] >> (place & 7).astype(np.uint8) & 1
            if len(known):
                at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                order = np.where(known[at] == tokens, rank_of[at], order)
            return order

        return of


def frequent_shingles(docs: DataFrame, width: int, least: int, ranked: int) -> Frequent:
    """Shingles with a count of ``least`` or more, the ``ranked`` most frequent by rank.

    Equal sets of a block count once.  Blocks count a shingle short by one for each block
    at most, where it stands alone; one of every ``SAMPLED`` sets counts all of its own,
    which counts for ``SAMPLED`` from the second one on.  So a shingle of f sets, however
    they are spread, stays uncounted with a probability of (1 + x) / e^x, x = f / SAMPLED:
    of 500 sets that is 1e-12, at any number of documents, and lists do not get longer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(sets: list[np.ndarray], sample: list[np.ndarray]) -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            found, n = found[n > 1], n[n > 1]
            few, m = np.unique(np.concatenate([found[:0], *sample]), return_counts=True)
            return pa.RecordBatch.from_pydict(
                {
                    "token": np.concatenate([found, few]),
                    "n": np.concatenate([n, np.zeros(len(few), n.dtype)]),
                    "sampled": np.concatenate([np.zeros(len(found), m.dtype), m]),
                }
            )

        seen: set[bytes] = set()
        sets, sample, size = [], [], 0
        for batch in batches:
            for tokens in shingle_sets(batch.column(0).to_pylist(), width):
                digest = hashlib.md5(tokens).digest()
                if digest in seen or not len(tokens):
                    continue
                seen.add(digest)
                sets.append(tokens)
                if int.from_bytes(digest[:4], "little") % SAMPLED == 0:
                    sample.append(tokens)
                size += len(tokens)
                if size >= BLOCK_SHINGLES or len(sets) >= BLOCK_SETS:
                    yield counted(sets, sample)
                    seen, sets, sample, size = set(), [], [], 0
        if sets:
            yield counted(sets, sample)

    estimate = F.when(F.col("sampled") > 1, F.col("sampled") * SAMPLED).otherwise(0)
    counts = stage(
        map_arrow(docs.select("text"), run, "token long, n long, sampled long")
        .groupBy("token")
        .agg(F.sum("n").alias("n"), F.sum("sampled").alias("sampled"))
        .select("token", F.greatest("n", estimate).alias("n"))
        .where(F.col("n") >= least),
        "frequent",
    )
    # The lowest count that leaves no more than ``ranked``: one row per distinct count.
    total, lowest, beyond = 0, None, False
    for n, tokens in counts.groupBy("n").agg(F.count("*")).orderBy(F.desc("n")).toLocalIterator():
        total += tokens
        if total > ranked:
            beyond = True
            break
        lowest = n
    marks = _marked(counts.where(F.col("n") < lowest) if lowest else counts) if beyond else None
    if lowest is None:
        return Frequent(np.zeros(0, np.int64), marks)
    top = counts.where(F.col("n") >= lowest).toArrow()
    tokens, n = top.column("token").to_numpy(), top.column("n").to_numpy()
    return Frequent(tokens[np.lexsort((tokens, n))].astype(np.int64), marks)


def _marked(counts: DataFrame) -> np.ndarray:
    """A bitmap of 2^MARK_BITS places with those of the given shingles' first bits set."""
    place = F.shiftrightunsigned("token", 64 - MARK_BITS) + 1  # Spark's bitmaps count from 1
    rows = (
        counts.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        .collect()  # 4 KB for each of at most 2^MARK_BITS / 32768 buckets
    )
    marks = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    for r in rows:
        bits = np.frombuffer(r["bits"], np.uint8)
        first = (r["bucket"] - 1) << 12
        marks[first : first + len(bits)] = bits[: len(marks) - first]
    return marks


# --- 2. prefixes, classes and groups ----------------------------------------------


def prefixes(docs: DataFrame, frequent: Frequent, width: int) -> DataFrame:
    """Per document: size of its set, digests of set and of (size, prefix), the prefix.

    The last ``n_hot`` shingles of a prefix are ranked ones.
    """
    id_type = docs.schema["id"].dataType.simpleString()
    def digest(data: bytes) -> tuple[int, int]:
        a, b = np.frombuffer(hashlib.md5(data).digest(), np.int64).tolist()
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = frequent.classes()
        for batch in batches:
            sizes, whole, group, first, hot = [], [], [], [], []
            for tokens in shingle_sets(batch.column(1).to_pylist(), width):
                n = len(tokens)
                rank = classes(tokens)
                order = np.argsort(rank, kind="stable")[: prefix_length(n) if n else 0]
                prefix = tokens[order]
                sizes.append(n)
                whole.append(digest(tokens.tobytes()))
                group.append(digest(n.to_bytes(8, "little") + prefix.tobytes()))
                first.append(prefix)
                hot.append(int(np.count_nonzero(rank[order] > 1)))
            ends = np.cumsum([0, *map(len, first)], dtype=np.int64)
            flat = np.concatenate([np.zeros(0, np.int64), *first])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([w[0] for w in whole], pa.int64()),
                    pa.array([w[1] for w in whole], pa.int64()),
                    pa.array([g[0] for g in group], pa.int64()),
                    pa.array([g[1] for g in group], pa.int64()),
                    pa.array(hot, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
                ],
                names=["id", "n", "set_a", "set_b", "grp_a", "grp_b", "n_hot", "prefix"],
            )

    return map_arrow(
        docs.select("id", "text"),
        run,
        f"id {id_type}, n long, set_a long, set_b long, grp_a long, grp_b long, n_hot long,"
        " prefix array<long>",
    )


def index_lists(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (token, gid, n, at, lead, lead_n): a prefix shingle of a group, its place, and
    the smallest group that has it, for shingles that several groups have.

    Lists of frequent shingles are never brought together: their smallest group is a
    partial aggregate that is broadcast, a row per ranked shingle.  Other lists are
    short: what could make a long one is counted as frequent (:func:`frequent_shingles`),
    and put behind all else in every prefix even if it has no rank.
    """
    leaders = broadcast_if_small(groups.select("gid"))
    rows = keyed.join(leaders, keyed["id"] == leaders["gid"], "left_semi").select(
        F.col("id").alias("gid"),
        F.col("n").cast("int").alias("n"),
        (F.size("prefix") - F.col("n_hot")).alias("n_cold"),
        F.posexplode("prefix").alias("at", "token"),
    )
    own = F.struct("gid", "n")
    per_token = Window.partitionBy("token")
    cold = (
        rows.where("at < n_cold")
        .select("token", "gid", "n", "at")
        .withColumn("lead", F.min(own).over(per_token))
        .withColumn("last", F.max("gid").over(per_token))
        .where(F.col("lead.gid") != F.col("last"))
        .drop("last")
    )
    hot = rows.where("at >= n_cold").select("token", "gid", "n", "at")
    leads = hot.groupBy("token").agg(F.min(own).alias("lead"), F.max("gid").alias("last"))
    hot = hot.join(F.broadcast(leads.where(F.col("lead.gid") != F.col("last")).drop("last")), "token")
    columns = ["token", "gid", "n", "at", F.col("lead.gid").alias("lead"), F.col("lead.n").alias("lead_n")]
    return cold.select(*columns).unionByName(hot.select(*columns))


# --- pairs ------------------------------------------------------------------------


def size_filter(n: Column, m: Column) -> Column:
    return F.least(n, m) * 4 >= F.greatest(n, m) * 3


def _beyond(n: Column) -> Column:
    """Shingles that do not belong to the prefix."""
    return n - F.floor(n / 4) - 1


def common_filter(common: Column, n: Column, m: Column) -> Column:
    """Common prefix shingles, and all beyond the prefix of one of the two, may suffice."""
    return (common + F.greatest(_beyond(n), _beyond(m))) * 7 >= (n + m) * 3


def verified(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Those of the pairs (a, b) of documents whose whole texts link.

    Only texts that a pair names are shuffled, once for each pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, np.zeros(0, np.int64)
        for batch in batches:
            keep = []
            right = batch.column(3).to_pylist()
            for k, tokens in enumerate(shingle_sets(batch.column(2).to_pylist(), width)):
                if right[k] != last:
                    last, last_set = right[k], next(shingle_sets([right[k]], width))
                common = len(np.intersect1d(tokens, last_set, assume_unique=True))
                if len(tokens) and linked(common, len(tokens), len(last_set)):
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64())).select([0, 1])

    pairs = stage(pairs.select("a", "b").distinct(), "pairs")
    ids = stage(pairs.select(F.col("b").alias("id")).distinct(), "pair_ids")
    left = docs.join(broadcast_if_small(pairs), docs["id"] == pairs["a"]).select(
        "a", "b", F.col("text").alias("left")
    )
    right = docs.join(broadcast_if_small(ids), "id", "left_semi").select(
        F.col("id").alias("b"), F.col("text").alias("right")
    )
    id_type = docs.schema["id"].dataType.simpleString()
    both = left.join(right, "b").select("a", "b", "left", "right")
    return map_arrow(both, run, f"a {id_type}, b {id_type}").distinct()


def star_pairs(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Each group with the smallest group of one of its lists; each class with its group."""
    best = (
        lists.where("gid <> lead")
        .groupBy("gid", "n", "lead", "lead_n")
        .agg(F.count("*").alias("common"))
        .where(size_filter(F.col("n"), F.col("lead_n")))
        .where(common_filter(F.col("common"), F.col("n"), F.col("lead_n")))
        .groupBy("gid")
        .agg(F.max_by("lead", F.struct("common", "lead")).alias("lead"))
    )
    members = classes.where("cls <> gid").select(F.col("cls").alias("a"), F.col("gid").alias("b"))
    return best.select(F.col("gid").alias("a"), F.col("lead").alias("b")).unionByName(members)


def rest_pairs(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes of different components that may link.

    ``classes``: cls, gid, n, component.  What the prefixes of two groups of different
    components have in common lies in lists that hold several components.  Of the rows of
    such a list only those are joined from which on both groups have enough of such
    prefix shingles left: the first one that two linked groups share is among them.
    """
    groups = stage(
        classes.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high")),
        "group_components",
    )
    listed = lists.select("token", "gid", "n", "at").join(groups, "gid")
    mixed = (
        listed.groupBy("token")
        .agg(F.min("low").alias("least"), F.max("high").alias("most"))
        .where("least <> most")
        .select("token")
    )
    # A group has at most as many rows as its prefix.
    own = Window.partitionBy("gid")
    listed = stage(
        listed.join(mixed, "token", "left_semi").withColumn(
            "left", F.count("*").over(own) - F.row_number().over(own.orderBy("at", "token")) + 1
        ),
        "mixed_lists",
    )
    main = (
        listed.groupBy("token", "low")
        .agg(F.count("*").alias("members"))
        .groupBy("token")
        .agg(F.max_by("low", F.struct("members", "low")).alias("main"))
    )
    listed = listed.join(main, "token").withColumn(
        "minor", (F.col("low") != F.col("main")) | (F.col("high") != F.col("main"))
    )
    g, h = listed.where("minor").alias("g"), listed.alias("h")
    one_component = (
        (F.col("g.low") == F.col("g.high"))
        & (F.col("h.low") == F.col("h.high"))
        & (F.col("g.low") == F.col("h.low"))
    )
    n, m = F.col("g.n"), F.col("h.n")
    between = (
        g.join(h, F.col("g.token") == F.col("h.token"))
        .where((F.col("g.gid") < F.col("h.gid")) | (~F.col("h.minor") & (F.col("g.gid") > F.col("h.gid"))))
        .where(size_filter(n, m) & ~one_component)
        .where(common_filter(F.least("g.left", "h.left"), n, m))
        .select(F.least("g.gid", "h.gid").alias("g"), F.greatest("g.gid", "h.gid").alias("h"))
        .distinct()
    )
    within = groups.where("low <> high").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    x, y = classes.alias("x"), classes.alias("y")
    return (
        between.unionByName(within)
        .join(x, F.col("g") == F.col("x.gid"))
        .join(y, F.col("h") == F.col("y.gid"))
        .where(F.col("x.component") != F.col("y.component"))
        .select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))
        .distinct()
    )


# --- the operator -----------------------------------------------------------------


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    least: int = 50,
    ranked: int = 500_000,
) -> DataFrame:
    """Per document: id, n_shingles, component_id (the smallest id reachable by links)."""
    docs = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    frequent = frequent_shingles(docs, width, least, ranked)
    keyed = stage(prefixes(docs, frequent, width), "prefixes")

    classes = (
        keyed.where("n > 0 and id is not null")
        .groupBy("set_a", "set_b")
        .agg(F.min("id").alias("cls"), *[F.first(c).alias(c) for c in ("n", "grp_a", "grp_b")])
    )
    grouped = classes.groupBy("grp_a", "grp_b").agg(F.min("cls").alias("gid"))
    classes = stage(
        classes.join(grouped, ["grp_a", "grp_b"]).select("cls", "gid", "n", "set_a", "set_b"),
        "classes",
    )
    copies = (
        keyed.where("n > 0 and id is not null")
        .select("id", "set_a", "set_b")
        .join(classes.select("cls", "set_a", "set_b"), ["set_a", "set_b"])
        .where("id <> cls")
        .select(F.col("id").alias("a"), F.col("cls").alias("b"))
    )

    release(docs.sparkSession)
    lists = stage(index_lists(keyed, classes.where("cls = gid")), "lists")
    release(docs.sparkSession)
    stars = stage(star_pairs(lists, classes), "star_pairs")
    links = copies.unionByName(verified(docs, stars, width))
    found = components(links)

    placed = stage(
        classes.join(found, F.col("cls") == F.col("node"), "left").select(
            "cls", "gid", "n", F.coalesce("component", "cls").alias("component")
        ),
        "placed",
    )
    release(docs.sparkSession)
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = rest_pairs(lists, placed).join(tested, ["a", "b"], "left_anti")
    more = stage(verified(docs, rest, width), "more_links")
    release(docs.sparkSession)
    if not more.isEmpty():
        found = components(
            found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        )
    return (
        keyed.select("id", "n")
        .join(found, F.col("id") == F.col("node"), "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each component: that of smallest id.

    Copies of a row are one document.  Where ids are repeated with different texts, a
    document is an id with a hash of its text, and goes only if that text links with one
    of a smaller id, or a smaller hash under the same id.  Documents without words, and
    rows without an id, are linked with nothing and stay.
    """
    key = F.xxhash64(named(text_col))
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), key.alias("key"))
    repeated = stage(
        rows.where("id is not null")
        .groupBy("id")
        .agg(F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
        .where("rows > 1"),
        "repeated",
    )
    plain = repeated.where("low <> high").isEmpty()
    # A struct orders and joins like the id it starts with.
    one = "id" if plain else F.when(F.col("id").isNotNull(), F.struct("id", "key")).alias("id")
    found = stage(jaccard_components(rows.select(one, "text"), "id", "text"), "components")
    gone = stage(found.where("id <> component_id").select(F.col("id").alias("__gone")).distinct(), "gone")
    release(docs.sparkSession)
    mine = named(id_col)
    if not plain:
        mine = F.when(mine.isNotNull(), F.struct(mine.alias("id"), key.alias("key")))
    left = docs.join(broadcast_if_small(gone), mine == F.col("__gone"), "left_anti")
    if repeated.isEmpty():
        return left
    again = broadcast_if_small(repeated.select(F.col("id").alias("__again")))
    worded = F.regexp_like(F.coalesce(named(text_col), F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]"))
    twice = left.join(again, named(id_col) == F.col("__again"), "left_semi").where(worded)
    rest = left.join(again, named(id_col) == F.col("__again"), "left_anti")
    bare = left.join(again, named(id_col) == F.col("__again"), "left_semi").where(~worded)
    # One of the rows of a document: the smallest one, so that a rerun keeps the same.
    whole = F.struct(*all_of(docs)).alias("__row")
    several = (
        twice.groupBy(named(id_col).alias("__id"), key.alias("__key")).agg(F.min(whole).alias("__row"))
    )
    several = several.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
    return rest.unionByName(bare).unionByName(several)
