"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a value of six or more characters assigned to a telling name, in quotes up
to the closing one and otherwise up to a space, or else a run of 16 or more of the
characters keys are made of.  A text is split at its candidates, which gives each one its place and the words around it in linear time.
The forest sees its length, character transitions and classes, how much of it a
dictionary covers, the document's path and the neighbouring words.  It is fitted by
Spark ML on labelled findings and compiled into one column expression, so that texts
are scored and redacted in a single projection, without a shuffle or a user function.

Findings are labelled by rules that are sure either way and leave the rest open:
known key formats and values assigned to a telling name are secrets; plain words,
numbers and paths are not.  A key of a known format scores 1 whatever the forest says.
A value given to a telling name is a secret unless trees that see neither name nor sign
clearly doubt it (a score under ``DOUBT``): from the values of all labels they learn which
are words of a kind.  The rest is the forest's alone.  At most ``per_label`` findings of each label
are learnt from, those with the smallest hashes; all documents are scanned for them.

Defined results: null and empty texts have no candidates; a null path is an empty one;
repeated rows are scanned one by one, and learnt from once; if findings of either label are missing, the
rules alone decide; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import let, named, smallest_hashes

#: Score of the trees without BLIND under which a value given to a telling name is no secret.
DOUBT = 0.25
#: Documents with a secret that are known to all tasks; beyond, all texts are cut anew.
MARKED = 1_000_000
#: Characters of context before and after a candidate.
BEFORE, AFTER = 48, 16

# Formats of issued keys, telling names, names of test folders, and the
# dictionary, common words and word parts of the languages at hand.
KEY_FORMAT = (
    r"(?<![A-Za-z0-9])(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}"
    r"|AIza[0-9A-Za-z_\-]{35}|xox[abprs]-[0-9A-Za-z\-]{10,}|sk_live_[0-9A-Za-z]{16,})"
    r"(?![A-Za-z0-9])"
)
# Not the words author, authentic, tokenizer and secretary, which go on with other letters.
NAME = (
    r"(?:token(?!i[sz])|secret(?!ar)|passwd|password|pwd|api_?key|access_?key"
    r"|auth(?!or(?!i)|entic(?!at))|credential)"
)
NAMED = rf"(?i){NAME}\w*\W{{0,6}}$"
ASSIGNED = r"[=:]>?\s*[\"']?$"
# Lookbehinds need a bound, and the cheap ones come first: it is these that most places fail.
_AFTER_NAME = (
    r"(?<=[=:>\"' \t])(?<=[=:]>?[ \t]{0,4}[\"']?)"
    rf"(?<=(?i:{NAME})\w{{0,24}}[^\w\n]{{0,6}})"
)
_QUOTED = r"(?<=\")[^\s\"]{6,}+(?=\")|(?<=')[^\s']{6,}+(?=')"
# Signs that end a sentence, a call, a tag or a parameter of an address are not of the value.
_ENDS = r"[.,;)\]}&<]"
_BARE = (
    rf"(?=[^\s\"'.,;)\]}}&<]{{6}}|[^\s\"']{{9}})"
    rf"(?:[^\s\"'.,;)\]}}&<]++|{_ENDS}(?!{_ENDS}{{0,3}}(?:[\s\"']|$)|\w{{1,30}}[=:]|/))++"
)
CANDIDATE = rf"{_AFTER_NAME}(?:{_QUOTED}|{_BARE})|[A-Za-z0-9+/_\-]{{16,}}"
# Calls, parts of objects and references to variables, as code assigns them.
CODE = (
    r"^[A-Za-z_][\w.]*[(\[]|^[A-Za-z_]\w{0,19}(\.[A-Za-z_]\w{0,19})+$"
    r"|^\$?\{+[\w.:\-]+\}*$|^\$[A-Z_][A-Z0-9_]*$|^\$\(|^<.*>?$|^%.*%$"
)
TEST_PATH = r"(?i)(test|example|sample|mock|fixture|demo)"
DICTIONARY = (
    "the and ing tion ent for that with ment able ness ough ight our ous ist ver ion "
    "der die und ung heit keit lich sch ein ich ach ge be zu auf aus "
    "que les des ent eur elle eau aux ier ais ons est pour dans "
    "cion los las ado ando iento mente dad para con por"
).split()

FEATURES = (
    "length",
    "digits",
    "uppers",
    "signs",
    "class_changes",
    "case_changes",
    "distinct",
    "hex",
    "vowels",
    "dictionary",
    "named",
    "assigned",
    "quoted",
    "test_path",
    "slashes",
    "words_before",
)


#: What shows that a value was given to a name; trees that check such labels do not see it.
BLIND = ("named", "assigned", "quoted", "words_before")
#: Dictionary coverage from which a value without a telling name is words and no key.
WORDY = 0.6


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _flag(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(0.0)


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    """The features of one candidate as a struct of doubles."""
    n = F.length(value)

    def without(chars: str, s: Column = value) -> Column:
        return F.length(s) - F.length(F.translate(s, chars, ""))

    parts = "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))
    words = F.filter(F.split(before, r"\s+"), lambda w: w != "")
    columns = {
        "length": n.cast("double"),
        "digits": _share(without("0123456789"), n),
        "uppers": _share(without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n),
        "signs": _share(without("+/_-"), n),
        "class_changes": _share(
            F.regexp_count(value, F.lit(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")), n - 1
        ),
        "case_changes": _share(F.regexp_count(value, F.lit(r"[a-z](?=[A-Z])|[A-Z](?=[a-z])")), n - 1),
        "distinct": _share(F.size(F.array_distinct(F.split(value, ""))), n),
        "hex": _flag(value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$")),
        "vowels": _share(without("aeiouAEIOU"), n),
        "dictionary": _share(n - F.length(F.regexp_replace(F.lower(value), parts, "")), n),
        "named": _flag(before.rlike(NAMED)),
        "assigned": _flag(before.rlike(ASSIGNED)),
        "quoted": _flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
        "test_path": _flag(path.rlike(TEST_PATH)),
        "slashes": _share(without("/"), n),
        "words_before": _share(
            F.size(F.filter(words, lambda w: w.rlike(r"^\p{L}+[.,;:!?]?$"))), F.size(words)
        ),
    }
    return F.struct(*[columns[name].alias(name) for name in FEATURES])


def rule_label(value: Column, f: Column) -> Column:
    """1: surely a secret; 0: surely none; null: open."""
    mixed = (f["digits"] > 0) & (f["digits"] < 1)
    given = (f["named"] == 1) & (f["assigned"] == 1)
    # Letters that change their case at random: no word, and no name joined of words.
    scrambled = (f["length"] >= 16) & (f["digits"] == 0) & (f["case_changes"] >= 0.4)
    literal = (f["slashes"] == 0) & ~value.rlike(CODE)
    return (
        F.when(value.rlike(KEY_FORMAT), 1.0)
        .when(given & (mixed | scrambled) & literal, 1.0)
        .when((f["digits"] == 0) & ~given, 0.0)
        .when(f["digits"] == 1, 0.0)
        .when((f["slashes"] > 0.1) & ~given, 0.0)
        .when((f["dictionary"] >= WORDY) & (f["named"] == 0), 0.0)
    )


def _running(lengths: Column) -> Column:
    """Running sums of an array of ints, in blocks: appending to long arrays is slow."""
    block, none = 512, F.array().cast("array<int>")

    def within(some: Column, base: Column) -> Column:
        return F.aggregate(
            some,
            F.struct(none.alias("sums"), base.alias("end")),
            lambda acc, n: F.struct(
                F.concat(acc["sums"], F.array(acc["end"] + n)).alias("sums"),
                (acc["end"] + n).alias("end"),
            ),
        )

    def over(acc: Column, k: Column) -> Column:
        return let(
            within(F.slice(lengths, k * block + 1, F.lit(block)), acc["end"]),
            lambda w: F.struct(
                F.concat(acc["blocks"], F.array(w["sums"])).alias("blocks"), w["end"].alias("end")
            ),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.floor(F.size(lengths) / block).cast("int")),
        F.struct(F.array().cast("array<array<int>>").alias("blocks"), F.lit(0).alias("end")),
        over,
        lambda acc: F.flatten(acc["blocks"]),
    )


def scan(
    text: Column, path: Column, result: Callable[[Column, Column, Column, Column], Column]
) -> Column:
    """``result(pieces, values, found, starts)`` of a text, or what it gives without any.

    ``values`` are the candidates and ``pieces`` what lies between; ``found`` are their
    structs (value, features), ``starts`` their places in code points.
    """
    text = F.coalesce(text, F.lit(""))
    path = F.coalesce(path, F.lit(""))

    def with_values(values: Column) -> Column:
        # Without a candidate there is nothing to split.
        cut = F.when(F.size(values) > 0, F.split(text, CANDIDATE, -1)).otherwise(F.array(text))

        def with_pieces(pieces: Column) -> Column:
            found = F.transform(
                values,
                lambda v, k: F.struct(
                    v.alias("value"),
                    let(
                        F.struct(
                            # A long name may be a candidate itself: look back beyond one.
                            F.right(
                                F.concat(F.coalesce(F.get(values, k - 1), F.lit("")), F.get(pieces, k)),
                                F.lit(BEFORE),
                            ).alias("before"),
                            F.left(F.get(pieces, k + 1), F.lit(AFTER)).alias("after"),
                        ),
                        lambda c: features(v, c["before"], c["after"], path),
                    ).alias("f"),
                ),
            )
            behind = F.transform(
                values, lambda v, k: F.length(F.get(pieces, k)) + F.length(v)
            )
            ends = let(behind, _running)
            starts = F.transform(ends, lambda e, k: e - F.length(F.get(values, k)))
            return result(pieces, values, found, starts)

        return let(cut, with_pieces)

    return let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), with_values)


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """A row per candidate: id, key of the text, start, value, features ``f``, rule ``label``."""
    found = scan(
        named(text_col),
        named(path_col),
        lambda pieces, values, found, starts: F.arrays_zip(
            found.alias("c"), starts.alias("start")
        ),
    )
    key = F.xxhash64(named(text_col))
    rows = docs.select(named(id_col).alias("id"), key.alias("key"), F.explode(found).alias("x"))
    return rows.select(
        "id",
        "key",
        F.col("x")["start"].alias("start"),
        F.col("x")["c"]["value"].alias("value"),
        F.col("x")["c"]["f"].alias("f"),
        rule_label(F.col("x")["c"]["value"], F.col("x")["c"]["f"]).alias("label"),
    )


class Forest:
    """A fitted forest as a column expression over a struct of features."""

    def __init__(self, trees: list[tuple], blind_trees: Sequence[tuple] = ()):
        self.trees, self.blind_trees = trees, blind_trees

    def score(self, value: Column, f: Column) -> Column:
        """Probability of a secret; without trees, what the rules say."""
        if not self.trees:
            return F.coalesce(rule_label(value, f), F.lit(0.0))
        return self._mean(self.trees, f)

    @staticmethod
    def _mean(trees: Sequence[tuple], f: Column) -> Column:
        def walk(node: tuple) -> Column:
            if len(node) == 1:
                return F.lit(node[0])
            feature, threshold, low, high = node
            return F.when(f[FEATURES[feature]] <= threshold, walk(low)).otherwise(walk(high))

        total = walk(trees[0])
        for tree in trees[1:]:
            total = total + walk(tree)
        return total / len(trees)

    def judged(self, value: Column, f: Column, threshold: float) -> Column:
        """The score that counts: formats are sure, telling names as long as it does not doubt."""
        score = self.score(value, f)
        if not self.trees:
            return score
        given = rule_label(value, f) == 1
        doubt = self._mean(self.blind_trees, f)
        return (
            F.when(value.rlike(KEY_FORMAT), 1.0)
            .when(given & (doubt < DOUBT), doubt)
            .when(given, F.greatest(score, F.lit(float(threshold))))
            .otherwise(score)
        )


def _tree(node, at: Sequence[int] = range(len(FEATURES))) -> tuple:
    """A JVM node as nested tuples: (probability,) or (feature, threshold, low, high).

    ``at`` gives the feature of each place in the vectors.
    """
    if node.getClass().getSimpleName() == "LeafNode":
        counts = list(node.impurityStats().stats())
        return (counts[1] / sum(counts),)
    split = node.split()
    low, high = _tree(node.leftChild(), at), _tree(node.rightChild(), at)
    return (at[split.featureIndex()], split.threshold(), low, high)


def fit_forest(
    findings: DataFrame, per_label: int = 5000, trees: int = 20, depth: int = 5, seed: int = 7
) -> Forest:
    """A forest over labelled findings (columns id, start, value, f, label)."""
    labelled = findings.where(F.col("label").isNotNull()).withColumn(
        "h", F.xxhash64("value", "id", "start")
    )
    below = [
        (F.col("label") == label) & (F.lit(True) if h is None else F.col("h") < h)
        for label, h in smallest_hashes(labelled, "label", "h", per_label).items()
    ]
    # Rows that repeat a finding have its hash: they are one.
    chosen = (
        labelled.where(reduce(or_, below, F.lit(False)))
        .groupBy("label", "h")
        .agg(F.min("f").alias("f"))
    )
    # At most twice per_label rows: one sorted partition makes the forest repeatable.
    sample = stage(
        chosen.select("label", "f.*", "h").repartition(1).sortWithinPartitions("label", "h").drop("h"),
        "findings",
    )
    if sample.select("label").distinct().count() < 2:
        return Forest([])

    def fitted(names: list[str]) -> list[tuple]:
        vectors = VectorAssembler(inputCols=names, outputCol="features").transform(sample)
        model = RandomForestClassifier(
            labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxBins=32
        ).fit(vectors)
        return [_tree(t._call_java("rootNode"), [FEATURES.index(n) for n in names]) for t in model.trees]

    return Forest(fitted(list(FEATURES)), fitted([n for n in FEATURES if n not in BLIND]))


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
    threshold: float = 0.5,
    per_label: int = 5000,
) -> DataFrame:
    """Every candidate: id, start (code points before it), value, score, is_secret."""
    findings = stage(candidates(docs, id_col, text_col, path_col), "findings")
    forest = fit_forest(findings, per_label)
    score = forest.judged(F.col("value"), F.col("f"), threshold)
    return findings.select(
        F.col("id").alias(id_col), "start", "value", F.round(score, 6).alias("score")
    ).withColumn("is_secret", F.col("score") >= threshold)


def redact(
    text: Column, path: Column, forest: Forest, threshold: float = 0.5, mark: str = "[SECRET]"
) -> Column:
    """A text with its secrets replaced; null stays null."""

    def joined(pieces: Column, values: Column, found: Column, starts: Column) -> Column:
        shown = F.transform(
            found,
            lambda c: F.when(
                F.round(forest.judged(c["value"], c["f"], threshold), 6) >= threshold, F.lit(mark)
            ).otherwise(c["value"]),
        )
        return F.array_join(
            F.transform(pieces, lambda p, k: F.concat(p, F.coalesce(F.get(shown, k), F.lit("")))), ""
        )

    return F.when(text.isNotNull(), scan(text, path, joined))


def redact_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
    size_col: str = "n_chars",
    per_label: int = 5000,
) -> DataFrame:
    """``docs``, all columns, with secrets replaced in texts and ``size_col`` to match.

    Only texts with a secret are cut again, known by id and a hash of the text; if there
    are more than ``MARKED`` of them, all are.  The size of a text without secrets stays
    as it is.
    """
    findings = stage(candidates(docs, id_col, text_col, path_col), "findings")
    forest = fit_forest(findings, per_label)
    is_secret = F.round(forest.judged(F.col("value"), F.col("f"), 0.5), 6) >= 0.5
    marked = stage(
        findings.where(is_secret).select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct(),
        "marked",
    )
    text, shown = named(text_col), F.col("__shown")
    cut = redact(text, named(path_col), forest)
    if marked.count() <= MARKED:
        same = named(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__key"))
        docs_marked = docs.join(F.broadcast(marked), same, "left")
        cut = F.when(F.col("__key").isNotNull(), cut).otherwise(text)
    else:
        docs_marked = docs
    clean = docs_marked.withColumn("__shown", cut)
    new = {text_col: shown}
    if size_col in docs.columns:
        kind = docs.schema[size_col].dataType
        new[size_col] = F.when(shown != text, F.length(shown).cast(kind)).otherwise(named(size_col))
    return clean.select(*[new[c].alias(c) if c in new else named(c) for c in docs.columns])
