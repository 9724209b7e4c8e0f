"""The Jaccard join against all pairs, and components against a plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs, strange  # noqa: F401
from reelmill.llm import jaccard
from reelmill.llm.components import components
from reelmill.llm.shingles import shingle_sets


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def all_pairs(rows):
    """Sizes and components by comparing every document with every other."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    found = Sets()
    for k, (i, s) in enumerate(sets):
        found.find(i)
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                found.join(i, j)
    return sorted(
        ((i, len(shingles(t)), None if i is None else found.find(i)) for i, t in rows), key=repr
    )


def corpus(seed):
    """Copies, near copies of several degrees, chains, and passages many texts share."""
    random.seed(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(random.choices(words, k=30))
    rows = []

    def add(text):
        rows.append((len(rows) + 100, text))

    for _ in range(25):
        add(" ".join(random.choices(words, k=random.randint(1, 80))))
    for _ in range(12):  # mostly the passage
        add(" ".join(random.choices(words, k=random.randint(0, 12))) + " " + passage)
    for base in range(4):
        text = random.choices(words, k=60 + 40 * base)
        for _ in range(10):
            changed = list(text)
            for _ in range(random.randint(0, 4)):
                changed[random.randrange(len(changed))] = random.choice(words)
            add(" ".join(changed))
        chain = list(text)
        for _ in range(8):  # each like the one before, the last unlike the first
            at = random.randrange(len(chain) - 5)
            chain[at : at + 3] = random.choices(words, k=3)
            add(" ".join(chain))
    add(rows[3][1])
    add(rows[3][1].upper().replace(" ", "\n\t "))
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "least", "ranked"), [(1, 50, 1000), (2, 3, 1000), (3, 2, 20)])
def test_components_equal_all_pairs(docs, strange, seed, least, ranked):
    rows = [*strange, *corpus(seed)]
    got = jaccard.jaccard_components(docs(rows).repartition(3), least=least, ranked=ranked)
    assert sorted(map(tuple, got.collect()), key=repr) == all_pairs(rows)


def test_one_of_each_group_stays(docs, strange):
    rows = [*strange, *corpus(4)]
    kept = jaccard.one_of_each(docs(rows))
    assert kept.columns == docs([]).columns
    want = {i for i, _, c in all_pairs(rows) if i == c}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(want | {None}, key=repr)
    assert jaccard.one_of_each(docs([])).collect() == []
    assert jaccard.jaccard_components(docs([])).collect() == []


def test_broadcasts_or_not_the_result_is_the_same(docs, monkeypatch):
    rows = corpus(5)
    monkeypatch.setattr("reelmill.llm.common.BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "broadcast_if_small", lambda df: df)
    got = jaccard.jaccard_components(docs(rows), least=3)
    assert sorted(map(tuple, got.collect()), key=repr) == all_pairs(rows)


def test_one_text_in_very_many_near_copies(docs):
    random.seed(6)
    text = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(600):
        changed = list(text)
        changed[random.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(changed)))
    got = jaccard.jaccard_components(docs(rows), least=20).collect()
    assert {r["component_id"] for r in got} == {0}


def test_shingle_sets_equal_brute_force(monkeypatch):
    monkeypatch.setattr("reelmill.llm.shingles.TOGETHER", 50)
    random.seed(7)
    texts = [" ".join(random.choices("a b A".split(), k=random.randint(0, 40))) for _ in range(200)]
    texts += [None, "", "\x1f x\x85y é É", "To " * 20 + "of " * 20 + "To To of of To"]
    sizes = [len(s) for s in shingle_sets(texts)]
    assert sizes == [len(shingles(t)) for t in texts]
    same = list(shingle_sets(["a b c d e f", "x y", "A B\nC d  e f"]))
    assert np.array_equal(same[0], same[2])


def spread(n, every):
    """Texts of their own, one in ``every`` with a phrase that no block of as many has twice."""
    return [
        (k, f"u{k} v{k} w{k} x{k} y{k}" + (" one phrase of five words" if k % every == 0 else ""))
        for k in range(n)
    ]


def test_a_thinly_spread_phrase_is_counted(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    rows = spread(3600, 18)  # 200 times, never twice in a block
    df = docs(rows).coalesce(1).select(F.col("doc_id").alias("id"), "text")
    (phrase,) = next(shingle_sets(["one phrase of five words"])).tolist()
    found = jaccard.frequent_shingles(df, 5, 50, 100)
    assert phrase in found.ranked.tolist() and found.marks is None
    monkeypatch.setattr(jaccard, "SAMPLED", 1 << 30)
    assert phrase not in jaccard.frequent_shingles(df, 5, 50, 100).ranked.tolist()


def test_frequent_shingles_without_a_rank_are_marked(docs, monkeypatch):
    rows = spread(400, 2) + [(k, f"a{k} b{k} c{k} d{k} e{k} other words that all share") for k in range(500, 600)]
    df = docs(rows).coalesce(1).select(F.col("doc_id").alias("id"), "text")
    often, less = (next(shingle_sets([t])) for t in ("one phrase of five words", "other words that all share"))
    found = jaccard.frequent_shingles(df, 5, 20, 1)
    assert found.ranked.tolist() == often.tolist()
    rare = next(shingle_sets([rows[1][1]]))
    order = found.classes()
    assert order(often).tolist() == [2] and order(less).tolist() == [1] and order(rare).max() == 0
    assert sum(bin(b).count("1") for b in found.marks.tolist()) == 1
    keyed = {r["id"]: r for r in jaccard.prefixes(df, found, 5).collect()}
    row = keyed[500]
    assert row["n"] == 6 and less[0] not in row["prefix"] and row["n_hot"] == 0
    with_phrase = keyed[0]
    assert often[0] not in with_phrase["prefix"]
    monkeypatch.setattr(jaccard, "MARK_BITS", 15)  # marks that meet others by chance
    got = jaccard.jaccard_components(docs(corpus(9)), least=2, ranked=3).collect()
    assert sorted(map(tuple, got), key=repr) == all_pairs(corpus(9))


def test_components_of_chains_stars_and_rings(spark):
    random.seed(8)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)]
    links += [(200 + k, 200 + (k + 1) % 9) for k in range(9)] + [(7, 7), (300, None), (5, 4), (4, 5)]
    links += [(random.randint(400, 500), random.randint(400, 500)) for _ in range(60)]
    found = Sets()
    for a, b in links:
        if b is not None and a != b:
            found.join(a, b)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, found.find(x)) for x in found.up)
    none = spark.createDataFrame([], "a long, b long")
    assert components(none).collect() == []


@pytest.mark.parametrize("links, rounds", [([], 0), ([(2, 1), (3, 1), (9, 8)], 0), ([(2, 1), (3, 2)], 1)])
def test_no_round_is_run_to_find_that_nothing_changes(spark, monkeypatch, links, rounds):
    written = []
    from reelmill.llm import components as module

    real = module.stage
    monkeypatch.setattr(module, "stage", lambda df, name: written.append(name) or real(df, name))
    got = sorted(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert len(written) == 1 + rounds
    assert got == sorted({(x, 8 if x > 7 else 1) for pair in links for x in pair})


def test_prefixes_suffice():
    """Linked sets share a shingle among the first n // 4 + 1 in any order."""
    random.seed(9)
    for _ in range(3000):
        x = set(random.sample(range(40), random.randint(1, 30)))
        y = set(x)
        for _ in range(random.randint(0, 6)):
            y ^= {random.randrange(40)}
        if x and y and jaccard.linked(len(x & y), len(x), len(y)):
            assert 100 * len(x & y) >= 75 * len(x | y)
            first = [set(sorted(s)[: jaccard.prefix_length(len(s))]) for s in (x, y)]
            assert first[0] & first[1]
        else:
            assert not y or 100 * len(x & y) < 75 * len(x | y)
