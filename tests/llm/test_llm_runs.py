"""Runs on the grammar against a look at every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from llm_fixtures import docs, strange  # noqa: F401

from reelmill.llm.runs import Grammar, document_runs, looped, periodic_runs


def plain_runs(words):
    """For every period the stretches in which words that far apart agree."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        first = 0
        for k in range(len(words) - q + 1):
            if k == len(words) - q or words[k] != words[k + q]:
                if k > first and k + q - first >= max(24, 3 * q):
                    found.setdefault((first, k + q), q)  # the smallest period comes first
                first = k + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = (None,) * 4
    if runs:
        # Python's integers: l1 / q1 > l2 / q2 without fractions.
        top = runs[0]
        for r in runs[1:]:
            if r[1] * top[2] > top[1] * r[2]:
                top = r
        best = (*top, 1000 * top[1] // top[2])
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    digests = hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()
    return (doc_id, len(runs), *best, *digests)


def some_words(rnd):
    kinds = rnd.choice([1, 2, 3, 5, 50, 1000])
    words = [b"w%d" % rnd.randrange(kinds) for _ in range(rnd.choice([0, 5, 23, 24, 25, 60, 300]))]
    for _ in range(rnd.randrange(4)):
        block = [b"w%d" % rnd.randrange(kinds) for _ in range(rnd.choice([1, 2, 3, 7, 8, 9, 20, 40]))]
        if rnd.random() < 0.4 and len(block) > 3:
            block = (block[: len(block) // 3] * 4)[: len(block)]
        loop = block * rnd.randrange(2, 12)
        at = rnd.randrange(len(words) + 1)
        words[at:at] = loop[: len(loop) - rnd.randrange(len(block))]
        if rnd.random() < 0.2:
            words += words
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_loops(seed):
    rnd = random.Random(seed)
    docs = [some_words(rnd) for _ in range(60)]
    assert document_runs(docs) == [plain_runs(d) for d in docs]


def test_runs_of_famous_words():
    a, b = [b"a"], [b"b"]
    for _ in range(12):
        a, b = a + b, a
    thue_morse = [b"xy"[bin(k).count("1") % 2 :][:1] for k in range(512)]
    cubes = [b"c"] * 1000
    assert document_runs([a, thue_morse, cubes, []]) == [plain_runs(a), [], [(0, 1000, 1)], []]


def test_a_grammar_spells_its_text():
    rnd = random.Random(9)
    words = np.array([rnd.randrange(4) for _ in range(500)] * 4, np.int64)
    part = np.repeat([0, 1], 1000)
    grammar = Grammar(words, part)
    for s, at in zip(grammar.symbol, grammar.start, strict=True):
        n = grammar.right[s] - grammar.left[s]
        assert grammar.left[s] < grammar.middle[s] < grammar.right[s]
        assert (words[at : at + n] == words[grammar.left[s] : grammar.right[s]]).all()
    whole = grammar.right - grammar.left == 1000
    assert whole.any()  # equal texts, one symbol
    assert len(grammar.left) < len(grammar.symbol)  # and symbols are put more than once


def test_a_long_text_of_one_loop():
    words = [b"w%d" % (k % 777) for k in range(400_000)]
    assert document_runs([words]) == [[(0, 400_000, 777)]]


def test_query_rows_equal_brute_force(spark, docs, strange):
    rnd = random.Random(2)
    given = strange + [(i, b" ".join(some_words(rnd)).decode()) for i in range(100, 160)]
    given += [(200, " ".join(["again"] * 30) + "\n" + " ".join(["more", "words"] * 20))]
    given = [(i, t) for i, t in given if len(t or "") < 100_000]
    got = sorted(map(tuple, periodic_runs(docs(given)).collect()), key=repr)
    assert got == sorted((plain_row(i, t) for i, t in given), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in given)


def test_very_long_and_no_documents(spark, docs, strange):
    long = [(i, t) for i, t in strange if len(t or "") > 100_000]
    assert long and [r["n_runs"] for r in periodic_runs(docs(long)).collect()] == [0]
    assert periodic_runs(docs([])).collect() == []


def test_looped_words_follow_the_contract():
    words = [b"%d" % k for k in range(97)]
    for i in range(200):
        h = zlib.crc32(str(i).encode())
        a, p = (h // 10) % 97, 1 + (97 - (h // 10) % 97) // (3 + h // 10 % 8)
        same = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        assert looped(words, i) == (words if h % 10 else same)
