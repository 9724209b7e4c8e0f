"""Vector codes against Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from reelmill.llm.vector_codes import compress, dots, limbs

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, error double"


def plain(rows, parts=8, entries=16, rounds=6):
    """The same by lists of integers; rows are (vec_id, vector, label)."""
    kept = [
        (i, [math.floor(4096 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(c[p], books[p])[0] for c in cut]
            for e in set(own):
                mine = [c[p] for c, k in zip(cut, own, strict=True) if k == e]
                books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    digest = hashlib.sha256(
        ",".join(str(x) for book in books for entry in book for x in entry).encode()
    ).hexdigest()
    out, total = [], {}
    for (i, _, label), c in zip(kept, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(f for _, f in found)
        out.append((i, "".join(f"{e:02x}" for e, _ in found), error, label))
        total[label] = total.get(label, 0) + error
    return sorted(((i, code, e, total[label], digest) for i, code, e, label in out), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 0.5) for r in rows], SCHEMA).repartition(5)


def vectors(n, scale=1.0, width=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, scale, (12, width))
    return (centres[rng.integers(0, 12, n)] + rng.normal(0, scale / 5, (n, width))).astype(np.float32).tolist()


@pytest.mark.parametrize("scale", [0.1, 3000.0, 5.0e4])
def test_codes_equal_plain_integers(spark, rows, scale):
    given = [(k * 3 % 401, v, k % 4 or None) for k, v in enumerate(vectors(400, scale))]
    assert rows(compress(table(spark, given))) == plain(given)


def test_strange_rows(spark, rows):
    nan, inf = float("nan"), float("inf")
    given = [(k, v, 1) for k, v in enumerate(vectors(40, width=8))]
    given += [(1, given[0][1], None), (5, given[5][1], 2), (5, given[5][1], 2), (None, given[7][1], 3)]
    given += [(-1, None, 1), (-2, [nan] + [0.0] * 7, 1), (-3, [None] + [0.0] * 7, 1), (-4, [inf] * 8, 1)]
    assert rows(compress(table(spark, given))) == plain(given)
    few = given[:3]
    assert rows(compress(table(spark, few))) == plain(few)
    assert rows(compress(table(spark, given[-4:]))) == []
    assert rows(compress(table(spark, []))) == []


def test_ties_go_to_the_lower_entry_and_unused_entries_stay(spark, rows):
    given = [(k, [float(k % 2)] * 8, 0) for k in range(40)]
    got = rows(compress(table(spark, given)))
    assert got == plain(given) and {r[1] for r in got} == {"00" * 8, "01" * 8}


def test_vectors_of_several_lengths_are_refused(spark):
    with pytest.raises(Exception, match="one length"):
        compress(table(spark, [(1, [1.0] * 8, 0), (2, [1.0] * 16, 0)])).collect()
    with pytest.raises(ValueError, match="one length"):
        compress(table(spark, [(1, [1.0] * 9, 0)]))


def test_limbs_and_their_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (1, 1 << 12, 1 << 24, 1 << 28):
        x, y = (rng.integers(-top, top, (3, 50, 8), endpoint=True) for _ in range(2))
        put = sum(part.astype(np.int64) << (24 * k) for k, part in enumerate(limbs(x, 24)))
        assert (put == x).all()
        exact = np.einsum("pnw,pew->pne", x.astype(object), y.astype(object))
        assert (dots(x, y) == exact).all()
