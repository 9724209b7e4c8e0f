"""Periodic runs of words, found on a grammar of the text.

A run is a stretch of words with smallest period q, of at least ``LEAST`` words and three
periods, that no neighbouring word extends.  Texts go through these steps, whole and in
blocks of documents, with numpy:

1. Words get numbers.  Every run is covered by windows of ``WINDOW`` words that occur
   twice in the document (it holds two thirds of its words again, one period on), so only
   stretches of such windows go on; the others hold no run.
2. Re-Pair on the stretches, in rounds: a pair of neighbouring symbols that occurs twice
   or more becomes a new symbol wherever it is more frequent than the two pairs that
   overlap it there.  Frequencies count by powers of two, and equal ones are told apart
   by a hash, which keeps the rounds few.  What is left of a stretch is paired up evenly.
3. For each distinct symbol of ``LEAST`` words or more, once: the runs that cross the
   boundary between its two halves.  Four words next to the boundary recur one period
   away on one side of it; how far the period holds is found by comparing hashes.
4. These runs are translated to all places where the symbol was put, overlapping pieces
   of equal period are merged into maximal ones, and each is compared word by word.

The symbol in which a run lies whole and crosses the middle gives it in full length, so
none is missed.  Work is n log n whatever repeats; a text's work is in one task, and no
two texts meet, so copies and frequent words make no hot key.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

#: Words that a run has at least, and periods.
LEAST, PERIODS = 24, 3
#: Words of which a run holds a window twice: two thirds of LEAST.
WINDOW = 16
#: Words next to a boundary that recur one period away.
NEAR = 4
#: Characters of text that are worked on together, and places compared at once.
TOGETHER, AT_ONCE = 1 << 20, 1 << 19

_PRIME = (1 << 31) - 1
_BASES = (1_103_515_245, 48_271, 742_938_285, 950_706_376, 1_226_874_159)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = (
    "n_runs long, start long, length long, period long, exponent_milli long,"
    " runs_sha256 string, collapsed_sha256 string"
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _doubtful(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Marks the words in windows that their document seems to hold twice."""
    covered = np.zeros(len(ids) + 1, np.int64)
    n = len(ids) - WINDOW + 1
    if n > 0:
        hashes, width = _mixed((ids + 1).astype(np.uint64) * _GOLDEN), 1
        while width < WINDOW:
            hashes = _mixed(hashes[:-width] * np.uint64(3) + hashes[width:] * _GOLDEN)
            width *= 2
        hashes = _mixed(hashes + doc[:n].astype(np.uint64) * _GOLDEN)
        at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
        # Few of 2^22 counters are shared by chance: what is alone in one is unique.
        small = (hashes[at] >> np.uint64(42)).astype(np.int64)
        at = at[np.bincount(small, minlength=1 << 22)[small] > 1]
        at = at[np.argsort(hashes[at], kind="stable")]
        same = hashes[at][1:] == hashes[at][:-1]
        twice = at[np.append(same, False) | np.append(False, same)] if len(at) else at
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    return np.cumsum(covered)[:-1] > 0


class Grammar:
    """Symbols over ``words``, whose stretches are numbered by ``part``.

    ``left``, ``middle`` and ``right`` bound one occurrence of each symbol and its halves;
    ``symbol`` and ``start`` list all occurrences.
    """

    def __init__(self, words: np.ndarray, part: np.ndarray):
        seq, start, part = words.copy(), np.arange(len(words)), part.copy()
        size = np.ones(len(words), np.int64)
        fresh = int(words.max(initial=0)) + 1
        first, middles, sizes, symbols, starts = fresh, [], [], [], []
        pairing = True
        while True:
            within = part[1:] == part[:-1]
            if not within.any():
                break
            if pairing:
                chosen, number = self._frequent(seq, within)
                if not len(chosen):
                    pairing = False
                    continue
            else:
                head = np.flatnonzero(np.concatenate([[True], ~within]))
                place = np.arange(len(seq)) - np.repeat(head, np.diff(np.append(head, len(seq))))
                chosen = np.flatnonzero(within & (place[:-1] % 2 == 0))
                number = np.arange(len(chosen))
            _, once = np.unique(number, return_index=True)
            middles.append(size[chosen[once]])
            sizes.append(size[chosen[once]] + size[chosen[once] + 1])
            symbols.append(fresh - first + number)
            starts.append(start[chosen])
            seq[chosen] = fresh + number
            size[chosen] += size[chosen + 1]
            fresh += len(once)
            kept = np.ones(len(seq), bool)
            kept[chosen + 1] = False
            seq, start, part, size = seq[kept], start[kept], part[kept], size[kept]
        none = [np.zeros(0, np.int64)]
        self.symbol, self.start = np.concatenate(symbols + none), np.concatenate(starts + none)
        _, once = np.unique(self.symbol, return_index=True)
        self.left = self.start[once]
        self.middle = self.left + np.concatenate(middles + none)
        self.right = self.left + np.concatenate(sizes + none)

    @staticmethod
    def _frequent(seq: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs to replace, none overlapping another, and their numbers."""
        at = np.flatnonzero(within)
        codes, code, counts = np.unique(
            seq[at] << 32 | seq[at + 1], return_inverse=True, return_counts=True
        )
        # Lower goes first: by the power of two of the count, then by hash.
        turn = np.uint64(63) - np.frexp(counts.astype(float))[1].astype(np.uint64) << np.uint64(58)
        turn |= _mixed(codes.astype(np.uint64) * _GOLDEN) >> np.uint64(6)
        never = np.uint64(2**64 - 1)
        turn[counts < 2] = never
        turns = np.full(len(seq) + 1, never)  # that of the pair at k stands at k + 1
        turns[at + 1] = turn[code]
        here = turns[1:]
        # Overlapping copies of one pair (a a a) go together, every second is replaced.
        same = here[1:] == here[:-1]
        head = np.flatnonzero(np.append(True, ~same))
        tail = np.append(head[1:], len(here)) - 1
        low = (here[head] < turns[head]) & (here[head] < np.append(here, never)[tail + 1])
        block = np.repeat(np.arange(len(head)), tail - head + 1)
        odd = (np.arange(len(here)) - head[block]) % 2 == 1
        chosen = np.flatnonzero(low[block] & ~odd & (here != never))
        number_of = np.full(len(seq), -1)
        number_of[at] = code
        return chosen, np.unique(number_of[chosen], return_inverse=True)[1]


class _Lengths:
    """How far words at two places agree, by hashes of prefixes."""

    def __init__(self, words: np.ndarray, base: int):
        powers = np.ones(len(words) + 1, np.int64)
        done, factor = 1, base % _PRIME
        while done < len(powers):
            n = min(done, len(powers) - done)
            powers[done : done + n] = powers[:n] * factor % _PRIME
            factor, done = factor * factor % _PRIME, done + n
        values = _mixed((words + 1).astype(np.uint64) * _GOLDEN) % np.uint64(_PRIME)
        terms = values.astype(np.int64) * powers[:-1] % _PRIME
        self.sums = np.concatenate([[0], np.cumsum(terms)])
        self.powers = powers

    def _equal(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Whether n words at a and, further on, at b agree."""
        here = (self.sums[a + n] - self.sums[a]) % _PRIME * self.powers[b - a] % _PRIME
        return here == (self.sums[b + n] - self.sums[b]) % _PRIME

    def agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, sign: int) -> np.ndarray:
        """Words from a and b on (sign 1) or before them (sign -1) that agree."""
        found = np.zeros(len(a), np.int64)
        step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while step:
            at = np.flatnonzero(found + step <= most)
            back = 0 if sign > 0 else step
            x, y = a[at] + sign * found[at] - back, b[at] + sign * found[at] - back
            found[at[self._equal(x, y, step)]] += step
            step //= 2
        return found


def _names(words: np.ndarray) -> np.ndarray:
    """Equal numbers for equal NEAR words; a text's last places have none."""
    two = np.unique(words[:-1] << 32 | words[1:], return_inverse=True)[1].astype(np.int64)
    return np.unique(two[:-2] << 32 | two[2:], return_inverse=True)[1].astype(np.int64)


def _crossing(grammar: Grammar, words: np.ndarray, base: int) -> Iterator[np.ndarray]:
    """Runs (symbol, offset, end, period) across the middle of each long symbol."""
    far = _Lengths(words, base)
    name = _names(words)
    n = len(words) + 1
    keys = np.sort(name * n + np.arange(len(name)))  # by name, then place
    long = np.flatnonzero(grammar.right - grammar.left >= LEAST)
    for side in (1, -1):
        left, middle, right = grammar.left[long], grammar.middle[long], grammar.right[long]
        anchor = middle if side > 0 else middle - NEAR
        inside = (anchor + NEAR <= right) & (anchor >= left)
        nodes, left, middle, right, anchor = (
            x[inside] for x in (long, left, middle, right, anchor)
        )
        reach = (right - left) // PERIODS
        own = name[anchor] * n
        if side > 0:
            lo = np.searchsorted(keys, own + anchor, "right")
            hi = np.searchsorted(keys, own + np.minimum(right - NEAR, anchor + reach), "right")
        else:
            lo = np.searchsorted(keys, own + np.maximum(left, anchor - reach))
            hi = np.searchsorted(keys, own + anchor)
        counts = np.maximum(hi - lo, 0)
        ends = np.cumsum(counts)
        first = 0
        while first < len(nodes):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] - counts[first] + AT_ONCE)))
            some = counts[first:last]
            node = np.repeat(np.arange(first, last), some)
            turn = np.arange(len(node)) - np.repeat(np.cumsum(some) - some, some)
            q = abs(keys[lo[node] + turn] % n - anchor[node])
            lower, mid, upper = left[node], middle[node], right[node]
            a = mid if side > 0 else mid - q
            more = far.agree(a, a + q, upper - a - q, 1)
            less = far.agree(a, a + q, a - lower, -1)
            s, e = a - less - lower, a + q + more - lower
            good = e - s >= np.maximum(LEAST, PERIODS * q)
            yield np.stack([nodes[node], s, e, q])[:, good]
            first = last


def _smallest(found: np.ndarray) -> np.ndarray:
    """Of columns (..., period) that agree in all else the one of smallest period."""
    found = found[:, np.lexsort(found[::-1])]
    new = np.append(True, (found[:-1, 1:] != found[:-1, :-1]).any(0))
    return found[:, new[: found.shape[1]]]


def _maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Pieces of equal period that overlap by a period or more as one."""
    merged: list[list[int]] = []
    pieces = np.unique(np.stack([period, start, end]), axis=1).T.tolist()
    for q, s, e in pieces:
        if merged and merged[-1][2] == q and s <= merged[-1][1] - q:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, q])
    return np.array(merged, np.int64).reshape(-1, 3).T


def _holds(words: np.ndarray, part: np.ndarray, runs: np.ndarray) -> bool:
    """Whether every run has its period and no neighbour of its stretch extends it."""
    for s, e, q in runs.T.tolist():
        if not np.array_equal(words[s : e - q], words[s + q : e]):
            return False
        if s and part[s - 1] == part[s] and words[s - 1] == words[s - 1 + q]:
            return False
        if e < len(words) and part[e] == part[s] and words[e] == words[e - q]:
            return False
    return True


def runs_of(words: np.ndarray, part: np.ndarray) -> np.ndarray:
    """All runs (start, end, period) of numbered words; none crosses from part to part."""
    none = np.zeros((3, 0), np.int64)
    if len(words) < LEAST:
        return none
    grammar = Grammar(words, part)
    for base in _BASES:
        found = _smallest(np.concatenate([np.zeros((4, 0), np.int64), *_crossing(grammar, words, base)], 1))
        if not found.shape[1]:
            return none
        # Every place where the symbol of a run was put.
        order = np.argsort(grammar.symbol, kind="stable")
        lo = np.searchsorted(grammar.symbol[order], found[0])
        counts = np.searchsorted(grammar.symbol[order], found[0], "right") - lo
        run = np.repeat(np.arange(found.shape[1]), counts)
        turn = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        base_of = grammar.start[order][lo[run] + turn]
        runs = _smallest(_maximal(base_of + found[1][run], base_of + found[2][run], found[3][run]))
        if _holds(words, part, runs):
            return runs
    raise ArithmeticError("hashes of words collide under every base")


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def looped(words: list[bytes], doc_id: object) -> list[bytes]:
    """A tenth of the documents, by a checksum of their id, end on a loop."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + p]
    return words[:a] + (loop * ((n - a) // len(loop) + 1))[: n - a]


def document_runs(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each document the runs of its words: (start, length, period), sorted."""
    numbers = _Numbers()
    total = sum(map(len, docs))
    ids = np.fromiter((numbers[w] for d in docs for w in d), np.int64, total)
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    doc = np.repeat(np.arange(len(docs)), sizes)
    places = np.flatnonzero(_doubtful(ids, doc))
    new = (np.diff(places) != 1) | (np.diff(doc[places]) != 0)
    part = np.concatenate([[0], np.cumsum(new)])[: len(places)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    if len(places):
        wide = np.bincount(part)[part] >= LEAST
        places, part = places[wide], part[wide]
    first = np.cumsum(sizes) - sizes
    for s, e, q in runs_of(ids[places], part).T.tolist():
        k = int(doc[places[s]])
        out[k].append((int(places[s] - first[k]), e - s, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def _row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = None
    for run in runs:  # sorted, so the first of equal exponents stays
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    if runs:
        inner = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            inner[s + q] += 1
            inner[s + n] -= 1
        dropped = (np.cumsum(inner) > 0).tolist()
        words = [w for w, d in zip(words, dropped, strict=False) if not d]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return (
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256(listed).hexdigest(),
        hashlib.sha256(b" ".join(words)).hexdigest(),
    )


def _rows(ids: list, texts: list[str | None]) -> Iterator[tuple]:
    # bytes.split: runs of ASCII white space, the words of the contract.
    docs = [looped((t or "").encode().split(), i) for i, t in zip(ids, texts, strict=True)]
    for i, words, runs in zip(ids, docs, document_runs(docs), strict=True):
        yield (i, *_row(words, runs))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_runs, the run of greatest exponent, and digests.

    A tenth of the documents is looped first (``looped``).  ``collapsed_sha256`` is over
    the words that no run contains after its first period.

    Defined results: null and empty texts have no words and no run; rows with equal ids
    are looked at one by one; a null id is not looped; an empty table gives an empty one;
    further columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            first, size = 0, 0
            for k, text in enumerate(texts):
                size += len(text or "")
                if size >= TOGETHER or k + 1 == len(texts):
                    rows += _rows(ids[first : k + 1], texts[first : k + 1])
                    first, size = k + 1, 0
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [batch.schema.field(0).type] + [pa.int64()] * 5 + [pa.string()] * 2
                names = [id_col, *(c.split()[0] for c in SCHEMA.split(","))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
                )

    return map_arrow(docs.select(f"`{id_col}`", f"`{text_col}`"), run, f"`{id_col}` {kind}, {SCHEMA}")
