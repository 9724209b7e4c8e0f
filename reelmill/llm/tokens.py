"""Ids of a public byte-level tokenizer for whole texts, in bounded memory."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd

# Spark runs a task per core; threads of the library's own would only get in the way.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

from .common import worker_cache  # noqa: E402

#: Distinct pieces of text a worker remembers before it forgets some: 50 MB, or half of
#: that where little memory is left.
REMEMBERED, FEW_REMEMBERED = 300_000, 120_000
#: Characters of text that are split and looked up together.
TOGETHER = 1 << 19

#: The tokenizer's own split of a text into pieces (fixed value of byte-level BPE), for
#: the characters of COMMON.
PIECE = re.compile(
    r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
)
#: Letters, ASCII digits and signs on whose classes all libraries agree.  Texts with
#: other characters go through the tokenizer whole.
COMMON = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u017f]*")


# Classes of the characters of COMMON, and of the end of a text.
_LETTER, _DIGIT, _SIGN, _SPACE, _END = range(5)
_CODES = 0x180


def _class_of(char: str) -> int:
    if char == "\0":
        return _END
    if char.isspace():
        return _SPACE
    return _DIGIT if re.match(r"\d", char) else _LETTER if re.match(r"[^\W_]", char) else _SIGN


_CLASSES = np.array([_class_of(chr(k)) for k in range(_CODES)], np.uint8)
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_VALUES = np.array([(k + 1) * 0xD1342543DE82EF95 % (1 << 64) for k in range(_CODES)], np.uint64)


def piece_starts(chars: np.ndarray) -> np.ndarray:
    """Where ``PIECE`` cuts texts of COMMON characters that end on NUL each.

    Pieces are runs of one class with the space before them; white space otherwise goes
    alone, its last character apart; a sole apostrophe takes the letters of a clitic.
    """
    kind = _CLASSES[chars]
    start = np.append(True, kind[1:] != kind[:-1]) | (kind == _END)
    space = kind == _SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & (kind[1:] != _END))
    start[last] = True
    start[last + 1] = chars[last] != ord(" ")
    sole = np.flatnonzero((chars[:-1] == ord("'")) & start[:-1] & (kind[1:] == _LETTER))
    if len(sole):
        first, second = chars[sole + 1], chars[sole + 2]
        size = np.where(np.isin(first, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size[(first == ord(a)) & (second == ord(b))] = 2
        sole, size = sole[size > 0], size[size > 0]
        start[sole + 1] = False
        after = sole + size + 1
        start[after] |= kind[after] == _LETTER
    return np.flatnonzero(start)


def distinct_pieces(chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The number of each piece among the distinct ones, and where these stand first.

    Pieces are told apart by hashes, and then compared with the first of their hash;
    None if two differ.
    """
    n = len(chars)
    with np.errstate(over="ignore"):
        factors = np.full(n, _FACTOR, np.uint64)
        factors[0] = 1
        sums = np.append(np.uint64(0), np.cumsum(_VALUES[chars] * np.cumprod(factors)))
        factors[1:] = _INVERSE
        ends = np.append(starts[1:], n)
        hashes = (sums[ends] - sums[starts]) * np.cumprod(factors)[starts]
    codes, distinct = pd.factorize(hashes)
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    sizes = ends - starts
    if (sizes != sizes[first[codes]]).any():
        return None
    shift = np.repeat(starts[first[codes]] - starts, sizes)
    return (codes, first) if (chars[shift + np.arange(n)] == chars).all() else None


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Ids of texts, each followed by an end id.

    ``Tokenizer.encode(text, add_special_tokens=False)`` with remembered pieces: a
    piece's ids do not depend on its neighbours, so each distinct piece goes through
    the library once, and a text is the concatenation of its pieces' ids.  Texts that
    name an added token, or hold uncommon characters, are encoded whole.
    """

    #: Stands for the end of a text among its pieces; no text has it in COMMON.
    END = "\0"

    def __init__(self, path: str, end_id: int, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end_id = np.array([end_id], np.uint32)
        # The ids of piece n are arena[starts[n] : starts[n] + lengths[n]].
        self.known = _Numbers({self.END: 0})
        self.arena, self.starts, self.lengths = self.end_id, np.zeros(1, int), np.ones(1, int)
        self.uses = np.zeros(1, int)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _forget(self) -> None:
        """Keep the more used half of what may be remembered."""
        self.uses[0] = self.uses.max() + 1  # the end of a text stays, however few there were
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: self.remembered // 2 + 1])
        pieces = list(self.known)
        self.known = _Numbers(zip([pieces[k] for k in kept], range(len(kept)), strict=True))
        self.arena = self._ids(kept)
        self.lengths, self.uses = self.lengths[kept], self.uses[kept]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _ids(self, at: np.ndarray) -> np.ndarray:
        """The ids of numbered pieces, one after the other."""
        lengths = self.lengths[at]
        shift = np.repeat(self.starts[at] - np.cumsum(lengths) + lengths, lengths)
        return self.arena[shift + np.arange(len(shift))]

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces, each on a line of its own, which keeps them apart."""
        blank = np.fromiter(map(str.isspace, pieces), bool, len(pieces))
        lines = [p for p in pieces if not p.isspace()]
        texts = ["\n".join([*lines[k : k + 256], ""]) for k in range(0, len(lines), 256)]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [np.array(e.ids, np.uint32) for e in encoded]
        flat = np.concatenate([np.zeros(0, np.uint32), *ids])
        ends = np.flatnonzero(flat == self._whole("\n")[0])
        if len(ends) != len(lines):
            raise ValueError("this tokenizer does not keep lines apart")
        spaces = [self._whole(p) for p in pieces if p.isspace()]
        starts, lengths = np.empty(len(pieces), int), np.empty(len(pieces), int)
        starts[~blank] = len(self.arena) + np.concatenate([[0], ends + 1])[: len(ends)]
        lengths[~blank] = len(self.arena) + ends - starts[~blank]
        lengths[blank] = [len(x) for x in spaces]
        starts[blank] = len(self.arena) + len(flat) + np.cumsum(lengths[blank]) - lengths[blank]
        self.arena = np.concatenate([self.arena, flat, *spaces])
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.uses = np.concatenate([self.uses, np.zeros(len(pieces), int)])

    def _plain(self, text: str) -> bool:
        return COMMON.fullmatch(text) is not None and not any(a in text for a in self.added)

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; null is empty."""
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1]) + 1
            if size >= TOGETHER:
                yield from self._encode_some(some)
                some, size = [], 0
        if some:
            yield from self._encode_some(some)

    def _encode_some(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self._plain(t) for t in texts]
        together = "".join(t + self.END for t, p in zip(texts, plain, strict=True) if p)
        # COMMON characters are of two bytes, so places in the text and the array agree.
        chars = np.frombuffer(together.encode("utf-16-le"), "<u2")
        starts = piece_starts(chars) if len(chars) else np.zeros(0, int)
        found = distinct_pieces(chars, starts) if len(chars) else (starts, starts)
        codes, first = found or (np.arange(len(starts)), np.arange(len(starts)))
        edges = np.append(starts, len(chars))
        pieces = [
            together[a:b] for a, b in zip(edges[first].tolist(), edges[first + 1].tolist(), strict=True)
        ]
        if len(self.known) > self.remembered:
            self._forget()
        before = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))[codes]
        if len(self.known) > before:
            self._learn(list(islice(self.known, before, None)))
        self.uses += np.bincount(at, minlength=len(self.uses))
        flat = self._ids(at)
        # A plain text's ids end with those of its end.
        ends = iter(np.cumsum(self.lengths[at])[at == 0].tolist())
        edges = [next(ends) if p else None for p in plain]
        from_, out = 0, []
        for text, to in zip(texts, edges, strict=True):
            if to is None:
                out.append(np.concatenate([self._whole(text), self.end_id]))
            else:
                out.append(flat[from_:to])
                from_ = to
        return out


@worker_cache
def encoder(path: str, end_id: int, remembered: int = REMEMBERED) -> Encoder:
    """One encoder per worker: its memory serves all tasks that run there."""
    return Encoder(path, end_id, remembered)
