"""Token counts under a unigram model, by dynamic programming on a trie.

The best segmentation of a word ends, at each of its prefixes, in the best score of a
shorter prefix plus the score of one vocabulary piece.  That forward score depends on
the prefix alone.  So the distinct words of a block of texts are inserted in a trie and
the scores are computed once per node, level by level in numpy; a word's token count is
stored at its last node, and a text's count is the sum over its words.

Which pieces end at a node is known from its parent: every start that the vocabulary's
own trie still follows is advanced by one character.

Public vocabularies here carry merge ranks instead of probabilities, so scores follow
Zipf's law over the rank.  Ties go to fewer tokens.  A character that is no piece
counts as its UTF-8 bytes.

Defined results: null, empty and blank texts have no words and no tokens; words are
separated by white space and begin with the vocabulary's word mark; a word longer than
``LONG`` characters goes through the same recurrence alone; an empty table gives an
empty one; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_arrow, worker_cache

MARK = "▁"
#: Words up to this length share a trie; its levels are as many.
LONG = 96
#: Characters of text whose distinct words share a trie.
TOGETHER = 1 << 22
#: Natural logarithm of a byte's probability: below any piece.
BYTE_SCORE = -25.0


def zipf_pieces(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece vocabulary with scores by rank."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        (model.get_score(i), i)
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    plain.sort(key=lambda x: (-x[0], x[1]))
    total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    return [(model.id_to_piece(i), -math.log(r + 1) - total) for r, (_, i) in enumerate(plain)]


class Unigram:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.score = dict(pieces)
        self.longest = max((len(p) for p in self.score), default=1)
        states: dict[tuple[int, int], int] = {}
        for piece in self.score:
            at = 0
            for c in piece:
                at = states.setdefault((at, ord(c)), len(states) + 1)
        keys = np.array([(s << 21) | c for s, c in states], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.next = np.fromiter(states.values(), np.int64, len(states))[order]
        self.piece_score = np.full(len(states) + 1, -np.inf)
        for piece, score in pieces:
            at = 0
            for c in piece:
                at = states[at, ord(c)]
            self.piece_score[at] = score

    def count_one(self, word: str) -> int:
        """Tokens of one word."""
        best, tokens = [0.0], [0]
        for end in range(1, len(word) + 1):
            options = []
            for start in range(max(0, end - self.longest), end):
                if (score := self.score.get(word[start:end])) is not None:
                    options.append((-(best[start] + score), tokens[start] + 1))
            if word[end - 1] not in self.score:
                n = len(word[end - 1].encode())
                options.append((-(best[-1] + n * BYTE_SCORE), tokens[-1] + n))
            least = min(options)
            best.append(-least[0])
            tokens.append(least[1])
        return tokens[-1]

    def _step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Follow the vocabulary's trie by one character; -1 is nowhere."""
        if not len(self.keys):
            return np.full(len(states), -1, np.int64)
        wanted = (states << 21) | chars
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.next[at], -1)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each of some distinct words."""
        result = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(lengths > LONG):
            result[k] = self.count_one(words[k])
        short = np.flatnonzero((lengths > 0) & (lengths <= LONG))
        points = np.frombuffer(
            "".join(words[k] for k in short).encode("utf-32-le", "surrogatepass"), np.uint32
        ).astype(np.int64)
        length = lengths[short]
        first = np.cumsum(length) - length

        # The root level.  Per node and open start: vocabulary state, score and tokens there.
        alive = np.arange(len(short))
        node = np.zeros(len(short), np.int64)
        best, tokens = np.zeros(1), np.zeros(1, np.int64)
        open_at, open_state = np.zeros(1, np.int64), np.zeros(1, np.int64)
        open_score, open_tokens = np.zeros(1), np.zeros(1, np.int64)
        depth = 0
        while len(alive):
            # Insert the next character of all words that have one.
            char = points[first[alive] + depth]
            edges, node = np.unique((node << 21) | char, return_inverse=True)
            parent, letter = edges >> 21, edges & ((1 << 21) - 1)
            # Children of a node are neighbours: give each child its parent's open starts.
            begin = np.searchsorted(open_at, parent)
            many = np.searchsorted(open_at, parent, "right") - begin
            owner = np.repeat(np.arange(len(edges)), many)
            ends = np.cumsum(many)
            source = np.repeat(begin - ends + many, many) + np.arange(int(ends[-1]))
            state = self._step(open_state[source], letter[owner])
            held = state >= 0
            owner, state, source = owner[held], state[held], source[held]
            start_score, start_tokens = open_score[source], open_tokens[source]
            # Candidates: pieces that end here, and bytes where the character is none.
            gain = self.piece_score[state]
            ending = np.isfinite(gain)
            alone = self._step(np.zeros(len(edges), np.int64), letter)
            foreign = np.flatnonzero((alone < 0) | ~np.isfinite(self.piece_score[alone]))
            n_bytes = 1 + (letter[foreign] > 0x7F) + (letter[foreign] > 0x7FF) + (letter[foreign] > 0xFFFF)
            at = np.concatenate([owner[ending], foreign])
            score = np.concatenate(
                [start_score[ending] + gain[ending], best[parent[foreign]] + n_bytes * BYTE_SCORE]
            )
            count = np.concatenate([start_tokens[ending] + 1, tokens[parent[foreign]] + n_bytes])
            order = np.lexsort((count, -score, at))
            winner = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
            best, tokens = score[winner], count[winner]
            # Words that end here take the count stored at their node.
            depth += 1
            done = length[alive] == depth
            result[short[alive[done]]] = tokens[node[done]]
            alive, node = alive[~done], node[~done]
            # A new start opens at every node.
            open_at = np.concatenate([owner, np.arange(len(edges))])
            order = np.argsort(open_at, kind="stable")
            open_at = open_at[order]
            open_state = np.concatenate([state, np.zeros(len(edges), np.int64)])[order]
            open_score = np.concatenate([start_score, best])[order]
            open_tokens = np.concatenate([start_tokens, tokens])[order]
        return result

    def count_texts(self, texts: Iterable[str | None]) -> Iterator[tuple[int, int]]:
        """Words and tokens of each text."""

        def counted(some: list[str]) -> Iterator[tuple[int, int]]:
            split = [t.split() for t in some]
            words = np.array([w for s in split for w in s], dtype=object)
            number, distinct = pd.factorize(words) if len(words) else (np.zeros(0, int), [])
            per_word = self.count([MARK + w for w in distinct])[number] if len(words) else number
            ends = np.cumsum([0, *map(len, split)])
            sums = np.concatenate([[0], np.cumsum(per_word)])
            totals = sums[ends[1:]] - sums[ends[:-1]]
            yield from zip(np.diff(ends).tolist(), totals.tolist(), strict=True)

        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1]) + 1
            if size >= TOGETHER:
                yield from counted(some)
                some, size = [], 0
        if some:
            yield from counted(some)


@worker_cache
def _model(path: str) -> Unigram:
    return Unigram(zipf_pieces(path))


def token_counts(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: id, n_words, n_tokens."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(vocabulary_path)
        for batch in batches:
            counts = list(model.count_texts(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([c[0] for c in counts], pa.int64()),
                    pa.array([c[1] for c in counts], pa.int64()),
                ],
                names=[id_col, "n_words", "n_tokens"],
            )

    return map_arrow(
        docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, n_words long, n_tokens long", _model
    )
