"""Token files, packing and token counts against the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_fixtures import docs, strange  # noqa: F401
from reelmill.llm.packing import Packer, pack
from reelmill.llm.token_files import read_token_files, write_token_files
from reelmill.llm.tokens import COMMON, PIECE, Encoder, distinct_pieces, encoder, piece_starts
from reelmill.llm.unigram import LONG, MARK, Unigram, token_counts, zipf_pieces
from reelmill.session import scratch_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
REFERENCE = Tokenizer.from_file(BPE)


def ids_of(text, end):
    return np.array(REFERENCE.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.text(st.sampled_from("ab'stre 12\n\t\r.,!-_éßÿ²½ªº ́日Ā<|>"), max_size=40)
        | st.text(max_size=20)
    )
)
def test_encoder_equals_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = [x.tolist() for x in encoder(BPE, 7).encode(texts)]
    assert got == [ids_of(t, 7).tolist() for t in texts]


def test_encoder_forgets_when_its_memory_is_full(monkeypatch):
    monkeypatch.setattr("reelmill.llm.tokens.TOGETHER", 8)
    texts = ["one two", "three four", "one five", "<|endoftext|>x", None, "six", "one two", " one"] * 3
    got = [x.tolist() for x in Encoder(BPE, 7, 3).encode(texts)]
    assert got == [ids_of(t, 7).tolist() for t in texts]


def test_the_end_id_outlives_any_number_of_pieces():
    """One long text of many pieces uses the end once, and the memory is then full."""
    for remembered, many in ((4, 40), (None, 380_000)):
        some = Encoder(BPE, 1) if remembered is None else Encoder(BPE, 1, remembered)
        long = " ".join(f"{k} {k}" for k in range(many))
        for text in (long, "hello world", long[: len(long) // 2], "hello world", None):
            (got,) = some.encode([text])
            assert got[-1] == 1
            if len(text or "") < 1000:
                assert got.tolist() == ids_of(text, 1).tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'stmdrevel  \n\t.,_-19é²µº'"), max_size=16), min_size=1))
def test_pieces_are_cut_as_the_pattern_says(texts):
    texts = [t for t in texts if COMMON.fullmatch(t)]
    whole = "".join(t + "\0" for t in texts)
    chars = np.frombuffer(whole.encode("utf-16-le"), "<u2")
    starts = piece_starts(chars) if texts else np.zeros(0, int)
    edges = [*starts.tolist(), len(whole)]
    got = [whole[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    assert got == [p for t in texts for p in [*PIECE.findall(t), "\0"]]
    if texts:
        codes, first = distinct_pieces(chars, starts)
        assert [got[f] for f in first[codes]] == got and len(first) == len(set(got))


def test_token_files_round_trip(spark, docs, strange):
    path = scratch_path(spark, "tokens")
    write_token_files(docs(strange).repartition(3), path, BPE, end_id=0)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10]
    texts = {i: t for i, t in strange}
    at = 0
    for r in got:
        ids = ids_of(texts[r["doc_id"]], 0)
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
        at += len(ids)


def test_token_files_of_nothing(spark, docs):
    path = scratch_path(spark, "tokens")
    write_token_files(docs([]), path, BPE, end_id=0)
    assert read_token_files(spark, path).collect() == []


def check_packing(rows, texts, end, window):
    """Every id in exactly one piece, sequences gapless; returns the padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, pieces in by_doc.items():
        ids = ids_of(texts[doc], end)
        copies = sum(r["start"] == 0 for r in pieces)
        assert sum(r["length"] for r in pieces) == copies * len(ids)
        for r in pieces:
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert r["token_ids"] == piece.tobytes() and r["doc_tokens"] == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert set(by_doc) == set(texts)
    return padding


@pytest.mark.parametrize("max_open", [4096, 2])
def test_packing_keeps_every_id_once(docs, strange, max_open):
    rows = pack(docs(strange).repartition(2), BPE, end_id=1, window=64, max_open=max_open).collect()
    assert check_packing(rows, dict(strange), 1, 64) == 0


def test_packing_of_nothing(docs):
    assert pack(docs([]), BPE, end_id=1).collect() == []


def test_placement_keeps_the_sum_of_squares_least():
    """The level chosen is one that no other level beats."""
    random.seed(5)
    packer = Packer(32, 10**6)
    for k in range(400):
        size = random.randint(1, 31)
        before = packer.counts.copy()

        def cost(level, before=before, size=size):
            n = before.copy()
            if level:
                n[level] -= 1
            if level + size < 32:
                n[level + size] += 1
            return int((n[1:32] ** 2).sum())

        options = [h for h in range(32 - size + 1) if h == 0 or before[h]]
        chosen = packer.level_for(size)
        assert chosen in options and cost(chosen) == min(map(cost, options))
        packer.add(k, np.zeros(size, np.uint32))


def test_trie_counts_equal_single_words():
    random.seed(3)
    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -1.5), ("aab", -2.5), (MARK, -0.5),
              (MARK + "a", -1.5)]
    model = Unigram(pieces)
    words = {MARK + "".join(random.choices("abcé日", k=random.randint(0, 9))) for _ in range(2000)}
    words = [*words, "", "ab" * LONG, "c" * (LONG + 1)]
    assert model.count(words).tolist() == [model.count_one(w) for w in words]
    assert Unigram([]).count(["ab", "é"]).tolist() == [2, 2]


def test_one_word_has_its_best_segmentation():
    """Against all segmentations, fewer tokens first among equals."""
    pieces = dict(zipf_pieces(PIECES))
    model = Unigram(list(pieces.items()))

    def every(word):
        if not word:
            yield 0.0, 0
        for k in range(1, len(word) + 1):
            if word[:k] in pieces:
                for score, n in every(word[k:]):
                    yield pieces[word[:k]] + score, n + 1

    for word in ("▁the", "▁thention", "▁erlich", "▁ingand"):
        best = max(every(word), key=lambda x: (round(x[0], 9), -x[1]))
        assert model.count_one(word) == best[1]


def test_token_counts_sum_over_words(docs, strange):
    model = Unigram(zipf_pieces(PIECES))
    got = sorted(map(tuple, token_counts(docs(strange), PIECES).collect()), key=repr)
    want = []
    for i, text in strange:
        words = (text or "").split()
        want.append((i, len(words), sum(model.count_one(MARK + w) for w in words)))
    assert got == sorted(want, key=repr)
    assert token_counts(docs([]), PIECES).collect() == []


def test_checksum_of_the_query_is_that_of_the_ids(docs):
    packed = pack(docs([(1, "some text")]), BPE, 1).select("token_ids", F.crc32("token_ids").alias("c"))
    rows = packed.collect()
    assert sum(len(r["token_ids"]) for r in rows) == 4 * len(ids_of("some text", 1))
    assert all(r["c"] == zlib.crc32(r["token_ids"]) for r in rows)
