"""The registered queries and the pipeline on the smallest given data."""

import re

import pytest
from conftest import SMALL

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import compare, connect
from reelmill.llm.common import table
from reelmill.llm.langid import fit_profiles, identify
from reelmill.llm.packing import pack
from reelmill.llm.queries import BYTE_BPE, QUERIES
from reelmill.llm.sql import SQL
from test_llm_jaccard import all_pairs
from test_llm_text import contaminated
from test_llm_tokens import check_packing


def test_all_operators_and_the_pipeline_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, name):
    con = connect(SMALL)
    assert compare(spark, con, name, QUERIES[name], SQL[name], SMALL) is None
    con.close()


def given_rows(spark):
    return [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]


def test_held_out_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, SMALL)
    docs = table(spark, SMALL, "documents").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_components_of_the_given_documents(spark):
    got = QUERIES["op6_jaccard_join"](spark, SMALL).collect()
    assert sorted(map(tuple, got), key=repr) == all_pairs(given_rows(spark))


def test_every_given_conversation_and_the_hard_one(spark):
    got = {r["conv_id"]: r for r in QUERIES["op9_chat_formatting"](spark, SMALL).collect()}
    turns = table(spark, SMALL, "conversations")
    assert len(got) == turns.select("conv_id").distinct().count() + 1
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == 34


def test_secrets_of_the_given_documents(spark):
    got = QUERIES["op10_secret_scan"](spark, SMALL).collect()
    secret = {(r["doc_id"], r["start"]) for r in got if r["is_secret"]}
    named = set()
    for i, text in given_rows(spark):
        for m in re.finditer(r'token = "([0-9a-f]{40})"', text or ""):
            named.add((i, m.start(1)))
    assert named <= secret


def test_pipeline_equals_brute_force(spark):
    """Stage by stage: who goes, what is replaced, how it is packed."""
    docs = table(spark, SMALL, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert 4 <= len(names) <= 5
    profiles = fit_profiles(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    kept = {
        r["doc_id"]: r["text"]
        for r in identify(docs, profiles).collect()
        if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE
    }
    firsts = {i for i, _, c in all_pairs(list(kept.items())) if i == c}
    kept = {i: t for i, t in kept.items() if i in firsts}
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    dirty = {i for i, *_, hit in contaminated(list(kept.items()), items) if hit}
    kept = {i: t for i, t in kept.items() if i not in dirty}

    step = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        step = stage(spark, step, SMALL)
        assert step.columns == docs.columns
    clean = {r["doc_id"]: r["text"] for r in step.collect()}
    assert set(clean) == set(kept) and len(firsts) < docs.count()
    for i, text in clean.items():
        unmarked = re.escape(text).replace(re.escape("[SECRET]"), r"[A-Za-z0-9+/_\-]{16,}")
        assert re.fullmatch(unmarked, kept[i]), i
        assert not re.search(r'token = "[0-9a-f]{40}"', text)

    packed = corpus_pipeline.run(spark, SMALL).collect()
    rows = [r.asDict() for r in packed]
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(clean)
    for pieces in by_doc.values():
        assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"]


def test_packing_query_keeps_every_id(spark):
    texts = dict(given_rows(spark))
    rows = pack(table(spark, SMALL, "documents"), BYTE_BPE, end_id=1).collect()
    assert check_packing(rows, texts, 1, 2048) == 0
