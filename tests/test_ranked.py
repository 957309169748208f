"""Ranked retrieval against scoring every document for every query."""

import re

import pytest

from annalist.operators import retrieval
from annalist.plans import registry

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\W_]+")


def density(words, wanted):
    """Shortest covers one after another, each found by looking at all stretches that begin behind the last one's beginning."""
    total, least = 0.0, 0
    for end in range(len(words)):
        if words[end] not in wanted:
            continue
        begin = next((b for b in range(end, least - 1, -1) if wanted <= set(words[b : end + 1])), None)
        if begin is not None:
            total += 1.0 / (end - begin + 2 - len(wanted))
            least = begin + 1
    return total


def brute(docs, queries, limit):
    out = []
    for item, asked in queries:
        wanted = set(WORD.findall(asked.lower()))
        found = [(-density(words, wanted), doc) for doc, words in docs if wanted and wanted <= set(words)]
        out += [(item, doc, place, round(-score, 9)) for place, (score, doc) in enumerate(sorted(found)[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1, 4])
def test_best_documents_of_every_passage(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "FIRST_BLOCK", block)
    docs = [(r.doc_id, WORD.findall(r.text.lower())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    queries = []
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        queries.append((r.item_id, " ".join(list(dict.fromkeys(WORD.findall(r.text.lower())))[:3])))
    found = registry.QUERIES["ranked_retrieval"](spark, SF).collect()
    assert sorted((r.item_id, r.doc_id, r.place, round(r.score, 9)) for r in found) == brute(docs, queries, 10)


def test_ties_bounds_and_queries_without_words(spark):
    texts = ["a b", "a a a b b b", "b a", "a x b", "a b a b", "a", None, "", "A_B", "b x x a x b"] + ["a x x b"] * 30 + ["a b " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b"), (2, "a"), (3, ""), (4, "zz"), (5, None), (6, "B, b; a")], "item_id long, asked string")
    got = retrieval.ranked(docs, "doc_id", "text", queries, "item_id", "asked", 3).collect()
    plain = [(i, WORD.findall((t or "").lower())) for i, t in enumerate(texts)]
    want = brute(plain, [(1, "a b"), (2, "a"), (3, ""), (4, "zz"), (5, ""), (6, "b a")], 3)
    assert sorted((r.item_id, r.doc_id, r.place, round(r.score, 9)) for r in got) == want


def test_a_rare_word_may_be_in_several_covers(spark):
    texts = ["a b" + " x" * 9 + " b" + " x" * 9 + " a"] * 20 + ["a b a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = retrieval.ranked(docs, "doc_id", "text", spark.createDataFrame([(1, "a b")], "item_id long, asked string"), "item_id", "asked", 1).collect()
    assert [(r.doc_id, r.score) for r in got] == [(20, 2.0)]
