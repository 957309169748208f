"""Literal containment: windows of words, and passages met word for word."""

import numpy as np

from annalist.operators import retrieval


def test_windows_of_words_whatever_the_white_space():
    keys = lambda t, n: retrieval.window_keys(np.frombuffer(t.encode(), np.uint8), n)
    plain, odd = keys("uno due trè uno due trè uno", [1, 3]), keys("\n uno\t due\x0b trè  uno due\r\ntrè uno ", [1, 3])
    assert {n: h.tolist() for n, h in plain.items()} == {n: h.tolist() for n, h in odd.items()}
    assert len(plain[3]) == 5 and plain[3][0] == plain[3][3] and len(set(plain[3].tolist())) == 3
    assert keys("uno due", [2])[2][0] != keys("due uno", [2])[2][0] and keys("", [1]) == {} and keys("a b", [1, 3]).keys() == {1}


def test_literals_are_met_by_windows_that_are_no_expressions(spark):
    texts = ["a b c d e f g h i", "x a  b\nc d e f g h", "ab", "a", None, "", "b a", "a b c d e f g x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    passages = spark.createDataFrame([(1, " a b c d\te f g h "), (2, "a"), (3, " "), (4, "b c"), (5, None)], "item_id long, text string")
    found = retrieval.literal_hits(docs, "doc_id", "text", passages, "item_id", "text")
    assert sorted(map(tuple, found.collect())) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 3), (2, 6), (2, 7), (4, 0), (4, 1), (4, 7)]
    assert retrieval.literal_hits(docs, "doc_id", "text", passages.where("item_id = 3"), "item_id", "text").count() == 0
