"""Substring dedup by words, against all windows counted one by one."""

import random
from collections import Counter
from hashlib import sha256

import pytest

from annalist.llm import debruijn
from tests.llm.conftest import SCHEMA, prose


def brute(rows, width):
    words = [(row[0], (row[1] or "").encode().split()) for row in rows]
    seen = Counter(tuple(w[i : i + width]) for _, w in words for i in range(len(w) - width + 1))
    out = []
    for doc_id, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, y in zip(w, gone, strict=True) if not y)
        out.append((doc_id, len(w), sum(gone), kept.decode()))
    return sorted(out, key=str)


def result(docs, width):
    kept = debruijn.remove_repeats(docs, width, 8 if width > 10 else 3)
    return sorted([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in kept.collect()], key=str)


@pytest.mark.parametrize("width", [5, 35])
def test_equals_counting_every_window(docs, width):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(docs, width) == brute(rows, width)


def test_empty_table_and_clashing_columns(spark, empty):
    assert result(empty, 35) == []
    rows = [(1, "a b c d e f g", "en", "s", 1, 1, 1, 1, "q", "s", "i"), (2, "x b c d e f y", "en", "s", 1, 1, 1, 1, "q", "s", "i")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("ids", "unitig").withColumnRenamed("key", "spans")
    assert result(docs, 5) == brute(rows, 5)


def test_long_texts_in_parts_and_one_hot_passage(spark, monkeypatch):
    """A text of many parts, periodic words, and one passage in all texts with other words around it."""
    rng = random.Random(3)
    passage, long = prose(rng, 50), prose(rng, 3000)
    rows = [(i, f"{prose(rng, rng.randrange(40))} {passage}\t\n{prose(rng, rng.randrange(40))}") for i in range(300)]
    rows += [(900, long), (901, "x " + long[1000:9000] + " y"), (902, "la " * 400), (903, "ha ho " * 300), (904, "one " * 34), (905, "é " * 36)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    monkeypatch.setattr(debruijn, "SPAN", 700)
    assert result(docs, 35) == brute(rows, 35)


def test_unitigs_join_paths_through_plain_nodes(spark):
    """1-2-3 is one path in one text, 4 goes on from it in another text; 5 and 6 both leave node 90; 7 is a cycle."""
    paths = [(10, 20, 1, 0, 1), (20, 30, 1, 1, 4), (30, 40, 1, 5, 1), (40, 90, 2, 7, 2), (90, 50, 3, 0, 1), (90, 60, 4, 0, 1), (70, 70, 5, 0, 1)]
    named = debruijn.unitigs(spark.createDataFrame(paths, "u long, v long, row long, pos int, n_windows int"))
    found = {(r.row, r.pos): r.unitig for r in named.collect()}
    groups = sorted(sorted(k for k, v in found.items() if v == unitig) for unitig in set(found.values()))
    assert groups == [[(1, 0), (1, 1), (1, 5), (2, 7)], [(3, 0)], [(4, 0)], [(5, 0)]]


def test_a_piece_whose_words_differ_from_its_digest_stays():
    text = b"a b c d e f"
    import pyarrow as pa

    for digest, left in ((debruijn.digest(memoryview(text), 0, 5), b"d e f"), (1, text)):
        spans = [[{"start": 0, "end": 3, "digest": digest, "unitigs": [1]}]]
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array(spans)], ["doc_id", "data", "spans"])
        assert next(debruijn._cut(iter([batch]))).column("kept")[0].as_py() == left
