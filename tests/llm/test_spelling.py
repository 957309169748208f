"""Spelling variants, against deletion neighbourhoods and plain counting."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from annalist.llm import spelling
from tests.llm.conftest import SCHEMA


def near(u: str, v: str) -> bool:
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(u) + 1 == len(v) and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute_vocabulary(rows, least_length=5, least_count=3, every=97):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least_count}


def brute_groups(words: dict[str, int]):
    by_shape = defaultdict(set)  # words that share a form with one code point left out, or are it
    for w in words:
        for shape in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_shape[shape].add(w)
    close = defaultdict(set)
    for some in by_shape.values():
        for u in some:
            close[u] |= {v for v in some if near(u, v)}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), words.get(form[w])))
    return sorted(out, key=str)


def result(df):
    return sorted([(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()], key=str)


def some_words(n, letters="abcé", least=1, most=7, seed=1):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(least, most))): rng.choice([1, 2, 3, 5, 9, 40, 200]) for _ in range(n)}


def test_automaton_is_minimal_and_numbers_words_in_order():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops", "", "é"})
    codes, offsets = spelling._codes(words)
    built = spelling.Automaton(codes, offsets)
    assert len(built.final) == 7  # the root, behind s, st, t, behind a or o, behind p, the end
    for i, word in enumerate(words):
        state, number = built.root, 0
        for c in word:
            there, at = built.step(np.array([state]), np.array([ord(c)]))
            assert there[0]
            state, number = int(built.target[at[0]]), number + int(built.ahead[at[0]])
        assert built.final[state] and number == i


@pytest.mark.parametrize("most", [30, 1 << 16])
def test_groups_equal_brute_force(spark, monkeypatch, most):
    """Also where halves shared by over 30 words are dealt out again, and with small automata."""
    words = some_words(1500)
    monkeypatch.setattr(spelling, "AUTOMATON", 64)
    monkeypatch.setattr(spelling, "WALKED", 50)
    plain = spelling.near_pairs
    monkeypatch.setattr(spelling, "near_pairs", lambda rows: plain(rows, most))
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()] + [(None, 3, "x")], "word string, n int, near string").repartition(3)
    assert result(spelling.group_variants(df)) == brute_groups(words)


def test_pairs_are_found_once_each(spark):
    words = some_words(400, "ab", 1, 9)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    for most in (20, 1 << 16):
        found = [(r.word, r.near, r.near_n) for r in spelling.near_pairs(df, most).collect()]
        assert sorted(found) == sorted((u, v, words[v]) for u in words for v in words if near(u, v))


def test_vocabulary_and_groups_of_documents(spark, docs, empty, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(7, "Straße straße STRASSE ×÷× naïve Naïve naïve école École éCOLE aaĀbb"), (8, "y" * 5000 + " " + "y" * 5000 + "," + "y" * 4999 + "z " + "y" * 5000)]
    more = spark.createDataFrame([(*r, *[None] * 9) for r in rows], SCHEMA).withColumnRenamed("lang", "word").repartition(4)
    monkeypatch.setattr(spelling, "SPAN", 700)
    monkeypatch.setattr(spelling, "COUNTED", 20)
    for settings in ({}, {"least_length": 3, "least_count": 2, "every": 3}):
        want = brute_vocabulary(rows, **settings)
        assert {r.word: r.n for r in spelling.vocabulary(more, **settings).collect()} == want
    assert result(spelling.group_variants(spelling.vocabulary(more, 3, 2, 3))) == brute_groups(brute_vocabulary(rows, 3, 2, 3))
    assert result(spelling.group_variants(spelling.vocabulary(empty))) == []
