"""Spelling variants: words one inserted, deleted or replaced code point apart, by forward and backward automata.

Of two words one error apart, either the first half of one begins the other, or its second half ends it. Words are dealt out by
such halves, so that a word meets all that share one. In a task, a minimal acyclic automaton of the words is walked along the exact half and
then with one error; a backward automaton, of the words read from behind, does so for the second half. Its transitions carry how many words
precede, so the sum along a path is the word's number in order (a minimal perfect hash), by which its count is looked up.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm import shared
from annalist.llm.jaccard import by_runs
from annalist.llm.shingles import mixed

#: Words as they are counted: least code points, least occurrences, and which hashes have a code point deleted.
LEAST_LENGTH, LEAST_COUNT, EVERY = 5, 3, 97
#: A form is so many times as frequent as its variants.
TIMES = 2
#: Words of an automaton, about; words that share a half and are more are dealt out by halves of what the half leaves.
AUTOMATON = 1 << 15
#: Words walked through it at once, and words counted before they leave a task.
WALKED, COUNTED = 1 << 12, 1 << 17
#: Bytes of text searched at once.
SPAN = 1 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A-Z are lower-cased before; U+00C0 to U+00FF are these two bytes in UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def _runs(raw: memoryview, span: int) -> Iterator[list[bytes]]:
    """Lower-cased runs of letters, about `span` bytes of text at a time."""
    begin = 0
    while begin < len(raw):
        end = min(len(raw), begin + span)
        part = bytes(raw[begin:end])
        while end < len(raw):  # on to a byte that is in no run
            more = bytes(raw[end : end + 4096])
            gap = re.search(rb"[^A-Za-z\x80-\xff]", more)
            part += more[: gap.start()] if gap else more
            end += gap.start() if gap else len(more)
            if gap:
                break
        yield _RUN.findall(part.translate(_LOWER))
        begin = end


def _counted(every: int, span: int, most: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for runs in _runs(memoryview(text.as_buffer() or b""), span):
                    for run, n in Counter(runs).items():
                        h = zlib.crc32(run, seed)
                        if h % every == 0:
                            letters = run.decode()
                            at = h % len(letters)
                            run = (letters[:at] + letters[at + 1 :]).encode()
                        found[run] += n
                    if len(found) > most:
                        yield out()
        if found:
            yield out()

    return counted


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): maximal runs of letters (A-Z, a-z and U+00C0 to U+00FF) of whole texts, A-Z lower-cased, with their occurrences.

    Let h be the unsigned CRC-32 of `<doc_id>:<run>`; where `every` divides h, the run's code point h % length is deleted. Words have
    `least_length` code points and `least_count` occurrences at least. Null text: no words. Null doc_id: nothing stands before the colon. Repeated rows
    count as often as they occur. Empty table: no words. Other columns are ignored. Very long texts are searched a megabyte at a time.
    """
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    found = texts.mapInArrow(_counted(every, SPAN, COUNTED), "word string, n long").where(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """A minimal acyclic automaton of sorted distinct words; transitions of a state stand side by side, in order of their code points.

    start[s] to start[s + 1] are the transitions of state s: `label`, `target`, and in `ahead` how many of the words that s accepts precede those through the transition.
    """

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        node, layers, total = np.zeros(n, dtype=np.int64), [], 1
        final = [np.array([bool(n and lengths[0] == 0)])]
        live = np.arange(n)
        for depth in range(int(lengths.max(initial=0))):  # a trie, layer by layer
            live = live[lengths[live] > depth]
            parent, label = node[live], codes[offsets[live] + depth]
            new = np.append(True, (parent[1:] != parent[:-1]) | (label[1:] != label[:-1]))
            child = total + np.cumsum(new) - 1
            node[live] = child
            ends = np.zeros(int(new.sum()), dtype=bool)
            ends[child[lengths[live] == depth + 1] - total] = True
            final.append(ends)
            layers.append((parent[new], label[new], child[new]))
            total += len(ends)
        final = np.concatenate(final)
        count, salt = final.astype(np.int64), 0
        for parent, _, child in reversed(layers):
            np.add.at(count, parent, count[child])
        while True:  # states are equal if what they accept is; told by hashes, then checked
            language = mixed(final.astype(np.uint64) + np.uint64(2 + 2 * salt))
            with np.errstate(over="ignore"):
                for parent, label, child in reversed(layers):
                    np.add.at(language, parent, mixed(mixed(language[child]) + label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            _, first, state = np.unique(language, return_index=True, return_inverse=True)
            if not layers:
                break
            parent, label, child = (np.concatenate(c) for c in zip(*layers, strict=True))
            order = np.lexsort((label, parent))
            parent, label, child = parent[order], label[order], child[order]
            begin = np.searchsorted(parent, np.arange(total + 1))
            same = begin[first[state[parent]]] + np.arange(len(parent)) - begin[parent]  # the transition of the state that stands for it
            degree = np.diff(begin)
            if (final == final[first[state]]).all() and (degree == degree[first[state]]).all() and (label == label[same]).all() and (state[child] == state[child[same]]).all():
                break
            salt += 1
        self.root, self.final = int(state[0]), final[first]
        if not layers:
            self.start, self.label, self.target, self.ahead = np.zeros(2, np.int64), *(np.zeros(0, np.int64) for _ in range(3))
            return
        degree = np.diff(begin)[first]
        self.start = np.append(0, np.cumsum(degree))
        every = np.repeat(begin[first] - self.start[:-1], degree) + np.arange(int(degree.sum()))
        self.label, self.target, passed = label[every].astype(np.int64), state[child[every]], count[child[every]]
        before = np.cumsum(passed) - passed
        self.ahead = before - np.repeat(before[np.minimum(self.start[:-1], len(before) - 1)], degree) + np.repeat(self.final, degree)
        self.keys = np.repeat(np.arange(len(first)), degree) << 21 | self.label

    def step(self, state: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which have such a transition, and the transition."""
        if not len(self.label):
            return np.zeros(len(state), dtype=bool), np.zeros(len(state), dtype=np.int64)
        key = state << 21 | label
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, at

    def near(self, codes: np.ndarray, offsets: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and the number of a word of the automaton that equals it in the first `exact` code points and has one error behind."""
        n, lengths = len(exact), np.diff(offsets)
        query, state, number = np.arange(n), np.full(n, self.root), np.zeros(n, dtype=np.int64)
        for depth in range(int(exact.max(initial=0))):
            goes = exact[query] > depth
            there, at = self.step(state, codes[np.minimum(offsets[query] + depth, max(len(codes) - 1, 0))])
            there &= goes
            state, number = np.where(there, self.target[at], state), np.where(there, number + self.ahead[at], number)
            query, state, number = (x[there | ~goes] for x in (query, state, number))
        whole = (query, state, exact[query], number)  # not one error so far
        wrong = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))  # one
        found = []
        while len(whole[0]) or len(wrong[0]):
            q, s, p, number = wrong
            ends = p == lengths[q]
            hit = ends & self.final[s]
            found.append((q[hit], number[hit]))
            q, s, p, number = (x[~ends] for x in wrong)
            there, at = self.step(s, codes[offsets[q] + p])
            q, at, p, number = q[there], at[there], p[there], number[there]
            new = [(q, self.target[at], p + 1, number + self.ahead[at])]
            q, s, p, number = whole
            inside = p < lengths[q]
            label = np.where(inside, codes[np.minimum(offsets[q] + p, max(len(codes) - 1, 0))], -1)
            new.append((q[inside], s[inside], p[inside] + 1, number[inside]))  # the query has one more
            degree = self.start[s + 1] - self.start[s]
            of = np.repeat(np.arange(len(q)), degree)
            every = np.repeat(self.start[s] - (np.cumsum(degree) - degree), degree) + np.arange(int(degree.sum()))
            new.append((q[of], self.target[every], p[of], number[of] + self.ahead[every]))  # the word has one more
            other = inside[of] & (self.label[every] != label[of])
            of, every = of[other], every[other]
            new.append((q[of], self.target[every], p[of] + 1, number[of] + self.ahead[every]))  # another one
            wrong = tuple(np.concatenate(c) for c in zip(*new, strict=True))
            there, at = self.step(s, np.maximum(label, 0))
            there &= inside
            whole = (q[there], self.target[at[there]], p[there] + 1, number[there] + self.ahead[at[there]])
        query, number = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        pairs = np.unique(query * np.int64(1 << 31) + number)  # the same word by several errors
        return pairs >> 31, pairs & ((1 << 31) - 1)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.int32).astype(np.int64)
    return codes, np.append(0, np.cumsum([len(w) for w in words])).astype(np.int64)


DEALT = "key long, word string, n long, asks boolean, forward boolean, before int, behind int"


def _searched(size: int):
    """Pairs of near words from rows of DEALT in order of the key: those that ask, and those that share their half."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for table in by_runs(batches):
            held.append(table)
            if sum(t.num_rows for t in held) >= size:
                yield from _near(pa.concat_tables(held))
                held = []
        if held:
            yield from _near(pa.concat_tables(held))

    return searched


def _near(table: pa.Table) -> Iterator[pa.RecordBatch]:
    words, n, asks, forward, before, behind = (table.column(c).to_pylist() for c in ("word", "n", "asks", "forward", "before", "behind"))
    for way in (True, False):
        read = (lambda w: w) if way else (lambda w: w[::-1])
        counts = {read(w): c for w, c, f in zip(words, n, forward, strict=True) if f == way}
        if not counts:
            continue
        known = sorted(counts)
        automaton = Automaton(*_codes(known))
        asking = [(w, p, s) for w, p, s, a, f in zip(words, before, behind, asks, forward, strict=True) if a and f == way]
        for i in range(0, len(asking), WALKED):
            some = asking[i : i + WALKED]
            exact = np.array([p if way else s for _, p, s in some], dtype=np.int64)
            query, number = automaton.near(*_codes([read(w) for w, _, _ in some]), exact)
            out = []
            for q, k in zip(query.tolist(), number.tolist(), strict=True):
                (word, p, s), near = some[q], read(known[k])
                behind_from = len(word) - s
                if near.startswith(word[:p]) and not (s and near[:behind_from] == word[:behind_from]):  # else found, or to be found, elsewhere
                    out.append((word, near, counts[known[k]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["word", "near", "near_n"])


def _halved(rows: DataFrame) -> DataFrame:
    """Rows dealt by the halves of what lies between their first `before` and last `behind` code points.

    A word asks by its own halves, and is found by those of words that are one code point shorter, as long, or one longer.
    """
    rows = rows.withColumn("gap", F.length("word") - F.col("before") - F.col("behind"))
    first = F.expr("array_distinct(array(greatest(gap - 1, 0) div 2, gap div 2, (gap + 1) div 2))")
    second = F.expr("filter(array_distinct(array(gap div 2, (gap + 1) div 2, (gap + 2) div 2)), x -> x <= gap)")

    def side(forward: bool, sizes: Column, own: Column) -> DataFrame:
        dealt = rows.withColumn("size", F.explode(sizes)).withColumn("size", F.col("size").cast("int"))
        before, behind = (F.col("before") + F.col("size"), F.col("behind")) if forward else (F.col("before"), F.col("behind") + F.col("size"))
        return dealt.select("word", "n", (F.col("asks") & (F.col("size") == own)).alias("asks"), F.lit(forward).alias("forward"), before.alias("before"), behind.alias("behind"))

    out = side(True, first, F.expr("gap div 2")).union(side(False, second, F.expr("(gap + 1) div 2")))
    begins, ends = F.expr("substring(word, 1, before)"), F.expr("right(word, behind)")
    key = F.xxhash64("forward", "before", "behind", begins, ends)  # that two halves may have one key does no harm
    return out.select(key.alias("key"), *(c.split()[0] for c in DEALT.split(", ")[1:]))


def near_pairs(words: DataFrame, most: int = 2 * AUTOMATON) -> DataFrame:
    """(word, near, near_n): all pairs of words that differ by exactly one inserted, deleted or replaced code point, each in both orders.

    `words` has distinct words and their n. Where over `most` words share a half, they are dealt out again by halves of what it leaves, until what is left
    is at most two code points, which no more words can fill than the square of the alphabet. A pair whose common beginning has c
    code points is kept where `before` <= c and c < length - `behind` only, so none is found twice.
    """
    spark, rows, parts = words.sparkSession, words.select("word", "n", F.lit(True).alias("asks"), F.lit(0).alias("before"), F.lit(0).alias("behind")), []
    while True:
        rows = shared.written(_halved(rows), "halves")
        wide = F.length("word") - F.col("before") - F.col("behind")
        hot = rows.groupBy("key").agg(F.count("*").alias("k"), F.max(wide).alias("widest")).where((F.col("k") > most) & (F.col("widest") > 2)).select("key")
        if hot.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(hot, "key", "left_anti"))
        rows = rows.join(hot, "key", "left_semi").drop("key", "forward")
    dealt = parts[0]
    for part in parts[1:]:
        dealt = dealt.unionByName(part)
    dealt = dealt.repartition(shared.partitions(spark), "key").sortWithinPartitions("key").select(*(c.split()[0] for c in DEALT.split(", ")))
    return dealt.mapInArrow(_searched(AUTOMATON), "word string, near string, near_n long")


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """Every word with its form and its root.

    `words` has distinct words and their n. Returns word, form (the near word of largest n, ties to the smallest in code-point order, if that n is at
    least `times` that of the word; else null), root (from the word, follow forms to the last; the word itself if it has none), n, n_near (near words) and form_n.

    Null words go. An empty table has no rows. Further columns are ignored. A very long word is one row, and takes as many steps as it has code points. Forms
    at least double n, so chains are short; each round doubles the steps taken along them.
    """
    words = shared.written(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    said = words.join(best, "word", "left").withColumn("form", F.when(-F.col("best.less") >= times * F.col("n"), F.col("best.near")))
    said = shared.written(said.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", F.when(F.col("form").isNotNull(), -F.col("best.less")).alias("form_n")), "forms")

    ways = said.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = ways.select(F.col("word").alias("at"), F.col("root").alias("far"))
        further = shared.written(ways.join(on, ways["root"] == on["at"], "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("went")), "roots")
        ways = further.select("word", "root")
        if further.where("went").isEmpty():
            break
    return said.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variant_automata(spark, sf_dir):
    """The vocabulary of all documents, every word with its form and root; see `vocabulary` and `group_variants`."""
    return group_variants(vocabulary(shared.documents(spark, sf_dir)))


#: Near words by what is left when one code point is left out.
SQL = """
WITH RECURSIVE r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::UBIGINT] ELSE [195::UBIGINT, (unicode(x) - 64)::UBIGINT] END))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda y, i: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))), 4294967295::UBIGINT) AS h FROM r),
w AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
l AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS near, b.n FROM l a JOIN l b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION
  SELECT w.word, l.word, l.n FROM w JOIN l ON w.word = l.rest UNION SELECT l.word, w.word, w.n FROM w JOIN l ON w.word = l.rest),
b AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS best, max(n) AS best_n FROM p GROUP BY word),
f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)),
t AS (
  SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, t.root FROM t JOIN f ON f.form = t.word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM f JOIN t USING (word)"""
