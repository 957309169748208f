"""Candidate retrieval by words and by vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from annalist.operators.shared import settled


def dot(a: Column, b: Column) -> Column:
    """Inner product: products in single precision, summed in double, clamped to [-1, 1]; null for unequal lengths."""
    products = F.zip_with(a, b, lambda x, y: (x.cast("float") * y.cast("float")).cast("double"))
    score = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)))


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], limit: int) -> DataFrame:
    """The best rows for one query vector; the limit is kept per task before rows meet."""
    score = dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(key, score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), key).limit(limit)


def terms(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


#: Words, passages or pairs of up to this many rows, with up to so many bytes of text, are broadcast; more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its rows are few enough and its texts and lists of words are short enough, all together."""
    sizes = [F.octet_length(name) for name, kind in df.dtypes if kind == "string"] + [F.octet_length(F.concat_ws(" ", name)) for name, kind in df.dtypes if kind == "array<string>"]
    held = sum((F.coalesce(x, F.lit(0)).cast("long") for x in sizes), F.lit(0).cast("long"))
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def holding_all_terms(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """Pairs of query and document in which the document has every word of the query.

    Documents are read once, and of their words only those leave a task that some query asks for; each document then is one
    row with the asked words it holds. Of a query only its rarest word is looked up, and the rest is verified on
    the rows found, so common words deal out no rows.
    """
    asked = settled(queries.select(query_key, terms(F.col(query_text)).alias("_all")))
    wanted = _small(settled(asked.select(F.explode("_all").alias("term")).distinct()))
    words = docs.select(key, F.explode(terms(F.col(text))).alias("term")).join(wanted, "term", "left_semi")
    held = settled(words.groupBy(key).agg(F.collect_list("term").alias("_held")))
    index = held.select(key, F.explode("_held").alias("term"))
    frequency = index.groupBy("term").agg(F.count("*").alias("_df"))
    each = asked.select(query_key, F.explode("_all").alias("term")).join(frequency, "term", "left")
    rare = each.groupBy(query_key).agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("_df"), "term")).alias("_r")).select(query_key, F.col("_r.term").alias("term"))
    found = _small(settled(index.join(_small(settled(rare)), "term").select(key, query_key)))
    pairs = held.join(found, key).join(_small(asked), query_key)
    return pairs.where(F.size(F.array_except("_all", "_held")) == 0).select(query_key, key)


def _cover(found: np.ndarray, n: int) -> float:
    """Cover density from the places of n words, each packed as place * n + word, in order: the sum over shortest covers of 1 / (other words in it + 1)."""
    last: dict[int, int] = {}
    total = 0.0
    for x in found.tolist():
        place, term = divmod(x, n)
        last[term] = place
        if len(last) == n:
            begin = min(last.values())
            total += 1.0 / (place - begin + 2 - n)
            last = {t: p for t, p in last.items() if p > begin}
    return total


def _scored(rows: DataFrame, query_key: str, key: str) -> DataFrame:
    """Query, document and score of rows with `n` and `places`. These go to Python as whole numbers, and stay numbers of Arrow but for one row's at a time, so what Python holds does not grow with a batch's rows."""
    schema = T.StructType([rows.schema[query_key], rows.schema[key], T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, places = batch.column(2).to_numpy(), batch.column(3)
            ends, values = places.offsets.to_numpy(), places.values.to_numpy()
            scores = [_cover(values[ends[i] : ends[i + 1]], int(n)) for i, n in enumerate(sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], schema=arrow)

    packed = F.transform("places", lambda x: x["place"].cast("long") * F.col("n") + x["term"])
    return rows.select(query_key, key, "n", packed.alias("places")).mapInArrow(run, schema)


#: Of each query, so many times the limit are scored first; they set the bar for the rest.
FIRST_BLOCK = 4


def ranked(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, limit: int) -> DataFrame:
    """For each query the best documents that hold all its words: query, document, place (from 1) and score, the cover density; ties go to the smaller key.

    Postings with places are taken of documents and words that match, by query and document. Every cover holds the query's word that is rarest in the document. Of the shortest covers around one of its
    places each takes one more word from behind it than the last, so there are as many as the query has words at most, and none counts more than 1. Candidates are scored in order of that bound: a first block sets the bar, and of the rest
    only those whose bound is above the query's bar, or equal to it with a smaller key, can change the answer and are scored. Queries without words match nothing.
    """
    matches = settled(holding_all_terms(docs, key, text, queries, query_key, query_text))
    asked = queries.select(query_key, terms(F.col(query_text)).alias("_all")).where(F.size("_all") > 0)
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = docs.select(key, text).join(matches, key).join(asked, query_key)
    every = F.transform(words, lambda w, i: F.struct(i.alias("place"), (F.array_position("_all", w) - 1).cast("int").alias("term")))
    rows = rows.select(query_key, key, F.size("_all").alias("n"), F.filter(every, lambda x: x["term"] >= 0).alias("places"))
    bound = F.array_min(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda t: F.size(F.filter("places", lambda x: x["term"] == t))))
    rows = rows.withColumn("bound", bound * F.col("n"))
    order = Window.partitionBy(query_key).orderBy(F.desc("bound"), key)
    postings = settled(rows.withColumn("turn", F.row_number().over(order)))

    best = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    top = lambda df: df.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
    first = settled(top(_scored(postings.where(F.col("turn") <= FIRST_BLOCK * limit), query_key, key)))
    bar = first.where(F.col("place") == limit).select(query_key, F.col("score").alias("_bar"), F.col(key).alias("_last"))
    rest = postings.where(F.col("turn") > FIRST_BLOCK * limit).join(bar, query_key)
    may = (F.col("bound") > F.col("_bar")) | ((F.col("bound") == F.col("_bar")) & (F.col(key) < F.col("_last")))
    found = first.select(query_key, key, "score").union(_scored(rest.where(may), query_key, key))
    return top(found).select(query_key, key, "place", "score")


def merged_candidates(baseline: DataFrame, semantic: DataFrame, key: str, limit: int) -> DataFrame:
    """Baseline candidates first, then semantic ones that are not among them, up to a limit. Both have `place`."""
    both = baseline.select(key, F.lit(0).alias("_list"), "place").union(semantic.select(key, F.lit(1).alias("_list"), "place"))
    once = both.groupBy(key).agg(F.min(F.struct("_list", "place")).alias("_best"))
    rows = once.select(key, "_best.*").orderBy("_list", "place", key).limit(limit)
    return rows.select(key, F.when(F.col("_list") == 0, "baseline").otherwise("semantic").alias("origin"))


def cover_density(text: str, query: list[str]) -> float:
    """Sum over shortest covers, which hold every word once and overlap no other, of 1 / (extra words + 1)."""
    import re

    words = re.findall(r"\w+", text.lower())
    wanted, score, begin = set(query), 0.0, 0
    if not wanted:
        return 0.0
    last: dict[str, int] = {}
    for i, word in enumerate(words):
        if word not in wanted:
            continue
        last[word] = i
        if len(last) == len(wanted):
            begin = min(last.values())
            score += 1.0 / (i - begin + 1 - len(wanted) + 1)
            last = {w: p for w, p in last.items() if p > begin}
    return score


#: Bytes that separate words, as `\\s` has it, and odd multipliers of hashes modulo 2^64: of bytes, its inverse, of words.
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier of bytes and of its inverse, kept in the worker."""
    if not _powers or len(_powers[0]) < size:
        step = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(size, 1 << 16), x, np.uint64)]))
        _powers[:] = [step(_BYTE), step(pow(_BYTE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def window_keys(data: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
    """Hashes of all windows of so many words of a text, given as bytes of UTF-8. They are put together from hashes of words, so the white space between these does not matter."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _WHITE[data], [True]]).view(np.int8)))
    begin, end = edges[::2], edges[1::2]
    power, inverse = _power(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
    words = (total[end] - total[begin]) * inverse[begin]
    words ^= words >> np.uint64(29)
    found, sums, factor = {}, np.zeros(len(words) + 1, np.uint64), 1
    for n in range(1, max(widths) + 1):
        if len(words) < n:
            break
        sums = sums[: len(words) - n + 1] + words[n - 1 :] * np.uint64(factor)
        factor = factor * _WORD % (1 << 64)
        if n in widths:
            found[n] = sums.view(np.int64)
    return found


@F.pandas_udf(T.LongType())
def _own_key(head: pd.Series) -> pd.Series:
    """The one window of a text that has all its words."""
    found = [list(window_keys(np.frombuffer(h.encode("utf-8", "surrogatepass"), np.uint8), [len(h.split(" "))]).values()) for h in head]
    return pd.Series([f[0][0] if f else None for f in found], dtype="Int64")


#: Windows that leave Python together.
WINDOWS_AT_ONCE = 1 << 16


def keyed_windows(docs: DataFrame, key: str, text: str, widths: list[int]) -> DataFrame:
    """The key of each text with the widths (_n) and hashes (_key) of its windows. Texts are read where Arrow has them, one after another, and what they give leaves in small batches."""
    schema = T.StructType([docs.schema[key], T.StructField("_n", T.IntegerType()), T.StructField("_key", T.LongType())])
    arrow = to_arrow_schema(schema)

    def batch_of(ids: pa.Array, held: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sizes = [len(h) for _, _, h in held]
        rows, n = np.repeat([i for i, _, _ in held], sizes), np.repeat([n for _, n, _ in held], sizes).astype(np.int32)
        whole = pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(n), pa.array(np.concatenate([h for _, _, h in held]))], schema=arrow)
        for i in range(0, whole.num_rows, WINDOWS_AT_ONCE):
            yield whole.slice(i, WINDOWS_AT_ONCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            held, size = [], 0
            for i in range(batch.num_rows):
                if not texts[i].is_valid:
                    continue
                for n, hashes in window_keys(np.frombuffer(texts[i].as_buffer(), np.uint8), widths).items():
                    held.append((i, n, hashes))
                    size += len(hashes)
                if size >= WINDOWS_AT_ONCE:
                    yield from batch_of(ids, held)
                    held, size = [], 0
            if held:
                yield from batch_of(ids, held)

    return docs.select(key, text).mapInArrow(run, schema)


def literal_hits(docs: DataFrame, key: str, text: str, passages: DataFrame, passage_key: str, passage_text: str, width: int = 8) -> DataFrame:
    """Documents that hold a passage word for word, white space aside.

    A passage's first words, `width` or as many as it has, are its key. Of the windows of words of a document only those go on
    that are some passage's key, without the text; texts are fetched for the documents found, and compared in full.
    """
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    asked = passages.select(passage_key, flat(F.col(passage_text)).alias("_passage")).where("_passage <> ''")
    asked = asked.withColumn("_words", F.slice(F.split("_passage", " "), 1, width)).withColumn("_n", F.size("_words"))
    asked = settled(asked.select(passage_key, "_passage", "_n", _own_key(F.array_join("_words", " ")).alias("_key")))
    sizes = sorted(r["_n"] for r in asked.select("_n").distinct().collect())  # `width` numbers at most
    if not sizes:
        return asked.select(passage_key, F.lit(None).cast(docs.schema[key].dataType).alias(key))  # no passages
    keys = _small(settled(asked.select("_n", "_key").distinct()))
    hits = keyed_windows(docs, key, text, sizes).join(keys, ["_n", "_key"], "left_semi")
    pairs = _small(settled(hits.distinct().join(_small(asked.drop("_passage")), ["_n", "_key"]).select(key, passage_key).distinct()))
    exact = docs.select(key, F.col(text).alias("_text")).join(pairs, key).join(_small(asked.select(passage_key, "_passage")), passage_key)
    held = F.contains(F.concat(F.lit(" "), flat(F.col("_text")), F.lit(" ")), F.concat(F.lit(" "), "_passage", F.lit(" ")))
    return exact.where(held).select(passage_key, key).distinct()
