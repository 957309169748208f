"""Byte-level BPE by corpus-level merge replay."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import shared

#: Characters of text that are handled together, and bytes of new words that are merged together.
BLOCK = 1_000_000
#: Bytes of words a task remembers between blocks, each counted with the room it takes besides; beyond, it starts afresh.
REMEMBERED, ROOM = 24_000_000, 150


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Codec:
    """Encodes and decodes with the ranks of a vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        compiled = regex.compile(pattern)
        self.pieces, self.matches = compiled.findall, compiled.finditer
        self.ranks = ranks
        tokens = dict.fromkeys(range(max(ranks.values()) + 1), b"") | {r: t for t, r in ranks.items()}
        self.token_bytes = np.frombuffer(b"".join(tokens[i] for i in range(len(tokens))), dtype=np.uint8)
        self.token_ends = np.append(0, np.cumsum([len(tokens[i]) for i in range(len(tokens))])).astype(np.int64)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.shift = max(ranks.values()).bit_length()
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append((left << self.shift) | right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys, self.pair_ranks = np.array(keys, dtype=np.int64)[order], np.array(merged, dtype=np.int32)[order]
        self.forget()

    def forget(self) -> None:
        self.number, self.remembered = Numbers(), 0
        self.flat, self.counts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, or -1."""
        if not len(self.pair_keys):
            return np.full(len(left), -1, dtype=np.int32)
        key = (left.astype(np.int64) << self.shift) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.int32(-1))

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words end to end, and how many each word has.

        An index holds, for every rank, the positions of pairs that would merge to it. Ranks
        are taken lowest first; each merges all its pairs at once, leftmost first where they
        overlap, and only the pairs beside a merge are looked up anew. If a merge makes a pair
        of lower rank, as no trained vocabulary does, that word is merged by itself.
        """
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(data)
        token = self.of_byte[data]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)
        after[ends - 1] = -1
        before[(ends - sizes)] = -1
        pair = np.full(n, -1, dtype=np.int32)
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self.pair_rank(token[inner], token[inner + 1])

        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            for rank, i, j in zip(ranks[bounds[:-1]].tolist(), bounds[:-1], bounds[1:], strict=True):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(queue, rank)
                index[rank].append(at[i:j])

        known = inner[pair[inner] >= 0]
        if len(known):
            enter(known, pair[known])
        alone: set[int] = set()
        while queue:
            rank = heapq.heappop(queue)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                chained = after[at[:-1]] == at[1:]
                if chained.any():
                    i = np.arange(len(at))
                    first = np.maximum.accumulate(np.where(np.append(False, chained), 0, i))
                    at = at[(i - first) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            beside = np.flatnonzero(beyond[:-1] == at[1:]) + 1
            if len(beside):  # merged one by one, the second would meet the first as a pair
                between = self.pair_rank(np.full(len(beside), rank), token[at[beside]])
                alone.update(word[at[beside[(between >= 0) & (between < rank)]]].tolist())
            token[at] = rank
            token[gone] = -1
            pair[gone] = -1
            after[at] = beyond
            linked = beyond >= 0
            before[beyond[linked]] = at[linked]
            pair[at[~linked]] = -1
            previous = before[at]
            touched = np.concatenate([at[linked], previous[previous >= 0]])
            if len(touched):
                found = self.pair_rank(token[touched], token[after[touched]])
                pair[touched] = found
                new = found >= 0
                if new.any():
                    touched, found = touched[new], found[new]
                    if found.min() < rank:
                        alone.update(word[touched[found < rank]].tolist())
                    enter(touched, found)
        left = token >= 0
        out, counts = token[left].astype(np.int32), np.bincount(word[left], minlength=len(words))
        if alone:
            parts = np.split(out, np.cumsum(counts)[:-1])
            for i in alone:
                parts[i] = np.array(self.merged_alone(words[i]), dtype=np.int32)
            out, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return out, counts

    def merged_alone(self, word: bytes) -> list[int]:
        """One word, always merging the leftmost pair of lowest rank, from a heap of pairs."""
        parts: list[bytes | None] = [bytes([b]) for b in word]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        rank_at = lambda i: self.ranks.get(parts[i] + parts[after[i]], -1) if after[i] < len(parts) else -1
        queue = [(rank, i) for i in range(len(parts)) if (rank := rank_at(i)) >= 0]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            if parts[i] is None or rank_at(i) != rank:
                continue  # a merge beside it has changed the pair
            gone = after[i]
            parts[i], parts[gone] = parts[i] + parts[gone], None
            after[i] = after[gone]
            if after[i] < len(parts):
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and (rank := rank_at(j)) >= 0:
                    heapq.heappush(queue, (rank, j))
        return [self.ranks[p] for p in parts if p is not None]

    def learn(self, words: list[str]) -> None:
        """Appends the tokens of new words, numbered in order, some of them at a time."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum([len(w) for w in raw])
        self.remembered += int(ends[-1]) + ROOM * len(raw)
        first = 0
        while first < len(raw):
            upto = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, "right")))
            self._learn(raw[first:upto])
            first = upto

    def _learn(self, raw: list[bytes]) -> None:
        whole = np.array([self.ranks.get(w, -1) for w in raw], dtype=np.int32)
        rest = np.flatnonzero(whole < 0)
        tokens, counts = self.replay([raw[i] for i in rest.tolist()]) if len(rest) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        sizes = np.ones(len(raw), dtype=np.int64)
        sizes[rest] = counts
        flat = np.zeros(sizes.sum(), dtype=np.int32)
        merged = np.repeat(whole < 0, sizes)
        flat[merged], flat[~merged] = tokens, whole[whole >= 0]
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, sizes])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        if self.remembered > REMEMBERED:
            self.forget()
        number, told = self.number, len(self.number)
        numbers, sizes = [], []
        for text in texts:
            if len(text) > BLOCK:  # no list of all its words
                own = np.fromiter((number[m[0]] for m in self.matches(text)), dtype=np.int32)
            else:
                own = np.array([number[w] for w in self.pieces(text)], dtype=np.int32)
            numbers.append(own)
            sizes.append(len(own))
        if len(number) > told:
            self.learn(list(number)[told:])
        words = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        upto = np.append(0, np.cumsum(self.counts[words]))[np.append(0, np.cumsum(sizes)).astype(np.int64)]
        return self.flat[gathered(np.cumsum(self.counts) - self.counts, self.counts, words)], np.diff(upto)

    def decode(self, ids) -> bytes:
        return self.decoded(np.asarray(ids, dtype=np.int32)).tobytes()

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids end to end."""
        return self.token_bytes[gathered(self.token_ends[:-1], np.diff(self.token_ends), ids)]


def gathered(begins: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places of all elements of the chosen runs, one run behind the other."""
    counts = sizes[chosen]
    total = np.cumsum(counts)
    return np.repeat(begins[chosen] - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _codec(name: str, pattern: str) -> Codec:
    return Codec(read_ranks(SparkFiles.get(name)), pattern)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes, first, total = pc.utf8_length(texts).fill_null(0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > BLOCK:
            yield first, i
            first, total = i, 0
        total += n
    yield first, len(sizes)


def encode(docs: DataFrame, vocabulary: str, pattern: str, column: str = "text", decoded: bool = False, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds `ids`, the tokens of each whole text, and with `decoded` the bytes they decode to.

    `vocabulary` is a file of ranks on the driver, sent to the executors. The columns `keep` stay (all of
    the input by default), and only they and the text are sent to Python; columns named `ids` or `decoded` are replaced.

    Null or empty text: no ids. Repeated rows: each by itself. Empty table: no rows. A task handles a
    million characters at a time, or one text, whose words are numbered as they are met and merged a
    million bytes at a time; its memory does not grow with the table. A word of any length is one unit,
    for which the merge needs some 30 bytes a byte.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rstrip("/").rsplit("/", 1)[-1]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    stay = docs.select(*[F.col(f"`{c}`") for c in kept])
    sent = docs.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{column}`")] * (column not in kept))
    text_at = sent.columns.index(column)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        codec.forget()
        for batch in batches:
            for first, end in _blocks(batch.column(text_at)) if batch.num_rows else ():
                part = batch.slice(first, end - first)
                ids, counts = codec.encode([t or "" for t in part.column(text_at).to_pylist()])
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                columns = [*part.columns[: len(kept)], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
                if decoded:
                    data = codec.decoded(ids)
                    bounds = np.append(0, np.cumsum(np.diff(codec.token_ends)[ids]))[offsets].astype(np.int32)
                    columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]))
                yield pa.RecordBatch.from_arrays(columns, [*kept, "ids", *["decoded"] * decoded])
        codec.forget()  # the worker may wait for other work

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in stay.schema)
    return sent.mapInArrow(encoded, f"{fields}ids array<int>" + ", decoded binary" * decoded)


def decode(rows: DataFrame, vocabulary: str, column: str = "ids") -> DataFrame:
    """Adds `decoded`, the bytes of each list of ids, which must be of the vocabulary.

    Null list: null; empty list: no bytes. Repeated rows are decoded each by itself, an empty table gives no rows, and a column named `decoded` is replaced. A list is one row, however long.
    """
    rows.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rstrip("/").rsplit("/", 1)[-1]

    @F.pandas_udf("binary")
    def joined(ids):
        codec = _codec(name, "x")
        return ids.map(lambda x: None if x is None else codec.decode(x))

    return rows.withColumn("decoded", joined(F.col(column)))


def op6_merge_replay(spark, sf_dir):
    """Per document the number of tokens, and hashes of the ids and of the bytes they decode to; see `encode`."""
    import public_tokenizers

    docs = shared.documents(spark, sf_dir).select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True, keep=("doc_id",))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
