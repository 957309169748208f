"""Suffix-array dedup: removes bytes that lie in long strings occurring more than once.

Sorting every suffix of a corpus is far more work than the repeats in it need. Each string of
`length` bytes is therefore named by its anchor, the substring of ANCHOR bytes with the least
hash; equal strings have equal anchors at equal offsets. Where an anchor occurs in several
surroundings, their strings are sorted as suffixes, by comparisons on prefix hashes, and equal neighbours are
compared byte by byte. Whole surroundings that are equal, and the strings around anchors that very many
texts share, are told by 128-bit digests of their bytes, which no known input makes collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import shared
from annalist.llm.jaccard import by_runs
from annalist.llm.shingles import mixed, powers

#: Bytes of strings that are removed where they repeat, and of those that are only reported: some fifty words.
LENGTH, REPORTED = 400, 260
#: Longest strings that rows have room for.
MOST_LENGTH = (1 << 16) - 1
#: Share of a string's length that its anchor has.
ANCHOR_SHARE = 0.48
#: Bytes of text handled at once; longer texts are cut into overlapping pieces.
SPAN = (1 << 21) - 8192
#: Surroundings of one anchor that are sorted in one task; anchors with more go by single strings.
MOST_SORTED = 512
#: Surroundings of one anchor that a batch of texts sends to the anchor's task; where it has more they go by single strings at once.
HOT = 512

#: Kinds of rows: spans that are final (key: a hash of the row, ctx: end, ctx2: level, at: start), surroundings of anchors, and surroundings
#: that go by single strings (under a key of their own). A surrounding with info MARK only tells that there are such.
SPAN_ROW, AROUND, CROWDED, MARK = 0, 1, 2, -1
ROWS = "kind int, key long, ctx long, ctx2 long, doc_id long, row long, at long, info long"
SORTED = ["key", "kind", "ctx", "ctx2", "doc_id", "row", "at", "info"]
SPANS = "doc_id long, row long, start long, end long, level int"


class Rolling:
    """Hashes of all substrings modulo 2**64, to choose anchors by. That others collide does no harm there."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64))

    def of(self, start: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[start + size] - self.sums[start]) * self.down[start]


#: A prime below 2**50, so that products modulo it can be had from doubles.
PRIME = 2**50 - 27


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME: the quotient from doubles is off by one at most."""
    with np.errstate(over="ignore"):
        rest = (a * b - (a.astype(np.float64) * b.astype(np.float64) / PRIME).astype(np.uint64) * np.uint64(PRIME)).view(np.int64)
    rest = np.where(rest < 0, rest + PRIME, rest)
    return np.where(rest >= PRIME, rest - PRIME, rest).view(np.uint64)


@lru_cache(maxsize=2)
def _geometric(base: int, n: int) -> np.ndarray:
    """base**i modulo PRIME for i < n."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.append(out, times(out, np.full(len(out), pow(base, len(out), PRIME), dtype=np.uint64)))
    return out


def _running(values: np.ndarray) -> np.ndarray:
    """Running sums modulo PRIME of numbers below it."""
    rows = -(-len(values) // 8192)
    grid = np.zeros(rows * 8192, dtype=np.uint64)
    grid[: len(values)] = values
    grid = np.cumsum(grid.reshape(rows, 8192), axis=1, dtype=np.uint64) % np.uint64(PRIME)
    if rows > 1:
        grid[1:] += _running(grid[:, -1])[:-1, None]
    return grid.ravel()[: len(values)] % np.uint64(PRIME)


class Hashes:
    """Prefix polynomial hashes of bytes modulo a prime: hashes of all substrings, and order of suffixes."""

    def __init__(self, data: np.ndarray, base: int = 0x2A5C_1D2E_37B9):
        self.data, n = data, 1 << (len(data) + 1).bit_length()
        up, self.down = _geometric(base, n), _geometric(pow(base, -1, PRIME), n)
        terms = (data.astype(np.uint64) + np.uint64(1)) * up[: len(data)] % np.uint64(PRIME)
        self.sums = np.append(np.uint64(0), _running(terms))

    def of(self, start: np.ndarray, size) -> np.ndarray:
        between = self.sums[start + size] + np.uint64(PRIME) - self.sums[start]
        return times(np.where(between >= PRIME, between - np.uint64(PRIME), between), self.down[start])

    def common(self, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
        """Length of the common beginning of suffixes, `most` at most, by binary search."""
        out = np.full(len(p), most)
        apart = np.flatnonzero(self.of(p, most) != self.of(q, most))
        p, q = p[apart], q[apart]
        low, high = np.zeros(len(p), dtype=np.int64), np.full(len(p), most - 1)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.of(p, middle) == self.of(q, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        out[apart] = low
        return out

    def before(self, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
        """-1, 0 or 1 as the suffix at p is less than, equal to or greater than that at q in `most` bytes."""
        n = self.common(p, q, most)
        rest = n < most
        out = np.zeros(len(p), dtype=np.int64)
        out[rest] = np.sign(self.data[p[rest] + n[rest]].astype(np.int64) - self.data[q[rest] + n[rest]])
        return out

    def sorted_within(self, suffixes: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
        """Order that sorts suffixes inside each group (equal numbers, side by side) by merging.

        All runs of one width are merged with their neighbours at once: the place of an element
        is its place in its own run plus the number of elements of the other that precede it,
        found by binary search.
        """
        n = len(suffixes)
        order = np.arange(n)
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, n))
        begin, size = np.repeat(starts, counts), np.repeat(counts, counts)
        place = np.arange(n) - begin
        width, largest = 1, int(counts.max(initial=0))
        while width < largest:
            pair = place // (2 * width) * (2 * width)
            right = place - pair >= width
            other = begin + np.where(right, pair, pair + width)
            limit = np.minimum(np.where(right, width, np.clip(size - pair - width, 0, width)), n)
            low, high = np.zeros(n, dtype=np.int64), limit.astype(np.int64)
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                sign = self.before(suffixes[order[other[open_] + middle]], suffixes[order[open_]], most)
                precedes = (sign < 0) | ((sign == 0) & right[open_])
                low[open_] = np.where(precedes, middle + 1, low[open_])
                high[open_] = np.where(precedes, high[open_], middle)
            own = place - pair - np.where(right, width, 0)
            target = begin + pair + own + low
            merged = np.empty(n, dtype=np.int64)
            merged[target] = order
            order = merged
            width *= 2
        return order


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, reported: int, most: int) -> tuple[np.ndarray, ...]:
    """The anchors of all strings of `reported` bytes that begin in the first `most` bytes of the pieces data[bounds[i]:bounds[i + 1]].

    Returns for each run of strings that share an anchor: first and last start, anchor's place and hash, end of the
    surrounding, which is that of a string of `length` bytes at the last start or of its piece, and in two halves the surrounding's digest.
    """
    size = max(1, int(reported * ANCHOR_SHARE))
    n = len(data)
    grams = mixed(Rolling(data).of(np.arange(n - size + 1), size))
    mask = np.uint64((1 << int(n).bit_length()) - 1)
    owner = (window_minima((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), reported - size + 1) & mask).astype(np.int64)
    inside = np.ones(len(owner), dtype=bool)
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        inside[max(begin, min(begin + most, end - reported + 1)) : end] = False
    change = np.append(True, (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1]))
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(owner)) - 1
    first, last = first[inside[first]], last[inside[first]]
    at, end = owner[first], np.minimum(last + length, bounds[np.searchsorted(bounds, last, "right")])
    ctx = digests(data, first, end)
    with np.errstate(over="ignore"):
        ctx[:, 0] += (at - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + (at - last).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return first, last, at, end, grams[at].view(np.int64), ctx[:, 0].view(np.int64), ctx[:, 1].view(np.int64)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of a cryptographic digest of each range of bytes, as two numbers: equal ones are taken for equal bytes."""
    raw = memoryview(np.ascontiguousarray(data))
    found = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(found, dtype=np.uint64).reshape(-1, 2).copy()


def _pieces(sizes: list[int], length: int, reported: int, span: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, begin, end) of about `span` bytes; pieces of one text overlap, and a string belongs to that in whose first `span` bytes it begins."""
    held, total = [], 0
    for i, size in enumerate(sizes):
        for begin in range(0, size - reported + 1, span):
            end = min(size, begin + span + length - 1)
            if held and total + end - begin > span:
                yield held
                held, total = [], 0
            held.append((i, begin, end))
            total += end - begin
    if held:
        yield held


def _packed(first, last, at, end, n) -> np.ndarray:
    """How far the first and last start are before the anchor, the surrounding's bytes behind the last start, and 1, or 2 for several."""
    return ((at - first) << 40) | ((at - last) << 18) | ((end - last) << 2) | n


def _unpacked(info: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return info >> 40, (info >> 18) & ((1 << 22) - 1), (info >> 2) & MOST_LENGTH, info & 3


def _told_spans(first: np.ndarray, last: np.ndarray, room: np.ndarray, length: int, reported: int) -> tuple[np.ndarray, ...]:
    """Of runs of starts whose strings all repeat, with the bytes there are behind the last start: index, start, end and level of the spans.

    Level 1 is what strings of `reported` bytes cover, level 0 what those of `length` bytes do.
    """
    most = np.minimum(last, last + room - length)  # the last start of a whole string
    whole = np.flatnonzero(most >= first)
    every = np.arange(len(first))
    level = np.repeat([1, 0], [len(every), len(whole)])
    return np.append(every, whole), np.append(first, first[whole]), np.append(last + reported, most[whole] + length), level


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _combined(columns: list[np.ndarray], doc_ids: pa.Array, texts: np.ndarray, length: int, reported: int, most: int) -> pa.RecordBatch:
    """Rows of a batch, with one row for each surrounding.

    Where a surrounding occurs twice in the batch, all its places are known to repeat: their
    spans are final, and one row marked by n = 2 stands for them. So copies and common
    passages leave a task as single rows. An anchor with more than `most` surroundings is crowded: its
    rows are dealt out one by one, and its own task only gets a mark.
    """
    key, ctx, ctx2, row, at, first, last, room = columns
    order = np.lexsort((ctx2, ctx, key))
    key, ctx, ctx2, row, at, first, last, room, texts = (x[order] for x in (key, ctx, ctx2, row, at, first, last, room, texts))
    new_key = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, dtype=bool)
    starts = np.flatnonzero(new_key | np.append(True, (ctx[1:] != ctx[:-1]) | (ctx2[1:] != ctx2[:-1]))) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(key)))
    repeated = np.flatnonzero(np.repeat(counts > 1, counts))
    i, span_start, span_end, level = _told_spans(first[repeated], last[repeated], room[repeated], length, reported)
    span_row, span_start, span_end, tag = _merged(row[repeated][i], span_start, span_end, texts[repeated][i] * 2 + level)
    span_text, level = tag >> 1, tag & 1
    info = _packed(first[starts], last[starts], at[starts], last[starts] + room[starts], np.minimum(counts, 2))
    heads = np.flatnonzero(new_key[starts])
    hot = np.diff(np.append(heads, len(starts))) > most
    crowded, marks = np.repeat(hot, np.diff(np.append(heads, len(starts)))), starts[heads[hot]]
    own = np.where(crowded, ctx[starts], key[starts])
    docs = doc_ids.take(pa.array(np.concatenate([texts[starts], span_text, texts[marks]])))
    n, m, k = len(starts), len(span_row), len(marks)
    zero = np.zeros(k, np.int64)
    out = [
        np.concatenate([np.where(crowded, CROWDED, AROUND), np.full(m, SPAN_ROW), np.full(k, AROUND)]), np.concatenate([own, mixed(span_row.view(np.uint64)).view(np.int64), key[marks]]),
        np.concatenate([ctx[starts], span_end, zero]), np.concatenate([ctx2[starts], level, zero]), docs,
        np.concatenate([row[starts], span_row, row[marks]]), np.concatenate([at[starts], span_start, zero]), np.concatenate([info, np.zeros(m, np.int64), np.full(k, MARK)]),
    ]
    return _batch(out, ROWS)


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each row merged where they touch; `tag` goes with the row."""
    if not len(row):
        return row, start, end, tag
    order = np.lexsort((start, tag, row))
    row, start, end, tag = row[order], start[order], end[order], tag[order]
    new = np.append(True, (row[1:] != row[:-1]) | (tag[1:] != tag[:-1]))
    group = np.cumsum(new) - 1
    shift = group * (int(end.max()) + 1)  # so that one running maximum serves all rows
    reach = np.maximum.accumulate(end + shift)
    fresh = np.append(True, (start + shift)[1:] > reach[:-1]) | new
    begins = np.flatnonzero(fresh)
    ends = np.append(begins[1:], len(row)) - 1
    return row[begins], start[begins], (reach - shift)[ends], tag[begins]


def _found_anchors(length: int, reported: int, span: int, hot: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data_of = batch.column(2)
            sizes = [len(x) for x in map(memoryview, (b.as_buffer() for b in data_of))]
            columns, texts = [], []
            rows = batch.column(1).to_numpy()
            for pieces in _pieces(sizes, length, reported, span):
                parts = [np.frombuffer(data_of[i].as_buffer(), dtype=np.uint8)[begin:end] for i, begin, end in pieces]
                bounds = np.append(0, np.cumsum([len(p) for p in parts]))
                first, last, at, end, key, ctx, ctx2 = anchors(np.concatenate(parts), bounds, length, reported, span)
                piece = np.searchsorted(bounds, first, "right") - 1
                text = np.array([i for i, _, _ in pieces])[piece]
                shift = np.array([b for _, b, _ in pieces])[piece] - bounds[piece]
                columns.append([key, ctx, ctx2, rows[text], at + shift, first + shift, last + shift, end - last])
                texts.append(text)
            if columns:
                yield _combined([np.concatenate(c) for c in zip(*columns, strict=True)], batch.column(0), np.concatenate(texts), length, reported, hot)

    return found


def _settled(length: int, reported: int, keep_open: bool):
    """From rows in the order of SORTED: spans of surroundings seen twice, and the surroundings of anchors that have several, or that are crowded."""

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_runs(batches):
            table = table.combine_chunks()
            kind, key, ctx, ctx2, at, info = (table.column(c).to_numpy() for c in ("kind", "key", "ctx", "ctx2", "at", "info"))
            is_span, mark = kind == SPAN_ROW, (kind == AROUND) & (info == MARK)
            before, after, room, n = _unpacked(info)
            n = np.where(is_span | mark, 0, n)
            new_key = np.append(True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]))
            new = new_key | np.append(True, (ctx[1:] != ctx[:-1]) | (ctx2[1:] != ctx2[:-1]))
            starts = np.flatnonzero(new)
            counts = np.diff(np.append(starts, len(key)))
            seen = np.repeat(np.add.reduceat(n, starts), counts)
            told = np.flatnonzero((seen > 1) & (n == 1))
            key_starts = np.flatnonzero(new_key)
            of_key = np.diff(np.append(key_starts, len(key)))
            marked = np.repeat(np.add.reduceat(mark.astype(np.int64), key_starts) > 0, of_key) | (kind == CROWDED)
            first = new & (n > 0)
            several = np.repeat(np.add.reduceat(first.astype(np.int64), key_starts), of_key) > 1
            open_ = np.flatnonzero(first & (several | marked)) if keep_open else np.zeros(0, np.int64)
            given = np.flatnonzero(is_span)
            take = lambda name, i: table.column(name).take(pa.array(i)).combine_chunks()
            i, start, end, level = _told_spans((at - before)[told], (at - after)[told], room[told], length, reported)
            every = np.concatenate([given, told[i]])
            if len(every):
                zero = np.zeros(len(every), np.int64)
                yield _batch([zero.astype(np.int32), zero, np.append(ctx[given], end), np.append(ctx2[given], level), take("doc_id", every), take("row", every), np.append(at[given], start), zero], ROWS)
            if len(open_):
                kinds = np.where(marked[open_], CROWDED, AROUND).astype(np.int32)
                yield _batch([kinds, *[take(c, open_) for c in ("key", "ctx", "ctx2", "doc_id", "row", "at", "info")]], ROWS)

    return settled


def _with_bytes():
    """The bytes around each open anchor of a text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, info, doc, at, kind, data = [], [], [], [], [], []
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_buffer()
                for x in batch.column(3)[i].as_py():
                    before, after, room, _ = _unpacked(x["info"])
                    key.append(x["key"])
                    info.append(x["info"])
                    at.append(x["at"])
                    kind.append(x["kind"])
                    data.append(memoryview(text)[x["at"] - before : x["at"] - after + room].tobytes())
                    doc.append(i)
            take = lambda c: batch.column(c).take(pa.array(doc, pa.int64()))
            yield _batch([key, take(0), take(1), at, info, data, kind], OPEN)

    return cut


OPEN = "key long, doc_id long, row long, at long, info long, data binary, kind int"


def repeated(names: np.ndarray) -> np.ndarray:
    """Which numbers occur more than once."""
    order = np.argsort(names)
    equal = np.flatnonzero(names[order[1:]] == names[order[:-1]])
    out = np.zeros(len(names), dtype=bool)
    out[order[equal]] = out[order[equal + 1]] = True
    return out


def some_runs(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.Table]:
    """Tables of whole runs of the first column that hold some `most` bytes of `data`, or one run."""
    for table in by_runs(batches):
        key = table.column(0).to_numpy()
        bounds = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        size = np.append(0, np.cumsum(pc.binary_length(table.column("data")).to_numpy()))[bounds]
        first = 0
        while first < len(bounds) - 1:
            upto = max(first + 1, int(np.searchsorted(size, size[first] + most, "right")) - 1)
            yield table.slice(bounds[first], bounds[upto] - bounds[first]).combine_chunks()
            first = upto


#: What stands behind a surrounding that ends with its text. It is no byte.
NOTHING = 256


def _sorted_repeats(length: int, reported: int):
    """Spans of strings that occur in two surroundings of an anchor, by sorting the suffixes that begin them."""

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in some_runs(batches):
            key, at, info, row = (table.column(c).to_numpy() for c in ("key", "at", "info", "row"))
            before, after, room, _ = _unpacked(info)
            raw = table.column("data").to_pylist()
            padded = np.maximum(length - room, 0)  # so that `length` places follow every start
            sizes = np.array([len(b) for b in raw], dtype=np.int64)
            offset = np.cumsum(sizes + padded) - sizes - padded
            data = np.full(int((sizes + padded).sum()), NOTHING, dtype=np.int16)
            data[np.repeat(offset - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))] = np.frombuffer(b"".join(raw), dtype=np.uint8)
            counts = before - after + 1
            of = np.repeat(np.arange(len(raw)), counts)
            turn = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            run = np.cumsum(np.append(True, key[1:] != key[:-1]))[of]
            hashes = Hashes(data)
            far = before[of] - turn  # equal strings stand equally far before the anchor
            with np.errstate(over="ignore"):
                met = repeated(mixed(hashes.of(offset[of] + turn, reported) + mixed((run.astype(np.uint64) << np.uint64(20)) + far.astype(np.uint64))))
            of, turn, run, far = of[met], turn[met], run[met], far[met]  # the others occur once
            if not len(of):
                continue
            order = np.lexsort((far, run))
            of, turn, run, far = of[order], turn[order], run[order], far[order]
            group = np.cumsum(np.append(True, (run[1:] != run[:-1]) | (far[1:] != far[:-1])))
            suffix = offset[of] + turn
            order = hashes.sorted_within(suffix, group, length)
            suffix, of, turn = suffix[order], of[order], turn[order]
            whole = sizes[of] - turn >= length
            for level, size in enumerate((length, reported)):
                fits = whole[1:] & whole[:-1] if level == 0 else np.ones(max(len(suffix) - 1, 0), dtype=bool)
                same = np.flatnonzero(fits & (group[1:] == group[:-1]) & (hashes.of(suffix[1:], size) == hashes.of(suffix[:-1], size)))
                same = same[_verified(data, suffix[same], suffix[same + 1], of[same], of[same + 1], turn[same], size)]
                hit = np.unique(np.concatenate([same, same + 1]))
                start = (at - before)[of[hit]] + turn[hit]
                row_, start, end, which = _merged(row[of[hit]], start, start + size, of[hit])
                if len(row_):
                    yield _batch([table.column("doc_id").take(pa.array(which)).combine_chunks(), row_, start, end, np.full(len(row_), level)], SPANS)

    return repeats


def _verified(data, p, q, i, j, turn, length: int) -> np.ndarray:
    """Which pairs of strings are equal byte by byte.

    Of pairs in the same two surroundings with starts in a row, the first and the last cover
    all bytes of the rest, which are fewer than a length apart.
    """
    ok = np.ones(len(p), dtype=bool)
    if not len(p):
        return ok
    order = np.lexsort((turn, j, i))
    linked = (i[order][1:] == i[order][:-1]) & (j[order][1:] == j[order][:-1]) & (turn[order][1:] == turn[order][:-1] + 1)
    starts = np.flatnonzero(np.append(True, ~linked))
    ends = np.append(starts[1:], len(p)) - 1
    rows = np.lib.stride_tricks.sliding_window_view(data, length)
    for a in range(0, len(starts), 4096):
        for edge in (starts[a : a + 4096], ends[a : a + 4096]):
            equal = (rows[p[order[edge]]] == rows[q[order[edge]]]).all(axis=1)
            for bad in np.flatnonzero(~equal) + a:  # a collision: check each string of the run
                for x in order[starts[bad] : ends[bad] + 1]:
                    ok[x] = bool((rows[p[x]] == rows[q[x]]).all())
    return ok


#: Strings of a crowded anchor that begin so many bytes apart, at most, are first told together.
BLOCK = 32
BLOCKS = "doc_id long, row long, at long, info long, block int, level int, core1 long, core2 long, whole1 long, whole2 long"


def _block_names(length: int, reported: int):
    """Around a crowded anchor, blocks of strings that begin 32k to 32k + 31 bytes before it, for each of the two lengths.

    A block is named twice: by its core, the bytes that any such strings have in common, and by all bytes of those that there are. Where no other block has its core, none of
    its strings repeats; where another is equal as a whole, all do.
    """

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, info = (batch.column(c).to_numpy() for c in (3, 4))
            before, after, _, _ = _unpacked(info)
            raw = batch.column(5).to_pylist()
            data = np.frombuffer(b"".join(raw), dtype=np.uint8)
            sizes = np.array([len(b) for b in raw], dtype=np.int64)
            anchor = np.cumsum(sizes) - sizes + before
            for level, size in enumerate((length, reported)):
                near = np.maximum(after, before - (sizes - size))  # the last string that fits begins so far before the anchor
                first, last = near // BLOCK, np.where(near <= before, before // BLOCK, near // BLOCK - 1)
                counts = last - first + 1
                of = np.repeat(np.arange(len(raw)), counts)
                block = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                low, high = np.maximum(block * BLOCK, near[of]), np.minimum(block * BLOCK + BLOCK - 1, before[of])
                end = anchor[of] - (block * BLOCK + BLOCK - 1) + size
                core = digests(data, np.minimum(anchor[of] - block * BLOCK, end), end)
                whole = digests(data, anchor[of] - high, anchor[of] - low + size)
                with np.errstate(over="ignore"):
                    place = mixed((block * 2 + level).astype(np.uint64))
                    core[:, 0] += place
                    whole[:, 0] += place + mixed((low * BLOCK * 8 + high).astype(np.uint64))
                take = lambda c: batch.column(c).take(pa.array(of))
                yield _batch([take(1), take(2), take(3), take(4), block, np.full(len(of), level), *(x.view(np.int64) for x in (core[:, 0], core[:, 1], whole[:, 0], whole[:, 1]))], BLOCKS)

    return names


def _single_strings(length: int, reported: int):
    """Every string of the blocks asked for as a row of its own, named by its digest."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, info, row = (batch.column(c).to_numpy() for c in (3, 4, 2))
            before, after, _, _ = _unpacked(info)
            raw = batch.column(5).to_pylist()
            data = np.frombuffer(b"".join(raw), dtype=np.uint8)
            sizes = np.array([len(b) for b in raw], dtype=np.int64)
            offset, counts = np.cumsum(sizes) - sizes, before - after + 1
            of = np.repeat(np.arange(len(raw)), counts)
            turn = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            told, asked = batch.column(7).offsets.to_numpy(), batch.column(7).values
            owner = np.repeat(np.arange(len(raw)), np.diff(told))
            block, levels = (asked.field(c).to_numpy()[told[0] : told[-1]].astype(np.int64) for c in ("block", "level"))
            for level, size in enumerate((length, reported)):
                wanted = ((owner << 20) | block)[levels == level]
                there = (sizes[of] - turn >= size) & np.isin((of << 20) | (before[of] - turn) // BLOCK, wanted)
                i, place = of[there], (offset[of] + turn)[there]
                name = digests(data, place, place + size).view(np.int64)
                start = (at - before)[i] + turn[there]
                yield _combined([name[:, 0], name[:, 1], np.full(len(i), size), row[i], start, start, start, np.full(len(i), size)], batch.column(1), i, length, reported, len(i))

    return strings


def _crowded_spans(around: DataFrame, length: int, reported: int) -> DataFrame:
    """Spans of strings that repeat around crowded anchors, told from coarse to fine: blocks first, then the strings of those blocks that share their core and are not alike.

    Of equal blocks one stands for all, so copies of a passage send few rows, and nothing of a hot anchor has to be in one task.
    """
    dealt = shared.partitions(around.sparkSession)
    core, whole = ["core1", "core2"], ["whole1", "whole2"]
    blocks = shared.written(around.mapInArrow(_block_names(length, reported), BLOCKS), "blocks")
    kinds = blocks.groupBy(*core, *whole).agg(F.count("*").alias("n"), F.min(F.struct("row", "at", "info", "block", "level")).alias("one"))
    cores = shared.written(kinds.groupBy(*core).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1"), "cores")
    kinds = shared.written(kinds.join(cores, core), "kinds")
    alike = blocks.join(kinds.where("n > 1").select(*core, *whole), [*core, *whole])
    before, after, room = F.shiftright("info", 40), F.shiftright("info", 18).bitwiseAND((1 << 22) - 1), F.shiftright("info", 2).bitwiseAND(MOST_LENGTH)
    size = F.when(F.col("level") == 0, length).otherwise(reported)
    low = F.greatest(F.col("block") * BLOCK, after, after - room + size)
    high = F.least(F.col("block") * BLOCK + (BLOCK - 1), before)
    told = alike.select("doc_id", "row", (F.col("at") - high).alias("start"), (F.col("at") - low + size).alias("end"), "level")

    asked = kinds.where("kinds > 1").select("one.*").groupBy("row", "at", "info").agg(F.collect_list(F.struct("block", "level")).alias("blocks"))
    fine = around.join(asked, ["row", "at", "info"]).select("key", "doc_id", "row", "at", "info", "data", "kind", "blocks").mapInArrow(_single_strings(length, reported), ROWS)
    fine = fine.repartition(dealt, "key").select(*SORTED).sortWithinPartitions("key", "kind", "ctx", "ctx2")
    return told.union(_final(fine.mapInArrow(_settled(length, reported, False), ROWS)))


def _final(rows: DataFrame) -> DataFrame:
    told = rows.where(F.col("kind") == SPAN_ROW)
    return told.select("doc_id", "row", F.col("at").alias("start"), F.col("ctx").alias("end"), F.col("ctx2").cast("int").alias("level"))


def repeated_spans(docs: DataFrame, length: int, reported: int) -> DataFrame:
    """doc_id, row (hash of doc_id and text) and spans of bytes of repeated strings, as an array of (start, end, level): 0 for `length` bytes, 1 for `reported`."""
    if not 0 < reported <= length <= MOST_LENGTH:
        raise ValueError("0 < reported <= length <= MOST_LENGTH")
    spark = docs.sparkSession
    dealt = shared.partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("data"))
    texts = texts.where(F.length("data") >= reported)

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition(dealt, "key").select(*SORTED).sortWithinPartitions("key", "kind", "ctx", "ctx2")

    rows = texts.mapInArrow(_found_anchors(length, reported, SPAN, HOT), ROWS)
    found = shared.written(in_order(rows).mapInArrow(_settled(length, reported, True), ROWS), "anchors")

    opened = found.where(F.col("kind") != SPAN_ROW)
    crowded = opened.where(F.col("kind") == AROUND).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST_SORTED).select(F.col("key").alias("crowded"))
    by_text = opened.groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "at", "info", "kind")).alias("open"))
    t, o = texts.alias("t"), by_text.alias("o")
    same = F.col("t.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("t.row") == F.col("o.row"))
    picked = t.join(o, same).select("t.doc_id", "t.row", "t.data", "o.open")
    around = picked.mapInArrow(_with_bytes(), OPEN).join(crowded, F.col("key") == F.col("crowded"), "left")
    around = shared.written(around.withColumn("single", F.col("crowded").isNotNull() | (F.col("kind") == CROWDED)).drop("crowded"), "surroundings")

    few = around.where("NOT single").drop("single").repartition(dealt, "key").sortWithinPartitions("key").mapInArrow(_sorted_repeats(length, reported), SPANS)
    spans = _final(found).union(few).union(_crowded_spans(around.where("single").drop("single"), length, reported))
    return spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "end", "level")).alias("spans"))


CUT = "n_bytes long, n_removed long, n_repeated long, spans array<struct<start:long,end:long>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, reported: int | None = None) -> DataFrame:
    """Removes every byte covered by a string of `length` bytes that also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_repeated (bytes covered by strings of `reported` bytes, no more than `length`, that also
    start anywhere else; they stay unless `length` removes them), spans (maximal removed runs, in bytes) and kept (the
    remaining bytes). Strings are judged on the input, never cross documents, and may repeat inside one document or overlap.

    Null text counts as empty; texts shorter than `length` stay whole. Rows that repeat in full
    are copies of one another. Null doc_id: a row as any other. Empty table: no rows. Other
    columns are ignored. Texts are read a few megabytes at a time; a text and the list of its open anchors are one row,
    so a text must stay below 2 GB.
    """
    spans = repeated_spans(docs, length, min(REPORTED, length) if reported is None else reported)
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), shared.text_or_empty().cast("binary").alias("data")).alias("t")
    s = spans.alias("s")
    same = F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.row") == F.col("s.row"))
    marked = t.join(s, same, "left").select("t.doc_id", "t.data", "s.spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, repeated, spans, kept = [], [], [], [], []
            for i in range(batch.num_rows):
                data, found = memoryview(batch.column(1)[i].as_buffer()), batch.column(2)[i].as_py() or []
                at = np.array([(x["start"], x["end"], x["level"]) for x in found], dtype=np.int64).reshape(-1, 3)
                _, start, end, level = _merged(np.zeros(len(at), dtype=np.int64), at[:, 0], at[:, 1], at[:, 2])
                own = list(zip(start[level == 0].tolist(), end[level == 0].tolist(), strict=True))
                edges = [0, *[x for span in own for x in span], len(data)]
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in own))
                repeated.append(int((end - start)[level == 1].sum()))
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            counts = [pa.array(c, pa.int64()) for c in (sizes, removed, repeated)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_repeated", "spans", "kept"])

    return marked.mapInArrow(cut, f"doc_id long, {CUT}")


def op2_suffix_dedup(spark, sf_dir):
    """Bytes of 400-byte strings that start anywhere else are removed; `n_repeated` reports those of passages of some fifty words. See `remove_repeats`."""
    kept = remove_repeats(shared.documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")
