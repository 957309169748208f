"""N-gram Jaccard join: candidates by set partitions, verified in prefix trees."""

from __future__ import annotations

import secrets
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import shared
from annalist.llm.components import components
from annalist.llm.shingles import blocks, mixed, shingle_sets

#: Sets, and elements of them, that one tree holds at most; larger candidate components are verified by links, and what those leave open in tiles of two parts.
TREE_SETS, TREE_ELEMENTS = 4096, 4_000_000
#: Sets that a task remembers in order to skip equal ones.
REMEMBERED = 500_000
#: Candidates of up to this many rows are broadcast to pick their texts; more are joined by shuffle.
BROADCAST_IDS = 500_000


class Sizes:
    """Ranges of set sizes, and the partition that pairs whose larger set is in a range share.

    Sets of similarity p % differ in at most (100 - p) / (100 + p) of their summed sizes. A
    universe cut into more parts than that therefore has parts in which both are equal.
    """

    def __init__(self, percent: int):
        self.percent, self.tops = percent, [0]

    def range_of(self, size: int) -> int:
        while self.tops[-1] < size:
            top = self.tops[-1]
            self.tops.append(max(top + 1, top * 100 // self.percent))
        return int(np.searchsorted(self.tops, size))

    def ranges(self, size: int) -> range:
        """The ranges in which a set of this size can meet one that is not smaller."""
        return range(self.range_of(size), self.range_of(size * 100 // self.percent) + 1)

    def differing(self, k: int) -> int:
        return (100 - self.percent) * 2 * self.tops[k] // (100 + self.percent)

    def bits(self, k: int) -> int:
        return 64 * max(1, -(-4 * self.differing(k) // 64))


@lru_cache(maxsize=4)
def _sizes(percent: int) -> Sizes:
    return Sizes(percent)


def part_keys(found: np.ndarray, sizes: Sizes, k: int) -> np.ndarray:
    """Keys of parts: equal keys mean equal parts of sets in one size range, whose number is the key's last byte.

    There are half as many parts again as a difference in one each needs, so similar sets agree on more of
    them than are left out: the smallest, which are empty or hold what many documents share.
    """
    kept = sizes.differing(k) + 1
    parts = kept + kept // 2
    at = ((found >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # ascending, as the set is sorted
    with np.errstate(over="ignore"):
        upto = np.append(np.uint64(0), np.cumsum(mixed(found + np.uint64(k)), dtype=np.uint64))
        cuts = np.searchsorted(at, np.arange(parts + 1, dtype=np.uint64))
        keys = upto[cuts[1:]] - upto[cuts[:-1]]
        keys = mixed(keys + np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k << 40))
    keys = keys[np.argsort(cuts[:-1] - cuts[1:], kind="stable")[:kept]]
    return ((keys & ~np.uint64(255)) | np.uint64(k & 255)).view(np.int64)


def parity(found: np.ndarray, bits: int) -> bytes:
    """Bit i: whether an odd number of elements falls on i. Sets differ in as many elements at least as these bits do."""
    return np.packbits(np.bincount((((mixed(~found) >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def set_hash(found: np.ndarray) -> int:
    return int(mixed(found).sum(dtype=np.uint64).view(np.int64))


#: What the first pass gives: keys of parts with the set that has them, and for each row, under a key of its own, what is known of its set.
KEYED = "key long, node long, info binary"
#: Names of groups with their members, and for each row of the input its set: two hashes, and parity bits and bound for each of its size ranges.
NAMED = "name long, member long, doc_id long, text_hash long, n long, h2 long, bits array<binary>, most array<int>, low_range int"
_HEAD = struct.Struct("<?qqqqi")


def _packed(doc_id: int | None, text_hash: int, found: np.ndarray, sizes: Sizes) -> bytes:
    with np.errstate(over="ignore"):
        h2 = int(mixed(found * np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).view(np.int64))
    ranges = sizes.ranges(len(found)) if len(found) else range(0)
    parts = [_HEAD.pack(doc_id is not None, doc_id or 0, text_hash, len(found), h2, ranges.start & 255)]
    for k in ranges:
        bits = parity(found, sizes.bits(k))
        parts += [struct.pack("<ii", sizes.differing(k), len(bits)), bits]
    return b"".join(parts)


def _unpacked(info: bytes) -> tuple:
    known, doc_id, text_hash, n, h2, low = _HEAD.unpack_from(info)
    at, bits, most = _HEAD.size, [], []
    while at < len(info):
        bound, size = struct.unpack_from("<ii", info, at)
        bits.append(info[at + 8 : at + 8 + size])
        most.append(bound)
        at += 8 + size
    return doc_id if known else None, text_hash, n, h2, bits, most, low


def keyed_rows(docs: DataFrame, width: int, percent: int, secret: int) -> DataFrame:
    """The rows of KEYED, from one pass over the texts. Of equal sets a task gives the keys once."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, seen = _sizes(percent), set()
        for batch in batches:
            ids, hashes = (batch.column(c).to_pylist() for c in (0, 1))
            at = 0
            for _, data, bounds in blocks(batch.column(2)):
                keys, nodes, infos = [], [], []
                for found in shingle_sets(data, bounds, width, secret):
                    node = set_hash(found)
                    infos.append((node, _packed(ids[at], hashes[at], found, sizes)))
                    if len(found) and ids[at] is not None and node not in seen:
                        seen.add(node)
                        keys += [part_keys(found, sizes, k) for k in sizes.ranges(len(found))]
                        nodes += [np.full(len(x), node) for x in keys[len(nodes) :]]
                    at += 1
                own = np.array([node for node, _ in infos], dtype=np.int64)
                spread_over = mixed(own.view(np.uint64) + np.arange(len(own), dtype=np.uint64)).view(np.int64)  # equal sets too
                n_keys = sum(map(len, keys))
                info = pa.concat_arrays([pa.nulls(n_keys, pa.binary()), pa.array([x for _, x in infos], pa.binary())])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, spread_over])), pa.array(np.concatenate([*nodes, own])), info], ["key", "node", "info"])
            if len(seen) > REMEMBERED:
                seen.clear()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(keyed, KEYED)


def by_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole runs of the first column, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
        if held and (cut or held[0].column(0)[0].as_py() != keys[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _run_starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and node, the nodes of each key that has several, under a name made of them; and the rows that describe sets.

    Parts on which the same sets agree have one name, so near copies are compared once, not once a part.
    """
    seen: set[int] = set()
    names = [f.split()[0] for f in NAMED.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.list_(pa.binary()), pa.list_(pa.int32()), pa.int32()]
    for table in by_runs(batches):
        described = table.filter(table.column("info").is_valid())
        if described.num_rows:
            rows = [_unpacked(x) for x in described.column("info").to_pylist()]
            nodes = described.column("node").combine_chunks()
            own = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), nodes, *own], names)
            table = table.filter(table.column("info").is_null())
        if not table.num_rows:
            continue
        key, node = (table.column(c).to_numpy() for c in ("key", "node"))
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        key, node = key[new].view(np.uint64), node[new]
        starts = _run_starts(key)
        counts = np.diff(np.append(starts, len(key)))
        with np.errstate(over="ignore"):
            name = mixed(np.add.reduceat(mixed(node.view(np.uint64)), starts))
        name = ((name & ~np.uint64(255)) | (key[starts] & np.uint64(255))).view(np.int64)
        several = np.flatnonzero(counts > 1)
        found, at = np.unique(name[several], return_index=True)
        fresh = np.array([x not in seen for x in found.tolist()], dtype=bool)
        seen.update(found[fresh].tolist())
        chosen = np.zeros(len(starts), dtype=bool)
        chosen[several[at[fresh]]] = True
        rows = np.repeat(chosen, counts)
        if rows.any():
            n = int(rows.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, counts)[rows]), pa.array(node[rows]), *[pa.nulls(n, kind) for kind in kinds[2:]]], names)
        if len(seen) > REMEMBERED:
            seen.clear()


def spread(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """A spanning forest of a graph on 0..n-1, as root and both ends of each edge; `linked(i, rest)` gives the neighbours of i in `rest`.

    Asks each node only about nodes that nothing has reached yet, so where most are linked to
    one of them few questions are left.
    """
    rest = np.arange(n)
    while len(rest):
        root, rest = int(rest[0]), rest[1:]
        todo = [root]
        while todo and len(rest):
            at = todo.pop()
            near = linked(at, rest)
            if len(near):
                yield from ((root, at, int(x)) for x in near)
                rest = np.setdiff1d(rest, near, assume_unique=True)
                todo.extend(near.tolist())


EDGES = "name long, root long, u long, v long"


def _bit_rows(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.uint64).reshape(len(packed), len(packed[0]) // 8)


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int, int]]]]:
    """Of rows (group, node, bits, most) sorted by group: each group, its nodes, and edges (root, a, b) that connect them as far as their parity bits allow.

    Two sets are apart if more bits differ than elements may.
    """
    for table in by_runs(batches):
        keys, nodes = table.column(0).to_numpy(), table.column(1).to_numpy()
        packed, most, starts = table.column(2).to_pylist(), table.column(3).to_numpy(), _run_starts(keys)
        for i, j in zip(starts.tolist(), np.append(starts[1:], len(keys)).tolist(), strict=True):
            bits, bound = _bit_rows(packed[i:j]), int(most[i])
            near = lambda x, rest, bits=bits, bound=bound: rest[np.bitwise_count(bits[rest] ^ bits[x]).sum(axis=1) <= bound]
            yield int(keys[i]), nodes[i:j], list(spread(j - i, near))


def _edge_batch(ties: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t[c] for t in ties], pa.int64()) for c in range(4)], ["name", "root", "u", "v"])


def _candidate_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name, root, u, v of the ties of each group: sets of one name and root are tied together, those of different roots are apart."""
    for name, nodes, ties in _ties(batches):
        if ties:
            yield _edge_batch([(name, nodes[root], nodes[a], nodes[b]) for root, a, b in ties])


def _near_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, member, bits, most, root, root_bits) with `near`: whether the parity bits let the member be similar to the root; and `around`: or to a set that is near the root.

    Bits that differ add up along a way, so what is near to one that is near is twice as far at most.
    """
    for batch in batches:
        if batch.num_rows:
            far = np.zeros(batch.num_rows, dtype=np.int64)
            widths = np.array([len(x) for x in batch.column(2).to_pylist()])
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                own, root = (_bit_rows(batch.column(c).take(pa.array(at)).to_pylist()) for c in (2, 5))
                far[at] = np.bitwise_count(own ^ root).sum(axis=1)
            most = batch.column(3).to_numpy().astype(np.int64)
            yield batch.select([0, 1, 2, 3, 4]).append_column("near", pa.array(far <= most)).append_column("around", pa.array(far <= 2 * most))


#: Members of a group that one task compares with each other; larger groups are peeled and cut.
HOT_GROUP = 4096
#: How often a large group is compared with one of its members before what is left is cut into tiles.
PEELS = 3


def _hot_edges(hot: DataFrame, dealt: int) -> DataFrame:
    """Ties of groups with more than HOT_GROUP members, from (name, member, bits, most), spread over tasks.

    A large group is most often one of near copies: every member is compared with the first one, on its own, and tied to it if it is near, or so far that it may
    be near to one that is. Those near it have all their ties then and are done; the others stay, with each other's ties to come. After
    PEELS rounds, what is still large is cut into blocks, and each pair of blocks is compared in a task. Ties found
    there have the name as their root, so all of them count as tied together; that is more than they are, never less.
    """
    found, rest = None, shared.written(hot, "hot")
    for _ in range(PEELS):
        first = rest.groupBy(F.col("name").alias("_name")).agg(F.min("member").alias("root"), F.count("*").alias("_n"))
        first = first.join(rest.select(F.col("name").alias("_m"), "member", F.col("bits").alias("root_bits")), (F.col("_name") == F.col("_m")) & (F.col("root") == F.col("member"))).drop("_m", "member")
        first = shared.written(first, "roots")
        large = first.where(F.col("_n") > HOT_GROUP)
        if large.isEmpty():
            break
        asked = rest.join(F.broadcast(large) if large.count() <= BROADCAST_IDS // 10 else large, F.col("name") == F.col("_name"))
        peeled = shared.written(asked.select("name", "member", "bits", "most", "root", "root_bits").mapInArrow(_near_root, "name long, member long, bits binary, most int, root long, near boolean, around boolean"), "peeled")
        ties = peeled.where("around AND member <> root").select("name", "root", F.col("root").alias("u"), F.col("member").alias("v"))
        found = ties if found is None else found.union(ties)
        small = rest.join(large.select(F.col("_name")), F.col("name") == F.col("_name"), "left_anti")
        rest = shared.written(peeled.where("NOT near").select("name", "member", "bits", "most").union(small.select("name", "member", "bits", "most")), "hot")
    sizes = rest.groupBy(F.col("name").alias("_name")).agg(F.ceil(F.count("*") / HOT_GROUP).cast("int").alias("_k"))
    rows = rest.join(sizes, F.col("name") == F.col("_name")).withColumn("_b", F.pmod(F.xxhash64("member"), F.col("_k")).cast("int"))
    few = rows.where("_k = 1").select("name", "member", "bits", "most").repartition(dealt, "name").sortWithinPartitions("name", "member").mapInArrow(_candidate_edges, EDGES)
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda c: F.struct(F.least(c, "_b").alias("low"), F.greatest(c, "_b").alias("high"))))
    tiles = rows.where("_k > 1").withColumn("_t", pair).select(F.xxhash64("name", "_t.low", "_t.high").alias("tile"), "member", "bits", "most", "name")

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_runs(batches):
            names = dict(zip(table.column(0).to_pylist(), table.column(4).to_pylist(), strict=True))
            for tile, nodes, ties in _ties(iter(table.to_batches())):
                if ties:
                    yield _edge_batch([(names[tile], names[tile], nodes[a], nodes[b]) for _, a, b in ties])

    cut = tiles.repartition(dealt, "tile").sortWithinPartitions("tile", "member").mapInArrow(tied, EDGES)
    return (few if found is None else found.union(few)).union(cut)


class PrefixTree:
    """Sets as paths in a compressed prefix tree, elements in the one order that holds in all trees: that of their hashes.

    A search walks the tree with the overlap so far, so sets with a common beginning share it,
    and leaves a subtree when even all that is left on the shorter side could not make the
    overlap large enough.
    """

    STEP = 64

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.n = percent, len(sets)
        sizes = np.array([len(s) for s in sets])
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        paths = np.split(ids.astype(np.int64), np.cumsum(sizes)[:-1])  # numbered in the order of the hashes, as the sets are
        self.order = sorted(range(self.n), key=lambda i: paths[i].astype(">i8").tobytes())
        self.place = np.argsort(self.order)
        self.paths = [paths[i] for i in self.order]
        self.sizes = sizes[self.order]
        self.marked = np.zeros(len(values), dtype=bool)
        depth = [self._common(a, b) for a, b in zip(self.paths, self.paths[1:], strict=False)]
        self.nodes: list[list] = []  # depth, first and last path, children
        self.root = self._build(depth)

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        apart = np.flatnonzero(a[:n] != b[:n])
        return int(apart[0]) if len(apart) else n

    def _build(self, depth: list[int]) -> int:
        """The tree over the sorted paths from the lengths of neighbours' common beginnings."""
        stack: list[int] = []
        for i in range(self.n):
            before = depth[i - 1] if i else 0
            last = None
            while stack and self.nodes[stack[-1]][0] > before:
                last = stack.pop()
                self.nodes[last][2] = i - 1
                if stack and self.nodes[stack[-1]][0] >= before:
                    self.nodes[stack[-1]][3].append(last)
                    last = None
            if not stack or self.nodes[stack[-1]][0] < before or i == 0:
                first = self.nodes[last][1] if last is not None else i
                self.nodes.append([before, first, None, [last] if last is not None else []])
                stack.append(len(self.nodes) - 1)
            self.nodes.append([len(self.paths[i]) + 1, i, None, []])  # a path's own end
            stack.append(len(self.nodes) - 1)
        while len(stack) > 1:
            last = stack.pop()
            self.nodes[last][2] = self.n - 1
            self.nodes[stack[-1]][3].append(last)
        self.nodes[stack[0]][2] = self.n - 1
        return stack[0]

    def search(self, query: int, rest: np.ndarray) -> np.ndarray:
        """The sets in `rest` that are similar enough to set `query`."""
        path = self.paths[self.place[query]]
        size, percent = len(path), self.percent
        wanted = np.zeros(self.n + 1, dtype=np.int64)
        wanted[self.place[rest] + 1] = 1
        ahead = np.cumsum(wanted)
        self.marked[path] = True
        hits, todo = [], [(self.root, 0, 0)]
        while todo:
            node, depth, overlap = todo.pop()
            end, first, last, children = self.nodes[node]
            if ahead[last + 1] == ahead[first]:
                continue
            line, leaf = self.paths[first], not children
            end = min(end, len(line))
            shortest = self.sizes[first] if leaf else max(end, -(-size * percent // 100))
            longest = self.sizes[first] if leaf else size * 100 // percent
            needed = -(-percent * (size + max(shortest, -(-size * percent // 100))) // (100 + percent))
            alive = shortest * 100 >= percent * size and size * 100 >= percent * shortest if leaf else True
            while alive and depth < end:
                upto = min(end, depth + self.STEP)
                overlap += int(np.count_nonzero(self.marked[line[depth:upto]]))
                depth = upto
                left = size - int(np.searchsorted(path, line[depth - 1], "right"))
                alive = overlap + min(left, longest - depth) >= needed
            if not alive:
                continue
            if leaf:
                if 100 * overlap >= percent * (size + self.sizes[first] - overlap):
                    hits.append(self.order[first])
            else:
                todo.extend((child, depth, overlap) for child in children)
        self.marked[path] = False
        return np.array(hits, dtype=np.int64)


def linked_sets(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between the sets."""
    tree = PrefixTree(sets, percent)
    return ((a, b) for _, a, b in spread(len(sets), tree.search))


def _sets_of(nodes: list[int], texts: pa.Array, width: int, secret: int) -> Iterator[tuple[int, np.ndarray]]:
    """Node and set of each text."""
    for first, data, bounds in blocks(texts):
        yield from zip(nodes[first : first + len(bounds) - 1], shingle_sets(data, bounds, width, secret), strict=True)


def _tree_table(sets: dict[int, np.ndarray], percent: int) -> pa.Table:
    own = list(sets)
    seen = [(own[a], own[b]) for a, b in linked_sets(list(sets.values()), percent)] if sets else []
    u, v = zip(*seen, strict=True) if seen else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _tree_links(percent: int):
    def links(group: pa.Table) -> pa.Table:
        sets = zip(group.column("node").to_pylist(), group.column("shingles").to_pylist(), strict=True)
        return _tree_table({node: np.frombuffer(found, dtype=np.uint64) for node, found in sets}, percent)

    return links


def _set_bytes(width: int, secret: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                own = [found.tobytes() for _, found in _sets_of(part.column(0).to_pylist(), part.column(1), width, secret)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary()), *part.columns[2:]], ["node", "shingles", "component"])

    return rows


def _similar_rows(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return rows


def _verified(asked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) that are links. A u with many pairs goes with each TREE_SETS of them."""
    hubs = asked.groupBy(F.col("u").alias("_u")).agg(F.ceil(F.count("*") / TREE_SETS).cast("int").alias("chunks"))
    asked = asked.join(hubs, F.col("u") == F.col("_u")).select("u", "v", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int").alias("chunk"))
    hubs = hubs.join(sets, F.col("_u") == F.col("node")).select("_u", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("_chunk"), F.col("shingles").alias("left"))
    rows = asked.join(sets.select(F.col("node").alias("_v"), F.col("shingles").alias("right")), F.col("v") == F.col("_v"))
    rows = rows.join(hubs, (F.col("u") == F.col("_u")) & (F.col("chunk") == F.col("_chunk")))
    return rows.select("u", "v", "left", "right").mapInArrow(_similar_rows(percent), "u long, v long")


def _with_label(rows: DataFrame, node: str, label: str, found: DataFrame) -> DataFrame:
    """Adds the component that `found` has for a node, or the node itself."""
    found = found.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return rows.join(found, F.col(node) == F.col("_n"), "left").withColumn(label, F.coalesce("_c", node)).drop("_n", "_c")


def _large_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect what is similar within large candidate components, from pairs (name, root, u, v, component).

    The pairs are verified, first one for each set, then those whose ends are still apart. Sets of one
    name and root that all are connected by then are done. Of the others, each set outside the largest
    connected part of its component meets those that it shares a name and root with, in trees of two parts.
    """
    links = _verified(pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), sets, percent)
    links = shared.written(links, "links")
    linked = shared.written(components(links), "linked")
    apart = _with_label(_with_label(pairs.select("u", "v").distinct(), "u", "a", linked), "v", "b", linked).where("a <> b").select("u", "v")
    links = links.union(shared.written(_verified(apart, sets, percent), "links"))
    linked = shared.written(components(links), "linked")

    inside = pairs.select("name", "root", "component", F.col("v").alias("node")).union(pairs.select("name", "root", "component", F.col("u").alias("node"))).distinct()  # a root that is a set begins a tie
    inside = shared.written(_with_label(inside, "node", "own", linked), "inside")
    unsettled = inside.groupBy("name", "root").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("name", "root")
    inside = shared.written(inside.join(unsettled, ["name", "root"], "left_semi"), "unsettled")
    if inside.isEmpty():
        return links
    counts = inside.select("component", "own", "node").distinct().groupBy("component", "own").agg(F.count("*").alias("n"))
    largest = counts.groupBy(F.col("component").alias("_of")).agg(F.max_by("own", F.struct("n", "own")).alias("main"), F.max("n").alias("held"), F.sum("n").alias("total"))
    halves = lambda n: F.greatest(F.ceil(n * 2 / TREE_SETS), F.lit(1))  # noqa: E731  a tree holds two parts
    other = F.col("own") != F.col("main")
    part = F.pmod("node", F.when(other, halves(F.col("total") - F.col("held"))).otherwise(halves(F.col("held"))))
    inside = inside.join(largest, F.col("component") == F.col("_of")).select("name", "root", "component", "node", (part * 2 + other.cast("long")).alias("part"))  # odd: not of the largest
    inside = shared.written(inside, "parts")
    met = shared.written(inside.select(F.col("name").alias("_name"), F.col("root").alias("_root"), F.col("part").alias("_part")).distinct(), "met")
    few = met.count() <= BROADCAST_IDS
    same = (F.col("name") == F.col("_name")) & (F.col("root") == F.col("_root")) & ((F.col("part") % 2 == 1) | (F.col("_part") % 2 == 1))
    tiles = inside.join(F.broadcast(met) if few else met, same).select("component", F.least("part", "_part").alias("low"), F.greatest("part", "_part").alias("high"), "node")
    tiles = shared.written(tiles.distinct(), "tiles").join(sets.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n")
    return links.union(tiles.groupBy("component", "low", "high").applyInArrow(_tree_links(percent), "u long, v long"))


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n and component_id of each row."""
    spark = docs.sparkSession
    dealt = shared.partitions(spark)
    secret, other = secrets.randbits(64), secrets.randbits(64)  # drawn for this run; what the first finds the second verifies
    keys = keyed_rows(docs, width, percent, secret).repartition(dealt, "key").sortWithinPartitions("key", "node")
    found = shared.written(keys.mapInArrow(_groups, NAMED), "sets")
    rows = found.where("name IS NULL").withColumnRenamed("member", "h1").drop("name")
    full = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = full.groupBy("h1", "h2").agg(*[F.any_value(c).alias(c) for c in ("bits", "most", "low_range")])

    named = found.where("name IS NOT NULL").select("name", "member")
    hot = named.groupBy(F.col("name").alias("_hot")).count().where(F.col("count") > HOT_GROUP).select("_hot")  # or less, as rows may repeat
    any_hot = bool(hot.take(1))
    joined = named.distinct().join(reps, F.col("member") == F.col("h1")).withColumn("slot", F.pmod(F.col("name").bitwiseAND(255) - F.col("low_range"), F.lit(256)))
    joined = joined.select("name", "member", F.expr("bits[slot]").alias("bits"), F.expr("most[slot]").alias("most"))
    if any_hot:
        hot, joined = shared.written(hot, "hot-names"), shared.written(joined, "groups")
    calm = joined.join(hot, F.col("name") == F.col("_hot"), "left_anti") if any_hot else joined
    edges = calm.repartition(dealt, "name").sortWithinPartitions("name", "member").mapInArrow(_candidate_edges, EDGES)
    if any_hot:
        edges = edges.union(_hot_edges(joined.join(hot, F.col("name") == F.col("_hot"), "left_semi"), dealt))
    edges = shared.written(edges, "pairs")
    groups = shared.written(components(edges.select("u", "v")), "candidates")

    first = full.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash")).alias("f"), F.count("*").alias("copies"), F.any_value("n").alias("n"))
    first = first.select("h1", "h2", F.col("f.doc_id").alias("first"), F.col("f.text_hash").alias("first_text"), "copies", "n")
    members = groups.join(first.select(F.col("h1").alias("_h"), "first", "first_text", "n"), F.col("node") == F.col("_h")).drop("_h")
    members = shared.written(members, "members")
    large = members.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("elements")).where((F.col("sets") > TREE_SETS) | (F.col("elements") > TREE_ELEMENTS)).select("component")
    large = shared.written(large, "large")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")

    def with_sets(picked: DataFrame) -> DataFrame:
        picked = picked.select("node", "first", "first_text", "component")
        few = picked.count() <= BROADCAST_IDS
        same = (F.col("doc_id") == F.col("first")) & (F.col("text_hash") == F.col("first_text"))
        rows = texts.join(F.broadcast(picked) if few else picked, same).select("node", "text", "component")
        return rows.mapInArrow(_set_bytes(width, other), "node long, shingles binary, component long")

    any_large = not large.isEmpty()
    small = shared.written(members.join(large, "component", "left_anti"), "small") if any_large else members
    links = with_sets(small).groupBy("component").applyInArrow(_tree_links(percent), "u long, v long")
    if any_large:
        big = shared.written(members.join(large, "component", "left_semi"), "big")
        sets = shared.written(with_sets(big).groupBy("node").agg(F.any_value("shingles").alias("shingles")), "shingles")
        pairs = edges.join(big.select(F.col("node").alias("_n"), "component"), F.col("v") == F.col("_n")).drop("_n")
        links = links.union(_large_links(shared.written(pairs, "large-pairs"), sets, percent))
    found = shared.written(components(links).withColumnRenamed("component", "_c"), "found")

    least = found.join(members.select(F.col("node").alias("_n"), "first"), F.col("node") == F.col("_n")).groupBy("_c").agg(F.min("first").alias("named"))
    found = found.join(least, "_c").select("node", "named")
    labels = first.join(found, F.col("h1") == F.col("node"), "left").where("copies > 1 OR node IS NOT NULL")
    labels = labels.select("h1", "h2", F.coalesce("named", "first").alias("named"))
    labelled = rows.select("doc_id", "text_hash", "n", "h1", "h2").join(labels, ["h1", "h2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("named", "doc_id")).otherwise(F.col("doc_id"))
    return labelled.select("doc_id", "text_hash", "n", component.alias("component_id"))


def similar_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of each row.

    Two documents link when the Jaccard similarity of their sets of `width`-word shingles is at
    least `percent` %. Words are lower-cased in A-Z; a document of fewer words has its whole
    word sequence as one shingle; without words it links with nothing.

    1. Equal sets become one, by a partially aggregated minimum of doc_id.
    2. Similar sets agree on one part at least of a partition of the shingles (see `Sizes`), so
       sets that share a part's key are candidates. Within a key, parity bits rule out sets that
       differ in too many elements, and the rest is tied together by few edges. Groups of more than
       HOT_GROUP sets are spread over tasks (see `_hot_edges`).
    3. Components of those edges hold every link. Each of up to TREE_SETS sets is joined exactly in a
       prefix tree. In larger ones the edges are verified one by one, and only sets that these leave
       apart and that share a key meet in trees (see `_large_links`). Links become the components of the result.

    Words are hashed under two keys drawn for the run: the first finds candidates, and whether two different sets
    are similar is decided by the second, so no two words can be made to collide. Sets are taken as equal by 128 bits of the first.

    Nothing is sampled or capped. Very long texts: a text's words and shingles are held by one task at a time, some 40 bytes a
    byte of text, and its set crosses a shuffle as one value, so that a text must stay below 2 GB. Null text: no words. Null doc_id: n_shingles is given,
    component_id is null and the row links with nothing. Repeated rows are copies of one
    another; rows that share only the doc_id have each their own set. Empty table: no rows. Other columns are ignored.
    """
    return _labelled(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One document of each component, that of the least doc_id, with all columns; rows with null doc_id stay.

    Of repeated rows one stays; only those are shuffled with their texts.
    """
    gone = _labelled(docs, width, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).distinct()
    gone = shared.written(gone, "gone")
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_text"))
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, same, "left_anti")
    twice = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))
    twice = shared.written(twice.groupBy("_id", "_text").count().where("count > 1"), "twice")
    n_twice = twice.count()
    if not n_twice:
        return left
    twice = F.broadcast(twice) if n_twice <= BROADCAST_IDS else twice
    return left.join(twice, same, "left_anti").union(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op9_prefix_tree_join(spark, sf_dir):
    """Documents tied by 90 % of their 3-word shingles; see `similar_components`."""
    return similar_components(shared.documents(spark, sf_dir), width=3, percent=90)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] END) AS k FROM w),
n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 90 * (na.n + nb.n - shared)),
r AS (
  SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.first, w.doc_id))::BIGINT AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(other) AS first FROM r GROUP BY doc_id) m ON m.doc_id = w.doc_id"""
