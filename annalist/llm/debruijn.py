"""Substring dedup by a compacted de Bruijn graph of words.

An edge is a window of `width` consecutive words, its nodes are the first and the last width - 1 of them. Only edges that
occur twice or more are of interest, and few of a corpus are. Windows are therefore first dealt into pieces: runs of
consecutive windows of a text that have the same minimizer, the substring of ANCHOR words with the least hash. Equal windows have
equal minimizers, so a piece whose minimizer occurs once in the corpus holds no repeated edge and goes.

Where all pieces of a minimizer are equal, one piece is a path of repeated edges. Where they differ, one piece of each kind
becomes single edges, named by digests of the words at their source coordinates, and edges are counted. Repeated paths and edges
whose node has one edge in and one out are linked by a join on nodes, runs of links along one text are contracted,
and what is left is glued as components: the unitigs. Removed words are those of the occurrences of unitigs in the texts; where a
piece was told by its hash, the words at its coordinates are held against the digest of the piece that stands for it.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm import shared, shingles
from annalist.llm.components import components
from annalist.llm.shingles import mixed, powers
from annalist.llm.suffix_dedup import window_minima

#: Words of a window, and of the substring by which windows are dealt into pieces.
WIDTH, ANCHOR = 35, 8
#: Bytes of text handled at once; longer texts are read in parts.
SPAN = 1 << 21

PIECES = "key long, c long, row long, first int, n_windows int"
#: Edges (kind EDGE: one of several of the piece that begins at `piece`) and pieces that occur twice or more (PIECE: with a digest of its words).
EDGE, PIECE = 0, 1
PATHS = "kind int, several boolean, key long, c long, row long, pos int, n_windows int, n long, u long, v long, digest long, piece int"


def _batch(columns: dict, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))], [f.split()[0] for f in schema.split(", ")])


def pieces(words: np.ndarray, bounds: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: first window, number of windows, hash of the minimizer, hash of all words of the run.

    `words` are hashes of the words of some texts, text i having words[bounds[i]:bounds[i + 1]]; no window leaves its text.
    """
    n = len(words)
    if n < width:
        return tuple(np.zeros(0, dtype=kind) for kind in (np.int64, np.int64, np.uint64, np.uint64))
    with np.errstate(over="ignore"):
        factors = mixed(np.arange(1, anchor + 1, dtype=np.uint64)) | np.uint64(1)
        grams = np.zeros(n - anchor + 1, dtype=np.uint64)
        for i, factor in enumerate(factors):
            grams += words[i : i + len(grams)] * factor
        grams = mixed(grams)
        mask = np.uint64((1 << int(n).bit_length()) - 1)
        owner = (window_minima((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), width - anchor + 1) & mask).astype(np.int64)
        inside = np.ones(len(owner), dtype=bool)
        for end in bounds[1:-1].tolist():
            inside[max(0, end - width + 1) : end] = False
        change = np.append(True, (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1]))
        first = np.flatnonzero(change)
        counts = np.diff(np.append(first, len(owner)))
        first, counts = first[inside[first]], counts[inside[first]]
        up, down = powers(n + 1)
        sums = np.append(np.uint64(0), np.cumsum(words * up[:n], dtype=np.uint64))
        whole = mixed((sums[first + counts + width - 1] - sums[first]) * down[first] + counts.astype(np.uint64))
    return first, counts, grams[owner[first]], whole


def _found(width: int, anchor: int, seed: int, span: int):
    """Pieces of every text; a text of more than `span` bytes is hashed part by part, each with the last words of the one before."""

    def parts(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Hashes of words and the place of the first, overlapping by width - 1 words."""
        begin, done, kept = 0, 0, np.zeros(0, dtype=np.uint64)
        while begin < len(raw):
            end = min(len(raw), begin + span)
            while end < len(raw):  # on to the end of a word
                gaps = np.flatnonzero(shingles._SPACE[raw[end : end + 65536]])
                end = end + int(gaps[0]) if len(gaps) else min(len(raw), end + 65536)
                if len(gaps):
                    break
            words, _ = shingles.word_hashes(raw[begin:end], np.array([0, end - begin]), seed, lower=False)
            words = np.concatenate([kept, words])
            yield done - len(kept), words
            done += len(words) - len(kept)
            kept, begin = words[max(0, len(words) - width + 1) :], end

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for index, data, bounds in shingles.blocks(batch.column(1), span):
                if len(bounds) == 2 and len(data) > span:
                    told = [(at, *pieces(words, np.array([0, len(words)]), width, anchor)) for at, words in parts(data)]
                    for at, first, counts, key, whole in told:
                        yield _batch({"key": key.view(np.int64), "c": whole.view(np.int64), "row": np.full(len(first), rows[index]), "first": first + at, "n_windows": counts}, PIECES)
                    continue
                words, counts = shingles.word_hashes(data, bounds, seed, lower=False)
                starts = np.append(0, np.cumsum(counts))
                first, n, key, whole = pieces(words, starts, width, anchor)
                text = np.searchsorted(starts, first, "right") - 1
                yield _batch({"key": key.view(np.int64), "c": whole.view(np.int64), "row": rows[index + text], "first": first - starts[text], "n_windows": n}, PIECES)

    return found


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes belong to words, and where words start and end."""
    inside = ~shingles._SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return inside, edges[::2], edges[1::2]


def digest(raw: memoryview, start: int, end: int) -> int:
    """64 bits of a cryptographic digest of the words in raw[start:end], whatever stands between them."""
    return int.from_bytes(blake2b(b" ".join(bytes(raw[start:end]).split()), digest_size=8).digest(), "little", signed=True)


def _as_paths(width: int):
    """Edges of pieces whose minimizer has several kinds, and pieces that occur twice or more, from texts with the pieces that stand for theirs."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = batch.column(0).to_numpy(), {f.split()[0]: [] for f in PATHS.split(", ")}
            told, wanted = batch.column(2).offsets.to_numpy(), batch.column(2).values
            first, n_windows, key, c, n, several = (wanted.field(name).to_numpy(zero_copy_only=False) for name in ("first", "n_windows", "key", "c", "n", "several"))
            for i in range(batch.num_rows):
                raw = memoryview(batch.column(1)[i].as_buffer())
                _, starts, ends = word_bounds(np.frombuffer(raw, dtype=np.uint8))
                for x in range(told[i], told[i + 1]):
                    begin, count = int(first[x]), int(n_windows[x])
                    at = range(begin, begin + count + 1) if several[x] else (begin, begin + count)
                    nodes = [digest(raw, starts[p], ends[p + width - 2]) for p in at]
                    if several[x]:
                        for j in range(count):
                            _put(out, EDGE, True, 0, 0, rows[i], begin + j, 1, n[x], nodes[j], nodes[j + 1], 0, begin)
                    if n[x] > 1:
                        _put(out, PIECE, several[x], key[x], c[x], rows[i], begin, count, n[x], nodes[0], nodes[-1], digest(raw, starts[begin], ends[begin + count + width - 2]), begin)
                if len(out["kind"]) >= 1 << 16:
                    yield _batch(out, PATHS)
                    out = {name: [] for name in out}
            if out["kind"]:
                yield _batch(out, PATHS)

    return paths


def _put(out: dict[str, list], *values) -> None:
    for column, value in zip(out.values(), values, strict=True):
        column.append(value)


def unitigs(paths: DataFrame) -> DataFrame:
    """(row, pos, unitig, n_edges) for paths (u, v, row, pos, n_windows): maximal paths through nodes with one edge in and one out.

    Paths are distinct and named by source coordinates, (row, pos). Paths that follow one another in one text are contracted in the
    order of that text, which most of a unitig's paths do; the few links that lead from text to text are glued as components.
    `n_edges` is the length of the unitig in edges. A cycle is one unitig.
    """
    item = F.struct("row", "pos", "n_windows")
    ends = paths.select(F.col("u").alias("node"), F.lit(None).cast("struct<row:long,pos:int,n_windows:int>").alias("before"), item.alias("behind"))
    ends = ends.union(paths.select(F.col("v").alias("node"), item.alias("before"), F.lit(None).cast("struct<row:long,pos:int,n_windows:int>").alias("behind")))
    plain = ends.groupBy("node").agg(F.count("before").alias("n_in"), F.count("behind").alias("n_out"), F.max("before").alias("before"), F.max("behind").alias("behind"))
    links = plain.where("n_in = 1 AND n_out = 1").select("before", "behind")
    along = (F.col("before.row") == F.col("behind.row")) & (F.col("before.pos") + F.col("before.n_windows") == F.col("behind.pos"))
    links = shared.written(links.withColumn("along", along), "links")

    goes_on = links.where("along").select(F.col("behind.row").alias("row"), F.col("behind.pos").alias("pos"), F.lit(1).alias("goes_on"))
    in_text = Window.partitionBy("row").orderBy("pos")
    runs = paths.join(goes_on, ["row", "pos"], "left").select("row", "pos", "n_windows", F.sum(F.when(F.col("goes_on").isNull(), 1).otherwise(0)).over(in_text).alias("run"))
    runs = shared.written(runs.withColumn("run", F.xxhash64("row", "run")), "runs")
    last = runs.select(F.col("row").alias("r"), F.col("pos").alias("p"), F.col("run").alias("a"))
    begun = runs.select(F.col("row").alias("r2"), F.col("pos").alias("p2"), F.col("run").alias("b"))
    glue = links.where("NOT along").join(last, (F.col("before.row") == F.col("r")) & (F.col("before.pos") == F.col("p"))).join(begun, (F.col("behind.row") == F.col("r2")) & (F.col("behind.pos") == F.col("p2")))
    names = components(glue.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = runs.join(names, runs["run"] == names["node"], "left").select("row", "pos", "n_windows", F.coalesce("component", "run").alias("unitig"))
    return named


def repeated_spans(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    """row (hash of doc_id and text) and its spans of repeated windows: struct of start and end in words, digest of the words where it is to be held against them, and unitigs."""
    if not 0 < anchor < width:
        raise ValueError("0 < anchor < width")
    seed = secrets.randbits(63)
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("data")).where(F.length("data") >= 2 * width - 1)
    found = texts.mapInArrow(_found(width, anchor, seed, SPAN), PIECES)
    half = F.shiftright("c", 32).cast("int")
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min(half).alias("least"), F.max(half).alias("most")).where("n > 1").select("key", (F.col("least") != F.col("most")).alias("several"))
    keys = shared.written(keys, "keys")  # so that both sides of the join are dealt for it, and Spark can split a hot key
    met = shared.written(found.join(keys, "key"), "pieces")

    kinds = met.groupBy("key", "c").agg(F.count("*").alias("n"), F.any_value("several").alias("several"), F.min(F.struct("row", "first", "n_windows")).alias("at")).where("several OR n > 1")
    wanted = kinds.select(F.col("at.row").alias("row"), F.struct(F.col("at.first").alias("first"), F.col("at.n_windows").alias("n_windows"), "key", "c", "n", "several").alias("piece"))
    wanted = wanted.groupBy("row").agg(F.collect_list("piece").alias("wanted"))
    paths = shared.written(texts.join(wanted, "row").mapInArrow(_as_paths(width), PATHS), "paths")

    edges = paths.where(F.col("kind") == EDGE)
    repeated = edges.groupBy("u", "v").agg(F.sum("n").alias("n"), F.min(F.struct("row", "pos")).alias("at")).where("n > 1")
    repeated = shared.written(repeated.select("u", "v", F.col("at.row").alias("row"), F.col("at.pos").alias("pos"), F.lit(1).alias("n_windows")), "edges")
    whole = paths.where(F.col("kind") == PIECE).dropDuplicates(["key", "c"])
    alike = whole.where("NOT several")
    named = shared.written(unitigs(repeated.union(alike.select("u", "v", "row", "pos", "n_windows"))), "unitigs")

    labelled = repeated.join(named.select("row", "pos", "unitig"), ["row", "pos"]).select("u", "v", "unitig")
    hits = shared.written(edges.join(labelled, ["u", "v"]).select("row", "pos", "n", "piece", "unitig"), "hits")
    single = hits.where("n = 1").select("row", F.struct(F.col("pos").alias("start"), (F.col("pos") + width).alias("end"), F.lit(None).cast("long").alias("digest"), F.array("unitig").alias("unitigs")).alias("span"))
    labels = hits.where("n > 1").select("row", F.col("piece").alias("pos"), "unitig").union(named.select("row", "pos", "unitig")).groupBy("row", "pos").agg(F.collect_set("unitig").alias("unitigs"))
    whole = whole.join(labels, ["row", "pos"], "left").select("key", "c", "digest", F.coalesce("unitigs", F.array().cast("array<long>")).alias("unitigs"))
    many = met.join(whole, ["key", "c"]).select("row", F.struct(F.col("first").alias("start"), (F.col("first") + F.col("n_windows") + (width - 1)).alias("end"), "digest", "unitigs").alias("span"))
    return single.union(many).groupBy("row").agg(F.collect_set("span").alias("spans"))


CUT = "doc_id long, n_words long, n_removed long, n_passages long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, removed, passages, spans, kept = [], [], [], [], []
        told, every = batch.column(2).offsets.to_numpy(), batch.column(2).values
        first, last, checked, of = every.field("start").to_numpy(zero_copy_only=False), every.field("end").to_numpy(zero_copy_only=False), every.field("digest"), every.field("unitigs")
        sure, checked = checked.is_null().to_numpy(zero_copy_only=False), checked.fill_null(0).to_numpy()
        upto, names = of.offsets.to_numpy(), of.values.to_numpy()
        for i in range(batch.num_rows):
            view = memoryview(batch.column(1)[i].as_buffer())
            raw = np.frombuffer(view, dtype=np.uint8)
            inside, starts, ends = word_bounds(raw)
            change, met = np.zeros(len(starts) + 1, dtype=np.int32), set()
            for x in range(told[i], told[i + 1]):
                a, b = first[x], last[x]
                if sure[x] or digest(view, starts[a], ends[b - 1]) == checked[x]:
                    change[a] += 1
                    change[b] -= 1
                    met.update(names[upto[x] : upto[x + 1]].tolist())
            covered = np.cumsum(change)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).view(np.int8)))
            out, stays = raw.copy(), inside
            behind = ends[ends < len(raw)]
            out[behind], stays[behind] = 0x20, True
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                stays[starts[a] : ends[b - 1] + 1] = False
            words.append(len(starts))
            removed.append(int(covered.sum()))
            passages.append(len(met))
            spans.append([{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
            kept.append(out[stays].tobytes().removesuffix(b" "))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (words, removed, passages)), pa.array(spans, kind), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in CUT.split(", ")])


def remove_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """Removes every word covered by a window of `width` words whose words also start anywhere else.

    Returns doc_id, n_words, n_removed, n_passages (unitigs met in the text), spans (maximal removed runs, in words) and kept (the remaining words
    joined by one space). Windows are judged on the input, never cross documents, and may repeat inside one document or overlap.

    Null or empty text: no words. Texts of fewer words stay whole. Rows that repeat in full are copies of one another. Null doc_id: a row as
    any other. Empty table: no rows. Other columns are ignored. Very long texts are hashed a few megabytes at a time; a text, its word bounds and the list of
    its repeated pieces are one row, so a text must stay below 2 GB. Ties between equal windows do not matter: all of them go.
    """
    spans = repeated_spans(docs, width, anchor)
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), shared.text_or_empty().cast("binary").alias("data")).alias("t")
    return t.join(spans.alias("s"), F.col("t.row") == F.col("s.row"), "left").select("t.doc_id", "t.data", "s.spans").mapInArrow(_cut, CUT)


def op11_debruijn_dedup(spark, sf_dir):
    """Words of 35-word windows that start anywhere else are removed. See `remove_repeats`."""
    kept = remove_repeats(shared.documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", F.size("spans").cast("long").alias("n_spans"))


#: Edges are strings here. Unitigs are numbered by their first edge, cycles by the least of theirs.
SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (
  SELECT r, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
e AS (
  SELECT r, i, n, word, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS edge FROM w),
k AS MATERIALIZED (
  SELECT edge, row_number() OVER () AS id FROM e WHERE i <= n - 34 GROUP BY edge HAVING count(*) > 1),
m AS MATERIALIZED (
  SELECT e.r, e.i, e.word, k.id, max(k.id IS NOT NULL) OVER (PARTITION BY e.r ORDER BY e.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM e LEFT JOIN k ON e.i <= e.n - 34 AND e.edge = k.edge),
node AS (
  SELECT node, count(a) AS n_in, count(b) AS n_out, max(a) AS a, max(b) AS b FROM (
    SELECT regexp_replace(edge, '^[^ ]+ ', '') AS node, id AS a, NULL AS b FROM k UNION ALL
    SELECT regexp_replace(edge, ' [^ ]+$', ''), NULL, id FROM k) GROUP BY node),
link AS MATERIALIZED (
  SELECT a, b FROM node WHERE n_in = 1 AND n_out = 1),
path AS (
  SELECT id, id AS unitig FROM k WHERE id NOT IN (SELECT b FROM link) UNION ALL
  SELECT link.b, path.unitig FROM path JOIN link ON path.id = link.a),
loop AS (
  SELECT id, id AS met FROM k WHERE id NOT IN (SELECT id FROM path) UNION
  SELECT loop.id, link.b FROM loop JOIN link ON loop.met = link.a),
named AS (
  SELECT id, unitig FROM path UNION ALL SELECT id, min(met) FROM loop GROUP BY id),
s AS (
  SELECT r, count(*) FILTER (gone AND NOT before) AS n_spans FROM (SELECT r, gone, lag(gone, 1, false) OVER (PARTITION BY r ORDER BY i) AS before FROM m) GROUP BY r),
p AS (
  SELECT r, count(DISTINCT unitig) AS n_passages FROM m JOIN named USING (id) GROUP BY r),
t AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY r)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
       coalesce(n_passages, 0)::BIGINT AS n_passages, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM d LEFT JOIN t USING (r) LEFT JOIN p USING (r) LEFT JOIN s USING (r)"""
