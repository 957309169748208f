"""Repair of the structure of conversations: a dynamic programme whose audit strings are compressed to ranks.

A conversation shall read `(s?(ua)+)?` in the initials of its roles. The edits at a turn are a run of inserted turns and then the turn's own
edit; written as `I`s and one other letter, these macro edits are prefix-free codes, so audit strings of the same number of turns compare as their
last code does if what stands before is equal. A layer of the programme therefore keeps, for each state of the grammar, the least cost and the rank of its audit
among those of the layer, and for each turn a pointer to the state before and the code. The audit itself is read off the pointers at the end.

Layers of consecutive turns compose to one layer: costs and ranks for each pair of states before and behind. Turns are
dealt into blocks, blocks compose to longer ones, and the states chosen at the ends of a block decide inside it; so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm import shared
from annalist.llm.jaccard import by_runs

#: Costs of a changed role, a deleted turn, an inserted turn and a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
#: States of the grammar: nothing yet, behind s, behind u, behind a. What is inserted next, and where that leads.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INSERTED = {NOTHING: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: Turns that must follow a state for an end: inserted ones.
CLOSING = np.array([0, 2, 1, 0])
#: Where the initial of a role leads from each state; the empty initial changes none.
STEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {q: q for q in range(4)}}
INITIALS = ["s", "u", "a", "", None]
#: Codes in ASCII order. No more than two inserted turns in a row can help.
CODES = sorted("I" * k + letter for k in range(3) for letter in "DKR")
#: Turns of a block, as a power of two, and a cost beyond all others.
BLOCK, NEVER = 10, 1 << 40
#: Stands behind all turns of a conversation.
END = 1 << 62


def _layers() -> tuple[np.ndarray, np.ndarray]:
    """Costs and codes of the cheapest macro edit for each initial, condition of the turn (sound, truncated, to be deleted), state before and state behind."""
    cost = np.full((len(INITIALS) * 3, 4, 4), NEVER, dtype=np.int64)
    code = np.zeros((len(INITIALS) * 3, 4, 4), dtype=np.int64)
    for i, initial in enumerate(INITIALS):
        for condition in range(3):
            for before in range(4):
                for number, text in enumerate(CODES):
                    state, spent = before, INSERT * (len(text) - 1)
                    for _ in text[:-1]:
                        state = INSERTED[state][1]
                    if text[-1] == "D":
                        spent += DELETE
                    elif condition == 2:
                        continue
                    else:
                        state = INSERTED[state][1] if text[-1] == "R" else STEPS.get(initial, {}).get(state)
                        spent += (REROLE if text[-1] == "R" else 0) + (TRUNCATED if condition else 0)
                    at = (i * 3 + condition, before, state)
                    if state is not None and spent < cost[at]:  # codes come in order: of equal costs the least stays
                        cost[at], code[at] = spent, number
    return cost, code


COSTS, FIRST_CODES = _layers()


def composed(cost: np.ndarray, code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Layers of groups, which begin at `starts`, composed: cost and rank by group, state before and state behind; and a pointer (state << 4 | code) by layer and the same."""
    lengths = np.diff(np.append(starts, len(cost)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    total, rank = np.full((len(starts), 4, 4), NEVER, dtype=np.int64), np.zeros((len(starts), 4, 4), dtype=np.int64)
    total[:, range(4), range(4)] = 0
    pointers = np.zeros((len(cost), 4, 4), dtype=np.uint8)
    for t in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-lengths, -t))  # groups with a layer t
        at = starts[:n] + t
        ways = ((total[:n, :, :, None] + cost[at][:, None]) << 8) | (rank[:n, :, :, None] << 4) | code[at][:, None]
        before = ways.argmin(axis=2)
        best = np.take_along_axis(ways, before[:, :, None], axis=2)[:, :, 0]
        pointers[at] = before << 4 | best & 15
        total[:n] = np.minimum(best >> 8, NEVER)
        audit = (best & 255).reshape(n, 16)
        by = audit.argsort(axis=1)
        sorted_ = np.take_along_axis(audit, by, axis=1)
        dense = np.cumsum(np.concatenate([np.zeros((n, 1), dtype=bool), sorted_[:, 1:] != sorted_[:, :-1]], axis=1), axis=1)
        ranked = np.empty((n, 16), dtype=np.int64)
        np.put_along_axis(ranked, by, dense, axis=1)
        rank[:n] = ranked.reshape(n, 4, 4)
    back = np.argsort(order)
    return total[back], rank[back], pointers


def _walked(pointers: np.ndarray, starts: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By layer, the state before, the state behind and the code, where groups begin and end in the states given."""
    lengths = np.diff(np.append(starts, len(pointers)))
    before, behind, code = (np.zeros(len(pointers), dtype=np.int64) for _ in range(3))
    state = end.copy()
    for t in range(int(lengths.max(initial=0)) - 1, -1, -1):
        some = np.flatnonzero(lengths > t)
        at = starts[some] + t
        pointer = pointers[at, begin[some], state[some]].astype(np.int64)
        before[at], behind[at], code[at] = pointer >> 4, state[some], pointer & 15
        state[some] = before[at]
    return before, behind, code


LAYERS = "kind int, conv_id long, at long, group long, cost binary, code binary"
LAYER, WHOLE = 0, 1


def _starts(table: pa.Table, *columns: str) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for name in columns:
        column = table.column(name).combine_chunks()
        valid, values = column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy()
        new[1:] |= (values[1:] != values[:-1]) | (valid[1:] != valid[:-1])
    return np.flatnonzero(new)


def _batch(kind: int, conv_id: pa.Array, at, group, cost: list, code: list) -> pa.RecordBatch:
    kinds = pa.array(np.full(len(cost), kind), pa.int32())
    return pa.RecordBatch.from_arrays([kinds, conv_id, pa.array(at, pa.int64()), pa.array(group, pa.int64()), pa.array(cost, pa.binary()), pa.array(code, pa.binary())], [c.split()[0] for c in LAYERS.split(", ")])


def _folded(first: bool):
    """Composes blocks. Of rows hash, conv_id, block, at and either class or cost and code: pointers by row, under the place of the block's first, and one row by block."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_runs(batches):
            table = table.combine_chunks()
            starts, at, conv_id = _starts(table, "hash", "conv_id", "block"), table.column("at").to_numpy(), table.column("conv_id").combine_chunks()
            if first:
                which = table.column("class").to_numpy()
                cost, code = COSTS[which], FIRST_CODES[which]
            else:
                cost = np.frombuffer(b"".join(table.column("cost").to_pylist()), dtype=np.int64).reshape(-1, 4, 4)
                code = np.frombuffer(b"".join(table.column("code").to_pylist()), dtype=np.uint8).reshape(-1, 4, 4).astype(np.int64)
            total, rank, pointers = composed(cost, code, starts)
            group = np.repeat(at[starts], np.diff(np.append(starts, len(at))))
            yield _batch(LAYER, conv_id, at, group, [None] * len(at), [p.tobytes() for p in pointers])
            yield _batch(WHOLE, conv_id.take(pa.array(starts)), at[starts], at[starts], [x.tobytes() for x in total], [x.tobytes() for x in rank.astype(np.uint8)])

    return folded


CHOSEN = "conv_id long, at long, before int, behind int, code int"


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest end of whole conversations; of equal costs that with the least audit. `code` is the number of turns inserted at the end."""
    for batch in batches:
        if batch.num_rows:
            cost = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.int64).reshape(-1, 16)[:, :4] + INSERT * CLOSING
            rank = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, 16)[:, :4].astype(np.int64)
            end = ((cost << 8) | (rank << 4) | CLOSING).argmin(axis=1)
            ints = [pa.array(x, pa.int32()) for x in (np.zeros(len(end), np.int64), end, CLOSING[end])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *ints], [c.split()[0] for c in CHOSEN.split(", ")])


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows group, at, conv_id, pointers, and the states before and behind of the group, those of each row."""
    for table in by_runs(batches):
        table = table.combine_chunks()
        starts = _starts(table, "group")
        pointers = np.frombuffer(b"".join(table.column("code").to_pylist()), dtype=np.uint8).reshape(-1, 4, 4)
        ends = (table.column(c).to_numpy()[starts].astype(np.int64) for c in ("before", "behind"))
        found = [pa.array(x, pa.int32()) for x in _walked(pointers, starts, *ends)]
        columns = [table.column(c).combine_chunks() for c in ("conv_id", "at")]
        yield pa.RecordBatch.from_arrays([*columns, *found], [c.split()[0] for c in CHOSEN.split(", ")])


def chosen_edits(turns: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Of `turns` (conv_id, at, class), numbered 0 to total - 1 without gaps in a conversation, the state before and behind and the code; and the same by conversation."""
    spark, levels, layers, level = turns.sparkSession, [], turns, 0
    while True:
        level += 1
        block = F.shiftright("at", BLOCK * level)
        rows = layers.select(F.xxhash64("conv_id", block).alias("hash"), "conv_id", block.alias("block"), *layers.columns[1:])
        rows = rows.repartition(shared.partitions(spark), "hash").sortWithinPartitions("hash", "conv_id", "block", "at")
        folded = shared.written(rows.mapInArrow(_folded(level == 1), LAYERS), "layers")
        levels.append(folded.where(F.col("kind") == LAYER))
        layers = folded.where(F.col("kind") == WHOLE).select("conv_id", "at", "cost", "code")
        if total - 1 >> BLOCK * level <= 0:
            break
    whole = chosen = shared.written(layers.mapInArrow(_ended, CHOSEN), "ends")
    for own in reversed(levels):
        ends = chosen.select(F.col("at").alias("group"), "before", "behind")
        rows = own.join(ends, "group").select("group", "at", "conv_id", "code", "before", "behind")
        chosen = rows.repartition(shared.partitions(spark), "group").sortWithinPartitions("group", "at").mapInArrow(_inside, CHOSEN)
    return chosen, whole


def _spelled() -> Column:
    return F.element_at(F.array(*map(F.lit, CODES)), F.col("code") + 1)


def repair(turns: DataFrame) -> DataFrame:
    """The cheapest edits after which every conversation reads `(s?(ua)+)?` in the initials of its roles; of equal costs, the least audit in ASCII order.

    Takes conv_id (long), turn, role and text. Returns a row for each turn, and one behind all of its conversation (`at` = END): conv_id, at (order), turn, role, text,
    fault (blank: nothing but white space; duplicate: role and text seen earlier; truncated: the last other character is none of `.!?`; the first
    that holds, else null), edits (inserted turns as `I`, then `K`eep, `R`erole to user or assistant, or `D`elete), cost, and standing: the turns that stand in its place, as
    (role, text).

    Turns stand in order of (turn, role, text), nulls first; equal rows follow one another. Null role or text: one space. An empty role changes no state if kept.
    Null conv_id: a conversation of its own. Blank and duplicate turns are deleted. Empty table: no rows. Other columns are ignored. Very long
    texts: a row holds one turn's text. A conversation of any length is numbered by ranges and composed in blocks.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows, total = shared.numbered(rows, [F.col(c) for c in ("conv_id", "turn", "role", "text")], "repaired-turns")
    rows = rows.withColumnRenamed("row_number", "at")
    earliest = rows.groupBy("conv_id", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).agg(F.min("at").alias("at")).select("at", F.lit(False).alias("again"))
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(last == "", "blank").when(F.coalesce("again", F.lit(True)), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    rows = shared.written(rows.join(earliest, "at", "left").withColumn("fault", fault).select("at", "conv_id", "turn", "role", "text", "fault"), "faults")
    initial = F.substring("role", 1, 1)
    number = F.coalesce(*(F.when(initial == x, F.lit(i)) for i, x in enumerate(INITIALS) if x is not None), F.lit(len(INITIALS) - 1))
    condition = F.when(F.col("fault").isNull(), 0).when(F.col("fault") == "truncated", 1).otherwise(2)
    edits, whole = chosen_edits(rows.select("conv_id", "at", (number * 3 + condition).cast("long").alias("class")), total)

    def following(state: Column, n: Column) -> Column:
        """`n` turns inserted behind a state."""
        return F.slice(F.when(state == USER, F.array(F.lit("assistant"), F.lit("user"))).otherwise(F.array(F.lit("user"), F.lit("assistant"))), 1, n)

    code, letter = _spelled(), F.right("edits", F.lit(1))
    added = F.transform(following(F.col("before"), F.length("edits") - 1), lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    role = F.when(letter == "K", F.col("role")).when(F.col("behind") == ASSISTANT, "assistant").otherwise("user")
    own = F.when(letter == "D", F.array()).otherwise(F.array(F.struct(role.alias("role"), F.col("text").alias("text"))))
    cost = INSERT * (F.length("edits") - 1) + F.when(letter == "D", DELETE).otherwise(F.when(letter == "R", REROLE).otherwise(0) + F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0))
    told = rows.join(edits.select("at", "before", "behind", code.alias("edits")), "at")
    told = told.select("conv_id", "at", "turn", "role", "text", "fault", "edits", cost.cast("long").alias("cost"), F.concat(added, own).alias("standing"))
    closing = whole.select(
        "conv_id", F.lit(END).alias("at"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("fault"),
        F.repeat(F.lit("I"), F.col("code")).alias("edits"), (INSERT * F.col("code")).cast("long").alias("cost"),
        F.transform(following(F.col("behind"), F.col("code")), lambda r: F.struct(r.alias("role"), F.lit("").alias("text"))).alias("standing"),
    )
    return told.union(closing)


def damage(turns: DataFrame) -> DataFrame:
    """Damage by h = crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 sets role user. Nulls are one space, in the hashed text as well."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, from the rows of `repair` in order; of a conversation only sums, letters of edits and the state of a hash are kept."""
    names, ended, held = [c.split()[0] for c in REPORT.split(", ")], [], None

    def out() -> pa.RecordBatch:
        kinds = [pa.string() if name in ("audit", "repaired_sha256") else pa.int64() for name in names]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*ended, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for at, conv_id, turn, role, fault, edits, cost, standing in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None:
                held = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "turns": 0, "first": None, "last": None, "before": None, "edits": [], "hash": sha256(), "mark": ""}
            held["cost"] += cost
            held["edits"].append(edits)
            for x in standing:
                held["hash"].update(f"{held['mark']}{x['role']}:{x['text']}".encode())
                held["mark"] = "\n"
            if at == END:
                gaps = held["last"] - held["first"] + 1 - held["turns"] if held["turns"] else 0
                ended.append((conv_id, gaps, *(held[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(held["edits"]), held["hash"].hexdigest()))
                held = None
                continue
            if fault is not None:
                held[fault] += 1
            if held["before"] is not None and held["before"] + role[:1] not in ("su", "ua", "au"):
                held["illegal"] += 1
            held["before"] = role[:1]
            if turn is not None and turn != held["last"]:
                held["first"], held["last"], held["turns"] = turn if held["first"] is None else held["first"], turn, held["turns"] + 1
        if ended:
            yield out()
            ended.clear()


def report(original: DataFrame, repaired: DataFrame) -> DataFrame:
    """One row for every conv_id of `original`: counts of faults, cost, audit and a digest of the repaired turns, from the rows of `repair`.

    A digest of a whole conversation has to be taken in one task; its turns stream through it in order.
    """
    rows = repaired.repartition(shared.partitions(repaired.sparkSession), "conv_id").sortWithinPartitions("conv_id", "at")
    said = rows.select("at", "conv_id", "turn", "role", "fault", "edits", "cost", "standing").mapInArrow(_reported, REPORT)
    every = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("o")
    joined = every.join(said.alias("s"), F.col("o.conv_id").eqNullSafe(F.col("s.conv_id")), "left")
    counts = [F.coalesce(f"s.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("o.conv_id", *counts, F.coalesce("s.audit", F.lit("")).alias("audit"), F.coalesce("s.repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))


def op12_rank_repair(spark, sf_dir):
    """All conversations damaged by `damage` and repaired by `repair`."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report(turns, repair(damage(turns)))


#: Audits are strings here. States are numbered as above.
SQL = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda x: unicode(x)::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda y, i: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))), 4294967295::UBIGINT) % 20 AS h FROM c),
d AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy, h FROM h),
o AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM d WHERE h <> 0),
r AS MATERIALIZED (
  SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
         lag(role[1]) OVER (PARTITION BY g ORDER BY i) || role[1] AS pair FROM o),
f AS MATERIALIZED (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM r),
mid(before, k, mid, added) AS (VALUES
  (0, 0, 0, []), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
  (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])),
way AS (
  SELECT *, CASE letter WHEN 'D' THEN mid WHEN 'R' THEN CASE WHEN mid = 2 THEN 3 ELSE 2 END
    ELSE CASE WHEN initial = 's' AND mid = 0 THEN 1 WHEN initial = 'u' AND mid <> 2 THEN 2 WHEN initial = 'a' AND mid = 2 THEN 3 WHEN initial = '' THEN mid END END AS behind
  FROM mid, (VALUES ('D'), ('K'), ('R')) AS l(letter), (VALUES ('s'), ('u'), ('a'), (''), ('?')) AS n(initial)),
dp AS (
  SELECT g, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS standing FROM (SELECT DISTINCT g FROM f) UNION ALL
  SELECT dp.g, f.i, behind, dp.cost + 2 * k + CASE letter WHEN 'D' THEN 3 ELSE CASE letter WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END END AS spent, dp.audit || repeat('I', k) || letter AS said,
         dp.standing || added || CASE letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text] ELSE [CASE WHEN behind = 3 THEN 'assistant:' ELSE 'user:' END || text] END
  FROM dp JOIN f ON f.g = dp.g AND f.i = dp.i + 1 JOIN way ON way.before = dp.state AND way.initial = CASE WHEN role[1] IN ('s', 'u', 'a', '') THEN role[1] ELSE '?' END
  WHERE behind IS NOT NULL AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate'))
  QUALIFY row_number() OVER (PARTITION BY dp.g, behind ORDER BY spent, said) = 1),
z AS (
  SELECT dp.g, dp.cost + 2 * len(closing) AS cost, dp.audit || repeat('I', len(closing)) AS audit, dp.standing || closing AS standing
  FROM dp JOIN (SELECT g, max(i) AS i FROM f GROUP BY g) USING (g, i) JOIN (VALUES (0, []::VARCHAR[]), (1, ['user:', 'assistant:']), (2, ['assistant:']), (3, [])) AS e(state, closing) USING (state)
  QUALIFY row_number() OVER (PARTITION BY dp.g ORDER BY dp.cost + 2 * len(closing), dp.audit || repeat('I', len(closing))) = 1),
a AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(standing, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g FROM conversations) LEFT JOIN a USING (g) LEFT JOIN z USING (g)"""
