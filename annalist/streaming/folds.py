"""Structured Streaming forms of the folds, and windowed history with late data."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from annalist.operators.stateful import State, Step


def streamed(events: DataFrame, key: str, order: list[str], step: Step, start: Callable[[], State], schema: str) -> DataFrame:
    """The fold of `stateful.folded` over a stream: events of a micro-batch in order, state kept per key."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current: Any = pickle.loads(state.get[0]) if state.exists else start()
        rows = []
        events = pd.concat(list(batches)).sort_values(order)
        for event in events.astype(object).where(events.notna(), None).to_dict("records"):
            out = step(current, event)
            if out is not None:
                rows.append({key: keys[0], **out})
        state.update((pickle.dumps(current),))
        yield pd.DataFrame(rows, columns=names)

    return events.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def timed(events: DataFrame, key: str, at: str, order: list[str], step: Step, start: Callable[[], State], schema: str, late: str, idle_us: int | None = None, buckets: int | None = None) -> DataFrame:
    """The fold of `stateful.folded` over a stream whose micro-batches are in any order, by timers of event time.

    `at` is a timestamp, `at_us` the same in microseconds, first in `order`; steps see `at_us`. Events are held until the watermark, `late` behind the newest, has passed them, then stepped in order: by
    the next events of their key, or by a timer at the first that is held. So the rows are those of the batch form over all events that were not late; later ones Spark leaves out. A key
    begins anew where an event is more than `idle_us` behind its last one, if that is given, and its state goes once the watermark is. The state holds the fold's state and no more events than arrive within `late`.
    Python is called once per key, or with `buckets` once per bucket of keys by hash, which share a state and a timer: a call costs milliseconds, so many keys of few events want buckets of some hundred keys.
    The number must stay the same as long as the stream does.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns, folds = pickle.loads(zlib.decompress(state.get[0])) if state.exists else ([], {})  # key: state, events held, time of the last one
        for frame in batches:
            if frame.empty:  # a timer
                continue
            columns = [c for c in frame.columns if c not in (at, "_bucket")]
            parts = [frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in columns]
            for event in zip(*parts, strict=True):
                fold = folds.get(event[columns.index(key)])
                if fold is None:
                    fold = folds[event[columns.index(key)]] = [start(), [], None]
                fold[1].append(event)
        mark = state.getCurrentWatermarkMs() * 1000
        rows, due, turn = [], [], [columns.index(c) for c in order if columns]
        for one, fold in list(folds.items()):
            current, held, last = fold
            ready = sorted((e for e in held if e[turn[0]] <= mark), key=lambda e: [e[i] for i in turn])
            if ready:
                held = [e for e in held if e[turn[0]] > mark]
            for event in ready:
                if idle_us is not None and last is not None and event[turn[0]] > last + idle_us:
                    current = start()
                out, last = step(current, dict(zip(columns, event, strict=True))), int(event[turn[0]])
                if out is not None:
                    rows.append({key: one, **out})
            if not held and idle_us is not None and last + idle_us < mark:
                del folds[one]
                continue
            fold[:] = current, held, last
            if held:
                due.append(max(min(int(e[turn[0]]) for e in held) // 1000, mark // 1000 + 1))
            elif idle_us is not None:
                due.append((last + idle_us) // 1000 + 1)
        if folds:
            state.update((zlib.compress(pickle.dumps((columns, folds)), 1),))
            if due:
                state.setTimeoutTimestamp(min(due))
        else:
            state.remove()
        yield pd.DataFrame(rows, columns=names)

    own = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(buckets))).otherwise(-1) if buckets else F.col(key)
    dealt = events.withWatermark(at, late).withColumn("_bucket", own)
    return dealt.groupBy("_bucket").applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def history(events: DataFrame, at: str, keys: list[str], step: str, late: str) -> DataFrame:
    """Counts per tumbling bucket; events later than `late` behind the newest are left out once their bucket is closed."""
    window = F.window(at, step)
    return events.withWatermark(at, late).groupBy(window.alias("_w"), *keys).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("bucket"), *keys, "n")


def deduplicated(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first event of each key within the watermark: an outbox that replays do not repeat."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
