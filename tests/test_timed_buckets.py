"""The timed fold with many keys in one state: the rows are those of one state per key."""

import random

from pyspark.sql import functions as F

from annalist.operators import stateful
from annalist.streaming import folds

SECOND = 1_000_000
DAY = 24 * 3600 * SECOND
OUT = "k string, event_id long, state string, attempts int, most int, available_us long, archived boolean, applied boolean"


def found(spark, path, name, idle_us, buckets):
    stream = spark.readStream.schema("k string, event_id long, at_us long, kind string, attempt int, until_us long, at timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    step = stateful.queue_step(DAY, 30 * SECOND)
    out = folds.timed(stream, "k", "at", ["at_us", "event_id"], step, stateful.queue_start, OUT, "1 day", idle_us, buckets)
    out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(200)
    return sorted((str(r.k), *r[1:]) for r in spark.table(name).collect())


def test_buckets_of_keys_give_the_rows_of_single_keys(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "log")
    rows = [(rng.choice(["a", "b", "c", "d", None]), n, n * DAY // 4, rng.choice(["claim", "fail_temporary", "complete", "relaunch"]), rng.randrange(1, 4)) for n in range(60)] + [("end", 99, 40 * DAY, "claim", 1)]
    batches = [rows[i : i + 10] for i in range(0, len(rows), 10)]
    for batch in batches:
        rng.shuffle(batch)
        df = spark.createDataFrame([(*r, r[2] + 50 * SECOND) for r in batch], "k string, event_id long, at_us long, kind string, attempt int, until_us long")
        df.withColumn("at", F.timestamp_micros("at_us")).coalesce(1).write.mode("append").parquet(path)
    single = found(spark, path, "single_keys", 2 * DAY, None)
    assert len(single) > 50 and found(spark, path, "in_buckets", 2 * DAY, 2) == single
