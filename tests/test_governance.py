"""References, clarification, merging, admission and review on small tables with known answers."""

from pyspark.sql import functions as F

from annalist.operators import acts, governance


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_resolution_ladder(spark):
    refs = spark.createDataFrame(
        [(1, 1, "ord", 38, 2026), (1, 2, "ord", 40, 2026), (1, 3, "dec", None, 2025), (1, 4, "dec", None, 2026), (1, 5, "ord", 99, 2026), (1, 6, "det", 1, 2026), (1, 7, "ord", 41, 2026)],
        "version_id long, reference_id int, kind string, number int, year int",
    )
    attached = spark.createDataFrame([(1, 500, "ord", 38, 2026), (2, 501, "ord", 40, 2026)], "version_id long, act_id long, kind string, number int, year int")
    register = spark.createDataFrame(
        [(10, "ord", 40, 2026), (11, "dec", 7, 2025), (12, "dec", 8, 2026), (13, "dec", 9, 2026), (14, "ord", 38, 2026), (15, "ord", 41, 2026), (16, "ord", 41, 2026)], "act_id long, kind string, number int, year int"
    )
    readable = spark.createDataFrame([("ord",), ("dec",)], "kind string")
    found = rows(acts.resolved(refs, attached, register, readable), "reference_id", "method", "act_id")
    assert found == [
        (1, "attached", 500), (2, "numbered", 10), (3, "unique_candidate", 11), (4, "ambiguous", None), (5, "not_found", None), (6, "unavailable", None), (7, "ambiguous", None),
    ]


def test_clarification(spark):
    measures = spark.createDataFrame([(1, 7, "closure", "a", 5), (2, 7, "closure", "b", 5), (3, 7, "closure", "c", 5), (4, 8, "closure", "a", 5)], "measure_id long, act_id long, kind string, subject string, start long")
    clauses = spark.createDataFrame([(7, "closure", "a", 5, 9), (7, "closure", "b", 6, 9), (7, "closure", "c", 5, 9), (7, "closure", "c", 5, 8)], "act_id long, kind string, subject string, clause_start long, clause_end long")
    assert rows(acts.clarified(measures, clauses), "measure_id", "state", "end") == [(1, "clarified", 9), (2, "conflict", None), (3, "conflict", None), (4, "not_matched", None)]


def test_merge_and_temporal_choice(spark):
    found = spark.createDataFrame([(1, "closure", "Via Roma", None, "q1"), (1, "closure", "VIA ROMA", "ponte", "q2"), (1, "ban", "Sosta", None, "q1"), (1, "ban", "sosta", None, "q3")], "v int, kind string, subject string, place string, evidence string")
    merged = {(r.kind, r.place): (r.evidence, r.n, r.conflict) for r in acts.merged(found, ["v"]).collect()}
    assert merged == {("closure", None): (["q1"], 1, True), ("closure", "ponte"): (["q2"], 1, True), ("ban", None): (["q1", "q3"], 2, False)}
    given = spark.createDataFrame([(1, 5, 9), (1, 5, 9), (2, 5, 9), (2, 5, 7), (3, 5, 9), (3, 6, 9), (4, None, 3), (4, 5, 9)], "k int, start int, end int")
    out = {r.k: (r.state, r.start, r.end, r.conflict_id is not None) for r in acts.temporal_choice(given, ["k"]).collect()}
    assert out == {1: ("resolved", 5, 9, False), 2: ("shortest", 5, 7, False), 3: ("conflict", None, None, True), 4: ("conflict", None, None, True)}


def test_envelopes(spark):
    out = spark.createDataFrame([(1, '{"kind": "ban", "quote": "sosta"}'), (2, "{"), (3, '{"kind": "x", "quote": "sosta"}'), (4, '{"kind": "ban", "quote": "no"}'), (5, '{"kind": "ban"}'), (6, None)], "id int, raw string")
    found = rows(acts.envelopes(out.withColumn("source", F.lit("divieto di sosta")), "raw", "kind string, quote string", ["ban"], "source"), "id", "reason")
    assert found == [(1, None), (2, "invalid_json"), (3, "unknown_kind"), (4, "quote_missing"), (5, "invalid_json"), (6, "invalid_json")]


def test_admission_takes_the_last_switch(spark):
    jobs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "job_id int, source_id string")
    switches = spark.createDataFrame([(1, 1, True), (2, 2, False), (3, 3, True)], "at int, id int, enabled boolean")
    own = spark.createDataFrame([("a", 1, 1, False), ("b", 1, 2, True), ("b", 1, 3, False)], "source_id string, at int, id int, enabled boolean")
    at = lambda t: rows(governance.admitted(jobs, switches, own, F.lit(t)), "job_id", "admitted")
    assert at(3) == [(1, False), (2, False), (3, True)]
    assert at(2) == [(1, False), (2, False), (3, False)]


def test_words_become_lines(spark):
    words = spark.createDataFrame([(1, 0.0, 5.0, "b"), (1, 0.4, 1.0, "a"), (1, 12.0, 0.0, "c"), (2, 0.0, 0.0, "d")], "page int, y double, x double, word string")
    assert rows(governance.lines_of_words(words, ["page"]), "page", "line", "text") == [(1, 1, "a b"), (1, 2, "c"), (2, 1, "d")]


def test_text_layer_and_maps(spark):
    good, bad = "twenty letters and more in here", "short"
    pages = spark.createDataFrame([(1, 1, good), (1, 2, good), (2, 1, good), (2, 3, good), (3, 1, bad), (4, 1, good + "\x01")], "v int, page int, text string")
    assert rows(governance.text_layer(pages, "v"), "v", "accepted") == [(1, True), (2, False), (3, False), (4, False)]
    facts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "a")], "m int, zone string")
    assert rows(governance.complete_maps(facts, ["m"], ["zone"], 2), "m", "complete") == [(1, True), (2, False), (3, False)]


def test_single_flight(spark):
    requests = spark.createDataFrame([(1, "x", 1, 99, False), (2, "x", 2, 99, False), (3, "y", 1, 5, False), (4, "y", 2, 99, False), (5, "z", 3, 0, True), (6, "z", 1, 99, False)], "id int, artifact string, at int, lease_expires_at int, finished boolean")
    assert rows(governance.single_flight(requests, "artifact", F.lit(10)), "id", "leader", "role") == [(1, 1, "leads"), (2, 1, "waits"), (4, 4, "leads"), (5, 5, "leads"), (6, 5, "reuses")]
