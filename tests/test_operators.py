"""Bitemporal, coverage and geographic operators on small tables with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from annalist.operators import asof, coverage, documents, facts, geo, intervals, ledger, lineage, paging, reports
from annalist.sources import readers, sinks


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def table(spark, schema, *rows):
    """Rows with times as text, cast to the schema."""
    names = [f.strip().split()[0] for f in schema.split(",")]
    loose = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} string" if k in ("timestamp_ntz", "date") else f"{n} {k}" for n, k in (f.strip().split() for f in schema.split(","))))
    return loose.select(*[F.col(n).cast(k) for n, k in zip(names, (f.strip().split()[1] for f in schema.split(",")), strict=True)])


MEASURES = "measure_id long, version_id long, extraction_id int, document_id string, source_id string, acquired_at timestamp_ntz, fingerprint string, recorded_at timestamp_ntz, state string, precision string, valid_from timestamp_ntz, valid_until timestamp_ntz"


def measure(i, version, extraction, document, acquired, fingerprint, recorded, state="supported", source="s"):
    day = "2026-01-01 00:00:"
    return (i, version, extraction, document, source, f"{day}{acquired:02d}", fingerprint, f"{day}{recorded:02d}", state, "interval", "2026-01-01 10:00:00", "2026-01-01 12:00:00")


SUSPENSIONS = "source_id string, suspended_at timestamp_ntz, resumed_at timestamp_ntz"


def shown(spark, rows, known, suspensions=()):
    measures, held = table(spark, MEASURES, *rows), table(spark, SUSPENSIONS, *suspensions)
    return sorted(r.measure_id for r in facts.selected(measures, held, at(f"2026-01-01 00:00:{known:02d}")).collect())


def test_equivalent_replacement(spark):
    rows = [
        measure(1, 1, 1, "x", 5, "fx", 10), measure(2, 2, 1, "x", 15, "fx", 40),  # x: a later equal version, projected late
        measure(3, 3, 1, "y", 5, "fy", 10), measure(4, 3, 1, "y", 5, "fy", 10), measure(5, 4, 1, "y", 15, "fy2", 20),  # y: the text changed
        measure(6, 5, 1, "z", 5, None, 10), measure(7, 6, 1, "z", 15, None, 20),  # z: no fingerprint
    ]
    assert shown(spark, rows, 12) == [1, 3, 4, 6]
    assert shown(spark, rows, 35) == [1, 3, 4, 5, 6, 7]
    assert shown(spark, rows, 45) == [2, 3, 4, 5, 6, 7]


def test_same_version_replacement_and_states(spark):
    rows = [measure(1, 1, 1, "x", 5, "f", 10), measure(2, 1, 2, "x", 5, "f", 30), measure(3, 2, 1, "w", 5, None, 10, state="rejected")]
    assert shown(spark, rows, 20) == [1] and shown(spark, rows, 57) == [2]


def test_suspension_freezes_interpretation(spark):
    rows = [measure(1, 1, 1, "x", 5, None, 10), measure(2, 2, 1, "y", 5, None, 30)]
    open_, resumed = ("s", "2026-01-01 00:00:20", None), ("s", "2026-01-01 00:00:20", "2026-01-01 00:00:40")
    assert shown(spark, rows, 35, [open_]) == [1]
    assert shown(spark, rows, 35, [resumed]) == [1] and shown(spark, rows, 40, [resumed]) == [1, 2]
    assert shown(spark, rows, 35) == [1, 2]


def test_later_records_do_not_change_earlier_answers(spark):
    rows = [measure(i, i, 1, f"d{i % 3}", i % 20, f"f{i % 2}", (i * 7) % 50) for i in range(1, 25)]
    for known in (10, 25, 40):
        earlier = [r for r in rows if r[7] <= f"2026-01-01 00:00:{known:02d}"]
        assert shown(spark, rows, known) == shown(spark, earlier, known)


def test_superseded_status_and_relations(spark):
    measures = facts.selected(table(spark, MEASURES, measure(1, 1, 1, "x", 5, None, 10), measure(2, 2, 1, "y", 5, None, 10)), table(spark, SUSPENSIONS), at("2026-01-01 11:00:00"))
    updates = table(spark, "update_id long, target_id long, relation string, applied_at timestamp_ntz", (2, 1, "replaces", "2026-01-01 10:30:00"))
    status = lambda t: {r.measure_id: r.status for r in facts.with_status(measures, updates, at(t)).collect()}
    assert status("2026-01-01 10:15:00") == {1: "current", 2: "current"}
    assert status("2026-01-01 10:45:00") == {1: "superseded", 2: "current"}
    assert status("2026-01-01 09:00:00") == {1: "future", 2: "future"}
    related = {r.measure_id: [(x.direction, x.other) for x in r.relations] for r in facts.relations(updates, at("2026-01-02")).collect()}
    assert related == {1: [("updated_by", 2)], 2: [("updates", 1)]}


def test_linked_updates_are_applied_once(spark):
    links = table(spark, "linking_run_id long, update_run long, update_ordinal int, target_run long, target_ordinal int, relation string", (9, 1, 0, 2, 1, "replaces"), (9, 1, 0, 2, 1, "replaces"), (9, 1, 5, 2, 1, "amends"))
    bound = table(spark, "extraction_run_id long, extraction_ordinal int, measure_id string", (1, 0, "a"), (2, 1, "b"))
    none = table(spark, "linking_run_id long, update_id string, target_id string")
    edges = facts.apply_linked(links, bound, none, at("2026-01-01"))
    assert [(r.update_id, r.target_id, r.relation) for r in edges.collect()] == [("a", "b", "replaces")]
    assert facts.apply_linked(links, bound, edges.select("linking_run_id", "update_id", "target_id"), at("2026-01-01")).count() == 0


def test_temporal_values_and_carry_forward(spark):
    values = table(spark, "id long, entity_kind string, entity_id string, meaning string, created_at timestamp_ntz", (1, "m", "a", "validity", "2026-01-01"), (2, "m", "a", "validity", "2026-01-01"), (3, "m", "a", "validity", "2026-02-01"), (4, "r", "a", "validity", "2026-01-01"))
    assert [r.id for r in facts.temporal_value(values, "m", "validity", at("2026-01-15")).collect()] == [2]
    rows = table(spark, "k string, t int, v string", ("a", 1, "ok1"), ("a", 2, "bad"), ("a", 3, "ok3"), ("a", 4, "bad"), ("b", 1, "bad"), (None, 1, "okn"), (None, 2, "bad"))
    out = asof.carried_forward(rows, ["k"], ["t"], "v", F.col("v").startswith("ok"))
    assert sorted((str(r.k), r.t, r.presented) for r in out.collect()) == [("None", 1, "okn"), ("None", 2, "bad"), ("a", 1, "ok1"), ("a", 2, "ok1"), ("a", 3, "ok3"), ("a", 4, "ok3"), ("b", 1, "bad")]


def test_intervals(spark):
    rows = table(spark, "k string, a timestamp_ntz, b timestamp_ntz", ("x", "2026-01-01 01:00:00", "2026-01-01 02:00:00"), ("x", "2026-01-01 02:00:00", "2026-01-01 03:00:00"), ("x", "2026-01-01 03:00:50", "2026-01-01 23:00:00"), ("y", "2025-12-31 00:00:00", "2026-01-03 00:00:00"))
    gaps = intervals.complement(rows, ["k"], "a", "b", at("2026-01-01"), at("2026-01-02"), 60)
    assert sorted((r.k, str(r.gap_start)[11:], str(r.gap_end)[8:]) for r in gaps.collect()) == [("x", "00:00:00", "01 01:00:00"), ("x", "23:00:00", "02 00:00:00")]
    seconds = lambda df: df.select("k", F.timestamp_diff("SECOND", F.col("a"), F.col("b")).alias("n"))
    clipped = rows.select("k", F.greatest("a", at("2026-01-01")).alias("a"), F.least("b", at("2026-01-02")).alias("b"))
    covered = {r.k: r.n for r in seconds(intervals.merged(clipped, ["k"], "a", "b")).groupBy("k").agg(F.sum("n").alias("n")).collect()}
    left = {r.k: r.n for r in intervals.complement(rows, ["k"], "a", "b", at("2026-01-01"), at("2026-01-02")).select("k", F.timestamp_diff("SECOND", F.col("gap_start"), F.col("gap_end")).alias("n")).groupBy("k").agg(F.sum("n").alias("n")).collect()}
    assert all(covered[k] + left.get(k, 0) == 86400 for k in covered)
    checks = table(spark, "k string, t timestamp_ntz", ("x", "2026-01-01 06:00:00"), ("x", "2026-01-01 10:00:00"))
    gap = intervals.largest_gap(checks, ["k"], "t", at("2026-01-01"), at("2026-01-02")).first()
    assert gap.max_gap_seconds == 14 * 3600


def test_overlap_join_counts_pairs_once(spark):
    left = table(spark, "k string, i int, a timestamp_ntz, b timestamp_ntz", ("x", 1, "2026-01-01 10:00:00", "2026-01-04 00:00:00"), ("x", 2, "2026-01-05 00:00:00", "2026-01-05 00:00:00"))
    right = table(spark, "k string, j int, c timestamp_ntz, d timestamp_ntz", ("x", 1, "2026-01-02 00:00:00", "2026-01-09 00:00:00"), ("x", 2, "2026-01-04 00:00:00", "2026-01-05 00:00:00"), ("y", 3, "2026-01-01 00:00:00", "2026-01-09 00:00:00"))
    assert [(r.i, r.j) for r in intervals.overlap_join(left, right, ["k"], ("a", "b"), ("c", "d")).collect()] == [(1, 1)]


def test_lineage(spark):
    chain = table(spark, "n long, p long", *[(i, i - 1 if i > 1 else None) for i in range(1, 40)])
    assert {(r.root, r.depth) for r in lineage.roots(chain, "n", "p").where("n = 39").collect()} == {(1, 38)}
    candidates = table(spark, "run_id long", (1,), (2,), (5,))
    runs = table(spark, "run_id long", (1,), (2,), (3,), (5,))
    edges = table(spark, "run_id long, original_run_id long", (3, 2), (2, 1))
    assert [r.run_id for r in documents.without_ancestors(candidates, edges, runs).collect()] == [5]


def test_paging(spark):
    rows = spark.range(7).withColumnRenamed("id", "k")
    page = paging.offset_page(rows, [F.col("k")], 3, 1).collect()
    assert [(r.k, r.more) for r in page] == [(3, True), (4, True), (5, True)]
    assert [r.more for r in paging.offset_page(rows, [F.col("k")], 3, 2).collect()] == [False]
    order = rows.limit(1).select(*[paging.ranked(F.lit(s), paging.STATUS_ORDER).alias(s) for s in ("current", "expired", "odd")]).first()
    assert order.current < order.expired < order.odd


def test_acceptance(spark):
    reviews = table(spark, "id long, source_id string, at timestamp_ntz, decision string, limited boolean, product string, territory string", (1, "a", "2026-01-01", "accepted", False, "p", "t"), (2, "b", "2026-01-01", "accepted", True, "p", "u"), (3, "b", "2026-01-02", "accepted", True, "p", "u"), (4, "c", "2026-01-01", "accepted", False, "p", "v"), (5, "c", "2026-01-02", "rejected", False, "p", "v"))
    regressions = table(spark, "id long, source_id string, at timestamp_ntz, passed boolean", (1, "a", "2025-12-31", False), (2, "b", "2026-01-03", False))
    assert [r.source_id for r in coverage.accepted(reviews, regressions).collect()] == ["a"]
    required = table(spark, "product string, territory string", ("p", "t"), ("p", "u"), ("p", "v"))
    scopes = coverage.release_readiness(required, reviews, table(spark, "source_id string"))
    assert {r.territory: r.status for r in scopes.collect()} == {"t": "accepted_declared_scope", "u": "accepted_with_limitations", "v": "pending"}
    assert coverage.overall_readiness(scopes).first().overall == "partial"


def test_geography(spark):
    log = table(spark, "kind string, dataset_id string, selected_at timestamp_ntz, id long", ("m", "d1", "2026-01-01", 1), ("m", "d2", "2026-02-01", 2))
    towns = table(spark, "dataset_id string, istat string, name string, province string, supported boolean", ("d1", "000001", "Rho", "MI", True), ("d2", "000001", "Rho", "MI", True), ("d2", "000002", "Lu", "AL", False), ("d2", "000003", "Lu", "XX", True))
    d1, d2 = geo.dataset_at(log, "m", at("2026-01-15")), geo.dataset_at(log, "m", at("2026-03-01"))
    status = lambda d, **k: geo.discover(towns, d, **k).first().status
    assert status(d2, name="rho") == "ok" and status(d1, istat="000002") == "not_found"
    assert status(d2, name="LU") == "ambiguous" and status(d2, istat="000002") == "unsupported_area"
    with pytest.raises(ValueError, match="not both"):
        geo.discover(towns, d2, name="a", istat="b")
    levels = table(spark, "town string, level string", ("a", "yellow"), ("a", "red"), ("b", "green"), ("c", "mauve"))
    summary = {r.town: (r.level, r.partial_territory) for r in coverage.level_summary(levels, ["town"], ["red", "orange", "yellow", "green"]).collect()}
    assert summary == {"a": ("red", True), "b": ("green", False), "c": ("mauve", False)}


def test_two_days(spark):
    values = table(spark, "i int, precision string, valid_from timestamp_ntz, valid_until timestamp_ntz", (1, "instant", "2026-01-02 00:00:00", None), (2, "interval", "2025-12-31 00:00:00", "2026-01-01 00:00:01"), (3, "conditional", None, None), (4, "interval", "2026-01-01 12:00:00", None))
    assert sorted((r.i, r.day) for r in reports.two_days(values, at("2026-01-01")).collect()) == [(1, "tomorrow"), (2, "today"), (3, "undated"), (4, "today"), (4, "tomorrow")]


def test_completeness_and_projection(spark):
    present = table(spark, "category string, workload string, usage_unknown long, cost_unknown long", ("ocr", "ordinary", 0, 0), ("text", "ordinary", 1, 1))
    required = table(spark, "category string, workload string", ("ocr", "ordinary"), ("storage", "ordinary"))
    codes = ledger.completeness(present, required, table(spark, "currency string", ("EUR",), ("EUR",)))
    assert [r.code for r in codes.collect()] == ["cost_unknown:text:ordinary", "metric_missing:storage:ordinary", "usage_unknown:text:ordinary"]
    assert spark.range(1).select(ledger.monthly_projection(F.lit(1950).cast("long"), F.lit(7 * 86400).cast("long")).alias("x")).first().x == -(-1950 * 30 // 7)


def test_content_identity(spark):
    parts = table(spark, "version_id long, url string, role string, object_hash string, required boolean", (1, "u2", "pdf", "h2", True), (1, "u1", "html", "h1", True), (2, "u1", "html", "h1", True), (2, "u2", "pdf", "h2", True), (3, "u1", "html", None, True), (4, "u1", "html", None, False))
    found = {r.version_id: (r.identity, r.complete) for r in documents.identity(parts).collect()}
    assert found[1] == found[2] and found[1][1] and not found[3][1] and found[4][1]


# ---- sources and sinks


def test_csv_readers_refuse_bad_files(spark, tmp_path):
    def path(name, *lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    good = readers.municipalities_csv(spark, path("m.csv", "istat,name,province", "000001,Rho,MI", "000002,Lu,AL"))
    assert good.count() == 2
    with pytest.raises(readers.Rejected, match="codes"):
        readers.municipalities_csv(spark, path("c.csv", "istat,name,province", "1,Rho,MI"))
    with pytest.raises(readers.Rejected, match="repeated"):
        readers.municipalities_csv(spark, path("d.csv", "istat,name,province", "000001,Rho,MI", "000001,Lu,AL"))
    assert readers.zones_csv(spark, path("z.csv", "istat,zone,territorial_scope", "000001,A,whole", "000002,B,partial"), good).count() == 2
    with pytest.raises(readers.Rejected, match="without zone"):
        readers.zones_csv(spark, path("w.csv", "istat,zone,territorial_scope", "000001,A,whole"), good)


def test_sinks_are_idempotent(spark):
    have = table(spark, "k string, body string", ("a", "1"))
    assert [r.k for r in sinks.outbox(have, table(spark, "k string, body string", ("a", "1"), ("b", "2")), "k", "body").collect()] == ["b"]
    with pytest.raises(sinks.Conflict, match="a"):
        sinks.outbox(have, table(spark, "k string, body string", ("a", "other")), "k", "body")
    old = table(spark, "k string, v string, t int", ("a", "x", 5), ("b", "y", 6))
    new = table(spark, "k string, v string, t int", ("a", None, 3), ("c", "z", 1))
    out = sinks.merged(old, new, ["k"], {"t": F.least("old_t", "new_t")})
    assert sorted(map(tuple, out.collect())) == [("a", "x", 3), ("b", "y", 6), ("c", "z", 1)]
    staged = spark.createDataFrame([("d", "h1", ["o1"]), ("d", "h2", ["o1", "o9"]), ("e", "h3", ["o1"])], "document_id string, content_hash string, object_hashes array<string>")
    versions = spark.createDataFrame([("e", "h3")], "document_id string, content_hash string")
    stored = spark.createDataFrame([("o1",)], "object_hash string")
    assert [(r.document_id, r.content_hash) for r in sinks.append_versions(staged, versions, stored).collect()] == [("d", "h1")]


def test_objects_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}").write_bytes(b"data %d" % (i // 2))
    found = readers.objects(spark, str(tmp_path / "in"))
    sinks.store_objects(found.drop("path"), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_reachable_on_long_chains_with_branches_and_cycles(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(3000)] + [(1000, 5000), (5000, 5001), (2500, 7000), *((7000 + i, 7001 + i) for i in range(500)), (7500, 2400), (9000, 9001), (9001, 9000), (None, 4), (3, None), (3, 4)]
    nodes = [rng.randrange(40) + 20_000 for _ in range(70)]
    edges += list(zip(nodes[::2], nodes[1::2], strict=True))
    rows = spark.createDataFrame(edges, "a long, b long")
    for first in ([0], [1500, 20_001, 20_002, 9000, 123_456], []):
        seen, todo = set(first), list(first)
        while todo:
            x = todo.pop()
            new = {b for a, b in edges if a == x and b is not None} - seen
            seen |= new
            todo += new
        got = lineage.reachable(rows, "a", "b", spark.createDataFrame([(x,) for x in first], "n long"))
        assert sorted(r.n for r in got.collect()) == sorted(seen)


def test_rows_are_dealt_out_although_a_file_is_one_row_group(spark, tmp_path):
    from pyspark.sql import functions as F

    from annalist.plans.base import dealt_table

    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    held = dealt_table(spark, str(tmp_path), "orders").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in held) < 200


@pytest.mark.parametrize("backwards", [False, True])
def test_ties_of_time_and_id_are_told_apart_by_value(spark, backwards):
    from annalist.operators import documents, governance

    log = [(1, 5, 9, "archive"), (1, 5, 9, "recover"), (2, 5, 9, "archive")][:: -1 if backwards else 1]
    pending = spark.createDataFrame([(1,), (2,)], "version_id int")
    found = governance.archived(pending, spark.createDataFrame(log, "version_id int, at int, id int, action string").coalesce(1), "version_id")
    assert [r.version_id for r in found.collect()] == [2]
    runs = [(1, 7, 5, "failed"), (1, 7, 5, "supported")][:: -1 if backwards else 1]
    runs = spark.createDataFrame(runs, "version_id int, run_id int, created_at int, status string").coalesce(1)
    versions = spark.createDataFrame([(1, 1)], "version_id int, acquired_at int")
    from pyspark.sql import functions as F

    assert documents.assessed(versions, runs, runs.limit(0), F.lit(9)).first()["state"] == "supported"


def test_two_days_reads_its_values_once_and_only_what_may_count(spark):
    from pyspark.sql import functions as F

    from annalist.operators import reports

    rows = [(1, "instant", "2024-05-05 10:00"), (2, "date", "2024-05-06 00:00"), (3, "instant", "2024-05-07 00:00"), (4, "unknown", None), (5, "interval", "2024-01-01 00:00"), (6, None, "2024-05-05 10:00"), (7, "odd", "2024-05-05 10:00")]
    values = spark.createDataFrame(rows, "id int, precision string, v string").select("id", "precision", F.col("v").cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_until"))
    found = reports.two_days(values, F.lit("2024-05-05").cast("timestamp_ntz"))
    assert sorted((r.id, r.day) for r in found.collect()) == [(1, "today"), (2, "tomorrow"), (4, "undated"), (5, "today"), (5, "tomorrow"), (7, "undated")]
    assert "Union" not in found._jdf.queryExecution().toString()


def test_register_search_counts_acts_and_requests_that_do_not_differ_once(spark):
    """As many references as acts of one number and day: each side is one row where they meet."""
    from annalist.operators import acts

    n = 20_000
    day = F.lit("2024-05-05").cast("date")
    register = spark.range(n).select(F.lit(1).alias("source_id"), F.lit("c").alias("category"), F.lit(7).alias("number"), F.lit(2024).alias("year"), day.alias("published"), F.col("id").alias("act_id"), F.lit("Chiusura ponte").alias("object"), day.alias("act_date"))
    asked = spark.range(n).select(F.col("id").alias("version_id"), F.lit(1).alias("reference_id"), F.lit(1).alias("source_id"), F.lit("c").alias("category"), F.lit(7).alias("number"), F.lit(None).cast("int").alias("year"), day.alias("published"), F.array(F.lit("ponte")).alias("terms"), (day - 30).alias("_low"), day.alias("_high"))
    for found in (acts._by_number(asked, register), acts._by_terms(asked, register)):
        assert found.count() == n and found.select("_found", "_accepted", "_act").distinct().collect() == [(n, n, 0)]
