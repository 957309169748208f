"""The public questions: measures, documents, coverage, geography, readiness and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import temporal
from annalist.operators import asof, coverage, documents, facts, geo, reports
from annalist.plans.base import at, query, shape, table

KNOWN, EVALUATED = "1998-06-30", "1998-08-01"
SEEN = f"""
frozen AS (SELECT source_id, min(suspended_at) AS f FROM suspensions WHERE suspended_at <= TIMESTAMP '{KNOWN}' AND (resumed_at IS NULL OR resumed_at > TIMESTAMP '{KNOWN}') GROUP BY 1),
seen AS (SELECT m.*, least(TIMESTAMP '{KNOWN}', f) AS cutoff FROM measures m LEFT JOIN frozen USING (source_id)
  WHERE acquired_at <= TIMESTAMP '{KNOWN}' AND recorded_at <= least(TIMESTAMP '{KNOWN}', f)),
own AS (SELECT s.* FROM seen s JOIN (SELECT version_id, max(extraction_id) AS e FROM seen GROUP BY 1) l ON s.version_id = l.version_id AND s.extraction_id = l.e),
last AS (SELECT document_id, fingerprint, max((acquired_at, version_id)) AS top FROM own WHERE fingerprint IS NOT NULL GROUP BY 1, 2),
shown AS (SELECT o.* FROM own o LEFT JOIN last l ON o.document_id = l.document_id AND o.fingerprint = l.fingerprint
  WHERE (l.top IS NULL OR (o.acquired_at, o.version_id) >= l.top) AND state IN ('supported', 'partial', 'unreliable'))"""
STATUS = """CASE WHEN precision = 'interval' AND valid_from IS NOT NULL THEN CASE WHEN {t} < valid_from THEN 'future' WHEN valid_until IS NOT NULL AND {t} >= valid_until THEN 'expired' ELSE 'current' END
  WHEN precision = 'instant' AND valid_from IS NOT NULL AND {t} < valid_from THEN 'future' ELSE 'undetermined' END"""
T = f"TIMESTAMP '{EVALUATED}'"


def _shown(spark, sf_dir):
    return facts.selected(shape(spark, sf_dir, "measures"), shape(spark, sf_dir, "suspensions"), at(KNOWN))


@query(f"WITH {SEEN} SELECT measure_id, version_id, source_id, state FROM shown", "measures suspensions")
def selected_measures(spark, sf_dir):
    """Measures to show at a time of knowledge (Q11, Q12)."""
    return _shown(spark, sf_dir).select("measure_id", "version_id", "source_id", "state")


@query(f"""
WITH {SEEN} SELECT measure_id, CASE WHEN u.applied <= least({T}, cutoff) THEN 'superseded' ELSE {STATUS.format(t=T)} END AS status
FROM shown LEFT JOIN (SELECT target_id, min(applied_at) AS applied FROM updates GROUP BY 1) u ON measure_id = target_id""", "measures suspensions updates")
def measure_states(spark, sf_dir):
    """Selected measures with their status at the evaluation time (Q13, Q19)."""
    return facts.with_status(_shown(spark, sf_dir), shape(spark, sf_dir, "updates"), at(EVALUATED)).select("measure_id", "status")


@query(f"""
WITH {SEEN}, st AS (SELECT source_id, CASE WHEN u.applied <= least({T}, cutoff) THEN 'superseded' ELSE {STATUS.format(t=T)} END AS status
  FROM shown LEFT JOIN (SELECT target_id, min(applied_at) AS applied FROM updates GROUP BY 1) u ON measure_id = target_id)
SELECT coalesce(m.source_id, v.source_id) AS source_id, coalesce(current, 0) AS current, coalesce(measures, 0) AS measures, documents, history_start
FROM (SELECT source_id, count(*) AS measures, count(*) FILTER (WHERE status = 'current') AS current FROM st GROUP BY 1) m RIGHT JOIN
  (SELECT source_id, count(DISTINCT document_id) AS documents, min(acquired_at) AS history_start FROM versions WHERE acquired_at <= TIMESTAMP '{KNOWN}' GROUP BY 1) v ON m.source_id = v.source_id""",
       "measures suspensions updates versions")
def situation(spark, sf_dir):
    """The situation of each source: measures by status, documents and the start of history."""
    rows = facts.with_status(_shown(spark, sf_dir), shape(spark, sf_dir, "updates"), at(EVALUATED))
    counts = rows.groupBy("source_id").agg(F.count("*").alias("measures"), F.count_if(F.col("status") == "current").alias("current"))
    known = shape(spark, sf_dir, "versions").where(F.col("acquired_at") <= at(KNOWN))
    docs = known.groupBy("source_id").agg(F.countDistinct("document_id").alias("documents"), F.min("acquired_at").alias("history_start"))
    return docs.join(counts, "source_id", "left").fillna(0, ["measures", "current"]).select("source_id", "current", "measures", "documents", "history_start")


@query(f"SELECT measure_id, {STATUS.format(t=T)} AS status FROM measures", "measures")
def validity_status(spark, sf_dir):
    """Status by validity alone (Q15)."""
    own = temporal.status(F.col("precision"), F.col("valid_from"), F.col("valid_until"), at(EVALUATED))
    return shape(spark, sf_dir, "measures").select("measure_id", own.alias("status"))


@query("""
SELECT measure_id FROM measures WHERE precision IN ('unknown', 'conditional') OR valid_from IS NULL OR (valid_from < TIMESTAMP '1997-03-01' AND CASE precision
  WHEN 'instant' THEN valid_from >= TIMESTAMP '1997-02-01' WHEN 'date' THEN valid_from + INTERVAL 1 DAY > TIMESTAMP '1997-02-01' ELSE valid_until IS NULL OR valid_until > TIMESTAMP '1997-02-01' END)""", "measures")
def interval_intersects(spark, sf_dir):
    """Measures whose validity may touch a range."""
    return facts.filtered(shape(spark, sf_dir, "measures"), low=at("1997-02-01"), high=at("1997-03-01")).select("measure_id")


@query("""
WITH a AS (SELECT * FROM updates WHERE applied_at <= TIMESTAMP '1998-01-01'),
n AS (SELECT update_id AS measure_id, applied_at, 'updates' AS direction, target_id AS other FROM a UNION ALL SELECT target_id, applied_at, 'updated_by', update_id FROM a)
SELECT measure_id, string_agg(direction || ':' || other, ',' ORDER BY applied_at, direction, other) AS related FROM n GROUP BY measure_id""", "updates")
def measure_relations(spark, sf_dir):
    """Neighbours of measures along updates, both ways (Q18)."""
    rows = facts.relations(shape(spark, sf_dir, "updates"), at("1998-01-01"))
    return rows.select("measure_id", F.array_join(F.transform("relations", lambda r: F.concat_ws(":", r["direction"], r["other"])), ",").alias("related"))


@query("""
SELECT m.measure_id, n.newer_at FROM measures m JOIN (SELECT document_id, max(acquired_at) AS newer_at FROM versions WHERE acquired_at <= TIMESTAMP '1998-06-30' AND NOT interpreted AND priority <> '3-MEDIUM' GROUP BY 1) n
  ON m.document_id = n.document_id AND n.newer_at > m.acquired_at""", "measures versions")
def newer_warnings(spark, sf_dir):
    """Measures whose document has a newer version without interpretation (Q20)."""
    versions = shape(spark, sf_dir, "versions")
    reuse = versions.where("priority = '3-MEDIUM'").select("version_id")
    return facts.newer_warnings(shape(spark, sf_dir, "measures"), versions, reuse, at("1998-06-30"))


@query("""
SELECT version_id, status AS own, CASE WHEN status IN ('F', 'P') THEN version_id ELSE coalesce((SELECT w.version_id FROM versions w WHERE w.document_id = v.document_id AND w.priority = v.priority AND w.status IN ('F', 'P')
  AND (w.acquired_at, w.version_id) < (v.acquired_at, v.version_id) ORDER BY w.acquired_at DESC, w.version_id DESC LIMIT 1), v.version_id) END AS presented FROM versions v""", "versions")
def carry_forward(spark, sf_dir):
    """Failed versions present the assessment of the last equivalent one before (Q24)."""
    rows = shape(spark, sf_dir, "versions")
    shown = asof.carried_forward(rows, ["document_id", "priority"], ["acquired_at", "version_id"], "version_id", F.col("status").isin("F", "P"))
    return shown.select("version_id", F.col("status").alias("own"), "presented")


@query("""
SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1""".replace("lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k", "sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS fingerprint"))
def exact_repeats(spark, sf_dir):
    """Texts that are equal but for case and space."""
    return documents.exact_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
WITH v AS (SELECT doc_id, source, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS fp FROM documents)
SELECT doc_id, EXISTS (SELECT 1 FROM v w WHERE w.fp = v.fp AND w.doc_id > v.doc_id) AS replaced FROM v""")
def equivalent_replacement(spark, sf_dir):
    """Documents that a later equal one replaces, set-based."""
    rows = table(spark, sf_dir, "documents").select("doc_id", documents.fingerprint(F.col("text")).alias("fp"))
    return asof.replaced_by_later(rows, ["fp"], ["doc_id"], F.lit(True)).select("doc_id", "replaced")


@query("""
SELECT version_id, document_id, acquired_at FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY acquired_at DESC, version_id DESC) AS n FROM versions WHERE acquired_at <= TIMESTAMP '1998-06-30')
WHERE n = 1 AND acquired_at >= TIMESTAMP '1997-06-01' AND acquired_at < TIMESTAMP '1998-06-01'""", "versions")
def search_documents(spark, sf_dir):
    """Latest visible versions acquired in a range (Q07, Q08)."""
    return documents.search(shape(spark, sf_dir, "versions"), at("1998-06-30"), at("1997-06-01"), at("1998-06-01")).select("version_id", "document_id", "acquired_at")


@query("""
SELECT document_id, version_id, acquired_at, (row_number() OVER w)::INTEGER AS ordinal, lead(acquired_at) OVER w AS until, lead(acquired_at) OVER w IS NULL AS latest
FROM versions WHERE acquired_at <= TIMESTAMP '1998-06-30' WINDOW w AS (PARTITION BY document_id ORDER BY acquired_at, version_id)""", "versions")
def document_chronology(spark, sf_dir):
    """Versions of each document in order (Q09)."""
    return documents.chronology(shape(spark, sf_dir, "versions"), at("1998-06-30"))


@query("""
WITH e AS (SELECT run_id AS version_id, CASE outcome WHEN 'succeeded' THEN 'supported' WHEN 'failed' THEN 'failed' ELSE 'partial' END AS status, row_number() OVER (PARTITION BY run_id ORDER BY at DESC, id DESC) AS n
  FROM attempts WHERE stage = 'F' AND at <= TIMESTAMP '1998-01-01'),
c AS (SELECT run_id AS version_id, CASE outcome WHEN 'succeeded' THEN 'relevant' ELSE 'irrelevant' END AS status, row_number() OVER (PARTITION BY run_id ORDER BY at DESC, id DESC) AS n
  FROM attempts WHERE stage = 'O' AND at <= TIMESTAMP '1998-01-01')
SELECT v.version_id, CASE WHEN e.status IS NOT NULL THEN e.status WHEN c.status = 'irrelevant' THEN 'irrelevant' WHEN c.status IS NOT NULL THEN 'pending' ELSE 'unprocessed' END AS state
FROM versions v LEFT JOIN e ON e.version_id = v.version_id AND e.n = 1 LEFT JOIN c ON c.version_id = v.version_id AND c.n = 1 WHERE acquired_at <= TIMESTAMP '1998-01-01'""", "versions attempts")
def assessed_versions(spark, sf_dir):
    """State of each version by extraction, or by classification without one (Q23)."""
    runs = shape(spark, sf_dir, "attempts")
    part = lambda stage, status: runs.where(F.col("stage") == stage).selectExpr("run_id AS version_id", "id AS run_id", "at AS created_at", f"{status} AS status")
    extractions = part("F", "CASE outcome WHEN 'succeeded' THEN 'supported' WHEN 'failed' THEN 'failed' ELSE 'partial' END")
    classifications = part("O", "CASE outcome WHEN 'succeeded' THEN 'relevant' ELSE 'irrelevant' END")
    return documents.assessed(shape(spark, sf_dir, "versions"), extractions, classifications, at("1998-01-01")).select("version_id", "state")


@query("""
SELECT version_id, acquired_at + INTERVAL 24 MONTH AS expires_at FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY acquired_at DESC, version_id DESC) AS n FROM versions) v
WHERE n > 1 AND acquired_at + INTERVAL 24 MONTH <= TIMESTAMP '1999-01-01' AND NOT EXISTS (SELECT 1 FROM measures m WHERE m.version_id = v.version_id AND state = 'supported' AND valid_from IS NOT NULL AND valid_until IS NULL)""", "versions measures")
def retention_candidates(spark, sf_dir):
    """Versions that may go: old, not the latest, and without a measure in force."""
    protected = shape(spark, sf_dir, "measures").where("state = 'supported' AND valid_from IS NOT NULL AND valid_until IS NULL").select("version_id")
    return documents.retention_candidates(shape(spark, sf_dir, "versions"), protected, 24, at("1999-01-01")).select("version_id", "expires_at")


@query("""
SELECT version_id, (SELECT min(w.version_id) FROM versions w WHERE w.fingerprint = v.fingerprint AND w.priority = v.priority AND w.document_id = v.document_id AND w.interpreted AND w.version_id < v.version_id) AS equivalent FROM versions v""", "versions")
def earliest_equivalent(spark, sf_dir):
    """The earliest finished run with the same input."""
    runs = shape(spark, sf_dir, "versions").select("version_id", F.col("version_id").alias("run_id"), F.concat_ws("/", "priority", F.col("document_id")).alias("stage"), "fingerprint", F.col("interpreted").alias("finished"))
    return documents.earliest_equivalent(runs).select("version_id", "equivalent")


@query("""
WITH r AS (SELECT version_id, first_value(version_id) OVER w AS representative, first_value(interpreted) OVER w AS done FROM versions WHERE fingerprint IS NOT NULL WINDOW w AS (PARTITION BY document_id, fingerprint ORDER BY version_id))
SELECT version_id AS run_id, representative FROM r WHERE version_id <> representative AND NOT done""", "versions")
def waiting_equivalent(spark, sf_dir):
    """Runs that wait for the first of their class (Q38)."""
    runs = shape(spark, sf_dir, "versions").select(F.col("version_id").alias("run_id"), F.col("document_id").cast("string").alias("stage"), "fingerprint", F.col("interpreted").alias("finished"))
    return documents.waiting_equivalent(runs).select("run_id", "representative")


@query("SELECT version_id, source_id FROM versions WHERE source_id = 7 AND error_code = 'too_large' AND acquired_at >= TIMESTAMP '1996-01-01'", "versions")
def reprocess_selection(spark, sf_dir):
    """Versions to process again by source, range and error (X11)."""
    return documents.reprocess_selection(shape(spark, sf_dir, "versions"), 7, at("1996-01-01"), None, "too_large").select("version_id", "source_id")


# ---- coverage and acceptance

ACCEPTED = """
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY at DESC, id DESC) AS n FROM acceptances) WHERE n = 1 AND decision = 'accepted'),
ok AS (SELECT source_id FROM la WHERE NOT EXISTS (SELECT 1 FROM regressions r WHERE r.source_id = la.source_id AND NOT r.passed AND r.at >= la.at))"""


@query(f"""
WITH {ACCEPTED} SELECT product, territory, count(*) AS sources, CASE WHEN bool_or(ok.source_id IS NOT NULL AND enabled AND NOT suspended) THEN 'enabled'
  WHEN bool_or(ok.source_id IS NOT NULL AND enabled AND suspended) THEN 'suspended' ELSE 'pending' END AS state FROM sources s LEFT JOIN ok ON ok.source_id = s.source_id GROUP BY product, territory""", "sources acceptances regressions")
def coverage_state(spark, sf_dir):
    """Coverage of each product and territory."""
    ok = coverage.accepted(shape(spark, sf_dir, "acceptances"), shape(spark, sf_dir, "regressions"))
    return coverage.coverage_state(shape(spark, sf_dir, "sources"), ok, ["product", "territory"])


@query("SELECT source_id, bool_and(passed) AS ready FROM (SELECT *, row_number() OVER (PARTITION BY source_id, suite ORDER BY at DESC, id DESC) AS n FROM regressions) WHERE n = 1 GROUP BY source_id", "regressions")
def regression_ready(spark, sf_dir):
    """Sources whose suites all passed last."""
    return coverage.regression_ready(shape(spark, sf_dir, "regressions"))


READY = """
lr AS (SELECT a.*, s.product, s.territory FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY at DESC, id DESC) AS n FROM acceptances) a JOIN sources s ON s.source_id = a.source_id WHERE n = 1),
bad AS (SELECT DISTINCT source_id FROM regressions WHERE NOT passed),
sc AS (SELECT product, territory, bool_or(NOT limited) AS whole FROM lr WHERE decision = 'accepted' AND source_id NOT IN (SELECT source_id FROM bad) GROUP BY 1, 2),
rd AS (SELECT q.product, q.territory, CASE WHEN whole IS NULL THEN 'pending' WHEN whole THEN 'accepted_declared_scope' ELSE 'accepted_with_limitations' END AS status
  FROM (SELECT DISTINCT product, territory FROM sources) q LEFT JOIN sc ON sc.product = q.product AND sc.territory = q.territory)"""


def _readiness(spark, sf_dir):
    sources = shape(spark, sf_dir, "sources")
    reviews = shape(spark, sf_dir, "acceptances").join(sources.select("source_id", "product", "territory"), "source_id")
    failed = shape(spark, sf_dir, "regressions").where(~F.col("passed")).select("source_id")
    return coverage.release_readiness(sources.select("product", "territory").distinct(), reviews, failed)


@query(f"WITH {READY} SELECT product, territory, status FROM rd", "sources acceptances regressions")
def release_readiness(spark, sf_dir):
    """Readiness of each required scope."""
    return _readiness(spark, sf_dir)


@query(f"WITH {READY} SELECT CASE WHEN count(*) FILTER (WHERE status = 'pending') = count(*) THEN 'pending' WHEN count(*) FILTER (WHERE status = 'pending') > 0 THEN 'partial' ELSE 'ready' END AS overall, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) AS scopes FROM rd", "sources acceptances regressions")
def overall_readiness(spark, sf_dir):
    """Readiness as a whole."""
    return coverage.overall_readiness(_readiness(spark, sf_dir))


@query("""
WITH o AS (SELECT *, ((at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome')::DATE AS d, date_sub('second', coalesce(lag(at) OVER (PARTITION BY source_id ORDER BY at), TIMESTAMP '2024-01-02'), at) AS gap
  FROM checks WHERE at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-29'),
r AS (SELECT source_id, count(*) AS checks, count(*) FILTER (WHERE complete) AS complete, count(*) FILTER (WHERE NOT complete) AS failed, count(DISTINCT d) AS local_days,
  greatest(max(gap), date_sub('second', max(at), TIMESTAMP '2024-01-29')) AS max_gap_seconds FROM o GROUP BY 1)
SELECT *, concat_ws(',', CASE WHEN max_gap_seconds > 172800 THEN 'gap' END, CASE WHEN local_days < 25 THEN 'days' END, CASE WHEN complete = 0 THEN 'never_complete' END) AS issues FROM r""", "checks")
def observation_report(spark, sf_dir):
    """Observation of each source in a campaign."""
    return coverage.source_report(shape(spark, sf_dir, "checks"), at("2024-01-02"), at("2024-01-29"), 172800, 25)


@query("""
WITH l AS (SELECT n_regionkey AS region, CASE WHEN s_acctbal > 8000 THEN 'red' WHEN s_acctbal > 5000 THEN 'orange' WHEN s_acctbal > 1000 THEN 'yellow' ELSE 'green' END AS level FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT region, CASE min(list_position(['red', 'orange', 'yellow', 'green'], level)) WHEN 1 THEN 'red' WHEN 2 THEN 'orange' WHEN 3 THEN 'yellow' ELSE 'green' END AS level, count(DISTINCT level) > 1 AS partial_territory, count(*) AS zones FROM l GROUP BY region""")
def level_summary(spark, sf_dir):
    """The highest level of each region."""
    b = F.col("s_acctbal")
    level = F.when(b > 8000, "red").when(b > 5000, "orange").when(b > 1000, "yellow").otherwise("green")
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), level.alias("level"))
    return coverage.level_summary(rows, ["region"], ["red", "orange", "yellow", "green"])


@query("""
SELECT a.o_orderkey AS record_id, CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_custkey <> b.o_custkey THEN 'non_comparable' WHEN a.o_orderstatus <> b.o_orderstatus OR a.o_orderpriority <> b.o_orderpriority THEN 'conflict' ELSE 'corroborated' END AS state
FROM orders a LEFT JOIN (SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 0 ELSE o_custkey END AS o_custkey, o_orderstatus, CASE WHEN o_totalprice < 20000 THEN 'x' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderstatus <> 'P') b ON a.o_orderkey = b.o_orderkey""")
def verification_compare(spark, sf_dir):
    """Records of one channel against those of another (Q40, Q41)."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "record_id")
    other = orders.where("o_orderstatus <> 'P'").withColumns({
        "o_custkey": F.when(F.col("o_totalprice") > 400000, F.lit(0)).otherwise(F.col("o_custkey")),
        "o_orderpriority": F.when(F.col("o_totalprice") < 20000, "x").otherwise(F.col("o_orderpriority")),
    })
    return coverage.compared(orders, other, ["o_custkey"], ["o_orderstatus", "o_orderpriority"]).select("record_id", "state")


# ---- geography


@query("""
WITH m AS (SELECT c_nationkey::VARCHAR AS istat, c_name AS name, c_mktsegment AS province, c_acctbal > 0 AS supported FROM customer WHERE lower(c_name) = lower('customer#000000042'))
SELECT CASE WHEN count(*) = 0 THEN 'not_found' WHEN count(*) > 1 THEN 'ambiguous' WHEN NOT bool_and(supported) THEN 'unsupported_area' ELSE 'ok' END AS status, coalesce(string_agg(name, ','), '') AS names FROM m""")
def discover_municipality(spark, sf_dir):
    """One municipality by its name (Q01, Q02, Q05)."""
    rows = table(spark, sf_dir, "customer").selectExpr("'d1' AS dataset_id", "CAST(c_nationkey AS STRING) AS istat", "c_name AS name", "c_mktsegment AS province", "c_acctbal > 0 AS supported")
    log = spark.createDataFrame([("municipalities", "d1", "2024-01-01", 1), ("municipalities", "d2", "2024-03-01", 2)], "kind string, dataset_id string, selected_at string, id long")
    dataset = geo.dataset_at(log, "municipalities", F.lit("2024-02-01"))
    found = geo.discover(rows, dataset, name="CUSTOMER#000000042")
    return found.select("status", F.array_join("candidates.name", ",").alias("names"))


@query("SELECT s_nationkey::VARCHAR AS istat, string_agg('Z' || s_suppkey, ',' ORDER BY s_suppkey) AS zones, CASE WHEN bool_or(s_acctbal < 0) THEN 'partial' ELSE 'whole' END AS scope FROM supplier GROUP BY 1")
def attached_zones(spark, sf_dir):
    """Zones of municipalities by the registry they were made for."""
    mappings = table(spark, sf_dir, "supplier").selectExpr("'map1' AS dataset_id", "CAST(s_nationkey AS STRING) AS municipality_istat", "s_suppkey AS ordinal", "concat('Z', s_suppkey) AS zone", "CASE WHEN s_acctbal < 0 THEN 'partial' ELSE 'whole' END AS territorial_scope")
    municipalities = mappings.select(F.lit("reg1").alias("dataset_id"), F.col("municipality_istat").alias("istat")).distinct()
    datasets = spark.createDataFrame([("map1", "reg1")], "dataset_id string, parent_id string")
    return geo.with_zones(municipalities, mappings, datasets).select("istat", F.array_join("zones", ",").alias("zones"), "scope")


@query("SELECT DISTINCT n_nationkey::VARCHAR AS istat, n_name AS name, true AS requires_selection FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def lookup_postal(spark, sf_dir):
    """Municipalities of a postal code (Q03)."""
    postal = table(spark, sf_dir, "customer").selectExpr("'d' AS dataset_id", "c_mktsegment AS postal_code", "CAST(c_nationkey AS STRING) AS municipality_istat")
    municipalities = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS STRING) AS istat", "n_name AS name")
    return geo.lookup_postal(postal, municipalities, spark.createDataFrame([("d",)], "dataset_id string"), "BUILDING")


@query("""
WITH a AS (SELECT source_id, region, istat FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY recorded_at DESC, id DESC) AS n FROM associations) WHERE n = 1)
SELECT s.source_id, a.region IS NULL OR (a.region IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND a.istat IN ('F', 'P')) AS allowed FROM sources s LEFT JOIN a ON a.source_id = s.source_id""", "sources associations")
def source_allowed(spark, sf_dir):
    """Whether a source may run where it is associated now."""
    regions = spark.createDataFrame([("1-URGENT", True), ("2-HIGH", True), ("3-MEDIUM", True), ("5-LOW", False)], "region string, enabled boolean")
    places = spark.createDataFrame([("F", True), ("P", True), ("O", False)], "istat string, enabled boolean")
    return geo.source_allowed(shape(spark, sf_dir, "sources").select("source_id"), shape(spark, sf_dir, "associations"), regions, places)


@query("""
WITH h AS (SELECT version_id, source_id, acquired_at FROM versions)
SELECT e.id AS event_id, e.source_id, a.region, a.istat FROM regressions e LEFT JOIN LATERAL (
  SELECT region, istat FROM associations a WHERE a.source_id = e.source_id AND a.recorded_at <= e.at ORDER BY recorded_at DESC, id DESC LIMIT 1) a ON true""", "versions regressions associations")
def territorial_history(spark, sf_dir):
    """Events with the association their source had then."""
    events = shape(spark, sf_dir, "regressions").select(F.col("id").alias("event_id"), "source_id", "at")
    return reports.history_with_association(events, shape(spark, sf_dir, "associations")).select("event_id", "source_id", "region", "istat")


@query("""
WITH l AS (SELECT source_id, complete, at FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY at DESC, check_id DESC) AS n FROM checks) WHERE n = 1),
s AS (SELECT region, count(*) AS sources, count(*) FILTER (WHERE NOT complete) AS issues, max(at) AS last_result FROM sources LEFT JOIN l USING (source_id) GROUP BY 1),
m AS (SELECT n_regionkey AS region, count(*) AS municipalities, count(*) FILTER (WHERE n_nationkey > 5) AS enabled FROM nation GROUP BY 1)
SELECT r_regionkey AS region, coalesce(municipalities, 0) AS municipalities, coalesce(enabled, 0) AS enabled, coalesce(sources, 0) AS sources, coalesce(issues, 0) AS issues, last_result
FROM region LEFT JOIN m ON m.region = r_regionkey LEFT JOIN s ON s.region = r_regionkey""", "checks sources")
def territorial_overview(spark, sf_dir):
    """Regions with their municipalities, sources and last results."""
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"))
    places = table(spark, sf_dir, "nation").selectExpr("n_regionkey AS region", "n_nationkey > 5 AS enabled")
    return reports.territorial_overview(regions, places, shape(spark, sf_dir, "sources"), shape(spark, sf_dir, "checks"))


# ---- alerts, targets and regional facts


@query("""
SELECT measure_id, d.day FROM measures JOIN (VALUES ('today', TIMESTAMP '1997-05-05', TIMESTAMP '1997-05-06'), ('tomorrow', TIMESTAMP '1997-05-06', TIMESTAMP '1997-05-07')) d(day, lo, hi)
  ON valid_from < hi AND CASE WHEN precision = 'interval' THEN valid_until IS NULL OR valid_until > lo ELSE valid_from >= lo END WHERE precision <> 'unknown' AND valid_from IS NOT NULL
UNION ALL SELECT measure_id, 'undated' FROM measures WHERE precision = 'unknown' OR valid_from IS NULL""", "measures")
def two_day_alerts(spark, sf_dir):
    """Facts of today and tomorrow, and undated ones (Q31)."""
    return reports.two_days(shape(spark, sf_dir, "measures"), at("1997-05-05")).select("measure_id", "day")


@query("""
SELECT version_id, greatest(0, date_sub('second', acquired_at, TIMESTAMP '1998-06-30') // 86400)::BIGINT AS age_days, CASE WHEN status = 'P' THEN 'ceased' WHEN priority = '5-LOW' THEN 'none' WHEN interpreted THEN 'ongoing'
  WHEN date_sub('second', acquired_at, TIMESTAMP '1998-06-30') // 86400 >= 90 THEN 'aged_unresolved' ELSE 'unresolved' END AS state FROM versions WHERE acquired_at <= TIMESTAMP '1998-06-30'""", "versions")
def followed_targets(spark, sf_dir):
    """What became of followed targets."""
    rows = shape(spark, sf_dir, "versions").where(F.col("acquired_at") <= at("1998-06-30"))
    targets = rows.select("version_id", F.col("acquired_at").alias("first_seen"), (F.col("status") == "P").alias("withdrawn"), (F.col("priority") != "5-LOW").alias("relevant"), F.col("interpreted").alias("measured"))
    return reports.target_states(targets, at("1998-06-30"), 90).select("version_id", "age_days", "state")


@query(f"""
WITH f AS (SELECT measure_id AS record_id, extraction_id AS logic, version_id, source_id, state AS product, acquired_at, precision, valid_from, valid_until FROM measures WHERE recorded_at <= TIMESTAMP '{KNOWN}'),
v AS (SELECT source_id, product, version_id, row_number() OVER (PARTITION BY source_id, product ORDER BY acquired_at DESC, version_id DESC) AS n FROM (SELECT DISTINCT source_id, product, version_id, acquired_at FROM f))
SELECT record_id, CASE WHEN precision = 'date' THEN CASE WHEN ((({T}) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome')::DATE < valid_from::DATE THEN 'future' WHEN ((({T}) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome')::DATE > valid_from::DATE THEN 'expired' ELSE 'current' END
  ELSE {STATUS.format(t=T)} END AS status FROM f JOIN v USING (source_id, product, version_id) WHERE n = 1""", "measures")
def regional_facts(spark, sf_dir):
    """Regional facts of the newest version of each product (Q16, Q22)."""
    rows = shape(spark, sf_dir, "measures").withColumnsRenamed({"measure_id": "record_id", "extraction_id": "projection_logic", "state": "product"})
    return facts.regional(rows, at(KNOWN), at(EVALUATED)).select("record_id", "status")


@query("""
SELECT valid_from, valid_until, state AS product, precision AS risk, fingerprint AS level, string_agg(DISTINCT source_id::VARCHAR, ',' ORDER BY source_id::VARCHAR) AS zones, count(*) AS n FROM measures
WHERE state <> 'rejected' GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5"), "measures")
def warning_groups(spark, sf_dir):
    """Warnings of a daily report put together."""
    rows = shape(spark, sf_dir, "measures").select("valid_from", "valid_until", F.col("state").alias("product"), F.col("precision").alias("risk"), F.col("fingerprint").alias("level"), F.col("source_id").cast("string").alias("zone"), F.col("state").alias("status"))
    return reports.warning_groups(rows, ["rejected"])


# ---- values, projections and evidence by their owner's cutoff

_FROZEN = "(SELECT source_id, min(suspended_at) AS frozen FROM suspensions WHERE suspended_at <= TIMESTAMP '1997-01-01' AND (resumed_at IS NULL OR resumed_at > TIMESTAMP '1997-01-01') GROUP BY 1)"
_OWNED = """
SELECT measure_id % 1000 AS entity_id, CASE WHEN measure_id % 2 = 0 THEN 'local_measure' ELSE 'operational_phase' END AS entity_kind, CASE WHEN measure_id % 3 = 0 THEN 'issuance' ELSE 'validity' END AS meaning,
       recorded_at AS created_at, measure_id AS id, precision, valid_from, valid_until FROM measures"""


def _values(spark, sf_dir):
    return shape(spark, sf_dir, "measures").selectExpr(
        "measure_id % 1000 AS entity_id", "CASE WHEN measure_id % 2 = 0 THEN 'local_measure' ELSE 'operational_phase' END AS entity_kind", "CASE WHEN measure_id % 3 = 0 THEN 'issuance' ELSE 'validity' END AS meaning",
        "recorded_at AS created_at", "measure_id AS id", "precision", "valid_from", "valid_until",
    )


def _parents(spark):
    own = spark.range(1000).selectExpr("id AS entity_id", "id % 25 AS source_id")
    return {"local_measure": own, "operational_phase": own.selectExpr("entity_id", "(source_id + 7) % 25 AS source_id")}


@query(f"""
WITH v AS ({_OWNED}), o AS (SELECT v.*, CASE WHEN entity_kind = 'local_measure' THEN entity_id % 25 ELSE (entity_id % 25 + 7) % 25 END AS source_id FROM v WHERE meaning = 'validity'),
s AS (SELECT o.*, row_number() OVER (PARTITION BY entity_kind, entity_id ORDER BY created_at DESC, id DESC) AS n FROM o LEFT JOIN {_FROZEN} f USING (source_id) WHERE created_at <= least(TIMESTAMP '1997-01-01', frozen)),
e AS (SELECT DISTINCT entity_kind, entity_id FROM o)
SELECT e.entity_kind, e.entity_id, s.id, coalesce(s.precision, 'unknown') AS precision FROM e LEFT JOIN s ON s.entity_kind = e.entity_kind AND s.entity_id = e.entity_id AND s.n = 1""", "measures suspensions")
def temporal_values(spark, sf_dir):
    """The value last stated for each entity by the cutoff of the source that owns it; unknown without one (Q14)."""
    found = facts.owned_value(_values(spark, sf_dir), _parents(spark), shape(spark, sf_dir, "suspensions"), "validity", at("1997-01-01"))
    return found.select("entity_kind", "entity_id", "id", "precision")


_PROJECTED = "l_orderkey * 10 + l_linenumber AS record_id, 'operational_phase' AS entity_kind, l_suppkey AS source_id, l_orderkey % 500 AS logical_key, l_shipdate AS created_at, l_orderkey * 10 + l_linenumber AS id"
_CURRENT = f"""
p AS (SELECT {_PROJECTED} FROM lineitem WHERE l_linenumber < 4 AND l_shipdate <= TIMESTAMP '1997-01-01'),
l AS (SELECT DISTINCT record_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, logical_key ORDER BY created_at DESC, id DESC) AS n FROM p) WHERE n = 1)"""


def _projections(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_linenumber < 4").selectExpr(*_PROJECTED.split(", "))


@query(f"""
WITH {_CURRENT}
SELECT l_orderkey * 10 + l_linenumber AS record_id, NOT EXISTS (SELECT 1 FROM p WHERE p.record_id = l_orderkey * 10 + l_linenumber) OR EXISTS (SELECT 1 FROM l WHERE l.record_id = l_orderkey * 10 + l_linenumber) AS current FROM lineitem""")
def current_records(spark, sf_dir):
    """Whether records are what their logical key is projected to at a time; those never mapped are (Q28)."""
    records = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS record_id", "'operational_phase' AS entity_kind")
    return facts.is_current(records, _projections(spark, sf_dir), at("1997-01-01")).select("record_id", "current")


@query(f"""
WITH {_CURRENT},
c AS (SELECT m.*, measure_id AS record_id, least(TIMESTAMP '1997-01-01', frozen) AS cutoff FROM measures m LEFT JOIN {_FROZEN} f USING (source_id) WHERE acquired_at <= TIMESTAMP '1997-01-01'),
k AS (SELECT * FROM c WHERE recorded_at <= cutoff AND (record_id NOT IN (SELECT record_id FROM p) OR record_id IN (SELECT record_id FROM l))),
v AS ({_OWNED}), s AS (SELECT k.record_id, v.precision, v.valid_from, v.valid_until, row_number() OVER (PARTITION BY k.record_id ORDER BY v.created_at DESC, v.id DESC) AS n
  FROM k JOIN v ON v.entity_id = k.record_id AND v.entity_kind = 'operational_phase' AND v.meaning = 'validity' WHERE v.created_at <= k.cutoff),
d AS (SELECT source_id, max(suspended_at) AS last FROM suspensions WHERE suspended_at <= TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT k.record_id, coalesce(s.precision, 'unknown') AS precision, coalesce(d.last < k.recorded_at, true) AS reliable,
  CASE WHEN s.precision = 'interval' AND s.valid_from IS NOT NULL THEN CASE WHEN TIMESTAMP '1997-06-01' < s.valid_from THEN 'future' WHEN s.valid_until IS NOT NULL AND TIMESTAMP '1997-06-01' >= s.valid_until THEN 'expired' ELSE 'current' END
       WHEN s.precision = 'instant' AND s.valid_from IS NOT NULL AND TIMESTAMP '1997-06-01' < s.valid_from THEN 'future' ELSE 'undetermined' END AS status
FROM k LEFT JOIN s ON s.record_id = k.record_id AND s.n = 1 LEFT JOIN d ON d.source_id = k.source_id""", "measures suspensions")
def operational_phases(spark, sf_dir):
    """Phases current at a time of knowledge, with stated validity, status and reliability (Q21)."""
    rows = shape(spark, sf_dir, "measures").withColumn("record_id", F.col("measure_id")).drop("precision", "valid_from", "valid_until")
    found = facts.phases(rows, shape(spark, sf_dir, "suspensions"), _projections(spark, sf_dir), _values(spark, sf_dir), at("1997-01-01"), at("1997-06-01"))
    return found.select("record_id", "precision", "reliable", "status")


@query("""
WITH m AS (SELECT o_orderkey AS measure_id, o_custkey AS version_id, TIMESTAMP '1996-06-01' AS cutoff FROM orders),
p AS (SELECT l_orderkey AS measure_id, 1 AS part, l_linenumber::BIGINT AS place, 'https://x.example/' || l_suppkey AS url, l_returnflag AS locator, 'q' || l_partkey AS passage FROM lineitem WHERE l_discount > 0.06),
b AS (SELECT measure_id, 1, 0::BIGINT, 'https://x.example/v' || version_id, 'retained source document', NULL FROM m WHERE measure_id NOT IN (SELECT measure_id FROM p) AND version_id IN (SELECT c_custkey FROM customer)),
a AS (SELECT l_orderkey, 2, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, 'a' || l_partkey), CASE WHEN l_tax > 0.04 THEN 'https://albo.example/' || l_linenumber ELSE 'https://act.example/' || l_linenumber END,
  'referenced_act:' || l_linestatus || CASE WHEN l_quantity > 25 THEN ' ' || l_partkey || '/' || year(l_shipdate) ELSE '' END, 'a' || l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate <= TIMESTAMP '1996-06-01')
SELECT measure_id, (row_number() OVER (PARTITION BY measure_id ORDER BY part, place, passage NULLS FIRST, url))::INTEGER AS ordinal, url, locator, passage FROM (SELECT p.* FROM p WHERE measure_id IN (SELECT measure_id FROM m) UNION ALL SELECT * FROM b UNION ALL SELECT a.* FROM a WHERE l_orderkey IN (SELECT measure_id FROM m))""")
def measure_evidence(spark, sf_dir):
    """What each measure rests on: passages or its document, then the acts that clarified it (Q34)."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    measures = orders.select(F.col("o_orderkey").alias("measure_id"), F.col("o_custkey").alias("version_id"), at("1996-06-01").alias("cutoff"))
    passages = lines.where("l_discount > 0.06").selectExpr("l_orderkey AS measure_id", "l_linenumber AS ordinal", "'https://x.example/' || l_suppkey AS url", "l_returnflag AS locator", "'q' || l_partkey AS passage")
    acts = lines.selectExpr(
        "l_orderkey AS measure_id", "l_linenumber AS id", "l_shipdate AS recorded_at", "CASE WHEN l_returnflag = 'R' THEN 'clarified' ELSE 'conflict' END AS outcome", "l_linestatus AS kind", "'a' || l_partkey AS passage",
        "CASE WHEN l_quantity > 25 THEN CAST(l_partkey AS STRING) END AS act_number", "CASE WHEN l_quantity > 25 THEN CAST(year(l_shipdate) AS STRING) END AS act_year",
        "CASE WHEN l_tax > 0.04 THEN 'https://albo.example/' || l_linenumber END AS detail_url", "'https://act.example/' || l_linenumber AS resource_url",
    )
    versions = table(spark, sf_dir, "customer").selectExpr("c_custkey AS version_id", "'https://x.example/v' || c_custkey AS url")
    return facts.evidence(measures, passages, acts, versions).select("measure_id", "ordinal", "url", "locator", "passage")


@query("""
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY acquired_at DESC, version_id DESC) AS n FROM versions WHERE acquired_at <= TIMESTAMP '1996-01-01') WHERE n = 1),
c AS (SELECT source_id, count(*) FILTER (WHERE status = 'F') AS supported, count(*) FILTER (WHERE status <> 'F') AS incomplete FROM l GROUP BY 1)
SELECT s AS source_id, coalesce(supported, 0) AS supported, coalesce(incomplete, 0) AS incomplete, CASE WHEN incomplete > 0 THEN 'partial' WHEN supported > 0 THEN 'supported' ELSE 'not_processed' END AS state FROM range(30) AS r(s) LEFT JOIN c ON c.source_id = s""", "versions")
def municipal_summary(spark, sf_dir):
    """Interpretation state of each source by the latest versions of its documents."""
    from annalist.operators import governance

    versions = shape(spark, sf_dir, "versions").withColumn("state", F.when(F.col("status") == "F", "supported").otherwise("pending"))
    return governance.municipal_summary(versions, spark.range(30).toDF("source_id"), at("1996-01-01"))


_MUNICIPALITY = "c_custkey AS istat, c_nationkey AS region_code, 'd' || c_custkey % 3 AS dataset_id"
_PUBLISHED = """
SELECT c_nationkey AS region_code, c_custkey AS istat FROM customer
WHERE c_acctbal > 0 AND c_mktsegment <> 'FURNITURE' AND c_custkey % 3 = c_nationkey % 3"""


def _published(spark, sf_dir):
    from annalist.operators import governance

    rows = table(spark, sf_dir, "customer")
    publication = rows.selectExpr("c_nationkey AS region_code", "c_custkey AS istat", "c_acctbal > 0 AS enabled")
    regions = spark.range(25).selectExpr("id AS region_code", "explode(array(0, 1, 2)) AS k").selectExpr("region_code", "'d' || k AS dataset_id", "k = region_code % 3 AS is_current")
    municipalities = rows.selectExpr(*_MUNICIPALITY.split(", "))
    geography = rows.selectExpr("'d' || c_custkey % 3 AS dataset_id", "c_custkey AS istat", "c_mktsegment <> 'FURNITURE' AS supported")
    return governance.published_municipalities(publication, regions, municipalities, geography)


@query(_PUBLISHED)
def published_municipalities(spark, sf_dir):
    """Enabled municipalities that the current data set of their region has and supports."""
    return _published(spark, sf_dir).select("region_code", "istat")


_CONFIGURATION = """
'{"policy": {"publication_permitted": ' || CASE WHEN s_suppkey % 5 = 0 THEN 'false' ELSE 'true' END || '}, "processing_profile": "' || CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'municipal-html' END || '"'
|| CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE ', "provenance": {"by": "hand"}' END || ', "unresolved": ' || CASE WHEN s_suppkey % 13 = 0 THEN '["x"]' ELSE '[]' END || '}'"""


@query(f"""
WITH m AS ({_PUBLISHED})
SELECT s_suppkey AS source_id FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0
  AND ((s_suppkey % 4 = 1 AND s_suppkey % 7 = 0 AND s_nationkey IN (SELECT region_code FROM m))
    OR (s_suppkey % 4 <> 1 AND EXISTS (SELECT 1 FROM m WHERE m.region_code = s_nationkey AND m.istat = s_suppkey)))""")
def development_sources(spark, sf_dir):
    """Sources to be shown while a region is in development."""
    from annalist.operators import governance

    regional = F.expr("s_suppkey % 4 = 1")
    sources = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("source_id"), F.when(regional, "criticality").otherwise("municipal").alias("product"), F.when(~regional, F.col("s_suppkey")).alias("istat"), F.col("s_suppkey").alias("territory"),
        F.col("s_nationkey").alias("region_code"), F.when(regional, "regional-html").otherwise("municipal-html").alias("profile"), F.expr(_CONFIGURATION).alias("configuration"),
    )
    return governance.development_visible(sources, _published(spark, sf_dir), "configuration", {"municipal": "municipal-html", "criticality": "regional-html"}, ["criticality"]).select("source_id")
