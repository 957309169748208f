"""References between acts, clarification, and merging of measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import acts
from annalist.operators.shared import dealt
from annalist.plans.base import at, query, shape, table

#: Acts, references to them and clauses, as columns that mean the same in Spark and in DuckDB.
REFERENCES = "l_orderkey AS version_id, l_linenumber AS reference_id, l_returnflag AS kind, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_partkey % 50 END AS number, year(l_shipdate) AS year"
ATTACHED = "l_orderkey AS version_id, l_orderkey * 10 + l_linenumber AS act_id, l_returnflag AS kind, l_partkey % 50 AS number, year(l_shipdate) AS year"
REGISTER = "p_partkey AS act_id, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'X' END AS kind, p_partkey % 50 AS number, 1990 + p_partkey % 12 AS year"
CLAUSES = "l_orderkey AS act_id, l_returnflag AS kind, l_linestatus AS subject, CAST(year(l_shipdate) AS BIGINT) AS clause_start, CASE WHEN l_tax > 0.04 THEN CAST(year(l_shipdate) AS BIGINT) + 1 END AS clause_end"
OPEN = "l_orderkey AS measure_id, l_orderkey AS act_id, l_returnflag AS kind, l_linestatus AS subject, CAST(year(l_shipdate) AS BIGINT) AS start"
FOUND = "l_orderkey AS version_id, l_returnflag AS kind, CASE WHEN l_tax > 0.04 THEN 'Road ' || l_linestatus ELSE 'ROAD ' || l_linestatus END AS subject, CASE WHEN l_discount > 0.05 THEN 'p' || l_linestatus END AS place, 'q' || l_linenumber AS evidence"
CANDIDATES = "l_orderkey AS measure_id, CAST(year(l_shipdate) AS BIGINT) AS start, CASE WHEN l_tax > 0.02 THEN CAST(year(l_shipdate) AS BIGINT) + CAST(l_quantity AS BIGINT) % 3 END AS \"end\""
OUTPUTS = """event_id, event_type AS queue, props AS source, CASE WHEN event_id % 7 = 0 THEN 'x{' ELSE '{"kind": "' || event_type || '", "quote": "' || CASE WHEN event_id % 5 = 0 THEN 'none' ELSE 'k' END || '"}' END AS raw"""


def _select(df, columns: str):
    return df.selectExpr(*[c.strip().replace('"end"', "`end`") for c in _split(columns)])


def _split(columns: str) -> list[str]:
    """The columns of a list, apart at commas outside brackets and quotes."""
    out, depth, quoted, begin = [], 0, False, 0
    for i, c in enumerate(columns):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not quoted and not depth:
            out.append(columns[begin:i])
            begin = i + 1
    return [*out, columns[begin:]]


@query(f"""
WITH r AS (SELECT {REFERENCES} FROM lineitem), o AS (SELECT version_id, kind, number, year, min(act_id) AS own FROM (SELECT {ATTACHED} FROM lineitem WHERE l_linenumber = 1) GROUP BY ALL),
g AS (SELECT {REGISTER} FROM part), n AS (SELECT kind, number, year, count(*) AS n, min(act_id) AS numbered FROM g GROUP BY ALL), y AS (SELECT kind, year, count(*) AS m, min(act_id) AS only_one FROM g GROUP BY ALL),
s AS (SELECT r.*, own, numbered, only_one, CASE WHEN own IS NOT NULL THEN 'attached' WHEN r.kind = 'R' THEN 'unavailable' WHEN r.number IS NOT NULL THEN CASE WHEN n = 1 THEN 'numbered' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END
  WHEN m = 1 THEN 'unique_candidate' WHEN m > 1 THEN 'ambiguous' ELSE 'not_found' END AS method
  FROM r LEFT JOIN o ON o.version_id = r.version_id AND o.kind = r.kind AND o.number = r.number AND o.year = r.year LEFT JOIN n ON n.kind = r.kind AND n.number = r.number AND n.year = r.year LEFT JOIN y ON y.kind = r.kind AND y.year = r.year)
SELECT version_id, reference_id, method, CASE method WHEN 'attached' THEN own WHEN 'numbered' THEN numbered WHEN 'unique_candidate' THEN only_one END AS act_id FROM s""")
def reference_resolution(spark, sf_dir):
    """References to acts resolved by attachment, number or as the only candidate."""
    lines = table(spark, sf_dir, "lineitem")
    readable = spark.createDataFrame([("A",), ("N",)], "kind string")
    found = acts.resolved(_select(lines, REFERENCES), _select(lines.where("l_linenumber = 1"), ATTACHED), _select(table(spark, sf_dir, "part"), REGISTER), readable)
    return found.select("version_id", "reference_id", "method", "act_id")


@query(f"""
WITH m AS (SELECT {OPEN} FROM lineitem WHERE l_linenumber = 1), c AS (SELECT act_id, kind, subject, count(DISTINCT clause_end) AS ends, min(clause_start) AS a, max(clause_start) AS b, max(clause_end) AS e
  FROM (SELECT {CLAUSES} FROM lineitem WHERE l_linenumber > 1) GROUP BY ALL),
s AS (SELECT m.measure_id, e, CASE WHEN a IS NULL THEN 'not_matched' WHEN ends > 1 OR a <> b OR a <> m.start THEN 'conflict' ELSE 'clarified' END AS state FROM m LEFT JOIN c ON c.act_id = m.act_id AND c.kind = m.kind AND c.subject = m.subject)
SELECT measure_id, state, CASE WHEN state = 'clarified' THEN e END AS "end" FROM s""")
def clarification(spark, sf_dir):
    """Measures clarified by clauses of the act they refer to."""
    lines = table(spark, sf_dir, "lineitem")
    return acts.clarified(_select(lines.where("l_linenumber = 1"), OPEN), _select(lines.where("l_linenumber > 1"), CLAUSES)).select("measure_id", "state", "end")


@query(f"""
WITH f AS (SELECT version_id, kind, lower(subject) AS subject, place, evidence FROM (SELECT {FOUND} FROM lineitem)), c AS (SELECT version_id, kind, subject, bool_or(place IS NULL) AND bool_or(place IS NOT NULL) AS conflict FROM f GROUP BY 1, 2, 3)
SELECT f.version_id, f.kind, f.subject, place, string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS evidence, count(*) AS n, any_value(conflict) AS conflict
FROM f JOIN c ON c.version_id = f.version_id AND c.kind = f.kind AND c.subject = f.subject GROUP BY 1, 2, 3, 4""")
def merged_measures(spark, sf_dir):
    """Measures of several windows put together."""
    found = acts.merged(_select(table(spark, sf_dir, "lineitem"), FOUND), ["version_id"])
    return found.withColumn("evidence", F.array_join("evidence", ","))


@query(f"""
WITH c AS (SELECT *, concat_ws('/', start::VARCHAR, coalesce("end"::VARCHAR, '')) AS shown FROM (SELECT {CANDIDATES} FROM lineitem)),
g AS (SELECT measure_id, count(DISTINCT shown) AS n, count(DISTINCT start) AS starts, min(start) AS start, min("end") AS e, string_agg(DISTINCT shown, ';' ORDER BY shown) AS listed FROM c GROUP BY 1),
s AS (SELECT *, CASE WHEN n = 1 THEN 'resolved' WHEN starts = 1 THEN 'shortest' ELSE 'conflict' END AS state FROM g)
SELECT measure_id, state, CASE WHEN state <> 'conflict' THEN start END AS start, CASE WHEN state <> 'conflict' THEN e END AS "end", CASE WHEN state = 'conflict' THEN left(sha256(listed), 24) END AS conflict_id FROM s""")
def temporal_choice(spark, sf_dir):
    """The validity of a measure from its candidates."""
    return acts.temporal_choice(_select(table(spark, sf_dir, "lineitem"), CANDIDATES), ["measure_id"])


REASON = "CASE WHEN event_id % 7 = 0 THEN 'invalid_json' WHEN queue NOT IN ('view', 'purchase', 'click') THEN 'unknown_kind' WHEN NOT contains(source, CASE WHEN event_id % 5 = 0 THEN 'none' ELSE 'k' END) THEN 'quote_missing' END"


def _envelopes(spark, sf_dir):
    return acts.envelopes(_select(table(spark, sf_dir, "events"), OUTPUTS), "raw", "kind string, quote string", ["view", "purchase", "click"], "source")


@query(f"SELECT event_id, {REASON} AS reason FROM (SELECT {OUTPUTS} FROM events)")
def output_validation(spark, sf_dir):
    """Outputs of models checked for shape and literal evidence."""
    return _envelopes(spark, sf_dir).select("event_id", "reason")


@query(f"SELECT queue, coalesce({REASON}, 'ok') AS reason, count(*) AS n FROM (SELECT {OUTPUTS} FROM events) GROUP BY ALL")
def output_audit(spark, sf_dir):
    """Kept outputs by what is wrong with them."""
    return _envelopes(spark, sf_dir).groupBy("queue", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


LEXICON = {"en": "the|and", "fr": "le|la", "de": "der|die"}


@query("SELECT doc_id, coalesce(CASE lang WHEN 'en' THEN regexp_matches(lower(text), 'the|and') WHEN 'fr' THEN regexp_matches(lower(text), 'le|la') WHEN 'de' THEN regexp_matches(lower(text), 'der|die') ELSE false END, false) AS supported FROM documents")
def evidence_lexicon(spark, sf_dir):
    """Whether evidence holds a word that stands for its kind."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(acts.supported_kind(F.col("lang"), F.col("text"), LEXICON), F.lit(False)).alias("supported"))


@query("""
SELECT version_id, reference_id, id FROM (SELECT *, row_number() OVER (PARTITION BY version_id, reference_id ORDER BY recorded_at DESC, id DESC) AS n FROM (
  SELECT l_orderkey AS version_id, l_linenumber % 2 AS reference_id, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS recorded_at FROM lineitem) WHERE recorded_at <= TIMESTAMP '1997-01-01') WHERE n = 1""")
def act_reference_view(spark, sf_dir):
    """The last resolution of each reference at a time of knowledge."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS version_id", "l_linenumber % 2 AS reference_id", "l_orderkey * 10 + l_linenumber AS id", "l_shipdate AS recorded_at")
    return acts.latest_resolutions(rows, at("1997-01-01")).select("version_id", "reference_id", "id")


@query("""
WITH b AS (SELECT l_orderkey AS run, l_linenumber AS ordinal, l_orderkey * 10 + l_linenumber AS measure_id, l_discount, l_tax, l_returnflag FROM lineitem)
SELECT DISTINCT u.run AS linking_run_id, u.measure_id AS update_id, t.measure_id AS target_id, u.l_returnflag AS relation FROM b u JOIN b t ON t.run = u.run AND t.ordinal = 1 WHERE u.ordinal > 1 AND u.l_discount >= 0.07
  AND NOT EXISTS (SELECT 1 FROM b e WHERE e.measure_id = u.measure_id AND e.ordinal > 1 AND e.l_discount >= 0.07 AND e.l_tax > 0.04)""")
def applied_updates(spark, sf_dir):
    """Edges for linked runs that are not there yet (Q42)."""
    from annalist.operators import facts

    rows = table(spark, sf_dir, "lineitem")
    bindings = rows.selectExpr("l_orderkey AS extraction_run_id", "l_linenumber AS extraction_ordinal", "l_orderkey * 10 + l_linenumber AS measure_id")
    linked = rows.where("l_linenumber > 1 AND l_discount >= 0.07")
    links = linked.selectExpr("l_orderkey AS linking_run_id", "l_orderkey AS update_run", "l_linenumber AS update_ordinal", "l_orderkey AS target_run", "1 AS target_ordinal", "l_returnflag AS relation")
    there = linked.where("l_tax > 0.04").selectExpr("l_orderkey AS linking_run_id", "l_orderkey * 10 + l_linenumber AS update_id", "l_orderkey * 10 + 1 AS target_id")
    return facts.apply_linked(links, bindings, there, at("1998-01-01")).select("linking_run_id", "update_id", "target_id", "relation")


@query("SELECT measure_id, coalesce(s.last < recorded_at, true) AS reliable FROM measures LEFT JOIN (SELECT source_id, max(suspended_at) AS last FROM suspensions GROUP BY 1) s ON s.source_id = measures.source_id", "measures suspensions")
def defect_warnings(spark, sf_dir):
    """Measures interpreted before their source was suspended are not reliable (Q25, Q26)."""
    from annalist.operators import governance

    return governance.defect_warnings(shape(spark, sf_dir, "measures"), shape(spark, sf_dir, "suspensions")).select("measure_id", "reliable")


#: Notices, their references and a register, made from orders and line items.
_REF = """
l_orderkey AS version_id, l_linenumber AS reference_id, CASE l_returnflag WHEN 'R' THEN 'ordinanza' WHEN 'A' THEN 'decreto' ELSE 'delibera' END AS kind, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_partkey % 40 END AS number,
CASE WHEN l_tax > 0.02 THEN year(l_shipdate) END AS year, CASE WHEN l_linestatus = 'F' AND l_discount > 0.05 THEN CAST(l_shipdate AS DATE) END AS day"""
_NOTICE = "o_orderkey AS version_id, o_custkey % 10 AS source_id, CASE WHEN o_totalprice > 20000 THEN CAST(o_orderdate AS DATE) END AS published, CASE WHEN o_orderpriority = '1-URGENT' THEN '' WHEN o_orderpriority = '2-HIGH' THEN 'Chiusura ponte' ELSE 'Divieto ponte' END AS subject"
_RECORDED = """
l_orderkey * 10 + l_linenumber AS act_id, l_suppkey % 10 AS source_id, CASE WHEN l_linenumber % 2 = 0 THEN 'ordinanze' ELSE 'decreti' END AS category, l_partkey % 40 AS number, year(l_shipdate) AS year,
CAST(l_shipdate AS DATE) AS published, CASE WHEN l_quantity > 25 THEN 'Chiusura della scuola' ELSE 'Limitazioni al traffico' END AS object, CASE WHEN l_discount > 0.02 THEN CAST(l_shipdate AS DATE) END AS act_date"""
_ATTACHED = "l_orderkey AS version_id, 'u' || l_linenumber AS url, 'Comune. ' || CASE WHEN l_linenumber % 2 = 0 THEN 'ORDINANZA N. ' ELSE 'Decreto nr. 0' END || l_partkey % 40 || ' / ' || year(l_shipdate) || ' testo' AS text"


UNREAD = [(3, "1995-01-01", "1995-03-01", "page_not_recognized"), (3, "1995-02-10", "1996-02-01", "page_bound_exceeded"), (5, "1997-06-01", "1997-06-30", "page_bound_exceeded"), (6, "1993-01-01", "1993-01-01", "register_unavailable")]
_UNREAD = ", ".join(f"({s}, DATE '{a}', DATE '{b}', '{r}')" for s, a, b, r in UNREAD)


@query(f"""
WITH unread(source_id, since, until, reason) AS (VALUES {_UNREAD}), r AS (SELECT {_REF} FROM lineitem), n AS (SELECT *, CASE WHEN subject = 'Chiusura ponte' THEN ['chiusu', 'ponte'] WHEN subject = 'Divieto ponte' THEN ['diviet', 'ponte'] ELSE [] END AS terms FROM (SELECT {_NOTICE} FROM orders)),
g AS (SELECT *, CASE WHEN object = 'Chiusura della scuola' THEN ['chiusu', 'scuola'] ELSE ['limita', 'traffi'] END AS words FROM (SELECT {_RECORDED} FROM lineitem)),
t AS (SELECT l_orderkey AS version_id, 'u' || l_linenumber AS url, CASE WHEN l_linenumber % 2 = 0 THEN 'ordinanza' ELSE 'decreto' END AS kind, l_partkey % 40 AS number, year(l_shipdate) AS year FROM lineitem WHERE l_discount > 0.08),
c AS (SELECT s AS source_id, k AS kind, v AS category FROM range(8) AS x(s), (VALUES ('ordinanza', 'ordinanze'), ('decreto', 'decreti')) AS y(k, v)),
o AS (SELECT r.version_id, r.reference_id, count(DISTINCT url) AS m, min(url) AS url FROM r JOIN t ON t.version_id = r.version_id AND t.kind = r.kind AND (r.number IS NULL OR (r.number = t.number AND (r.year IS NULL OR r.year = t.year))) GROUP BY 1, 2),
a AS (SELECT r.*, n.source_id, n.published, n.terms, o.url, c.category FROM r LEFT JOIN o ON o.version_id = r.version_id AND o.reference_id = r.reference_id AND o.m = 1 LEFT JOIN n ON n.version_id = r.version_id LEFT JOIN c ON c.source_id = n.source_id AND c.kind = r.kind),
f AS (SELECT a.version_id, a.reference_id, count(*) AS found, count(*) FILTER (WHERE a.number IS NOT NULL OR g.act_date BETWEEN a.published - 7 AND a.published) AS accepted, min(CASE WHEN a.number IS NOT NULL OR g.act_date BETWEEN a.published - 7 AND a.published THEN g.act_id END) AS act_id
  FROM a JOIN g ON g.source_id = a.source_id AND g.category = a.category
  WHERE a.url IS NULL AND CASE WHEN a.number IS NOT NULL THEN g.number = a.number AND (a.year IS NULL OR g.year = a.year) AND g.published BETWEEN coalesce(a.day, a.published - 30) AND coalesce(a.day + 10, a.published)
    ELSE list_has_any(a.terms, g.words) AND g.published BETWEEN a.published - 7 AND a.published + 10 END GROUP BY 1, 2),
z AS (SELECT a.*, coalesce(found, 0) AS found, coalesce(accepted, 0) AS accepted, act_id FROM a LEFT JOIN f ON f.version_id = a.version_id AND f.reference_id = a.reference_id),
w AS (SELECT *, CASE WHEN number IS NULL THEN published - 7 ELSE coalesce(day, published - 30) END AS low, CASE WHEN number IS NULL THEN published + 10 ELSE coalesce(day + 10, published) END AS high FROM z),
x AS (SELECT w.*, (SELECT min(u.reason) FROM unread u WHERE u.source_id = w.source_id AND u.since <= w.high AND u.until >= w.low AND w.url IS NULL AND w.category IS NOT NULL) AS own FROM w),
v AS (SELECT *, min(own) OVER (PARTITION BY version_id, reference_id) AS unread FROM x),
q AS (SELECT *, CASE WHEN url IS NOT NULL THEN NULL WHEN source_id IS NULL OR source_id >= 8 THEN 'no_configured_register' WHEN category IS NULL THEN 'kind_not_published' WHEN number IS NOT NULL AND day IS NULL AND published IS NULL THEN 'no_date_to_bound_the_search'
  WHEN number IS NULL AND published IS NULL THEN 'publication_date_unknown' WHEN number IS NULL AND len(terms) = 0 THEN 'no_terms' WHEN unread IS NOT NULL THEN unread WHEN found = 0 THEN 'no_matching_record' WHEN found > 3 THEN 'too_many_matching_records'
  WHEN accepted = 0 THEN 'no_record_in_act_date_window' WHEN accepted > 1 THEN 'several_matching_records' END AS reason FROM v)
SELECT version_id, reference_id, CASE WHEN url IS NOT NULL THEN 'attached' WHEN reason = unread THEN 'unavailable' WHEN reason IN ('too_many_matching_records', 'several_matching_records') THEN 'ambiguous' WHEN reason IS NOT NULL THEN 'not_found' WHEN number IS NOT NULL THEN 'numbered' ELSE 'unique_candidate' END AS outcome,
  reason, url, CASE WHEN url IS NULL AND reason IS NULL THEN act_id END AS act_id FROM q""")
def register_search(spark, sf_dir):
    """References resolved by attachment, by number in a window of days, or as the only act that fits; unavailable where the register could not be read."""
    from annalist.functions import text

    lines = table(spark, sf_dir, "lineitem")
    notices = _select(table(spark, sf_dir, "orders"), _NOTICE).withColumn("terms", text.stems(F.col("subject"))).drop("subject")
    kinds = spark.createDataFrame([("ordinanza", "ordinanze"), ("decreto", "decreti")], "kind string, category string")
    categories = spark.range(8).toDF("source_id").crossJoin(F.broadcast(kinds))  # eight registers of two kinds
    unread = spark.createDataFrame(UNREAD, "source_id long, since string, until string, reason string").select("source_id", F.col("since").cast("date").alias("since"), F.col("until").cast("date").alias("until"), "reason")
    return acts.searched(_select(lines, _REF), _select(dealt(lines.where("l_discount > 0.08")), _ATTACHED), notices, _select(lines, _RECORDED), categories, unread)


_PARTS = "[{'ordinal': 1, 'kind': 'closure', 'text': 'la chiusura dei parchi'}, {'ordinal': 2, 'kind': 'closure', 'text': 'la chiusura della scuola Verdi'}, {'ordinal': 3, 'kind': 'prohibition', 'text': 'il divieto di sosta'}]"
_ASKED = """
o_orderkey AS measure_id, o_custkey AS act_id, CASE WHEN o_orderkey % 5 = 0 THEN 'prohibition' ELSE 'closure' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'delle scuole Verdi' WHEN 1 THEN 'Parchi pubblici' WHEN 2 THEN 'sosta' ELSE 'chiusura' END AS subject,
CASE WHEN o_orderstatus = 'F' THEN 'interval' ELSE 'unknown' END AS precision, year(o_orderdate) AS start"""


@query(f"""
WITH m AS (SELECT *, CASE WHEN kind = 'prohibition' THEN CASE WHEN subject = 'sosta' THEN 3 END WHEN subject = 'Parchi pubblici' THEN 1 END AS ordinal FROM (SELECT {_ASKED} FROM orders)),
c AS (SELECT c_custkey AS act_id, 1990 + c_custkey % 10 AS clause_start, CASE WHEN c_acctbal > 0 THEN 2000 END AS clause_end, CASE WHEN c_acctbal <= 0 THEN 'fino a revoca' END AS condition FROM customer WHERE c_custkey % 3 <> 0),
s AS (SELECT m.measure_id, CASE WHEN c.act_id IS NULL THEN NULL ELSE ordinal END AS disposition, precision, start, clause_start, clause_end, condition FROM m LEFT JOIN c USING (act_id)),
o AS (SELECT *, CASE WHEN disposition IS NULL THEN 'not_matched' WHEN precision <> 'unknown' AND start = clause_start THEN 'kept' WHEN precision <> 'unknown' THEN 'conflict' ELSE 'clarified' END AS outcome FROM s)
SELECT measure_id, outcome, disposition, CASE WHEN outcome = 'clarified' THEN clause_start END AS start, CASE WHEN outcome = 'clarified' THEN clause_end END AS "end", CASE WHEN outcome = 'clarified' THEN condition END AS condition FROM o""")
def matched_dispositions(spark, sf_dir):
    """Measures against the dispositions of an act, by kind and head term."""
    parts = F.from_json(F.lit(_PARTS.replace("'", '"')), "array<struct<ordinal:int,kind:string,text:string>>")
    clauses = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey AS act_id", "1990 + c_custkey % 10 AS clause_start", "CASE WHEN c_acctbal > 0 THEN 2000 END AS clause_end", "CASE WHEN c_acctbal <= 0 THEN 'fino a revoca' END AS condition")
    return acts.matched_dispositions(_select(table(spark, sf_dir, "orders"), _ASKED), clauses.withColumn("dispositions", parts))
