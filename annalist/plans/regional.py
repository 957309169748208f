"""Regional bulletins and expressions of time. The pages are made from customers and orders, each in one of several shapes, some of which must be refused."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import italian, text
from annalist.operators import regional
from annalist.plans.base import dealt_table, query, table

#: A day of 2026 from a key and a month, the hours that Rome is ahead on it, and how a bulletin writes it. The same in Spark and in DuckDB.
_DAY = "(c_custkey % 27 + 1)"
_MONTH = "CASE WHEN c_custkey % 2 = 0 THEN 'aprile' ELSE 'Gennaio' END"
_M = "CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 1 END"
_AHEAD = "CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END"
_WRITTEN = f"'Lunedì, ' || {_DAY} || ' ' || {_MONTH} || ' 2026'"
_NEXT = f"'Martedì, ' || ({_DAY} + 1) || ' ' || {_MONTH} || ' 2026'"
_ZONES = "A1 A2 A3 A4 A5 A6 B C E1 E2 E3 F1 F2 I L M O1 O2 O3 R1 R2 S1 S2 S3 T V".split()
_HEAD = f"'<html><script>var zone = 1;</script><body><p>Emissione di ' || {_WRITTEN} || ', ore 10.30</p>'"
_TABLE = "'<table><tr><th>Zone</th><th>Rischio</th><th>Validità</th><th>Criticità</th></tr>'"
_WIND = f"'<tr><td>B, A1 e A1</td><td>Rischio Vento</td><td>dalle ore 12.00  alle ore 23:59 di ' || {_WRITTEN} || '</td><td> Giallo </td></tr>'"
_STORM = f"'<tr><td>E3</td><td>TEMPORALI FORTI</td><td>in corso fino alle ore 20.15 di ' || {_WRITTEN} || '</td><td>rosso</td></tr>'"
_NONE = "'<p>Criticità previste: NESSUNA</p><ul>" + "".join(f"<li>{x}</li>" for x in regional.RISK_LABELS) + f"</ul><p>' || {_WRITTEN} || '</p><p>' || {_NEXT} || '</p>'"
_KEY = lambda zones: f"'<p>AREE INTERESSATE: {' '.join(zones)} Legenda criticità: T</p>'"
_PAGES = [
    (f"{_HEAD} || {_TABLE} || {_WIND} || {_STORM} || '</table>'", "NULL"),
    (f"{_HEAD} || {_TABLE} || {_WIND} || replace({_STORM}, 'rosso', 'viola') || '</table>'", "'unsupported_row'"),
    (f"{_HEAD} || {_TABLE} || {_WIND} || '<tr><td>B</td><td>neve</td><td>rosso</td></tr></table>'", "'row_shape'"),
    (f"replace({_HEAD}, 'Emissione', 'Ristampa') || {_TABLE} || {_WIND} || '</table>'", "'no_issuance'"),
    (f"{_HEAD} || {_NONE} || {_KEY(_ZONES)}", "NULL"),
    (f"{_HEAD} || {_TABLE} || {_WIND} || '</table>' || {_NONE} || {_KEY(_ZONES)}", "'conflict'"),
    (f"{_HEAD} || {_NONE} || {_KEY(_ZONES[:-1])}", "'zone_scope'"),
    (f"{_HEAD} || {_TABLE} || replace({_WIND}, '12.00', '23.59') || '</table>'", "'unsupported_row'"),
    (f"{_HEAD} || '<table><tr><td>Zone</td><td>Rischio</td></tr></table>'", "'no_supported_rows'"),
]
_KINDS = len(_PAGES)


def _shape(i: int) -> str:
    return f"CASE c_custkey % {_KINDS} " + " ".join(f"WHEN {n} THEN {x[i]}" for n, x in enumerate(_PAGES)) + " END"


def _customers(spark, sf_dir, html: str):
    return dealt_table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{html} AS html")


@query(f"""
SELECT c_custkey, {_shape(1)} AS refused, CASE WHEN c_custkey % {_KINDS} = 4 THEN 'Criticità previste: NESSUNA' END AS statement, CASE c_custkey % {_KINDS} WHEN 0 THEN 3 WHEN 4 THEN 364 ELSE 0 END AS facts FROM customer""")
def regional_criticality(spark, sf_dir):
    """Criticality bulletins understood as a whole or refused."""
    return regional.criticality(_customers(spark, sf_dir, _shape(0))).select("c_custkey", "refused", "statement", F.size("facts").alias("facts"))


_TIME = lambda h, m: f"make_timestamp(2026, {_M}, {_DAY}, {h}, {m}, 0) - INTERVAL ({_AHEAD}) HOUR"
_VALUES = ", ".join(f"('{label}', '{name}')" for label, name in regional.RISK_LABELS.items())
_ZONE_VALUES = ", ".join(f"('{z}')" for z in _ZONES)


@query(f"""
WITH a AS (SELECT * FROM customer WHERE c_custkey % {_KINDS} = 0), n AS (SELECT * FROM customer WHERE c_custkey % {_KINDS} = 4),
f AS (
  SELECT c_custkey, 'wind' AS risk, z AS zone, 'yellow' AS level, {_TIME(12, 0)} AS start, {_TIME(23, 59)} AS until, NULL::DATE AS day, false AS from_issuance FROM a, (VALUES ('A1'), ('B')) AS t(z)
  UNION ALL SELECT c_custkey, 'thunderstorms', 'E3', 'red', {_TIME(10, 30)}, {_TIME(20, 15)}, NULL, true FROM a
  UNION ALL SELECT c_custkey, r, z, 'unknown', NULL, NULL, (make_date(2026, {_M}, {_DAY}::INTEGER) + k::INTEGER)::DATE, false FROM n, (VALUES {_VALUES}) AS x(label, r), (VALUES {_ZONE_VALUES}) AS y(z), range(2) AS d(k))
SELECT * FROM f""")
def regional_statements(spark, sf_dir):
    """The facts that criticality bulletins state, one by one."""
    rows = regional.criticality(_customers(spark, sf_dir, _shape(0))).select("c_custkey", F.explode("facts").alias("f"))
    return rows.select("c_custkey", "f.risk", "f.zone", "f.level", "f.start", F.col("f.end").alias("until"), "f.day", "f.from_issuance")


_VIGILANCE = [
    (name, f"'<tr><td>{name}</td><td>' || {cell} || '</td><td>A1 T</td></tr>'")
    for name, cell in [("Pioggia", "'O1, B'"), ("temporali", "CASE WHEN c_custkey % 3 = 0 THEN 'V' ELSE '-' END"), ("vento", "'-'"), ("mare", "'-'"), ("neve", "'X9'"), ("ghiaccio", "'-'")]
]
_LIST = f"""
{_HEAD} || '<table><tr><th></th><th>' || {_WRITTEN} || '</th><th>' || CASE WHEN c_custkey % 5 = 1 THEN 'domani' ELSE {_NEXT} END || '</th></tr>' || {' || '.join(row for _, row in _VIGILANCE)}
|| CASE c_custkey % 5 WHEN 2 THEN '<tr><td>nebbia</td><td>B</td><td>B</td></tr>' WHEN 3 THEN '<tr><td>neve</td></tr>' ELSE '' END || '</table>'"""


@query(f"""
WITH f AS (SELECT c_custkey, l, r FROM customer, (VALUES ('pioggia', 'minor_network_hydro'), ('pioggia', 'main_network_hydraulic'), ('temporali', 'thunderstorms'), ('vento', 'wind'), ('mare', 'coastal_waves'), ('neve', 'snow'), ('ghiaccio', 'ice')) AS t(l, r)
  WHERE c_custkey % 5 IN (0, 4)),
z AS (SELECT c_custkey, l, r, unnest(CASE WHEN l = 'pioggia' THEN ['B', 'O1'] WHEN l = 'temporali' AND c_custkey % 3 = 0 THEN ['V'] ELSE [] END) AS zone, 0 AS k FROM f
  UNION ALL SELECT c_custkey, l, r, unnest(['A1', 'T']), 1 FROM f)
SELECT c_custkey, r AS risk, zone, (make_date(2026, {_M}, {_DAY}::INTEGER) + k::INTEGER)::DATE AS day FROM z""")
def regional_vigilance(spark, sf_dir):
    """Phenomena by zone on two days; pages with other rows, columns or dates are refused."""
    rows = regional.vigilance(_customers(spark, sf_dir, _LIST)).select("c_custkey", F.explode("facts").alias("f"))
    return rows.select("c_custkey", "f.risk", "f.zone", "f.day")


_NEWS = f"CASE c_custkey % 3 WHEN 0 THEN '<b>{regional.NO_EVENT}</b>' WHEN 1 THEN '<p>Emesso il 0' || (c_custkey % 9 + 1) || '/04/2026 7.05: piogge</p>' ELSE '<p>niente</p>' END"


@query(f"""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '{regional.NO_EVENT}' WHEN 1 THEN '0' || (c_custkey % 9 + 1) || '/04/2026, ore 7:05' END AS statement, CASE WHEN c_custkey % 3 = 2 THEN 'no_issuance' END AS refused FROM customer""")
def regional_monitoring(spark, sf_dir):
    """Monitoring bulletins state nothing but themselves."""
    return regional.monitoring(_customers(spark, sf_dir, _NEWS)).select("c_custkey", "statement", "refused")


# ---- expressions of time

_D = "(day(o_orderdate) % 28 + 1)"
_NAME = "CASE month(o_orderdate) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(text.MONTHS, 1)) + " END"
_DATE = f"{_D} || ' ' || {_NAME} || ' 2026'"
_NUM = f"{_D} || '/' || month(o_orderdate) || '/2026'"
_UTC = lambda h: f"(make_timestamp(2026, month(o_orderdate), {_D}, {h}, 0, 0) - INTERVAL (CASE WHEN make_date(2026, month(o_orderdate)::INTEGER, {_D}::INTEGER) BETWEEN DATE '2026-03-29' AND DATE '2026-10-24' THEN 2 ELSE 1 END) HOUR)"
_SPANS = [
    (f"'Dalle  ore 9.00 alle ore 17:00 di sabato, ' || {_DATE}", "9", "17"),
    (f"'dalle ore 9.00 ' || {_DATE} || ' alle ore 18:00 di ' || {_DATE}", "9", "18"),
    (f"'valido dalle 7:00 del ' || {_NUM} || ' fino alle 19.00 ' || {_NUM}", "7", "19"),
    (f"'dalle ore 17.00 alle ore 9:00 di ' || {_DATE}", None, None),
    (f"'dalle ore 9.00 alle ore 24.00 di ' || {_DATE}", None, None),
    ("'dalle ore 02.30 alle ore 12.00 di Domenica, 25 ottobre 2026'", None, None),
    ("'dalle ore 02.30 alle ore 12.00 di Domenica, 29 marzo 2026'", None, None),
    (f"'dalle 7:00 del ' || {_NUM}", None, None),
    ("'dalle ore 9.00 alle ore 17:00 di 31 aprile 2026'", None, None),
]


def _span(i: int) -> str:
    given = [(n, x[i] if i == 0 else _UTC(x[i]) if x[i] else "NULL") for n, x in enumerate(_SPANS)]
    return f"CASE o_orderkey % {len(_SPANS)} " + " ".join(f"WHEN {n} THEN {x}" for n, x in given) + " END"


@query(f"SELECT o_orderkey, {_span(1)} AS start, {_span(2)} AS until FROM orders")
def interval_phrases(spark, sf_dir):
    """Intervals in words, in three shapes; reversed, nonexistent and ambiguous ones are refused."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", italian.row_interval(F.expr(_span(0))).alias("i"))
    return rows.select("o_orderkey", "i.start", F.col("i.end").alias("until"))


_ONGOING = f"'In corso fino alle ore ' || (o_orderkey % 23 + 1) || '.00 di ' || {_DATE}"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 23 + 1 > 6 THEN {_UTC(6)} END AS start, CASE WHEN o_orderkey % 23 + 1 > 6 THEN {_UTC('(o_orderkey % 23 + 1)')} END AS until FROM orders")
def ongoing_phrases(spark, sf_dir):
    """What goes on until a time begins at its issuance, here six o'clock of the day."""
    rows = table(spark, sf_dir, "orders")
    issued = italian.local_instant(F.lit("6"), F.lit("00"), F.to_date(F.expr(f"make_date(2026, month(o_orderdate), {_D})")))
    rows = rows.select("o_orderkey", italian.in_progress_interval(F.expr(_ONGOING), issued).alias("i"))
    return rows.select("o_orderkey", "i.start", F.col("i.end").alias("until"))


_STARTS = [f"'dalle ore 8.00 di ' || {_DATE}", f"'dalle ore 8.00 di ' || {_D} || ' ' || {_NAME}", f"'dalle ore 8.00 di ' || ({_D} % 28 + 1) || ' ' || {_NAME}", f"'a partire dalle ore 8.00 di ' || {_DATE}"]


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN {_UTC(8)} END AS start FROM orders")
def operative_starts(spark, sf_dir):
    """Operative starts; without a year the publication's counts, if it is of that day."""
    phrase = "CASE o_orderkey % 4 " + " ".join(f"WHEN {n} THEN {p}" for n, p in enumerate(_STARTS)) + " END"
    published = F.expr(f"make_date(2026, month(o_orderdate), {_D})")
    return table(spark, sf_dir, "orders").select("o_orderkey", italian.operative_start(F.expr(phrase), published).alias("start"))
