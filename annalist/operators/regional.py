"""Regional bulletins as HTML tables: what a page says, and the facts that it states in so many words.

A page is either understood as a whole or refused with a reason; nothing is inferred from what it leaves out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import italian, kernels, text
from annalist.functions.temporal import let

# Names of risks, zones, phenomena and levels in public bulletins.
RISKS = ["minor_network_hydro", "main_network_hydraulic", "thunderstorms", "wind", "coastal_waves", "snow", "ice"]
RISK_LABELS = {
    "RISCHIO IDROGEOLOGICO-IDRAULICO RETICOLO MINORE": "minor_network_hydro",
    "RISCHIO IDRAULICO RETICOLO PRINCIPALE": "main_network_hydraulic",
    "TEMPORALI FORTI CON RISCHIO IDROGEOLOGICO-IDRAULICO RETICOLO MINORE": "thunderstorms",
    "RISCHIO VENTO": "wind",
    "RISCHIO MAREGGIATE": "coastal_waves",
    "RISCHIO NEVE": "snow",
    "RISCHIO GHIACCIO": "ice",
}
OTHER_LABELS = {"IDROGEOLOGICO IDRAULICO RETICOLO MINORE": "minor_network_hydro", "TEMPORALI FORTI": "thunderstorms"}
LEVELS = {"verde": "green", "giallo": "yellow", "arancione": "orange", "rosso": "red"}
PHENOMENA = {"pioggia": RISKS[:2], "temporali": RISKS[2:3], "vento": RISKS[3:4], "mare": RISKS[4:5], "neve": RISKS[5:6], "ghiaccio": RISKS[6:]}
ZONE = r"\b(?:A[1-6]|B|C|E[1-3]|F[1-2]|I|L|M|O[1-3]|R[1-2]|S[1-3]|T|V)\b"
ISSUED = r"(?i)Emissione(?: interna)? di\s+(.+?),\s*ore\s+([0-9]{1,2})[.:]([0-9]{2})"
MONITORED = r"(?i)Emesso il\s+([0-9]{2}/[0-9]{2}/[0-9]{4})\s+([0-9]{1,2})[.:]([0-9]{2})"
_DAYS, _MONTHS = "|".join(d.replace("ì", "[iìí]") for d in italian.WEEKDAYS), "|".join(text.MONTHS)
DATED = rf"(?iu)\b(?:{_DAYS}),?\s+[0-9]{{1,2}}\s+(?:{_MONTHS})\s+[0-9]{{4}}\b"
NO_EVENT = "NESSUN AVVISO IN CORSO DI VALIDITÀ O EVENTO IN CORSO"
NO_CRITICALITY = r"(?iu)CRITICIT[ÀA] PREVISTE: NESSUNA"
AREA_KEY = r"(?s)AREE INTERESSATE:(.*?)Legenda criticità:"
#: Zones that the area key of a whole bulletin names.
N_ZONES = 26

FACT = "array<struct<risk:string,label:string,zone:string,level:string,precision:string,start:timestamp_ntz,end:timestamp_ntz,day:date,from_issuance:boolean>>"


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def zones(value: Column) -> Column:
    """The zones that a text names, each once, in order of their names."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(value, F.lit(ZONE), F.lit(0))))


def risk(label: Column) -> Column:
    """The risk that a label names, with or without the word risk in front; null for others."""
    short = {k.removeprefix("RISCHIO "): v for k, v in RISK_LABELS.items()}
    return _mapped(RISK_LABELS | short | OTHER_LABELS, F.upper(label))


def observed(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds `seen` with the visible text in one line, the tables, the issuance and its time, and what the page says in words."""
    parsed = pages.withColumn("_p", kernels.parsed_html(html))
    line = text.squeezed(F.col("_p.text"))
    first, other = (lambda i: F.regexp_extract(line, ISSUED, i)), (lambda i: F.regexp_extract(line, MONITORED, i))
    day = F.coalesce(text.italian_date(first(1)), F.try_to_date(first(1), "dd/MM/yyyy"))
    seen = F.struct(
        line.alias("text"),
        F.col("_p.tables").alias("tables"),
        F.when(first(1) != "", F.concat(F.trim(first(1)), F.lit(", ore "), first(2), F.lit(":"), first(3))).alias("issuance"),
        F.when(other(1) != "", F.concat(other(1), F.lit(", ore "), other(2), F.lit(":"), other(3))).alias("monitored"),
        italian.local_instant(first(2), first(3), day).alias("issued_at"),
        line.rlike(NO_CRITICALITY).alias("none_expected"),
        F.contains(line, F.lit(NO_EVENT)).alias("no_event"),
        F.array_distinct(F.regexp_extract_all(line, F.lit(DATED), F.lit(0))).alias("days"),
    )
    return parsed.withColumn("seen", seen).drop("_p")


def _empty(array: Column) -> Column:
    return F.coalesce(F.size(array) == 0, F.lit(True))


def criticality(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds `refused` (a reason, or null), `statement` and `facts` of criticality bulletins.

    Of every table headed by zones, risk and criticality each row must have four cells that all are understood: zones, a known
    risk, an interval (or `in corso fino alle ore ...`, which begins at the issuance) and a level. A page without such rows
    must say that no criticality is expected, for two dated days, and name all zones: then every risk of every zone is
    `unknown` on both days, not green. A page that says both is refused.
    """
    rows = observed(pages, html)
    table = F.filter(
        "seen.tables",
        lambda t: (F.size(t) >= 2) & (F.size(t[0]) >= 4) & F.upper(F.array_join(t[0], " ")).rlike("(?s)^(?=.*ZONE)(?=.*RISCHIO)(?=.*CRITIC)"),
    )
    rows = rows.withColumn("_rows", F.flatten(F.transform(table, lambda t: F.slice(t, 2, F.size(t)))))
    rows = rows.withColumn("_spans", F.transform("_rows", lambda r: italian.row_interval(F.get(r, 2))))
    late = F.transform("_rows", lambda r: italian.in_progress_interval(F.get(r, 2), F.col("seen.issued_at")))
    rows = rows.withColumn("_late", late)
    read = F.transform(
        F.arrays_zip(F.col("_rows").alias("r"), F.col("_spans").alias("s"), F.col("_late").alias("l")),
        lambda x: F.struct(
            zones(F.get(x["r"], 0)).alias("zones"), risk(F.get(x["r"], 1)).alias("risk"), F.get(x["r"], 1).alias("label"), _mapped(LEVELS, F.lower(F.get(x["r"], 3))).alias("level"),
            F.coalesce(x["s"], x["l"]).alias("span"), (x["s"].isNull() & x["l"].isNotNull()).alias("late"), F.size(x["r"]).alias("cells"),
        ),
    )
    rows = rows.withColumn("_read", read)
    shape = F.exists("_read", lambda x: x["cells"] != 4)
    odd = F.exists("_read", lambda x: x["risk"].isNull() | x["level"].isNull() | x["span"].isNull() | (F.size(x["zones"]) == 0))
    none = F.lit(None)
    listed = F.flatten(F.transform("_read", lambda x: F.transform(x["zones"], lambda z: F.struct(
        x["risk"].alias("risk"), x["label"].alias("label"), z.alias("zone"), x["level"].alias("level"), F.lit("interval").alias("precision"),
        x["span"]["start"].alias("start"), x["span"]["end"].alias("end"), none.cast("date").alias("day"), x["late"].alias("from_issuance")))))
    scope = zones(F.regexp_extract("seen.text", AREA_KEY, 1))
    days = F.transform("seen.days", text.italian_date)
    risks = F.map_entries(F.create_map(*[F.lit(x) for kv in RISK_LABELS.items() for x in kv]))
    unknown = let(F.col("_scope"), lambda named: F.flatten(F.flatten(F.transform("_days", lambda d: F.transform(risks, lambda r: F.transform(named, lambda z: F.struct(
        r["value"].alias("risk"), r["key"].alias("label"), z.alias("zone"), F.lit("unknown").alias("level"), F.lit("date").alias("precision"),
        none.cast("timestamp_ntz").alias("start"), none.cast("timestamp_ntz").alias("end"), d.alias("day"), F.lit(False).alias("from_issuance"))))))))
    rows = rows.withColumn("_days", days).withColumn("_scope", scope)
    all_risks = F.upper("seen.text")
    named = F.lit(True)
    for label in RISK_LABELS:
        named = named & F.contains(all_risks, F.lit(label))
    refused = (
        F.when(F.col("seen.issuance").isNull(), "no_issuance")
        .when(~_empty(F.col("_read")) & shape, "row_shape")
        .when(~_empty(F.col("_read")) & odd, "unsupported_row")
        .when(~_empty(F.col("_read")) & F.col("seen.none_expected"), "conflict")
        .when(~_empty(F.col("_read")), none)
        .when(~F.col("seen.none_expected") | (F.size("_days") != 2) | ~named, "no_supported_rows")
        .when(F.exists("_days", lambda d: d.isNull()), "date")
        .when(F.size("_scope") != N_ZONES, "zone_scope")
    )
    rows = rows.withColumn("refused", F.coalesce(refused, none.cast("string")))
    ok = F.col("refused").isNull()
    statement = F.when(ok & _empty(F.col("_read")), "Criticità previste: NESSUNA")
    facts = F.when(ok & ~_empty(F.col("_read")), listed.cast(FACT)).when(ok, unknown.cast(FACT))
    return rows.withColumn("statement", statement).withColumn("facts", F.coalesce(facts, F.array().cast(FACT))).drop("_rows", "_spans", "_late", "_read", "_days", "_scope")


def vigilance(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds `refused`, `statement` and `facts` of vigilance bulletins: phenomena by zone on two days, never colours.

    The table is the first that names all six phenomena; its head must have two dates and each row three cells.
    """
    rows = observed(pages, html)
    known = list(PHENOMENA)
    is_phenomenon = lambda r: F.coalesce(F.lower(F.get(r, 0)).isin(*known), F.lit(False))
    rows = rows.withColumn("_t", F.get(F.filter("seen.tables", lambda t: F.size(F.filter(t, is_phenomenon)) == len(known)), 0))
    rows = rows.withColumn("_days", F.transform(F.slice("_t", 1, 1)[0], text.italian_date)).withColumn("_rows", F.slice("_t", F.lit(2), F.greatest(F.size("_t"), F.lit(1))))
    of = F.create_map(*[x for k, v in PHENOMENA.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.lit(None)
    facts = let(F.col("_days"), lambda days: F.flatten(F.transform("_rows", lambda r: F.flatten(F.transform(F.array(F.lit(1), F.lit(2)), lambda i: F.flatten(F.transform(zones(F.get(r, i)), lambda z: F.transform(
        F.element_at(of, F.lower(F.get(r, 0))), lambda k: F.struct(
            k.alias("risk"), F.get(r, 0).alias("label"), z.alias("zone"), F.lit("not_applicable").alias("level"), F.lit("date").alias("precision"),
            none.cast("timestamp_ntz").alias("start"), none.cast("timestamp_ntz").alias("end"), F.get(days, i).alias("day"), F.lit(False).alias("from_issuance"))))))))))
    refused = (
        F.when(F.col("seen.issuance").isNull(), "no_issuance")
        .when(F.col("_t").isNull(), "layout")
        .when(F.size("_days") != 3, "date_columns")
        .when(F.exists("_rows", lambda r: F.size(r) != 3), "row_shape")
        .when(F.exists("_rows", lambda r: ~is_phenomenon(r)), "unknown_phenomenon")
        .when(F.get("_days", 1).isNull() | F.get("_days", 2).isNull(), "date")
    )
    rows = rows.withColumn("refused", F.coalesce(refused, none.cast("string")))
    ok = F.col("refused").isNull()
    statement = F.when(ok, "Vigilance phenomenon zone-summary table")
    return rows.withColumn("statement", statement).withColumn("facts", F.coalesce(F.when(ok, facts.cast(FACT)), F.array().cast(FACT))).drop("_t", "_days", "_rows")


def monitoring(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds `refused` and `statement` of monitoring bulletins, which state no facts: that nothing goes on, or when they were issued."""
    rows = observed(pages, html)
    issued = F.coalesce("seen.issuance", "seen.monitored")
    statement = F.when(issued.isNull() & F.col("seen.no_event"), NO_EVENT).otherwise(issued)
    return rows.withColumn("statement", statement).withColumn("refused", F.when(statement.isNull(), "no_issuance"))
