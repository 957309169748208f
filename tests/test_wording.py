"""What notices say: acts named, clauses, measures stated, and what is refused."""

import datetime as dt

import pytest

from annalist.functions import wording


def named(text):
    return [(r["kind"], r["number"], r["year"], r["day"] and r["day"].isoformat()) for r in wording.references(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Emessa ordinanza di chiusura parchi. Il Sindaco ha predisposto mediante apposita ordinanza la chiusura.", [("ordinanza", None, None, None)]),
        ("Restano in vigore le disposizioni adottate con ordinanza comunale: chiusura al pubblico.", [("ordinanza", None, None, None)]),
        ("Con Ordinanza n. 7/2031 il Sindaco dispone la chiusura. È stata emessa apposita ordinanza.", [("ordinanza", 7, 2031, None)]),
        ("Si comunica che con ordinanza sindacale n° 0034 del 20/08/2031 sono chiusi i cimiteri.", [("ordinanza", 34, 2031, "2031-08-20")]),
        ("Emessa ordinanza di chiusura. Con decreto n. 9/2031 è attivato il centro.", [("decreto", 9, 2031, None), ("ordinanza", None, None, None)]),
        ("Allerta gialla per temporali. Albo pretorio", []),
        ("Al momento non è stata emessa alcuna ordinanza di chiusura.", []),
        ("Qualora necessario potrà essere emessa apposita ordinanza.", []),
        ("Ordinanza n. 1/2031. Ordinanza n. 2/2031. Ordinanza n. 3/2031. Ordinanza n. 4/2031.", [("ordinanza", k, 2031, None) for k in (1, 2, 3)]),
        ("Non piove. Ordinanza\nn. 5 / 2031", [("ordinanza", 5, 2031, None)]),
        ("", []),
        ("Visto il decreto n. 00123456 del 3/4/2031", [("decreto", 123456, 2031, "2031-04-03")]),
        ("Visto il decreto n. 1234567890/2031", []),
    ],
)
def test_references(text, want):
    assert named(text) == want


HEADER = "ORDINA in via contingibile e urgente, a partire dalle ore 00.00 del giorno 10 settembre 2031, fino al perdurare dell'emergenza: "


def test_clause_of_an_ordinance_with_recitals_before_it():
    text = "Visto il D. Lgs. n. 267 del 18/8/2000; disponendo: • la chiusura; " + HEADER + "• la chiusura al pubblico: ◦ dei cimiteri; • il divieto di attività; • la sospensione delle lezioni. AVVERTE DISPONE l'attivazione"
    found = wording.clause(text)
    assert found["start"] == dt.datetime(2031, 9, 10) and found["end"] is None and found["condition"] == "fino al perdurare dell'emergenza"
    assert [d["kind"] for d in found["dispositions"]] == ["closure", "prohibition", "suspension"]


@pytest.mark.parametrize(
    "text",
    [
        "Si dispone la chiusura dei cimiteri dalle ore 00.00 del 10 settembre.",
        HEADER.replace("fino al perdurare dell'emergenza", "fino a quando sarà opportuno") + "la chiusura dei cimiteri;",
        HEADER.replace("10 settembre", "31 settembre") + "la chiusura dei cimiteri;",
        HEADER.replace("fino al perdurare dell'emergenza", "fino alle ore 08.00 del giorno 9 settembre 2031") + "la chiusura;",
        HEADER + "quanto in premessa; AVVERTE",
    ],
)
def test_clauses_that_are_not_understood(text):
    assert wording.clause(text) is None


def said(text, core=None):
    return [(m["kind"], m["subject"], m["place"], m["valid_from"], m["valid_until"]) for m in wording.stated(text, core)]


LIST = HEADER + "- la chiusura al pubblico: ◦ dell'area di sgambamento cani; ◦ dei cimiteri  comunali; - il divieto di attività"
SINCE = "a partire dalle ore 00.00 del giorno 10 settembre 2031"


def test_directive_lists_inherit_start_and_condition():
    until = "fino al perdurare dell'emergenza"
    assert said(LIST) == [("closure", "area di sgambamento cani", None, SINCE, until), ("closure", "cimiteri comunali", None, SINCE, until)]
    assert all(m["quote"] in LIST and m["quote"].endswith("comunali;") for m in wording.stated(LIST))
    one = "ORDINA in via contingibile e urgente: la chiusura al pubblico: - del parco; "
    assert said(one) == [("closure", "parco", None, None, None)]


@pytest.mark.parametrize(
    "text",
    [
        "Il Sindaco non ha deciso, " + LIST,
        "Se piove, " + LIST,
        "Si cita: «" + LIST + "»",
        "Oggetto: " + LIST + " VISTO il bollettino",
        LIST.replace("◦ dei cimiteri  comunali;", "◦ dei cimiteri: comunali;"),
        LIST.replace("comunali", "c" * 200),
        LIST.replace("area", "area se piove"),
        LIST.replace("◦", ""),
        LIST.replace("ORDINA in via contingibile e urgente", "ORDINA"),
    ],
)
def test_directive_lists_that_are_refused_as_a_whole(text):
    assert said(text) == []


KEPT = "Restano al momento in vigore, salvo successive modifiche, le disposizioni: chiusura al pubblico della biblioteca e dei giardini e divieto di attività nei parchi e giardini pubblici, nelle aree verdi, nelle ciclopiste in riva d’Arno e negli orti sociali."


def test_retained_lists():
    text = "Il ponte di via del Bosco è stato riaperto alla circolazione. " + KEPT + " Il Centro Operativo resta attivo."
    span = ("al momento", "salvo successive modifiche")
    assert said(text) == [
        ("closure", "biblioteca", None, *span), ("closure", "giardini", None, *span),
        *(("prohibition", "attività", p, *span) for p in ("parchi e giardini pubblici", "aree verdi", "ciclopiste in riva d’Arno", "orti sociali")),
        ("reopening", "ponte di via del Bosco", None, None, None),
    ]


PLAIN = "Restano in vigore le disposizioni: divieto di attività nei parchi, nelle aree verdi e negli orti."


@pytest.mark.parametrize(
    "text",
    [
        "Non " + PLAIN, "Se piove, " + PLAIN, "La relazione cita «" + PLAIN + "»", "Oggetto: " + PLAIN + " VISTO il bollettino.", PLAIN.replace("Restano", "Resteranno"), PLAIN.replace("negli orti", "negli orti, esclusi quelli privati"),
        PLAIN.replace("nelle aree verdi e negli orti", "piazze e orti"), PLAIN.removesuffix("."), PLAIN.replace("nelle aree verdi", "nei parchi"), PLAIN.replace("parchi", "p" * 161),
    ],
)
def test_retained_prohibitions_that_are_refused(text):
    assert said(text) == []


def test_a_quote_counts_where_its_core_begins():
    assert len(said(PLAIN)) == 3 and said(PLAIN, (len("Restano"), len(PLAIN))) == [] and len(said("È qui. " + PLAIN, (8, 20))) == 3


OPEN = "Il sottopasso di via del Bosco, chiuso nella serata di ieri per acqua, è stato riaperto alla circolazione."


@pytest.mark.parametrize(
    ("text", "n"),
    [
        (OPEN, 1), ("La strada del Parco è stata riaperta alla circolazione.", 1), (OPEN + " Il ponte del Parco è stato riaperto alla circolazione.", 2), (OPEN.replace("circolazione.", "circolazione solo se autorizzati."), 0),
        (OPEN.replace("è stato", "non è stato"), 0), ("Il ponte del Parco forse è stato riaperto alla circolazione.", 0), (OPEN.replace("è stato", "sarà"), 0), ("Se migliora il tempo, " + OPEN, 0),
        ("Il documento cita «Testo. " + OPEN + "»", 0), ('Il documento cita "Testo. ' + OPEN + '"', 0), ("Oggetto: aggiornamento. " + OPEN + " VISTO il maltempo.", 0),
    ],
)
def test_reopenings(text, n):
    assert len(said(text)) == n


@pytest.mark.parametrize(
    ("kind", "quote", "want"),
    [
        ("prohibition", "un'ordinanza che vieta il transito", True), ("prohibition", "È vietato il transito", True), ("prohibition", "sono vietati il transito e la sosta", True), ("prohibition", "non è vietato il transito", False),
        ("prohibition", "l'ordinanza non vieta il transito", False), ("prohibition", "non sono vietati", False), ("prohibition", "prosegue verso il Vietnam", False), ("prohibition", "non è vietato sostare, è vietato transitare", True),
        ("prohibition", "il divieto", True), ("activation", "il COC (Centro Operativo Comunale) resta aperto", True), ("activation", "il centro operativo comunale non è aperto", False), ("activation", "l'ufficio è aperto", False),
        ("closure", "Chiusi i parchi", True), ("unknown", "chiusi", False),
    ],
)
def test_supported_kinds(kind, quote, want):
    assert wording.supported(kind, quote) is want


def test_measures_of_all_windows_at_once(spark):
    from pyspark.sql import functions as F

    from annalist.functions import kernels

    keeps = "Restano al momento in vigore le disposizioni: divieto di attività nei parchi 7, nelle aree verdi e negli orti sociali."
    texts = [(1, "Parole di contorno. " * 250 + keeps + " Altre parole." * 200), (2, keeps * 2), (3, ""), (4, None), (5, "Il ponte B è stato riaperto alla circolazione. " * 200)]
    rows = spark.createDataFrame(texts, "id int, text string")
    windows = rows.select("id", "text", F.explode(kernels.operational_windows("text")).alias("w"))
    one = windows.select("id", "w.ordinal", F.explode(wording.stated_in_window("text", "w")).alias("m")).select("id", "ordinal", "m.*")
    every = rows.select("id", F.explode(wording.stated_in_windows("text")).alias("m")).select("id", "m.*")
    assert sorted(map(str, every.collect())) == sorted(map(str, one.collect())) and every.count() > 200
