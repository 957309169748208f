"""Scalar functions and kernels on hand-made cases and random input."""

import datetime as dt
import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalist.functions import checks, italian, kernels, money, temporal, text
from annalist.operators import ledger, retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ts(value):
    return F.lit(value).cast("timestamp_ntz")


# ---- money


@pytest.mark.parametrize(
    ("q", "p", "u", "wanted"),
    [(2, 4, 3, 3), (3, 4, 3, 4), (0, 5, 7, 0), (2**62, 4, 1, None), (2**62, 4, 4, 2**62), (None, 1, 1, None), (1, 1, 0, None), (-1, 1, 1, None), (2**63 - 1, 2**63 - 1, 2**63 - 1, 2**63 - 1)],
)
def test_ceil_cost(spark, q, p, u, wanted):
    assert one(spark, money.ceil_cost(*[F.lit(x).cast("long") for x in (q, p, u)])) == wanted


def test_cost_needs_every_metric(spark):
    usage = spark.createDataFrame([(1, 7, "in", 100), (1, 7, "out", 10), (2, 7, "in", 20), (3, 7, "in", 5), (3, 7, "out", 1), (3, 7, "other", 1)], "id long, price_version_id long, metric string, amount long")
    rates = spark.createDataFrame([(7, "in", 2, 1), (7, "out", 1, 3)], "price_version_id long, metric string, unit_size long, price_microunits long")
    assert {r.id: r.cost for r in ledger.costs(usage, rates).collect()} == {1: 80, 2: None, 3: None}


# ---- time


@pytest.mark.parametrize(
    ("precision", "start", "end", "at", "wanted"),
    [
        ("interval", "10:00", "12:00", "09:59", "future"),
        ("interval", "10:00", "12:00", "10:00", "current"),
        ("interval", "10:00", "12:00", "12:00", "expired"),
        ("interval", "10:00", None, "23:00", "current"),
        ("instant", "10:00", None, "09:00", "future"),
        ("instant", "10:00", None, "10:00", "undetermined"),
        ("date", "10:00", None, "11:00", "undetermined"),
        ("unknown", None, None, "11:00", "undetermined"),
    ],
)
def test_status(spark, precision, start, end, at, wanted):
    day = lambda t: ts(t and f"2026-04-13 {t}:00")
    assert one(spark, temporal.status(F.lit(precision), day(start), day(end), day(at))) == wanted


@pytest.mark.parametrize(
    ("precision", "start", "end", "wanted"),
    [
        ("unknown", None, None, True), ("conditional", "2030-01-01", None, True), ("date", "2026-04-12", None, False), ("date", "2026-04-13", None, True), ("date", "2026-04-14", None, False),
        ("interval", "2026-04-01", None, True), ("interval", "2026-04-01", "2026-04-13", False), ("interval", "2026-04-01", "2026-04-14", True), ("instant", "2026-04-13", None, True), ("instant", "2026-04-14", None, False),
    ],
)
def test_intersects(spark, precision, start, end, wanted):
    assert one(spark, temporal.intersects(F.lit(precision), ts(start), ts(end), ts("2026-04-13"), ts("2026-04-14"))) is wanted


@pytest.mark.parametrize(
    ("local", "utc"),
    [("2026-04-13 12:00:00", "2026-04-13 10:00:00"), ("2026-01-13 12:00:00", "2026-01-13 11:00:00"), ("2026-03-29 02:30:00", None), ("2026-10-25 02:30:00", None), ("2026-10-25 03:00:00", "2026-10-25 02:00:00"), ("2026-10-25 01:59:00", "2026-10-24 23:59:00"), ("2026-03-29 03:00:00", "2026-03-29 01:00:00")],
)
def test_local_to_utc(spark, local, utc):
    assert one(spark, temporal.local_to_utc(ts(local))) == (utc and dt.datetime.fromisoformat(utc))


def test_months_are_clamped(spark):
    for start, wanted in (("2027-01-31 10:30:00", "2027-02-28 10:30:00"), ("2028-01-31 10:30:00", "2028-02-29 10:30:00"), ("2027-03-15 00:00:00", "2027-04-15 00:00:00")):
        assert one(spark, temporal.add_months(ts(start), 1)) == dt.datetime.fromisoformat(wanted)


def test_backoff(spark):
    assert [one(spark, temporal.backoff_seconds(1, 86400, F.lit(n))) for n in (0, 1, 2, 3, 30, 4000)] == [0, 1, 2, 4, 86400, 86400]


def test_due_state(spark):
    state = lambda last, at: one(spark, temporal.due_state(ts("2026-01-01 00:00:00"), 21600, 3600, ts(last), ts(at)))
    assert state(None, "2025-12-31 23:00:00") == "not_due"
    assert state("2026-01-01 05:00:00", "2026-01-01 06:30:00") == "published"
    assert state("2026-01-01 04:59:59", "2026-01-01 07:00:00") == "awaiting"
    assert state("2026-01-01 04:59:59", "2026-01-01 07:00:01") == "missing"


def test_updating_state(spark):
    state = lambda last, failed, suspended, at: one(spark, temporal.updating_state(ts(last), F.lit(failed), F.lit(suspended), 3600, ts(at)))
    assert state(None, True, True, "2026-01-01 10:00:00") == "not_verified"
    assert state("2026-01-01 09:00:00", True, True, "2026-01-01 09:30:00") == "suspended"
    assert state("2026-01-01 09:00:00", True, False, "2026-01-01 09:30:00") == "failed"
    assert state("2026-01-01 09:00:00", False, False, "2026-01-01 10:00:00") == "delayed"
    assert state("2026-01-01 09:00:00", False, False, "2026-01-01 09:59:59") == "ok"


def test_local_days(spark):
    assert one(spark, temporal.local_day(ts("2026-09-23 22:15:00"))) == dt.date(2026, 9, 24)


# ---- phrases


@pytest.mark.parametrize(("phrase", "wanted"), [("Mercoledí, 23 Settembre 2026", dt.date(2026, 9, 23)), ("31 febbraio 2026", None), ("domani", None), (None, None)])
def test_italian_date(spark, phrase, wanted):
    assert one(spark, text.italian_date(F.lit(phrase).cast("string"))) == wanted


@pytest.mark.parametrize(
    ("phrase", "wanted"),
    [
        ("dalle ore 12.00 alle ore 23.59 di Lunedì, 13 Aprile 2026", ("2026-04-13 10:00", "2026-04-13 21:59")),
        ("dalle ore 12.00 Lunedì, 13 Aprile 2026 alle ore 23.59 Martedì, 14 Aprile 2026", ("2026-04-13 10:00", "2026-04-14 21:59")),
        ("dalle ore 12.00 alle ore 23.59 di Martedì, 31 Febbraio 2026", None),
        ("dalle ore 23.00 alle ore 12.00 di Lunedì, 13 Aprile 2026", None),
        ("dalle ore 02.30 alle ore 12.00 di Domenica, 25 Ottobre 2026", None),
        ("dalle ore 02.30 alle ore 12.00 di Domenica, 29 Marzo 2026", None),
        ("dalle ore 12.00 alle ore 24.00 di Lunedì, 13 Aprile 2026", None),
        ("domani", None),
    ],
)
def test_interval_phrase(spark, phrase, wanted):
    found = one(spark, italian.row_interval(F.lit(phrase)))
    assert (found and (found.start, found.end)) == (wanted and tuple(map(dt.datetime.fromisoformat, wanted)))


def test_act_references(spark):
    phrase = "Ordinanza n. 38/2026, ordinanza sindacale n° 0034 del 20/08/2026, decreto n. 5/2025, delibera n. 9/2024, apposita ordinanza"
    assert one(spark, text.act_references(F.lit(phrase))) == ["ordinanza 38/2026", "ordinanza 34/2026", "decreto 5/2025"]
    assert one(spark, text.act_references(F.lit("nessun atto"))) == []


def test_small_text_functions(spark):
    assert one(spark, text.bounded(F.lit("aé日b"), 4)) == "aé"
    assert one(spark, text.bounded(F.lit("abc"), 9)) == "abc"
    assert one(spark, text.canonical(F.lit(" Rosso  Scuro "), {"rosso scuro": "red"})) == "red"
    assert one(spark, text.same_origin(F.lit("https://a.it/x"), F.lit("https://a.it/y?z"))) is True
    assert one(spark, text.same_origin(F.lit("https://a.it:8/x"), F.lit("https://a.it/y"))) is False
    assert one(spark, text.within_path(F.lit("https://a.it/x/y"), F.lit("https://a.it/x/"))) is True
    assert one(spark, text.within_path(F.lit("https://a.it/xy"), F.lit("https://a.it/x"))) is False
    assert one(spark, text.stems_match(F.lit("chiusura del sottopasso"), F.lit("i sottopassi"))) is True
    a, b = (one(spark, text.stable_id("m", F.lit("x"), F.lit(v))) for v in (1, 2))
    assert a.startswith("m_") and len(a) == 66 and a != b


# ---- kernels

MARKED = "## **ORDINA**\r\n\tla chiusura del `sottopasso Verde` fino a revoca"


def test_normal_form():
    plain, spans = kernels.normalize(MARKED)
    assert plain == "ORDINA la chiusura del sottopasso Verde fino a revoca"
    start, end = kernels.source_range(spans, 0, plain.index(" fino"))
    assert MARKED.encode()[start:end].decode() == "ORDINA**\r\n\tla chiusura del `sottopasso Verde"
    assert [kernels.normalize(f"l{q}ora")[0] for q in "’‘ʼ"] == ["l'ora"] * 3


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é’`*_#\n\t日", max_size=80))
def test_normal_form_covers_every_byte_once(source):
    plain, spans = kernels.normalize(source)
    assert [s[0] for s in spans] == [0, *[s[1] for s in spans]][: len(spans)]
    assert (spans[-1][1] if spans else 0) == len(plain.encode())
    assert all(0 <= s[2] < s[3] <= len(source.encode()) for s in spans)
    assert "  " not in plain and plain == plain.strip()


def test_window_owns_quotes_that_begin_in_its_core():
    source = "alpha beta. " * 20
    cores = kernels.windows(source, 60, 24)
    assert kernels.owns(cores[1], source, "alpha")
    assert not kernels.owns((0, 5, 0, 12), source, "beta")


PAGE = "<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body><nav><a href='/a'>A  b</a></nav><div class='body main'><p>one <b>two</b></p></div><table><tr><th>x</th><td>1 <i>2</i></td></tr><tr><td>y</td></tr></table></body></html>"


def test_html():
    assert kernels.visible(PAGE).split("\n") == ["T", "A b", "one two", "x1 2", "y"]
    parsed = kernels.page(PAGE)
    assert parsed.tables == [[["x", "1 2"], ["y"]]] and parsed.links == [["/a", "A  b"]]
    assert kernels.article(PAGE, [("class", "main")]) == "one two"
    assert kernels.article(PAGE, [("tag", "tr")]) == kernels.visible(PAGE)


def test_json_text():
    lines, spans = kernels.json_text('{"a/b": ["x", 2, null], "c": {"d": true}}')
    assert lines == "x\n2\ntrue"
    assert spans == [("/a~1b/0", 0, 1), ("/a~1b/1", 2, 3), ("/c/d", 4, 8)]


def test_literals():
    assert kernels.literal("vieta l’accesso\n  al ponte", "l'accesso al") == "l’accesso\n  al"
    assert kernels.literal("abc", "x") is None and kernels.literal("abc", " ") is None
    assert kernels.word_bounds("il ponte nuovo", 3, 8) and not kernels.word_bounds("il ponte nuovo", 3, 7)


def test_cover_density():
    assert retrieval.cover_density("the cat and the dog", ["cat", "dog"]) == pytest.approx(1 / 3)
    assert retrieval.cover_density("cat dog", ["cat", "dog"]) == 1.0
    assert retrieval.cover_density("cat", ["cat", "dog"]) == 0.0


def test_geometry():
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], dtype=float)
    far = square + 10
    assert kernels.contains(square, np.array([1, 5]), np.array([1, 1])).tolist() == [True, False]
    assert kernels.distance(square, 6, 2) == pytest.approx(2)
    assert kernels.labelled([square, far], 2, 2) == 0 and kernels.labelled([square, square], 2, 2) is None
    assert kernels.labelled([square, far], 5, 2) is None and kernels.labelled([square, far], 5, 2, reach=1) == 0
    levels = {"red": (255, 0, 0), "yellow": (255, 255, 0)}
    assert kernels.palette((253, 3, 4), levels) == "red" and kernels.palette((240, 0, 0), levels) is None
    assert kernels.lines_of_words([(9, 1, "b"), (1, 1.5, "a"), (1, 8, "c")]) == ["a b", "c"]


def test_dot_product(spark):
    rows = spark.createDataFrame([([0.6, 0.8], [0.6, 0.8]), ([1.0], [1.0, 2.0]), ([2.0], [2.0])], "a array<float>, b array<float>")
    assert [r.x for r in rows.select(F.round(retrieval.dot(F.col("a"), F.col("b")), 5).alias("x")).collect()] == [1.0, None, 1.0]


def test_invariants(spark):
    rows = spark.createDataFrame(
        [("interval", "2026-01-01", "2026-01-02"), ("interval", "2026-01-02", "2026-01-01"), ("instant", None, None), ("odd", None, None), ("unknown", None, None)], "precision string, valid_from string, valid_until string"
    )
    assert [(r.precision, r.broken) for r in checks.violations(rows, checks.TEMPORAL).collect()] == [("interval", ["end"]), ("instant", ["anchor"]), ("odd", ["anchor", "kind"])]


def test_seeded_random_kernels_agree_with_plain_code():
    rng = random.Random(0)
    for _ in range(50):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        whole = " ".join(words)
        assert (retrieval.cover_density(whole, ["a"]) > 0) == ("a" in words)


def test_bound_of_every_text(spark, tmp_path):
    from annalist.plans import registry

    texts = [None, "", "Plain words that go beyond the bound", *("x" * k + c * 9 for k in range(17, 21) for c in "aé日😀"), "Perché né " * 5, "日本 " * 9]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.item_id: (r.head, r.bounded) for r in registry.QUERIES["head_and_bound"](spark, str(tmp_path)).collect()}
    words = lambda t: [w for w in re.split(r"[\W\d_]+", unicodedata.normalize("NFC", t).lower()) if len(w) > 3]
    wanted = [("", None) if t is None else ((words(t) or [""])[0][:6], t.encode()[:20].decode(errors="ignore")) for t in texts]
    assert [found[i] for i in range(len(texts))] == wanted
