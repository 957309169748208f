"""Maps of offsets, windows and segments that carry them, against plain byte-by-byte versions over every document and on random strings."""

import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import types as T

from annalist.functions import kernels, offsets
from annalist.plans import registry

SF = "/root/testdata/sf0.001"
TEXT = st.lists(st.sampled_from([*"ab #*_`~’'\n\t.é日😀", "**", "__", " "]), max_size=60).map("".join)


def plain(pieces):
    """For every byte of the text, the range of its source."""
    out = []
    for a, b, c, d in pieces:
        out += [(c + k, c + k + 1) if b - a == d - c else (c, d) for k in range(b - a)]
    return out


@settings(max_examples=200, deadline=None)
@given(TEXT, st.data())
def test_clipped_shifted_and_composed(source, data):
    text, pieces = kernels.normalize(source)
    size, whole = len(text.encode()), offsets.OffsetMap(pieces)
    if not size:
        assert not whole.valid(0, 0) and whole.source_range(0, 1) is None
        return
    assert whole.valid(0, size)
    a = data.draw(st.integers(0, size - 1))
    b = data.draw(st.integers(a + 1, size))
    part, every = whole.clipped(a, b), plain(pieces)
    assert part.valid(a, b, *whole.source_range(a, b))
    assert plain(part.pieces()) == every[a:b]
    assert whole.source_range(a, b) == (every[a][0], every[b - 1][1]) == kernels.source_range(pieces, a, b)
    assert whole.source_range(a, size + 1) is None
    window = part.shifted(-a)  # the window's own bytes
    assert window.valid(0, b - a) and plain(window.pieces()) == every[a:b]
    below = offsets.OffsetMap([(0, len(source.encode()), 5, 5 + len(source.encode()))])  # the source lies 5 bytes into a file
    assert plain(window.composed(below).pieces()) == [(x + 5, y + 5) for x, y in every[a:b]]


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_composed_maps_of_two_normal_forms(source):
    once, first = kernels.normalize(source)
    twice, second = kernels.normalize(once)
    if twice:
        below, every = plain(first), plain(second)
        found = plain(offsets.OffsetMap(second).composed(offsets.OffsetMap(first)).pieces())
        assert found == [(below[x][0], below[y - 1][1]) for x, y in every]


def test_maps_that_do_not_hold():
    good = [(0, 2, 0, 2), (2, 3, 5, 9)]
    assert offsets.OffsetMap(good).valid(0, 3, 0, 9)
    for bad in ([(0, 2, 0, 2), (3, 4, 5, 9)], [(0, 2, 0, 2), (2, 3, 1, 9)], [(0, 2, 0, 2), (2, 2, 5, 9)], [(1, 3, 0, 9)], [(0, 3, 4, 4)], []):
        assert not offsets.OffsetMap(bad).valid(0, 3)
    assert not offsets.OffsetMap(good).valid(0, 3, 1, 9) and not offsets.OffsetMap(good).valid(0, 3, 0, 8)


def wire(fields):
    """Canonical JSON put together by hand."""
    show = lambda v: str(v) if isinstance(v, int) else "[" + ",".join(map(wire, v)) + "]" if isinstance(v, list) else json.dumps(v, ensure_ascii=False).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    return "{" + ",".join(f'"{k}":{show(v)}' for k, v in fields) + "}"


def sha(fields):
    return hashlib.sha256(wire(fields).encode()).hexdigest()


def test_every_window_leads_back_to_its_source(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = registry.QUERIES["mapped_windows"](spark, SF).collect()
    assert {r.doc_id for r in found} == set(docs)
    seen = {}
    for r in found:
        source = docs[r.doc_id].text.encode()
        text, pieces = kernels.normalize(docs[r.doc_id].text)
        data, every = text.encode(), plain(pieces)
        if r.ordinal is None:
            assert kernels.windows(text) is None
            continue
        seen.setdefault(r.doc_id, []).append((r.core_start, r.core_end, r.start, r.end))
        assert r.text.encode() == data[r.start : r.end]
        assert (r.source_start, r.source_end) == (every[r.start][0], every[r.end - 1][1])
        assert plain([tuple(s) for s in r.spans]) == every[r.start : r.end]
        for k, (a, b) in enumerate(every[r.start : r.end]):  # the same byte, white space for white space, an apostrophe for an apostrophe
            byte = data[r.start + k : r.start + k + 1]
            assert source[a:b] == byte or (byte == b" " and not source[a:b].decode(errors="ignore").strip(" \t\r\n#*_~`\x0b\x0c")) or byte == b"'"
        fields = [("DocumentVersionID", r.doc_id), ("Ordinal", r.ordinal), ("Page", 1), ("ResourceURL", docs[r.doc_id].source or ""), ("Role", "original"), ("ContextStartByte", r.start), ("ContextEndByte", r.end)]
        fields += [("CoreStartByte", r.core_start), ("CoreEndByte", r.core_end), ("SourceStartByte", r.source_start), ("SourceEndByte", r.source_end), ("Text", r.text)]
        assert r.sha256 == sha(fields)
    for doc_id, windows in seen.items():
        assert sorted(windows) == kernels.windows(kernels.normalize(docs[doc_id].text)[0])


def test_segments_of_json_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = registry.QUERIES["json_segments"](spark, SF).collect()
    assert {r.doc_id for r in found} == set(docs)
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    crossing = 0
    for doc_id, rows in by_doc.items():
        d = docs[doc_id]
        values = [("/a~1b/id", str(doc_id)), ("/a~1b/text", d.text), ("/lang/0", d.lang), ("/lang/1", d.source)]
        values = [(p, v) for p, v in values if v is not None]
        data, at, spans = "\n".join(v for _, v in values).encode(), 0, []
        for pointer, value in values:
            spans.append((pointer, at, at + len(value.encode())))
            at += len(value.encode()) + 1
        assert sorted((r.start, r.end) for r in rows) == kernels.segment(data.decode())
        for r in rows:
            held = [(p, max(a, r.start) - r.start, min(b, r.end) - r.start) for p, a, b in spans if a < r.end and b > r.start]
            crossing += any(a < r.start < b for _, a, b in spans)
            assert [tuple(s) for s in r.scalars] == held
            fields = [("DocumentVersionID", doc_id), ("Ordinal", r.ordinal), ("Page", 0), ("StartByte", r.start), ("EndByte", r.end), ("ResourceURL", "https://www.example.org/d.json"), ("Role", "original"), ("Text", data[r.start : r.end].decode())]
            fields += [("JSONScalars", [[("pointer", p), ("start_byte", a), ("end_byte", b)] for p, a, b in held])] if held else []
            assert r.sha256 == sha(fields)
    assert crossing


def test_canonical_json_escapes_what_the_contract_escapes():
    assert offsets.canonical({"b": "<a&b>\u2028é\n\"", "a": 1}) == '{"b":"\\u003ca\\u0026b\\u003e\\u2028é\\n\\"","a":1}'
    assert offsets.identified_segments(1, "", "", 0, "   ") is None and offsets.mapped_windows(1, "", "", 1, " # ") is None


def test_rows_of_texts_leave_python_in_small_batches_and_are_those_of_the_columns(spark, monkeypatch):
    from pyspark.sql import functions as F

    from annalist.functions import kernels, offsets
    from annalist.plans import registry
    from annalist.plans.documents import _AS_JSON

    sf = "/root/testdata/sf0.001"
    docs, shown = spark.read.parquet(f"{sf}/documents.parquet"), lambda df: sorted(map(str, df.collect()))
    got = {name: registry.QUERIES[name](spark, sf) for name in ("operational_windows", "mapped_windows", "json_segments", "owned_quotes", "visible_html")}
    windows = docs.select("doc_id", "text", F.explode_outer(kernels.operational_windows("text")).alias("w"))
    quotes = windows.withColumn("quote", F.substring("text", 5001, 30)).where("quote <> '' AND w IS NOT NULL")
    json = docs.select("doc_id", kernels.json_lines(F.expr(_AS_JSON)).alias("j"))
    segments = offsets.segments_column()("doc_id", F.lit("https://www.example.org/d.json"), "j.text", "j.spans")
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", kernels.parsed_html("html").alias("p"))
    want = {
        "operational_windows": windows.select("doc_id", "w.*"),
        "mapped_windows": docs.select("doc_id", F.explode_outer(offsets.windows_column()("doc_id", "source", "text")).alias("w")).select("doc_id", "w.*"),
        "json_segments": json.select("doc_id", F.explode_outer(segments).alias("s")).select("doc_id", "s.*"),
        "owned_quotes": quotes.select("doc_id", "w.ordinal", kernels.owned("w", "text", "quote").alias("owned")),
        "visible_html": pages.select("page_id", "p.text", F.size("p.tables").alias("tables"), F.size("p.links").alias("links")),
    }
    for name, rows in got.items():
        assert rows.dtypes == want[name].dtypes and shown(rows) == shown(want[name]), name
        assert "MapInArrow" in rows._jdf.queryExecution().toString() and "ArrowEvalPython" not in rows._jdf.queryExecution().toString()
    few = kernels.rows_of(spark.range(100).coalesce(1), lambda n: [(n, k) for k in range(n % 3)], kernels.struct(a=T.LongType(), b=kernels.INT))
    assert few.count() == 99 and kernels.rows_of(spark.range(0), lambda n: [(n,)], kernels.struct(a=T.LongType())).count() == 0
