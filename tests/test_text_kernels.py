"""Normal forms, segments, windows and parsers against plain versions, over every document and on random strings."""

import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annalist.functions import kernels, markup, wording
from annalist.operators import lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None]


# ---- plain versions


def plain_normal(source):
    """Character by character; each character of the result with its bytes of the source."""
    out, line, gap, on = [], True, None, set()
    size = lambda a, b: (len(source[:a].encode()), len(source[:b].encode()))
    white = lambda c: c in "\t\n\v\f\r \x85\xa0　"
    i = 0
    while i < len(source):
        c = source[i]
        if white(c):
            gap = (gap[0] if gap else i, i + 1)
            line = line or c in "\r\n"
            i += 1
            continue
        if line and c == "#":
            n = 0
            while n < 6 and source[i + n : i + n + 1] == "#":
                n += 1
            if i + n < len(source) and white(source[i + n]):
                i += n
                continue
        line = False
        mark = source[i : i + 2] if source[i : i + 2] in ("**", "__", "~~") else c if c == "`" else None
        if mark and (mark in on or mark in source[i + len(mark) :]):
            on ^= {mark}
            i += len(mark)
            continue
        if gap and out:
            out.append((" ", *size(*gap)))
        gap = None
        out.append(("'" if c in "‘’ʼ" else c, *size(i, i + 1)))
        i += 1
    return out


def plain_segments(data, limit):
    out, at = [], 0
    while True:
        while at < len(data) and data[at] == 32:
            at += 1
        if at >= len(data):
            break
        end = len(data)
        if end - at > limit:
            end = at + limit
            while data[end] & 0xC0 == 0x80:
                end -= 1
            cuts = [i for i in range(at + 3 * limit // 4, end) if data[i] == 32]
            end = cuts[-1] if cuts else end
        out.append((at, end))
        at = end
    return out if out and len(out) <= 512 else None


def plain_windows(data, core, context):
    starts = lambda i: i == len(data) or data[i] & 0xC0 != 0x80
    stop = lambda i: data[i - 1] in b".!?;:" and (i == len(data) or data[i] == 32)
    out, at = [], 0
    while True:
        while at < len(data) and data[at] == 32:
            at += 1
        if at >= len(data):
            break
        end = len(data)
        if end - at > core:
            most = max(i for i in range(at, at + core + 1) if starts(i))
            inside = range(at + core // 2 + 1, most + 1)
            end = max([i for i in inside if stop(i)] or [i for i in inside if data[i - 1] == 32] or [most])
        begin, upto = at, end
        if at and context:
            least = min(i for i in range(max(0, at - context), at + 1) if starts(i))
            inside = range(least, at)
            begin = 0 if not least else min([i for i in inside if stop(i)] or [i for i in inside if data[i - 1] == 32] or [least])
        if end < len(data) and context:
            most = max(i for i in range(end, min(len(data), end + context) + 1) if starts(i))
            inside = range(end + 1, most + 1)
            sentence = [i for i in inside if stop(i)]
            upto = min(sentence) if sentence else max([i - 1 for i in inside if data[i - 1] == 32] or [most])
        out.append((at, end, begin, upto))
        at = end
    return out if out and len(out) <= 1536 else None


def same_normal(source):
    text, spans = kernels.normalize(source)
    plain = plain_normal(source)
    assert text == "".join(c for c, _, _ in plain)
    at = 0
    for c, begin, end in plain:
        n = len(c.encode())
        if begin < end:
            assert kernels.source_range(spans, at, at + n) == (begin, end)
        at += n
    for a, b in zip(spans, spans[1:], strict=False):  # as few spans as can be
        kept = lambda s: s[1] - s[0] == s[3] - s[2]
        assert a[1] == b[0] and not (kept(a) and kept(b) and a[3] == b[2])


# ---- every document, and random strings


def test_every_document(texts):
    for text in texts:
        data = text.encode()
        assert kernels.segment(text) == plain_segments(data, 12288)
        assert kernels.segment(text, 100) == plain_segments(data, 100)
        assert kernels.windows(text) == plain_windows(data, 4096, 1024)
    for text in texts[:60]:
        same_normal(text[:3000])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #*_~`é’\n\t日\xa0", max_size=60))
def test_normal_form_is_the_plain_one(source):
    same_normal(source)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .;é日\n", max_size=300), st.integers(32, 60), st.integers(0, 20))
def test_cuts_are_the_plain_ones(source, size, context):
    data = source.encode()
    assert kernels.windows(source, size, context) == plain_windows(data, size, context)
    assert kernels.segment(source, size) == plain_segments(data, size)


def test_refused():
    assert kernels.segment("") is None and kernels.segment("   ") is None and kernels.windows(" ") is None
    assert kernels.segment("ab " * 60_000, 100) is None and len(kernels.segment("ab" * 25_600, 100)) == 512
    assert kernels.normalize("3 * 4 = 12 and ~~x~~ __y z")[0] == "3 * 4 = 12 and x __y z"


def test_registered_kernels_cover_every_document(spark, texts):
    from annalist.plans import registry

    found = {}
    for r in registry.QUERIES["all_segments"](spark, SF).collect():
        found.setdefault(r.doc_id, []).append((r.ordinal, r.start, r.end))
    windows = {}
    for r in registry.QUERIES["operational_windows"](spark, SF).collect():
        windows.setdefault(r.doc_id, []).append((r.ordinal, r.core_start, r.core_end, r.start, r.end))
    normal = {r.doc_id: r.text for r in registry.QUERIES["normalized_text"](spark, SF).collect()}
    quoted = {(r.doc_id, r.ordinal): r.owned for r in registry.QUERIES["owned_quotes"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        data = (r.text or "").encode()
        wanted = plain_segments(data, 12288)
        assert sorted(found[r.doc_id], key=str) == sorted([(i, a, b) for i, (a, b) in enumerate(wanted, 1)] if wanted else [(None, None, None)], key=str)
        wanted = plain_windows(data, 4096, 1024)
        assert sorted(windows[r.doc_id], key=str) == sorted([(i, *w) for i, w in enumerate(wanted, 1)] if wanted else [(None,) * 5], key=str)
        if r.text is not None:
            assert normal[r.doc_id] == "".join(c for c, _, _ in plain_normal(r.text))
            quote = r.text[5000:5030].encode()
            for i, (a, b, low, high) in enumerate(wanted or [], 1) if quote else ():
                places = [m.start() for m in re.finditer(b"(?=" + re.escape(quote) + b")", data)]
                assert quoted[(r.doc_id, i)] == any(a <= p < b and low <= p and p + len(quote) <= high for p in places)


# ---- parsers


def test_references_to_acts():
    seen = lambda t: [(r["kind"], r["number"], r["year"]) for r in wording.references(t)]
    assert seen("Vista l'ordinanza sindacale n. 38/2026, decreto n° 0034 del 20/08/2026.") == [("ordinanza", 38, 2026), ("decreto", 34, 2026)]
    assert seen("Non è prevista alcuna ordinanza n. 5/2026. Con decreto si ordina") == [("decreto", None, None)]
    assert seen("Qualora necessario potrà essere emessa apposita ordinanza di chiusura.") == []
    assert seen("ordinanza n. 3 del 31/02/2026") == [("ordinanza", 3, None)]
    assert seen("n. 1 " * 3) == []
    assert wording.references("ordinanza n. 3 del 28/02/2026")[0]["day"] == dt.date(2026, 2, 28)


def test_clauses():
    text = "la chiusura non conta ORDINA a partire dalle ore 00.00 del giorno 10 settembre 2026, fino alle ore 8:30 del giorno 11 settembre 2026: la chiusura del parco; il divieto\ndi sosta. AVVERTE la sospensione"
    found = wording.clause(text)
    assert (found["start"], found["end"]) == (dt.datetime(2026, 9, 10), dt.datetime(2026, 9, 11, 8, 30))
    assert [(d["kind"], d["text"]) for d in found["dispositions"]] == [("closure", "la chiusura del parco;"), ("prohibition", "il divieto di sosta.")]
    assert wording.clause(text.replace("11 settembre", "9 settembre")) is None and wording.clause(text.replace("ORDINA", "DECRETA")) is None
    assert wording.clause(text.replace("fino alle ore 8:30 del giorno 11 settembre 2026", "fino al perdurare dell'emergenza"))["condition"] == "fino al perdurare dell'emergenza"


def test_linked_files():
    page = "<div class='x content'><a href='../f.pdf#p'>f</a><a href='//h.example/G.PDF'>g</a><nav><a href='n.pdf'>n</a></nav></div><a href='o.pdf'>o</a>"
    assert markup.linked_files(page, "https://a.example/b/c/", "content") == ["https://a.example/b/f.pdf", "https://h.example/G.PDF"]
    assert markup.linked_files(page, "https://a.example/", "absent") is None
    assert len(markup.linked_files(page, "https://a.example/")) == 4


def chunk(kind, data):
    import struct
    import zlib

    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def test_stable_bytes_of_images():
    parts = [chunk(b"IHDR", b"x" * 13), chunk(b"tIME", b"1234567"), chunk(b"tEXt", b"date:modify\x002026-01-01T00:00:00+01:00"), chunk(b"tEXt", b"date:modify\x00never"), chunk(b"IEND", b"")]
    raw = markup.PNG + b"".join(parts)
    assert markup.stable_bytes(raw, "image/PNG; q=1") == markup.PNG + parts[0] + parts[3] + parts[4]
    for broken in (raw[:-1], raw + b"x", raw.replace(b"IEND", b"IENX"), b"x" + raw):
        assert markup.stable_bytes(broken, "image/png") == broken
    assert markup.stable_bytes(raw, "text/plain") == raw


def test_cycles_have_no_root(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 6), (6, 4), (7, 4), (8, 8)], "n long, p long")
    found = {r.n: (r.root, r.depth) for r in lineage.roots(rows, "n", "p").collect()}
    assert found == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None), 8: (None, None)}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a long, b long")
    assert sorted(r.x for r in lineage.reachable(edges, "a", "b", spark.createDataFrame([(1,)], "x long")).collect()) == [1, 2, 3]


def test_listings():
    page = "<a href='/d/one'> One </a><ul><li class='i'><a href='/d/two#x'>t</a><a href='/d/two'>Two</a><i class='w'> </i><i class='w'>Data:  3  mag  2031</i></li><li class='i'><a href='/d/'>d</a></li></ul><a href='https://u@h.example/d/x'>u</a>"
    found = markup.listing(page, "https://h.example/l", ["/d/"], "i", "w")
    assert found == [{"url": "https://h.example/d/one", "title": "One", "date": None}, {"url": "https://h.example/d/two", "title": "Two", "date": "Data: 3 mag 2031"}]
    assert [d["date"] for d in markup.listing(page, "https://h.example/l", ["/d/"], "i", "w", "Data:")] == [None, "3 mag 2031"]
    assert [d["date"] for d in markup.listing(page, "https://h.example/l", ["/d/"], "i", "w", "Giorno:")] == [None, None]
    assert markup.listing(page, "https://other.example/l", ["/x/"], "i", "w") == [] and markup.listing("", "", []) == []


def test_stable_bytes_of_generated_pdf():
    raw = b"%PDF-1.7 /Producer (TCPDF 6) /M (D:20260101120000+01'00') /ModDate (yesterday) <xmp:CreateDate>2026-01-01T12:00:00-01:00</xmp:CreateDate><xmpMM:DocumentID>uuid:" + b"a1-" * 12 + b"</xmpMM:DocumentID> /ID [ <" + b"0f" * 16 + b"> <" + b"0F" * 16 + b"> ]"
    want = b"%PDF-1.7 /Producer (TCPDF 6) /M (D:generated) /ModDate (yesterday) <xmp:CreateDate>generated</xmp:CreateDate><xmpMM:DocumentID>uuid:generated</xmpMM:DocumentID> /ID [ <generated> <generated> ]"
    assert markup.stable_bytes(raw, "application/pdf") == want
    assert markup.stable_bytes(raw.replace(b"TCPDF", b"Other"), "application/pdf") == raw.replace(b"TCPDF", b"Other")
    assert markup.stable_bytes(raw.replace(b"+01'00'", b"+0100"), "application/pdf").count(b"generated") == 4
