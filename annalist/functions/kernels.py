"""Text and geometry kernels for which there is no built-in function, as Arrow-batched UDFs.

Offsets are bytes of UTF-8 and ranges half open, unless said otherwise.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _list(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(struct(**fields))


#: Texts that are Python objects at a time, and rows that leave Python together.
TEXTS_AT_ONCE, ROWS_AT_ONCE = 32, 2048


def rows_of(df: DataFrame, found: Callable[..., Iterable[tuple]], schema: T.StructType) -> DataFrame:
    """The rows that `found` gives for the values of each row. Of a batch, which may hold thousands of long texts, few are objects at a time, and what they give leaves in small batches, so a task's memory does not grow with its rows."""
    arrow = to_arrow_schema(schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                out: list[tuple] = []
                for row in zip(*(c.to_pylist() for c in batch.slice(i, TEXTS_AT_ONCE).columns), strict=True):
                    for one in found(*row):
                        out.append(one)
                        if len(out) == ROWS_AT_ONCE:
                            yield batch_of(out)
                            out = []
                if out:
                    yield batch_of(out)

    return df.mapInArrow(run, schema)


INT, TEXT, DAY = T.IntegerType(), T.StringType(), T.DateType()

# ---- normal form with a map back to the source

_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_QUOTES = "‘’ʼ"
_TOKEN = re.compile(rf"(?P<space>[{_WHITE}]+)|(?P<head>#+)|(?P<mark>\*\*|__|~~|`)|(?P<quote>[{_QUOTES}])|(?P<text>[^{_WHITE}#*_~`{_QUOTES}]+|.)", re.S)
SPANS = _list(normalized_start=INT, normalized_end=INT, source_start=INT, source_end=INT)


def normalize(source: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """Text without heading marks and paired emphasis marks, with single spaces and plain apostrophes.

    A heading mark is one to six # at the beginning of a line with white space behind. The marks **, __, ~~
    and ` go in pairs only: one opens if the same mark follows anywhere, the next closes it; others stay. Each
    span maps bytes of the result to bytes of the source; every byte of the result is in exactly one. Neighbours
    of which no byte changed are one span.
    """
    last = {mark: source.rfind(mark) for mark in ("**", "__", "~~", "`")}
    out, spans, opened, at, done, gap, line = [], [], set(), 0, 0, None, True

    def put(text: str, size: int, begin: int, end: int) -> None:
        nonlocal done
        kept = size == end - begin
        if spans and kept and spans[-1][4] and spans[-1][3] == begin:
            spans[-1] = (spans[-1][0], done + size, spans[-1][2], end, True)
        else:
            spans.append((done, done + size, begin, end, kept))
        out.append(text)
        done += size

    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m[0]
        begin, at = at, at + len(text.encode("utf-8", "surrogatepass"))
        if kind == "space":
            gap = (gap[0] if gap else begin, at)
            line = line or "\n" in text or "\r" in text
            continue
        if kind == "head" and line and len(text) <= 6 and m.end() < len(source) and re.match(f"[{_WHITE}]", source[m.end()]):
            continue
        line = False
        if kind == "mark" and (text in opened or last[text] >= m.end()):
            opened ^= {text}
            continue
        if gap and out:
            put(" ", 1, *gap)
        gap = None
        put("'" if kind == "quote" else text, 1 if kind == "quote" else at - begin, begin, at)
    return "".join(out), [x[:4] for x in spans]


def source_range(spans: list, start: int, end: int) -> tuple[int, int] | None:
    """Bytes of the source behind bytes [start, end) of the normal form."""
    if not spans or not 0 <= start < end <= spans[-1][1]:
        return None
    first = spans[bisect.bisect_right([s[1] for s in spans], start)]
    last = spans[bisect.bisect_left([s[0] for s in spans], end) - 1]
    same = lambda s: s[1] - s[0] == s[3] - s[2]
    begin = first[2] + (start - first[0] if same(first) else 0)
    stop = last[3] - (last[1] - end if same(last) else 0)
    return (begin, stop) if begin < stop else None


@F.pandas_udf(T.StructType([T.StructField("text", TEXT), T.StructField("spans", SPANS)]))
def normalized(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else normalize(t) for t in texts]
    names = ("normalized_start", "normalized_end", "source_start", "source_end")
    return pd.DataFrame({"text": [r[0] for r in rows], "spans": [None if r[1] is None else [dict(zip(names, s, strict=True)) for s in r[1]] for r in rows]})


# ---- segments and windows

#: Segments and windows of one document at most; documents with more are refused.
MOST_SEGMENTS, MOST_WINDOWS = 512, 1536


def _character(data: bytes, at: int) -> int:
    """The last place up to `at` that does not split a character."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return min(at, len(data))


def _filled(data: bytes, at: int) -> int:
    """The first place from `at` on that holds no blank."""
    return len(data) - len(data[at:].lstrip(b" "))


def segment(text: str, limit: int = 12 * 1024) -> list[tuple[int, int]] | None:
    """Ranges of at most `limit` bytes, none beginning with a blank, each cut before the last blank of its last quarter if there is one.

    Null (refused) where nothing is left, or where there would be more than MOST_SEGMENTS.
    """
    data, out = text.encode("utf-8", "surrogatepass"), []
    at = _filled(data, 0)
    while at < len(data) and len(out) <= MOST_SEGMENTS:
        end = len(data)
        if end - at > limit:
            end = _character(data, at + limit)
            blank = data.rfind(b" ", at + 3 * limit // 4, end)
            end = blank if blank >= 0 else end
        out.append((at, end))
        at = _filled(data, end)
    return out if 0 < len(out) <= MOST_SEGMENTS else None


def windows(text: str, core: int = 4096, context: int = 1024) -> list[tuple[int, int, int, int]] | None:
    """Cores of at most `core` bytes, none beginning with a blank, each inside a range with context of up to `context` bytes on both sides.

    A core ends behind the last sentence of its second half, else behind its last blank there, else between
    characters. Context begins at the first sentence, else the first word, of the bytes allowed, and ends with the
    first sentence, else before the last blank. A sentence ends with one of .!?;: before a blank or the end.
    Null (refused) where nothing is left, or where there would be more than MOST_WINDOWS.
    """
    data, out = text.encode("utf-8", "surrogatepass"), []
    raw = np.frombuffer(data, dtype=np.uint8)
    blanks = np.flatnonzero(raw == 32) + 1  # places behind a blank
    stops = np.flatnonzero(np.isin(raw, np.frombuffer(b".!?;:", dtype=np.uint8)) & np.append(raw[1:] == 32, True)[: len(raw)]) + 1

    def first(places: np.ndarray, low: int, high: int) -> int | None:
        """The first of the places in [low, high)."""
        i = int(np.searchsorted(places, low))
        return int(places[i]) if i < len(places) and places[i] < high else None

    def last(places: np.ndarray, low: int, high: int) -> int | None:
        """The last of the places in (low, high]."""
        i = int(np.searchsorted(places, high, "right")) - 1
        return int(places[i]) if i >= 0 and places[i] > low else None

    at = _filled(data, 0)
    while at < len(data) and len(out) <= MOST_WINDOWS:
        end = len(data)
        if end - at > core:
            most = _character(data, at + core)
            end = last(stops, at + core // 2, most) or last(blanks, at + core // 2, most) or most
        begin, stop = at, end
        if at > 0 and context:
            least = max(0, at - context)
            while least < at and data[least] & 0xC0 == 0x80:
                least += 1
            begin = 0 if least == 0 else first(stops, least, at) or first(blanks, least, at) or least
        if end < len(data) and context:
            most = _character(data, end + context)
            stop = first(stops, end + 1, most + 1) or (last(blanks, end, most) or most + 1) - 1
        out.append((at, end, begin, stop))
        at = _filled(data, end)
    return out if 0 < len(out) <= MOST_WINDOWS else None


def owns(core: tuple[int, int, int, int], text: str, quote: str) -> bool:
    """Whether a quote in a window begins in its core."""
    data, wanted = text.encode("utf-8", "surrogatepass"), quote.encode("utf-8", "surrogatepass")
    at = data.find(wanted, core[2], core[3]) if wanted else -1
    while at >= 0:
        if core[0] <= at < core[1]:
            return True
        at = data.find(wanted, at + 1, core[3])
    return False


def window_rows(key: int, text: str | None) -> Iterator[tuple]:
    """Key, ordinal and window, of each window of a text; one row without them for a refused or null text."""
    found = None if text is None else windows(text)
    yield from ((key, n, *w) for n, w in enumerate(found, 1)) if found else [(key,) + (None,) * 5]


def owned_quotes(key: int, text: str, quote: str) -> Iterator[tuple[int, int, bool]]:
    """Key, ordinal and whether it owns the quote, of each window of a text; none for a refused text."""
    for n, core in enumerate(windows(text) or (), 1):
        yield key, n, owns(core, text, quote)


@F.pandas_udf(T.BooleanType())
def owned(window: pd.DataFrame, text: pd.Series, quote: pd.Series) -> pd.Series:
    cores = zip(window["core_start"], window["core_end"], window["start"], window["end"], strict=True)
    return pd.Series([owns(c, t, q) for c, t, q in zip(cores, text, quote, strict=True)])


@F.pandas_udf(_list(ordinal=INT, start=INT, end=INT))
def segments(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None or (found := segment(t)) is None else [{"ordinal": i, "start": a, "end": b} for i, (a, b) in enumerate(found, 1)])


@F.pandas_udf(_list(ordinal=INT, core_start=INT, core_end=INT, start=INT, end=INT))
def operational_windows(texts: pd.Series) -> pd.Series:
    names = ("core_start", "core_end", "start", "end")
    return texts.map(lambda t: None if t is None or (found := windows(t)) is None else [{"ordinal": i, **dict(zip(names, w, strict=True))} for i, w in enumerate(found, 1)])


# ---- HTML


#: What stands between < and > of a plain tag, and its attributes; elements whose content is no markup are left to the parser.
_TAG, _ATTRIBUTE = re.compile(r'(/?)([a-z][a-z0-9]*)((?: +[a-z][a-z0-9-]*="[^"&]*")*)'), re.compile(r'([a-z][a-z0-9-]*)="([^"]*)"')
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}
#: Characters of tags that are kept with what they say.
_SHORT = 128


def _parsed_tag(raw: str) -> tuple[bool, str, list[tuple[str, str]]] | None:
    """Whether a plain tag ends an element, its name and attributes."""
    m = _TAG.fullmatch(raw)
    if m is None or m[2] in _RAW or (m[1] and m[3]):
        return None
    return bool(m[1]), m[2], _ATTRIBUTE.findall(m[3])


_known_tag = lru_cache(maxsize=4096)(_parsed_tag)


class Markup(HTMLParser):
    """The parser, with a short way through pages of plain tags only: the same calls in the same order. Any other page goes the parser's way from its beginning."""

    def feed(self, data: str) -> None:
        if self.rawdata or self.cdata_elem is not None:  # in the middle of a page
            return super().feed(data)
        first, *pieces = data.split("<")
        found = [(None, first)]
        for piece in pieces:
            raw, closed, text = piece.partition(">")
            tag = (_known_tag(raw) if len(raw) <= _SHORT else _parsed_tag(raw)) if closed else None
            if tag is None:
                return super().feed(data)
            found.append((tag, text))
        for tag, text in found:
            if tag is not None:
                if tag[0]:
                    self.handle_endtag(tag[1])
                else:
                    self.handle_starttag(tag[1], tag[2])
            if text:
                self.handle_data(unescape(text) if "&" in text else text)


class _Page(Markup):
    """Visible text, tables of cells, links, and text below elements that match a selector."""

    HIDDEN, BLOCKS = {"script", "style", "noscript", "template"}, {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "table", "section", "article", "nav", "ul", "title", "head"}
    VOID = {"br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "embed", "track", "wbr"}

    def __init__(self, selector: tuple[str, str] | None = None):
        super().__init__(convert_charrefs=True)
        self.selector, self.hidden, self.open = selector, 0, []
        self.text, self.tables, self.links, self.matches = [], [], [], []
        self.rows: list[list] = []

    def _matches(self, tag, attributes) -> bool:
        if self.selector is None:
            return False
        name, value = self.selector
        return tag == value if name == "tag" else value in (attributes.get(name) or "").split()

    def handle_starttag(self, tag, attrs):
        attributes = dict(attrs)
        if tag in self.BLOCKS:
            self.text.append("\n")
        if tag in self.VOID:
            return
        self.open.append((tag, self._matches(tag, attributes)))
        self.hidden += tag in self.HIDDEN
        if self.open[-1][1]:
            self.matches.append([])
        if tag == "a" and attributes.get("href"):
            self.links.append([attributes["href"], ""])
        if tag == "table":
            self.tables.append([])
            self.rows.append(self.tables[-1])
        elif tag == "tr" and self.rows:
            self.rows[-1].append([])
        elif tag in ("td", "th") and self.rows and self.rows[-1]:
            self.rows[-1][-1].append("")

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            last, _ = self.open.pop()
            self.hidden -= last in self.HIDDEN
            if last == "table" and self.rows:
                self.rows.pop()
            if last == tag:
                break
        if tag in self.BLOCKS:
            self.text.append("\n")

    def handle_data(self, data):
        if self.hidden:
            return
        self.text.append(data)
        tags = [t for t, _ in self.open] if self.links or self.rows else ()
        if "a" in tags and self.links:
            self.links[-1][1] += data
        if self.rows and self.rows[-1] and self.rows[-1][-1] and {"td", "th"} & set(tags):
            self.rows[-1][-1][-1] += data
        if self.matches and any(m for _, m in self.open):
            self.matches[-1].append(data)


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def page(html: str, selector: tuple[str, str] | None = None) -> _Page:
    parsed = _Page(selector)
    parsed.feed(html)
    parsed.close()
    return parsed


def _lines(parsed: _Page) -> str:
    lines = (_squeeze(line) for line in "".join(parsed.text).split("\n"))
    return "\n".join(line for line in lines if line)


def visible(html: str) -> str:
    """Text outside scripts, styles and the like, a line per block."""
    return _lines(page(html))


def article(html: str, selectors: list[tuple[str, str]]) -> str:
    """Text below the one element that matches a selector; the whole visible text unless each matches exactly once."""
    pages = [page(html, s) for s in selectors] or [page(html)]
    found = [p.matches for p in pages]
    return "\n".join(_squeeze("".join(m[0])) for m in found) if all(len(m) == 1 for m in found) else _lines(pages[0])


_PAGE = T.StructType([T.StructField("text", TEXT), T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(TEXT)))), T.StructField("links", _list(url=TEXT, label=TEXT))])


@F.pandas_udf(_PAGE)
def parsed_html(html: pd.Series) -> pd.DataFrame:
    """Visible text, tables and links of a page, parsed once. Tables without rows are left out."""
    pages = [None if h is None else page(h) for h in html]
    text = [None if p is None else "\n".join(x for x in map(_squeeze, "".join(p.text).split("\n")) if x) for p in pages]
    tables = [None if p is None else [[[_squeeze(c) for c in row] for row in t if row] for t in p.tables if any(t)] for p in pages]
    links = [None if p is None else [{"url": u, "label": _squeeze(t)} for u, t in p.links] for p in pages]
    return pd.DataFrame({"text": pd.Series(text, dtype=object), "tables": pd.Series(tables, dtype=object), "links": pd.Series(links, dtype=object)})


def page_counts(key: int, html: str | None) -> Iterator[tuple[int, str | None, int | None, int | None]]:
    """Key, visible text, number of tables with rows and number of links of a page."""
    if html is None:
        yield key, None, None, None
    else:
        p = page(html)
        yield key, "\n".join(x for x in map(_squeeze, "".join(p.text).split("\n")) if x), sum(any(t) for t in p.tables), len(p.links)


@F.pandas_udf(TEXT)
def visible_html(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else visible(h))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(TEXT))))
def html_tables(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else [[[_squeeze(c) for c in row] for row in t] for t in page(h).tables])


@F.pandas_udf(_list(url=TEXT, label=TEXT))
def html_links(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else [{"url": u, "label": _squeeze(t)} for u, t in page(h).links])


def article_column(selectors: list[tuple[str, str]]):
    def bodies(html: pd.Series) -> pd.Series:
        return html.map(lambda h: None if h is None else article(h, selectors))

    return F.pandas_udf(bodies, TEXT)


# ---- JSON


def json_text(raw: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The scalars of a JSON document, a line each, and the pointer and byte range of each line."""
    lines, spans, at = [], [], 0
    todo = [("", json.loads(raw))]
    while todo:
        pointer, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", v) for k, v in reversed(list(value.items()))]
        elif isinstance(value, list):
            todo += [(f"{pointer}/{i}", v) for i, v in reversed(list(enumerate(value)))]
        elif value is not None:
            line = value if isinstance(value, str) else json.dumps(value)
            n = len(line.encode())
            lines.append(line)
            spans.append((pointer, at, at + n))
            at += n + 1
    return "\n".join(lines), spans


@F.pandas_udf(T.StructType([T.StructField("text", TEXT), T.StructField("spans", _list(pointer=TEXT, start=INT, end=INT))]))
def json_lines(raw: pd.Series) -> pd.DataFrame:
    """Text and spans of JSON documents; null where one is broken."""
    found = []
    for value in raw:
        try:
            found.append((None, None) if value is None else json_text(value))
        except ValueError:
            found.append((None, None))
    spans = [None if s is None else [dict(zip(("pointer", "start", "end"), x, strict=True)) for x in s] for _, s in found]
    return pd.DataFrame({"text": pd.Series([t for t, _ in found], dtype=object), "spans": pd.Series(spans, dtype=object)})


# ---- literals


def literal(source: str, quote: str) -> str | None:
    """The exact part of the source that a quote stands for, white space and apostrophes aside."""
    parts = [re.escape(p) for p in re.sub("[’‘ʼ]", "'", quote).split()]
    if not parts:
        return None
    pattern = r"\s+".join(p.replace("'", "['’‘ʼ]") for p in parts)
    found = re.search(pattern, source)
    return found[0] if found else None


def word_bounds(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] begins and ends between words."""
    return not ((start > 0 and text[start - 1].isalnum() and text[start].isalnum()) or (end < len(text) and text[end - 1].isalnum() and text[end].isalnum()))


# ---- lexical rank


def rank_column(query: list[str]):
    """Cover density of a text for the words of a query."""
    from annalist.operators.retrieval import cover_density

    return F.pandas_udf(lambda texts: texts.map(lambda t: cover_density(t or "", query)), T.DoubleType())


# ---- geometry


def contains(polygon: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points lie inside, by counting crossings. Points on left and lower edges are inside, on others outside."""
    ax, ay = polygon[:, 0], polygon[:, 1]
    bx, by = np.roll(ax, -1), np.roll(ay, -1)
    px, py = np.asarray(x)[:, None], np.asarray(y)[:, None]
    crosses = (ay > py) != (by > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = ax + (py - ay) * (bx - ax) / (by - ay)
    return (np.where(crosses, px < at, False).sum(axis=1) % 2).astype(bool)


def distance(polygon: np.ndarray, x: float, y: float) -> float:
    """Distance of a point to the polygon's outline."""
    a, b = polygon, np.roll(polygon, -1, axis=0)
    d, p = b - a, np.array([x, y])
    length = np.maximum((d**2).sum(axis=1), 1e-300)
    t = np.clip(((p - a) * d).sum(axis=1) / length, 0, 1)
    return float(np.sqrt((((a + t[:, None] * d) - p) ** 2).sum(axis=1)).min())


def labelled(polygons: list[np.ndarray], x: float, y: float, reach: float = 0.0) -> int | None:
    """The only polygon with a label's point inside, or the only one whose outline is within reach."""
    inside = [i for i, p in enumerate(polygons) if contains(p, np.array([x]), np.array([y]))[0]]
    if inside:
        return inside[0] if len(inside) == 1 else None
    near = [i for i, p in enumerate(polygons) if distance(p, x, y) <= reach] if reach else []
    return near[0] if len(near) == 1 else None


def palette(rgb: tuple[int, int, int], levels: dict[str, tuple[int, int, int]], tolerance: int = 4) -> str | None:
    """The level whose colour is within tolerance in each channel, if it is the only one."""
    hit = [name for name, colour in levels.items() if max(abs(a - b) for a, b in zip(rgb, colour, strict=True)) <= tolerance]
    return hit[0] if len(hit) == 1 else None


def lines_of_words(words: list[tuple[float, float, str]], tolerance: float = 1.0) -> list[str]:
    """Words at (x, y) put together to lines: y within tolerance of the line's first, then by x."""
    lines: list[list[tuple[float, float, str]]] = []
    for word in sorted(words, key=lambda w: (w[1], w[0])):
        if lines and abs(lines[-1][0][1] - word[1]) <= tolerance:
            lines[-1].append(word)
        else:
            lines.append([word])
    return [" ".join(w[2] for w in sorted(line)) for line in lines]
