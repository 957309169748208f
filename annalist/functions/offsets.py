"""Maps between bytes of a text and bytes of what it was made from: clipped, shifted, composed and checked; and windows and segments that carry them.

A map is a sorted array of pieces (start, end, source start, source end). The pieces of the text touch one another, those of the source may leave gaps.
A piece of which both sides are equally long is copied byte by byte (but for apostrophes and white space of the same length); any other piece stands for its source as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.functions import kernels
from annalist.functions.kernels import INT, SPANS, TEXT, struct


class OffsetMap:
    """Pieces as four arrays."""

    def __init__(self, pieces):
        table = np.array(pieces, dtype=np.int64).reshape(-1, 4)
        self.start, self.end, self.source_start, self.source_end = table.T

    @classmethod
    def identity(cls, size: int) -> OffsetMap:
        return cls([(0, size, 0, size)] if size else [])

    def __len__(self) -> int:
        return len(self.start)

    def pieces(self) -> list[tuple[int, int, int, int]]:
        return list(zip(*(c.tolist() for c in (self.start, self.end, self.source_start, self.source_end)), strict=True))

    def valid(self, start: int, end: int, source_start: int | None = None, source_end: int | None = None) -> bool:
        """Whether the pieces fill [start, end) without gaps, and their sources follow one another, from the one end of the source range to the other if that is given."""
        if not len(self) or start >= end:
            return False
        touch = self.start[0] == start and self.end[-1] == end and (self.start[1:] == self.end[:-1]).all()
        forward = (self.start < self.end).all() and (self.source_start < self.source_end).all() and (self.source_start[1:] >= self.source_end[:-1]).all()
        return bool(touch and forward and source_start in (None, self.source_start[0]) and source_end in (None, self.source_end[-1]))

    def clipped(self, start: int, end: int) -> OffsetMap:
        """The pieces of [start, end). A copied piece is cut on both sides; another one that is cut keeps its whole source."""
        first, last = np.searchsorted(self.end, start, "right"), np.searchsorted(self.start, end, "left")
        a, b, c, d = (x[first:last].copy() for x in (self.start, self.end, self.source_start, self.source_end))
        copied = b - a == d - c
        c += np.where(copied, np.maximum(start - a, 0), 0)
        d -= np.where(copied, np.maximum(b - end, 0), 0)
        return OffsetMap(np.stack([np.maximum(a, start), np.minimum(b, end), c, d], axis=1))

    def source_range(self, start: int, end: int) -> tuple[int, int] | None:
        """The bytes of the source behind [start, end); null outside the text."""
        if not len(self) or not self.start[0] <= start < end <= self.end[-1]:
            return None
        part = self.clipped(start, end)
        return int(part.source_start[0]), int(part.source_end[-1])

    def shifted(self, by: int) -> OffsetMap:
        """The map of a text that begins `by` bytes later."""
        return OffsetMap(np.stack([self.start + by, self.end + by, self.source_start, self.source_end], axis=1))

    def composed(self, below: OffsetMap) -> OffsetMap:
        """The map to what the source was made from, `below` being the map of the source.

        Copied pieces are cut where a piece of `below` ends; others stand for all that lies below their source.
        """
        out = []
        for a, b, c, d in self.pieces():
            if b - a == d - c:
                out += [(x + a - c, y + a - c, s, t) for x, y, s, t in below.clipped(c, d).pieces()]
            elif (found := below.source_range(c, d)) is not None:
                out.append((a, b, *found))
        return OffsetMap(out)


def canonical(value) -> str:
    """Compact JSON in the order given, with &, <, > and the two line separators of Unicode escaped, as contracts hash it."""
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    for c in "<>&\u2028\u2029":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def digest(value) -> str:
    return sha256(canonical(value).encode("utf-8", "surrogatepass")).hexdigest()


def mapped_windows(version: int, url: str, role: str, page: int, source: str, core: int = 4096, context: int = 1024) -> list[dict] | None:
    """Windows of the normal form of a page's source, each with its map, the bytes of the source that it covers, and a hash of all that identifies it.

    Null (refused) where the text has no windows, or a map does not hold.
    """
    text, pieces = kernels.normalize(source)
    found = kernels.windows(text, core, context)
    whole, data = OffsetMap(pieces), text.encode("utf-8", "surrogatepass")
    if found is None or not whole.valid(0, len(data)):
        return None
    out = []
    for ordinal, (core_start, core_end, start, end) in enumerate(found, 1):
        part, (low, high) = whole.clipped(start, end), whole.source_range(start, end)
        if not part.valid(start, end, low, high):
            return None
        shown = data[start:end].decode("utf-8", "surrogatepass")
        # The order and the names of what is hashed are fixed values.
        identity = {"DocumentVersionID": version, "Ordinal": ordinal, "Page": page, "ResourceURL": url, "Role": role, "ContextStartByte": start, "ContextEndByte": end, "CoreStartByte": core_start, "CoreEndByte": core_end, "SourceStartByte": low, "SourceEndByte": high, "Text": shown}
        out.append({"ordinal": ordinal, "total": len(found), "core_start": core_start, "core_end": core_end, "start": start, "end": end, "source_start": low, "source_end": high, "text": shown, "sha256": digest(identity), "spans": part.pieces()})
    return out


def identified_segments(version: int, url: str, role: str, page: int, text: str, scalars: list[tuple[str, int, int]] = (), limit: int = 12 * 1024) -> list[dict] | None:
    """Segments of a text, each with the scalars (pointer, start, end) that it holds a part of, cut and counted from its beginning, and a hash. Null where the text is refused."""
    found = kernels.segment(text, limit)
    if found is None:
        return None
    data, out = text.encode("utf-8", "surrogatepass"), []
    names = np.array([s[0] for s in scalars], dtype=object)
    starts, ends = (np.array([s[i] for s in scalars], dtype=np.int64) for i in (1, 2))
    for ordinal, (start, end) in enumerate(found, 1):
        own = np.flatnonzero((starts < end) & (ends > start))
        held = [{"pointer": names[i], "start_byte": max(int(starts[i]), start) - start, "end_byte": min(int(ends[i]), end) - start} for i in own]
        shown = data[start:end].decode("utf-8", "surrogatepass")
        # The order and the names of what is hashed are fixed values.
        identity = {"DocumentVersionID": version, "Ordinal": ordinal, "Page": page, "StartByte": start, "EndByte": end, "ResourceURL": url, "Role": role, "Text": shown} | ({"JSONScalars": held} if held else {})
        out.append({"ordinal": ordinal, "total": len(found), "start": start, "end": end, "sha256": digest(identity), "scalars": [(h["pointer"], h["start_byte"], h["end_byte"]) for h in held]})
    return out


_SCALARS = T.ArrayType(struct(pointer=TEXT, start=INT, end=INT))
WINDOW = T.ArrayType(struct(ordinal=INT, total=INT, core_start=INT, core_end=INT, start=INT, end=INT, source_start=INT, source_end=INT, text=TEXT, sha256=TEXT, spans=SPANS))
SEGMENT = T.ArrayType(struct(ordinal=INT, total=INT, start=INT, end=INT, sha256=TEXT, scalars=_SCALARS))


def _named(rows: list[dict] | None, column: str, names: tuple[str, ...]) -> list[dict] | None:
    return None if rows is None else [r | {column: [dict(zip(names, x, strict=True)) for x in r[column]]} for r in rows]


def windows_column(role: str = "original", page: int = 1, core: int = 4096, context: int = 1024):
    """Windows of (version, url, source); null source: null."""
    names = ("normalized_start", "normalized_end", "source_start", "source_end")

    def windows(version: pd.Series, url: pd.Series, source: pd.Series) -> pd.Series:
        found = (None if s is None else mapped_windows(int(v), u or "", role, page, s, core, context) for v, u, s in zip(version, url, source, strict=True))
        return pd.Series([_named(f, "spans", names) for f in found], dtype=object)

    return F.pandas_udf(windows, WINDOW)


def segments_column(role: str = "original", page: int = 0, limit: int = 12 * 1024):
    """Segments of (version, url, text, scalars); null text: null, null scalars: none."""

    def segments(version: pd.Series, url: pd.Series, text: pd.Series, scalars: pd.Series) -> pd.Series:
        out = []
        for v, u, t, s in zip(version, url, text, scalars, strict=True):
            told = [(x["pointer"], x["start"], x["end"]) for x in s] if s is not None else []
            out.append(None if t is None else _named(identified_segments(int(v), u or "", role, page, t, told, limit), "scalars", ("pointer", "start", "end")))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(segments, SEGMENT)


def keyed(items: T.ArrayType) -> T.StructType:
    """Rows of a document's key and one of its items."""
    return T.StructType([T.StructField("doc_id", T.LongType()), *items.elementType.fields])


def _rows(key: int, items: list[dict] | None, kind: T.ArrayType) -> Iterator[tuple]:
    names = kind.elementType.names
    yield from ((key, *(x[n] for n in names)) for x in items) if items else [(key,) + (None,) * len(names)]


def window_rows(version: int, url: str | None, source: str | None) -> Iterator[tuple]:
    """The rows of `windows_column`, one by one; one without a window for a refused or null source."""
    found = None if source is None else mapped_windows(int(version), url or "", "original", 1, source)
    return _rows(version, _named(found, "spans", ("normalized_start", "normalized_end", "source_start", "source_end")), WINDOW)


def json_rows(version: int, url: str | None, raw: str | None) -> Iterator[tuple]:
    """The rows of `segments_column` over a JSON document's scalars, one by one; one without a segment for a refused, broken or null document."""
    try:
        text, spans = (None, []) if raw is None else kernels.json_text(raw)
    except ValueError:
        text, spans = None, []
    found = None if text is None else identified_segments(int(version), url or "", "original", 0, text, spans)
    return _rows(version, _named(found, "scalars", ("pointer", "start", "end")), SEGMENT)
