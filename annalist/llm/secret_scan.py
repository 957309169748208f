"""Secret scans: all rules in one minimal automaton, and one pass over the bytes of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import shared
from annalist.llm.automaton import PATTERNS, SPAN, Dfa, scan


@dataclass(frozen=True)
class Rule:
    """A secret is `key`, then `tail`, then a run of `run`, then `end`.

    The run, or the whole match if `whole`, must have `least` characters. `run` is one class, repeated, and `end` begins with none of it.
    """

    kind: str
    key: str
    tail: str
    run: str
    least: int
    whole: bool
    end: str = ""

    @property
    def pattern(self) -> str:
        return f"(?:{self.key})(?:{self.tail})({self.run})(?:{self.end})"


_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
#: The base kinds, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)", _GIVEN, r"[A-Za-z0-9+/_.=-]+", 6, False),
    Rule("access", r"AKIA", r"", r"[A-Z0-9]+", 20, True),
    Rule("hex", r"", r"", r"[0-9a-f]+", 24, True),
)
#: Formats of well-known issuers of keys and tokens; what stands behind the prefix must have so many characters.
RULES = (
    *BASE,
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", r"\r?\n", r"[A-Za-z0-9+/=\r\n]+", 40, False),
    Rule("json_web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"", r"[A-Za-z0-9_-]+", 20, False),
    Rule("url_password", r"[A-Za-z][A-Za-z0-9+]*://[A-Za-z0-9._~%+-]+:", r"", r"[A-Za-z0-9._~%!$&*+,;=-]+", 3, False, "@"),
    Rule("bearer", r"(?i:bearer)", r"\x20+", r"[A-Za-z0-9._~+/=-]+", 20, False),
    Rule("cloud_secret", r"(?i:aws_?secret_?access_?key)", _GIVEN, r"[A-Za-z0-9/+]+", 40, False),
    Rule("cloud_api", r"AIza", r"", r"[A-Za-z0-9_-]+", 35, False),
    Rule("code_host", r"(?:gh[oprsu]_|github_pat_|glpat-)", r"", r"[A-Za-z0-9_-]+", 20, False),
    Rule("chat_host", r"xox[abeoprs]-", r"", r"[A-Za-z0-9-]+", 20, False),
    Rule("payment", r"(?:sk|pk|rk)_(?:live|test)_", r"", r"[A-Za-z0-9]+", 16, False),
    Rule("mail_host", r"(?:SG\.|key-)", r"", r"[A-Za-z0-9_.-]+", 32, False),
    Rule("package_host", r"(?:npm_|pypi-)", r"", r"[A-Za-z0-9_-]+", 36, False),
    Rule("model_host", r"(?:sk-|hf_)", r"", r"[A-Za-z0-9_-]+", 32, False),
)


@lru_cache(maxsize=4)
def automata(rules: tuple[Rule, ...]) -> list[Dfa]:
    """Of up to PATTERNS rules each."""
    return [Dfa([rule.pattern for rule in rules[i : i + PATTERNS]], backwards=True) for i in range(0, len(rules), PATTERNS)]


class Scanner:
    """Finds the leftmost non-overlapping matches of each rule, then drops those too short.

    One automaton of all whole rules, read backwards, marks in one pass over the bytes where matches of every rule begin.
    Of a rule without a key, matches are the runs of such marks. Those of other rules are rare, and the rule itself tells
    how far the match at a mark goes.
    """

    def __init__(self, rules: tuple[Rule, ...] = RULES, compiled: list[Dfa] | None = None):
        self.rules = rules
        self.automata = compiled or automata(rules)
        self.patterns = [re.compile(rule.pattern.encode()) for rule in rules]

    def _keyed(self, k: int, text: bytes, starts: list[int], first: int) -> list[tuple[int, int, int]]:
        rule, found, free = self.rules[k], [], 0
        for start in starts:
            start -= first
            if start >= free and (match := self.patterns[k].match(text, start)):
                free = match.end()
                if free - start >= rule.least if rule.whole else match.end(1) - match.start(1) >= rule.least:
                    found.append((start, k, free))
        return found

    def spans(self, data: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) in bytes, sorted, for each text data[bounds[i]:bounds[i + 1]]."""
        full = np.flatnonzero(np.diff(bounds) > 0)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
        if not len(full):
            return found
        begins = bounds[full]
        ends = np.append(begins[1:], len(data))
        backwards = np.ascontiguousarray(data[::-1])
        for k, rule in enumerate(self.rules):
            bit = np.uint64(1 << (k % PATTERNS))
            if k % PATTERNS == 0:
                marks = scan(self.automata[k // PATTERNS], backwards, (len(data) - ends)[::-1])[::-1]
                marked = np.flatnonzero(marks)
                marks = marks[marked]
            at = marked[(marks & bit) != 0]
            if not len(at):
                continue
            text = np.searchsorted(begins, at, "right") - 1
            if rule.key:
                cuts = np.append(np.flatnonzero(np.append(True, text[1:] != text[:-1])), len(at))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    i = int(text[a])
                    found[full[i]] += self._keyed(k, data[begins[i] : ends[i]].tobytes(), at[a:b].tolist(), int(begins[i]))
            else:
                heads = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])))
                sizes = np.diff(np.append(heads, len(at)))
                for a, n in zip(heads[sizes >= rule.least].tolist(), sizes[sizes >= rule.least].tolist(), strict=True):
                    i = int(text[a])
                    start = int(at[a] - begins[i])
                    found[full[i]].append((start, k, start + n))
        for spans in found:
            spans.sort()
        return found


def _blocks(texts: pa.Array, limit: int = SPAN) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about `limit` bytes: index of the first, bytes, bounds of each."""
    texts = texts.cast(pa.large_string()).fill_null("")
    sizes = pc.binary_length(texts).to_numpy()
    first, total = 0, 0
    for i, n in enumerate([*sizes.tolist(), None]):
        if n is None or (total and total + n > limit):
            if i > first:
                part = pa.concat_arrays([texts.slice(first, i - first)])
                bounds = np.concatenate([[0], np.cumsum(sizes[first:i])]).astype(np.int64)
                buffer = part.buffers()[2]
                begin = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset]
                yield first, np.frombuffer(buffer, dtype=np.uint8)[begin : begin + bounds[-1]] if buffer else np.zeros(0, np.uint8), bounds
            first, total = i, 0
        total += n or 0


SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"


def _masked(text: bytes, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """The text with its kind in square brackets for each secret; those that overlap are one, of the first kind."""
    pieces, at = [], 0
    for start, k, end in spans:
        if start >= at:
            pieces += [text[at:start], f"[{rules[k].kind}]".encode()]
        at = max(at, end)
    return b"".join([*pieces, text[at:]]).decode()


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], column: str, added: str) -> DataFrame:
    """The rows with `added`: the list of secrets, or the masked text where there are any."""
    kept = [c for c in docs.columns if c != added]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    compiled = automata(rules)  # here, once; tasks get the arrays
    listing = added == "secrets"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])) if listing else pa.string()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, compiled)
        for batch in batches:
            values = []
            for _, data, bounds in _blocks(batch.column(kept.index(column))):
                for i, spans in enumerate(scanner.spans(data, bounds)):
                    value = spans if listing else None
                    if spans:
                        text = data[bounds[i] : bounds[i + 1]]
                        if listing:
                            chars = np.append(0, np.cumsum((text & 0xC0) != 0x80))
                            value = [{"kind": rules[k].kind, "start": int(chars[s]), "end": int(chars[e])} for s, k, e in spans]
                        else:
                            value = _masked(text.tobytes(), spans, rules)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, type=kind)], [*kept, added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(scanned, f"{fields}, `{added}` {SPAN_TYPE if listing else 'string'}")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "text") -> DataFrame:
    """Adds `secrets`: kind, start, end (code points) of each secret, by start, then rule.

    Null or empty text: an empty list. All columns of the input stay; a column named `secrets`
    is replaced. Repeated rows are scanned each by itself, null ids are ids like others; an empty table gives no rows. Each
    text is scanned whole by one task, in which a very long one takes some 20 bytes a byte; shorter ones are scanned a few megabytes at a time.
    """
    return _scanned(docs, rules, column, "secrets")


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every secret replaced by its kind in square brackets; spans that overlap are masked as one.

    `n_chars`, where there is one, follows the text. Null text stays null; else as `find_secrets`.
    """
    masked = F.coalesce("_masked", "text")
    new = {"text": masked, "n_chars": F.length(masked).cast("long")}
    return _scanned(docs, rules, "text", "_masked").select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def op4_secret_automaton(spark, sf_dir):
    """Secrets of every document: counts and digest of the base kinds, and the spans of all."""
    found = find_secrets(shared.documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    listed = lambda secrets: F.array_join(F.transform(secrets, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = listed(F.filter("secrets", lambda x: x["kind"].isin(*[rule.kind for rule in BASE])))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
    )
