"""What Italian notices and acts say, read token by token: acts that are named, clauses, and measures stated in so many words.

A text becomes a list of tokens, and its sentences ranges of them. Small readers take a place among the tokens and return what they have read and where
it ends, or nothing. What is not read as a whole is left out, never guessed.
"""

from __future__ import annotations

import datetime
import re
from functools import cached_property, lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.functions.kernels import DAY, INT, TEXT, struct, windows
from annalist.functions.text import MONTHS

# Words, limits and names that results depend on.
ACTS = {"ordinanza": "ordinanza", "ordinanze": "ordinanza", "decreto": "decreto", "decreti": "decreto", "delibera": "delibera", "deliberazione": "delibera", "deliberazioni": "delibera", "determina": "determina", "determine": "determina", "determinazione": "determina", "determinazioni": "determina"}
AUTHORITIES = ["sindacale", "comunale", "dirigenziale", "del sindaco", "della polizia locale", "di giunta comunale", "di giunta", "del consiglio comunale", "contingibile e urgente"]
ADOPTED_BY = ["sindacale", "comunale", "del sindaco"]
ADOPTED = ["emessa", "emesso", "emanata", "emanato", "adottata", "adottato", "firmata", "firmato", "apposita", "apposito", "mediante", "con"]
DOUBTS = ["non", "nessun", "nessuno", "nessuna", "alcun", "alcuno", "alcuna", "eventuale", "eventuali", "potrà", "potra", "potranno", "sarà emessa", "sarà emesso", "qualora", "se necessario", "se necessaria"]
DISPOSITIONS = {"chiusura": "closure", "divieto": "prohibition", "sospensione": "suspension", "attivazione": "activation", "limitazione": "restriction", "limitazioni": "restriction", "riapertura": "reopening"}
CONDITIONS = ["fino al perdurare dell'emergenza", "fino al termine dell'emergenza", "fino al cessare dell'emergenza", "fino al cessazione dell'emergenza", "fino a nuova disposizione", "fino a revoca"]
CLAUSE_ENDS = ["AVVERTE", "DISPONE", "DEMANDA", "INFORMA", "AVVISA", "Adempimenti"]
OF_THE = ["dell'", "della", "delle", "degli", "dei", "del"]
IN_THE = ["nei", "nelle", "negli", "nel", "nella"]
REOPENED = ["sottopasso", "ponte", "tunnel", "strada"]
UNCERTAIN = ["non", "mai", "forse", "se", "qualora", "quando", "potrebbe", "sarebbe", "sarà", "sara"]
EXCEPTED = ["non", "forse", "se", "qualora", "eccetto", "tranne", "escluso", "esclusa", "esclusi", "escluse"]
UNSURE = ["non", "se", "qualora"]
RECITALS = ["VISTO", "VISTA", "VISTI", "VISTE", "PREMESSO", "PREMESSA", "CONSIDERATO", "RITENUTO", "DATO", "RICHIAMATA", "ORDINA"]
PROHIBITING = ["vieta", "vietano", "vietato", "vietata", "vietati", "vietate"]
BEING = ["è", "e'", "sono", "sarà", "saranno", "resta", "restano", "rimane", "rimangono"]
#: References of one text at most, characters of a passage on either side, how far a doubt reaches, longest quotes and parts of lists.
MOST_REFERENCES, PASSAGE, REACH, MOST_QUOTE, MOST_PART, MOST_PLACE, MOST_PLACES = 3, 200, 60, 1000, 180, 160, 8
#: A kind is supported by evidence that holds one of these.
LEXICON = {
    "closure": ["chius"], "reopening": ["riapert"], "restriction": ["restrizion", "limitazion"], "prohibition": ["diviet"], "suspension": ["sospens", "esposizione delle attività didattiche"],
    "activation": ["attivazion", "resta attivo", "resta attiva", "attivato", "attivata"], "deactivation": ["disattiv", "cessa"], "operational_update": ["aggiorn", "restano", "liberat", "ripristinat"], "observation": ["monitor", "osserv"],
}


class Token(NamedTuple):
    """A word (with the apostrophe that ends it), a number, or another sign; `text` in lower case and with a plain apostrophe."""

    text: str
    raw: str
    start: int
    end: int


_TOKENS = re.compile(r"[^\W\d_]+(?:['’](?=\w|\s|$))?|\d+|\n|[^\w\s]|_")


def tokens(text: str) -> list[Token]:
    return [Token(m[0].lower().replace("’", "'"), m[0], m.start(), m.end()) for m in _TOKENS.finditer(text)]


@lru_cache(maxsize=256)
def _words(phrase: str) -> tuple[str, ...]:
    return tuple(t.text for t in tokens(phrase))


@lru_cache(maxsize=64)
def _by_first(phrases: tuple[str, ...]) -> dict[str, list[tuple[str, ...]]]:
    """Phrases by their first word, the longest first."""
    out: dict[str, list] = {}
    for words in sorted(map(_words, phrases), key=len, reverse=True):
        out.setdefault(words[0], []).append(words)
    return out


class Reader:
    """The tokens of a text, and readers that begin at one of them."""

    def __init__(self, text: str):
        self.text, self.raws = text, _TOKENS.findall(text)
        self.words = [w.lower() for w in self.raws]
        if "’" in text:
            self.words = [w.replace("’", "'") for w in self.words]

    @cached_property
    def tokens(self) -> list[Token]:
        return tokens(self.text)

    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        return [m.span() for m in _TOKENS.finditer(self.text)]

    def __len__(self) -> int:
        return len(self.words)

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def phrase(self, i: int, words: str) -> int | None:
        """Behind the words, if they stand at i."""
        wanted = _words(words)
        if self.word(i) != wanted[0]:
            return None
        return i + len(wanted) if all(self.word(i + k) == w for k, w in enumerate(wanted)) else None

    def one_of(self, i: int, phrases) -> int | None:
        """Behind the longest of the phrases that stands at i."""
        for wanted in _by_first(tuple(phrases)).get(self.word(i), ()):
            if all(self.word(i + k) == w for k, w in enumerate(wanted)):
                return i + len(wanted)
        return None

    def past(self, i: int, *signs: str) -> int:
        """Behind one of the signs if it stands at i, else i."""
        return i + 1 if self.word(i) in signs else i

    def lines_skipped(self, i: int) -> int:
        while self.word(i) == "\n":
            i += 1
        return i

    def number(self, i: int, most: int) -> int | None:
        word = self.word(i)
        return int(word) if word.isdecimal() and len(word.lstrip("0") or "0") <= most else None

    def numbered(self, i: int) -> tuple[int, int] | None:
        """`n. 12`, `nr. 12`, `n° 12` or `numero 12`: the number, and behind it."""
        if self.word(i) == "n" and self.word(i + 1) in (".", "°"):
            i += 2
        elif self.word(i) == "nr":
            i = self.past(i + 1, ".")
        elif self.word(i) == "numero":
            i += 1
        else:
            return None
        i = self.lines_skipped(i)
        found = self.number(i, 9)  # what an int holds
        return None if found is None else (found, i + 1)

    def day(self, i: int) -> tuple[datetime.date | None, int] | None:
        """`3/4/2026` or `3.4.2026`: the day, nothing if there is none of that name, and behind it."""
        parts = [self.word(i + k) for k in range(5)]
        if not (parts[0].isdecimal() and parts[2].isdecimal() and parts[4].isdecimal() and len(parts[4]) == 4 and len(parts[0]) <= 2 and len(parts[2]) <= 2 and {parts[1], parts[3]} <= {"/", "."}):
            return None
        try:
            return datetime.date(int(parts[4]), int(parts[2]), int(parts[0])), i + 5
        except ValueError:
            return None, i + 5

    def moment(self, i: int) -> tuple[datetime.datetime, int] | None:
        """`ore 8.30 del giorno 3 ottobre 2026`, and behind it."""
        after = self.phrase(i, "ore")
        hour, minute = (self.number(after, 2), self.word(after + 2)) if after else (None, "")
        if hour is None or self.word(after + 1) not in (".", ":") or not (minute.isdecimal() and len(minute) == 2):
            return None
        at = self.phrase(after + 3, "del giorno")
        if at is None or self.number(at, 2) is None or self.word(at + 1) not in MONTHS or self.number(at + 2, 4) is None:
            return None
        try:
            return datetime.datetime(int(self.word(at + 2)), MONTHS.index(self.word(at + 1)) + 1, int(self.word(at)), hour, int(minute)), at + 3
        except ValueError:
            return None

    def ends_sentence(self, i: int) -> bool:
        """Whether token i ends a sentence: a mark before white space or the end, but for that of a number."""
        token = self.tokens[i]
        if token.text == "\n":
            return True
        if token.text not in (".", ";", "!", "?") or not (token.end == len(self.text) or self.text[token.end].isspace()):
            return False
        return not (token.text == "." and self.word(i - 1) in ("n", "nr") and self.word(self.lines_skipped(i + 1)).isdecimal())

    def sentences(self, marks: str = ".!?") -> list[tuple[int, int]]:
        """Ranges of tokens, each with the mark that ends it. Lines do not count, nor do marks inside words and numbers."""
        out, begin = [], 0
        for i, word in enumerate(self.words):
            if word in marks and word != "\n" and self.ends_sentence(i):
                out.append((begin, i + 1))
                begin = i + 1
        every = [(self.lines_skipped(a), b) for a, b in [*out, (begin, len(self))]]
        return [(a, b) for a, b in every if a < b]

    def cut(self, a: int, b: int) -> str:
        """The text of tokens a to b."""
        return self.text[self.spans[a][0] : self.spans[b - 1][1]] if a < b else ""

    def has(self, a: int, b: int, words) -> bool:
        return any(self.word(i) in words for i in range(a, b))

    def in_quotes(self, at: int) -> bool:
        before = self.text[:at]
        return before.count('"') % 2 == 1 or any(before.count(x) > before.count(y) for x, y in ("«»", "“”"))

    def in_heading(self, at: int) -> bool:
        """Whether a place stands between `Oggetto:` and the first recital behind it."""
        for i, token in enumerate(self.tokens):
            if token.text == "oggetto" and self.word(i + 1) == ":":
                body = next((t.start for t in self.tokens[i + 2 :] if t.raw in RECITALS), None)
                if body is not None and token.start <= at < body:
                    return True
        return False


# ---- acts that a text names


def _named(r: Reader, i: int) -> tuple[dict, int] | None:
    """An act with its number at token i: kind, number, year and day, and behind it."""
    kind = ACTS.get(r.word(i))
    if kind is None:
        return None
    i = r.lines_skipped(r.one_of(i + 1, AUTHORITIES) or i + 1)
    if (found := r.numbered(i)) is None:
        return None
    number, i = found
    year = day = None
    if r.word(i) == "/" and len(r.word(i + 1)) == 4 and r.word(i + 1).isdecimal():
        year, i = int(r.word(i + 1)), i + 2
    if r.word(i) in ("del", "dell'", "dell", "del'") and (dated := r.day(i + 1)):
        day, i = dated
    return {"kind": kind, "number": number, "year": year or (day.year if day else None), "day": day}, i


def _adopted(r: Reader, i: int) -> bool:
    """Whether an act without a number is said to have been adopted, before or behind its name."""
    return r.word(i - 1) in ADOPTED or r.one_of(i + 1, ADOPTED_BY) is not None


def references(text: str) -> list[dict]:
    """The acts that a notice refers to: numbered ones in order, then kinds without a number of which no numbered one is named; three at most.

    What is negated, conditional or only possible earlier in its part of a sentence is no reference. A date that does
    not exist does not count; one that does gives the year where the number has none.
    """
    r, numbered, named, doubt, begin, i = Reader(text), {}, {}, None, 0, 0
    while i < len(r):
        if r.ends_sentence(i) or r.word(i) == ":":
            doubt, begin, i = None, begin if r.word(i) == ":" else i + 1, i + 1
            continue
        if (after := r.one_of(i, DOUBTS)) is not None:
            doubt, i = r.tokens[after - 1].end, after
            continue
        if r.word(i) not in ACTS:
            i += 1
            continue
        sure = doubt is None or r.tokens[i].start - doubt > REACH
        found, after = _named(r, i) or ({"kind": ACTS[r.word(i)], "number": None, "year": None, "day": None}, i + 1)
        if sure and (found["number"] is not None or _adopted(r, i)):
            into, key = (numbered, (found["kind"], found["number"], found["year"])) if found["number"] is not None else (named, found["kind"])
            if key not in into:
                stop = next((k for k in range(after, len(r)) if r.ends_sentence(k)), len(r) - 1)
                into[key] = found | {"passage": text[max(r.tokens[begin].start, r.tokens[i].start - PASSAGE) : min(r.tokens[stop].end, r.tokens[after - 1].end + PASSAGE)].strip()}
        i = after
    covered = {x["kind"] for x in numbered.values()}
    every = [*numbered.values(), *(x for kind, x in named.items() if kind not in covered)]
    return [{"ordinal": i, **x} for i, x in enumerate(every[:MOST_REFERENCES], 1)]


def named_act(text: str) -> dict | None:
    """The first act that is named with number and year, as in the head of an act."""
    r = Reader(text)
    found = (_named(r, i) for i in range(len(r)) if r.word(i) in ACTS)
    return next((x for x, _ in filter(None, found) if x["year"] is not None), None)


# ---- the clause by which an act disposes


def _start(r: Reader, i: int) -> tuple[datetime.datetime, int] | None:
    at = r.phrase(i, "a partire dalle")
    return r.moment(at) if at else None


def clause(text: str) -> dict | None:
    """The clause behind ORDINA: local start, and either a local end or a condition, and what it disposes, in order; null if any part is not understood."""
    if "ORDINA" not in text:
        return None
    r = Reader(text)
    for begin in (i for i, raw in enumerate(r.raws) if raw == "ORDINA"):
        i = r.lines_skipped(begin + 1)
        i = r.past(r.phrase(i, "in via contingibile e urgente") or i, ",")
        if (started := _start(r, i)) is None:
            continue
        start, i = started
        i = r.past(i, ",")
        end, until = None, r.phrase(i, "fino alle")
        if until and (ended := r.moment(until)):
            end, stop = ended
        else:
            stop = r.one_of(i, CONDITIONS)
        if stop is None or r.word(stop) != ":" or (end is not None and end < start):
            return None
        condition = None if end is not None else " ".join(r.cut(i, stop).split())
        last = next((k for k in range(stop, len(r)) if r.raws[k] in CLAUSE_ENDS), len(r))
        heads = [k for k in range(stop + 1, last - 1) if r.word(k) in ("la", "il", "lo", "l'") and r.word(k + 1) in DISPOSITIONS]
        parts = [{"ordinal": n, "kind": DISPOSITIONS[r.word(k + 1)], "text": " ".join(r.cut(k, to).split())} for n, (k, to) in enumerate(zip(heads, [*heads[1:], last][: len(heads)], strict=True), 1)]
        return {"start": start, "end": end, "condition": condition, "passage": " ".join(r.cut(begin, stop + 1).split()), "dispositions": parts} if parts else None
    return None


# ---- measures that are stated in so many words


def _split(r: Reader, a: int, b: int, articles: list[str]) -> list[tuple[int, int]] | None:
    """Members of an enumeration: each begins with an article, and all but the first behind a comma or `e`. Nothing if the first has no article."""
    if r.word(a) not in articles:
        return None
    heads = [a, *(k for k in range(a + 1, b) if r.word(k) in articles and r.word(k - 1) in (",", "e"))]
    ends = [*(k - 1 for k in heads[1:]), b]
    return [(h + 1, e) for h, e in zip(heads, ends, strict=True)]


def _measure(kind: str, subject: str, quote: str, at: int, place: str | None = None, start: str | None = None, until: str | None = None) -> dict:
    return {"kind": kind, "subject": subject, "place": place, "valid_from": start, "valid_until": until, "quote": quote, "at": at}


def _cleared(r: Reader, a: int, b: int) -> list[dict]:
    """`Si informa la cittadinanza che tutte le strade ... sono state liberate ...`."""
    begin = r.past(r.phrase(a, "aggiornamento") or a, ":")
    subject = r.phrase(begin, "si informa la cittadinanza che")
    if subject is None or r.phrase(subject, "tutte le strade") is None or r.has(a, b, UNSURE) or r.has(subject, b - 1, (";", ":")):
        return []
    done = next((k for k in range(subject, b) if r.phrase(k, "sono state liberate")), None)
    return [] if done is None else [_measure("operational_update", r.cut(subject, done), r.cut(a, b), r.tokens[a].start)]


def _retained(r: Reader, a: int, b: int) -> list[dict]:
    """`Restano in vigore ...: chiusura al pubblico dei A e della B e divieto di X nei C, nelle D`: each member by itself; a list of one is none, it needs no splitting."""
    begin = r.phrase(a, "restano al momento in vigore") or r.phrase(a, "restano in vigore")
    if begin is None:
        return []
    colon = next((k for k in range(begin, b) if r.word(k) == ":"), None)
    if colon is None or r.word(b - 1) not in (".", "!", "?") or r.has(colon, b, (";",)):
        return []
    end, quote, out = b - 1, r.cut(a, b - 1), []
    at, start = r.tokens[a].start, "al momento" if r.phrase(a, "restano al momento") else None
    changes = next((r.cut(k, k + 3) for k in range(a, end) if r.phrase(k, "salvo successive modifiche")), None)
    kinds = [k for k in range(colon + 1, end) if r.word(k) in DISPOSITIONS and (k == colon + 1 or r.word(k - 1) == "e")]
    for k, upto in zip(kinds, [*(x - 1 for x in kinds[1:]), end], strict=True):
        if (i := r.phrase(k, "chiusura al pubblico")) and (members := _split(r, i, upto, OF_THE)) and len(members) > 1 and not r.has(k, upto, EXCEPTED):
            said = r.cut(a, upto)
            if len(said) <= MOST_QUOTE:
                out += [_measure("closure", r.cut(*m), said, at, start=start, until=changes) for m in members if m[0] < m[1]]
        elif (i := r.phrase(k, "divieto di")) and len(quote) <= MOST_QUOTE and not r.has(a, end, EXCEPTED):
            first = next((x for x in range(i + 1, upto) if r.word(x) in IN_THE), None)
            places = _split(r, first, upto, IN_THE) if first else None
            if not places or not 2 <= len(places) <= MOST_PLACES or r.has(i, first, (",", ":")):
                continue
            names = [r.cut(*p) for p in places]
            if all(n and len(n) <= MOST_PLACE and not set(n) & set(",;:") for n in names) and len({n.lower() for n in names}) == len(names):
                out += [_measure("prohibition", r.cut(i, first), quote, at, n, start, changes) for n in names]
    return out


def _reopened(r: Reader, a: int, b: int) -> list[dict]:
    """`Il ponte X, chiuso ..., è stato riaperto alla circolazione.`"""
    end = b - (r.word(b - 1) in (".", "!", "?"))
    if r.word(a) not in ("il", "la") or r.word(a + 1) not in REOPENED:
        return []
    said = next((k for k in range(a + 2, end) if r.one_of(k, ["è stato riaperto alla circolazione", "è stata riaperta alla circolazione"]) == end), None)
    if said is None or r.has(a, said, (";", ":", "!", "?", "\n")):
        return []
    aside = next((k for k in range(a + 2, said) if r.word(k) == ","), None)
    if aside is not None and not (r.word(aside + 1) in ("chiuso", "chiusa") and r.word(said - 1) == ","):
        return []
    stop = said if aside is None else aside
    return [] if r.has(a, stop, UNCERTAIN) or stop <= a + 2 else [_measure("reopening", r.cut(a + 1, stop), r.cut(a, end), r.tokens[a].start)]


BULLETS = ("-", "•", "◦", "○", "▪", "*", "–")


def _directive(r: Reader) -> list[dict]:
    """`ORDINA in via contingibile e urgente ...: - la chiusura al pubblico: ◦ dell'area A; ◦ dei B;`: every item closes, with the start and the condition of the header.

    An item is a bullet, an article and a name up to a semicolon. A list of which an item cannot be read is refused as a whole, as is one whose
    sentence doubts or quotes it, stands in a heading, or whose quote is too long.
    """
    out = []
    for begin in (i for i, word in enumerate(r.words) if word == "ordina"):
        i = r.one_of(begin + 1, ["in via contingibile e urgente", "in via contingenti e urgente"])
        before = r.tokens[begin].start
        sentence = max((k + 1 for k in range(begin) if r.word(k) in (".", ";")), default=0)
        if i is None or (begin and r.word(begin - 1) not in (".", ";", ",", "\n")) or r.has(sentence, begin, UNSURE) or r.in_quotes(before):
            continue
        colon = next((k for k in range(i, len(r)) if r.word(k) == ":" and not (r.word(k - 1).isdecimal() and r.word(k + 1).isdecimal())), None)
        if colon is None:
            continue
        k = r.lines_skipped(colon + 1)
        k = r.lines_skipped(r.past(k, *BULLETS))
        listed = r.phrase(r.past(k, "la"), "chiusura al pubblico")
        if listed is None or r.word(listed) != ":":
            continue
        k, items, whole = r.lines_skipped(listed + 1), [], True
        while r.word(k) in BULLETS and r.word(r.lines_skipped(k + 1)) in OF_THE:
            head = r.lines_skipped(k + 1)
            stop = next((x for x in range(head, len(r)) if r.word(x) in (";", ":", ".")), None)
            if stop is None or r.word(stop) != ";" or not 0 < len(name := " ".join(r.cut(head + 1, stop).split())) <= MOST_PART:
                whole = False
                break
            items.append(name)
            k = r.lines_skipped(stop + 1)
            listed = stop + 1
        quote = r.cut(begin, listed)
        if not items or not whole or len(quote) > MOST_QUOTE or r.has(begin, listed, UNSURE):
            continue
        start = next((r.cut(x, y[1]) for x in range(i, colon) if (y := _start(r, x))), None)
        until = next((r.cut(x, y) for x in range(i, colon) if (y := r.one_of(x, CONDITIONS[:1]))), None)
        out += [_measure("closure", name, quote, before, start=start, until=until) for name in items]
    return out


#: How sentences begin that state a measure.
OPENINGS = {"aggiornamento", ":", "si", "restano", "il", "la"}


def stated(text: str, core: tuple[int, int] | None = None) -> list[dict]:
    """Measures that a notice states in so many words: roads cleared (operational_update), listed closures and prohibitions that stay in force, what is open again (reopening),
    and what an act closes by a list.

    Quotes are literal. A quote counts if it begins in the core, a range of bytes, of which the whole text is one; neighbours' cores have the others. Doubted, conditional,
    excepted or quoted statements are none, nor are those of a heading.
    """
    if not any(word in text.lower() for word in ("liberate", "in vigore", "riapert", "chiusura al pubblico")):
        return []
    r, found = Reader(text), []
    for a, b in r.sentences():
        if r.word(a) in OPENINGS:
            found += _cleared(r, a, b) + _retained(r, a, b) + _reopened(r, a, b)
    found = [m for m in found if not r.in_quotes(m["at"])] + _directive(r)
    low, high = core or (0, len(text.encode("utf-8", "surrogatepass")))
    own = [m for m in found if low <= len(text[: m["at"]].encode("utf-8", "surrogatepass")) < high and not r.in_heading(m["at"])]
    order = ["operational_update", "closure", "prohibition", "reopening"]
    return sorted(own, key=lambda m: (order.index(m["kind"]), m["at"]))


# ---- kinds that evidence supports


def supported(kind: str, quote: str) -> bool:
    """Whether a quote holds a word of the kind's lexicon; or, for a prohibition, a form of `vietare` that is not negated, and, for an activation, that the operational centre is open."""
    low = quote.lower()
    if any(word in low for word in LEXICON.get(kind, ())):
        return True
    r = Reader(quote)
    if kind == "prohibition":
        denied = lambda i: r.word(i - 1) == "non" or (r.word(i - 1) in BEING and r.word(i - 2) == "non")
        return any(r.word(i) in PROHIBITING and not denied(i) for i in range(len(r)))
    if kind == "activation":
        centre = (r.one_of(i, ["coc (centro operativo comunale)", "centro operativo comunale"]) for i in range(len(r)))
        return any(r.word(i) in ("sarà", "sara", "è", "resta", "rimane") and r.word(i + 1) == "aperto" for i in centre if i is not None)
    return False


_REFERENCE = struct(ordinal=INT, kind=TEXT, number=INT, year=INT, day=DAY, passage=TEXT)
_CLAUSE = struct(start=T.TimestampNTZType(), end=T.TimestampNTZType(), condition=TEXT, passage=TEXT, dispositions=T.ArrayType(struct(ordinal=INT, kind=TEXT, text=TEXT)))
_ACT = struct(kind=TEXT, number=INT, year=INT)
_STATED = struct(kind=TEXT, subject=TEXT, place=TEXT, valid_from=TEXT, valid_until=TEXT, quote=TEXT)


def _frame(rows: list[dict | None], schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame({name: pd.Series([(r or {}).get(name) for r in rows], dtype=object) for name in schema.names})


@F.pandas_udf(T.ArrayType(_REFERENCE))
def references_in(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else references(t))


@F.pandas_udf(_ACT)
def act_of(texts: pd.Series) -> pd.DataFrame:
    return _frame([named_act(t or "") for t in texts], _ACT)


@F.pandas_udf(_CLAUSE)
def clause_of(texts: pd.Series) -> pd.DataFrame:
    return _frame([clause(t or "") for t in texts], _CLAUSE)


@F.pandas_udf(T.ArrayType(_STATED))
def stated_in(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [{k: m[k] for k in _STATED.names} for m in stated(t)])


@F.pandas_udf(T.ArrayType(_STATED))
def stated_in_window(texts: pd.Series, window: pd.DataFrame) -> pd.Series:
    """Of a window (core_start, core_end, start, end: bytes of the text), the measures whose quotes its core owns."""
    out = []
    for text, low, high, begin, end in zip(texts, window["core_start"], window["core_end"], window["start"], window["end"], strict=True):
        part = text.encode("utf-8", "surrogatepass")[begin:end].decode("utf-8", "surrogatepass")
        out.append([{k: m[k] for k in _STATED.names} for m in stated(part, (low - begin, high - begin))])
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("ordinal", INT), *_STATED.fields])))
def stated_in_windows(texts: pd.Series) -> pd.Series:
    """The measures of all windows of a text, each with the window whose core owns its quote; the text goes to Python once. Null for a refused text."""

    def found(text: str | None) -> list[dict] | None:
        if text is None or (cores := windows(text)) is None:
            return None
        data, out = text.encode("utf-8", "surrogatepass"), []
        for n, (low, high, begin, end) in enumerate(cores, 1):
            part = data[begin:end].decode("utf-8", "surrogatepass")
            out += [{"ordinal": n, **{k: m[k] for k in _STATED.names}} for m in stated(part, (low - begin, high - begin))]
        return out

    return texts.map(found)


@F.pandas_udf(T.BooleanType())
def supported_by(kind: pd.Series, quote: pd.Series) -> pd.Series:
    return pd.Series([bool(k and q and supported(k, q)) for k, q in zip(kind, quote, strict=True)])
