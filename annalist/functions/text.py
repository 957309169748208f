"""Text functions as column expressions: normal forms, terms, references to acts, dates in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions.temporal import let

#: Italian month names, in order.
MONTHS = ["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"]
# Words that say nothing about a disposition, and about what a measure is on.
STOP_WORDS = ["della", "delle", "degli", "dello", "nelle", "negli", "tutte", "tutti", "ogni", "grado", "ordine", "comunale", "comunali", "pubblico", "pubblici", "pubbliche", "pubblica", "territorio"]
HEAD_STOP_WORDS = ["della", "delle", "dello", "degli", "dell", "dei", "del", "nelle", "negli", "nella", "tutte", "tutti", "qualunque", "qualsiasi", "ogni"]
NO_LETTERS = r"[^\p{L}]+"


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def stem(word: Column) -> Column:
    return F.substring(word, 1, 6)


def _words(text: Column, least: int, without: list[str]) -> Column:
    return F.filter(F.split(F.lower(text), NO_LETTERS), lambda w: (F.length(w) >= least) & ~w.isin(*without))


def stems(text: Column) -> Column:
    """Distinct sorted stems of the words of at least five letters that are no stop words."""
    return F.array_sort(F.array_distinct(F.transform(_words(text, 5, STOP_WORDS), stem)))


def stems_match(a: Column, b: Column) -> Column:
    return F.arrays_overlap(stems(a), stems(b))


def head_term(subject: Column) -> Column:
    """Stem of the first word of at least four letters that says something; empty if there is none."""
    return F.coalesce(stem(F.get(_words(subject, 4, HEAD_STOP_WORDS), 0)), F.lit(""))


def bounded(text: Column, limit: int) -> Column:
    """At most `limit` bytes of UTF-8 without breaking a character."""
    raw = F.encode(text, "UTF-8")
    upto = F.filter(F.sequence(F.lit(limit), F.lit(max(limit - 3, 0)), F.lit(-1)), lambda n: F.hex(F.substring(raw, n + 1, F.lit(1))).rlike("^([0-7C-F].|)$"))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(raw, F.lit(1), F.get(upto, 0)), "UTF-8"))


def canonical(value: Column, aliases: dict[str, str]) -> Column:
    """The canonical name of an alias, in any case and spacing; others as they are."""
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    key = F.lower(squeezed(value))
    return F.coalesce(F.element_at(F.create_map(*pairs), key), key)


def stable_id(prefix: str, *parts: Column) -> Column:
    """A prefix and the hash of the parts as JSON."""
    named = F.struct(*[F.coalesce(p.cast("string"), F.lit("")).alias(f"p{i}") for i, p in enumerate(parts)])
    return F.concat(F.lit(prefix + "_"), F.sha2(F.to_json(named), 256))


def valid_url(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & (F.try_parse_url(url, F.lit("HOST")) != ""), F.lit(False))


def same_origin(a: Column, b: Column) -> Column:
    origin = lambda u: F.struct(F.try_parse_url(u, F.lit("PROTOCOL")), F.try_parse_url(u, F.lit("AUTHORITY")))
    return valid_url(a) & valid_url(b) & origin(a).eqNullSafe(origin(b))


def within_path(url: Column, base: Column) -> Column:
    """Whether a URL is of the same origin and below the base's path."""
    path = lambda u: F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit(""))
    prefix = F.concat(F.regexp_replace(path(base), "/$", ""), F.lit("/"))
    return same_origin(url, base) & F.startswith(F.concat(path(url), F.lit("/")), prefix)


#: A numbered act: its kind, then n., its number, and a year or a date.
ACT = r"(?i)\b(ordinanza|decreto|delibera|determina)\b(?:\s+(?:sindacale|dirigenziale))?\s+n[.°]?\s*0*([0-9]{1,6})(?:\s*/\s*([0-9]{4})|\s+del\s+[0-9]{1,2}/[0-9]{1,2}/([0-9]{4}))"


def act_references(text: Column, most: int = 3) -> Column:
    """kind, number and year of numbered acts named in a text: distinct, in order, at most so many."""
    part = lambda i: F.regexp_extract_all(text, F.lit(ACT), F.lit(i))
    year = F.zip_with(part(3), part(4), lambda a, b: F.when(a != "", a).otherwise(b))
    found = F.arrays_zip(F.transform(part(1), F.lower).alias("kind"), part(2).alias("number"), year.alias("year"))
    named = F.transform(found, lambda x: F.concat_ws(" ", x["kind"], F.concat(x["number"], F.lit("/"), x["year"])))
    return F.slice(F.array_distinct(named), 1, most)


def italian_date(text: Column) -> Column:
    """The date that a phrase such as `Lunedì, 13 Aprile 2026` names, or null if there is none or it does not exist."""
    months = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(f"{i + 1:02d}"))])
    pattern = rf"(?iu)\b([0-9]{{1,2}})\s+({'|'.join(MONTHS)})\s+([0-9]{{4}})\b"
    named = F.split(F.regexp_extract(text, pattern, 0), r"\s+")
    words = lambda found: F.concat_ws("-", F.get(found, 2), F.element_at(months, F.lower(F.get(found, 1))), F.lpad(F.get(found, 0), 2, "0"))
    return let(named, lambda found: F.when(F.size(found) == 3, F.try_to_date(words(found), "yyyy-MM-dd")))
