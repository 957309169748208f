"""Quality rules with line-first cleaning. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm import shared

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5

#: Phrases that mark a line as boilerplate, in lower case, by language.
PHRASES = {
    "en": ("all rights reserved", "accept all cookies", "cookie policy", "privacy policy", "terms of service", "terms of use", "click here to", "subscribe to our newsletter", "sign up for our newsletter", "enable javascript", "skip to main content"),
    "fr": ("tous droits réservés", "accepter tous les cookies", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "cliquez ici pour", "inscrivez-vous à notre newsletter", "activer javascript"),
    "de": ("alle rechte vorbehalten", "alle cookies akzeptieren", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "newsletter abonnieren", "javascript aktivieren", "zum inhalt springen"),
    "es": ("todos los derechos reservados", "aceptar todas las cookies", "política de privacidad", "aviso legal", "términos y condiciones", "haga clic aquí", "suscríbase a nuestro boletín", "activar javascript"),
    "it": ("tutti i diritti riservati", "accetta tutti i cookie", "informativa sulla privacy", "note legali", "termini e condizioni", "clicca qui per", "iscriviti alla newsletter", "abilita javascript"),
}
BOILERPLATE = tuple(phrase for phrases in PHRASES.values() for phrase in phrases)
#: Words of menus, in lower case.
MENU = (
    "home", "menu", "login", "logout", "register", "search", "contact", "sitemap", "faq", "accueil", "connexion", "inscription", "recherche", "startseite", "anmelden",
    "kontakt", "impressum", "suche", "inicio", "contacto", "buscar", "acceder", "contatti", "accedi", "cerca",
)
#: Characters that stand between the items of menus, and how many of them make a line navigation.
SEPARATORS, NAV_SEPARATORS = "|»›·•", 3
#: A line of at most so many characters that holds so many words of menus is navigation.
MENU_CHARS, MENU_WORDS = 120, 3
#: A line with more symbols than this share of its words is no prose.
SYMBOL_SHARE = 0.5
#: A document that loses more than this share of its word characters goes.
LOST_SHARE = 0.5
PUNCTUATION, BULLET, ENDS = r"[.!?…。:;,]", r"^[\x20\t]*([-*•–]|[0-9]+[.)])[\x20\t]", r"[.!?…。:;][\"'”’)\x20\t]*$"


def line_rules(line: Column, separators: Column, symbols: Column, boilerplate: Column) -> Column:
    """Whether a line fails by itself: bare (no punctuation), bullet, navigation, symbols or boilerplate.

    The flags say which rules any line of the text can fail at all.
    """
    bullet = line.rlike(BULLET) & ~line.rlike(ENDS)
    many_symbols = F.regexp_count(line, F.lit(SYMBOL)) > F.regexp_count(line, F.lit(shared.WORD)) * SYMBOL_SHARE
    between = F.length(line) - F.length(F.translate(line, SEPARATORS, "")) >= NAV_SEPARATORS
    words = F.filter(F.split(F.lower(line), r"[^\p{L}]+"), lambda word: word.isin(*MENU))
    menu = (F.length(line) <= MENU_CHARS) & (F.size(words) >= MENU_WORDS)
    return bullet | (symbols & many_symbols) | (separators & between) | menu | (boilerplate & F.lower(line).rlike("|".join(BOILERPLATE)))


def failing(lines: Column, fails: Column, bare: Column) -> Column:
    """Of arrays side by side, (line, fails): a line without punctuation fails too, unless it heads one that has some and fails no rule."""
    prose = F.zip_with(fails, bare, lambda f, b: ~f & ~b)
    behind = F.concat(F.slice(prose, F.lit(2), F.greatest(F.size(prose) - 1, F.lit(0))), F.array(F.lit(False)))
    alone = F.zip_with(bare, behind, lambda b, headed: b & ~headed)
    return F.zip_with(lines, F.zip_with(fails, alone, lambda f, a: f | a), lambda line, f: F.struct(line.alias("line"), f.alias("fails")))


def _repeated_words(rows: DataFrame) -> DataFrame:
    """Adds `n_repeat_words`, the words inside windows of five words that `words` holds twice or more.

    Hashes of windows grow from words over pairs to fives, each step one projection. Only texts
    in which a hash repeats sort (hash, place), and mark the places whose neighbour has the same hash.
    """
    behind = lambda name, n: F.slice(name, n + 1, F.greatest(F.size(name), F.lit(1)))
    both = lambda a, b: F.xxhash64(a, b)  # noqa: E731  the ends, where b is missing, are cut off
    rows = rows.withColumn("h", F.transform("words", lambda word: F.xxhash64(word)))
    rows = rows.withColumn("z", F.zip_with("h", behind("h", 1), both))
    rows = rows.withColumn("z", F.zip_with("z", behind("z", 2), both))
    rows = rows.withColumn("k", F.slice(F.zip_with("z", behind("h", WINDOW - 1), both), F.lit(1), F.greatest(F.size("h") - WINDOW + 1, F.lit(0)))).drop("h", "z")
    places = F.arrays_zip("k", F.sequence(F.lit(0), F.size("k") - 1).alias("at"))
    rows = rows.withColumn("p", F.when(F.size(F.array_distinct("k")) < F.size("k"), F.sort_array(places))).drop("k")
    equal = F.filter(F.arrays_zip("p", behind("p", 1).alias("q")), lambda x: x["p"]["k"] == x["q"]["k"])
    rows = rows.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.transform(equal, lambda x: F.array(x["p"]["at"], x["q"]["at"])))))).drop("p")
    steps = F.zip_with("at", behind("at", 1), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).drop("at")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars")


def _measured(docs: DataFrame) -> DataFrame:
    """`row` with all columns of the input, and `q` with the counts, the verdicts and the cleaned text."""
    rows = docs.select(F.struct("*").alias("row"), shared.text_or_empty().alias("t"))
    rows = rows.withColumn("low", F.lower("t"))
    word = lambda line: line.rlike(shared.WORD)
    rows = rows.select(
        "row",
        F.array_remove(F.split("t", SPACE), "").alias("words"),
        F.filter(F.split("t", "\n", -1), word).alias("lines"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        reduce(Column.__or__, [F.contains("t", F.lit(c)) for c in SEPARATORS]).alias("separators"),
        reduce(Column.__or__, [F.contains("low", F.lit(phrase)) for phrase in BOILERPLATE]).alias("boilerplate"),
    )
    fails = lambda line: line_rules(line, F.col("separators"), F.col("n_symbols") > 0, F.col("boilerplate"))
    rows = rows.select(
        "row", "words", "n_symbols", "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", fails).alias("fails"),
        F.transform("lines", lambda line: ~line.rlike(PUNCTUATION)).alias("bare"),
    )
    rows = rows.withColumn("lines", failing(F.col("lines"), F.col("fails"), F.col("bare"))).drop("fails", "bare")
    lost = F.array_join(F.transform(F.filter("lines", lambda x: x["fails"]), lambda x: x["line"]), "")
    left = F.array_join(F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
    rows = _repeated_words(rows).select(
        "row", *[c for c in COUNTS if c != "lost_chars"],
        F.length(F.regexp_replace(lost, SPACE, "")).cast("long").alias("lost_chars"),
        F.when(F.exists("lines", lambda x: x["fails"]), left).otherwise(F.col("row.text")).alias("cleaned"),
    )
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    kept = ~failed & (F.col("lost_chars") <= F.col("word_chars") * LOST_SHARE)
    return rows.select("row", F.struct(*COUNTS, failed.alias("base_failed"), kept.alias("kept"), "cleaned").alias("q"))


def score(docs: DataFrame) -> DataFrame:
    """Adds to each row the struct `quality` with the counts, the verdicts and the cleaned text.

    Lines that fail a rule are removed first: those without punctuation that head no prose, list items that end in none, navigation (three
    separators, or three words of menus in a short line), lines of symbols, and boilerplate phrases in five languages. A document goes if it fails the base rules
    (fewer than ten words, or over a fifth of its words in repeated windows) or if the removed
    lines held more than half of its word characters. Null text counts as none: rejected, with
    cleaned text null. Very long texts: a row holds a text, its words and eight bytes for each of them some times over. All columns of the input stay, a column `quality` is replaced. Repeated
    rows are scored each by itself; an empty table gives no rows.
    """
    return _measured(docs).select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "quality"], F.col("q").alias("quality"))


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their cleaned texts and the columns of the input.

    Null or empty text has no words and goes, as does whatever else `score` rejects. Repeated rows are judged each by itself, null ids are ids like others, and an empty table gives no rows. `text`, and
    `n_chars` where there is one, are replaced; all other columns stay, whatever their names. A text is judged as one row, and its lines and words are arrays of that row.
    """
    kept = F.filter(F.array("q"), lambda q: q["kept"])  # exploded, not filtered by: a filter would compute the rules twice
    rows = _measured(docs).select("row", F.explode(kept).alias("q"))
    new = {"text": F.col("q.cleaned"), "n_chars": F.length("q.cleaned").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def op10_line_quality(spark, sf_dir):
    """Counts, base verdict and the verdict of line-first cleaning for every document; see `score`."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return score(shared.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *(F.col(f"quality.{n}").alias(n) for n in names))


_BOILERPLATE_SQL = "|".join(BOILERPLATE).replace("'", "''")
_MENU_SQL = ", ".join(f"'{word}'" for word in MENU)
_ENDS_SQL = ENDS.replace("'", "''")

SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (
  SELECT doc_id, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS k FROM w, unnest(range(1, len(ws) - 3)) AS r(i)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(5) AS r(j) GROUP BY doc_id),
li AS (
  SELECT doc_id, i, ls[i] AS l FROM w, unnest(range(1, len(ls) + 1)) AS r(i)),
lr AS (
  SELECT doc_id, i, l, NOT regexp_matches(l, '{PUNCTUATION}') AS bare,
         (regexp_matches(l, '{BULLET}') AND NOT regexp_matches(l, '{_ENDS_SQL}')) OR length(regexp_replace(l, '[^{SEPARATORS}]', '', 'g')) >= {NAV_SEPARATORS}
      OR length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > {SYMBOL_SHARE} * len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))
      OR (length(l) <= {MENU_CHARS} AND len(list_filter(string_split_regex(lower(l), '[^\p{{L}}]+'), lambda x: x IN ({_MENU_SQL}))) >= {MENU_WORDS})
      OR regexp_matches(lower(l), '{_BOILERPLATE_SQL}') AS fails FROM li),
lf AS (
  SELECT doc_id, sum(length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')))::BIGINT AS lost
  FROM (SELECT *, coalesce(lead(NOT fails AND NOT bare) OVER (PARTITION BY doc_id ORDER BY i), false) AS headed FROM lr) WHERE fails OR (bare AND NOT headed)
  GROUP BY doc_id),
q AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lf.lost, 0) AS lost
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lf USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= {LOST_SHARE} * word_chars) AS kept
FROM q"""
