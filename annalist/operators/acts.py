"""References between acts, clarification of measures, and merging of what several windows found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import text, wording
from annalist.operators.shared import scratch

#: What identifies a numbered act.
ACT = ["kind", "number", "year"]


def resolved(references: DataFrame, attached: DataFrame, register: DataFrame, available: DataFrame) -> DataFrame:
    """Each reference with the act it means and how that was found.

    An attachment of the same version comes first, then the only act of that kind, number and year, then,
    for references without a number, the only act of its kind and year. A kind whose register
    could not be read is `unavailable`; several acts are `ambiguous`, none `not_found`.
    """
    own = attached.groupBy("version_id", *ACT).agg(F.min("act_id").alias("_own"))
    numbered = register.groupBy(*ACT).agg(F.count("*").alias("_n"), F.min("act_id").alias("_numbered"))
    of_year = register.groupBy("kind", "year").agg(F.count("*").alias("_m"), F.min("act_id").alias("_only"))
    rows = references.join(own, ["version_id", *ACT], "left").join(numbered, ACT, "left").join(of_year, ["kind", "year"], "left")
    rows = rows.join(available.select("kind", F.lit(True).alias("_readable")), "kind", "left")
    ladder = lambda n, found: F.when(n == 1, found).when(n > 1, "ambiguous").otherwise("not_found")
    searched = F.when(F.col("number").isNotNull(), ladder(F.col("_n"), F.lit("numbered"))).otherwise(ladder(F.col("_m"), F.lit("unique_candidate")))
    method = F.when(F.col("_own").isNotNull(), "attached").when(F.col("_readable").isNull(), "unavailable").otherwise(searched)
    rows = rows.withColumn("method", method)
    act = F.when(F.col("method") == "attached", F.col("_own")).when(F.col("method") == "numbered", F.col("_numbered")).when(F.col("method") == "unique_candidate", F.col("_only"))
    return rows.withColumn("act_id", act).drop("_own", "_n", "_numbered", "_m", "_only", "_readable")


#: Days around a date in which a register is searched, and candidates whose details are read at most.
LATER, BEFORE, UNNUMBERED, MOST_DETAILS = 10, 30, 7, 3
#: Bytes at an attachment's beginning in which it names itself.
HEAD = 1200


def attached_acts(attachments: DataFrame) -> DataFrame:
    """version_id, url, kind, number and year of attachments whose first bytes name a numbered act of a year."""
    head = text.bounded(F.col("text"), HEAD)
    acts = attachments.select("version_id", "url", wording.act_of(head).alias("act")).select("version_id", "url", "act.*")
    return acts.where("number IS NOT NULL").distinct()


#: Days that one key of a search in a register stands for.
BLOCK = 32


def _block(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BLOCK)


def _met(requests: DataFrame, records: DataFrame, keys: list[str], fits: Column, accepted: Column) -> DataFrame:
    """Requests, each once, with how many records fit and how many of them are accepted, and the least act accepted. A record is one row for all acts that do not differ (_n, _least); both meet in blocks of days."""
    wanted = requests.distinct().where("_low <= _high")
    asked = wanted.withColumn("_block", F.explode(F.sequence(_block(F.col("_low")), _block(F.col("_high"))))).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = (F.col("_block") == F.col("_in")) & F.col("_day").between(F.col("_low"), F.col("_high")) & fits
    for k in keys:
        same = same & (F.col(f"_of_{k}") == F.col(k))
    met = asked.join(records.withColumn("_in", _block(F.col("_day"))), same)
    back = [F.col(f"_of_{k}").alias(k) if k in keys else F.col(k) for k in wanted.columns]
    return met.groupBy(*back).agg(F.sum("_n").alias("_found"), F.sum(F.when(accepted, F.col("_n")).otherwise(0)).alias("_accepted"), F.min(F.when(accepted, F.col("_least"))).alias("_act"))


def _told(asked: DataFrame, met: DataFrame, names: list[str]) -> DataFrame:
    """What was found for each asked reference, by its request."""
    a, m = asked.alias("a"), met.alias("m")
    same = F.lit(True)
    for c in names:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"m.{c}"))
    return a.join(m, same).select("a.version_id", "a.reference_id", "m._found", "m._accepted", "m._act")


def _by_number(asked: DataFrame, register: DataFrame) -> DataFrame:
    names = ["source_id", "category", "number", "year", "_low", "_high"]
    acts = register.groupBy("source_id", "category", "number", F.col("year").alias("_year"), F.col("published").alias("_day")).agg(F.count("*").alias("_n"), F.min("act_id").alias("_least"))
    met = _met(asked.select(*names), acts, ["source_id", "category", "number"], F.col("year").isNull() | (F.col("year") == F.col("_year")), F.lit(True))
    return _told(asked, met, names)


def _by_terms(asked: DataFrame, register: DataFrame) -> DataFrame:
    names = ["source_id", "category", "terms", "published", "_low", "_high"]
    acts = register.groupBy("source_id", "category", "object", "act_date", F.col("published").alias("_day")).agg(F.count("*").alias("_n"), F.min("act_id").alias("_least"))
    acts = acts.withColumn("_words", text.stems(F.col("object"))).drop("object")
    dated = F.coalesce(F.col("act_date").between(F.date_sub("published", UNNUMBERED), F.col("published")), F.lit(False))
    met = _met(asked.select(*names), acts, ["source_id", "category"], F.arrays_overlap("terms", "_words"), dated)
    return _told(asked, met, names)


def searched(references: DataFrame, attachments: DataFrame, notices: DataFrame, register: DataFrame, categories: DataFrame, unread: DataFrame | None = None) -> DataFrame:
    """Each reference with `outcome`, `reason`, the attachment's `url` or the register's `act_id`.

    The only attachment of the version that names an act of its kind (number, and year if it has one) comes first.
    Else the register of the notice's source is searched, in the category of the kind: numbered references by number and
    year among what was published within LATER days of their date, or in the BEFORE days up to the notice; others by the
    notice's terms among what was published around the notice, of which the acts dated in the UNNUMBERED days up to it count.
    What is asked alike is searched once, among acts that are counted where they do not differ, so neither side grows as the square of the other.
    Over MOST_DETAILS candidates are ambiguous. Where days of the search could not be read from the register, the reference is `unavailable` for that reason, whatever other days hold.

    references: version_id, reference_id, kind, number, year, day. attachments: version_id, url, text. notices: version_id, source_id,
    published, terms. register: source_id, act_id, category, number, year, published, object, act_date. categories: source_id, kind, category. unread: source_id, since, until, reason (such as a page
    that was not recognized, or a bound on pages).
    """
    near = attached_acts(attachments).select("version_id", F.col("kind").alias("_kind"), F.col("number").alias("_number"), F.col("year").alias("_year"), "url")
    fits = F.col("number").isNull() | ((F.col("number") == F.col("_number")) & (F.col("year").isNull() | (F.col("year") == F.col("_year"))))
    own = references.join(near, "version_id").where((F.col("kind") == F.col("_kind")) & fits).groupBy("version_id", "reference_id").agg(F.countDistinct("url").alias("_n"), F.min("url").alias("url"))
    rows = references.join(own.where("_n = 1").drop("_n"), ["version_id", "reference_id"], "left").join(notices, "version_id", "left").join(categories, ["source_id", "kind"], "left")
    rows = rows.join(categories.select("source_id").distinct().withColumn("_known", F.lit(True)), "source_id", "left")

    path = scratch(rows.sparkSession, "references")
    rows.write.parquet(path)
    rows = rows.sparkSession.read.parquet(path)
    numbered = F.col("number").isNotNull()
    low = F.when(numbered, F.coalesce("day", F.date_sub("published", BEFORE))).otherwise(F.date_sub("published", UNNUMBERED))
    high = F.when(numbered, F.coalesce(F.date_add("day", LATER), F.col("published"))).otherwise(F.date_add("published", LATER))
    asked = rows.where(F.col("url").isNull() & F.col("category").isNotNull() & low.isNotNull()).withColumns({"_low": low, "_high": high})
    found = _by_number(asked.where(numbered), register).unionByName(_by_terms(asked.where(~numbered), register))
    found = found.groupBy("version_id", "reference_id").agg(F.sum("_found").alias("_found"), F.sum("_accepted").alias("_accepted"), F.min("_act").alias("_act"))
    rows = rows.join(found, ["version_id", "reference_id"], "left").fillna(0, ["_found", "_accepted"])
    if unread is None:
        rows = rows.withColumn("_unread", F.lit(None).cast("string"))
    else:
        gaps = asked.join(unread.select("source_id", "since", "until", F.col("reason").alias("_why")), "source_id").where((F.col("since") <= F.col("_high")) & (F.col("until") >= F.col("_low")))
        rows = rows.join(gaps.groupBy("version_id", "reference_id").agg(F.min("_why").alias("_unread")), ["version_id", "reference_id"], "left")

    none = F.lit(None).cast("string")
    reason = (
        F.when(F.col("url").isNotNull(), none)
        .when(F.col("_known").isNull(), "no_configured_register")
        .when(F.col("category").isNull(), "kind_not_published")
        .when(numbered & F.col("day").isNull() & F.col("published").isNull(), "no_date_to_bound_the_search")
        .when(~numbered & F.col("published").isNull(), "publication_date_unknown")
        .when(~numbered & (F.coalesce(F.size("terms"), F.lit(0)) < 1), "no_terms")
        .when(F.col("_unread").isNotNull(), F.col("_unread"))
        .when(F.col("_found") == 0, "no_matching_record")
        .when(F.col("_found") > MOST_DETAILS, "too_many_matching_records")
        .when(F.col("_accepted") == 0, "no_record_in_act_date_window")
        .when(F.col("_accepted") > 1, "several_matching_records")
    )
    rows = rows.withColumn("reason", reason)
    ambiguous = F.col("reason").isin("too_many_matching_records", "several_matching_records")
    outcome = F.when(F.col("url").isNotNull(), "attached").when(F.col("reason") == F.col("_unread"), "unavailable").when(ambiguous, "ambiguous").when(F.col("reason").isNotNull(), "not_found").when(numbered, "numbered").otherwise("unique_candidate")
    return rows.select("version_id", "reference_id", outcome.alias("outcome"), "reason", "url", F.when(F.col("reason").isNull() & F.col("url").isNull(), F.col("_act")).alias("act_id"))


def matched_dispositions(measures: DataFrame, clauses: DataFrame) -> DataFrame:
    """Measures with `outcome` against the clause of the act they refer to.

    The disposition of a measure's kind that holds its subject's head term, if it is the only one, matches; without one it is not_matched. A known
    validity that begins with the clause stays (`kept`), any other known one is a conflict; an unknown one is clarified and takes the clause's start, end and condition.
    measures: measure_id, act_id, kind, subject, precision, start. clauses: act_id, clause_start, clause_end, condition, dispositions (ordinal, kind, text).
    """
    head = text.head_term(F.col("subject"))
    words = lambda t: F.transform(F.filter(F.split(F.lower(t), text.NO_LETTERS), lambda w: F.length(w) >= 4), text.stem)
    rows = measures.join(clauses, "act_id", "left").withColumn("_head", head)
    hits = F.filter("dispositions", lambda d: (d["kind"] == F.col("kind")) & (F.col("_head") != "") & F.array_contains(words(d["text"]), F.col("_head")))
    rows = rows.withColumn("disposition", F.when(F.size(hits) == 1, hits[0]["ordinal"]))
    known = F.col("precision") != "unknown"
    outcome = F.when(F.col("disposition").isNull(), "not_matched").when(known & F.coalesce(F.col("start") == F.col("clause_start"), F.lit(False)), "kept").when(known, "conflict").otherwise("clarified")
    rows = rows.withColumn("outcome", outcome)
    told = lambda c: F.when(F.col("outcome") == "clarified", F.col(c))
    return rows.select("measure_id", "outcome", "disposition", told("clause_start").alias("start"), told("clause_end").alias("end"), told("condition").alias("condition"))


def clarified(measures: DataFrame, clauses: DataFrame) -> DataFrame:
    """Measures against the clauses of the act they refer to: not_matched, conflict or clarified, with the end that a clause gives.

    A clause matches on act, kind and subject. Clauses that disagree on the end, or a start other than the measure's, conflict.
    """
    told = clauses.groupBy("act_id", "kind", "subject").agg(
        F.countDistinct("clause_end").alias("_ends"), F.min("clause_start").alias("_first"), F.max("clause_start").alias("_last"), F.max("clause_end").alias("_end")
    )
    rows = measures.join(told, ["act_id", "kind", "subject"], "left")
    other = (F.col("_first") != F.col("_last")) | (F.col("_first") != F.col("start"))
    state = F.when(F.col("_first").isNull(), "not_matched").when((F.col("_ends") > 1) | other, "conflict").otherwise("clarified")
    rows = rows.withColumn("state", state)
    return rows.withColumn("end", F.when(F.col("state") == "clarified", F.col("_end"))).drop("_ends", "_first", "_last", "_end")


def merged(measures: DataFrame, scope: list[str]) -> DataFrame:
    """Measures of one scope put together by kind, subject in any case, and place, with all their evidence.

    A kind and subject that occur both with a place and without one conflict.
    """
    rows = measures.withColumn("subject", F.lower("subject"))
    one = rows.groupBy(*scope, "kind", "subject", "place").agg(F.array_sort(F.collect_set("evidence")).alias("evidence"), F.count("*").alias("n"))
    both = rows.groupBy(*scope, "kind", "subject").agg((F.bool_or(F.col("place").isNull()) & F.bool_or(F.col("place").isNotNull())).alias("conflict"))
    return one.join(both, [*scope, "kind", "subject"])


def temporal_choice(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The validity of each key from its candidates: resolved if there is one, shortest if all begin alike, else conflict.

    A conflict is named by a hash of its distinct candidates in order.
    """
    shown = F.concat_ws("/", F.col("start").cast("string"), F.coalesce(F.col("end").cast("string"), F.lit("")))
    rows = candidates.groupBy(*keys).agg(
        F.countDistinct(shown).alias("_n"), F.countDistinct("start").alias("_starts"), F.count_if(F.col("start").isNull()).alias("_unknown"),
        F.min("start").alias("start"), F.min("end").alias("end"), F.array_sort(F.collect_set(shown)).alias("_all"),
    )
    state = F.when(F.col("_n") == 1, "resolved").when((F.col("_starts") == 1) & (F.col("_unknown") == 0), "shortest").otherwise("conflict")
    rows = rows.withColumn("state", state)
    conflict = F.when(F.col("state") == "conflict", F.substring(F.sha2(F.array_join("_all", ";"), 256), 1, 24))
    kept = lambda c: F.when(F.col("state") != "conflict", F.col(c)).alias(c)
    return rows.select(*keys, "state", kept("start"), kept("end"), conflict.alias("conflict_id"))


def latest_resolutions(resolutions: DataFrame, known_at: Column) -> DataFrame:
    """The last resolution of each reference that was recorded by then."""
    from annalist.operators import asof

    return asof.latest(resolutions.where(F.col("recorded_at") <= known_at), ["version_id", "reference_id"], ["recorded_at", "id"])


def envelopes(outputs: DataFrame, raw: str, schema: str, kinds: list[str], source: str) -> DataFrame:
    """Outputs of a model with `reason`: invalid_json, unknown_kind, quote_missing, or null where nothing is wrong.

    `schema` has kind and quote; the quote must stand in the column `source` word for word.
    """
    parsed = F.from_json(F.col(raw), schema, {"mode": "PERMISSIVE"})
    rows = outputs.withColumn("_o", parsed)
    broken = F.col("_o").isNull() | F.col("_o.kind").isNull() | F.col("_o.quote").isNull()
    reason = F.when(broken, "invalid_json").when(~F.col("_o.kind").isin(*kinds), "unknown_kind").when(F.instr(F.col(source), F.col("_o.quote")) == 0, "quote_missing")
    return rows.withColumn("reason", reason).drop("_o")


def supported_kind(kind: Column, evidence: Column, lexicon: dict[str, str]) -> Column:
    """Whether the evidence of a kind holds a word that stands for it; kinds without words are not supported."""
    out = F.lit(False)
    for name, words in lexicon.items():
        out = F.when(kind == name, F.lower(evidence).rlike(words)).otherwise(out)
    return out
