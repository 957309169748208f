"""Italian expressions of time as column expressions. What is not wholly understood is null, never guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions.temporal import ROME, let, local_to_utc
from annalist.functions.text import italian_date, squeezed

# The wording of public bulletins and notices.
CLOCK = r"([0-9]{1,2})[:.]([0-9]{2})"
DAY = r"([0-9]{1,2} [a-z]+ [0-9]{4})"
WEEKDAY = r"(?:[a-zàèéìíòù]+,? )?"
SHARED_DAY = rf"(?iu)^dalle ore {CLOCK} alle ore {CLOCK} di {WEEKDAY}{DAY}$"
TWO_DAYS = rf"(?iu)^dalle ore {CLOCK} (?:di )?{WEEKDAY}{DAY} alle ore {CLOCK} (?:di )?{WEEKDAY}{DAY}$"
IN_PROGRESS = rf"(?iu)^in corso fino alle ore {CLOCK} (?:di )?{WEEKDAY}{DAY}$"
NUMERIC = rf"(?i){CLOCK}\s+(?:del\s+)?([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}})"
WEEKDAYS = ["domenica", "lunedì", "martedì", "mercoledì", "giovedì", "venerdì", "sabato"]
OPERATIVE = rf"(?iu)^dalle ore {CLOCK} di (?:({'|'.join(WEEKDAYS)})\s+)?([0-9]{{1,2}})\s+([a-z]+)(?:\s+([0-9]{{4}}))?$"


def local_instant(hour: Column, minute: Column, day: Column, zone: str = ROME) -> Column:
    """UTC of a local time of a day; null where it is no time of that day, or is there twice."""

    def instant(given: Column) -> Column:
        there = given["day"].isNotNull() & (given["hour"].try_cast("int") < 24) & (given["minute"].try_cast("int") < 60)
        clock = F.concat(given["day"].cast("string"), F.lit(" "), F.lpad(given["hour"], 2, "0"), F.lit(":"), given["minute"], F.lit(":00"))
        return local_to_utc(F.when(there, F.try_to_timestamp(clock).cast("timestamp_ntz")), zone)

    return let(F.struct(hour.alias("hour"), minute.alias("minute"), day.alias("day")), instant)


def _interval(start: Column, end: Column) -> Column:
    return let(F.struct(start.alias("start"), end.alias("end")), lambda both: F.when(both["start"] < both["end"], both))


def _numeric_day(day: Column, month: Column, year: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def row_interval(phrase: Column) -> Column:
    """start and end in UTC of an interval in one of three shapes, or null.

    `dalle ore A alle ore B di giorno`, `dalle ore A di giorno alle ore B di giorno`, and any text with exactly two times of
    the shape `A del 1/2/2026`. Reversed or empty intervals and times that do not exist or are ambiguous are null.
    """

    def interval(text: Column) -> Column:
        one, two = (lambda i: F.regexp_extract(text, SHARED_DAY, i)), (lambda i: F.regexp_extract(text, TWO_DAYS, i))
        shared = let(italian_date(one(5)), lambda day: _interval(local_instant(one(1), one(2), day), local_instant(one(3), one(4), day)))
        apart = _interval(local_instant(two(1), two(2), italian_date(two(3))), local_instant(two(4), two(5), italian_date(two(6))))
        part = lambda i, k: F.get(F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(i)), k)
        at = lambda k: local_instant(part(1, k), part(2, k), _numeric_day(part(3, k), part(4, k), part(5, k)))
        numeric = F.when(F.regexp_count(text, F.lit(NUMERIC)) == 2, _interval(at(0), at(1)))
        return F.when(text.rlike(SHARED_DAY), shared).when(text.rlike(TWO_DAYS), apart).otherwise(numeric)

    return let(squeezed(phrase), interval)


def in_progress(phrase: Column) -> Column:
    """Whether a phrase says that something goes on until a time."""
    return F.coalesce(squeezed(phrase).rlike(IN_PROGRESS), F.lit(False))


def in_progress_interval(phrase: Column, issued: Column) -> Column:
    """From the issuance to the end that `in corso fino alle ore A di giorno` states; null if that is not later, or unknown."""

    def interval(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, IN_PROGRESS, i)
        return F.when(text.rlike(IN_PROGRESS), _interval(issued, local_instant(part(1), part(2), italian_date(part(3)))))

    return let(squeezed(phrase), interval)


def operative_start(phrase: Column, published: Column) -> Column:
    """UTC of `dalle ore A di [giorno della settimana] 1 gennaio [anno]`, or null.

    Without a year, that of the publication counts if it fell on the same day of the year. A weekday must be the date's.
    """

    def start(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, OPERATIVE, i)
        year = F.when(part(6) != "", part(6)).otherwise(F.year(published).cast("string"))

        def of_day(day: Column) -> Column:
            named = F.get(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(day) - 1)
            fits = ((part(6) != "") | (day == published)) & ((part(3) == "") | (F.lower(part(3)) == named))
            return F.when(fits, local_instant(part(1), part(2), day))

        return F.when(text.rlike(OPERATIVE), let(italian_date(F.concat_ws(" ", part(4), part(5), year)), of_day))

    return let(squeezed(phrase), start)
