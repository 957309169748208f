"""Documents that listing pages link, read as each source's configuration says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import markup
from annalist.functions.text import MONTHS

ENGLISH = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def listing_day(raw: Column, layout: Column, locale: Column, layouts: list[str] | None = None) -> Column:
    """The day that a text says in a layout (a Spark pattern with English months); Italian months may be whole or their first three letters. Null for a day that there is not, another layout or another locale.

    `layouts` are those that occur, if they are known: a formatter for one is made once, for that of a column with every row.
    """
    names = {name: short for whole, short in zip(MONTHS, ENGLISH, strict=True) for name in (whole, whole[:3])}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    words = F.split(raw, " ")
    english = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), w)), " ")
    told = F.when(locale == "it", english).otherwise(raw)
    read = F.try_to_timestamp(told, layout) if layouts is None else F.lit(None).cast("timestamp")
    for known in layouts or ():
        read = F.when(layout == known, F.try_to_timestamp(told, F.lit(known))).otherwise(read)
    return F.when(locale.isin("it", "en"), read).cast("date")


def discovered(pages: DataFrame, configurations: DataFrame) -> DataFrame:
    """source_id, page_id, url, title and day of the documents that pages (source_id, page_id, url, html) link.

    A configuration per source_id has prefixes (of documents' paths), item_class, date_class, date_label, layout and locale; without classes, layout or locale only links are read.
    Pages of sources without one are left out. A page is parsed once; a page that links no document has no row.
    """
    whole = F.col("layout").isNotNull() & F.col("locale").isNotNull()
    classes = [F.when(whole, F.col(c)) for c in ("item_class", "date_class", "date_label")]
    p, c = pages.alias("p"), configurations.alias("c")
    rows = p.join(c, F.col("p.source_id") == F.col("c.source_id")).select("p.source_id", "p.page_id", "p.url", "p.html", "c.prefixes", "c.item_class", "c.date_class", "c.date_label", "c.layout", "c.locale")
    layouts = sorted(r["layout"] for r in configurations.where(whole).select("layout").distinct().collect())  # a few of them
    found = rows.select("source_id", "page_id", "layout", "locale", F.explode(markup.listed_documents("html", "url", "prefixes", *classes)).alias("d"))
    return found.select("source_id", "page_id", "d.url", "d.title", listing_day(F.col("d.date"), F.col("layout"), F.col("locale"), layouts).alias("day"))
