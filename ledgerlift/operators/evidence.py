"""Questions that only the records can answer: keys, branches, dates, code pages. Each is one aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codepages, decoders
from ..functions.decoders import BLANK, raw
from ..layout import Item, Usage

#: Fixed value: characters that count as legible.
LEGIBLE = "A-Za-z0-9 .,\\-/()"
#: Fixed value: characters that a text may hold to look right as a branch's field.
TEXT = LEGIBLE + "&'"
#: Pages that a file may be in, and records that legibility and dates are judged by.
PAGES, SAMPLE = ("cp037", "cp500", "cp1047", "cp1140", "latin-1"), 2000


def key_counts(records: DataFrame, items: list[Item], page: str) -> dict[str, int]:
    """records, distinct and blank composite keys. Grouped before counting, so that a hot key is summed where it is read."""
    key = F.struct(*(codepages.text(raw(i), page).alias(f"k{n}") for n, i in enumerate(items)))
    whole = reduce(F.concat, (codepages.text(raw(i), page) for i in items))
    grouped = records.groupBy(key.alias("key"), whole.rlike(f"^{BLANK}*$").alias("blank")).agg(F.count(F.lit(1)).alias("n"))
    row = grouped.agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("distinct"), F.sum(F.when(F.col("blank"), F.col("n"))).alias("blank")).first()
    return {k: row[k] or 0 for k in ("records", "distinct", "blank")}


def looks_right(item: Item, page: str):
    """Whether the bytes can be what the field declares; a field without such a test always can."""
    t = codepages.text(raw(item), page)
    if item.numeric and item.usage is Usage.DISPLAY:
        return (F.substr(t, F.lit(1), F.length(t) - 1) if item.picture.signed else t).rlike("^[0-9]+$")
    return t.rlike(f"^[{TEXT}]*$") if item.picture is not None and not item.numeric else F.lit(True)


def branch_fit(records: DataFrame, discriminator: Item, values: list[str], branches: dict[str, list[Item]], page: str) -> DataFrame:
    """(value, seen, and for each branch b<i> the sum of its fields that look right) of the discriminator's listed values."""
    code = decoders.strip(codepages.text(raw(discriminator), page))
    fits = [F.sum(sum((looks_right(i, page).cast("int") for i in leaves), F.lit(0))).alias(f"b{n}") for n, leaves in enumerate(branches.values())]
    return records.select(code.alias("value"), "rec").where(F.col("value").isin(values)).groupBy("value").agg(F.count(F.lit(1)).alias("seen"), *fits)


def date_counts(records: DataFrame, item: Item, page: str, most: int | None = SAMPLE) -> tuple[int, int]:
    """(dates as yyyymmdd, other values) of the first records; None: of all."""
    t = decoders.strip(codepages.text(raw(item), page))
    sign, digit = decoders.punched(F.right(t, F.lit(1)))
    digits = F.regexp_replace(F.when(sign.isNotNull(), F.concat(F.substr(t, F.lit(1), F.length(t) - 1), digit)).otherwise(t), "[^0-9]", "")
    good = digits.rlike("^[0-9]{8}$") & ~digits.startswith("0000") & F.try_to_date(digits, "yyyyMMdd").isNotNull()
    some = records if most is None else records.where(F.col("rec_no") < most)
    ok, n = some.agg(F.count_if(good), F.count(F.lit(1))).first()
    return ok, n - ok


def legibility(records: DataFrame, item: Item, most: int | None = SAMPLE, pages: tuple[str, ...] = PAGES) -> dict[str, float]:
    """Share of legible characters under each known page, to three places; all pages in one aggregate."""
    known = [p for p in pages if codepages.known(p)]
    some = records if most is None else records.where(F.col("rec_no") < most)
    text = {p: codepages.text(raw(item), p) for p in known}
    row = some.agg(*(F.sum(F.length(F.regexp_replace(text[p], f"[^{LEGIBLE}]", ""))).alias(f"good{n}") for n, p in enumerate(known)), *(F.sum(F.length(text[p])).alias(f"all{n}") for n, p in enumerate(known))).first()
    return {p: round(row[f"good{n}"] / row[f"all{n}"], 3) if row[f"all{n}"] else 0.0 for n, p in enumerate(known)}
