"""Decoding a record DataFrame into typed columns, behind the gate of its findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import CriticalFindings
from ..functions import decoders
from ..functions.decoders import Reading
from ..layout import Item, Layout
from . import profile, rules


def column_names(layout: Layout) -> dict[str, str]:
    """Field key -> column name, FILLER left out; names that repeat carry their offset."""
    items = [i for i in layout.fields() if not i.filler]
    often = [i.name for i in items]
    return {i.key: i.name if often.count(i.name) == 1 else i.key for i in items}


def spark_type(item: Item) -> str:
    if item.usage.floating:
        return "double"
    p = item.picture
    if not p.numeric:
        return "string"
    if p.scale:
        return f"decimal({max(1, min(38, p.digits if not item.usage.binary else p.digits + 10))},{p.scale})"
    if item.usage.binary:
        return "decimal(20,0)" if item.size() == 8 and not p.signed else "bigint"
    return "int" if p.digits <= 9 else "bigint" if p.digits <= 18 else f"decimal({min(38, p.digits)},0)"


def decode(records: DataFrame, layout: Layout, reading: Reading = Reading(), trim: bool = False, null_unset: bool = False, as_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One typed column a field. What can't be decoded is NULL; ``trim`` cuts trailing blanks of texts, ``null_unset`` makes
    low-values NULL, ``as_text`` gives every number as a string."""
    out = [F.col(c) for c in keep]
    for item in layout.fields():
        if item.key not in (names := column_names(layout)):
            continue
        v = decoders.value(item, reading)
        kind = spark_type(item)
        if kind == "string" and trim:
            v = F.regexp_replace(v, f"{decoders.BLANK}+$", "")
        elif kind != "string":
            v = v.cast("string") if as_text else v.try_cast(kind) if kind != "double" else v
        if null_unset:
            v = F.when(~F.hex(decoders.raw(item)).rlike("^(00)*$"), v)
        out.append(v.alias(names[item.key]))
    return records.select(*out)


def gate(findings: list[rules.Finding], force: bool = False) -> None:
    if not force and (bad := [f for f in findings if f.severity == "critical"]):
        raise CriticalFindings(bad)


def extract(records: DataFrame, layout: Layout, out: str, reading: Reading = Reading(), force: bool = False, **options) -> tuple[list[rules.Finding], dict[str, int]]:
    """Scan, gate, decode, write Parquet (or CSV, by the name's end). Returns the findings and how many values of each field are missing."""
    found = rules.evaluate(layout, profile.scan(records, layout, reading), reading)
    gate(found, force)
    df = decode(records, layout, reading, **options)
    seen = Observation()
    if df.columns:
        df = df.observe(seen, *(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns))
    writer = df.write.mode("overwrite")
    if out.endswith(".csv"):
        writer.option("header", True).csv(out)
    else:
        writer.parquet(out)
    return found, {c: n for c, n in (seen.get if df.columns else {}).items() if n}
