"""One pass of statistics over all fields of a record DataFrame.

All counters of up to ``CHUNK`` fields are one aggregate: partial sums on the map side, one row shuffled for each task. Counters
are exact, and byte sets are bounded by 256 values. Value histograms, which alone can grow with the data, are a grouped
DataFrame (``values``), of which only the most frequent few come back.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codepages, decoders
from ..functions.decoders import BLANK, Reading, raw
from ..layout import Item, Layout, Usage

#: Fields of one aggregate: more could outgrow the JVM's limits on generated code.
CHUNK = 40
#: Values of a field that come back with their counts.
TOP = 5


@dataclass
class FieldStats:
    """Counters of one field over ``examined`` records; the groups that don't apply to a field stay at their zero."""

    examined: int = 0
    blank: int = 0
    unset: int = 0
    all_zero: int = 0
    undecodable: int = 0
    nondigit_last: int = 0
    negative: int = 0
    positive: int = 0
    ascii_signed: int = 0
    unknown_sign: int = 0
    invalid_packed: int = 0
    widest: int = 0
    float_nonzero: int = 0
    float_unnormalised: int = 0
    float_exponents: int = 0
    float_heads: int = 0
    float_tails: int = 0
    binary_nonzero: int = 0
    binary_heads: int = 0
    binary_tails: int = 0
    binary_max: int = 0
    binary_over: int = 0
    total: Decimal | float = Decimal(0)
    total_abs: Decimal = Decimal(0)
    total_naive: Decimal = Decimal(0)
    total_forced: Decimal = Decimal(0)
    distinct: int = 0
    top: list[tuple[str, int]] = field(default_factory=list)
    #: Values that no condition accounts for: how many records, and the most frequent ones.
    uncovered: int = 0
    uncovered_top: list[tuple[str, int]] = field(default_factory=list)
    unknown_bytes: list[tuple[str, int]] = field(default_factory=list)


_NAMES = {f.name for f in fields(FieldStats)}


def _byte(raw: Column, i: int) -> Column:
    return F.ascii(F.decode(F.substring(raw, i, 1), "ISO-8859-1"))


def _set(value: Column, keep: Column) -> Column:
    """How many of the 256 byte values occur: four 64-bit maps, which unlike sets are summed up in generated code."""
    seen = lambda q: F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.when(keep & (F.shiftright(value, 6) == q), value.bitwiseAND(63))))
    return sum((F.coalesce(F.bit_count(seen(q)), F.lit(0)) for q in range(1, 4)), F.coalesce(F.bit_count(seen(0)), F.lit(0)))


def _some(b: Column, size: int) -> Column:
    """Any byte isn't zero."""
    return b != F.lit(bytes(size))


def _float(item: Item, b: Column, reading: Reading) -> dict[str, Column]:
    some = _some(b, item.size())
    v = decoders.float_value(b, item.size(), reading.floats)
    return {
        "float_nonzero": F.count_if(some), "float_unnormalised": F.count_if(decoders.unnormalised(b)),
        "float_exponents": _set(_byte(b, 1).bitwiseAND(127), some), "float_heads": _set(_byte(b, 1), some), "float_tails": _set(decoders.last_byte(b), some),
        "total": F.sum(v), "undecodable": F.count_if(v.isNull()),
    }


def _binary(item: Item, b: Column, reading: Reading) -> dict[str, Column]:
    pic = item.picture
    some = _some(b, item.size())
    v = decoders.binary(b, pic.signed, item.size(), reading.order)
    size = F.abs(v)
    return {
        "binary_nonzero": F.count_if(some), "binary_heads": _set(_byte(b, 1), some), "binary_tails": _set(decoders.last_byte(b), some),
        "binary_max": F.max(size), "binary_over": F.count_if(size > F.lit(str(10**pic.digits - 1)).cast("decimal(38,0)")),
        "total": F.sum(decoders.scaled(size.cast("string"), pic.scale, v < 0)),
    }


def sign_columns(b: Column, text: Column, page: str) -> tuple[Column, Column, Column]:
    """(sign 1, -1 or NULL, the digit it stands for, whether the last byte is no digit, sign or padding) of a zoned field."""
    last = F.right(text, F.lit(1))
    z = decoders.zone(b)
    if codepages.is_ascii(page):
        z = F.coalesce(z, F.when(decoders.ascii_zone(b) < 0, -1))
    s, digit = decoders.punched(last)
    sign = F.coalesce(z, s)
    low = F.when(z.isNotNull(), decoders.last_byte(b).bitwiseAND(15).cast("string")).otherwise(digit)
    unknown = sign.isNull() & (F.length(last) > 0) & ~last.rlike(r"^[0-9\x00 \xFF]$")
    return sign, low, unknown


def zoned_parts(item: Item, b: Column, text: Column, reading: Reading) -> dict[str, Column]:
    """What the aggregates of a zoned field read: sign, unknown, and its values as read, unsigned digits, and with any sign honoured."""
    pic = item.picture
    sign, low, unknown = sign_columns(b, text, reading.page)
    v = decoders.display(b, pic, reading.page, item.leading, item.separate, text)
    digits = F.when(sign.isNotNull(), F.concat(F.substr(text, F.lit(1), F.length(text) - 1), low)).otherwise(text)
    found = {"sign": sign, "unknown": unknown, "v": v, "naive": decoders.display_digits_only(b, reading.page, text), "digits": F.regexp_replace(digits, "[^0-9]", "")}
    if not pic.signed:
        found["forced"] = decoders.display(b, replace(pic, signed=True), reading.page, text=text)
    return found


def plain_digits(item: Item, page: str) -> bool:
    """Whether most values of a field are digit bytes with a sign zone on the last one at most, and fit a long."""
    chars = codepages.decoded(page)
    usual = chars is not None and chars[0xF0:0xFA] == "0123456789" and not any(c.isdigit() for c in chars[0xC0:0xCA] + chars[0xD0:0xDA])
    return usual and item.numeric and item.usage is Usage.DISPLAY and not item.leading and not item.separate and item.size() == item.total() <= 18


def _plain(item: Item, n: Column, z: Column, slow: dict[str, Column]) -> dict[str, Column]:
    """``slow``, the aggregates of values for which ``n`` is NULL, with those of plain digits: their number and last zone (C, D or F)."""
    signed = F.when(z == "D", -n).otherwise(n)
    scale = F.lit(10**item.picture.scale)
    exact = lambda name, value: (F.coalesce(F.sum(value.cast("decimal(18,0)")), F.lit(0)) / scale).cast(f"decimal(38,{item.picture.scale})") + F.coalesce(slow[name], F.lit(0))
    found = slow | {
        "nondigit_last": slow["nondigit_last"] + F.count_if(z.isin("C", "D")), "negative": slow["negative"] + F.count_if(z == "D"), "positive": slow["positive"] + F.count_if(z == "C"),
        "all_zero": slow["all_zero"] + F.count_if(n == 0), "widest": F.greatest(F.coalesce(slow["widest"], F.lit(0)), F.coalesce(F.max(F.when(n == 0, 0).otherwise(F.length(n.cast("string")))), F.lit(0))),
        "total": exact("total", signed if item.picture.signed else n), "total_abs": exact("total_abs", n),
        "total_naive": F.coalesce(F.sum(F.when(z == "F", n).otherwise(F.floor(n / 10)).cast("decimal(18,0)")), F.lit(0)) + F.coalesce(slow["total_naive"], F.lit(0)),
    }
    return found | ({"total_forced": exact("total_forced", signed)} if "total_forced" in slow else {})


def _display(b: Column, text: Column, c: dict[str, Column]) -> dict[str, Column]:
    sign, v = c["sign"], c["v"]
    found = {
        "nondigit_last": F.count_if(sign.isNotNull()), "negative": F.count_if(sign < 0), "positive": F.count_if(sign > 0),
        "ascii_signed": F.count_if(decoders.zone(b).isNull() & F.right(text, F.lit(1)).isin("+", "-")), "unknown_sign": F.count_if(c["unknown"]),
        "all_zero": F.count_if(c["digits"].rlike("^0+$")), "widest": F.max(F.length(F.ltrim(c["digits"], F.lit("0")))),
        "total": F.sum(v), "total_abs": F.sum(F.abs(v)), "total_naive": F.sum(F.when(v.isNotNull(), c["naive"])),
    }
    return found | ({"total_forced": F.sum(c["forced"])} if "forced" in c else {})


def aggregates(item: Item, reading: Reading, b: Column, text: Column | None = None, parts: dict[str, Column] | None = None) -> dict[str, Column]:
    """Aggregate Columns of one field, by FieldStats name. ``text`` and ``parts`` stand for its text and zoned_parts where lower projections have them."""
    found = {"examined": F.count(F.lit(1))}
    if item.usage.floating:
        return found | _float(item, b, reading)
    text = codepages.text(b, reading.page) if text is None else text
    found["undecodable"] = F.count_if(F.contains(text, F.lit("�")))
    if not item.numeric or item.usage is Usage.DISPLAY:
        found |= {"blank": F.count_if(text.rlike(f"^{BLANK}*$")), "unset": F.count_if(decoders.unset(text))}
    if not item.numeric:
        return found
    if item.usage is Usage.COMP3:
        good = decoders.packed_strict(b)
        return found | {"invalid_packed": F.count_if(~good), "total": F.sum(F.when(good, decoders.packed(b, item.picture.scale)))}
    return found | (_binary(item, b, reading) if item.usage.binary else _display(b, text, zoned_parts(item, b, text, reading) if parts is None else parts))


def covered(item: Item, value: Column) -> Column:
    """A coded value that some 88-level accounts for, or that is unset."""
    singles = [v for vs in item.conditions.values() for v in vs]
    tests = [value.isin(singles)] if singles else []
    for low, high in (r for rs in item.ranges.values() for r in rs):
        tests.append(value.between(low, high))
        try:
            a, z = Decimal(low), Decimal(high)
        except ArithmeticError:
            continue
        tests.append(F.coalesce(value.try_cast("decimal(38,10)").between(F.lit(a), F.lit(z)), F.lit(False)))
    return decoders.unset(value) | decoders.any_of(tests)


def _coded(item: Item) -> bool:
    return bool(item.conditions or item.ranges)


def values(records: DataFrame, items: list[Item], reading: Reading) -> DataFrame:
    """(key, value, n, first): how often each value occurs, and where first. Texts are as they are, coded numbers stripped."""
    each = [F.struct(F.lit(i.key).alias("key"), (codepages.text(raw(i), reading.page) if not i.numeric else decoders.strip(codepages.text(raw(i), reading.page))).alias("value")) for i in items]
    return records.select("rec_no", F.explode(F.array(*each)).alias("x")).groupBy("x.key", "x.value").agg(F.count(F.lit(1)).alias("n"), F.min("rec_no").alias("first"))


def _ranked(counted: DataFrame, keep: int) -> dict[str, list[tuple[str, int]]]:
    """The most frequent values by key; ties go to the one seen first. Ranking is cut to ``keep`` rows before its shuffle."""
    at = Window.partitionBy("key").orderBy(F.desc("n"), "first", "value")
    out: dict[str, list] = {}
    for r in counted.withColumn("at", F.row_number().over(at)).where(F.col("at") <= keep).orderBy("key", "at").collect():
        out.setdefault(r["key"], []).append((r["value"], r["n"]))
    return out


def scan(records: DataFrame, layout: Layout, reading: Reading = Reading()) -> dict[str, FieldStats]:
    """FieldStats of every elementary field, by ``name@offset``."""
    items, stats = layout.fields(), {}
    for a in range(0, len(items), CHUNK):
        part = items[a : a + CHUNK]
        # texts and zoned parts are computed once, in projections of their own: several aggregates read them. Those of plain
        # digits, which are most values, come from their number alone
        plain = {k for k, i in enumerate(part) if plain_digits(i, reading.page)}
        slices = records.select(*(raw(i).alias(f"b{k}") for k, i in enumerate(part)))
        slices = slices.select("*", *(F.hex(f"b{k}").alias(f"h{k}") for k in plain))
        slices = slices.select("*", *(F.when(F.col(f"h{k}").rlike("^(F[0-9])*[CDF][0-9]$") & (F.octet_length(f"b{k}") == part[k].size()), F.translate(f"h{k}", "CDF", "").cast("long")).alias(f"n{k}") for k in plain))
        slices = slices.select("*", *(F.when(F.col(f"n{k}").isNotNull(), F.substring(f"h{k}", -2, 1)).alias(f"z{k}") for k in plain))
        odd = lambda k, c: F.when(F.col(f"n{k}").isNull(), c) if k in plain else c
        slices = slices.select("*", *(odd(k, codepages.text(F.col(f"b{k}"), reading.page)).alias(f"t{k}") for k, i in enumerate(part) if not i.usage.floating))
        parts = {k: zoned_parts(i, F.col(f"b{k}"), F.col(f"t{k}"), reading) for k, i in enumerate(part) if i.numeric and i.usage is Usage.DISPLAY}
        slices = slices.select("*", *(odd(k, c).alias(f"{n}{k}") for k, p in parts.items() for n, c in p.items()))
        here = {k: {n: F.col(f"{n}{k}") for n in p} for k, p in parts.items()}
        wanted = {}
        for k, i in enumerate(part):
            own = F.when(F.col(f"n{k}").isNull(), F.col(f"b{k}")) if k in plain else F.col(f"b{k}")
            found = aggregates(i, reading, own, None if i.usage.floating else F.col(f"t{k}"), here.get(k))
            found = _plain(i, F.col(f"n{k}"), F.col(f"z{k}"), found) if k in plain else found
            wanted |= {(k, n): c.alias(f"{n}{k}") for n, c in found.items()}
        row = slices.agg(*wanted.values()).first()
        for k, item in enumerate(part):
            got = {n: row[f"{n}{k}"] for (j, n) in wanted if j == k}
            stats[item.key] = FieldStats(**{n: (v if n.startswith("total") else int(v)) for n, v in got.items() if v is not None and n in _NAMES})
    listed = [i for i in items if not i.usage.floating and (not i.numeric or _coded(i))]
    if listed:
        counted = values(records, listed, reading).persist()
        for r in counted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect():
            stats[r["key"]].distinct = r["n"]
        for key, top in _ranked(counted.where(F.col("key").isin([i.key for i in listed if i.filler])), 3).items():
            stats[key].top = top
        coded = [i for i in listed if _coded(i)]
        if coded:
            text = decoders.strip(F.col("value"))
            open_ = decoders.any_of([(F.col("key") == i.key) & ~covered(i, text) for i in coded])
            left = counted.where(open_).groupBy("key", text.alias("value")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
            for r in left.groupBy("key").agg(F.sum("n").alias("n")).collect():
                stats[r["key"]].uncovered = r["n"]
            for key, top in _ranked(left, TOP).items():
                stats[key].uncovered_top = top
        counted.unpersist()
    for item in items:
        if stats[item.key].unknown_sign:
            b = raw(item)
            unknown = sign_columns(b, codepages.text(b, reading.page), reading.page)[2]
            stats[item.key].unknown_bytes = [(r["value"], r["n"]) for r in records.where(unknown).groupBy(F.concat(F.lit("0x"), F.hex(F.substring(b, -1, 1))).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("rec_no").alias("first")).orderBy(F.desc("n"), "first").limit(4).collect()]
    return stats


def stats_frame(spark, layout: Layout, stats: dict[str, FieldStats]) -> DataFrame:
    """One row a field: its place and its main counters."""
    rows = [(i.key, i.name, i.offset, i.total(), i.usage.value, s.examined, s.blank, s.unset, s.all_zero, s.negative, s.positive, s.unknown_sign, s.invalid_packed, s.widest, s.distinct, str(s.total), str(s.total_abs)) for i in layout.fields() for s in [stats[i.key]]]
    return spark.createDataFrame(rows, "field_key string, name string, offset int, bytes int, usage string, examined long, blank long, unset long, all_zero long, negative long, positive long, unknown_sign long, invalid_packed long, widest long, distinct long, total string, total_abs string")
