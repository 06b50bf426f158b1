"""Decoders: Columns over a record's bytes. Bytes that aren't a value give NULL, never a guess."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..layout import Item, Picture, Usage
from . import codepages

# The zoned sign characters of positive and negative numbers, by their last digit.
POSITIVE, NEGATIVE = "{ABCDEFGHI", "}JKLMNOPQR"
#: Whitespace as a record field can hold it, for regular expressions.
BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0]"


@dataclass(frozen=True)
class Reading:
    """How bytes are read: code page, float format (hfp, ieee, ieee-le), byte order of binary fields."""

    page: str = "cp037"
    floats: str = "hfp"
    order: str = "big"

    def __post_init__(self):
        if not codepages.known(self.page):
            raise LookupError(f"unknown code page {self.page}")
        if self.floats not in ("hfp", "ieee", "ieee-le") or self.order not in ("big", "little"):
            raise ValueError(f"no such reading: {self}")


def let(x: Column, use) -> Column:
    """``use(x)`` with x computed once, however often it is used: Columns are trees, which would repeat it."""
    return F.element_at(F.transform(F.array(x), use), 1)


def raw(item: Item, rec: Column | None = None, at: int = 0) -> Column:
    """Bytes of all occurrences, or of the record slice ``at`` bytes on. Short records give short slices."""
    return F.substring(F.col("rec") if rec is None else rec, item.offset + at + 1, item.total())


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def last_byte(raw: Column) -> Column:
    return F.ascii(F.right(F.decode(raw, "ISO-8859-1"), F.lit(1)))


def zone(raw: Column) -> Column:
    """-1 or 1 where the last byte carries an EBCDIC sign zone over a digit, else NULL."""
    b = last_byte(raw)
    digit = b.bitwiseAND(15) <= 9
    return F.when(F.shiftright(b, 4) == 13, F.when(digit, -1)).when(F.shiftright(b, 4) == 12, F.when(digit, 1))


def ascii_zone(raw: Column) -> Column:
    """-1 for 0x70 to 0x79, 1 for 0x30 to 0x39."""
    b = last_byte(raw)
    return F.when(b.between(0x70, 0x79), -1).when(b.between(0x30, 0x39), 1)


def punched(char: Column) -> tuple[Column, Column]:
    """(sign, digit) of a zoned sign character; sign NULL for others. A bare + or - has the empty digit."""
    up, down = F.instr(F.lit(POSITIVE), char), F.instr(F.lit(NEGATIVE), char)
    one = F.length(char) == 1
    sign = F.when(one & ((down > 0) | (char == "-")), -1).when(one & ((up > 0) | (char == "+")), 1)
    return sign, F.when(char.isin("+", "-"), "").otherwise((F.greatest(up, down) - 1).cast("string"))


def scaled(digits: Column, scale: int, negative: Column | None = None) -> Column:
    """Exact decimal of a digit string (blank is zero) with the point put ``scale`` digits from its end."""
    d = F.coalesce(F.nullif(digits, F.lit("")), F.lit("0"))
    if scale:
        # zeros in front make room for the point; the cast drops them again
        d = F.regexp_replace(F.concat(F.lit("0" * (scale + 1)), d), f"([0-9]{{{scale}}})$", ".$1")
    if negative is not None:
        d = F.concat(F.when(negative, "-").otherwise(""), d)
    return d.try_cast(f"decimal(38,{scale})")


def display_parts(raw: Column, t: Column, pic: Picture, page: str, leading: bool = False, separate: bool = False) -> tuple[Column, Column]:
    """(digits, sign as 1 or -1) of a zoned field of stripped text ``t``, sign as the bytes carry it."""
    n = F.length(t)
    head, tail, first, end = F.substr(t, F.lit(1), n - 1), F.substr(t, F.lit(2)), F.left(t, F.lit(1)), F.right(t, F.lit(1))
    if pic.signed and separate:
        body, sign = (tail, F.when(first == "-", -1)) if leading else (head, F.when(end == "-", -1))
    elif leading:
        s, digit = punched(first)
        body, sign = F.when(s.isNotNull(), F.concat(digit, tail)).otherwise(t), s
    else:
        s, digit = punched(end)
        z = F.coalesce(zone(raw), ascii_zone(raw)) if codepages.is_ascii(page) else zone(raw)
        low = last_byte(raw).bitwiseAND(15).cast("string")
        body = F.when(n == 0, "").when(z.isNotNull(), F.concat(head, low)).when(s.isNotNull(), F.concat(head, digit)).otherwise(t)
        sign = F.when(n > 0, F.coalesce(z, s))
    return F.regexp_replace(body, "[^0-9]", ""), F.coalesce(sign, F.lit(1))


def display(raw: Column, pic: Picture, page: str = "cp037", leading: bool = False, separate: bool = False, text: Column | None = None) -> Column:
    """``text`` is the field's text where the caller has it."""

    def parts(t: Column) -> Column:
        digits, sign = display_parts(raw, t, pic, page, leading, separate)
        return scaled(digits, pic.scale, sign < 0 if pic.signed else None)

    return let(strip(codepages.text(raw, page) if text is None else text), parts)


def display_digits_only(raw: Column, page: str = "cp037", text: Column | None = None) -> Column:
    """What a reader makes of the field that knows neither sign nor scale."""
    return scaled(F.regexp_replace(codepages.text(raw, page) if text is None else text, "[^0-9]", ""), 0)


def packed(raw: Column, scale: int = 0) -> Column:
    h = F.hex(raw)
    value = scaled(F.substr(h, F.lit(1), F.length(h) - 1), scale, F.right(h, F.lit(1)).isin("B", "D"))
    return F.when(F.length(raw) == 0, F.lit(0).cast(f"decimal(38,{scale})")).when(h.rlike("^[0-9]+[A-F]$"), value)


def packed_strict(raw: Column) -> Column:
    """Whether the nibbles are packed decimal with a sign that compilers write; empty is."""
    return F.hex(raw).rlike("^([0-9]+[CDF])?$")


def reversed_bytes(raw: Column, n: int) -> Column:
    return F.concat(*(F.substring(raw, i, 1) for i in range(n, 0, -1)))


def binary(raw: Column, signed: bool, width: int, order: str = "big") -> Column:
    """Two's complement of up to eight bytes, unscaled."""
    b = reversed_bytes(raw, width) if order == "little" else raw
    n = F.length(b)
    h = F.when((n > 0) & (n <= 8), F.hex(b)).otherwise(F.lit("0"))
    value = F.conv(h, 16, 10).cast("decimal(38,0)")
    if signed:
        powers = F.array(*(F.lit(str(1 << 8 * i)).cast("decimal(38,0)") for i in range(1, 9)))
        value = F.when((n > 0) & F.left(h, F.lit(1)).isin(*"89ABCDEF"), value - F.element_at(powers, F.greatest(n, F.lit(1)))).otherwise(value)
    return F.when(n <= 8, value)


def _bits(h: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(h, start, n), 16, 10).cast("long")


def hex_float(raw: Column, width: int) -> Column:
    """IBM hexadecimal float. A long one has 56 fraction bits and is rounded to double."""
    h = F.hex(raw)
    top, fraction = _bits(h, 1, 2), _bits(h, 3, 2 * width - 2).cast("double")
    value = fraction / float(1 << 8 * (width - 1)) * F.pow(F.lit(16.0), top.bitwiseAND(127) - 64)
    return F.when(F.length(raw) == width, F.when(fraction == 0, 0.0).otherwise(F.when(top >= 128, -value).otherwise(value)))


def ieee_float(raw: Column, width: int, order: str = "big") -> Column:
    """IEEE 754 single or double; infinities and NaN are no values."""
    h = F.hex(reversed_bytes(raw, width) if order == "little" else raw)
    bits, bias = (8, 127) if width == 4 else (11, 1023)
    size = 8 * width - 1 - bits  # of the mantissa
    if width == 4:
        top = F.shiftright(_bits(h, 1, 8), size)
        mantissa = _bits(h, 1, 8).bitwiseAND((1 << size) - 1)
    else:
        top, mantissa = _bits(h, 1, 3), _bits(h, 4, 13)
    exponent, part = top.bitwiseAND((1 << bits) - 1), mantissa.cast("double") / float(1 << size)
    value = F.when(exponent == 0, part * 2.0 ** (1 - bias)).otherwise((part + 1) * F.pow(F.lit(2.0), (exponent - bias).cast("double")))
    signed = F.when(top >= 1 << bits, -value).otherwise(value)
    return F.when((F.length(raw) == width) & (exponent != (1 << bits) - 1), signed)


def float_value(raw: Column, width: int, floats: str) -> Column:
    return hex_float(raw, width) if floats == "hfp" else ieee_float(raw, width, "little" if floats == "ieee-le" else "big")


def unnormalised(raw: Column) -> Column:
    """Non-zero bytes whose leading fraction digit is zero: no hexadecimal float writes that."""
    h = F.hex(raw)
    return ~h.rlike("^0*$") & (F.substring(h, 3, 1) == "0")


def unset(text: Column) -> Column:
    """Low-values, spaces or high-values only."""
    return text.rlike(r"^[\x00 \xFF]*$")


def value(item: Item, reading: Reading, slice_: Column | None = None) -> Column:
    """The typed value of an elementary field. Scaled integers are decimals, floats doubles, texts untrimmed."""
    b = raw(item) if slice_ is None else slice_
    if item.usage.floating:
        return float_value(b, item.size(), reading.floats)
    pic = item.picture
    if not pic.numeric:
        return codepages.text(b, reading.page)
    if item.usage is Usage.COMP3:
        return packed(b, pic.scale)
    if item.usage.binary:
        whole = binary(b, pic.signed, item.size(), reading.order)
        return whole if not pic.scale else let(whole, lambda v: scaled(F.abs(v).cast("string"), pic.scale, v < 0))
    return display(b, pic, reading.page, item.leading, item.separate)


def shown(item: Item, reading: Reading) -> Column:
    """A field as a person reads it: empty for none, no trailing blanks, leading zeros of unsigned whole numbers kept."""
    v = value(item, reading)
    if item.picture is not None and not item.picture.numeric:
        return F.coalesce(F.regexp_replace(v, f"{BLANK}+$", ""), F.lit(""))
    pic = item.picture
    if item.numeric and item.usage is Usage.DISPLAY and not pic.signed and not pic.scale:
        return F.when(v.isNull(), "").otherwise(F.regexp_replace(codepages.text(raw(item), reading.page), f"{BLANK}+$", ""))
    return F.coalesce(v.cast("string"), F.lit(""))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
