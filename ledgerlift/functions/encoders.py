"""Encoders: numbers to field bytes, for fixtures and for records written by this engine."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .decoders import NEGATIVE, POSITIVE


def digits(number: Column, width: int) -> Column:
    """Absolute whole number in ``width`` digits; the low ones if it has more."""
    d = F.abs(number.cast("decimal(38,0)")).cast("string")
    return F.right(F.lpad(d, F.greatest(F.length(d), F.lit(width)), F.lit("0")), F.lit(width))


def zoned(number: Column, width: int, sign: bool = True) -> Column:
    """EBCDIC zoned decimal; the same bytes in every EBCDIC page."""
    d = digits(number, width)
    last = F.when(number < 0, "D").otherwise("C") if sign else F.lit("F")
    return F.unhex(F.concat(F.regexp_replace(F.substr(d, F.lit(1), F.lit(width - 1)), "(.)", "F$1"), last, F.right(d, F.lit(1))))


def ascii_zoned(number: Column, width: int) -> Column:
    """ASCII zoned decimal: a negative number's last digit is 0x70 to 0x79."""
    d = digits(number, width)
    return F.unhex(F.concat(F.regexp_replace(F.substr(d, F.lit(1), F.lit(width - 1)), "(.)", "3$1"), F.when(number < 0, "7").otherwise("3"), F.right(d, F.lit(1))))


def punched_text(number: Column, width: int) -> Column:
    """Digits whose last one is a zoned sign character."""
    d = digits(number, width)
    last = F.right(d, F.lit(1))
    return F.concat(F.substr(d, F.lit(1), F.lit(width - 1)), F.when(number < 0, F.translate(last, "0123456789", NEGATIVE)).otherwise(F.translate(last, "0123456789", POSITIVE)))


def separate(number: Column, width: int, leading: bool = False) -> Column:
    sign = F.when(number < 0, "-").otherwise("+")
    return F.concat(sign, digits(number, width)) if leading else F.concat(digits(number, width), sign)


def packed(number: Column, width: int) -> Column:
    d = digits(number, width if width % 2 else width + 1)
    return F.unhex(F.concat(d, F.when(number < 0, "D").otherwise("C")))


def binary(number: Column, width: int, order: str = "big") -> Column:
    h = F.right(F.hex(number.cast("long")), F.lit(2 * width))
    b = F.unhex(F.when(number < 0, h).otherwise(F.lpad(h, 2 * width, "0")))
    return F.concat(*(F.substring(b, i, 1) for i in range(width, 0, -1))) if order == "little" else b


def page_bytes(text: Column, page: str) -> Column:
    """Characters of a single-byte page, as bytes."""
    from .codepages import decoded

    back = {c: chr(b) for b, c in enumerate(decoded(page)) if c != "�"}
    moved = [(c, b) for c, b in back.items() if c != b and b != "\0"]
    return F.encode(F.translate(text, "".join(c for c, _ in moved), "".join(b for _, b in moved)), "ISO-8859-1")


def ieee(number: Column, width: int, order: str = "big") -> Column:
    """Only fixtures write floats, so this one is vectorised Python."""
    form = ("<" if order == "little" else ">") + ("f" if width == 4 else "d")

    @F.pandas_udf("binary")
    def pack(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else struct.pack(form, v))

    return pack(number.cast("double"))


def hexadecimal(number: Column, width: int) -> Column:
    """IBM hexadecimal float, cut off behind its last digit."""

    def one(v: float) -> bytes | None:
        if pd.isna(v):
            return None
        if v == 0:
            return bytes(width)
        m, e = abs(v), 64
        while m >= 1:
            m, e = m / 16, e + 1
        while m < 1 / 16:
            m, e = m * 16, e - 1
        return bytes([(128 if v < 0 else 0) | e]) + int(m * (1 << 8 * (width - 1))).to_bytes(width - 1, "big")

    @F.pandas_udf("binary")
    def pack(x: pd.Series) -> pd.Series:
        return x.map(one)

    return pack(number.cast("double"))
