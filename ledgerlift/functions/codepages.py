"""Single-byte code pages as translation tables, built from Python's codecs on the driver."""

from __future__ import annotations

import codecs
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def decoded(page: str) -> str | None:
    """The 256 characters of a page; None if it isn't single-byte."""
    codecs.lookup(page)
    if codecs.lookup(page).name in ("utf-8", "utf-16", "utf-32"):
        return None
    return "".join(bytes([b]).decode(page, "replace") for b in range(256))


def known(page: str) -> bool:
    try:
        codecs.lookup(page)
    except LookupError:
        return False
    return True


def is_ascii(page: str) -> bool:
    """Digits are 0x30 to 0x39 there."""
    return known(page) and "0".encode(page) == b"0"


def text(raw: Column, page: str) -> Column:
    """Characters of bytes; what a page doesn't define becomes U+FFFD."""
    chars = decoded(page)
    if chars is None:
        return F.make_valid_utf8(raw.cast("string"))
    # identity pairs stay out: translate() deletes what maps to U+0000
    moved = [(chr(b), c) for b, c in enumerate(chars) if chr(b) != c]
    one = F.decode(raw, "ISO-8859-1")
    return F.translate(one, "".join(a for a, _ in moved), "".join(c for _, c in moved)) if moved else one
