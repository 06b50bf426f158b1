"""Round trips and single bytes of every encoding."""

import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlift import copybook
from ledgerlift.functions import codepages, decoders, encoders
from ledgerlift.functions.decoders import Reading


def decode(spark, spec, raws, reading=Reading()):
    item = copybook.parse(f"01 R.\n 05 V {spec}.").find("V")
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "rec_no int, rec binary")
    return [r[0] for r in df.orderBy("rec_no").select(decoders.value(item, reading)).collect()]


@pytest.mark.parametrize("page", ["cp037", "cp273", "cp500", "cp1026", "cp1140", "latin1"])
def test_every_byte_of_a_page(spark, page):
    df = spark.createDataFrame([(bytearray(range(256)),)], "b binary")
    assert df.select(codepages.text(F.col("b"), page)).first()[0] == bytes(range(256)).decode(page, "replace")


def test_unknown_page_is_refused():
    with pytest.raises(LookupError):
        Reading("cp1047x")
    assert not codepages.is_ascii("no-such-page") and codepages.is_ascii("latin1") and not codepages.is_ascii("cp037")


def test_utf8_with_bad_bytes(spark):
    assert decode(spark, "PIC X(3)", [b"a\xc3\xa9", b"\xffab"], Reading("utf-8")) == ["aé", "�ab"]


@pytest.mark.parametrize(("raw", "value"), [(b"\x01\x23\x4c", "12.34"), (b"\x01\x23\x4d", "-12.34"), (b"\x01\x23\x4b", "-12.34"), (b"\x01\x23\x4f", "12.34"), (b"\x01\x23\x45", None), (b"\x0a\x23\x4c", None), (b"\x40\x40\x40", None), (b"", "0")])
def test_packed(spark, raw, value):
    assert decode(spark, "PIC S9(3)V99 COMP-3", [raw]) == [None if value is None else Decimal(value)]


@pytest.mark.parametrize(("spec", "raw", "page", "value"), [
    ("PIC S9(3)V99", b"\xf0\xf1\xf2\xf3\xd4", "cp037", "-12.34"), ("PIC S9(3)V99", b"\xf0\xf1\xf2\xf3\xc4", "cp037", "12.34"), ("PIC S9(3)V99", b"\xf0\xf1\xf2\xf3\xf4", "cp037", "12.34"),
    ("PIC 9(3)V99", b"\xf0\xf1\xf2\xf3\xd4", "cp037", "12.34"), ("PIC S9(3)V99", b"0123t", "latin1", "-12.34"), ("PIC S9(3)V99", b"0123M", "latin1", "-12.34"), ("PIC S9(3)", b"12}", "latin1", "-120"),
    ("PIC S9(3) SEPARATE", b"123-", "latin1", "-123"), ("PIC S9(3) SIGN LEADING SEPARATE", b"-123", "latin1", "-123"), ("PIC S9(3) SIGN LEADING", b"J23", "latin1", "-123"), ("PIC S9(3)", b"12-", "latin1", "-12"),
    ("PIC S9(3)V99", b"\x00" * 5, "cp037", "0"), ("PIC S9(3)V99", b"\x40" * 5, "cp037", "0"), ("PIC 9(1)V99", b"5", "latin1", "0.05"), ("PIC S9(3)", b"", "cp037", "0"),
])
def test_display(spark, spec, raw, page, value):
    assert decode(spark, spec, [raw], Reading(page)) == [Decimal(value)]


@pytest.mark.parametrize("order", ["big", "little"])
@pytest.mark.parametrize("width", [2, 4, 8])
def test_binary_extremes(spark, width, order):
    digits = {2: 4, 4: 9, 8: 18}[width]
    values = [0, 1, -1, (1 << 8 * width - 1) - 1, -(1 << 8 * width - 1)]
    got = decode(spark, f"PIC S9({digits}) COMP-5", [v.to_bytes(width, order, signed=True) for v in values], Reading(order=order))
    assert [int(x) for x in got] == values
    most = (1 << 8 * width) - 1
    assert [int(x) for x in decode(spark, f"PIC 9({digits}) COMP-5", [most.to_bytes(width, order)], Reading(order=order))] == [most]


FLOATS = [0.0, 1.0, -1.0, 0.1, 1.72708, -118.625, 3.4e38, 1e-45, 1.17549435e-38]


@pytest.mark.parametrize("kind", ["ieee", "ieee-le"])
def test_ieee(spark, kind):
    mark = "<" if kind == "ieee-le" else ">"
    for form, spec, more in (("f", "COMP-1", []), ("d", "COMP-2", [5e-324, 1.7976931348623157e308, 2.2250738585072014e-308])):
        raws = [struct.pack(mark + form, v) for v in FLOATS + more]
        assert decode(spark, spec, raws, Reading(floats=kind)) == [struct.unpack(mark + form, r)[0] for r in raws]
        assert decode(spark, spec, [struct.pack(mark + form, v) for v in (float("inf"), float("-inf"), float("nan"))] + [b"\x01"], Reading(floats=kind)) == [None] * 4


def test_hex_float(spark):
    assert decode(spark, "COMP-1", [bytes.fromhex(x) for x in ("41100000", "C276A000", "00000000", "40800000", "4110")]) == [1.0, -118.625, 0.0, 0.5, None]
    assert decode(spark, "COMP-2", [bytes.fromhex("4110000000000000"), bytes.fromhex("C276A00000000000")]) == [1.0, -118.625]


@pytest.mark.parametrize(("encode", "spec", "reading"), [
    (lambda v: encoders.zoned(v, 9), "PIC S9(9)", Reading()), (lambda v: encoders.ascii_zoned(v, 9), "PIC S9(9)", Reading("latin1")), (lambda v: encoders.packed(v, 9), "PIC S9(9) COMP-3", Reading()), (lambda v: encoders.packed(v, 10), "PIC S9(10) COMP-3", Reading()),
    (lambda v: encoders.binary(v, 4), "PIC S9(9) COMP", Reading()), (lambda v: encoders.binary(v, 8, "little"), "PIC S9(18) COMP", Reading(order="little")), (lambda v: F.encode(encoders.punched_text(v, 9), "US-ASCII"), "PIC S9(9)", Reading("latin1")),
    (lambda v: F.encode(encoders.separate(v, 9, True), "US-ASCII"), "PIC S9(9) SIGN LEADING SEPARATE", Reading("latin1")), (lambda v: encoders.ieee(v, 8), "COMP-2", Reading(floats="ieee")), (lambda v: encoders.hexadecimal(v, 8), "COMP-2", Reading()),
])
def test_round_trips(spark, encode, spec, reading):
    values = [0, 1, -1, 9, -10, 123456789, -999999999, 500, -7]
    item = copybook.parse(f"01 R.\n 05 V {spec}.").find("V")
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", encode(F.col("v")).alias("rec"))
    assert all(int(got) == v for v, got in df.select("v", decoders.value(item, reading)).collect())


def test_encoders_keep_the_low_digits(spark):
    df = spark.createDataFrame([(123456,)], "v long")
    assert df.select(encoders.digits(F.col("v"), 4)).first()[0] == "3456"


def test_shown(spark):
    layout = copybook.parse("01 R.\n 05 A PIC 9(4).\n 05 B PIC X(4).\n 05 C PIC S9(2)V9 COMP-3.")
    df = spark.createDataFrame([(bytearray("0042ab  ".encode("cp037") + b"\x01\x2d"),), (bytearray("0042ab  ".encode("cp037") + b"\xff\xff"),)], "rec binary")
    assert [tuple(r) for r in df.select(*(decoders.shown(layout.find(n), Reading()) for n in "ABC")).collect()] == [("0042", "ab", "-1.2"), ("0042", "ab", "")]
