"""The sample files: (layout text, page, records as bytes, reading options, expected finding codes)."""

import random
import struct
from decimal import Decimal

from ledgerlift.errors import LayoutMismatch


def money(rng, a, b):
    return Decimal(str(round(rng.uniform(a, b), 2)))


def cents(x):
    return int(x.scaleb(2))


def zoned(n, width, page="cp037", sign=True):
    digits = str(abs(n)).zfill(width)
    raw = bytearray(digits.encode(page))
    if sign:
        raw[-1] = (raw[-1] & 0x0F) | (0xD0 if n < 0 else 0xC0)
    return bytes(raw)


def ascii_zoned(n, width):
    raw = bytearray(str(abs(n)).zfill(width).encode())
    if n < 0:
        raw[-1] |= 0x40
    return bytes(raw)


def packed(n, width):
    digits = str(abs(n)).zfill(width if width % 2 else width + 1)
    return bytes.fromhex(digits + ("D" if n < 0 else "C"))


def hex_float(v, width):
    m, e = abs(v), 64
    while m >= 1:
        m, e = m / 16, e + 1
    while 0 < m < 1 / 16:
        m, e = m * 16, e - 1
    return bytes([(128 if v < 0 else 0) | e]) + int(m * (1 << 8 * (width - 1))).to_bytes(width - 1, "big") if v else bytes(width)


E = lambda s: s.encode("cp037")
PACKED = "01 R.\n 05 PR-ACCOUNT PIC 9(08).\n 05 PR-BALANCE PIC S9(09)V99 COMP-3.\n 05 PR-LIMIT PIC S9(07)V99 COMP-3.\n 05 PR-CYCLE PIC S9(03) COMP-3."
CLEAN = "01 R.\n 05 CR-ID PIC 9(06).\n 05 CR-NAME PIC X(12).\n 05 CR-COUNT PIC 9(04)."
FLOAT = "01 R.\n 05 FR-ID PIC 9(06).\n 05 FR-SINGLE COMP-1.\n 05 FR-DOUBLE COMP-2."
BINARY = "01 R.\n 05 BR-ID PIC 9(06).\n 05 BR-COUNT PIC S9(04) COMP.\n 05 BR-TOTAL PIC S9(09) COMP."


def clean(seed, n):
    rng = random.Random(seed)
    return [E(f"{999999 - i:06d}" + rng.choice(("ALPHA", "BRAVO", "DELTA")).ljust(12) + f"{rng.randint(1000, 9999):04d}") for i in range(n)]


def ascii_separate():
    rng = random.Random(2)
    return [f"REF{i:05d}".encode() + (lambda c: f"{abs(c):09d}{'-' if c < 0 else '+'}".encode())(cents(money(rng, -900, 4000))) + b"Y" for i in range(60)]


def packed_records(seed, corrupt):
    rng = random.Random(seed)
    out = []
    for i in range(40):
        balance, limit, cycle = money(rng, -2000, 9000), money(rng, 0, 5000), rng.randint(1, 12)
        body = E("ABCDEF") if corrupt and i % 4 == 0 else packed(cents(balance), 11)
        out.append(E(f"{10000000 + i:08d}") + body + packed(cents(limit), 9) + packed(cycle, 3))
    return out


def ranges():
    rng = random.Random(12)
    return [E(f"{10000 + i:05d}{rng.choice('12345') if i % 9 else '7'}") for i in range(80)]


def unset():
    rng = random.Random(9)
    return [E(f"{100000 + i:06d}") + b"\0\0" + zoned(cents(money(rng, -400, 900)), 7) for i in range(60)]


def ascii_native():
    rng = random.Random(21)
    return [f"REF{i:05d}".encode() + ascii_zoned(cents(money(rng, -900, 4000)), 9) + b"Y" for i in range(60)]


def floats(kind):
    rng = random.Random(31)
    out = []
    for i in range(120):
        a, b = rng.uniform(0.01, 500000), rng.uniform(0.01, 900000)
        body = hex_float(a, 4) + hex_float(b, 8) if kind == "hfp" else struct.pack(("<" if kind == "ieee-le" else ">") + "f", a) + struct.pack(("<" if kind == "ieee-le" else ">") + "d", b)
        out.append(E(f"{100000 + i:06d}") + body)
    return out


def binaries(full):
    rng = random.Random(41)
    order = "big" if full else "little"
    out = []
    for i in range(120):
        a = rng.randint(10000, 31999) if full else rng.randint(0, 1999)
        out.append(E(f"{100000 + i:06d}") + a.to_bytes(2, order) + rng.randint(1, 900000).to_bytes(4, order))
    return out


MONEY = "PIC S9(07)V99"
SAMPLES = {
    "clean": (CLEAN, "cp037", clean(1, 50), {}, set()),
    "ascii-separate-sign": (f"01 R.\n 05 AR-REF PIC X(08).\n 05 AR-AMOUNT {MONEY} SIGN TRAILING SEPARATE.\n 05 AR-FLAG PIC X.", "latin1", ascii_separate(), {}, {"IMPLIED_DECIMAL", "TRAILING_SIGN"}),
    "packed-heavy": (PACKED, "cp037", packed_records(3, False), {}, {"IMPLIED_DECIMAL"}),
    "corrupt-packed": (PACKED, "cp037", packed_records(4, True), {}, {"IMPLIED_DECIMAL", "INVALID_PACKED"}),
    "wrong-copybook": (PACKED, "cp037", [E(str(10**21 + 7 * i)[:22]) for i in range(37)], {}, LayoutMismatch),
    "variable-blocked": (CLEAN, "cp037", [(len(x) + 4).to_bytes(2, "big") + b"\0\0" + x for x in clean(6, 30)], {}, set()),
    "never-populated": ("01 R.\n 05 BR-ID PIC 9(06).\n 05 BR-RESERVED PIC X(10).\n 05 BR-CODE PIC X(02).\n  88 NEW VALUE 'NW'.", "cp037", [E(f"{100000 + i:06d}" + " " * 10 + ("NW" if i % 3 else "ZZ")) for i in range(30)], {}, {"NEVER_POPULATED", "UNCOVERED_VALUE"}),
    "range-condition": ("01 R.\n 05 RR-ID PIC 9(05).\n 05 RR-CAUSE PIC 9(01).\n  88 VALID VALUE 1 THRU 5.\n  88 ONE VALUE 1.\n  88 FIVE VALUE 5.", "cp037", ranges(), {}, {"UNCOVERED_VALUE"}),
    "unset-numeric": ("01 R.\n 05 UR-ID PIC 9(06).\n 05 UR-FLAG PIC 9(01).\n 05 UR-CLASS PIC X.\n 05 UR-AMOUNT PIC S9(05)V99.", "cp037", unset(), {}, {"IMPLIED_DECIMAL", "NEVER_POPULATED", "TRAILING_SIGN"}),
    "ascii-native-zoned": (f"01 R.\n 05 MF-REF PIC X(08).\n 05 MF-AMOUNT {MONEY}.\n 05 MF-FLAG PIC X.", "latin1", ascii_native(), {}, {"IMPLIED_DECIMAL", "TRAILING_SIGN"}),
    "float-hex": (FLOAT, "cp037", floats("hfp"), {}, {"FLOAT_FORMAT_CONFIRMED"}),
    "float-ieee": (FLOAT, "cp037", floats("ieee"), {}, {"FLOAT_FORMAT_MISMATCH"}),
    "float-ieee-le": (FLOAT, "cp037", floats("ieee-le"), {}, {"FLOAT_FORMAT_MISMATCH"}),
    "float-ieee-read-so": (FLOAT, "cp037", floats("ieee"), {"floats": "ieee"}, {"FLOAT_FORMAT_CONFIRMED"}),
    "comp5-fullrange": (BINARY, "cp037", binaries(True), {}, {"BINARY_EXCEEDS_PIC"}),
    "comp5-little": (BINARY, "cp037", binaries(False), {}, {"BINARY_BYTE_ORDER"}),
    "partly-unset": ("01 R.\n 05 PR-ID PIC 9(05).\n 05 PR-STATUS PIC X.\n  88 OPEN-S VALUE 'O'.\n  88 CLOSED-S VALUE 'C'.", "cp037", [E(f"{10000 + i:05d}") + (b"\0" if i % 3 else E("OC"[i % 2])) for i in range(80)], {}, {"MOSTLY_UNSET"}),
}
