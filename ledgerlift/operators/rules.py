"""Predicates over a field's statistics, and the findings they make. One definition serves scans and adjudication."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.decoders import Reading
from ..layout import Item, Layout, Usage
from .profile import FieldStats

# Evidence that float columns must give. Below 67 values a true IEEE column may show no unnormalised one
# (each has odds of 4.35 %); one exponent byte alone can't show one either. Eight distinct bytes tell a busy end.
FLOAT_FLOOR, FLOAT_EXPONENTS, BUSY_BYTES = 67, 2, 8


@dataclass
class Finding:
    code: str
    severity: str
    field: str
    claim: str
    evidence: dict = field(default_factory=dict)
    records: int = 0
    impact: str = ""

    def __str__(self) -> str:
        lines = [f"[{self.severity.upper()}] {self.code}  {self.field}", f"    {self.claim}"]
        if self.evidence:
            lines.append("    " + ", ".join(f"{k}={v}" for k, v in self.evidence.items()) + f" ({self.records:,} records)")
        return "\n".join(lines + ([f"    {self.impact}"] if self.impact else []))


def share(n: int, of: int) -> str:
    return f"{100 * n / of:.1f}%" if of else "n/a"


def zoned(i: Item) -> bool:
    return i.numeric and i.usage is Usage.DISPLAY


def sign_seen(i: Item, s: FieldStats) -> bool:
    return zoned(i) and s.negative + s.positive > 0


def sign_matters(i: Item, s: FieldStats) -> bool:
    return i.numeric and i.picture.signed and s.negative > 0


def sign_idle(i: Item, s: FieldStats) -> bool:
    return i.numeric and i.picture.signed and s.negative == 0 and s.positive > 0


def sign_undeclared(i: Item, s: FieldStats) -> bool:
    return not (i.numeric and i.picture.signed) and sign_seen(i, s)


def implied_decimal(i: Item, s: FieldStats) -> bool:
    return i.numeric and i.picture.scale > 0


def underfilled(i: Item, s: FieldStats) -> bool:
    return i.numeric and i.picture.scale == 0 and 0 < s.widest < i.picture.int_digits


def unknown_sign(i: Item, s: FieldStats) -> bool:
    return zoned(i) and s.unknown_sign > 0


def invalid_packed(i: Item, s: FieldStats) -> bool:
    return s.invalid_packed > 0


def busy_end(heads: int, tails: int) -> str | None:
    """Magnitudes cluster, so the end with few distinct bytes is the high one."""
    if max(heads, tails) < BUSY_BYTES:
        return None
    if 2 * tails <= heads:
        return "little"
    return "big" if 2 * heads <= tails else None


def float_format(s: FieldStats) -> str | None:
    """What the bytes show: one unnormalised value is proof of IEEE; their absence over enough values, of hex float."""
    if s.float_unnormalised:
        return "ieee"
    return "hfp" if s.float_nonzero >= FLOAT_FLOOR and s.float_exponents >= FLOAT_EXPONENTS else None


def float_order(s: FieldStats) -> str | None:
    return busy_end(s.float_heads, s.float_tails)


def _in_force(reading: Reading) -> tuple[str, str]:
    return ("hfp", "big") if reading.floats == "hfp" else ("ieee", "little" if reading.floats == "ieee-le" else "big")


def float_contradicted(i: Item, s: FieldStats, r: Reading) -> bool:
    seen, (form, order) = float_format(s), _in_force(r)
    if not i.usage.floating or seen is None:
        return False
    return seen != form or form == "ieee" and float_order(s) not in (None, order)


def float_confirmed(i: Item, s: FieldStats, r: Reading) -> bool:
    form, order = _in_force(r)
    return i.usage.floating and float_format(s) == form and (form == "hfp" or float_order(s) == order)


def float_open(i: Item, s: FieldStats, r: Reading) -> bool:
    seen = float_format(s)
    return i.usage.floating and s.float_nonzero > 0 and not float_contradicted(i, s, r) and (seen is None or seen == "ieee" and float_order(s) is None)


def binary_order(i: Item, s: FieldStats) -> str | None:
    return busy_end(s.binary_heads, s.binary_tails) if i.usage.binary else None


def binary_contradicted(i: Item, s: FieldStats, r: Reading) -> bool:
    return binary_order(i, s) not in (None, r.order)


def binary_too_large(i: Item, s: FieldStats, r: Reading) -> bool:
    return i.usage is Usage.COMP and s.binary_over > 0 and not binary_contradicted(i, s, r)


def never_populated(i: Item, s: FieldStats) -> bool:
    return s.examined > 0 and s.examined in (s.blank, s.all_zero, s.unset)


def populated_filler(i: Item, s: FieldStats) -> bool:
    return i.filler and s.unset < s.examined


def shared_values(i: Item) -> dict[str, list[str]]:
    """Values that several conditions claim, each as its only one: value -> names."""
    alone = [(vs[0], name) for name, vs in i.conditions.items() if len(vs) == 1 and not i.ranges.get(name)]
    often = Counter(v for v, _ in alone)
    return {v: [n for w, n in alone if w == v] for v in dict.fromkeys(v for v, _ in alone) if often[v] > 1}


def _money(x) -> str:
    return f"{x:,.2f}"


def _sign_findings(i: Item, s: FieldStats):
    if not sign_seen(i, s):
        return
    if sign_matters(i, s):
        yield "TRAILING_SIGN", "critical", "the last byte holds the sign: without it negative amounts turn positive", {"negative": f"{s.negative:,}", "positive": f"{s.positive:,}", "share_negative": share(s.negative, s.examined)}, f"total {_money(s.total)}; without signs {_money(s.total_abs)}, which is {_money(s.total_abs - s.total)} too much"
    elif sign_idle(i, s):
        yield "SIGN_PRESENT_ALL_POSITIVE", "info", "the last byte holds a sign that is positive throughout: reading digits only is right until the first negative amount", {"positive": f"{s.positive:,}", "negative": "0"}, ""
    else:
        yield "UNDECLARED_SIGN", "critical", "the PICTURE is unsigned, and the last byte holds signs", {"signed_records": f"{s.negative + s.positive:,}", "share": share(s.negative + s.positive, s.examined), "declared": i.picture.raw}, f"as declared {_money(s.total)}; with signs {_money(s.total_forced)}, a difference of {_money(s.total - s.total_forced)}"


def _float_findings(i: Item, s: FieldStats, r: Reading):
    if not i.usage.floating:
        return
    ends = {"distinct_first_byte": s.float_heads, "distinct_last_byte": s.float_tails}
    counts = {"non_zero_values": f"{s.float_nonzero:,}", "unnormalisable_as_hex_float": f"{s.float_unnormalised:,}"}
    if float_contradicted(i, s, r):
        want = "hfp" if float_format(s) == "hfp" else "ieee-le" if float_order(s) == "little" else "ieee"
        yield "FLOAT_FORMAT_MISMATCH", "critical", f"read as {r.floats}, while the bytes are {want}", counts | {"share": share(s.float_unnormalised, s.float_nonzero)} | ends | {"reading_in_force": r.floats}, f"read it with --float-format {want}: the wrong format gives ordinary numbers of another magnitude"
    elif float_confirmed(i, s, r):
        yield "FLOAT_FORMAT_CONFIRMED", "info", f"read as {r.floats}, which the bytes support in format and byte order", counts | {"distinct_magnitudes": s.float_exponents} | ends, ""
    if float_open(i, s, r):
        yield "FLOAT_FORMAT_UNDECIDABLE", "warn", f"the values can't tell their format or byte order; {r.floats} is an assumption", {"non_zero_values": f"{s.float_nonzero:,}", "needed": FLOAT_FLOOR, "distinct_magnitudes": s.float_exponents, "needed_magnitudes": FLOAT_EXPONENTS} | ends, "few values, or values of one magnitude, look alike in every format"


def _field_findings(i: Item, s: FieldStats, r: Reading):
    p = i.picture
    yield from _sign_findings(i, s)
    if implied_decimal(i, s):
        stored = s.total_naive if zoned(i) else s.total * 10**p.scale
        yield "IMPLIED_DECIMAL", "warn", f"{p.scale} decimal places that the bytes don't show: the stored digits are 10^{p.scale} times the value", {"declared": p.raw, "scale": p.scale, "usage": i.usage.value}, f"total {_money(s.total)}; stored digits {stored:,.0f}"
    if underfilled(i, s):
        yield "WIDTH_UNDERFILL", "warn", f"no value uses more than {s.widest} of {p.int_digits} declared digits: the source is narrower, or values were cut", {"declared_digits": p.int_digits, "widest_observed": s.widest}, ""
    if populated_filler(i, s):
        yield "POPULATED_FILLER", "warn", "a FILLER with data, which the copybook doesn't describe", {"non_blank": f"{s.examined - s.blank:,}", "distinct_values": s.distinct, "examples": ", ".join(repr(v) for v, _ in s.top)}, ""
    if never_populated(i, s):
        yield "NEVER_POPULATED", "info", "blank, zero or low-values in every record", {"blank": f"{s.blank:,}", "zero": f"{s.all_zero:,}", "unset": f"{s.unset:,}", "of": f"{s.examined:,}"}, ""
    yield from _float_findings(i, s, r)
    if binary_contradicted(i, s, r):
        yield "BINARY_BYTE_ORDER", "critical", f"read {r.order}-endian, while the bytes are {binary_order(i, s)}-endian", {"distinct_first_byte": s.binary_heads, "distinct_last_byte": s.binary_tails, "reading_in_force": r.order}, f"read it with --binary-byteorder {binary_order(i, s)}: in the wrong order values are other whole numbers"
    if binary_too_large(i, s, r):
        most = 10**p.digits - 1
        yield "BINARY_EXCEEDS_PIC", "critical", f"values beyond {most:,}, where standard COMP cuts {p.raw}: this is native binary", {"over_limit": f"{s.binary_over:,}", "share": share(s.binary_over, s.examined), "largest_seen": f"{s.binary_max:,}", "pic_allows": f"{most:,}"}, "a column sized by the PICTURE is too small"
    if unknown_sign(i, s):
        yield "UNKNOWN_SIGN_BYTE", "critical", "the last byte is no digit, no known sign and no padding: its digit would be lost", {"records": f"{s.unknown_sign:,}", "share": share(s.unknown_sign, s.examined), "bytes": ", ".join(f"{b} x{n:,}" for b, n in s.unknown_bytes)}, "the code page or the sign convention is wrong"
    if invalid_packed(i, s):
        yield "INVALID_PACKED", "critical", "nibbles that aren't packed decimal: usage or offset is wrong", {"bad_records": f"{s.invalid_packed:,}", "share": share(s.invalid_packed, s.examined)}, ""
    if 100 * s.undecodable > s.examined:
        yield "ENCODING_SUSPECT", "warn", "bytes that the code page doesn't define", {"undecodable": f"{s.undecodable:,}", "share": share(s.undecodable, s.examined)}, ""


def _condition_findings(i: Item, s: FieldStats):
    if not i.conditions:
        return
    for value, names in shared_values(i).items():
        yield "AMBIGUOUS_CONDITION", "critical", f"{value!r} is the only value of {len(names)} conditions: neither copybook nor data tell which is meant", {"value": value, "names": ", ".join(names)}, ""
    if 0 < s.unset < s.examined:
        yield "MOSTLY_UNSET", "info", "a coded field without a value in some records: low-values mean that none was set", {"unset": f"{s.unset:,}", "of": f"{s.examined:,}", "share": share(s.unset, s.examined)}, ""
    if s.uncovered:
        yield "UNCOVERED_VALUE", "warn", "values without an 88-level: code that branches on the conditions skips these records", {"values": ", ".join(f"{v!r} x{n:,}" for v, n in s.uncovered_top), "records_affected": f"{s.uncovered:,}"}, ""


def evaluate(layout: Layout, stats: dict[str, FieldStats], reading: Reading = Reading()) -> list[Finding]:
    """Findings, critical ones first, then by field."""
    found = []
    items = [(i, stats[i.key]) for i in layout.fields() if i.key in stats and stats[i.key].examined]
    for i, s in items:
        found += [Finding(c, sev, f"FILLER @ offset {i.offset}" if c == "POPULATED_FILLER" else i.name, claim, ev, s.examined, impact) for c, sev, claim, ev, impact in _field_findings(i, s, reading)]
    for i, s in items:
        found += [Finding(c, sev, i.name, claim, ev, s.examined, impact) for c, sev, claim, ev, impact in _condition_findings(i, s)]
    return sorted(found, key=lambda f: (("critical", "warn", "info").index(f.severity), f.field))


def findings_frame(spark, findings: list[Finding]) -> DataFrame:
    rows = [(f.code, f.severity, f.field, f.claim, {k: str(v) for k, v in f.evidence.items()}, f.records, f.impact) for f in findings]
    return spark.createDataFrame(rows, "code string, severity string, field string, claim string, evidence map<string,string>, records long, impact string")
