"""Registered queries over planted faults and over record files: customers are written as records, damaged where a rule says
so, or put into a file, and what the engine finds must equal what DuckDB counts in the columns."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import copybook
from .errors import LayoutMismatch
from .functions import encoders
from .functions.decoders import Reading
from .layout import Item
from .operators import evidence, extract, profile, rules
from .sources import read_records
from .sources.records import detect_recfm

#: One field for each fault, in the order of ``_planted``.
PLANTED = """
01 R.
   05 ALL-POSITIVE  PIC S9(08)V99.
   05 NO-SIGN       PIC 9(10).
   05 FILLER        PIC X(04).
   05 NEVER         PIC X(03).
   05 ODD           PIC S9(05).
   05 PACK          PIC S9(09)V99 COMP-3.
   05 LARGE         PIC 9(04) COMP.
   05 TURNED        PIC 9(09) COMP.
   05 FLAG          PIC X.
      88 ONLY-A VALUE 'A'.
      88 ALSO-A VALUE 'A'.
"""
#: The figure of a field's statistics that a finding rests on.
FIGURE = {
    "TRAILING_SIGN": lambda i, s: s.negative,
    "SIGN_PRESENT_ALL_POSITIVE": lambda i, s: s.positive,
    "UNDECLARED_SIGN": lambda i, s: s.negative + s.positive,
    "IMPLIED_DECIMAL": lambda i, s: i.picture.scale,
    "WIDTH_UNDERFILL": lambda i, s: s.widest,
    "POPULATED_FILLER": lambda i, s: s.examined - s.unset,
    "NEVER_POPULATED": lambda i, s: s.examined,
    "UNKNOWN_SIGN_BYTE": lambda i, s: s.unknown_sign,
    "INVALID_PACKED": lambda i, s: s.invalid_packed,
    "BINARY_EXCEEDS_PIC": lambda i, s: s.binary_over,
    "BINARY_BYTE_ORDER": lambda i, s: s.binary_heads,
    "AMBIGUOUS_CONDITION": lambda i, s: max(map(len, rules.shared_values(i).values())),
    "MOSTLY_UNSET": lambda i, s: s.unset,
    "UNCOVERED_VALUE": lambda i, s: s.uncovered,
}


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/customer.parquet")


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, cents = F.col("c_custkey"), F.round(F.col("c_acctbal") * 100).cast("long")
    page = lambda c: encoders.page_bytes(c, "cp037")
    parts = [
        encoders.zoned(F.abs(cents), 10), encoders.zoned(cents, 10), page(F.lit("DATA")), page(F.lit("   ")),
        F.when(k % 5 == 0, F.lit(b"\xf0\xf0\xf0\xf0\x75")).otherwise(encoders.zoned(k % 100_000, 5)),
        F.when(k % 4 == 0, page(F.lit("ABCDEF"))).otherwise(encoders.packed(cents, 11)),
        encoders.binary(k % 20_000 + 9_990, 2), encoders.binary(k, 4, "little"),
        F.when(k % 3 == 0, F.lit(b"\0")).otherwise(page(F.when(k % 3 == 1, "A").otherwise("Z"))),
    ]
    return _customer(spark, sf_dir).select(k.alias("rec_no"), F.concat(*parts).alias("rec"))


def findings_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding over the planted faults, with the figure it rests on."""
    layout = copybook.parse(PLANTED)
    stats = profile.scan(_planted(spark, sf_dir), layout)
    by_name: dict[str, Item] = {f"FILLER @ offset {i.offset}" if i.filler else i.name: i for i in layout.fields()}
    rows = [(f.field, f.code, f.severity, FIGURE[f.code](by_name[f.field], stats[by_name[f.field].key])) for f in rules.evaluate(layout, stats)]
    return spark.createDataFrame(rows, "field string, code string, severity string, n long")


def unknown_byte_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last bytes that no sign is known for, with their counts."""
    layout = copybook.parse(PLANTED)
    found = profile.scan(_planted(spark, sf_dir), layout)[layout.find("ODD").key].unknown_bytes
    return spark.createDataFrame(found, "value string, n long")


def page_legibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of legible characters of a text in its own page and in one of another kind, over all records, in thousandths."""
    layout = copybook.parse("01 R.\n 05 T PIC X(10).")
    records = _customer(spark, sf_dir).select(F.col("c_custkey").alias("rec_no"), encoders.page_bytes(F.rpad("c_mktsegment", 10, " "), "cp500").alias("rec"))
    found = evidence.legibility(records, layout.find("T"), None, ("cp500", "latin-1"))
    return spark.createDataFrame([(p, round(1000 * v)) for p, v in found.items() if p == "cp500"], "page string, thousandths long")


def looks_right_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with an ampersand or an apostrophe look right, with an exclamation mark they don't."""
    layout = copybook.parse("01 R.\n 05 T PIC X(04).")
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, "A&B ").when(k % 3 == 1, "D'OR").otherwise("NO! ")
    records = _customer(spark, sf_dir).select(encoders.page_bytes(text, "cp037").alias("rec"))
    return records.agg(F.count_if(evidence.looks_right(layout.find("T"), "cp037")).alias("right"), F.count(F.lit(1)).alias("n"))


def little_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IEEE floats whose bytes run from the low end."""
    layout = copybook.parse("01 R.\n 05 V COMP-2.")
    whole = encoders.ieee(F.col("c_acctbal"), 8)
    turned = F.unhex(F.concat(*(F.substring(F.hex(whole), 2 * n + 1, 2) for n in range(7, -1, -1))))
    got = extract.decode(_customer(spark, sf_dir).select("c_custkey", F.col("c_custkey").alias("rec_no"), turned.alias("rec")), layout, Reading(floats="ieee-le"), keep=("c_custkey",))
    return got.select("c_custkey", F.round(F.col("V") * 100).cast("long").alias("cents"))


def zoned_text_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zoned numbers whose sign is a character of a text page."""
    layout = copybook.parse("01 R.\n 05 V PIC S9(08)V99.")
    text = encoders.punched_text(F.round(F.col("c_acctbal") * 100).cast("long"), 10)
    records = _customer(spark, sf_dir).select(F.col("c_custkey").alias("rec_no"), encoders.page_bytes(text, "latin-1").alias("rec"))
    stats = profile.scan(records, layout, Reading("latin-1"))[layout.find("V").key]
    return spark.createDataFrame([(stats.negative, int(stats.total * 100), int(stats.total_abs * 100))], "negatives long, cents long, cents_abs long")


_FILE = "01 R.\n 05 K PIC 9(09).\n 05 BALANCE PIC S9(08)V99.\n 05 SEGMENT PIC X(10)."


def _file(spark: SparkSession, sf_dir: str, variable: bool = False) -> str:
    """Customers by key as a record file. A file of records is one stream, so it is written in one place."""
    segment = F.rtrim("c_mktsegment") if variable else F.rpad("c_mktsegment", 10, " ")
    rec = F.concat(encoders.zoned(F.col("c_custkey"), 9, sign=False), encoders.zoned(F.round(F.col("c_acctbal") * 100).cast("long"), 10), encoders.page_bytes(segment, "cp037"))
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder.removeprefix("file:") if folder and folder.startswith(("/", "file:/")) else None
    if folder:
        os.makedirs(folder, exist_ok=True)
    path = os.path.join(tempfile.mkdtemp(dir=folder), "customer.dat")
    with open(path, "wb") as f:
        for r in _customer(spark, sf_dir).orderBy("c_custkey").select(rec.alias("rec")).toLocalIterator():
            f.write(((len(r["rec"]) + 4).to_bytes(2, "big") + b"\0\0" if variable else b"") + r["rec"])
    return path


def _typed(decoded: DataFrame) -> DataFrame:
    return decoded.select(F.col("K").cast("long").alias("k"), (F.col("BALANCE") * 100).cast("long").alias("cents"), F.rtrim("SEGMENT").alias("segment"))


def fixed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = copybook.parse(_FILE)
    return _typed(extract.decode(read_records(spark, _file(spark, sf_dir), layout.record_length(), partition_bytes=4096), layout))


def fixed_file_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred records, in file order."""
    layout = copybook.parse(_FILE)
    records = read_records(spark, _file(spark, sf_dir), layout.record_length(), limit=100, partition_bytes=512)
    return _typed(extract.decode(records, layout)).select("k")


def variable_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of differing lengths behind descriptor words, found by themselves, with their places."""
    layout = copybook.parse(_FILE)
    records = read_records(spark, _file(spark, sf_dir, variable=True), layout.record_length(), partition_bytes=4096)
    return records.select("rec_no", F.octet_length("rec").cast("long").alias("n_bytes"))


def record_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(name, detect_recfm(_file(spark, sf_dir, name == "vb"), 29)) for name in ("fixed", "vb")]
    return spark.createDataFrame(found, "written string, detected string")


def length_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A length that doesn't divide the file is refused with what is left over."""
    path = _file(spark, sf_dir)
    found = []
    for length in (7, 29, 31, 8191):
        try:
            read_records(spark, path, length, recfm="fixed")
            found.append((length, 0))
        except LayoutMismatch as e:
            found.append((length, e.remainder))
    return spark.createDataFrame(found, "length long, remainder long")


_CENTS = "cast(round(c_acctbal * 100) as bigint)"
_TYPED = f"select c_custkey as k, {_CENTS} as cents, rtrim(c_mktsegment[1:10]) as segment from customer"
QUERIES = {
    "findings_planted": findings_planted,
    "unknown_byte_values": unknown_byte_values,
    "page_legibility": page_legibility,
    "looks_right_marks": looks_right_marks,
    "little_floats": little_floats,
    "zoned_text_signs": zoned_text_signs,
    "fixed_file": fixed_file,
    "fixed_file_first": fixed_file_first,
    "variable_file": variable_file,
    "record_formats": record_formats,
    "length_refused": length_refused,
}
ORACLE_SQL = {
    "findings_planted": f"""
with c as (select c_custkey as k, {_CENTS} as cents from customer),
found as (
  select 'ALL-POSITIVE' as field, 'SIGN_PRESENT_ALL_POSITIVE' as code, 'info' as severity, count(*) as n from c
  union all select 'ALL-POSITIVE', 'IMPLIED_DECIMAL', 'warn', 2 from c
  union all select 'NO-SIGN', 'UNDECLARED_SIGN', 'critical', count(*) from c
  union all select 'NO-SIGN', 'WIDTH_UNDERFILL', 'warn', max(length(cast(abs(cents) as varchar))) from c having max(length(cast(abs(cents) as varchar))) < 10
  union all select 'FILLER @ offset 20', 'POPULATED_FILLER', 'warn', count(*) from c
  union all select 'NEVER', 'NEVER_POPULATED', 'info', count(*) from c
  union all select 'ODD', 'UNKNOWN_SIGN_BYTE', 'critical', count(*) from c where k % 5 = 0
  union all select 'ODD', 'SIGN_PRESENT_ALL_POSITIVE', 'info', count(*) from c where k % 5 <> 0
  union all select 'ODD', 'WIDTH_UNDERFILL', 'warn', max(length(cast(k % 100000 as varchar))) from c where k % 5 <> 0 having max(length(cast(k % 100000 as varchar))) < 5
  union all select 'PACK', 'INVALID_PACKED', 'critical', count(*) from c where k % 4 = 0
  union all select 'PACK', 'IMPLIED_DECIMAL', 'warn', 2 from c
  union all select 'LARGE', 'BINARY_EXCEEDS_PIC', 'critical', count(*) from c where k % 20000 + 9990 > 9999
  union all select 'TURNED', 'BINARY_BYTE_ORDER', 'critical', count(distinct k & 255) from c where k <> 0
  union all select 'FLAG', 'AMBIGUOUS_CONDITION', 'critical', 2 from c
  union all select 'FLAG', 'MOSTLY_UNSET', 'info', count(*) from c where k % 3 = 0
  union all select 'FLAG', 'UNCOVERED_VALUE', 'warn', count(*) from c where k % 3 = 2)
select distinct field, code, severity, cast(n as bigint) as n from found where n > 0""",
    "unknown_byte_values": "select '0x75' as value, count(*) as n from customer where c_custkey % 5 = 0",
    "page_legibility": "select 'cp500' as page, cast(round(1000.0 * sum(length(regexp_replace(rpad(c_mktsegment[1:10], 10, ' '), '[^A-Za-z0-9 .,\\-/()]', '', 'g'))) / sum(10)) as bigint) as thousandths from customer",
    "looks_right_marks": "select count(*) filter (c_custkey % 3 < 2) as \"right\", count(*) as n from customer",
    "little_floats": f"select c_custkey, {_CENTS} as cents from customer",
    "zoned_text_signs": f"select count(*) filter (c_acctbal < 0) as negatives, cast(sum({_CENTS}) as bigint) as cents, cast(sum(abs({_CENTS})) as bigint) as cents_abs from customer",
    "fixed_file": _TYPED,
    "fixed_file_first": "select c_custkey as k from customer order by c_custkey limit 100",
    "variable_file": "select row_number() over (order by c_custkey) - 1 as rec_no, 19 + length(rtrim(c_mktsegment)) as n_bytes from customer",
    "record_formats": "select * from (values ('fixed', 'fixed'), ('vb', 'vb')) t(written, detected)",
    "length_refused": "with s as (select count(*) * 29 as size from customer) select l as length, size % l as remainder from s, (values (7::bigint), (29), (31), (8191)) t(l)",
}
