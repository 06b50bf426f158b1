"""Registered queries of the record engine: table columns are encoded into records, our operators read the bytes, and
DuckDB computes the same from the columns. Money is compared in whole cents."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import copybook, planted
from .functions import decoders, encoders
from .functions.decoders import Reading
from .layout import Layout
from .operators import evidence, extract, nested, profile, rules

#: Fixed text of the flagship record.
CUSTOMER = """
01 CUSTOMER-REC.
   05 CUST-KEY      PIC 9(09).
   05 CUST-BALANCE  PIC S9(08)V99.
   05 CUST-SEGMENT  PIC X(10).
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def _layout(*fields: str) -> Layout:
    return copybook.parse("01 R.\n" + "\n".join(f"   05 {f}." for f in fields))


def _records(df: DataFrame, *parts: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(rec_no, rec) of the concatenated field bytes; rec_no is a column of the table, so that it needs no shuffle."""
    return df.select(*keep, F.concat(*parts).alias("rec"))


def _value(layout: Layout, name: str, reading: Reading = Reading()) -> Column:
    return decoders.value(layout.find(name), reading)


@cache
def customer_layout() -> Layout:
    return copybook.parse(CUSTOMER)


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("rec_no"), F.concat(encoders.zoned(F.col("c_custkey"), 9, sign=False), encoders.zoned(_cents("c_acctbal"), 10), encoders.page_bytes(F.rpad("c_mktsegment", 10, " "), "cp037")).alias("rec"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the customer table written as mainframe records."""
    layout = customer_layout()
    return rules.findings_frame(spark, rules.evaluate(layout, profile.scan(customer_records(spark, sf_dir), layout)))


def _balance(spec: str, encode, reading: Reading = Reading(), table: str = "customer", key: str = "c_custkey", money: str = "c_acctbal"):
    """A round trip of one money column: (key, cents)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        layout = _layout(f"V {spec}")
        df = _records(_table(spark, sf_dir, table), encode(_cents(money)), keep=(key,))
        return df.select(key, (_value(layout, "V", reading) * (1 if layout.find("V").picture and layout.find("V").picture.scale == 0 else 100)).cast("long").alias("cents"))

    return query


_BALANCE_SQL = "select c_custkey, cast(round(c_acctbal * 100) as bigint) as cents from customer"


def zoned_sign_totals(spark, sf_dir):
    layout = customer_layout()
    item = layout.find("CUST-BALANCE")
    got = profile.aggregates(item, Reading(), decoders.raw(item))
    return customer_records(spark, sf_dir).agg(got["negative"].alias("negatives"), got["total"].alias("t"), got["total_abs"].alias("a")).select("negatives", (F.col("t") * 100).cast("long").alias("cents"), (F.col("a") * 100).cast("long").alias("cents_abs"))


def zoned_naive_total(spark, sf_dir):
    return customer_records(spark, sf_dir).agg(F.sum(decoders.display_digits_only(decoders.raw(customer_layout().find("CUST-BALANCE")))).cast("long").alias("naive"))


def zoned_undeclared_sign(spark, sf_dir):
    layout = _layout("V PIC 9(08)V99")
    got = profile.aggregates(layout.find("V"), Reading(), decoders.raw(layout.find("V")))
    df = _records(_table(spark, sf_dir, "customer"), encoders.zoned(_cents("c_acctbal"), 10))
    return df.agg(got["total"].alias("t"), got["total_forced"].alias("f")).select((F.col("t") * 100).cast("long").alias("declared_cents"), (F.col("f") * 100).cast("long").alias("forced_cents"))


def zoned_pages(spark, sf_dir):
    layout = customer_layout()
    df = customer_records(spark, sf_dir)
    sums = [F.sum(_value(layout, "CUST-BALANCE", Reading(p)) * 100).cast("long").alias(p) for p in ("cp273", "cp500", "cp1026", "cp1140")]
    return df.agg(*sums)


def packed_invalid_count(spark, sf_dir):
    layout = _layout("V PIC S9(09)V99 COMP-3")
    item = layout.find("V")
    bytes_ = F.when(F.col("c_custkey") % 4 == 0, encoders.page_bytes(F.lit("ABCDEF"), "cp037")).otherwise(encoders.packed(_cents("c_acctbal"), 11))
    got = profile.aggregates(item, Reading(), decoders.raw(item))
    return _records(_table(spark, sf_dir, "customer"), bytes_).agg(got["invalid_packed"].alias("bad"), got["total"].alias("t")).select("bad", (F.col("t") * 100).cast("long").alias("good_cents"))


def _binary_groups(order: str):
    def query(spark, sf_dir):
        layout = _layout("V PIC S9(09) COMP")
        df = _records(_table(spark, sf_dir, "lineitem"), encoders.binary(_cents("l_extendedprice") - 5_000_000, 4, order), keep=("l_returnflag",))
        return df.groupBy("l_returnflag").agg(F.sum(_value(layout, "V", Reading(order=order))).cast("long").alias("total"), F.count(F.lit(1)).alias("n"))

    return query


_BINARY_SQL = "select l_returnflag, cast(sum(cast(round(l_extendedprice * 100) as bigint) - 5000000) as bigint) as total, count(*) as n from lineitem group by l_returnflag"


def binary_entropy(spark, sf_dir):
    layout = _layout("V PIC 9(09) COMP")
    got = profile.aggregates(layout.find("V"), Reading(), decoders.raw(layout.find("V")))
    df = _records(_table(spark, sf_dir, "lineitem"), encoders.binary(_cents("l_extendedprice"), 4))
    return df.agg(got["binary_heads"].cast("long").alias("heads"), got["binary_tails"].cast("long").alias("tails"), got["binary_nonzero"].alias("nonzero"))


def binary_over_pic(spark, sf_dir):
    layout = _layout("V PIC 9(04) COMP")
    got = profile.aggregates(layout.find("V"), Reading(), decoders.raw(layout.find("V")))
    df = _records(_table(spark, sf_dir, "orders"), encoders.binary(F.col("o_orderkey") % 32768, 2))
    return df.agg(got["binary_over"].alias("over_limit"), got["binary_max"].cast("long").alias("largest"))


def _float_sum(encode, reading):
    def query(spark, sf_dir):
        layout = _layout("V COMP-2")
        df = _records(_table(spark, sf_dir, "part"), encode(F.col("p_retailprice"), 8), keep=("p_partkey",))
        return df.select("p_partkey", F.round(_value(layout, "V", reading) * 100).cast("long").alias("cents"))

    return query


_FLOAT_SQL = "select p_partkey, cast(round(p_retailprice * 100) as bigint) as cents from part"


def unset_counts(spark, sf_dir):
    layout = _layout("CODE PIC X(02)", "AMOUNT PIC 9(04)")
    key = F.col("c_custkey")
    code = F.when(key % 3 == 0, F.lit(b"\0\0")).when(key % 3 == 1, F.lit(b"\x40\x40")).otherwise(encoders.page_bytes(F.lit("AB"), "cp037"))
    df = _records(_table(spark, sf_dir, "customer"), code, encoders.zoned(key % 2, 4, sign=False))
    a, b = (profile.aggregates(layout.find(n), Reading(), decoders.raw(layout.find(n))) for n in ("CODE", "AMOUNT"))
    return df.agg(a["unset"].alias("unset"), a["blank"].alias("blank"), b["all_zero"].alias("all_zero"))


def width_underfill(spark, sf_dir):
    item = customer_layout().find("CUST-KEY")
    return customer_records(spark, sf_dir).agg(profile.aggregates(item, Reading(), decoders.raw(item))["widest"].cast("long").alias("widest"))


def uncovered_values(spark, sf_dir):
    layout = copybook.parse("01 R.\n 05 FLAG PIC X.\n  88 RETURNED VALUE 'R'.\n  88 ACCEPTED VALUE 'A'.\n 05 LINE-NO PIC 9.\n  88 EARLY VALUE 1 THRU 4.")
    df = _records(_table(spark, sf_dir, "lineitem"), encoders.page_bytes(F.col("l_returnflag"), "cp037"), encoders.zoned(F.col("l_linenumber"), 1, sign=False)).withColumn("rec_no", F.lit(0))
    items = layout.fields()
    counted = profile.values(df, items, Reading())
    text = decoders.strip(F.col("value"))
    return counted.where(decoders.any_of([(F.col("key") == i.key) & ~profile.covered(i, text) for i in items])).select(F.substring_index("key", "@", 1).alias("field"), "value", "n")


def distinct_values_topk(spark, sf_dir):
    layout = customer_layout()
    got = profile.values(customer_records(spark, sf_dir), [layout.find("CUST-SEGMENT")], Reading())
    return got.select(decoders.strip(F.col("value")).alias("value"), "n").orderBy(F.desc("n"), "value").limit(3)


def unknown_sign_bytes(spark, sf_dir):
    layout = _layout("V PIC S9(05)")
    key = F.col("c_custkey")
    df = _records(_table(spark, sf_dir, "customer"), F.when(key % 5 == 0, F.lit(b"\xf0\xf0\xf0\xf0\x75")).otherwise(encoders.zoned(key, 5)))
    got = profile.aggregates(layout.find("V"), Reading(), decoders.raw(layout.find("V")))
    return df.agg(got["unknown_sign"].alias("unknown"), got["positive"].alias("positive"))


def key_uniqueness(spark, sf_dir):
    """The order key is one, the line key isn't."""
    layout = _layout("K PIC 9(09)", "N PIC 9(02)")
    one = _records(_table(spark, sf_dir, "orders"), encoders.zoned(F.col("o_orderkey"), 9, sign=False), F.lit(b"\xf0\xf0"))
    two = _records(_table(spark, sf_dir, "lineitem"), encoders.zoned(F.col("l_orderkey"), 9, sign=False), encoders.zoned(F.col("l_linenumber"), 2, sign=False))
    items = [layout.find("K"), layout.find("N")]
    counts = {name: evidence.key_counts(df, items, "cp037") for name, df in (("lineitem", two), ("orders", one))}
    rows = [(name, *(c[k] for k in ("records", "distinct", "blank"))) for name, c in counts.items()]
    return spark.createDataFrame(rows, "name string, records long, distinct_keys long, blank long")


def branch_fit(spark, sf_dir):
    layout = copybook.parse("01 R.\n 05 KIND PIC X.\n 05 BODY PIC X(6).\n 05 NUM REDEFINES BODY.\n  10 A PIC 9(06).\n 05 TXT REDEFINES BODY.\n  10 B PIC X(06).")
    status = F.col("o_orderstatus")
    body = F.when(status == "F", encoders.zoned(F.col("o_orderkey") % 1_000_000, 6, sign=False)).otherwise(encoders.page_bytes(F.lit("ABC-XY"), "cp037"))
    df = _records(_table(spark, sf_dir, "orders"), encoders.page_bytes(status, "cp037"), body)
    got = evidence.branch_fit(df, layout.find("KIND"), ["F", "O"], {n: [layout.find(x)] for n, x in (("NUM", "A"), ("TXT", "B"))}, "cp037")
    return got.select("value", "seen", F.col("b0").cast("long").alias("num_ok"), F.col("b1").cast("long").alias("txt_ok"))


def date_field_share(spark, sf_dir):
    layout = _layout("D PIC 9(08)")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    bad = F.when(F.col("o_orderkey") % 10 == 0, F.lit("20260230")).otherwise(day)
    ok, other = evidence.date_counts(_records(_table(spark, sf_dir, "orders"), encoders.page_bytes(bad, "cp037")), layout.find("D"), "cp037", None)
    return spark.createDataFrame([(ok, other)], "dates long, other long")


def encoding_legibility(spark, sf_dir):
    """Legible characters of a column that is written in a page, read in that page."""
    t = F.substring("p_name", 1, 12)
    layout = _layout("T PIC X(12)")
    df = _records(_table(spark, sf_dir, "part"), encoders.page_bytes(t, "cp500"))
    text = decoders.value(layout.find("T"), Reading("cp500"))
    return df.agg(F.sum(F.length(F.regexp_replace(text, f"[^{evidence.LEGIBLE}]", ""))).alias("legible"), F.sum(F.length(text)).alias("chars"))


_GROUP = "01 R.\n 05 K PIC 9(09).\n 05 Q OCCURS 3.\n  10 AMT PIC S9(07)V99 COMP-3.\n  10 FLAG PIC X."


def _grouped(spark, sf_dir):
    layout = copybook.parse(_GROUP)
    s = _table(spark, sf_dir, "supplier")
    cells = [x for n in (1, 2, 3) for x in (encoders.packed(_cents("s_acctbal") * n, 9), encoders.page_bytes(F.lit("ABC"[n - 1]), "cp037"))]
    return layout, _records(s, encoders.zoned(F.col("s_suppkey"), 9, sign=False), *cells, keep=("s_suppkey",))


def occurs_child_rows(spark, sf_dir):
    layout, df = _grouped(spark, sf_dir)
    got = nested.child_rows(df, layout.find("Q"), keep=("s_suppkey",))
    return got.select("s_suppkey", F.col("occurrence").cast("long").alias("occurrence"), (F.col("AMT") * 100).cast("long").alias("cents"), F.col("FLAG").alias("flag"))


def occurs_flatten(spark, sf_dir):
    layout, df = _grouped(spark, sf_dir)
    got = nested.flattened(df, layout.find("Q"), keep=("s_suppkey",))
    return got.select("s_suppkey", *((F.col(f"AMT_{n}") * 100).cast("long").alias(f"cents_{n}") for n in (1, 2, 3)))


def redefines_branch(spark, sf_dir):
    layout = copybook.parse("01 R.\n 05 KIND PIC X.\n 05 BODY PIC X(15).\n 05 NUM REDEFINES BODY.\n  10 A PIC 9(15).\n 05 TXT REDEFINES BODY.\n  10 B PIC X(15).")
    status = F.col("o_orderstatus")
    body = F.when(status == "F", encoders.zoned(F.col("o_orderkey"), 15, sign=False)).otherwise(encoders.page_bytes(F.rpad("o_orderpriority", 15, " "), "cp037"))
    df = _records(_table(spark, sf_dir, "orders"), encoders.page_bytes(status, "cp037"), body, keep=("o_orderkey",))
    got = nested.branches(df, layout, "KIND", {"F": "NUM", "O": "TXT"}, keep=("o_orderkey",))
    return got.select("o_orderkey", F.col("NUM.A").cast("long").alias("number"), F.rtrim("TXT.B").alias("words"))


def divisors(spark, sf_dir):
    """Lengths that would divide a file of one 57-byte record for each customer."""
    size = _table(spark, sf_dir, "customer").count() * 57
    return spark.range(2, min(8192, size) + 1).where(F.lit(size) % F.col("id") == 0).select(F.col("id").alias("length"))


def findings_summary(spark, sf_dir):
    return flagship(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def decoded_customer(spark, sf_dir):
    got = extract.decode(customer_records(spark, sf_dir), customer_layout(), trim=True)
    return got.select(F.col("CUST-KEY").cast("long").alias("k"), (F.col("CUST-BALANCE") * 100).cast("long").alias("cents"), F.col("CUST-SEGMENT").alias("segment"))


def proposer_scores(spark, sf_dir):
    """Proposals matched with proven findings by joins."""
    truth = flagship(spark, sf_dir).where("severity in ('critical', 'warn')").select("field", "code")
    said = spark.createDataFrame([("CUST-BALANCE", "TRAILING_SIGN"), ("CUST-BALANCE", "IMPLIED_DECIMAL"), ("CUST-KEY", "TRAILING_SIGN")], "field string, code string")
    hit, missed, wrong = (x.count() for x in (truth.join(said, ["field", "code"], "left_semi"), truth.join(said, ["field", "code"], "left_anti"), said.join(truth, ["field", "code"], "left_anti")))
    return spark.createDataFrame([(hit, missed, wrong)], "hit long, missed long, refuted long")


def metamorphic_double(spark, sf_dir):
    once = customer_records(spark, sf_dir)
    return once.union(once).agg(F.sum(_value(customer_layout(), "CUST-BALANCE") * 100).cast("long").alias("cents"), F.count(F.lit(1)).alias("n"))


_ZONED = "cast(round(c_acctbal * 100) as bigint)"
QUERIES = planted.QUERIES | {
    "zoned_roundtrip_acctbal": _balance("PIC S9(08)V99", lambda v: encoders.zoned(v, 10)),
    "zoned_sign_totals": zoned_sign_totals,
    "zoned_naive_total": zoned_naive_total,
    "zoned_undeclared_sign": zoned_undeclared_sign,
    "zoned_pages": zoned_pages,
    "ascii_zoned_roundtrip": _balance("PIC S9(08)V99", lambda v: encoders.ascii_zoned(v, 10), Reading("latin1")),
    "separate_sign_trailing": _balance("PIC S9(08)V99 SIGN TRAILING SEPARATE", lambda v: encoders.page_bytes(encoders.separate(v, 10), "cp037")),
    "separate_sign_leading": _balance("PIC S9(08)V99 SIGN LEADING SEPARATE", lambda v: encoders.page_bytes(encoders.separate(v, 10, True), "cp037")),
    "packed_roundtrip": _balance("PIC S9(09)V99 COMP-3", lambda v: encoders.packed(v, 11)),
    "packed_invalid_count": packed_invalid_count,
    "binary_big": _binary_groups("big"),
    "binary_little": _binary_groups("little"),
    "binary_comp5_roundtrip": _balance("PIC S9(09)V99 COMP-5", lambda v: encoders.binary(v, 8)),
    "binary_entropy": binary_entropy,
    "binary_over_pic": binary_over_pic,
    "float_ieee_roundtrip": _float_sum(encoders.ieee, Reading(floats="ieee")),
    "float_hfp_roundtrip": _float_sum(encoders.hexadecimal, Reading(floats="hfp")),
    "unset_counts": unset_counts,
    "width_underfill": width_underfill,
    "uncovered_values": uncovered_values,
    "distinct_values_topk": distinct_values_topk,
    "unknown_sign_bytes": unknown_sign_bytes,
    "key_uniqueness": key_uniqueness,
    "branch_fit": branch_fit,
    "date_field_share": date_field_share,
    "encoding_legibility": encoding_legibility,
    "occurs_child_rows": occurs_child_rows,
    "occurs_flatten": occurs_flatten,
    "redefines_branch": redefines_branch,
    "divisors": divisors,
    "findings_summary": findings_summary,
    "decoded_customer": decoded_customer,
    "proposer_scores": proposer_scores,
    "metamorphic_double": metamorphic_double,
}
ORACLE_SQL = planted.ORACLE_SQL | {
    "zoned_roundtrip_acctbal": _BALANCE_SQL,
    "zoned_sign_totals": f"select count(*) filter (c_acctbal < 0) as negatives, cast(sum({_ZONED}) as bigint) as cents, cast(sum(abs({_ZONED})) as bigint) as cents_abs from customer",
    "zoned_naive_total": f"select cast(sum(abs({_ZONED}) // 10) as bigint) as naive from customer",
    "zoned_undeclared_sign": f"select cast(sum(abs({_ZONED})) as bigint) as declared_cents, cast(sum({_ZONED}) as bigint) as forced_cents from customer",
    "zoned_pages": f"select {', '.join(f'cast(sum({_ZONED}) as bigint) as {p}' for p in ('cp273', 'cp500', 'cp1026', 'cp1140'))} from customer",
    "ascii_zoned_roundtrip": _BALANCE_SQL,
    "separate_sign_trailing": _BALANCE_SQL,
    "separate_sign_leading": _BALANCE_SQL,
    "packed_roundtrip": _BALANCE_SQL,
    "packed_invalid_count": f"select count(*) filter (c_custkey % 4 = 0) as bad, cast(sum({_ZONED}) filter (c_custkey % 4 <> 0) as bigint) as good_cents from customer",
    "binary_big": _BINARY_SQL,
    "binary_little": _BINARY_SQL,
    "binary_comp5_roundtrip": _BALANCE_SQL,
    "binary_entropy": "with v as (select cast(round(l_extendedprice * 100) as bigint) as v from lineitem) select count(distinct (v >> 24) & 255) as heads, count(distinct v & 255) as tails, count(*) as nonzero from v where v <> 0",
    "binary_over_pic": "select count(*) filter (o_orderkey % 32768 > 9999) as over_limit, max(o_orderkey % 32768) as largest from orders",
    "float_ieee_roundtrip": _FLOAT_SQL,
    "float_hfp_roundtrip": _FLOAT_SQL,
    "unset_counts": "select count(*) filter (c_custkey % 3 < 2) as unset, count(*) filter (c_custkey % 3 = 1) as blank, count(*) filter (c_custkey % 2 = 0) as all_zero from customer",
    "width_underfill": "select max(length(cast(c_custkey as varchar))) as widest from customer",
    "uncovered_values": "select 'FLAG' as field, l_returnflag as value, count(*) as n from lineitem where l_returnflag not in ('R', 'A') group by all union all select 'LINE-NO', cast(l_linenumber as varchar), count(*) from lineitem where not l_linenumber between 1 and 4 group by all",
    "distinct_values_topk": "select rtrim(c_mktsegment[1:10]) as value, count(*) as n from customer group by all order by n desc, value limit 3",
    "unknown_sign_bytes": "select count(*) filter (c_custkey % 5 = 0) as unknown, count(*) filter (c_custkey % 5 <> 0) as positive from customer",
    "key_uniqueness": "select 'orders' as name, count(*) as records, count(distinct o_orderkey) as distinct_keys, 0::bigint as blank from orders union all select 'lineitem', count(*), count(distinct (l_orderkey, l_linenumber)), 0 from lineitem",
    "branch_fit": "select o_orderstatus as value, count(*) as seen, count(*) filter (o_orderstatus = 'F') as num_ok, count(*) as txt_ok from orders where o_orderstatus in ('F', 'O') group by all",
    "date_field_share": "select count(*) filter (o_orderkey % 10 <> 0) as dates, count(*) filter (o_orderkey % 10 = 0) as other from orders",
    "encoding_legibility": "select cast(sum(length(regexp_replace(p_name[1:12], '[^A-Za-z0-9 .,\\-/()]', '', 'g'))) as bigint) as legible, cast(sum(length(p_name[1:12])) as bigint) as chars from part",
    "occurs_child_rows": "select s_suppkey, n as occurrence, cast(round(s_acctbal * 100) as bigint) * n as cents, 'ABC'[n] as flag from supplier, range(1, 4) r(n)",
    "occurs_flatten": "with v as (select s_suppkey, cast(round(s_acctbal * 100) as bigint) as c from supplier) select s_suppkey, c as cents_1, 2 * c as cents_2, 3 * c as cents_3 from v",
    "redefines_branch": "select o_orderkey, case when o_orderstatus = 'F' then o_orderkey end as number, case when o_orderstatus = 'O' then rtrim(o_orderpriority) end as words from orders",
    "divisors": "with s as (select count(*) * 57 as size from customer) select n as length from s, range(2, 8193) r(n) where n <= size and size % n = 0",
    "findings_summary": "select 'critical' as severity, 1::bigint as n union all select 'warn', 1 + (select (max(length(cast(c_custkey as varchar))) < 9)::bigint from customer)",
    "decoded_customer": f"select c_custkey as k, {_ZONED} as cents, rtrim(c_mktsegment[1:10]) as segment from customer",
    "proposer_scores": "select 2::bigint as hit, (select (max(length(cast(c_custkey as varchar))) < 9)::bigint from customer) as missed, 1::bigint as refuted",
    "metamorphic_double": f"select cast(2 * sum({_ZONED}) as bigint) as cents, 2 * count(*) as n from customer",
}
