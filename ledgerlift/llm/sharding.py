"""Extendible-hash sharding, in DataFrame operations only.

The directory is indexed by the leading bits of a hash of ``doc_id``. A bucket over the byte limit splits on its
next bit, others stay, so shards differ in depth. Splitting in rounds and choosing, for each hash, the least depth
whose bucket fits give the same directory; the second needs no loop over documents: byte sums of the buckets at one
fine depth are pre-aggregated on the map side, and coarser sums follow from that small histogram, ``STEP`` bits at a time:
each step groups at most 2**STEP neighbours, so the histogram shrinks by as much and no group grows with the data. It ends
where no group fits; depths then go back down by joins.

Rows with one hash (repeated ``doc_id``) never separate on more bits. Where such a bucket is over the limit at the
finest depth, its rows go to numbered overflow pages of at most the limit each, by a running sum of bytes.
A single document over the limit has a page of its own, marked ``oversize``.

Edge cases: null text counts 0 bytes; a null ``doc_id`` hashes as the empty string; repeated rows are placed each;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import cut, table

#: Bits of hash that the directory can use.
HASH_BITS = 60
#: Bytes of a shard in the registered query.
SHARD_BYTES = 1 << 20
#: The histogram's depth beyond that which even buckets would need.
SLACK_BITS = 4
#: Bits by which a step of the histogram gets coarser.
STEP = 4
#: Directories of at most so many rows are broadcast (about 40 bytes each).
BROADCAST_ROWS = 100_000


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, HASH_BITS - depth)


def _depths(sums: DataFrame, depth: int, limit: int) -> DataFrame:
    """(p, depth) of the byte sums (p, bytes) of all buckets at ``depth``, a multiple of STEP: the least depth at which p's bucket fits, or null."""
    if not depth:
        return sums.select("p", F.when(F.col("bytes") <= limit, F.lit(0)).alias("depth"))
    groups = cut(sums.groupBy(F.shiftright("p", STEP).alias("g")).agg(F.collect_list(F.struct("p", "bytes")).alias("xs"), F.sum("bytes").alias("total")))
    each = groups.select("g", "xs", F.explode("xs").alias("x"))

    def loads(k: int) -> Column:
        near = F.filter("xs", lambda y: F.shiftright(y["p"], k) == F.shiftright(F.col("x.p"), k))
        return F.aggregate(near, F.lit(0).cast("long"), lambda total, y: total + y["bytes"])

    # within the group a bucket that fits at a lesser depth fits at all greater ones
    own = reduce(lambda rest, k: F.when(loads(k) <= limit, F.lit(depth - k)).otherwise(rest), range(STEP), F.lit(None).cast("int"))
    each = each.select("g", F.col("x.p").alias("p"), own.alias("own"))
    if not groups.where(F.col("total") <= limit).head(1):
        return each.select("p", F.col("own").alias("depth"))
    above = _depths(groups.select(F.col("g").alias("p"), F.col("total").alias("bytes")), depth - STEP, limit)
    above = above.select(F.col("p").alias("g"), F.col("depth").alias("above"))
    return each.join(above, "g", "left").select("p", F.coalesce("above", "own").alias("depth"))


def assign(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, depth, prefix, page, oversize): the shard is ``(depth, prefix, page)``; bytes of a shard <= limit unless oversize."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")
    keyed = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), h.alias("h"))
    keyed = cut(keyed)  # narrow: three longs for each document, read several times below
    total = keyed.agg(F.sum("n_bytes")).first()[0] or 0
    fine = max(1, (max(1, total // limit) - 1).bit_length() + SLACK_BITS)
    pending, leaves = keyed, []
    while True:
        fine = min(HASH_BITS, -(-fine // STEP) * STEP)
        sums = pending.groupBy(_prefix(F.col("h"), fine).alias("p")).agg(F.sum("n_bytes").alias("bytes"))
        directory = cut(_depths(sums, fine, limit))
        small = directory.count() <= BROADCAST_ROWS
        placed = pending.withColumn("p", _prefix(F.col("h"), fine)).join(F.broadcast(directory) if small else directory, "p", "left")
        leaves.append(placed.where("depth is not null").select("doc_id", "n_bytes", "depth", F.expr(f"shiftright(h, {HASH_BITS} - depth)").alias("prefix"), F.lit(0).cast("long").alias("page"), F.lit(False).alias("oversize")))
        if not directory.where("depth is null").head(1):
            break
        pending = cut(placed.where("depth is null").select("doc_id", "n_bytes", "h"))
        if fine == HASH_BITS:
            leaves.append(_pages(pending, limit))
            break
        fine += 2 * STEP
    return reduce(DataFrame.unionByName, leaves)


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows that share a whole hash, cut into pages: greedy by a running sum within salted runs, so that no one task holds a hot hash.

    Each task of the cut frame ``rows`` numbers its own rows, so a page never mixes tasks and a task that runs again gives
    equal pages; at most one page a task and hash is partly filled.
    """
    rows = rows.withColumn("task", F.spark_partition_id())
    run = Window.partitionBy("h", "task").orderBy("n_bytes", "doc_id")
    before = F.sum("n_bytes").over(run.rowsBetween(Window.unboundedPreceding, -1))
    big = F.col("n_bytes") > limit
    # pages of half the limit by start offset hold at most half a limit plus one row of at most half; larger rows stand alone
    alone = F.col("n_bytes") * 2 > limit
    at = F.when(alone, F.row_number().over(run) * 2 + 1).otherwise(F.floor(F.coalesce(before, F.lit(0)) / F.lit(max(1, limit // 2))) * 2)
    return rows.select("doc_id", "n_bytes", F.lit(HASH_BITS).alias("depth"), F.col("h").alias("prefix"), (F.col("task").cast("long") * (1 << 32) + at + 1).alias("page"), big.alias("oversize"))


def op10_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, with the shard's bytes: (doc_id, n_bytes, depth, prefix, page, shard_id, oversize)."""
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.withColumn("shard_id", F.concat_ws("-", "depth", "prefix", "page"))


ORACLE_SQL = f"""
with keyed as (
  select doc_id, coalesce(strlen(text), 0) as n_bytes,
         ('0x' || substr(md5(cast(doc_id as varchar)), 1, {HASH_BITS // 4}))::bigint as h
  from documents),
depths as (select unnest(range(0, 25)) as d),
loads as (select d, h >> ({HASH_BITS} - d) as p, sum(n_bytes) as bytes from keyed, depths group by all),
fit as (select doc_id, n_bytes, h, min(l.d) as depth
        from keyed k join loads l on l.p = k.h >> ({HASH_BITS} - l.d) and l.bytes <= {SHARD_BYTES}
        group by doc_id, n_bytes, h)
select doc_id, cast(n_bytes as bigint) as n_bytes, cast(depth as integer) as depth,
       cast(h >> ({HASH_BITS} - depth) as bigint) as prefix, cast(0 as bigint) as page,
       depth || '-' || (h >> ({HASH_BITS} - depth)) || '-0' as shard_id, false as oversize
from fit
"""
