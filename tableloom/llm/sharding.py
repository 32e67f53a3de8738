"""Shards that all match the mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import pick, written


def _numbered(df: DataFrame, order: list[str], within: str | None, rank: str, total: str) -> DataFrame:
    """df with each row's place from 0 in the given total order, and the count of rows, of all or of those equal in `within`.

    Rows go to ranges of the order and are sorted there; the ranges are
    written, so that their numbers hold for good, and each range then adds the
    rows that lie before it: one count a range (and value of `within`).  No
    task sees more than a range, however many rows one source has.
    """
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1))), rank)
    keys = [within] if within else []
    counts = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", *keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"), F.sum("_n").over(by).alias(total))
    bases = bases.withColumnsRenamed({"_part": "_p"} | {k: "_k" for k in keys})
    same = F.col("_part") == F.col("_p")
    if within:
        same &= F.col(within).eqNullSafe(F.col("_k"))
    return ranged.join(bases, same).withColumn(rank, F.col("_at") + F.col("_base")).drop("_part", "_at", "_base", "_p", "_k")


def _digit_order(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def shard(docs: DataFrame, *, shards: int = 8, seed: int = 17) -> DataFrame:
    """Deal documents into `shards` shards whose row counts differ by one at most and whose sources all keep their shares.

    Within a source, rows are shuffled by a seeded hash of doc_id and ranked;
    row r of n stands at (r - 1/2) / n; all rows are sorted by that fraction
    and the order is cut into equal parts.  Input: `doc_id`, `text`, `source`;
    further columns are ignored.  Output: doc_id, source, size (UTF-8 bytes of
    the text plus 1; null: 1), text_crc32 (0 for null), shard, slot (gapless
    from 0 in its shard).  Rows of a null source form a stratum of their own.
    Rows of one doc_id are ordered by size and crc32; equal rows may swap
    places, which gives the same result.  An empty table gives no rows.

    Only the digest columns are shuffled, twice, by ranges of a hash or of the
    fraction; the law is `rows`, so copies of one text may part.
    """
    d = pick(docs, "doc_id", text="string", source="string")
    light = d.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        _digit_order(seed, F.col("doc_id")).alias("_h"),
    )
    ranked = _numbered(light, ["source", "_h", "doc_id", "size", "text_crc32"], "source", "_r", "_n")
    spread = ranked.select("doc_id", "source", "size", "text_crc32", "_h", ((F.col("_r") + 0.5) / F.col("_n")).alias("_f"))
    placed = _numbered(spread, ["_f", "_h", "source", "doc_id", "size", "text_crc32"], None, "_r", "_n")
    # shard s takes the places p with floor(p * shards / n) = s, so it begins at ceil(s * n / shards)
    return placed.withColumn("shard", F.expr(f"cast(_r * {shards} div _n as int)")).select(
        "doc_id", "source", "size", "text_crc32", "shard", F.expr(f"_r - (shard * _n + {shards - 1}) div {shards}").alias("slot")
    )


#: op10's result as DuckDB SQL; crc32 by bytes from its table, as DuckDB has no such function.
ORACLE = """
WITH t AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT doc_id, source, (coalesce(strlen(text), 0) + 1)::BIGINT AS size, hex(encode(coalesce(text, ''))) AS x, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
y AS (SELECT * EXCLUDE (x), xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM d, t),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, text_crc32) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM y),
p AS (SELECT *, row_number() OVER (ORDER BY f, h, source NULLS FIRST, doc_id, size, text_crc32) - 1 AS p, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p * 8 // n)::INT AS shard, p - ((p * 8 // n) * n + 7) // 8 AS slot, NULL::INT AS grown_shard FROM p
"""
