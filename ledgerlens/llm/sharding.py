"""Rendezvous hashing of record keys over weighted shards (operator 7).

Every (key, shard) pair has a pseudo-random draw ``u`` in (0, 1); a record goes to the shard
with the least ``-ln(u) / weight``. A shard's draws do not depend on the other shards, so one
more shard only takes records into itself, and a changed weight moves few.

Defined cases: a null key hashes as the text ``null``; repeated keys share a shard and have
slots of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import settle, whole_text

BUCKETS = 1024


def draw(key: Column, shard: int) -> Column:
    """The draw of a key for one shard: 52 bits of an MD5, never 0 or 1."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"#{shard}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: 0 to ``len(weights) - 1``; null if no weight is positive."""
    bids = [F.struct((-F.ln(draw(key, s)) / float(w)).alias("bid"), F.lit(s).alias("shard"))
            for s, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*bids))["shard"] if bids else F.lit(None).cast("int")


def assign_shards(df: DataFrame, key: str, weights: Sequence[float]) -> DataFrame:
    """``df`` with a column ``shard`` (an existing one of that name is replaced)."""
    return df.withColumn("shard", rendezvous(F.col(key), weights))


def number_in_shards(df: DataFrame, shard: str, order: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Gapless ``slot`` numbers from 0 within each shard, in order of a key hash and ``order``.

    Equal rows are counted before the shuffle and take consecutive slots. Each shard is cut into
    ``buckets`` by key hash; buckets are ranked on their own and moved by the counts before
    them, so no shard is gathered; raise ``buckets`` with the rows.
    """
    rows = df.groupBy(shard, *order).agg(F.count(F.lit(1)).alias("_n"))
    digits = F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in order])), 1, 8)
    rows = settle(rows.withColumn("_bucket", (F.conv(digits, 16, 10).cast("long") % buckets).cast("int")), "shards")
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_total"))
               .withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total"))
    inside = (Window.partitionBy("_shard", "_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order])
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.withColumn("_shard", F.col(shard))
              .withColumn("_prior", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
              .join(offsets.withColumnRenamed(shard, "_of").withColumnRenamed("_bucket", "_in"),
                    (F.col("_shard") == F.col("_of")) & (F.col("_bucket") == F.col("_in"))))
    first = F.col("_base") + F.col("_prior")
    return placed.select(shard, *order, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("slot"))


def shard_documents(df: DataFrame, shards: int = 8) -> DataFrame:
    """Place documents by ``doc_id``: size, checksum, shard, slot, and the shard if there were one more."""
    text = whole_text(F.col("text"))
    placed = assign_shards(df.select("doc_id", F.octet_length(text).cast("long").alias("_bytes"),
                                     F.crc32(text.cast("binary")).alias("text_crc32")), "doc_id", [1.0] * shards)
    placed = placed.select("doc_id", (F.col("_bytes") + 1).alias("size"), "text_crc32", "shard")
    numbered = number_in_shards(placed, "shard", ["doc_id", "size", "text_crc32"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                           rendezvous(F.col("doc_id"), [1.0] * (shards + 1)).alias("grown_shard"))


def shard_documents_sql(shards: int = 8) -> str:
    """The same placement in SQL; the checksum is computed byte by byte with the usual table (polynomial 0xEDB88320)."""
    def bid(s: int) -> str:
        return f"-ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '#{s}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"

    def place(n: int) -> str:
        bids = ", ".join(bid(s) for s in range(n))
        return f"CAST(list_position([{bids}], list_min([{bids}])) - 1 AS INTEGER)"

    return f"""
WITH step AS (
  SELECT list(c ORDER BY n) AS p FROM (
    SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) t(n))),
bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, CAST(len(h) // 2 + 1 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, p[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, step),
placed AS (SELECT *, {place(shards)} AS shard, {place(shards + 1)} AS grown_shard,
  ('0x' || substr(md5(concat_ws('|', doc_id, size, text_crc32)), 1, 8))::BIGINT % {BUCKETS} AS bucket FROM sums)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM placed"""
