"""Sharding by rendezvous hashing over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_shift, hash60, stash, table

SHARDS = 24


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard that draws the highest score for ``key``: -w / ln(u), u a hash of key and
    shard in (0, 1). A shard's draws don't depend on the others: one more shard, or a heavier
    one, takes rows only into itself, in proportion to its weight."""

    def score(i: int, w: float) -> Column:
        u = (hash60(key, F.lit(i)) + F.lit(0.5)) / F.lit(float(1 << 60))
        return F.struct((F.lit(-float(w)) / F.log(u)).alias("score"), F.lit(-i).alias("order"))

    drawn = [score(i, w) for i, w in enumerate(weights) if w > 0]
    best = F.greatest(*drawn) if len(drawn) > 1 else drawn[0]
    return (-best["order"]).cast("int")


def assign(docs: DataFrame, id_col="doc_id", weights: list[float] | None = None, shard_col="shard") -> DataFrame:
    """``docs`` with ``shard_col``, decided by id and weights alone: no shuffle, no state.

    A null id is a key as any other; repeated rows share a shard; a column named as
    ``shard_col`` is replaced; other columns pass through.
    """
    return docs.withColumn(shard_col, rendezvous(F.col(f"`{id_col}`"), weights or [1.0] * SHARDS))


def shard(docs: DataFrame, id_col="doc_id", text_col="text", weights: list[float] | None = None) -> DataFrame:
    """(id, size, crc, shard, slot, grown): slots number a shard's rows without gaps from 0.

    Rows are ordered by a hash of their id. Ranges of that hash split each shard into
    groups of bounded size; a row's slot is its place in its range plus the rows of the
    ranges before. Null texts count as empty, null ids as one key whose rows crc and size
    spread over the ranges; equal rows take neighbouring slots in any order.
    """
    weights = weights or [1.0] * SHARDS
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    light = docs.select(
        key.alias("id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, 1.0]).alias("grown"),
    ).withColumn("place", hash60(F.lit("slot"), F.col("id"), F.col("crc"), F.col("size")))
    light = stash(light, "shard-rows")
    light = light.withColumn("bucket", F.shiftright("place", bucket_shift(light.count())))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = light.groupBy("shard", "bucket").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("shard", "bucket").orderBy("place", "id")
    return light.withColumn("slot", F.row_number().over(inside) - 1).join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("slot") + F.col("start")).cast("long"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", F.col("grown").alias("grown_shard")
    )



#: Equal weights: the highest score is the highest hash. CRC-32 goes byte by byte, by its table.
ORACLE_SQL = f"""
WITH t AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crcs FROM range(256) x(i)),
b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, len(bytes) + 8 AS size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, crcs[1 + (xor(a, x) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM b, t),
h AS (SELECT doc_id, i, ('0x' || substr(md5(doc_id || ':' || i), 1, 15))::BIGINT AS h FROM documents, range({SHARDS + 1}) x(i)),
s AS (SELECT doc_id, (arg_max(i, h) FILTER (i < {SHARDS}))::INTEGER AS shard, arg_max(i, h)::INTEGER AS grown_shard FROM h GROUP BY doc_id)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5('slot:' || doc_id || ':' || crc || ':' || size), 1, 15))::BIGINT, doc_id) - 1 AS slot, grown_shard
FROM c JOIN s USING (doc_id)
"""
