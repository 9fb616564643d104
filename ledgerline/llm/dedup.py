"""Exact dedup by a log-structured merge index of text digests."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_rows, bloom_has, bloom_of, release, stash, table

SPACES = b" \t\n\x0b\x0c\r"
MEMTABLE_ROWS = 65_536
RANGE_ROWS = 262_144
FILTER_BYTES = 1 << 26


def _normalised(column):
    """(digest, normalised bytes) of each text of an Arrow column; null counts as empty."""
    import pyarrow as pa

    for raw in column.cast(pa.binary()).to_pylist():
        data = (raw or b"").translate(None, SPACES)
        yield hashlib.sha256(data).digest(), data


def _lengths(column):
    import pyarrow.compute as pc

    return pc.fill_null(pc.utf8_length(column), 0).cast("int64")


def flush_runs(docs: DataFrame, digest_bytes: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Level 0: (run, digest, length, id, n). Each task keeps a memtable of at most
    ``memtable_rows`` digests, each with its best row so far and its count, and flushes
    it as a run sorted by digest."""
    id_type = docs.schema["id"].dataType
    schema = T.StructType([
        T.StructField("run", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("length", T.LongType()),
        T.StructField("id", id_type), T.StructField("n", T.LongType()),
    ])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        memtable: dict[bytes, list] = {}
        runs = 0
        part = TaskContext.get().partitionId() if TaskContext.get() else 0

        def flush(out_schema):
            keys = sorted(memtable)
            cols = [[f"{part}-{runs}"] * len(keys), keys, *([memtable[k][i] for k in keys] for i in range(3))]
            memtable.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, out_schema, strict=True)], names=schema.names)

        out_schema = None
        for batch in batches:
            out_schema = [pa.string(), pa.binary(), pa.int64(), batch.schema.field(0).type, pa.int64()]
            ids, lengths = batch.column(0).to_pylist(), _lengths(batch.column(1)).to_pylist()
            for own, length, (digest, _) in zip(ids, lengths, _normalised(batch.column(1)), strict=True):
                digest = digest[:digest_bytes]
                if (entry := memtable.get(digest)) is None:
                    if len(memtable) >= memtable_rows:
                        yield flush(out_schema)
                        runs += 1
                    memtable[digest] = [length, own, 1]
                else:
                    entry[2] += 1
                    if _rank(length, own) < _rank(*entry[:2]):
                        entry[:2] = length, own
        if memtable:
            yield flush(out_schema)

    return docs.mapInArrow(run, schema)


def _rank(length, own):
    """What orders the rows of a group: the longest original text first, then the smallest id, null ids last."""
    return -length, own is None, own if own is not None else 0


def digest_range(digest: Column, ranges: int) -> Column:
    """Which of ``ranges`` (a power of two, 65,536 at most) equal parts of all digests one falls in."""
    first = F.conv(F.rpad(F.hex(F.substring(digest, 1, 2)), 4, "0"), 16, 10).cast("int")
    return F.shiftright(first, 17 - ranges.bit_length())


def compact(runs: DataFrame, entries: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Level 1: the runs of level 0 merged by ranges of the digest into one sorted run a range, of
    (digest, keep_id, keep_length, n), as far as a digest has two rows or more.

    A range meets in one task, which reads the entries of its runs in the order of their digests and folds those
    of one digest as they come: it holds one entry, however many runs have it. A digest comes once a run, so that a
    group of any size brings at most as many entries as there are runs. Ranges hold about
    ``range_rows`` entries each up to 65,536 ranges, which digests of any number fill evenly.
    """
    ranges = 1 << min(16, max(8, (entries // range_rows).bit_length()))
    kinds = {f.name: f.dataType for f in runs.schema.fields}
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("keep_id", kinds["id"]), T.StructField("keep_length", T.LongType()), T.StructField("n", T.LongType())])

    def merge(batches):
        import pyarrow as pa

        held, types = None, None

        def out(rows):
            rows = [r for r in rows if r[3] > 1]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=schema.names)

        for batch in batches:
            types, done = [f.type for f in batch.schema], []
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held[0] != entry[0]:
                    done += [held] if held else []
                    held = list(entry)
                    continue
                held[3] += entry[3]
                if _rank(entry[2], entry[1]) < _rank(held[2], held[1]):
                    held[1:3] = entry[1:3]
            if done:
                yield out(done)
        if held:
            yield out([held])

    met = runs.repartition(digest_range(F.col("digest"), ranges)).sortWithinPartitions("digest")
    return met.select("digest", "id", "length", "n").mapInArrow(merge, schema)


def probe(docs: DataFrame, bloom, hot: dict[bytes, int], digest_bytes: int = 32) -> DataFrame:
    """(id, length, sha, hit, salt, body): what misses the index's filter is unique and done;
    a hit carries its normalised bytes, to be compared with the row that stays."""
    bits, filter_bytes = bloom
    shared = docs.sparkSession.sparkContext.broadcast((filter_bytes, hot))
    fields = [T.StructField(n, t) for n, t in (("length", T.LongType()), ("sha", T.BinaryType()), ("hit", T.BooleanType()), ("salt", T.IntegerType()), ("body", T.BinaryType()))]
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *fields])

    def run(batches):
        import pyarrow as pa

        whole, hot_digests = np.frombuffer(shared.value[0], np.uint8), shared.value[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = list(_normalised(batch.column(1)))
            hits = bloom_has(whole, bits, as_rows([d for d, _ in pairs], 32))
            salts = [zlib.crc32(repr(own).encode()) % hot_digests.get(d[:digest_bytes], 1) for own, (d, _) in zip(batch.column(0).to_pylist(), pairs, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), _lengths(batch.column(1)), pa.array([d for d, _ in pairs], pa.binary()), pa.array(hits),
                pa.array(salts, pa.int32()), pa.array([b if h else None for h, (_, b) in zip(hits, pairs, strict=True)], pa.binary()),
            ], names=schema.names)

    return docs.mapInArrow(run, schema)


def dedup(docs: DataFrame, id_col="doc_id", text_col="text", digest_bytes: int = 32, memtable_rows: int = MEMTABLE_ROWS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, sha): the group of each row, and the row that stays.

    Two scans of the texts and no shuffle of them but for the hits. Level 0 takes the digests of all rows, level 1
    those of two rows or more; the filter of its runs is all that executors get whole: 16 bits a digest
    or somewhat more, ``filter_bytes`` at most in each worker (64 MB hold 33 million digests at that rate, 2 GB a thousand million). Beyond
    that a unique text may pass as a hit, at worst every one: it then travels to be compared with nothing and stays. Groups with over a thousandth of all rows, so a thousand
    at most, are salted. Null texts count as empty; null ids rank last; rows that repeat
    id and text are one document: all of them stay or go, and each counts in
    ``group_size``; an empty table gives no rows; extra columns aren't looked at.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    level0 = stash(flush_runs(docs, digest_bytes, memtable_rows), "dedup-level0")
    entries, total = level0.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    level1 = stash(compact(level0, entries), "dedup-level1")
    release(level0)
    fair = max(1, -(-total // 1000))
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(fair))).cast("int")
    hot = {bytes(r["digest"]): r["salts"] for r in level1.where(F.col("n") > fair).select("digest", salts.alias("salts")).collect()}
    if digest_bytes < 16:  # short digests are for tests of the verification: every row is a hit
        bloom = (512, b"\xff" * (256 * 512 // 8))
    else:
        bloom = bloom_of(level1, "digest", level1.count(), digest_bytes, filter_bytes)
    probed = stash(probe(docs, bloom, hot, digest_bytes), "dedup-probed")
    unique = probed.where(~F.col("hit")).select(
        "id", F.col("id").alias("keep_id"), F.col("length").alias("keep_length"), F.lit(1).cast("long").alias("group_size"), "length", "sha"
    )

    salted = level1.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    hits = probed.where("hit").withColumn("digest", F.substring("sha", 1, digest_bytes)).join(salted, ["digest", "salt"], "left")
    same = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length"))
    keepers = hits.where(same & F.col("n").isNotNull()).groupBy("digest").agg(F.min("body").alias("kept_body"), F.max("n").alias("n"))
    keepers = keepers.select("digest", "kept_body", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    equal = F.col("n").isNull() | (F.col("body") == F.col("kept_body"))
    verified = stash(
        hits.join(keepers, ["digest", "salt"], "left")
        .withColumn("equal", F.coalesce(equal, F.lit(False)))
        .select(
            "id", "digest", "length", "sha", "equal", F.when(~F.col("equal"), F.col("body")).alias("body"), F.coalesce("n", F.lit(1)).alias("n"),
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("keep_length", "length").alias("keep_length"),
        ),
        "dedup-verified",
    )
    same_digest = verified.where(~F.col("equal"))
    if same_digest.isEmpty():
        checked = verified.select("id", "keep_id", "keep_length", F.col("n").alias("group_size"), "length", "sha")
    else:  # unequal texts share a digest: what equals the row that stays keeps its group, the rest forms groups by its bytes
        left = verified.where("equal").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        kept = verified.where("equal").join(left, "digest").select("id", "keep_id", "keep_length", "group_size", "length", "sha")
        own = same_digest.groupBy("body").agg(
            F.min(F.struct((-F.col("length")).alias("l"), F.col("id").isNull().alias("u"), "id")).alias("best"), F.count(F.lit(1)).alias("group_size")
        )
        rest = same_digest.drop("keep_id", "keep_length").join(own, "body").select(
            "id", F.col("best.id").alias("keep_id"), (-F.col("best.l")).alias("keep_length"), "group_size", "length", "sha"
        )
        checked = kept.unionByName(rest)
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length"))
    return unique.unionByName(checked).select("id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("sha"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
k AS (SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM n)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM k
"""
