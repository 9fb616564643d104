"""Pieces that several operators share: tables, the shared scratch folder, hashes, filters."""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = "16777216"
_local: dict[str, str] = {}


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded in bytes, unless the session says how."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "2147483647") or 0) >= 2**31 - 1:
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which driver and executors share.

    Unset, a local master, whose executors are the driver, gets a temporary folder that goes at exit;
    a cluster gets an error: its machines share no other folder that is known to be one.
    """
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if base:
        return f"{base.rstrip('/')}/{app}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, _local[app], True)
    return _local[app]


def stash(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends here,
    and a lost executor costs a reread, not a recomputation. ``release`` or ``clear`` removes the table."""
    bound_batches(df.sparkSession)
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*stashed: DataFrame) -> None:
    """Remove tables of ``stash`` that nothing reads any more."""
    for df in stashed:
        _delete(df.sparkSession, df._stashed)


def clear(spark: SparkSession) -> None:
    """Remove all that this application has stashed; call it when its results are written."""
    _delete(spark, scratch(spark))


def per_worker(key, make):
    """``make()``, once in each Python worker process: functions come anew with each task, the process stays."""
    store = sys.modules.setdefault("_llm_worker", types.ModuleType("_llm_worker")).__dict__.setdefault("kept", {})
    if key not in store:
        store[key] = make()
    return store[key]


def salted_lookup(rows: DataFrame, index: DataFrame, key: str, total: int, how: str = "inner", many: bool = False) -> DataFrame:
    """``rows`` with what ``index`` (one row a key, or ``many``, with its count ``n`` of rows) says of their key.

    Keys with over a thousandth of ``total`` rows, a thousand keys at most, are known to all
    executors; their rows are dealt by a salt, row by row, the index rows repeated for each salt.
    """
    fair = max(1, -(-total // 1000))
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(fair))).cast("int")
    hot = index.where(F.col("n") > fair).select(key, salts.alias("_salts"))
    hot = F.broadcast(hot.distinct() if many else hot)
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_salts", F.lit(1))).cast("int")
    rows = rows.join(hot, key, "left").withColumn("_salt", dealt).drop("_salts")
    return rows.join(index.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))), [key, "_salt"], how).drop("_salt")


def row_mark(own: Column, text: Column) -> Column:
    """16 bytes that stand for a row's id, of any type or null, and its text: rows that share a mark repeat both."""
    parts = own.isNull().cast("string"), F.coalesce(own.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(F.concat_ws(":", *parts)))


def hash60(*parts: Column) -> Column:
    """The first 60 bits of the MD5 of the parts joined by colons, nulls as ``~``; DuckDB agrees bit by bit."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def bucket_shift(rows: int, per_bucket: int = 20_000, least: int = 10, bits: int = 60) -> int:
    """How far to shift a 60-bit hash to the right so that about ``per_bucket`` rows share
    a value, and at least 2**least values exist."""
    return bits - max(least, max(1, rows // per_bucket).bit_length())


def null_last(col: Column) -> list[Column]:
    return [col.isNull().cast("int"), col]


_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + np.uint64((_ODD[0] * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(_ODD[1])
    x = (x ^ x >> np.uint64(27)) * np.uint64(_ODD[2])
    return x ^ x >> np.uint64(31)


def _tables():
    """Random values of bytes (A-Z as a-z), powers of an odd base, and which bytes part words."""
    byte = mix64(np.arange(256, dtype=np.uint64), 7)
    byte[65:91] = byte[97:123]
    power = np.cumprod(np.append(np.uint64(1), np.full(65_535, _ODD[1], np.uint64)))
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return byte, power, space


def _pieces(raws: list[bytes], most: int = 1 << 18):
    """Runs of texts of about ``most`` bytes together."""
    first, size = 0, 0
    for i, raw in enumerate(raws):
        if size and size + len(raw) > most:
            yield raws[first:i]
            first, size = i, 0
        size += len(raw)
    if first < len(raws):
        yield raws[first:]


def word_hashes(raws: list[bytes]):
    """For some texts at a time, the 64-bit hashes of all their words, and the bounds of each text's words among them.

    A word's hash is the sum of its bytes' random values times powers of a base by place, mixed with its length.
    """
    byte, power, space = per_worker("word-tables", _tables)
    for texts in _pieces(raws):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        gap = space[data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.append(0, edge)
        starts, ends = edge[0::2], edge[1::2]
        lens = ends - starts
        inside = np.flatnonzero(~gap)
        place = (inside - np.repeat(starts, lens)) & 0xFFFF
        offsets = np.append(0, np.cumsum(lens))[:-1]
        words = np.add.reduceat(byte[data[inside]] * power[place], offsets) if len(starts) else np.zeros(0, np.uint64)
        yield mix64(words ^ lens.astype(np.uint64)), np.searchsorted(starts, np.append(0, np.cumsum([len(t) + 1 for t in texts]))).tolist()


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` words."""
    folded = np.full(max(len(words) - k + 1, 0), k, np.uint64)
    for i in range(k if len(folded) else 0):
        folded = folded * np.uint64(_ODD[0]) + words[i : i + len(folded)]
        folded ^= folded >> np.uint64(29)
    return mix64(folded)


# A Bloom filter cut into slices by the digest's first two bytes, so that it can be
# built by many tasks, each holding one slice.  Its size is bounded, whatever it holds.
SLICES, PROBES = 256, 5


def slice_bits(entries: int, most_bytes: int = 1 << 26) -> int:
    """Bits of one slice, a power of two: about 16 an entry, ``most_bytes`` for all slices at most."""
    want = max(512, 16 * entries // SLICES)
    return min(1 << (want - 1).bit_length(), most_bytes * 8 // SLICES)


def bloom_places(digests: np.ndarray, bits: int, probes: int = PROBES) -> np.ndarray:
    """Positions of each digest (rows of 16 bytes or more) within the whole filter."""
    words = np.ascontiguousarray(digests[:, :16]).view("<u4").reshape(len(digests), 4).astype(np.uint64)
    a, b = words[:, 1], words[:, 2] | np.uint64(1)
    steps = np.arange(probes, dtype=np.uint64)
    inside = (a[:, None] + steps[None, :] * b[:, None] + (words[:, 3] * np.uint64(0x9E3779B1))[:, None]) % np.uint64(bits)
    return inside + (digests[:, 0].astype(np.uint64) * np.uint64(bits))[:, None]


def bloom_has(bloom: np.ndarray, bits: int, digests: np.ndarray) -> np.ndarray:
    out = np.zeros(len(digests), bool)
    first = bloom_places(digests, bits, 1)[:, 0]  # most of what a filter lacks goes here
    some = np.flatnonzero((bloom[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8)) & 1)
    at = bloom_places(digests[some], bits)
    out[some] = ((bloom[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
    return out


def as_rows(digests: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(len(digests), width)


def long_rows(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes as the digests that a filter takes; the first byte is the hash's highest."""
    return np.ascontiguousarray(np.stack([hashes.astype(">u8").view(np.uint64), mix64(hashes)], axis=1)).view(np.uint8)


def bloom_of(df: DataFrame, digest: str, entries: int, width: int, most_bytes: int = 1 << 26):
    """The filter of ``df``'s digests as (bits of a slice, bytes), built in slices on the executors; width 8: of longs.

    What reaches the driver is the filter, ``most_bytes`` at most, never the digests.
    """
    bits = slice_bits(entries, most_bytes)

    def build(batches):
        open_slices: dict[int, np.ndarray] = {}

        def out(keys):
            return pa.RecordBatch.from_pydict({"slice": keys, "bits": [open_slices[k].tobytes() for k in keys]}, schema=schema)

        schema = pa.schema([("slice", pa.int32()), ("bits", pa.binary())])
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = long_rows(batch.column(0).to_numpy().view(np.uint64)) if width == 8 else as_rows(batch.column(0).to_pylist(), width)
            at, of = bloom_places(rows, bits), rows[:, 0]
            for k in np.unique(of):
                own = open_slices.setdefault(int(k), np.zeros(bits // 8, np.uint8))
                inner = at[of == k].ravel() - np.uint64(int(k) * bits)
                np.bitwise_or.at(own, inner >> np.uint64(3), (1 << (inner & np.uint64(7))).astype(np.uint8))
        if open_slices:
            yield out(sorted(open_slices))

    whole = np.zeros(SLICES * bits // 8, np.uint8)
    slices = F.shiftrightunsigned(digest, 56) if width == 8 else F.substring(digest, 1, 1)
    dealt = df.select(digest).repartition(slices)  # a slice meets in one task
    for row in dealt.mapInArrow(build, "slice int, bits binary").collect():
        at = row["slice"] * bits // 8
        whole[at : at + bits // 8] |= np.frombuffer(row["bits"], np.uint8)
    return bits, whole.tobytes()


def sifted(docs: DataFrame, mark: Column, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` as (row, mark) in two parts: rows that ``marks``, a stashed table of 16-byte ``mark``s, can't hold,
    and the rest to be looked up. Only a filter of ``marks`` goes to the executors, and no row is shuffled here."""
    bits, body = bloom_of(marks, "mark", marks.count(), 16)
    shared = docs.sparkSession.sparkContext.broadcast(body)

    @F.arrow_udf("boolean")
    def maybe(own: pa.Array) -> pa.Array:
        return pa.array(bloom_has(np.frombuffer(shared.value, np.uint8), bits, as_rows(own.to_pylist(), 16)))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), mark.alias("mark")).withColumn("maybe", maybe(F.col("mark")))
    return rows.where(~F.col("maybe")).drop("maybe"), rows.where("maybe").drop("maybe")
