"""Line dedup by content-defined chunks of lines, and by the two lines at every break."""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_rows, bloom_has, bloom_of, row_mark, salted_lookup, stash, table

#: Lines in a rolling window; one boundary in so many windows; a chunk's lines at least and at most.
WINDOW, MEAN, LEAST, MOST = 2, 3, 2, 16
_BASE = 0x100000001B3
#: Chunks that a worker turns into one batch.
_BATCH = 1 << 15


def chunk_places(text: str, mean: int = MEAN, least: int = LEAST, most: int = MOST):
    """(first line, lines, start, end) of each chunk of ``least`` lines or more, in code points.

    A boundary follows a line where the rolling hash of the last WINDOW lines' hashes is 0
    modulo ``mean`` and its chunk has ``least`` lines: text put in or cut out above may shift the
    boundaries next below. ``end`` leaves out the break behind the last line.
    """
    lines = text.split("\n")
    marks = [zlib.crc32(line.encode()) for line in lines]
    first, start, at = 0, 0, 0
    for k, line in enumerate(lines):
        at += len(line) + 1
        size = k - first + 1
        roll = 0
        for h in marks[max(0, k - WINDOW + 1) : k + 1]:
            roll = (roll * _BASE + h) & 0xFFFFFFFFFFFFFFFF
        edge = ((roll ^ roll >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 40
        if size >= least and edge % mean == 0 or size >= most or k == len(lines) - 1:
            if size >= least:
                yield first, size, start, at - 1
            first, start = k + 1, at


def pair_places(text: str):
    """(first line, 2, start, end) at each line but the last: every run of two whole lines."""
    start = 0
    lines = text.split("\n")
    for k, (line, below) in enumerate(zip(lines, lines[1:])):
        yield k, 2, start, start + len(line) + 1 + len(below)
        start += len(line) + 1


def _places(text: str):
    """The chunks and, between and across them, the pairs that are no chunk themselves."""
    whole = set()
    for place in chunk_places(text):
        if place[1] == 2:
            whole.add(place[0])
        yield place
    for place in pair_places(text):
        if place[0] not in whole:
            yield place


def _chunks(texts, ids, marks, digest_bytes):
    for own, text, mark in zip(ids, texts, marks, strict=True):
        if text and "\n" in text:
            for first, size, start, end in _places(text):
                body = text[start:end].encode()
                if not body.isspace() and body:
                    yield own, mark, first, size, start, end, hashlib.blake2b(body, digest_size=16).digest()[:digest_bytes], body


def chunks(docs: DataFrame, digest_bytes: int = 16, bloom=None) -> DataFrame:
    """(id, mark, first_line, lines, start, end, digest) of every chunk and pair of lines of ``docs`` (id, text, mark);
    with ``bloom`` only of those that its filter has, and their bytes as ``body``."""
    fields = [T.StructField(n, T.LongType()) for n in ("first_line", "lines", "start", "end")]
    own = T.StructField("id", docs.schema["id"].dataType), T.StructField("mark", T.BinaryType())
    schema = T.StructType([*own, *fields, T.StructField("digest", T.BinaryType()), T.StructField("body", T.BinaryType())])
    shared = docs.sparkSession.sparkContext.broadcast(bloom) if bloom else None

    def run(batches):
        import pyarrow as pa

        bits, whole = (shared.value[0], np.frombuffer(shared.value[1], np.uint8)) if shared else (0, None)
        for batch in batches:
            ids, texts, marks = (c.to_pylist() for c in batch.columns)
            found = _chunks(texts, ids, marks, digest_bytes)
            types = [batch.schema.field(0).type, pa.binary(), *[pa.int64()] * 4, pa.binary(), pa.binary()]
            for rows in itertools.batched(found if shared else ((*r[:7], None) for r in found), _BATCH):
                if shared and digest_bytes == 16:
                    keep = bloom_has(whole, bits, as_rows([r[6] for r in rows], 16))
                    rows = [r for r, k in zip(rows, keep, strict=True) if k]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return docs.mapInArrow(run, schema)


def repeated(docs: DataFrame, id_col="doc_id", text_col="text", digest_bytes: int = 16) -> DataFrame:
    """The chunks to remove: (id, mark, first_line, lines, start, end, keep_id, keep_start, n), offsets in code points.

    ``mark`` stands for a row's id and text (``row_mark``), as in ``lines.without``, which cuts these spans too. Digests of
    all chunks are grouped with partial aggregation. A filter of the repeated ones (64 MB at most) picks the chunks
    whose bytes a second scan brings along; each is compared with the first of its group by id (null last), mark and
    place, and goes only if it is equal. Two whole lines in a row, unless both are blank, that stand at an earlier place as
    well are always among them: spans overlap, and a longer run is their union. Each line of a span that goes equals a
    line at an earlier place, so one copy of every line stays. Frequent digests are salted.

    Texts without a line break, null and empty ones have no chunk; a very long text is cut whole, each chunk sixteen lines at
    most, however long; rows that repeat id and text share places, and both keep or lose a chunk; rows that share an id, or a
    null one, but not a text stand apart; an empty table gives no rows; extra columns aren't looked at.
    """
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    docs = docs.select(own.alias("id"), text.alias("text"), row_mark(own, text).alias("mark"))
    rows = stash(chunks(docs, digest_bytes).select("id", "mark", "start", "digest"), "chunks-rows")
    rank = F.struct(F.col("id").isNull().alias("u"), "id", "mark", "start")
    groups = rows.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    keep = F.col("first.id").alias("keep_id"), F.col("first.mark").alias("keep_mark"), F.col("first.start").alias("keep_start")
    index = stash(groups.select("digest", "n", *keep), "chunks-index")
    bloom = bloom_of(index, "digest", index.count(), digest_bytes) if digest_bytes == 16 else (1, b"\xff")
    total = rows.count()
    hits = stash(salted_lookup(chunks(docs, digest_bytes, bloom), index, "digest", total), "chunks-hits")
    first = (F.col("mark") == F.col("keep_mark")) & (F.col("start") == F.col("keep_start"))
    kept = hits.where(first).groupBy("digest").agg(F.min("body").alias("kept_body"), F.max("n").alias("n"))
    found = salted_lookup(hits.where(~first).drop("n"), kept, "digest", total).where("body = kept_body")
    return found.select("id", "mark", "first_line", "lines", "start", "end", "keep_id", "keep_start", "n")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "first_line", "lines", F.col("start").alias("start_char"), F.col("end").alias("end_char"),
        F.col("keep_id").alias("keep_doc_id"), F.col("keep_start").alias("keep_start_char"), F.col("n").alias("occurrences"),
    )
