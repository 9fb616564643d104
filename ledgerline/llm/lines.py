"""Substring dedup by hashes of lines or paragraphs, and of the sentences within lines.

A passage that stands inside longer lines shares no line with another document; its sentences do.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_mark, salted_lookup, sifted, stash, table

#: Words of the shortest unit that the query removes. Shorter lines repeat by chance: at scale 0.1 half of all documents
#: have a repeated line of any length, a fifth one of ten words. The operator itself leaves none out unless told to.
MIN_WORDS = 10
#: What ends a sentence belongs to it, as do blanks before it.
_SENTENCE = r"[^.!?]*[.!?]+|[^.!?]+"
_SENTENCES = re.compile(_SENTENCE)
_BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[\x20\x09-\x0D]*\n")}


def unit_places(text: str, unit: str = "line"):
    """(number, start, end) of each unit, in code points; the breaks belong to none. A sentence has its line's number."""
    if unit == "sentence":
        for k, start, end in unit_places(text):
            for m in _SENTENCES.finditer(text, start, end):
                yield k, m.start(), m.end()
        return
    start = 0
    for k, m in enumerate(_BREAKS[unit].finditer(text)):
        yield k, start, m.start()
        start = m.end()
    yield text.count("\n") if unit == "line" else len(_BREAKS[unit].findall(text)), start, len(text)


def units(docs: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """(id, mark, unit, start, end, digest) of units with ``min_words`` words or more; ``docs``: (id, text, mark).

    A digest is 128 bits of BLAKE2 over the words, A-Z in lower case, joined by single spaces.
    """
    schema = T.StructType([
        T.StructField("id", docs.schema["id"].dataType), T.StructField("mark", T.BinaryType()), T.StructField("unit", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("digest", T.BinaryType()),
    ])

    def run(batches):
        for batch in batches:
            rows = [], [], [], [], [], []
            for own, text, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, start, end in unit_places(text or "", unit):
                    words = text[start:end].encode().lower().split() if text else []
                    if len(words) >= max(1, min_words):
                        digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                        for column, x in zip(rows, (own, mark, k, start, end, digest), strict=True):
                            column.append(x)
            types = [batch.schema.field(0).type, pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=schema.names)

    return docs.mapInArrow(run, schema)


def repeated(docs: DataFrame, id_col="doc_id", text_col="text", unit: str = "line", min_words: int = 1) -> DataFrame:
    """The units to remove: (id, mark, unit, start, end, keep_id, keep_start, n), offsets in the original text.

    ``mark`` stands for a row's id and text (``row_mark``). Of equal units the first by id, null ids last, then by mark and
    place stays; ``n`` counts all. Digests are grouped with partial aggregation, frequent ones looked up by salted
    keys. Units without a word are none, so null and empty texts have none; a very long text is read whole, line by line;
    rows that repeat id and text share a mark and the places of their units, and both keep or lose them; rows that share an
    id, or a null one, but not a text stand apart; extra columns aren't looked at; an empty table gives no rows.
    """
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = stash(units(docs.select(own.alias("id"), text.alias("text"), row_mark(own, text).alias("mark")), unit, min_words), "lines-units")
    rank = F.struct(F.col("id").isNull().alias("u"), "id", "mark", "start")
    groups = rows.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    keep = F.col("first.id").alias("keep_id"), F.col("first.mark").alias("keep_mark"), F.col("first.start").alias("keep_start")
    index = stash(groups.select("digest", "n", *keep), "lines-index")
    found = salted_lookup(rows, index, "digest", rows.count())
    first = (F.col("mark") == F.col("keep_mark")) & (F.col("start") == F.col("keep_start"))
    return found.where(~first).select("id", "mark", "unit", "start", "end", "keep_id", "keep_start", "n")


def passages(docs: DataFrame, id_col="doc_id", text_col="text", min_words: int = 1) -> DataFrame:
    """Repeated lines, and repeated sentences of other lines: columns of ``repeated`` and ``kind``.

    Edge cases as in ``repeated``. The first place of a sentence is never in a line that goes: that
    line's own first place would come before it. So of every unit one copy stays.
    """
    whole = stash(repeated(docs, id_col, text_col, "line", min_words), "lines-repeated")
    gone = whole.select("mark", "unit").distinct()
    inside = repeated(docs, id_col, text_col, "sentence", min_words).join(gone, ["mark", "unit"], "left_anti")
    return whole.withColumn("kind", F.lit("line")).unionByName(inside.withColumn("kind", F.lit("sentence")), allowMissingColumns=True)


def without(docs: DataFrame, spans: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs``' rows and columns, the spans (mark, start, end; in code points) cut out of their texts; line breaks stay.

    A span belongs to the rows of its mark, so to one id and one text: null ids, ids with several texts and texts
    under several ids keep apart. Rows that repeat id and text lose the same. Rows without a span pass without
    a shuffle but for chance hits of a filter; the spans of a mark, at most its text's units, meet in one row. Null texts
    stay null; an empty table gives none; columns of any name pass through.
    """
    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if text is not None and own:
                at, parts = 0, []
                for s in sorted(own, key=lambda s: s["start"]):
                    parts.append(text[at : s["start"]])
                    at = max(at, s["end"])
                text = "".join(parts) + text[at:]
            out.append(text)
        return pa.array(out, pa.string())

    groups = spans.groupBy("mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.count(F.lit(1)).alias("c"))
    groups = stash(groups.select("mark", "spans", F.ceil(F.col("c") / F.size("spans")).alias("n")), "lines-cuts")
    passed, looked = sifted(docs, row_mark(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), groups)
    some = salted_lookup(looked, groups, "mark", docs.count(), "left")
    texts = [cut(F.col(f"row.`{c}`"), F.col("spans")).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    return passed.select("row.*").unionByName(some.select(*texts))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated line and sentence of ``MIN_WORDS`` words or more; edge cases as in ``passages``."""
    return passages(table(spark, sf_dir, "documents"), min_words=MIN_WORDS).select(
        F.col("id").alias("doc_id"), "kind", F.col("unit").alias("line"), F.col("start").alias("start_char"), F.col("end").alias("end_char"),
        F.col("keep_id").alias("keep_doc_id"), F.col("keep_start").alias("keep_start_char"), F.col("n").alias("occurrences"),
    )


def substring_dedup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with every repeated line, of however few words, removed: (doc_id, text)."""
    docs = table(spark, sf_dir, "documents")
    return without(docs, repeated(docs)).select("doc_id", "text")


ORACLE_SQL = rf"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(parts) AS body, unnest(range(len(parts))) AS line FROM s),
p AS (
  SELECT *, coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         regexp_extract_all(body, '{_SENTENCE}') AS own FROM l),
q AS (SELECT doc_id, line, start AS line_start, unnest(own) AS body, unnest(range(len(own))) AS place FROM p),
u AS (
  SELECT doc_id, 'line' AS kind, line, start, body FROM p
  UNION ALL
  SELECT doc_id, 'sentence', line, line_start + coalesce(sum(length(body)) OVER (PARTITION BY doc_id, line ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT, body FROM q),
n AS (SELECT *, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM u),
k AS (
  SELECT *, first_value(doc_id) OVER o AS keep_doc_id, first_value(start) OVER o AS keep_start_char, count(*) OVER (PARTITION BY kind, words) AS occurrences
  FROM n WHERE len(words) >= {MIN_WORDS} WINDOW o AS (PARTITION BY kind, words ORDER BY doc_id, start)),
r AS (SELECT * FROM k WHERE NOT (doc_id = keep_doc_id AND start = keep_start_char))
SELECT doc_id, kind, line::BIGINT AS line, start AS start_char, (start + length(body))::BIGINT AS end_char, keep_doc_id, keep_start_char, occurrences::BIGINT AS occurrences
FROM r WHERE kind = 'line' OR (doc_id, line) NOT IN (SELECT (doc_id, line) FROM r WHERE kind = 'line')
"""

TEXTS_SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(parts) AS body, unnest(range(len(parts))) AS line FROM s),
n AS (SELECT *, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY words ORDER BY doc_id, line) AS place FROM n)
SELECT doc_id, text FROM documents WHERE text IS NULL
UNION ALL
SELECT doc_id, string_agg(CASE WHEN place = 1 OR len(words) = 0 THEN body ELSE '' END, chr(10) ORDER BY line) AS text FROM k GROUP BY doc_id
"""
