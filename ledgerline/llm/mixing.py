"""Mixing sources to target weights, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, bucket_shift, hash60, stash, table

WORDS_KEPT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Sorts by code point, null last, and is never null itself."""
    return F.when(source.isNull(), "2").otherwise(F.concat(F.lit("1"), source.cast("string")))


def targets(sources: DataFrame, weights=(1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """``sources``: (src, source_size), one row a source. Adds ``target``.

    Weights repeat over the sources in order of ``src``. Water filling: in order of
    limit per weight, a source is held at its limit while what would be left for it
    by weight exceeds that limit; the first that isn't fixes the level for the rest.
    The windows see one row a source, so their single task is as long as that list.
    """
    by_key = Window.orderBy("src")
    before = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = (
        sources.withColumn("n", F.row_number().over(by_key) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("n", F.lit(len(weights))) + 1).cast("int")))
        .withColumn("limit", F.col("source_size") * F.lit(most))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("held", F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("held_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("held")) / (F.col("weights") - F.col("held_weight")))
        .withColumn("first", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(every))
    )
    target = F.when(
        F.col("first").isNull() | (F.struct("ratio", "src") < F.struct("first.ratio", "first.src")), F.col("limit").cast("double")
    ).otherwise(F.least(F.col("limit").cast("double"), F.col("first.level") * F.col("weight")))
    return rows.select("src", "source_size", target.alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    own, size = F.col(f"`{id_col}`"), words(F.col(f"`{text_col}`"))
    return docs.select(
        own.alias("id"), _source_key(F.col(f"`{source_col}`")).alias("src"), size.alias("size"), hash60(F.lit("mix"), own, size).alias("key")
    )


def cuts(sized: DataFrame, **how) -> DataFrame:
    """Where each source is cut: one row a source.

    Documents are ordered by a hash-random key. Keys fall into ranges; a source's
    range totals are a partial aggregation, their running sums the distributed prefix
    sums. Only the range in which a source's budget ends is sorted by row, so a source
    with a third of all rows costs no more than any other. Columns: src, source_size,
    target, epochs (whole repeats of every document), cut_key/cut_id (documents before
    it are taken once more), part (words taken of those at it) and full: what is left of the
    target rounds up to the whole source, so no document holds the cut and all are taken once more.
    """
    shift = bucket_shift(sized.count())
    ranged = sized.withColumn("bucket", F.shiftright("key", shift))
    totals = ranged.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    sources = targets(totals.groupBy("src").agg(F.sum("words").alias("source_size")), **how)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("epochs", epochs).withColumn(
        "rest", F.when(F.col("source_size") > 0, F.round(F.col("target") - F.col("epochs") * F.col("source_size"))).otherwise(0).cast("long")
    )
    run = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = (
        totals.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        .join(sources.select("src", "rest"), "src")
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select("src", "bucket", "before", "rest")
    )
    inner = Window.partitionBy("src", "bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        ranged.join(at, ["src", "bucket"])
        .groupBy("src", "bucket", "before", "rest", "key", "id", "size").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("start", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(inner), F.lit(0)))
        .where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("size") * F.col("rows")))
        .select("src", F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), F.floor((F.col("rest") - F.col("start")) / F.col("rows")).cast("long").alias("part"))
    )
    full = (F.col("source_size") > 0) & (F.col("rest") >= F.col("source_size"))
    return sources.withColumn("full", full).drop("rest").join(cut, "src", "left")


def _decide(sized: DataFrame, cut: DataFrame) -> DataFrame:
    """Adds what ``cut`` says; the table of cuts has a row a source, and Spark broadcasts it if it is small."""
    here, there = F.struct("key", "id"), F.struct(F.col("cut_key"), F.col("cut_id"))
    more = (
        F.when(F.col("full"), F.col("size"))
        .when(F.col("cut_key").isNull(), 0)
        .when(here < there, F.col("size"))
        .when((F.col("key") == F.col("cut_key")) & F.col("id").eqNullSafe(F.col("cut_id")), F.least("part", "size"))
        .otherwise(0)
    )
    return sized.join(cut, "src").withColumn("more", more.cast("long")).drop("full").withColumn("taken", F.col("epochs") * F.col("size") + F.col("more"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **how) -> DataFrame:
    """What the mix takes of each document: (id, src, size, source_size, target, epochs, more, taken).

    Null texts have size 0 and are taken 0 times; a null source is a source of its own,
    the last; repeated rows count each, and if the cut falls on them they share its words
    evenly; extra columns aren't looked at; an empty table gives no rows.
    """
    sized = stash(_sized(docs, id_col, text_col, source_col), "mix-sized")
    return _decide(sized, stash(cuts(sized, **how), "mix-cuts"))


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", chars_col="n_chars", **how) -> DataFrame:
    """The mix itself: ``docs``' rows and columns, each row as often as it is taken, the last
    time cut behind the words that still fit (``chars_col``, if there, follows).

    Null and empty texts have no words and are never taken; a null source is a source of its own; repeated rows
    are taken alike; very long texts are cut at a word like others; columns of any name pass through; an empty
    table gives no rows.
    """
    cut = stash(cuts(stash(_sized(docs, id_col, text_col, source_col), "mix-sized"), **how), "mix-cuts")
    text = F.col(f"row.`{text_col}`")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = whole.select(
        "row", F.col(f"row.`{id_col}`").alias("id"), _source_key(F.col(f"row.`{source_col}`")).alias("src"), words(text).alias("size")
    ).withColumn("key", hash60(F.lit("mix"), F.col("id"), F.col("size")))
    copies = F.col("epochs") + (F.col("more") > 0).cast("long")
    out = _decide(whole, cut).where(copies > 0).select("row", "size", "epochs", "more", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    partial = (F.col("copy") > F.col("epochs")) & (F.col("more") < F.col("size"))
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORDS_KEPT), F.lit(0)), F.lit(1), F.col("more").cast("int")), "")
    out, cols = out.select("row", F.when(partial, head).alias("head")), []
    for c in docs.columns:
        own = F.col(f"row.`{c}`")
        if c == text_col:
            own = F.coalesce("head", own)
        elif c == chars_col:
            own = F.when(F.col("head").isNotNull(), F.length("head")).otherwise(own).cast(docs.schema[c].dataType)
        cols.append(own.alias(c))
    return out.select(*cols)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "epochs"
    )


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
keyed AS (SELECT *, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '~') || ':' || size::VARCHAR), 1, 15))::BIGINT AS key FROM sized),
sources AS (SELECT src, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::DOUBLE AS weight FROM sized GROUP BY src),
ranked AS (
  SELECT *, source_size * 3 AS lim, source_size * 3 / weight AS ratio, (sum(source_size) OVER ())::DOUBLE AS budget, sum(weight) OVER () AS weights,
         coalesce(sum(source_size * 3) OVER before, 0) AS held, coalesce(sum(weight) OVER before, 0) AS held_weight
  FROM sources WINDOW before AS (ORDER BY source_size * 3 / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (budget - held) / (weights - held_weight) AS level FROM ranked),
first AS (SELECT ratio AS r, src AS s, level AS l FROM levels WHERE level <= ratio ORDER BY ratio, src LIMIT 1),
target AS (
  SELECT src, source_size, CASE WHEN l IS NULL OR (ratio, src) < (r, s) THEN lim::DOUBLE ELSE least(lim::DOUBLE, l * weight) END AS target
  FROM levels LEFT JOIN first ON true),
epoch AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM target),
run AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
         round(e.target - e.epochs * e.source_size)::BIGINT AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.src ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM keyed k JOIN epoch e USING (src))
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken, epochs::BIGINT AS epochs FROM run
"""
