"""License scans by diagonal voting, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_mark, salted_lookup, stash, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: all of ASCII but letters and digits.
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())

# Wordings of public licenses. Phrases that count wherever all their words stand consecutively, and their labels.
BASE = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]
# Wordings that may be edited: (words, label, family). A copy must have the words with a star; of copies that
# overlap within a family the best counts.
TEMPLATES = [
    ("licensed under the *apache license version *2 0", "apache-2.0", "apache"),
    (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www *apache org licenses"
        " license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
        " without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions"
        " and limitations under the license", "apache-2.0", "apache",
    ),
    ("released under the *mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", "mit"),
    (
        "permission is hereby granted free of charge to any person or *organization obtaining a copy of the software and accompanying documentation"
        " covered by this license", "bsl-1.0", "mit",
    ),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
        " and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"
        " fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages"
        " or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software"
        " or the use or other dealings in the software", "mit", "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies", "isc", "isc",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "bsd"),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
        " from this software without specific prior written permission", "bsd-3-clause", "bsd-3-clause",
    ),
    ("licensed under the gnu *lesser general public license version 3", "lgpl", "gnu"),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu *lesser general public license"
        " as published by the free software foundation", "lgpl", "gnu",
    ),
    ("licensed under the gnu *affero general public license version 3", "agpl-3.0", "gnu"),
    ("licensed under the gnu general public license version *3", "gpl-3.0", "gnu"),
    ("licensed under the gnu general public license version *2", "gpl-2.0", "gnu"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation either version *3 of the license or at your option any later version", "gpl-3.0", "gnu",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation either version *2 of the license or at your option any later version", "gpl-2.0", "gnu",
    ),
    ("subject to the terms of the *mozilla public license version *2 0", "mpl-2.0", "mpl"),
    ("licensed under cc by *nc 4 0", "cc-by-nc", "cc"),
    ("licensed under cc by *sa 4 0", "cc-by-sa", "cc"),
    ("licensed under cc by *nd 4 0", "cc-by-nd", "cc"),
    ("licensed under cc by *nc *sa 4 0", "cc-by-nc-sa", "cc"),
    ("licensed under cc by *nc *nd 4 0", "cc-by-nc-nd", "cc"),
    ("licensed under a creative commons attribution *noncommercial 4 0 international license", "cc-by-nc", "cc"),
    ("licensed under a creative commons attribution *sharealike 4 0 international license", "cc-by-sa", "cc"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unlicense"),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable"
        " for any damages arising from the use of this software", "zlib", "zlib",
    ),
]
#: Diagonals at most this far apart may belong to one edited copy of a template.
NEAR = 2
#: Share of a template's word pairs that such a copy must have, in order.
COVERAGE = 0.75
#: Word pairs of all templates together: they are known to every executor.
MOST_PAIRS = 100_000


def _rows(base, templates) -> tuple[list[str], list[str]]:
    """SQL rows (t, tpos, t1, t2) of the templates' word pairs, and (t, pairs, label, base, family, needs) of the templates."""
    pairs, each = [], []
    for t, (phrase, label, family) in enumerate([*((p, label, "") for p, label in base), *templates]):
        starred = phrase.split(" ")
        words = [w.lstrip("*") for w in starred]
        if len(words) < 2:
            raise ValueError(f"a template has two words or more: {phrase}")
        pairs += [f"({t}, {i}, '{a}', '{b}')" for i, (a, b) in enumerate(zip(words, words[1:]))]
        needs = ", ".join(str(i) for i, w in enumerate(starred) if w[0] == "*")
        each.append((t, len(words) - 1, label, t < len(base), family, needs))
    if len(pairs) > MOST_PAIRS:
        raise ValueError(f"templates have {len(pairs)} word pairs; {MOST_PAIRS} at most")
    return pairs, [f"({t}, {n}, '{label}', {str(own).lower()}, '{family}', {{}})".format(f"[{needs}]") for t, n, label, own, family, needs in each]


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case; one pass for the folding, one for the cuts."""
    return F.array_remove(F.split(F.translate(text, UPPER + GAPS, LOWER + " " * len(GAPS)), " "), "")


def _in_order(votes: Column) -> Column:
    """How many of the template's pairs a copy has in order: the longest run of ``votes`` (pos, tpos), in any order, that rises in both."""
    by_place = F.sort_array(F.transform(votes, lambda v: F.struct(v["pos"].alias("pos"), (-v["tpos"]).alias("down"))))

    def put(ends, vote):  # the smallest end of a run of each length
        below = F.size(F.filter(ends, lambda e: e < -vote["down"]))
        return F.concat(F.slice(ends, F.lit(1), below), F.array(-vote["down"]), F.slice(ends, below + 2, F.size(ends)))

    return F.aggregate(by_place, F.array().cast("array<int>"), put, F.size)


def _hits(docs: DataFrame, grams: list[int]) -> DataFrame:
    """One scan of ``docs`` (id, text, mark): (id, mark, n_words, hits), the rolling word pairs (pos, w1, w2) whose hash some template has."""
    own = F.col("words")
    split = docs.select("id", "mark", words(F.coalesce("text", F.lit(""))).alias("words"))
    pair = lambda i: F.xxhash64(F.get(own, i), F.get(own, i + 1))
    at = F.when(F.size(own) > 1, F.filter(F.sequence(F.lit(0), F.size(own) - 2), lambda i: pair(i).isin(grams))).otherwise(F.array().cast("array<int>"))
    hits = F.transform("at", lambda i: F.struct(i.alias("pos"), F.get(own, i).alias("w1"), F.get(own, i + 1).alias("w2")))
    return split.withColumn("at", at).select("id", "mark", F.size(own).cast("long").alias("n_words"), hits.alias("hits"))


def spans(hits: DataFrame, base=BASE, templates=TEMPLATES, near: int = NEAR, coverage: float = COVERAGE) -> DataFrame:
    """Found license passages: (mark, t, label, base, start, end, share), ``end`` exclusive, in words.

    ``hits``: (mark, hits). Every rolling word pair is joined by its hash to the templates' pairs (constants, at most
    ``MOST_PAIRS``, so broadcast), its words compared. A pair votes for the diagonal position minus template position; rows
    that repeat add nothing. Base phrases need all pairs of one diagonal. Of other templates diagonals up to ``near``
    apart merge; a span is verified by the pairs that it has in the template's order, ``coverage`` of all, and by the
    template's starred words, within one and a half times its length. A wider cluster gives a span of that length from
    each of its diagonals. Of spans that overlap within a family only the best and those of its label count.
    """
    spark = hits.sparkSession
    pairs, each = _rows(base, templates)
    pairs = spark.sql(f"SELECT *, xxhash64(t1, t2) AS gram FROM VALUES {', '.join(pairs)} AS v(t, tpos, t1, t2)")
    needed = ", ".join(each).replace("[", "CAST(array(").replace("]", ") AS array<int>)")
    each = spark.sql(f"SELECT * FROM VALUES {needed} AS v(t, pairs, label, base, family, needs)")
    exploded = hits.where(F.size("hits") > 0).select("mark", F.explode("hits").alias("hit")).select("mark", "hit.*")
    votes = (
        exploded.withColumn("gram", F.xxhash64("w1", "w2")).join(F.broadcast(pairs), "gram").where("w1 = t1 AND w2 = t2")
        .groupBy("mark", "t", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("places"))
        .join(F.broadcast(each), "t")
    )
    whole = votes.where("base AND size(places) = pairs").select("mark", "t", "label", "base", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("pairs") + 1).alias("end"), F.lit(1.0).alias("share"))

    order = Window.partitionBy("mark", "t").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(near + 1)) > near
    own, width = Window.partitionBy("mark", "t", "cluster"), F.floor(F.col("pairs") / 2).cast("int")
    froms = F.when(F.col("wide"), F.sequence(F.col("diagonal") - width, F.col("diagonal"))).otherwise(F.array(F.lit(None).cast("int")))
    placed = F.transform("places", lambda p: F.struct((p + F.col("diagonal")).alias("pos"), p.alias("tpos")))
    merged = (
        votes.where("NOT base").withColumn("cluster", F.sum(apart.cast("int")).over(order))
        .withColumn("wide", F.max("diagonal").over(own) - F.min("diagonal").over(own) > width)
        .withColumn("from", F.explode(froms))
        .groupBy("mark", "t", "cluster", "from")
        .agg(F.flatten(F.collect_list(placed)).alias("votes"), F.min("diagonal").alias("start"), F.max("diagonal").alias("last"))
        .where("from IS NULL OR from = start").join(F.broadcast(each), "t")
        .withColumn("seen", F.array_distinct(F.transform("votes", lambda v: v["tpos"])))
        .where(F.size("seen") >= F.lit(coverage) * F.col("pairs"))
        .where(F.forall("needs", lambda n: F.exists("seen", lambda s: (s == n) | (s == n - 1))))
        .withColumn("share", _in_order(F.col("votes")) / F.col("pairs")).where(F.col("share") >= coverage)
        .select("mark", "t", "label", "base", "family", F.greatest("start", F.lit(0)).alias("start"), (F.col("last") + F.col("pairs") + 1).alias("end"), "share", "pairs")
    )
    by_start = Window.partitionBy("mark", "family").orderBy("start", "end", "t")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    rank = F.struct("share", "pairs", (-F.col("start")).alias("s"), (-F.col("t")).alias("o"), "label", F.col("start").alias("lo"), F.col("end").alias("hi"))
    groups = merged.withColumn("new", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("int")).withColumn("group", F.sum("new").over(by_start))
    best = groups.withColumn("best", F.max(rank).over(Window.partitionBy("mark", "family", "group")))
    stays = (F.col("label") == F.col("best.label")) | (F.col("end") <= F.col("best.lo")) | (F.col("start") >= F.col("best.hi"))
    return whole.unionByName(best.where(stays).select("mark", "t", "label", "base", "start", "end", "share"))


def scan(docs: DataFrame, id_col="doc_id", text_col="text", base=BASE, templates=TEMPLATES, **how) -> DataFrame:
    """One row for each row of ``docs``: (id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``score`` is the largest share of a template's pairs that a found passage has in order, 1 for a base phrase, 0 for
    none. Texts are split once; rows without a template's word pair meet no shuffle. Null and empty texts have no words;
    very long ones are scanned whole; rows that repeat id and text get the same answer; null ids are ids; an empty table
    gives no rows; extra columns aren't looked at.
    """
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    pairs = ", ".join(_rows(base, templates)[0])
    grams = [r[0] for r in docs.sparkSession.sql(f"SELECT DISTINCT xxhash64(t1, t2) FROM VALUES {pairs} AS v(t, tpos, t1, t2)").collect()]
    rows = stash(_hits(docs.select(own.alias("id"), text.alias("text"), row_mark(own, text).alias("mark")), grams), "licenses-hits")
    some = rows.where(F.size("hits") > 0)
    label = lambda only: F.array_join(F.sort_array(F.collect_set(F.when(only, F.col("label")))), ",")
    found = spans(rows, base, templates, **how).groupBy("mark").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"), label(F.col("base")).alias("base_labels"), label(F.lit(True)).alias("labels"),
        F.max("share").alias("score"),
    )
    index = some.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).join(found, "mark")
    scanned = salted_lookup(some.select("id", "mark", "n_words"), index, "mark", rows.count(), "left")
    out = rows.where(F.size("hits") == 0).select("id", "n_words").unionByName(scanned, allowMissingColumns=True)
    return out.select(
        "id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"), F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license wording; edge cases as in ``scan``."""
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _base_sql() -> str:
    """Base phrases straight from the words, without pairs or votes: (doc_id, label, start)."""
    one = "SELECT doc_id, '{label}' AS label, unnest(list_filter(range(len(words)), lambda i: words[i + 1 : i + {n}] = {phrase})) AS start FROM w"
    return " UNION ALL ".join(one.format(label=label, n=len(p.split()), phrase=p.split()) for p, label in BASE)


ORACLE_SQL = rf"""
WITH v(t, tpos, t1, t2) AS (VALUES {", ".join(_rows(BASE, TEMPLATES)[0])}),
e(t, pairs, label, base, family, needs) AS (VALUES {", ".join(_rows(BASE, TEMPLATES)[1])}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS ({_base_sql()}),
p AS (SELECT doc_id, unnest(words[:-2]) AS w1, unnest(words[2:]) AS w2, unnest(range(len(words) - 1)) AS pos FROM w WHERE len(words) > 1),
votes AS (SELECT DISTINCT doc_id, t, pos, tpos, pos - tpos AS diagonal, pairs FROM p JOIN v ON w1 = t1 AND w2 = t2 JOIN e USING (t) WHERE NOT base),
lines AS (SELECT DISTINCT doc_id, t, diagonal, pairs FROM votes),
marks AS (SELECT *, CASE WHEN coalesce(diagonal - lag(diagonal) OVER o, {NEAR + 1}) > {NEAR} THEN 1 ELSE 0 END AS apart FROM lines WINDOW o AS (PARTITION BY doc_id, t ORDER BY diagonal)),
clusters AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS cluster FROM marks),
sized AS (SELECT *, max(diagonal) OVER c - min(diagonal) OVER c > pairs // 2 AS wide, min(diagonal) OVER c AS low FROM clusters WINDOW c AS (PARTITION BY doc_id, t, cluster)),
froms AS (SELECT a.doc_id, a.t, a.cluster, a.pairs, a.diagonal AS low, a.diagonal + CASE WHEN wide THEN a.pairs // 2 ELSE 1000000000 END AS high FROM sized a WHERE wide OR diagonal = low),
merged AS (
  SELECT f.doc_id, f.t, f.cluster, f.low, f.pairs, max(s.diagonal) AS last, list(DISTINCT x.tpos) AS seen, list([x.tpos] ORDER BY x.pos, x.tpos DESC) AS steps
  FROM froms f JOIN sized s ON s.doc_id = f.doc_id AND s.t = f.t AND s.cluster = f.cluster AND s.diagonal BETWEEN f.low AND f.high
  JOIN votes x ON x.doc_id = s.doc_id AND x.t = s.t AND x.diagonal = s.diagonal GROUP BY ALL),
judged AS (
  SELECT m.doc_id, m.t, label, family, greatest(low, 0) AS start, last + m.pairs + 1 AS "end", m.pairs,
         len(list_reduce(steps, lambda ends, x: ends[: len(list_filter(ends, lambda q: q < x[1]))] || x || ends[len(list_filter(ends, lambda q: q < x[1])) + 2 :])) / m.pairs AS share
  FROM merged m JOIN e USING (t)
  WHERE len(seen) >= {COVERAGE} * m.pairs AND len(list_filter(needs, lambda n: list_contains(seen, n) OR list_contains(seen, n - 1))) = len(needs)),
good AS (SELECT * FROM judged WHERE share >= {COVERAGE}),
parted AS (SELECT *, CASE WHEN coalesce(max("end") OVER (PARTITION BY doc_id, family ORDER BY start, "end", t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) <= start THEN 1 ELSE 0 END AS new FROM good),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, family ORDER BY start, "end", t) AS grp FROM parted),
best AS (
  SELECT *, first_value(label) OVER g AS best_label, first_value(start) OVER g AS lo, first_value("end") OVER g AS hi
  FROM grouped WINDOW g AS (PARTITION BY doc_id, family, grp ORDER BY share DESC, pairs DESC, start, t)),
found AS (
  SELECT doc_id, label, true AS base, start, 1.0::DOUBLE AS share FROM b
  UNION ALL SELECT doc_id, label, false, start, share FROM best WHERE label = best_label OR "end" <= lo OR start >= hi),
by_doc AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
  FROM found GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN by_doc USING (doc_id)
"""
