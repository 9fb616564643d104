"""Benchmark decontamination by greedy string tiling.

Texts and items meet in a join of the hashes of short runs of words, the seeds; only pairs that share
a seed which a match can't do without are tiled. Neither side is ever held whole: the executors get a filter
of the items' seeds, 64 MB at most whatever the benchmark, and a task holds one text and one item at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bloom_has, bloom_of, long_rows, row_mark, salted_lookup, shingles, sifted, stash, table, word_hashes

#: Words of the shortest tile, and the share of an item's words that tiles must cover.
TILE, COVERAGE = 5, 0.5
#: Tasks that the items of one text are dealt over at most: a text travels once to each that has an item for it.
DEALS = 64
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Primes and bases of the Karp-Rabin fingerprints.
_RINGS = ((2_147_483_647, 1_000_003), (2_147_483_629, 998_244_353))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case."""
    return (text or "").encode().translate(_FOLD).split()


def _powers(n: int, base: int, prime: int) -> np.ndarray:
    out, step = np.ones(1, np.uint64), base
    while len(out) < n:
        out, step = np.append(out, out * np.uint64(step) % np.uint64(prime)), step * step % prime
    return out[:n]


class Prints:
    """Karp-Rabin fingerprints of the runs of any length of a sequence of numbers, from prefix sums."""

    def __init__(self, numbers: np.ndarray, shift: int = 0):
        self.sums, numbers = [], numbers.astype(np.uint64)
        for prime, base in _RINGS:
            base += 2 * shift
            sums = np.append(np.uint64(0), np.cumsum(numbers * _powers(len(numbers), base, prime) % np.uint64(prime))) % np.uint64(prime)
            self.sums.append((sums, _powers(len(numbers) + 1, pow(base, -1, prime), prime), np.uint64(prime)))

    def of(self, length: int) -> np.ndarray:
        out = np.zeros(max(0, len(self.sums[0][0]) - length), np.uint64)
        for sums, back, prime in self.sums:
            out = out << np.uint64(32) | (sums[length:] + prime - sums[:-length]) % prime * back[: len(out)] % prime
        return out


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Where runs of ``length`` without a marked word start."""
    before = np.append(0, np.cumsum(marked))
    return np.flatnonzero(before[length:] == before[:-length]) if len(marked) >= length else np.zeros(0, np.int64)


def tile(doc: np.ndarray, item: np.ndarray, length: int, shift: int = 0) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of numbers; 0 equals nothing. (position in doc, in item, words).

    Of the matches between unmarked words the longest is marked, ties by place in the item, then in the document,
    until none has ``length`` words. Fingerprints of all unmarked runs tell whether a length has a match, halving the
    lengths left; all matches of the longest are marked in one go. Memory is in proportion to both
    sequences, never to their matches.
    """
    marks, prints, tiles = (doc == 0, item == 0), (Prints(doc, shift), Prints(item, shift)), []

    def runs(size):
        at = [_free(m, size) for m in marks]
        return [(p, own.of(size)[p]) for p, own in zip(at, prints, strict=True)]

    def met(size):
        (_, a), (_, b) = runs(size)
        return len(a) > 0 and len(b) > 0 and bool(np.isin(b, a).any())

    most = min(len(doc), len(item))
    while most >= length and met(length):
        low, high = length, most  # the longest match is between them
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if met(middle) else (low, middle - 1)
        (at, own), (places, wanted) = runs(low)
        order = np.argsort(own, kind="stable")
        at, own = at[order], own[order]
        first, last = np.searchsorted(own, wanted, "left"), np.searchsorted(own, wanted, "right")
        left: dict[int, int] = {}  # of each run of the document, where its next unmarked place may be
        end = low - 1
        for k in np.flatnonzero(last > first).tolist():
            b = int(places[k])
            if marks[1][b] or marks[1][b + end]:  # what was marked since has the same length
                continue
            s = left.get(first[k], int(first[k]))
            while s < last[k] and (marks[0][at[s]] or marks[0][at[s] + end]):
                s += 1
            left[first[k]] = s
            if s < last[k]:
                a = int(at[s])
                if not np.array_equal(doc[a : a + low], item[b : b + low]):
                    return tile(doc, item, length, shift + 1)  # two runs share a fingerprint: take another base
                tiles.append((a, b, low))
                marks[0][a : a + low] = marks[1][b : b + low] = True
        most = low - 1
    return tiles


class Text:
    """A text's words as numbers, and the places of its runs of seed length."""

    def __init__(self, own: list[bytes]):
        self.number: dict[bytes, int] = {}
        self.ids = np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in own), np.int64, len(own))
        self.prints, self.sorted = Prints(self.ids), {}

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        if length not in self.sorted:
            marks = self.prints.of(length)
            order = np.argsort(marks, kind="stable")
            self.sorted[length] = marks[order], order
        return self.sorted[length]

    def match(self, item: list[bytes], tile_words: int = TILE, coverage: float = COVERAGE) -> tuple[int, int, int] | None:
        """(words covered, tiles, words of the longest) if tiles cover the item to ``coverage``."""
        n, length = len(item), min(tile_words, len(item))
        if not n or len(self.ids) < length:
            return None
        ids = np.fromiter((self.number.get(w, 0) for w in item), np.int64, n)
        at = _free(ids == 0, length)
        marks, order = self.runs(length)
        wanted = Prints(ids).of(length)[at]
        first, last = np.searchsorted(marks, wanted, "left"), np.searchsorted(marks, wanted, "right")
        at, first, last = (x[last > first] for x in (at, first, last))
        reach = _covered(at, length, n)
        if not len(at) or reach.sum() < coverage * n:
            return None  # tiles lie within seeds
        found, once = np.unique(first, return_index=True)
        places = [order[lo:hi] for lo, hi in zip(found, last[once], strict=True)]
        near = _covered(np.concatenate(places), length, len(self.ids))
        keep = np.flatnonzero(near)
        gaps = np.flatnonzero(np.diff(keep) > 1) + 1
        tiles = tile(np.insert(self.ids[keep], gaps, 0), np.where(reach, ids, 0), length)  # the rest of the text has no seed
        covered = sum(t[2] for t in tiles)
        return (covered, len(tiles), tiles[0][2]) if tiles and covered >= coverage * n else None


def _covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[:n] > 0


def _digest(own: list[bytes]) -> tuple[bytes, bytes]:
    body = b" ".join(own)
    return hashlib.blake2b(body, digest_size=16).digest(), body


def _batch(schema, rows):
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _items(benchmark: DataFrame, tile_words: int) -> tuple[DataFrame, DataFrame]:
    """Items of equal words are one: (item, item_id, items, item_words, body); and their seeds: (item, pos, h)."""
    fields = [T.StructField("kind", T.IntegerType()), T.StructField("item", T.BinaryType()), T.StructField("id", benchmark.schema["id"].dataType)]
    fields += [T.StructField(n, t) for n, t in (("size", T.IntegerType()), ("body", T.BinaryType()), ("pos", T.IntegerType()), ("h", T.LongType()))]

    def run(batches):
        for batch in batches:
            schema = pa.schema([("kind", pa.int32()), ("item", pa.binary()), ("id", batch.schema.field(0).type), ("size", pa.int32()), ("body", pa.binary()), ("pos", pa.int32()), ("h", pa.int64())])
            for own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if item := words(text):
                    digest, body = _digest(item)
                    (hashes, _), = word_hashes([body])
                    seeds = shingles(hashes, min(tile_words, len(item))).view(np.int64).tolist()
                    yield _batch(schema, [(1, digest, own, len(item), body, None, None)])
                    for lo in range(0, len(seeds), 50_000):
                        yield _batch(schema, [(0, digest, None, len(item), None, lo + k, h) for k, h in enumerate(seeds[lo : lo + 50_000])])

    both = stash(benchmark.mapInArrow(run, T.StructType(fields)), "tiling-items", ("kind",))
    least = F.min(F.struct(F.col("id").isNull().alias("u"), "id"))
    items = both.where("kind = 1").groupBy("item").agg(least.alias("least"), F.count(F.lit(1)).alias("items"), F.max("size").alias("item_words"), F.min("body").alias("body"))
    seeds = both.where("kind = 0").select("item", "size", "pos", "h").distinct()
    return stash(items.select("item", F.col("least.id").alias("item_id"), "items", "item_words", "body"), "tiling-item"), stash(seeds, "tiling-seeds")


def _keys(seeds: DataFrame, tile_words: int, coverage: float) -> DataFrame:
    """(h, item): the seeds of which a text that covers an item must have one.

    Of each item's seeds those that most items share are left out, as long as all that are left out cover too few
    words for a match: what openings and instructions are common to many items brings no text and item together.
    """
    counts = seeds.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    whole = seeds.join(counts, "h").groupBy("item").agg(F.max("size").alias("size"), F.collect_list(F.struct("n", "pos", "h")).alias("seeds"))

    def run(batches):
        schema = pa.schema([("h", pa.int64()), ("item", pa.binary())])
        for batch in batches:
            for item, size, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                length, seen, covered, out = min(tile_words, size), np.zeros(size, bool), 0, set()
                for seed in sorted(own, key=lambda s: (-s["n"], s["pos"])):
                    at = seen[seed["pos"] : seed["pos"] + length]
                    more = length - int(at.sum())
                    if out or covered + more >= coverage * size:
                        out.add(seed["h"])
                    else:
                        covered += more
                        at[:] = True
                yield _batch(schema, [(h, item) for h in sorted(out)])

    return stash(whole.mapInArrow(run, "h long, item binary"), "tiling-keys")


def _meet(docs: DataFrame, keys: DataFrame, lengths: list[int]) -> DataFrame:
    """One scan of the texts, (id, text, mark): of those that a filter says have a key, kind 0 (text, h) the keys, kind 1
    (text, body) their words, kind 2 (text, id, mark) their rows. ``text`` stands for a text's words: copies are one."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom_of(keys, "h", keys.count(), 8))
    fields = [T.StructField(n, t) for n, t in (("kind", T.IntegerType()), ("text", T.BinaryType()), ("id", docs.schema["id"].dataType), ("mark", T.BinaryType()), ("h", T.LongType()), ("body", T.BinaryType()))]

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor().compress
        bits, whole = shared.value[0], np.frombuffer(shared.value[1], np.uint8)
        told = set()
        for batch in batches:
            schema = pa.schema([("kind", pa.int32()), ("text", pa.binary()), ("id", batch.schema.field(0).type), ("mark", pa.binary()), ("h", pa.int64()), ("body", pa.binary())])
            folded = [(t or b"").translate(_FOLD) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            ids, marks, row, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), 0, []
            for hashes, bounds in word_hashes(folded):
                found = []
                for length in lengths:
                    seeds = shingles(hashes, length)
                    at = np.flatnonzero(bloom_has(whole, bits, long_rows(seeds)))
                    text = np.searchsorted(bounds, at, "right") - 1
                    inside = at + length <= np.asarray(bounds)[text + 1]
                    found.append((text[inside], seeds[at[inside]]))
                text, seeds = (np.concatenate(x) for x in zip(*found, strict=True))
                for t in np.unique(text).tolist():
                    digest, body = _digest(folded[row + t].split())
                    out.append((2, digest, ids[row + t], marks[row + t], None, None))
                    if digest not in told:
                        if len(told) >= 65_536:
                            told.clear()
                        told.add(digest)
                        out.append((1, digest, None, None, None, pack(body)))
                        out += [(0, digest, None, None, h, None) for h in np.unique(seeds[text == t]).view(np.int64).tolist()]
                row += len(bounds) - 1
                if len(out) > 20_000:
                    yield _batch(schema, out)
                    out = []
            yield _batch(schema, out)

    return stash(docs.mapInArrow(run, T.StructType(fields)), "tiling-met", ("kind",))


def _tiled(pairs: DataFrame, bodies: DataFrame, items: DataFrame, tile_words: int, coverage: float) -> DataFrame:
    """(text, item_id, items, item_words, covered, tiles, longest) of the pairs that match; a task holds one text and one item at a time."""
    import zstandard

    deal = F.pmod(F.xxhash64("item"), F.lit(DEALS)).cast("int").alias("deal")
    each = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    dealt = salted_lookup(pairs, items.join(each, "item"), "item", pairs.count()).select("text", deal, "item", "body", "item_id", "items")
    once = bodies.groupBy("text").agg(F.min("body").alias("body")).join(pairs.select("text", deal).distinct(), "text")
    rows = dealt.unionByName(once, allowMissingColumns=True)
    kind = T.StructType([T.StructField("text", T.BinaryType()), T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("items", T.LongType()), *(
        T.StructField(n, T.IntegerType()) for n in ("item_words", "covered", "tiles", "longest")
    )])

    def run(batches):
        unpack, now, known = zstandard.ZstdDecompressor().decompress, None, None
        for batch in batches:
            schema = pa.schema([("text", pa.binary()), ("item_id", batch.schema.field("item_id").type), ("items", pa.int64()), *((n, pa.int32()) for n in ("item_words", "covered", "tiles", "longest"))])
            out = []
            for text, item, body, own, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if item is None:
                    now, known = text, Text(unpack(body).split(b" "))
                else:
                    if text != now:
                        raise RuntimeError("an item without its text")
                    parts = body.split(b" ")
                    if found := known.match(parts, tile_words, coverage):
                        out.append((text, own, items, len(parts), *found))
            yield _batch(schema, out)

    by_text = rows.repartition("text", "deal").sortWithinPartitions("text", "deal", F.col("item").asc_nulls_first())
    return by_text.select("text", "item", "body", "item_id", "items").mapInArrow(run, kind)


def _found(docs: DataFrame, benchmark: DataFrame, id_col, text_col, item_col, item_text_col, tile_words: int, coverage: float) -> tuple[DataFrame, DataFrame]:
    """(text, item_id, items, item_words, covered, tiles, longest, n) of texts and items they contain, ``n`` rows a text; and (id, mark, text) of such rows."""
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    items, seeds = _items(benchmark.select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{item_text_col}`").alias("text")), tile_words)
    lengths = items.agg(F.sort_array(F.collect_set(F.least("item_words", F.lit(tile_words))))).first()[0]  # tile_words numbers at most
    keys = _keys(seeds, tile_words, coverage)
    met = _meet(docs.select(own.alias("id"), text.alias("text"), row_mark(own, text).alias("mark")), keys, lengths or [tile_words])
    hits = met.where("kind = 0").select("text", "h").distinct()
    many = hits.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    pairs = salted_lookup(hits, keys.join(many, "h"), "h", met.where("kind = 0").count(), many=True).select("text", "item").distinct()
    found = stash(_tiled(stash(pairs, "tiling-pairs"), met.where("kind = 1").select("text", "body"), items, tile_words, coverage), "tiling-found")
    rows = met.where("kind = 2").select("text", "id", "mark")
    return found.join(rows.groupBy("text").agg(F.count(F.lit(1)).alias("n")), "text"), rows


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", tile_words: int = TILE, coverage: float = COVERAGE,
) -> DataFrame:
    """(id, item_id, items, item_words, covered, coverage, tiles, longest): each row of ``docs`` and item it contains.

    Items of equal words are one, named by the smallest id (null last); ``items`` counts them. An item of fewer words
    than a tile must stand whole. Ids are of any type, and may be null or repeat; rows that repeat count each. Null, empty
    and wordless texts and items match nothing; very long ones are tiled whole; an empty table on either side
    gives no rows; extra columns aren't looked at.
    """
    found, rows = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, tile_words, coverage)
    out = salted_lookup(rows, found, "text", rows.count(), many=True)
    share = (F.col("covered") / F.col("item_words")).alias("coverage")
    return out.select("id", "item_id", "items", "item_words", "covered", share, "tiles", "longest")


def clean(
    docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", tile_words: int = TILE, coverage: float = COVERAGE,
) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns, whatever their names; edge cases as in ``contaminated``."""
    found, rows = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, tile_words, coverage)
    texts = found.select("text", "n").distinct()
    bad = stash(salted_lookup(rows, texts, "text", rows.count()).groupBy("mark").agg(F.count(F.lit(1)).alias("n")), "tiling-bad")
    passed, looked = sifted(docs, row_mark(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), bad)
    return passed.select("row.*").unionByName(salted_lookup(looked, bad, "mark", docs.count(), "left_anti").select("row.*"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it contains; edge cases as in ``contaminated``."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")
