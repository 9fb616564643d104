"""Similarity join of documents by the Jaccard index of their word shingles.

Exact. A set of n shingles can reach the threshold only with a set that shares one of
its first n - ceil(threshold * n) + 1 shingles, in any order that holds for all sets. Two
such orders are used: both put shingles that a sketch of the whole corpus counts as
frequent last, and otherwise follow two different hashes. Pairs must meet in the
prefixes of both. Where many sets share a prefix shingle, pairs aren't listed: a
first round links the sets to a few of them. Only what then still lies in different
components is met, in cells of bounded size, and compared if it meets in the other order too.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_rows, bloom_has, bloom_of, mix64, salted_lookup, shingles, sifted, stash, table, word_hashes
from .graph import components

CELL_BITS, SLICE_BITS = 23, 15
#: A prefix shingle of more sets than this is treated as crowded.
CROWD = 64
#: Sets of a crowd that all others of it are compared with in the first round.
HUBS = 2
#: Sets of a crowd that the second round deals to a side; a cell is the pairs of two sides, or of one.
SIDE_SETS = 1024

def shingle_sets(raws: list[bytes], k: int):
    """For each text, the sorted 64-bit hashes of its distinct k-word shingles; fewer words make one of all of them.

    All in NumPy, many texts at a time.
    """
    for words, bounds in word_hashes(raws):
        folded = shingles(words, k)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= k:
                out = np.sort(folded[lo : hi - k + 1])
                yield out[np.append(True, out[1:] != out[:-1])]
            else:
                yield shingles(words[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def similar(common: int, n: int, m: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def _sets(batch, k):
    return shingle_sets([raw or b"" for raw in batch.column(1).cast(pa.binary()).to_pylist()], k)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def describe(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """One scan: (id, h, n, digest, key) of every row, and the slices of each task's shingle counts."""
    schema = T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("h", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("digest", T.BinaryType()), T.StructField("key", T.LongType()), T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType()),
    ])

    def run(batches):
        counts = np.zeros(1 << CELL_BITS, np.int32)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            n, digests, keys, cells = [], [], [], []

            def tally(cells):
                if cells:
                    own, many = np.unique(np.concatenate(cells), return_counts=True)
                    counts[own] += many.astype(np.int32)

            held = 0
            for s in _sets(batch, k):
                n.append(len(s))
                digests.append(_digest(s) if len(s) else None)
                keys.append(_key(digests[-1]) if len(s) else None)
                cells.append((s >> np.uint64(64 - CELL_BITS)).astype(np.int32))
                held += len(s)
                if held > 1_000_000:
                    tally(cells)
                    cells, held = [], 0
            tally(cells)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array([0] * rows, pa.int32()), batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.int64()),
                pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()),
            ], names=schema.names)
        if id_type is not None:
            size = 1 << SLICE_BITS
            parts = [(i, counts[i * size : (i + 1) * size]) for i in range(1 << CELL_BITS - SLICE_BITS)]
            parts = [(i, zlib.compress(c.tobytes(), 1)) for i, c in parts if c.any()]
            rows = len(parts)
            yield pa.RecordBatch.from_arrays([
                pa.array([1] * rows, pa.int32()), pa.nulls(rows, id_type), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.int64()),
                pa.array([i for i, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary()),
            ], names=schema.names)

    both = stash(docs.mapInArrow(run, schema), "jaccard-sets", ("kind",))
    return both.where("kind = 0").select("id", "h", "n", "digest", "key"), both.where("kind = 1").select("slice", "counts")


def frequency_levels(slices: DataFrame, shingles_in_all: int) -> bytes:
    """A level for each of the sketch's cells (8 MB, whatever the corpus): 0 unless its count
    stands out from the mean, then rising with its logarithm."""
    mean = shingles_in_all / (1 << CELL_BITS)
    least = 4 * mean**0.5 + 3

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(packed), np.int32)
                if i in sums:
                    sums[i] += part
                else:
                    sums[i] = part.astype(np.int64)
        excess = {i: c - mean for i, c in sums.items()}
        levels = [np.where(e < least, 0, 1 + np.floor(np.log2(np.maximum(e, 1) / least))).clip(0, 31).astype(np.uint8).tobytes() for e in excess.values()]
        yield pa.RecordBatch.from_pydict({"slice": list(sums), "levels": levels}, schema=pa.schema([("slice", pa.int32()), ("levels", pa.binary())]))

    out = bytearray(1 << CELL_BITS)
    for row in slices.repartition("slice").mapInArrow(add, "slice int, levels binary").collect():
        out[row["slice"] << SLICE_BITS : row["slice"] + 1 << SLICE_BITS] = row["levels"]
    return bytes(out)


def prefixes(docs: DataFrame, k: int, percent: int, levels: bytes, hot: dict) -> DataFrame:
    """(token, key, n): the prefix of each set in each order; a token's lowest bit names the order.

    ``hot``: of the sets that very many rows share, the row that speaks for it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((levels, hot))

    def run(batches):
        level, speaks = np.frombuffer(shared.value[0], np.uint8), shared.value[1]
        for batch in batches:
            tokens, keys, sizes, held = [], [], [], 0

            def out(tokens, keys, sizes):
                many = [len(t) for t in tokens]
                return pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.asarray(keys, np.int64), many)), pa.array(np.repeat(np.asarray(sizes, np.int32), many)),
                ], names=["token", "key", "n"])

            for own, h, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _sets(batch, k), strict=True):
                n = len(s)
                if not n:
                    continue
                digest = _digest(s)
                if speaks.get(digest, (own, h)) != (own, h):
                    continue
                p = prefix_size(n, percent)
                high = level[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(59)
                for order in (0, 1):
                    rank = high | mix64(s, order + 1) >> np.uint64(5)
                    first = s[np.argpartition(rank, p - 1)[:p]] if p < n else s
                    tokens.append(first & np.uint64(0xFFFFFFFFFFFFFFFE) | np.uint64(order))
                    keys.append(_key(digest))
                    sizes.append(n)
                held += 2 * p
                if held > 200_000:
                    yield out(tokens, keys, sizes)
                    tokens, keys, sizes, held = [], [], [], 0
            if tokens:
                yield out(tokens, keys, sizes)

    return docs.mapInArrow(run, "token long, key long, n int")


_LISTS = "kind int, a long, part int, partners binary, token long, n int"


def _lists_batch(rows):
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "a", "part", "partners", "token", "n"])


def _partner_rows(keys, sizes, comps, percent, part, sides=None):
    """A row for each set with the larger keys it may link with, if any: lengths fit, components differ, and sides, if told."""
    order = np.argsort(keys, kind="stable")
    keys, sizes, comps = keys[order], sizes[order], comps[order]
    sides = sides[order] if sides is not None else None
    for i in range(len(keys) - 1):
        n = sizes[i + 1 :]
        fit = (np.minimum(n, sizes[i]) * 100 >= percent * np.maximum(n, sizes[i])) & (comps[i + 1 :] != comps[i])
        if sides is not None:
            fit &= sides[i + 1 :] != sides[i]
        if fit.any():
            yield 0, int(keys[i]), part, keys[i + 1 :][fit].tobytes(), None, None


def meet(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """One shuffle of the prefixes by token. Returns lists (a, part, partners) and crowds (token, key, n).

    Tokens of one set vanish. Up to CROWD sets list their pairs, part 0 or 1 by order. Of
    a larger crowd each set lists the first HUBS (part 2), and the rows are kept for the second round.
    """

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3  # rows of the token that may go on; of a crowd its last row, already told
        hubs = None  # keys and sizes of the crowd that may go on
        out = []

        def crowd(token, keys, sizes):
            for key, n in zip(keys.tolist(), sizes.tolist(), strict=True):
                fit = (np.minimum(hubs[1], n) * 100 >= percent * np.maximum(hubs[1], n)) & (hubs[0] != key)
                if fit.any():
                    out.append((0, key, 2, hubs[0][fit].tobytes(), None, None))
                out.append((1, key, None, None, int(token), n))

        def group(token, keys, sizes):
            nonlocal hubs
            if len(keys) > CROWD:
                hubs = keys[:HUBS], sizes[:HUBS]
                crowd(token, keys, sizes)
                hubs = None
            else:
                out.extend(_partner_rows(keys, sizes, np.arange(len(keys)), percent, int(token) & 1))

        for batch in batches:
            token, key, n = (np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True))
            if not len(token):
                continue
            new = np.append(True, (token[1:] != token[:-1]) | (key[1:] != key[:-1]))
            token, key, n = token[new], key[new], n[new]
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(starts, len(token)))
            if hubs is not None:
                crowd(token[0], key[1 : size[0]], n[1 : size[0]])
                if len(starts) > 1:
                    hubs = None
                size[0] = 1
            last = starts[-1]
            size, starts = size[:-1], starts[:-1]
            two = starts[size == 2]
            lo, hi = np.minimum(key[two], key[two + 1]), np.maximum(key[two], key[two + 1])
            fit = np.minimum(n[two], n[two + 1]) * 100 >= percent * np.maximum(n[two], n[two + 1])
            parts = (token[two] & 1)[fit].tolist()
            out.extend((0, x, part, y.to_bytes(8, "little", signed=True), None, None) for x, y, part in zip(lo[fit].tolist(), hi[fit].tolist(), parts, strict=True))
            for i in np.flatnonzero(size > 2).tolist():
                s, e = starts[i], starts[i] + size[i]
                group(token[s], key[s:e], n[s:e])
            if hubs is None and len(token) - last > CROWD:
                hubs = key[last : last + HUBS], n[last : last + HUBS]
                crowd(token[last], key[last:], n[last:])
            held = [x[-1:] if hubs is not None else x[last:] for x in (token, key, n)]
            if len(out) > 20_000:
                yield _lists_batch(out)
                out.clear()
        if hubs is None and len(held[0]) > 1:
            group(held[0][0], held[1], held[2])
        if out:
            yield _lists_batch(out)

    dealt = rows.withColumn("r", F.xxhash64("token", "key")).repartition("token").sortWithinPartitions("token", "r", "key")
    both = stash(dealt.select("token", "key", "n").mapInArrow(run, _LISTS), "jaccard-lists", ("kind",))
    return both.where("kind = 0").select("a", "part", "partners"), both.where("kind = 1").select("token", F.col("a").alias("key"), "n")


def cross(crowds: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Lists of the crowds' pairs whose sets still lie in different components: part 3 or 4 by order.

    Tokens within one component go by an aggregation. The sets of each other token are dealt by
    their key to sides of about SIDE_SETS, and each set goes to one cell for every side of its token: a task
    holds one cell's rows, however large the crowd, and every pair is met in one cell.
    """
    placed = crowds.withColumnRenamed("n", "size").join(comps.select(F.col("u").alias("key"), "root"), "key", "left")
    placed = stash(placed.withColumn("root", F.coalesce("root", "key")), "jaccard-placed")
    tokens = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"))
    mixed = stash(tokens.where("lo < hi").select("token", "n"), "jaccard-mixed")

    def run(batches):
        held, out, size = None, [], 0
        for columns in batches:
            last = columns is None
            columns = held if last else [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)] if held else columns
            if not columns or not len(columns[0]):
                continue
            token, lo, hi = columns[:3]
            new = np.append(True, (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
            starts = np.append(np.flatnonzero(new), len(token))
            for s, e in zip(starts[:-1] if last else starts[:-2], starts[1:] if last else starts[1:-1], strict=True):
                keys, sizes, roots, sides = (c[s:e] for c in columns[3:])
                for row in _partner_rows(keys, sizes, roots, percent, 3 + int(token[s] & 1), sides if lo[s] != hi[s] else None):
                    out.append(row)
                    size += len(row[3])
                    if size > 8_000_000 or len(out) > 20_000:
                        yield _lists_batch(out)
                        out, size = [], 0
            held = None if last else [c[starts[-2] :] for c in columns]
        if out:
            yield _lists_batch(out)

    def cells(batches):
        def arrays():
            for batch in batches:
                yield [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            yield None

        return run(arrays())

    rows = salted_lookup(placed, mixed, "token", placed.count()).withColumn("sides", F.ceil(F.col("n") / F.lit(SIDE_SETS)).cast("long"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("key"), F.col("sides"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    rows = rows.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))
    dealt = rows.select("token", "lo", "hi", "key", "size", "root", "side").repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "key")
    return dealt.mapInArrow(cells, _LISTS).select("a", "part", "partners")


BLOCK_SETS = 2048
#: The same for sets that list hubs only: one more block costs no more than the hubs' texts.
STAR_SETS = 256


def _blocks(a: int, partners: np.ndarray):
    """(block, partners) for a set's list. Sets of a family tend to share their largest partner, and so
    a block; long lists are dealt by both sides, so that no block needs many more than 2 * BLOCK_SETS sets."""
    deal = 1 << (len(partners) // BLOCK_SETS).bit_length()
    for c in range(deal) if deal > 1 else (0,):
        part = partners[partners % deal == c] if deal > 1 else partners
        if len(part):
            yield zlib.crc32(f"{partners[-1]}:{deal}:{a % deal}:{c}".encode()) << 20 | int(partners[-1]) & 0xFFFFF, part


def _blocked(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists joined by set: (block, key, partners), pairs that met in both orders or with a crowd's hub;
    and the sets that each block needs: (block, key). A set with pairs of ``cross`` leaves out those that ``meet``
    alone listed in both orders: they have been compared.

    Many sets may share their largest partner, a crowd its hubs. Sets come to tasks by hash, so a task that has seen c of a
    block's takes it that there are c times as many as tasks, and deals the next among as many blocks as
    those need: beside one from each task, a block gets a few times STAR_SETS or BLOCK_SETS lists, however large the crowd.
    """
    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        seen: dict[int, int] = {}

        def settle(a, parts):
            own = [np.unique(np.concatenate([np.frombuffer(p, np.int64) for p in x])) if x else np.zeros(0, np.int64) for x in parts]
            found = np.intersect1d(own[0], own[1], assume_unique=True)
            if len(own[3]) or len(own[4]):
                found = np.setdiff1d(np.intersect1d(np.union1d(own[0], own[3]), np.union1d(own[1], own[4]), assume_unique=True), found, assume_unique=True)
            found = np.union1d(found, own[2])
            return [(place(block, a, part), a, part) for block, part in _blocks(a, found)] if len(found) else []

        def place(block, a, part):
            nonlocal seen
            if len(seen) > 200_000:
                seen = {b: c for b, c in seen.items() if c > 8}
            before = seen.get(block, 0)
            seen[block] = before + 1
            salts = max(1, -(-before * tasks // (STAR_SETS if len(part) <= HUBS else BLOCK_SETS)))
            salt = zlib.crc32(f"{block}:{a}".encode()) % salts
            return zlib.crc32(f"{block}:{salt}".encode()) << 20 | block & 0xFFFFF if salt else block

        def out(rows):
            columns = zip(*((b, a, p.tobytes()) for b, a, p in rows), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["block", "key", "partners"])

        now, parts, rows, size = None, tuple([] for _ in range(5)), [], 0
        for batch in batches:
            for a, part, partners in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != now:
                    if now is not None and (found := settle(now, parts)):
                        rows += found
                        size += sum(len(f[2]) for f in found)
                    now, parts = a, tuple([] for _ in range(5))
                    if size > 200_000:
                        yield out(rows)
                        rows, size = [], 0
                parts[part].append(partners)
        if now is not None:
            rows += settle(now, parts)
        if rows:
            yield out(rows)

    dealt = lists.repartition("a").sortWithinPartitions("a")
    wanted = stash(dealt.select("a", "part", "partners").mapInArrow(run, "block long, key long, partners binary"), "jaccard-blocks")

    def needs(batches):
        def out(block, keys):
            return pa.RecordBatch.from_pydict({"block": [block] * len(keys), "key": sorted(keys)}, schema=pa.schema([("block", pa.int64()), ("key", pa.int64())]))

        now, keys = None, set()
        for batch in batches:
            for block, key, partners in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if keys:
                        yield out(now, keys)
                    now, keys = block, set()
                keys.add(key)
                keys.update(np.frombuffer(partners, np.int64).tolist())
        if keys:
            yield out(now, keys)

    by_block = wanted.repartition("block").sortWithinPartitions("block")
    return wanted, stash(by_block.mapInArrow(needs, "block long, key long"), "jaccard-need")


def verify(lists: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v): links among the listed pairs, of each block a spanning forest of them.

    A block is some sets ``a`` with their partners; every text goes once to each block that needs its set.
    Texts travel compressed. They are scanned again, and only rows that a filter of the needed ids has are looked at.
    """
    wanted, need = _blocked(lists)
    ids = classes.join(need.select("key").distinct(), "key", "left_semi").select("rep_id", "rep_h", id_mark(F.col("rep_id"), F.col("rep_h")).alias("mark"))
    ids = stash(ids, "jaccard-ids")
    bloom = bloom_of(ids, "mark", ids.count(), 16)
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def gather(batches):
        import zstandard

        pack = zstandard.ZstdCompressor().compress
        bits, whole = shared.value[0], np.frombuffer(shared.value[1], np.uint8)
        for batch in batches:
            marks = as_rows(batch.column(2).to_pylist(), 16) if batch.num_rows else np.zeros((0, 16), np.uint8)
            some = batch.filter(pa.array(bloom_has(whole, bits, marks)))
            raws = [raw or b"" for raw in some.column(1).cast(pa.binary()).to_pylist()]
            keys = [(_key(_digest(s)), raw) for s, raw in zip(shingle_sets(raws, k), raws, strict=True) if len(s)]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keys], pa.int64()), pa.array([pack(raw) for _, raw in keys], pa.binary())], names=["key", "body"])

    marked = docs.select("id", "text", id_mark(F.col("id"), F.col("h")).alias("mark"))
    sets = marked.mapInArrow(gather, "key long, body binary")
    shipped = sets.join(need, "key").select("block", F.lit(0).alias("kind"), "key", "body")
    rows = shipped.unionByName(wanted.select("block", F.lit(1).alias("kind"), "key", F.col("partners").alias("body")))

    def compare(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        block, sets, root, edges = None, {}, {}, []

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            for b, kind, key, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    block, sets, root = b, {}, {}
                if kind == 0:
                    sets[key] = next(shingle_sets([unpack(body)], k))
                    continue
                own = sets[key]
                for other in np.frombuffer(body, np.int64).tolist():
                    if find(key) != find(other):
                        s = sets[other]
                        small, large = (own, s) if len(own) < len(s) else (s, own)
                        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                        if similar(int((large[at] == small).sum()), len(own), len(s), percent):
                            root[find(other)] = find(key)
                            edges.append((key, other))
            if edges:
                yield pa.RecordBatch.from_pydict({"u": [e[0] for e in edges], "v": [e[1] for e in edges]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))
                edges = []

    dealt = rows.repartition("block").sortWithinPartitions("block", "kind", "key")
    return stash(dealt.mapInArrow(compare, "u long, v long"), "jaccard-edges")


def id_mark(own: Column, h: Column) -> Column:
    """16 bytes that stand for a row's id and text, by the 64-bit hash of the text."""
    return F.unhex(F.md5(F.concat_ws(":", own.isNull().cast("string"), F.coalesce(own.cast("string"), F.lit("")), h.cast("string"))))


def linked(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, h, n, digest, component): one row for each row of ``docs``, ``h`` a hash of its text.

    ``component``: the smallest id that links reach, the row's own included. Rows of equal sets are linked;
    null and empty texts, or texts of white space, have no shingle and no link, and are their own component. Null
    ids never name a component unless it has no other. Extra columns aren't looked at; an empty
    table gives no rows. Sets are compared by 64-bit hashes of their shingles, grouped by 128 bits.
    """
    text = F.col(f"`{text_col}`")
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    described, slices = describe(docs, words)
    total, all_shingles = described.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rep = F.min(F.struct(F.col("id").isNull().alias("u"), "id", "h"))
    classes = described.where("n > 0").groupBy("digest", "key").agg(rep.alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stash(classes.select("digest", "key", F.col("rep.id").alias("rep_id"), F.col("rep.h").alias("rep_h"), "n"), "jaccard-classes")
    fair = max(1, total // 1000)
    hot = {bytes(r["digest"]): (r["rep_id"], r["rep_h"]) for r in classes.where(F.col("n") > fair).collect()}  # a thousand at most
    lists, crowds = meet(prefixes(docs, words, percent, frequency_levels(slices, all_shingles), hot), percent)
    edges = verify(lists, docs, classes, words, percent)
    roots = stash(components(edges), "jaccard-roots")
    if not crowds.isEmpty():
        more = stash(cross(crowds, roots, percent), "jaccard-cross")
        if not more.isEmpty():
            met = lists.where("part < 2").join(more.select("a").distinct(), "a", "left_semi").unionByName(more)
            edges = edges.unionByName(verify(met, docs, classes, words, percent))
            roots = stash(components(edges), "jaccard-roots")
    rooted = classes.join(roots.withColumnRenamed("u", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")).withColumnRenamed("n", "copies")
    named = stash(rooted.groupBy("root").agg(F.min("rep_id").alias("component"), F.count(F.lit(1)).alias("n")), "jaccard-named")
    index = salted_lookup(rooted, named, "root", total).select("digest", F.col("copies").alias("n"), "component")
    index = stash(index, "jaccard-index")
    some = salted_lookup(described.where("n > 0").withColumnRenamed("n", "n_shingles"), index, "digest", total)
    none = described.where("n = 0").select("id", "h", F.col("n").alias("n_shingles"), "digest", F.col("id").alias("component"))
    return some.select("id", "h", "n_shingles", "digest", "component").unionByName(none)


def one_of_each(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs``' rows and columns, of each component of linked texts the one with the smallest
    id (null last; then by a hash of the text). Of rows that repeat id and text one stays, the first by all its
    columns; texts without words all stay, as do different texts of a component whose ids are all null. Columns of any
    name pass through; very long texts are compared whole; an empty table gives none.

    Rows that a filter of the ones to look at (64 MB at most) lacks pass without a shuffle.
    """
    rows = linked(docs, id_col, text_col, words, percent).where("n_shingles > 0")
    found = stash(rows.groupBy("id", "h", "component").agg(F.count(F.lit(1)).alias("n")), "jaccard-linked")
    rank = F.struct(F.col("id").isNull().alias("u"), "id", "h")
    best = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    best = stash(best, "jaccard-best")
    placed = salted_lookup(found.withColumnRenamed("n", "repeats"), best, "component", found.count())
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))
    nowhere = found.where(F.col("component").isNull()).select("id", "h", F.lit(True).alias("stays"), "n")
    found = placed.select("id", "h", stays.alias("stays"), F.col("repeats").alias("n")).unionByName(nowhere)
    touched = found.where(~F.col("stays") | (F.col("n") > 1)).select(id_mark(F.col("id"), F.col("h")).alias("mark"), "stays", "n")
    touched = stash(touched, "jaccard-touched")
    passed, looked = sifted(docs, id_mark(F.col(f"`{id_col}`"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))), touched)
    looked = salted_lookup(looked, touched, "mark", docs.count(), "left")
    alone = looked.where("stays IS NULL").select("row.*")
    again = looked.where("stays").groupBy("mark").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return passed.select("row.*").unionByName(alone).unionByName(again)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), words=4, percent=85).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id")
    )


#: Every pair that shares a shingle is counted, and links are followed to their end: for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) >= 4 THEN list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' ')))
                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS own FROM w),
x AS (SELECT doc_id, unnest(own) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN s u ON u.doc_id = p.a JOIN s v ON v.doc_id = p.b WHERE 100 * n >= 85 * (len(u.own) + len(v.own) - n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT r.a AS doc_id, any_value(len(s.own))::BIGINT AS n_shingles, min(r.b) AS component_id FROM r JOIN s ON s.doc_id = r.a GROUP BY r.a
"""
