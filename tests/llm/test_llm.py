import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline import llm
from ledgerline.llm import chunks, decontaminate, dedup, graph, jaccard, licenses, lines, mixing, sharding, tokens, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, bucket int, shard string, target string, n int"
LONG = "lorem ipsum dolor " * 30_000


def documents(spark, rows):
    """Rows of (doc_id, text, source), with more columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, s, None, 1, 2, "x", "y", 3) for i, t, s in rows], DOCS)


EDGES = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, None, None), (3, "", "s"), (4, " \n\t", "t"), (None, "a b c d e f", "t"), (5, LONG, "t"), (6, "a  b\nc d e f", "s")]


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    got = llm.queries()[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted(map(tuple, want.fetchall()), key=repr)


OPERATORS = {
    "mix": lambda d, s: mixing.mix(d), "mixed": lambda d, s: mixing.mixed(d), "dedup": lambda d, s: dedup.dedup(d), "shard": lambda d, s: sharding.shard(d),
    "assign": lambda d, s: sharding.assign(d), "leaks": lambda d, s: decontaminate.contaminated(d, s.createDataFrame([(1, "a b c d e f"), (2, None), (3, "")], "item_id long, text string")),
    "toxic": lambda d, s: d.select(toxicity.score(F.col("text"), toxicity.Model(-3.0, {b"a": 5.0}))), "lines": lambda d, s: lines.repeated(d), "passages": lambda d, s: lines.passages(d), "chunks": lambda d, s: chunks.repeated(d),
    "linked": lambda d, s: jaccard.linked(d), "one": lambda d, s: jaccard.one_of_each(d), "licenses": lambda d, s: licenses.scan(d),
    "tokens": lambda d, s: tokens.token_counts(d, __import__("public_tokenizers").path("byte_bpe_50k.json")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_nulls_long_texts_repeats_and_empty_tables(spark, name):
    docs = documents(spark, EDGES)
    got = OPERATORS[name](docs, spark).collect()
    if name in ("mix", "dedup", "shard", "assign", "toxic", "linked", "licenses", "tokens"):
        assert len(got) == len(EDGES)
    assert OPERATORS[name](docs.where("1 = 0"), spark).collect() == []


def test_mix_follows_budgets_and_repeats(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), f"s{min(i % 10, 3)}") for i in range(300)]
    out = mixing.mix(documents(spark, rows)).collect()
    again = {r["id"]: r["taken"] for r in mixing.mix(documents(spark, rows[::-1])).collect()}
    assert {r["id"]: r["taken"] for r in out} == again
    by = collections.defaultdict(list)
    for r in out:
        by[r["src"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(sum(r["size"] for r in out))
    for rs in by.values():
        assert sum(r["taken"] for r in rs) == math.floor(rs[0]["target"] + 0.5) and rs[0]["target"] <= 3 * rs[0]["source_size"]
    copies = mixing.mixed(documents(spark, rows)).collect()
    assert sum(len(r["text"].split()) for r in copies) == sum(r["taken"] for r in out) and copies[0].__fields__ == documents(spark, []).columns


@pytest.mark.parametrize("sizes, epochs", [((1, 18, 25), 0), ((1, 6, 25), 1), ((2, 27, 6), 2)])
def test_mix_takes_a_source_whole_where_the_rest_rounds_up_to_it(spark, sizes, epochs):
    rows = [(10 * k + j, " ".join(["w"] * n), f"s{k}") for k, size in enumerate(sizes) for j, n in enumerate([size // 3, size - size // 3, 0])]
    docs, con = documents(spark, rows), duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(r) for r in rows])
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, taken, epochs, target FROM ({mixing.ORACLE_SQL})").fetchall()}
    out = mixing.mix(docs).collect()
    assert {r["id"]: (r["taken"], r["epochs"], r["target"]) for r in out} == want
    assert any(r["epochs"] == epochs and 0 < (epochs + 1) * r["source_size"] - r["target"] <= 0.5 and r["taken"] == (epochs + 1) * r["size"] > 0 for r in out)
    assert sum(len(r["text"].split()) for r in mixing.mixed(docs).collect()) == sum(r["taken"] for r in out)


@pytest.mark.parametrize("width", [32, 1])
def test_dedup_by_brute_force_and_with_colliding_digests(spark, width):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("ab \n") for _ in range(r.randrange(6))), "s") for i in range(400)]
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[ \n]", "", t)].append((-len(t), i))
    for x in dedup.dedup(documents(spark, rows), digest_bytes=width, memtable_rows=16).collect():
        body = re.sub(r"[ \n]", "", rows[x["id"]][1])
        keep = min(groups[body])[1]
        assert (x["keep_id"], x["group_size"], x["kept"], x["sha"]) == (keep, len(groups[body]), keep == x["id"], hashlib.sha256(body.encode()).hexdigest())


def test_compaction_merges_sorted_runs_by_ranges(spark):
    r = random.Random(13)
    rows = [(r.choice([None, r.randrange(50)]), f"t{r.randrange(300)}" + " " * r.randrange(3), "s") for _ in range(3000)]
    docs = documents(spark, rows).select(F.col("doc_id").cast("string").alias("id"), "text").repartition(5)
    runs = dedup.flush_runs(docs, memtable_rows=32)
    level0 = runs.collect()
    by_run = collections.defaultdict(list)
    for x in level0:
        by_run[x["run"]].append(bytes(x["digest"]))
    assert len(by_run) > 5 and all(d == sorted(set(d)) and len(d) <= 32 for d in by_run.values())
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[t.strip()].append((-len(t), i is None, str(i)))
    want = {hashlib.sha256(t.encode()).digest(): (None if min(g)[1] else min(g)[2], -min(g)[0], len(g)) for t, g in groups.items() if len(g) > 1}
    for range_rows in (10**6, 1):
        got = dedup.compact(runs, len(level0), range_rows).withColumn("part", F.spark_partition_id()).collect()
        assert {bytes(x["digest"]): (x["keep_id"], x["keep_length"], x["n"]) for x in got} == want and len(got) == len(want)
        parts = collections.defaultdict(list)
        for x in got:
            parts[x["part"]].append(bytes(x["digest"]))
        assert all(d == sorted(d) for d in parts.values())


def test_shards_move_little_and_slots_have_no_gaps(spark):
    rows = sharding.shard(documents(spark, [(i, f"t{i}", "s") for i in range(2000)])).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        assert r["grown"] in (r["shard"], 24) and r["crc"] == zlib.crc32(f"t{r['id']}".encode()) and r["size"] == len(f"t{r['id']}") + 8
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24
    assert 20 < sum(r["grown"] == 24 for r in rows) < 160
    heavy = sharding.assign(documents(spark, [(i, "", "s") for i in range(2000)]), weights=[1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    assert {r["shard"]: round(r["count"] / 500) for r in heavy} == {0: 1, 1: 3}


def test_decontamination_catches_reordered_passages(spark):
    item = " ".join(f"w{i}" for i in range(30))
    w = item.split()
    moved = "x " + " ".join(w[20:]) + " y " + " ".join(w[:20]).upper() + ", z"
    docs = documents(spark, [(1, moved, "s"), (2, " ".join(w[:12]), "s"), (3, " ".join(w[::-1]), "s"), (4, f"q {item}", "s"), (5, "of " * 500, "s"), (6, "tiny item", "s"), (4, f"q {item}", "s"), (None, item, "s")])
    bench = spark.createDataFrame([("g", item), ("h", "tiny item"), ("i", "of of of of of of of"), (None, f"{item}."), ("f", item.upper()), ("n", None), ("e", " ")], "item_id string, text string")
    got = sorted((r["id"] or 0, r["item_id"], r["items"], r["covered"], r["tiles"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(0, "f", 3, 30, 1), (1, "f", 3, 30, 2), (4, "f", 3, 30, 1), (4, "f", 3, 30, 1), (5, "i", 1, 7, 1), (6, "h", 1, 2, 1)]
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {2, 3}
    for a, b in ((docs.where("1 = 0"), bench), (docs, bench.where("1 = 0"))):
        assert decontaminate.contaminated(a, b).collect() == [] and decontaminate.clean(a, b).count() == a.count()


def tiles_by_hand(doc, item, least):
    """Greedy string tiling as it is defined: every unmarked match is looked at, the longest taken, first by place in the item."""
    taken, out = (set(), set()), []
    while True:
        best = None
        for b in range(len(item)):
            for a in range(len(doc)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and a + n not in taken[0] and b + n not in taken[1]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (a, b, n)
        if best is None:
            return out
        out.append(best)
        for side, at in enumerate(best[:2]):
            taken[side].update(range(at, at + best[2]))


def test_tiles_by_brute_force():
    import numpy as np

    r = random.Random(2)
    for n in range(150):
        a, b = ([r.randrange(1, 2 + n % 5) for _ in range(r.randrange(40))] for _ in range(2))
        if n % 3 == 0 and len(b) > 6:
            a += b[len(b) // 2 :] + b[: len(b) // 2]
        assert decontaminate.tile(np.array(a, np.int64), np.array(b, np.int64), 3) == tiles_by_hand(a, b, 3)
    one = decontaminate.Text([b"the"] * 300_000)  # in proportion to both, not to their matches
    assert one.match([b"the"] * 4000) == (4000, 1, 4000)


def test_decontamination_by_brute_force(spark):
    r = random.Random(11)
    common = [f"c{i}" for i in range(8)]  # an opening that all items share
    items = [(i, " ".join(common + [f"v{r.randrange(60)}" for _ in range(r.choice([1, 3, 9, 20, 30]))])) for i in range(25)] + [(90, "c1 c2"), (91, " ".join(common[:6]))]
    rows = []
    for i in range(80):
        w = [f"v{r.randrange(60)}" for _ in range(20)]
        for _ in range(r.randrange(3)):
            own = r.choice(items)[1].split()
            lo = r.randrange(len(own))
            at = r.randrange(len(w))
            w[at:at] = own[lo : lo + r.choice([6, 12, 40])]
        rows.append((i, " ".join(w), "s"))
    want = {}
    for i, t, _ in rows:
        for k, own in items:
            n, found = len(own.split()), tiles_by_hand(t.split(), own.split(), min(5, len(own.split())))
            if sum(x[2] for x in found) >= 0.5 * n:
                want[i, k] = (n, sum(x[2] for x in found), len(found), max(x[2] for x in found))
    got = decontaminate.contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["id"], x["item_id"]): (x["item_words"], x["covered"], x["tiles"], x["longest"]) for x in got} == want and len(want) > 20


ALONE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def found(batches):
    import importlib.util, pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_pydict({{"n": [int(importlib.util.find_spec("ledgerline") is not None)]}})
assert spark.range(1).mapInArrow(found, "n long").first()[0] == 0  # the workers have no copy of the package
from ledgerline.llm import chunks, decontaminate, dedup, jaccard, lines
docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (3, "x y")], "doc_id long, text string")
bench = spark.createDataFrame([(7, "one two three four five six")], "item_id long, text string")
print("ROWS", [decontaminate.contaminated(docs, bench).count(), decontaminate.clean(docs, bench).count(), jaccard.one_of_each(docs).count(), lines.without(docs, lines.repeated(docs)).count(), chunks.repeated(docs).count(), dedup.dedup(docs).count()])
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "alone.py").write_text(ALONE.format(repo=repo))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "alone.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS [2, 1, 2, 3, 0, 3]" in out.stdout, out.stderr[-2000:]


def test_toxicity_learns_sentences_from_document_labels(spark):
    r = random.Random(3)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = [" ".join(r.choices(words, k=8)) for _ in range(6)]
        if toxic:
            text[r.randrange(6)] += r.choice([" grumblex", " snarlyish"])
        rows.append((i, ". ".join(text) + ".", "s"))
        labels.append((i, int(toxic)))
    docs = documents(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame([*labels, (1, None), (None, 1), (9999, 1)], "doc_id long, toxic int"))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h"), toxicity.score(F.col("text"), model).alias("p")).collect()
    held = [(x["p"] >= 0.3) == (x["doc_id"] % 4 == 0) for x in scored if x["h"]]
    assert len(held) > 100 and sum(held) / len(held) > 0.97
    found = toxicity.offending(docs.where("doc_id = 0"), model, threshold=0.5).collect()
    assert any(re.search("grumblex|snarlyish", rows[0][1][s["start"] : s["end"]]) for s in found)
    assert model.score(None) == model.score("") == 0.0 and toxicity.fit([], []).score("a") < 0.1


def test_scores_are_the_noisy_or_of_the_sentences(spark):
    model = toxicity.Model(-2.0, {b"bad": 1.5, b"badl*": 0.5, b"nice": -1.0})
    one = {b: 1 / (1 + math.exp(-z)) for b, z in (("bad", -0.5), ("badly", -1.5), ("nice", -3.0), ("none", -2.0), ("both", -1.5))}
    texts = {"Bad.": ["bad"], "bad bad, BAD": ["bad"], "badly done! Nice.": ["badly", "nice"], "so\nbad nice? bad": ["none", "both", "bad"], "": [], None: [], "?! .": []}
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = [r[0] for r in docs.orderBy("doc_id").select(toxicity.score(F.col("text"), model)).collect()]
    assert got == pytest.approx([1 - math.prod(1 - one[k] for k in kinds) for kinds in texts.values()])
    found = toxicity.offending(docs, model, threshold=0.0).collect()
    for i, (text, kinds) in enumerate(texts.items()):
        own = sorted((r for r in found if r["id"] == i), key=lambda r: r["start"])
        assert [r["score"] for r in own] == pytest.approx([one[k] for k in kinds])
        assert 1 - math.prod(1 - r["score"] for r in own) == pytest.approx(got[i])
        assert all(text[r["start"] : r["end"]].strip() for r in own)
    assert toxicity.offending(docs.where("1 = 0"), model).collect() == [] and toxicity.offending(documents(spark, [(None, "bad", "s"), (None, "bad", "s"), (1, LONG, None)]), model).count() == 2


def test_located_sentences_are_those_that_reach_the_threshold(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    want = set()
    for own, text in docs.select("doc_id", "text").collect():
        at = 0
        for s in re.split(r"[.!?\n\r]", text or ""):
            end = at + len(s.encode())
            if model.score(s) >= toxicity.THRESHOLD:
                want.add((own, at, end, round(model.score(s), 9)))
            at = end + 1
    got = [tuple(r) for r in llm.queries()["toxicity_sentences"](spark, SF).collect()]
    assert {(i, a, b, round(p, 9)) for i, a, b, p in got} == want and len(got) == len(want) > 0


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = [(i, ("bad " if i % 2 else "good ") * 20 + f"w{i}", "s") for i in range(200)] + [(201, LONG, "s"), (202, None, "s"), (1, "bad", "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(203)] + [(5, 0), (None, 1)], "doc_id long, toxic int")
    fitted = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, weight: fitted.append(sorted(zip(y, texts, strict=True))))
    for most in (2000, 1 << 24):
        toxicity.train(documents(spark, rows), labels, sample_bytes=most)
    small, whole = fitted
    assert set(small) < set(whole) and LONG in {t for _, t in whole}
    assert all(1800 < sum(len(t) for label, t in small if label == y) <= 2000 for y in (0, 1))
    toxicity.train(documents(spark, []), labels)
    assert fitted[-1] == []


def test_lines_are_cut_out_by_their_offsets(spark):
    line = "this line of eleven words stands in more than one text"
    docs = documents(spark, [(1, f"head one\n{line}\ntail", "s"), (2, f"{line.upper()}\nown text", "s"), (3, f"é {line}\n{line}", "s")])
    spans = lines.repeated(docs)
    assert sorted((r["id"], r["unit"], r["keep_id"]) for r in spans.collect()) == [(2, 0, 1), (3, 1, 1)]
    assert {r["doc_id"]: r["text"] for r in lines.without(docs, spans).collect()} == {1: f"head one\n{line}\ntail", 2: "\nown text", 3: f"é {line}\n"}
    assert lines.repeated(documents(spark, [(1, "a b\n\nc d", "s"), (2, "c  D\n \na B", "s")]), unit="paragraph", min_words=1).count() == 2


@pytest.mark.parametrize("width", [16, 1])
def test_chunks_resist_shifts(spark, width):
    r = random.Random(4)
    block = [f"line {i} {r.random()}" for i in range(40)]
    rows = [(1, "\n".join(block), "s"), (2, "\n".join(["new start", *block, "new end"]), "s"), (3, "\n".join(f"other {r.random()}" for _ in range(40)), "s")]
    got = chunks.repeated(documents(spark, rows), digest_bytes=width).collect()
    assert {x["id"] for x in got} == {2} and sum(x["lines"] for x in got) >= (25 if width == 16 else 1)
    for x in got:
        n = x["end"] - x["start"]
        assert rows[1][1][x["start"] : x["end"]] == rows[0][1][x["keep_start"] : x["keep_start"] + n]


def test_every_shared_run_of_two_lines_is_covered_and_one_copy_of_each_line_stays(spark):
    r = random.Random(8)
    rows = [(i, "\n".join(r.choice("abcdefgh") * 3 + str(r.randrange(9)) for _ in range(r.randrange(1, 30))), "s") for i in range(40)]
    shared = ["shared é one", "shared two"]
    rows += [(100 + i, "\n".join([*(f"own {i} {j}" for j in range(i)), *shared, *(f"after {i} {j}" for j in range(i % 4))]), "s") for i in range(12)]
    first, want = {}, set()
    for i, t, _ in rows:
        parts = t.split("\n")
        for k, pair in enumerate(zip(parts, parts[1:])):
            if first.setdefault(pair, (i, k)) != (i, k):
                want |= {(i, k), (i, k + 1)}
    docs, text = documents(spark, rows), {i: t for i, t, _ in rows}
    got = chunks.repeated(docs)
    found = got.collect()
    assert {(x["id"], x["first_line"] + j) for x in found for j in range(x["lines"])} == want
    for x in found:
        body = text[x["id"]][x["start"] : x["end"]]
        assert len(body.split("\n")) == x["lines"] and text[x["keep_id"]].startswith(body, x["keep_start"])
    pairs = {(x["id"], x["first_line"]): x["n"] for x in found if x["lines"] == 2}
    assert all(pairs[100 + i, i] == 12 for i in range(1, 12))
    left = {line for x in lines.without(docs, got).collect() for line in x["text"].split("\n")}
    assert {line for t in text.values() for line in t.split("\n")} <= left


def components_by_hand(rows, k, percent):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("crowd", [64, 3])
def test_jaccard_join_by_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard, "STAR_SETS", 2)
    monkeypatch.setattr(jaccard, "SIDE_SETS", 5)
    r = random.Random(5)
    base = [[f"{r.randrange(10**6)}" for _ in range(60)] for _ in range(4)]
    rows = [(i, t, "s") for i, t in enumerate(["", None, "a", "A ", "a b", " "])]
    for i in range(6, 120):
        w = list(r.choice(base))
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = "changed"
        rows.append((i, " ".join(w[: r.choice([60, 60, 55, 3])]), "s"))
    got = {x["id"]: (x["n_shingles"], x["component"]) for x in jaccard.linked(documents(spark, rows), words=4, percent=85).collect()}
    assert got == components_by_hand(rows, 4, 85)
    kept = [x["doc_id"] for x in jaccard.one_of_each(documents(spark, rows + rows[6:9]), words=4, percent=85).collect()]
    assert sorted(kept) == sorted({c for _, c in got.values()})


def test_a_crowd_of_sets_that_dont_link_loses_none_that_do(spark, monkeypatch):
    """Every text begins with one passage; without the sketch its shingles stand in the prefixes."""
    monkeypatch.setattr(jaccard, "frequency_levels", lambda *a: bytes(1 << jaccard.CELL_BITS))
    monkeypatch.setattr(jaccard, "CROWD", 3)
    monkeypatch.setattr(jaccard, "SIDE_SETS", 8)
    r = random.Random(9)
    shared = [f"p{i}" for i in range(30)]
    own = [[f"{r.randrange(10**6)}" for _ in range(25)] for _ in range(45)]
    rows = [(i, " ".join(shared + w), "s") for i, w in enumerate(own)]
    rows += [(100 + i, " ".join(shared + w[: r.randrange(19, 26)]), "s") for i, w in enumerate(own)]
    cells, meet = [], jaccard.cross
    monkeypatch.setattr(jaccard, "cross", lambda *a: cells.append(meet(*a)) or cells[0])
    got = {x["id"]: (x["n_shingles"], x["component"]) for x in jaccard.linked(documents(spark, rows), words=4, percent=85).collect()}
    assert got == components_by_hand(rows, 4, 85) and len({c for _, c in got.values()}) < len(rows)
    assert {x["part"] for x in cells[0].select("part").distinct().collect()} == {3, 4}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    assert dict(map(tuple, graph.components(edges).collect())) == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(6)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "Ab", "'s", "12", "é", " ", "　", "日本", "<|endoftext|>", "!", "\x1c", "​", "Wort"]
    texts = ["".join(r.choices(parts, k=r.randrange(25))) for _ in range(3000)] + [LONG]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for batch, long in ((500, 1), (10_000, 7), (tokens.BATCH_CHARS, tokens.LONG)):
        assert tokens.counter(path, batch, long)(texts) == want
    assert max(map(len, tokens.parts(LONG))) <= tokens.LONG + 10 and "".join(tokens.parts(LONG)) == LONG


def test_token_counts_of_the_whole_table_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.op9_token_counts(spark, SF).collect()}
    assert got == {i: (*w, w[1] > 512) for i, w in want.items()}


def test_licenses_found_despite_edits(spark):
    text = "Intro words. Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and associated documentation files. All rights reserved; CC-BY 4.0"
    x = licenses.scan(documents(spark, [(1, text, "s"), (1, text, "s"), (2, "all rights are reserved", "s")])).orderBy("id").collect()
    assert x[0] == x[1] and x[0]["base_labels"] == "cc-by,reserved" and "mit" in x[0]["labels"].split(",") and x[0]["n_base"] == 2 and x[0]["score"] == 1.0
    assert x[2]["n_base"] == 0 and x[2]["first_word"] is None and x[2]["labels"] == "" and x[2]["score"] == 0.0


def test_licenses_found_beside_repeats_of_their_own_words(spark):
    tail, w = " 4 0" * 3000, "licensed under cc by nc 4 0"
    texts = [w + " 4 0 4 0", w + tail, tail + " " + w, "licensed under cc by nc 4" + " nc 4" * 9, tail, "licensed" + " x y under cc" * 9]
    got = {r["id"]: (r["labels"], r["score"]) for r in licenses.scan(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(3)] == [("cc-by,cc-by-nc", 1.0)] * 3
    assert "cc-by-nc" in got[3][0].split(",") and got[4] == ("", 0.0) and got[5] == ("", 0.0)


def test_licenses_tell_relatives_apart_and_need_their_order(spark):
    mit = next(p for p, _, _ in licenses.TEMPLATES if len(p.split()) > 100)
    half, back = mit.split()[:60], mit.split()[::-1]
    texts = [
        "licensed under the gnu general public license version 3", "licensed under the GNU Lesser General Public License, version 3", "under the gnu general public license we go",
        "licensed under cc by nc sa 4 0", "licensed under cc by nc 4.0", "Licensed under cc by, 4.0", "x " + mit.replace("merge ", "").replace(" tort", " or tort") + " y", " ".join(half), " ".join(back),
        "either version 2 of this", "license version the of terms public general gnu under licensed is work this 3", "licensed under the gnu affero general public license version 3", "a Kelvin \u212a sign is no \u212a",
    ]
    rows = licenses.scan(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).orderBy("id").collect()
    assert [r["labels"] for r in rows] == ["gpl,gpl-3.0", "gpl,lgpl", "gpl", "cc-by,cc-by-nc-sa", "cc-by,cc-by-nc", "cc-by", "mit", "mit", "", "", "", "agpl-3.0,gpl", ""]
    assert 0.9 < rows[6]["score"] <= 1 and rows[12]["n_words"] == 7
    found = licenses.spans(licenses._hits(spark.createDataFrame([(1, texts[6], b"m")], "id long, text string, mark binary"), [
        r[0] for r in spark.sql("SELECT xxhash64(w, lead(w) OVER (ORDER BY i)) FROM (SELECT posexplode(split('%s', ' ')) AS (i, w))" % mit).collect() if r[0]
    ])).where("share < 1").collect()
    assert [(r["start"], abs(r["end"] - len(texts[6].split()) + 1) <= 2) for r in found if r["start"] < 2] == [(0, True)]  # the word left out moves the later diagonals


def test_passages_inside_longer_lines_are_found_and_one_copy_stays(spark):
    a, b = "Of all the nine words here this one is first. ", "Then a second sentence of eleven words comes along right here. "
    rows = [
        (1, "start of a host " + a + b + "its end", "s"), (2, "another host begins with " + a + b + "and goes on", "s"),
        (3, (a + b).strip() + "\n" + b.upper() + "tail", None), (4, (a + b).strip(), "s"), (5, "Short one. Short one.", "s"), (None, b, "s"), (6, None, "s"),
    ]
    docs, text = documents(spark, rows), {r[0]: r[1] for r in rows}
    got = lines.passages(docs, min_words=lines.MIN_WORDS).collect()
    found = sorted((r["id"] is None, r["id"] or 0, r["kind"], " ".join(text[r["id"]][r["start"] : r["end"]].lower().split())) for r in got)
    second = b.lower().strip()
    assert found == [
        (False, 2, "sentence", second), (False, 3, "sentence", second), (False, 3, "sentence", second),
        (False, 4, "line", (a + b).lower().strip()), (True, 0, "sentence", second),
    ]
    left = " ".join(r["text"] or "" for r in lines.without(docs, lines.passages(docs, min_words=lines.MIN_WORDS)).collect()).lower()
    assert left.count(second) == 1


def test_rows_that_share_an_id_or_have_none_keep_their_own_spans(spark):
    line = "this line of eleven words stands in more than one text"
    rows = [
        (None, f"{line}\nalpha beta gamma", None), (None, "nothing here repeats, nothing at all is lost from it", None), (None, line, "s"),
        (2, f"own head\n{line}", "s"), (2, "a second text under the same id, of which nothing repeats", "s"), (1, f"x\n{line}", "s"), (2, f"own head\n{line}", "s"),
    ]
    docs = documents(spark, rows).withColumn("_id", F.lit(1)).withColumn("_spans", F.lit(2)).withColumn("mark", F.lit(3)).withColumn("row", F.lit(4))
    want = [
        "\nalpha beta gamma", "nothing here repeats, nothing at all is lost from it", "", "own head\n", "a second text under the same id, of which nothing repeats", f"x\n{line}", "own head\n",
    ]
    got = lines.without(docs, lines.repeated(docs, min_words=3))
    assert got.columns == docs.columns and sorted(r["text"] for r in got.collect()) == sorted(["own head\n" if "own head" in t else t for t in want])
    # the same places in different texts of one id, and of null ids
    pairs = [(7, "one two\nthree\nfour", "s"), (7, "one two\nthree\nfive", "s"), (None, "one two\nthree\nsix", "s"), (None, "one two\nthree\nseven", "s")]
    for op in (lines.repeated, chunks.repeated):
        left = [r["text"] for r in lines.without(documents(spark, pairs), op(documents(spark, pairs))).collect()]
        assert sum("one two\nthree" in t for t in left) == 1 and {t.split("\n")[-1] for t in left} == {"four", "five", "six", "seven"}


def test_short_lines_are_units_unless_told_otherwise(spark):
    docs = documents(spark, [(i, "just nine words stand here in this very line", "s") for i in range(50)])
    assert lines.repeated(docs).count() == 49 and lines.repeated(docs, min_words=10).count() == 0
    assert sorted(len(r["text"]) for r in lines.without(docs, lines.repeated(docs)).collect())[-2:] == [0, 44]


def test_columns_of_any_name_pass_through(spark):
    docs = documents(spark, EDGES)
    for name in ("head", "_head", "row", "mark", "copy", "more", "epochs", "key", "id", "h", "spans", "start", "item", "words", "u.v"):
        docs = docs.withColumn(name, F.lit(5))
    bench = spark.createDataFrame([(1, "nowhere to be seen")], "item_id long, text string")
    for got in (mixing.mixed(docs), sharding.assign(docs, shard_col="s"), decontaminate.clean(docs, bench), lines.without(docs, lines.repeated(docs)), jaccard.one_of_each(docs)):
        rows = got.collect()
        assert got.columns[: len(docs.columns)] == docs.columns and rows and all(r["head"] == r["u.v"] == 5 for r in rows)


def test_matches_of_single_pairs_by_brute_force():
    r = random.Random(12)
    for n in range(300):
        item = [f"v{r.randrange(5 + n % 30)}".encode() for _ in range(r.randrange(1, 25))]
        own = [f"v{r.randrange(5 + n % 30)}".encode() for _ in range(r.randrange(1, 40))]
        lo = r.randrange(len(item))
        own[len(own) // 2 : len(own) // 2] = item[lo:] + own[:2] + item[:lo]
        tiles = tiles_by_hand(own, item, min(4, len(item)))
        covered = sum(t[2] for t in tiles)
        want = (covered, len(tiles), tiles[0][2]) if tiles and covered >= 0.6 * len(item) else None
        assert decontaminate.Text(own).match(item, 4, 0.6) == want
