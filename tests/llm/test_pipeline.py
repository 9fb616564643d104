import random

import corpus_pipeline


def test_stages_on_a_small_corpus(spark, tmp_path):
    r = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    item = " ".join(r.choices(words, k=30))
    rows, labels = [], []
    for i in range(300):
        text = ". ".join(" ".join(r.choices(words, k=10)) for _ in range(6))
        if i % 5 == 0:
            text += ". vilegrot " + r.choice(words)
        labels.append((i, 1, int(i % 5 == 0)))
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    rows.append((1000, rows[1][1] + " tail", "en", "src0", 1))
    rows.append((1001, f"before {item} after", "en", None, 1))
    rows += [(1002, None, None, None, None), rows[2]]
    for name, data, kind in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item)], "item_id long, text string"),
    ):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(stage(spark, docs, str(tmp_path)), f"test-{name}")
        kept[name] = [x["doc_id"] for x in docs.collect()]
        assert docs.columns == columns + ["shard"] * (name == "sharding")
    clean = {i for i in range(300) if i % 5}
    assert set(kept["toxicity"]) == clean | {1000, 1001, 1002}
    assert sorted(kept["near_duplicates"]) == sorted(clean | {1001, 1002})
    assert set(kept["decontamination"]) == clean | {1002}
    assert kept["mixing"] and set(kept["mixing"]) <= clean and sorted(kept["sharding"]) == sorted(kept["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["mixing"])
