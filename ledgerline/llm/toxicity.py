"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

#: Labelled rows that a model is fitted on: at most so many of each class, in order of a hash of their id.
SAMPLE_EACH = 2500
#: Bytes of text that the sample of a class may hold; a text of over a sixteenth of that isn't fitted on. All texts are scored.
SAMPLE_BYTES = 1 << 24
#: Features that a model may have, and the lengths of the beginnings of words among them.
FEATURES, PREFIXES = 4000, (4, 5, 6)
THRESHOLD = 0.3
HELD_OUT = (4, 2)

#: Bytes: A-Z to lower case, what ends a sentence to a newline, other ASCII punctuation and control bytes to a space.
_ENDS = b".!?\n\r"
_FOLD = bytes(
    10 if c in _ENDS else c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def features(word: bytes) -> list[bytes]:
    """A word and its beginnings of 4 to 6 bytes, so that inflected and joined forms share weights."""
    return [word, *(word[:k] + b"*" for k in PREFIXES if len(word) >= k)]


def sentences(text: str | None) -> list[list[bytes]]:
    """The distinct words of each sentence that has any."""
    folded = (text or "").encode().translate(_FOLD)
    return [sorted(words) for s in folded.split(b"\n") if (words := set(s.split()))]


class _Weights(dict):
    """Word to weight, filled as words come, of bounded size."""

    def __init__(self, by_feature):
        self.by_feature = by_feature

    def __missing__(self, word):
        if len(self) >= 1_000_000:
            self.clear()
        value = self[word] = math.fsum(filter(None, map(self.by_feature.get, features(word))))
        return value


class Model:
    """P(document) = 1 - prod over sentences of (1 - sigmoid(bias + sum over its distinct words of their features' weights))."""

    def __init__(self, bias: float, weights: dict[bytes, float]):
        self.bias, self.weights, self.seen = bias, weights, _Weights(weights)

    def __reduce__(self):
        return Model, (self.bias, self.weights)

    def logits(self, folded: bytes) -> np.ndarray:
        get = self.seen.__getitem__
        return np.asarray([self.bias + math.fsum(filter(None, map(get, set(words)))) for s in folded.split(b"\n") if (words := s.split())], float)

    def score(self, text: str | None) -> float:
        return float(-np.expm1(-np.logaddexp(0, self.logits((text or "").encode().translate(_FOLD))).sum()))


def _screened(split, y) -> list[bytes]:
    """The features whose documents' labels differ most from the rest's, by chi-square."""
    seen, positive = Counter(), Counter()
    for doc, label in zip(split, y, strict=True):
        own = {f for w in {w for s in doc for w in s} for f in features(w)}
        seen.update(own)
        if label:
            positive.update(own)
    share = sum(y) / max(1, len(y))
    worth = {f: (positive[f] - n * share) ** 2 / n for f, n in seen.items() if n >= 3}
    return sorted(worth, key=lambda f: (-worth[f], f))[:FEATURES]


def fit(texts: list[str], labels: list[int], l1: float = 0.5, rounds: int = 150, rate: float = 0.15, weight=(1.0, 1.0)) -> Model:
    """Maximum likelihood of the documents' labels under the noisy-or of their sentences, with an
    L1 penalty on the features' weights: proximal gradient steps with running scales.

    ``weight``: what a document of class 0 and of class 1 counts. Copies of a text count once.
    """
    pairs = sorted({(t or "", int(y)) for t, y in zip(texts, labels, strict=True)})
    split = [sentences(t) for t, _ in pairs]
    y = np.asarray([label for _, label in pairs], float)
    names = _screened(split, y)
    place = {f: i for i, f in enumerate(names)}
    cols, row_of, doc_of = array("i"), array("i"), array("i")
    for d, doc in enumerate(split):
        for s in doc:
            known = [place[f] for w in s for f in features(w) if f in place]
            cols.extend(known)
            row_of.extend([len(doc_of)] * len(known))
            doc_of.append(d)
    cols, row_of, doc_of = (np.frombuffer(x, np.int32).astype(np.int64) if len(x) else np.zeros(0, np.int64) for x in (cols, row_of, doc_of))
    if not len(doc_of) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(math.log(max(share, 1e-4) / max(1 - share, 1e-4)) if len(y) else -5.0, {})
    counts = np.where(y == 1, weight[1], weight[0])
    w, bias = np.zeros(len(names)), math.log(max(1e-4, (counts * y).sum() / counts.sum()) / (len(doc_of) / len(pairs)))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(row_of, w[cols], minlength=len(doc_of))
        hazard = np.bincount(doc_of, np.logaddexp(0, z), minlength=len(pairs))
        pull = np.where(y == 1, -1 / np.expm1(np.clip(hazard, 1e-9, 500)), 1.0) * counts
        dz = pull[doc_of] / (1 + np.exp(-np.clip(z, -500, 500)))
        grad = np.append(np.bincount(cols, dz[row_of], minlength=len(names)), dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        scale = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
        w = w - scale[:-1] * m[:-1] / (1 - 0.9**step)
        w = np.sign(w) * np.maximum(0, np.abs(w) - scale[:-1] * l1)
        bias -= scale[-1] * m[-1] / (1 - 0.9**step)
    return Model(float(bias), {names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3)})


def held_out(id_col: Column, folds=HELD_OUT) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds[0] == folds[1], F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", sample_each: int = SAMPLE_EACH, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a sample of labelled rows outside the held-out fold, bounded in rows and in bytes: of each class
    at most ``sample_each`` rows, and of those as many, in order of a hash of their id, as ``sample_bytes`` hold.

    Rows without id, text or label are left out, and texts of over a sixteenth of ``sample_bytes``; of an id with
    several labels the larger counts, of one with several texts the least text. Extra columns aren't looked at. Without
    rows of both classes, as in an empty table, the model is a constant.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
        .where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    )
    present = docs.select(F.col(id_col).alias("id")).distinct()
    known = known.join(present, "id", "left_semi")
    share = known.groupBy("y").count().collect()
    sizes = {r["y"]: r["count"] for r in share}
    taken = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_each) for y in (0, 1)]
    chosen = taken[0].unionByName(taken[1])  # 2 * sample_each ids at most
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
        .join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    )
    rows = stash(rows.withColumn("size", F.octet_length("text").cast("long")).where(F.col("size") <= sample_bytes // 16), "toxicity-sample")
    so_far = F.sum("size").over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
    fit_in = rows.select("id", "y", "size").withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes)
    rows = rows.join(F.broadcast(fit_in.select("id")), "id").select("text", "y").collect()
    weight = tuple(max(1.0, sizes.get(y, 0) / sample_each) for y in (0, 1))
    least = min(weight)
    return fit([r["text"] for r in rows], [r["y"] for r in rows], weight=tuple(x / least for x in weight))


def score(text: Column, model: Model) -> Column:
    """The model's probability for a text; null and empty texts have no sentence and score 0."""
    @F.arrow_udf("double")
    def noisy_or(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in texts.to_pylist()], pa.float64())

    return noisy_or(text)


def offending(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """The sentences that carry a document's score: (id, start, end, score), offsets in UTF-8 bytes.

    Null and empty texts have none; rows that repeat have theirs each; null ids stay null; a very long text is read
    whole, sentence by sentence; extra columns aren't looked at; an empty table gives no rows.
    """
    @F.arrow_udf("array<struct<start:int,end:int,score:double>>")
    def locate(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            folded, found = (text or "").encode().translate(_FOLD), []
            for m in re.finditer(rb"[^\n]+", folded):
                if len(z := model.logits(m.group())) and (p := float(1 / (1 + np.exp(-z[0])))) >= threshold:
                    found.append({"start": m.start(), "end": m.end(), "score": p})
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))

    rows = docs.select(F.col(id_col).alias("id"), F.explode(locate(F.col(text_col))).alias("s"))
    return rows.select("id", "s.start", "s.end", "s.score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence that alone reaches the threshold: (doc_id, start_byte, end_byte, score); edge cases as in ``offending``."""
    docs = table(spark, sf_dir, "documents")
    found = offending(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "score")
