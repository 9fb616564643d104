"""Token counts of whole texts, by batches that return lengths only."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_worker, table

LIMIT = 512
BATCH_CHARS = 1 << 18
LONG = 1 << 16

#: Where a byte-level BPE pre-tokenizer always starts a new piece, whatever stands around:
#: before a lone space that joins two non-spaces, and on either side of such a lone newline.
_SAFE = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def parts(text: str, long: int = LONG):
    """``text`` in parts that start at safe boundaries, so that their token counts add up to its own: a text of up to
    ``long`` characters whole, of a longer one parts that end at the first such boundary from there on."""
    at = 0
    while len(text) - at > long and (found := _SAFE.search(text, at + long)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def counter(path: str, batch_chars: int = BATCH_CHARS, long: int = LONG):
    """A function from texts to token counts. It fills batches of about ``batch_chars`` with the parts of short and long
    texts alike, so that each call to the library has the same work, and keeps nothing of them but lengths."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def batches(texts):
        batch, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            for part in [text] if any(s in text for s in special) else parts(text, long):
                batch.append((i, part))
                size += len(part)
                if size >= batch_chars:
                    yield batch
                    batch, size = [], 0
        if batch:
            yield batch

    def count(texts: list[str | None]) -> list[int]:
        totals = [0] * len(texts)
        for batch in batches(texts):
            for (i, _), e in zip(batch, tokenizer.encode_batch_fast([part for _, part in batch], add_special_tokens=False), strict=True):
                totals[i] += len(e)
        return totals

    return count


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text as the tokenizer file at ``path`` counts them (executors read it there).

    Null and empty texts have 0; a text is never truncated.
    """
    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        count = per_worker(("tokens", path), lambda: counter(path))
        return pa.array(count(texts.to_pylist()), pa.int64())

    return tokens(text)


def token_counts(docs: DataFrame, path: str, id_col="doc_id", text_col="text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row for each row of ``docs``; repeated rows and
    null ids count as any other, an empty table gives no rows, extra columns aren't looked at."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary)).withColumnRenamed("id", "doc_id")
