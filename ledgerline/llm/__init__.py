"""Training-data operators: each module holds one operator, its thin query and,
where SQL can express it, the query's DuckDB SQL.  Nothing else in the library
imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to executors by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def queries():
    from . import (chunks, decontaminate, dedup, jaccard, licenses, lines, mixing,
                   sharding, tokens, toxicity)

    return {
        "op1_mix": mixing.op1_mix,
        "op2_exact_dedup": dedup.op2_exact_dedup,
        "op3_shard": sharding.op3_shard,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_toxicity": toxicity.op5_toxicity,
        "toxicity_sentences": toxicity.toxicity_sentences,
        "op6_substring_dedup": lines.op6_substring_dedup,
        "substring_dedup_texts": lines.substring_dedup_texts,
        "op7_line_dedup": chunks.op7_line_dedup,
        "op8_jaccard_join": jaccard.op8_jaccard_join,
        "op9_token_counts": tokens.op9_token_counts,
        "op10_license_scan": licenses.op10_license_scan,
    }


def oracle_sql():
    from . import dedup, jaccard, licenses, lines, mixing, sharding

    return {
        "op1_mix": mixing.ORACLE_SQL,
        "op2_exact_dedup": dedup.ORACLE_SQL,
        "op3_shard": sharding.ORACLE_SQL,
        "op6_substring_dedup": lines.ORACLE_SQL,
        "substring_dedup_texts": lines.TEXTS_SQL,
        "op8_jaccard_join": jaccard.ORACLE_SQL,
        "op10_license_scan": licenses.ORACLE_SQL,
    }
