"""The queries of this subpackage, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers

from marlstone.llm import bpe, embedding_dedup, exact_dedup, near_dedup, packing, passage_dedup, sharding, substring_dedup, token_counts, toxicity
from marlstone.session import table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op6_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_passage_dedup(spark, sf_dir):
    cut = passage_dedup.passage_dedup(table(spark, sf_dir, "documents"))
    return cut.drop("kept_text")


def op9_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_substring_dedup, op3_toxicity, op4_packing, op5_near_dedup, op6_sharding, op7_byte_bpe, op8_passage_dedup, op9_embedding_dedup, op10_token_counts)}
ORACLES = {"op1_exact_dedup": exact_dedup.ORACLE}
