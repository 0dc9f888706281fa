"""Packing into optimal length buckets.

A text is cut into sequences of at most ``max_tokens`` tokens: its words, or what a tokenizer
counted (``token_counts.count_tokens`` gives such lengths). A dynamic programme over the
global histogram of sequence lengths chooses the bucket lengths that need the least padding, and
batches of a token budget form inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Scratch, slots

#: Tokens in a sequence at most; longer texts become several sequences.
MAX_TOKENS = 2048
#: Buckets, and tokens of a batch with its padding.
BUCKETS = 8
BUDGET = 16_384

_WORD = "[^\\x20\\x09-\\x0D]+"


def best_buckets(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` lengths for the least padding; a sequence goes to the first that holds it.

    Only lengths that occur can be boundaries. Exact, in buckets x lengths² steps; the number of
    lengths is bounded by the longest sequence, not by the data. Of equal plans the one whose
    earlier boundaries are smaller is taken.
    """
    lengths = sorted(n for n, c in histogram.items() if n > 0 and c > 0)
    if not lengths:
        return []
    size = np.array(lengths, dtype=np.int64)
    count = np.array([histogram[n] for n in lengths], dtype=np.int64)
    rows = np.concatenate([[0], np.cumsum(count)])
    tokens = np.concatenate([[0], np.cumsum(count * size)])
    n = len(lengths)
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    froms = []
    for _ in range(min(buckets, n)):
        new, came = np.full_like(best, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
        new[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + size[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            came[j] = int(cost.argmin())
            new[j] = cost[came[j]]
        froms.append(came)
        best = new
    out, j = [], n
    for came in reversed(froms):
        if j == 0:
            break
        out.append(int(size[j - 1]))
        j = int(came[j])
    return out[::-1]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): the words of each text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(_WORD)).cast("long").alias("n_tokens"))


def sequences(lengths: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens) of texts (doc_id, n_tokens); one without tokens, or of unknown length, has one sequence of none."""
    whole = lengths.select("doc_id", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("whole"))
    last = F.greatest(F.lit(0), F.ceil(F.col("whole") / max_tokens) - 1).cast("int")
    pieces = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("first_token", F.col("piece").cast("long") * max_tokens)
    return pieces.select("doc_id", "piece", "first_token", F.least(F.col("whole") - F.col("first_token"), F.lit(max_tokens)).cast("int").alias("n_tokens"))


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pack_lengths`` over the words of texts; null counts as empty, other columns aren't read."""
    return pack_lengths(word_counts(docs, id_col, text_col), max_tokens, buckets, budget)


def pack_lengths(lengths: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per sequence of the texts (doc_id, n_tokens): doc_id, piece, first_token, n_tokens, bucket_tokens, padding, batch, place.

    A sequence has its text's tokens from ``first_token`` on. ``bucket_tokens`` is the padded length, ``batch`` counts through all buckets from 0 and
    ``place`` is the row inside the batch. A text without tokens, or of null length, has one sequence of
    none that no batch holds (bucket_tokens, padding, batch and place are null). Repeated rows are
    packed as often as they occur, null ids like others; an empty table gives an empty result.
    """
    scratch = Scratch(lengths.sparkSession, "pack")
    rows = scratch.save(sequences(lengths, max_tokens), "sequences")
    # at most max_tokens + 1 rows come to the driver
    histogram = {r["n_tokens"]: r["count"] for r in rows.groupBy("n_tokens").count().collect()}
    bounds = best_buckets(histogram, buckets)
    if not bounds:
        return rows.select("doc_id", "piece", "first_token", "n_tokens", *[F.lit(None).cast(kind).alias(c) for c, kind in (("bucket_tokens", "int"), ("padding", "int"), ("batch", "long"), ("place", "int"))])
    bucket, low, first, each, start = None, 0, {}, {}, 0
    for bound in bounds:
        held = sum(c for n, c in histogram.items() if low < n <= bound)
        each[bound], first[bound] = max(1, budget // bound), start
        start += -(-held // each[bound])
        this = F.col("n_tokens") <= bound
        bucket = F.when(this, F.lit(bound)) if bucket is None else bucket.when(this, F.lit(bound))
        low = bound
    table = lambda of: F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[F.col("bucket_tokens")]
    filled = rows.where("n_tokens > 0").withColumn("bucket_tokens", bucket)
    placed = slots(filled, ["bucket_tokens"], ["doc_id", "piece", "n_tokens"], sum(histogram.values()))
    batches = placed.select(
        "doc_id",
        "piece",
        "first_token",
        "n_tokens",
        "bucket_tokens",
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
        (table(first) + F.floor(F.col("slot") / table(each))).cast("long").alias("batch"),
        (F.col("slot") % table(each)).cast("int").alias("place"),
    )
    return batches.unionByName(rows.where("n_tokens = 0"), allowMissingColumns=True)
