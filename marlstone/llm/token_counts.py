"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is run through the merges alone; those that end as one token
are whole. A pre-token that is whole counts one without merging; only the rest is merged.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.bpe import LONG, REMEMBERED, PreTokens, newer_characters
from marlstone.llm.common import once

#: Tokens beyond which a text is over the limit.
LIMIT = 512


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves; the others follow from U+0100 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file of the tokenizers library: merges by rank, added tokens, whole strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        known = model["type"] == "BPE" and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["normalizer"] is None
        if not known or model.get("ignore_merges") or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only plain byte-level BPE files are read here")
        self.special = [t["content"] for t in spec["added_tokens"]]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        back = {letter: bytes([b]) for b, letter in self.letters.items()}
        self.whole: set[str] = set()
        for token in model["vocab"]:
            if token not in self.special and merged_size(token, self.ranks) == 1:
                try:
                    self.whole.add(b"".join(back[x] for x in token).decode())
                except UnicodeDecodeError:
                    pass  # part of a character: no text's pre-token


def merged_size(letters: str, ranks: dict[tuple[str, str], int]) -> int:
    """How many tokens the merges leave of a string, in n log n steps."""
    n = len(letters)
    parts: list[str | None] = list(letters)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, k, parts[k], parts[k + 1]) for k in range(n - 1) if (rank := ranks.get((parts[k], parts[k + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, k, a, b = heapq.heappop(heap)
        if parts[k] != a or (j := after[k]) >= n or parts[j] != b:
            continue
        parts[k], parts[j] = a + b, None
        after[k] = after[j]
        if after[k] < n:
            before[after[k]] = k
        left -= 1
        if (i := before[k]) >= 0 and (rank := ranks.get((parts[i], parts[k]))) is not None:
            heapq.heappush(heap, (rank, i, parts[i], parts[k]))
        if (j := after[k]) < n and (rank := ranks.get((parts[k], parts[j]))) is not None:
            heapq.heappush(heap, (rank, k, parts[k], parts[j]))
    return left


class _Sizes(dict):
    """Pre-token to its number of tokens: whole strings are there from the start."""

    def __init__(self, whole: set[str], ranks: dict, letters: dict[int, str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.ranks, self.letters = whole, ranks, letters

    def __missing__(self, piece: str) -> int:
        n = merged_size("".join(map(self.letters.__getitem__, piece.encode())), self.ranks)
        if len(piece) <= LONG:
            if len(self) > REMEMBERED + len(self.whole):
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = n
        return n


class Counter:
    def __init__(self, special: list[str], whole: set[str], ranks: dict, letters: dict[int, str], pattern: str, newer: str):
        self.special, self.pieces, self.sizes = special, PreTokens(pattern, newer), _Sizes(whole, ranks, letters)

    def count(self, text: str) -> int:
        """Added strings inside a text are tokens of their own, as the library does by default."""
        parts = [text]
        n = 0
        for special in self.special:
            split = [x.split(special) if special in x else [x] for x in parts]
            n += sum(len(x) - 1 for x in split)
            parts = [x for some in split for x in some]
        size = self.sizes.__getitem__
        return n + sum(sum(map(size, some)) for part in parts for some in self.pieces.of(part))


def count_tokens(docs: DataFrame, vocabulary_path: str, pattern: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; ``pattern`` is the one that the vocabulary's byte-level step applies.

    Null counts as empty: no bytes, no tokens. Repeated rows and null ids give rows of their own;
    no other column is read. Several added strings that overlap are not told apart as the library
    would; a vocabulary with one has no such case.
    """
    vocabulary = Vocabulary(vocabulary_path)
    # the broadcast is the vocabulary: its size does not depend on the data
    shared = once(docs.sparkSession.sparkContext.broadcast((vocabulary.special, vocabulary.whole, vocabulary.ranks, vocabulary.letters, pattern, newer_characters())), Counter)

    def run(batches):
        counter = shared()
        for batch in batches:
            n = [counter.count(text.as_py() or "") for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
