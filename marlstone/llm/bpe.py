"""Byte-level BPE by backtracking over longest matches, and the exact way back.

A pre-token's bytes, written as Latin-1, go once through an Aho-Corasick automaton that gives
the longest vocabulary string at every position. The encoder takes the longest match, accepts
it if the merges would really leave it beside the token before (a memoised test on pairs), else
tries its next shorter prefix, else takes the last token back. A position from which no encoding
can start is marked, so that the work stays linear in the length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import once

#: Pre-tokens, and pairs of tokens, that a worker remembers; beyond that it forgets them all.
REMEMBERED = 400_000
#: Longer pre-tokens aren't remembered.
LONG = 64
#: Characters of a text whose pre-tokens are held at once.
SLICE = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def newer_characters() -> str:
    """Letters and numbers of ``regex`` that the libraries' older Unicode tables don't know, as a class's body.

    The libraries' view is asked for with a vocabulary of single bytes, whose encoder keeps
    only what a pattern matches.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([k]): k for k in range(256)}
    odd: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        encoding = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
        known = set()
        for k in range(0, len(every), 1 << 16):
            known.update(bytes(encoding.encode_ordinary(every[k : k + (1 << 16)])).decode())
        odd |= set(regex.findall(kind, every)) ^ known
    ranges: list[list[int]] = []
    for c in sorted(map(ord, odd)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges)


class PreTokens:
    """Matches of a pattern in whole texts, with the libraries' view of letters and numbers."""

    def __init__(self, pattern: str, newer: str):
        self.plain = regex.compile(pattern)
        self.newer = regex.compile(f"[{newer}]") if newer else None
        without = lambda p: p.replace(r"[^\s\p{L}\p{N}]", f"(?:[{newer}]|[^\\s\\p{{L}}\\p{{N}}])").replace(r"?\p{L}+", f"?(?:(?![{newer}])\\p{{L}})+").replace(r"?\p{N}+", f"?(?:(?![{newer}])\\p{{N}})+")
        self.exact = regex.compile(without(pattern)) if newer else self.plain

    def of(self, text: str) -> Iterator[list[str]]:
        """The matches in order, in lists of a bounded length."""
        found = self.plain if self.newer is None or text.isascii() or not self.newer.search(text) else self.exact
        if len(text) <= SLICE:
            yield found.findall(text)
            return
        some: list[str] = []
        for match in found.finditer(text):
            some.append(match[0])
            if len(some) == SLICE // 4:
                yield some
                some = []
        yield some


class BacktrackEncoder:
    """Exact merges of a byte-level vocabulary, piece by piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.strings = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.shorter: dict[int, int | None] = {}
        for token, rank in ranks.items():
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), None)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for rank in sorted(self.strings):
            self._split(rank)
        self.fits.clear()

    def _split(self, rank: int) -> None:
        """The pair whose merge makes ``rank``: two lower ranks that stay as they are side by side."""
        token = self.strings[rank]
        left = self.shorter[rank]
        while left is not None:
            right = self.ranks.get(token[self.size[left] :])
            if right is not None and left < rank and right < rank and self._stay(left, right):
                self.merged[left, right] = rank
                self.halves[rank] = (left, right)
                return
            left = self.shorter[left]
        self.halves[rank] = (rank, rank)

    def _stay(self, left: int, right: int) -> bool:
        """Whether the merges, run over both strings together, leave just these two tokens.

        It walks the inner edges of both tokens' merge trees from the top: a merge across the
        border that has a lower rank than the tokens still to be built would have come first.
        """
        limit = 1 << 60
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < limit:
                return False
            if left > right:
                limit, left = left, self.halves[left][1]
                if left == limit:
                    limit, right = right + 1, self.halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.halves[right][0]
                if right + 1 == limit:
                    limit, left = left, self.halves[left][1]
                    if left == limit:
                        return True

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            known = self.fits[pair] = self._stay(left, right)
        return known

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        end = len(piece)
        longest = [-1] * end
        for last, rank in self.automaton.iter(piece.decode("latin-1")):
            first = last + 1 - self.size[rank]
            if longest[first] < 0 or self.size[rank] > self.size[longest[first]]:
                longest[first] = rank
        open_at = bytearray(b"\1") * (end + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < end:
            to = at + self.size[token]
            if open_at[to] and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                at = to
                if at < end:
                    token = longest[at]
            elif (less := self.shorter[token]) is not None:
                token = less
            else:
                open_at[at] = 0
                token = ids.pop()
                at -= self.size[token]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))


class _Packed(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encoder: BacktrackEncoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoder.encode(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONG:
            if len(self) > REMEMBERED:
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    """What a worker needs: pre-tokens, encoder and memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, newer: str):
        self.pieces, self.encoder = PreTokens(pattern, newer), BacktrackEncoder(ranks)
        self.packed = _Packed(self.encoder)

    def encode(self, text: str) -> bytes:
        known = self.packed.__getitem__
        return b"".join(b"".join(map(known, some)) for some in self.pieces.of(text))

    def decode(self, packed: bytes) -> bytes:
        return self.encoder.decode(memoryview(packed).cast("I").tolist())


def share(spark, ranks: dict[bytes, int], pattern: str) -> Callable[[], Codec]:
    """A function that gives each worker process its one codec.

    The vocabulary is broadcast: its size is that of the file, whatever the data.
    """
    return once(spark.sparkContext.broadcast((ranks, pattern, newer_characters())), Codec)


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each text's token ids, without special tokens.

    Null counts as empty, an empty text has an empty list. Rows are taken as they are: repeated
    rows and null ids give rows of their own, and no other column is read.
    """
    shared = share(docs.sparkSession, read_ranks(ranks_path), pattern)

    def run(batches):
        codec = shared()
        for batch in batches:
            ids = [memoryview(codec.encode(text or "")).cast("I").tolist() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<long>")


def decode_ids(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, data): the bytes of each row's ``ids``; a null list counts as empty."""
    shared = share(tokens.sparkSession, read_ranks(ranks_path), pattern)

    def run(batches):
        codec = shared()
        for batch in batches:
            data = [codec.encoder.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass over the texts."""
    shared = share(docs.sparkSession, read_ranks(ranks_path), pattern)
    digest: Callable[[bytes], str] = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches):
        codec = shared()
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1):
                packed = codec.encode(text.as_py() or "")
                n.append(len(packed) // 4)
                ids.append(digest(packed))
                decoded.append(digest(codec.decode(packed)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
