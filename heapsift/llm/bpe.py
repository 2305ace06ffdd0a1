"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

Encoding looks a pre-token up in two tiers. First, a minimal perfect hash tells whether it is a token as a whole: hash and displace, where
each of about n / 3 buckets holds the displacement that sends its keys to free slots among n, and the token stored in the slot is compared.
Otherwise its bytes form a linked list, and a heap of adjacent pairs by (rank, place) gives the next pair to merge.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession

from .common import modest_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Pre-tokens that a worker remembers with their ids, and the longest of them in characters.
REMEMBERED, LONGEST = 300_000, 64
KEYS_PER_BUCKET = 3
M64 = (1 << 64) - 1


def read_ranks(data: bytes) -> list[bytes]:
    """The tokens by rank, of a file with lines of a base64 token and its rank; the ranks must be 0 to n - 1."""
    rows = dict((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in data.splitlines() if line))
    return [rows[i] for i in range(len(rows))]


def _slot(h: int, displacement: int, n: int) -> int:
    x = (h ^ (displacement * 0x9E3779B97F4A7C15)) & M64
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & M64
    return (x >> 32) * n >> 32


class PerfectHash:
    """A minimal perfect hash of tokens: n slots for n tokens. get() gives the rank of a token, None for other bytes."""

    def __init__(self, tokens: list[bytes]):
        n = len(tokens)
        self.n, self.buckets = n, max(1, n // KEYS_PER_BUCKET)
        by: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for rank, token in enumerate(tokens):
            h = xxhash.xxh64_intdigest(token)
            by[h % self.buckets].append((h, rank))
        self.displacement, self.rank, free = [0] * self.buckets, [-1] * n, [True] * n
        left = 0
        for b in sorted(range(self.buckets), key=lambda b: -len(by[b])):
            if len(by[b]) > 1:
                d = 1
                while True:
                    slots = [_slot(h, d, n) for h, _ in by[b]]
                    if all(free[s] for s in slots) and len(set(slots)) == len(slots):
                        break
                    d += 1
            elif by[b]:  # a key alone in its bucket takes any slot, which a negative number names
                while not free[left]:
                    left += 1
                slots, d = [left], -1 - left
            else:
                continue
            self.displacement[b] = d
            for s, (_, rank) in zip(slots, by[b], strict=True):
                free[s], self.rank[s] = False, rank
        self.token = [tokens[r] for r in self.rank]

    def get(self, token: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh64_intdigest(token)
        d = self.displacement[h % self.buckets]
        s = -1 - d if d < 0 else _slot(h, d, self.n)
        return self.rank[s] if self.token[s] == token else None


class Memory(dict):
    """Pre-tokens with their ids as bytes, worked out when first asked for. Holds the last REMEMBERED to twice as many."""

    def __init__(self, work_out: Callable[[bytes], bytes]):
        super().__init__()
        self.work_out, self.older = work_out, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.work_out(text.encode("utf-8", "surrogatepass"))
        if len(text) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class Codec:
    """Encoder and decoder of one vocabulary; what it remembers stays behind when it is pickled."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern, self.whole = tokens, pattern, PerfectHash(tokens)
        self.__setstate__(self.__dict__)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("tokens", "pattern", "whole")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        # White space as Unicode defines it, as the tokenizer libraries do.
        self.split = regex.compile(self.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.memory = Memory(self.piece)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: again and again the adjacent pair of least rank, the leftmost of equals, becomes one token."""
        n, get = len(piece), self.ranks.get
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n  # of the part that starts at an index
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop or not alive[j]:
                continue  # a part of this pair has changed meanwhile
            end[i], alive[j] = stop, False
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def piece(self, raw: bytes) -> bytes:
        """The ids of a pre-token as little-endian unsigned 32-bit integers."""
        whole = self.whole.get(raw)
        ids = self.merge(raw) if whole is None else [whole]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.memory.__getitem__, self.split(text or "")))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def load(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """The codec of a vocabulary file on the driver's machine, built once and broadcast: a few MB. A file of over 64 MB is refused."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path} is too large to broadcast")
    modest_batches(spark)
    return spark.sparkContext.broadcast(Codec(read_ranks(data), pattern))


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """For each row of documents: doc_id, n_tokens, ids (array<int>), ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the bytes that decoding the ids gives).

    A null text counts as empty and has no tokens. Special tokens in a text are ordinary text. Rows stay as they are, repeated ones and
    null doc_ids too; other columns are not read. Each row is worked out alone, without a shuffle; a text is never cut.
    """
    return documents.select("doc_id", "text").mapInPandas(_kernel(load(documents.sparkSession, path, pattern), True), "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def report(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """encode() without the ids themselves."""
    return documents.select("doc_id", "text").mapInPandas(_kernel(load(documents.sparkSession, path, pattern), False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _kernel(shared: Broadcast, with_ids: bool):
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = shared.value
        for part in batches:
            for at in range(0, len(part), 256):
                rows = part.iloc[at : at + 256]
                ids = [codec.encode(t) for t in rows["text"]]
                out = pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "n_tokens": [len(x) // 4 for x in ids]})
                if with_ids:
                    out["ids"] = [np.frombuffer(x, dtype="<i4") for x in ids]
                out["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in ids]
                out["decoded_sha256"] = [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]
                yield out

    return kernel
