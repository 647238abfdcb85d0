"""Problem 6: byte-level BPE encoding with a public vocabulary of ranks."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.session import spread

#: Where the public vocabularies lie; a parameter of every function that reads one.
TOKENIZERS = "/opt/tokenizers"
# The public pre-tokenization pattern of the byte_bpe vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker keeps; the table is emptied when full.
CACHE = 1 << 17


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file; a rank is also the token's id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class BytePairEncoder:
    """Encodes and decodes text. Strings that look like special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], cache: int = CACHE) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.pieces = regex.compile(PATTERN).findall
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_size = cache
        self._names: dict[int, bytes] | None = None

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; null and empty text give an empty list."""
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for piece in self.pieces(text):
            ids = cache.get(piece)
            if ids is None:
                ids = tuple(self.merge(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= 64:
                    if len(cache) >= self.cache_size:
                        cache.clear()
                    cache[piece] = ids
            out.extend(ids)
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Merge the bytes of one piece, lowest rank first, leftmost of equal ranks first.

        Symbols are a doubly linked list over byte positions; a heap holds (rank, start, end) of neighbouring
        symbols. An entry is stale when its start was merged into an earlier symbol or the neighbour now ends elsewhere.
        O(n log n) for a piece of n bytes.
        """
        ranks, n, longest = self.ranks, len(piece), self.longest
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        after = list(range(1, n + 1))
        alive = bytearray(b"\x01") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or end[j] != e:
                continue
            alive[j] = 0
            end[i] = e
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if end[k] - i <= longest and (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            h = before[i]
            if h >= 0 and e - h <= longest and (r := ranks.get(piece[h:e])) is not None:
                heapq.heappush(heap, (r, h, e))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = after[i]
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``: their vocabulary strings one after another."""
        if self._names is None:
            self._names = {i: b for b, i in self.ranks.items()}
        return b"".join(self._names[i] for i in ids).decode("utf-8", "replace")


_encoders: dict[str, BytePairEncoder] = {}


def _worker_encoder(key: str, ranks: dict[bytes, int]) -> BytePairEncoder:
    if key not in _encoders:
        _encoders[key] = BytePairEncoder(ranks)
    return _encoders[key]


def encoder_functions(spark: SparkSession, path: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column], Column]]:
    """Column functions (encode, count, decode) for the vocabulary at ``path``, which only the driver reads: the ranks
    (some 50,000 short byte strings, a fixed size) go to the executors as a broadcast."""
    ranks = spark.sparkContext.broadcast(load_ranks(path))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        coder = _worker_encoder(path, ranks.value)
        rows = [coder.encode(t) for t in texts.to_pylist()]
        offsets = np.zeros(len(rows) + 1, dtype=np.int32)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        values = np.fromiter((x for r in rows for x in r), dtype=np.int32, count=int(offsets[-1]))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        coder = _worker_encoder(path, ranks.value)
        return pa.array([len(coder.encode(t)) for t in texts.to_pylist()], type=pa.int64())

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        coder = _worker_encoder(path, ranks.value)
        return pa.array([None if r is None else coder.decode(r) for r in ids.to_pylist()], type=pa.string())

    return encode, count, decode


def encode_corpus(documents: DataFrame, text: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", out: str = "ids") -> DataFrame:
    """``documents`` with the ids of ``text`` in column ``out``; empty and null texts get an empty list.

    A column called ``out`` that exists already is replaced; all other columns stay. No shuffle but for a table of
    fewer splits than cores.
    """
    encode, _, _ = encoder_functions(documents.sparkSession, path)
    return spread(documents).withColumn(out, encode(F.col(text)))
