"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 7).

A text is cut into words by the vocabulary's pattern. A word's bytes form a
doubly linked list of symbols; a priority queue holds the merges of neighbours
by rank and place. The least entry is popped and skipped if either symbol has
changed since it was pushed; else the two become one and merges with the new
neighbours are pushed. A word of n bytes costs n log n however long it is.
Words repeat, so each task remembers the ids of words it has met, up to
REMEMBERED of them. Decoding concatenates the vocabulary's strings.

The vocabulary (BOUND bytes at most, checked) is read on the driver and
broadcast; executors need no file. Special tokens' strings are ordinary text.

Defined results: an empty and a null text have the empty list; lone surrogates
are replaced as in UTF-8 encoding with replacement; ids of no symbol decode to
nothing; a null list decodes to null.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import spread

#: The split pattern of the byte_bpe_50k vocabulary (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 500_000
BOUND = 64 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(BOUND + 1)
    if len(data) > BOUND:
        raise ValueError(f"{path} has more than {BOUND} bytes")
    return data


def ranks_of(vocabulary: bytes) -> dict[bytes, int]:
    """Symbol to rank; the file has a line of base64 and rank per symbol."""
    return {base64.b64decode(symbol): int(rank) for symbol, rank in (line.split() for line in vocabulary.splitlines() if line)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word."""
    whole = ranks.get(word)
    if whole is not None and len(word) == 1:
        return [whole]
    n = len(word)
    symbol: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = []
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            queue.append((rank, i, 1, 1))
    heapify(queue)
    while queue:
        _, i, size, next_size = heappop(queue)
        left = symbol[i]
        if left is None or len(left) != size:
            continue
        j = after[i]
        if j < 0 or len(symbol[j]) != next_size:
            continue
        both = left + symbol[j]
        symbol[i], symbol[j] = both, None
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            rank = ranks.get(both + symbol[k])
            if rank is not None:
                heappush(queue, (rank, i, len(both), len(symbol[k])))
        h = before[i]
        if h >= 0:
            rank = ranks.get(symbol[h] + both)
            if rank is not None:
                heappush(queue, (rank, h, len(symbol[h]), len(both)))
    return [ranks[s] for s in symbol if s is not None]


def encoder(vocabulary: bytes, pattern: str = PATTERN) -> Callable[[str | None], list[int]]:
    """A function from text to ids that remembers words."""
    ranks, words, known = ranks_of(vocabulary), regex.compile(pattern), {}

    def encode(text: str | None) -> list[int]:
        ids: list[int] = []
        if text:
            for word in words.findall(text):
                found = known.get(word)
                if found is None:
                    found = merge(word.encode("utf-8", "replace"), ranks)
                    if len(word) <= 64:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[word] = found
                ids += found
        return ids

    return encode


def decoder(vocabulary: bytes) -> Callable[[list[int] | None], str | None]:
    symbols = {rank: symbol for symbol, rank in ranks_of(vocabulary).items()}
    return lambda ids: None if ids is None else b"".join(symbols.get(i, b"") for i in ids).decode("utf-8", "replace")


def _broadcast(spark: SparkSession, path: str | None):
    return spark.sparkContext.broadcast(read_vocabulary(path or default_path()))


def encode_column(df: DataFrame, key: str, text: str = "text", path: str | None = None, lengths_only: bool = False) -> DataFrame:
    """(key, ids array<int>) of every row, or (key, n_tokens int)."""
    vocabulary = _broadcast(df.sparkSession, path)
    key_type = df.schema[key].dataType.simpleString()

    def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.value)
        for batch in batches:
            lists = [encode(t) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            if lengths_only:
                out = pa.array(sizes.astype(np.int32))
            else:
                flat = np.fromiter((i for ids in lists for i in ids), np.int32, int(sizes.sum()))
                out = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], [key, "n_tokens" if lengths_only else "ids"])

    schema = f"`{key}` {key_type}, " + ("n_tokens int" if lengths_only else "ids array<int>")
    return spread(df.select(key, F.col(text).cast("string").alias("text")), key).mapInArrow(encode_batches, schema)


def decode_column(df: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text string) of every row."""
    vocabulary = _broadcast(df.sparkSession, path)
    key_type = df.schema[key].dataType.simpleString()

    def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(vocabulary.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(i) for i in batch.column(1).to_pylist()], pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(decode_batches, f"`{key}` {key_type}, text string")
