"""Dealing documents into blocks and their contents into buckets.

A block holds documents of a bounded number of bytes, dealt by doc_id; a bucket
holds what all blocks know of a share of the keys. Blocks send each distinct key
once, so a key that a third of all documents have comes to its bucket no more
often than there are blocks. Rows on the wire are packed arrays, one for each bucket
that a block has a key for: with very many buckets a message shrinks, down to one
key, and messages grow with the input, not with blocks times buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 14_000_000
WIRE = "key int, block int, a binary, b binary, c binary, d binary"


def block_count(rows: DataFrame, block_bytes: int = BLOCK_BYTES, least: int = 64) -> int:
    """Blocks for rows(text): by the bytes of all texts."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-size // block_bytes))


def in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """rows(doc_id, text, ...) with a column block; rows without an id are dealt by text."""
    return rows.withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks)).cast("int"))


def wire(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "block", "a", "b", "c", "d"])


def number(key: tuple[pa.Scalar, ...]) -> int:
    return key[0].as_py()


def joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def cuts(sorted_: np.ndarray) -> dict[int, slice]:
    """Where each number lies in a sorted array: only those that are there, so a block's messages are never more than its keys."""
    keys, first = np.unique(sorted_, return_index=True)
    return {int(k): slice(int(i), int(j)) for k, i, j in zip(keys, first, np.append(first[1:], len(sorted_)), strict=True)}


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group begins in it."""
    o = np.lexsort(keys[::-1])
    new = np.ones(len(o), bool)
    new[1:] = np.any([k[o][1:] != k[o][:-1] for k in keys], axis=0)
    return o, np.flatnonzero(new)


def is_in(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x
