"""Token counts through a digest cache.

Each text is known by the SHA-256 of its normalised content, each tokenizer by
the SHA-256 of its file. Stored counts are joined by the two digests; distinct
texts without a count are encoded, each once, and appended to the cache as a new
generation of Parquet files in the shared folder.

Counts are those of the exact text, so the only normalisation that keeps them
right is: null becomes the empty text, and the text is taken as UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def _bytes_of(token: str) -> bytes:
    """A byte-level token's bytes: printable Latin-1 characters stand for themselves, the other bytes, in order, for U+0100 and on."""
    return bytes(_BYTES[c] for c in token)


_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {chr(b): b for b in _PLAIN} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}


def _same_rules(spec: dict, ranks: dict[bytes, int]) -> bool:
    """Whether a tokenizer file says just what merge ranks and the public pattern say: nothing is normalised, all added tokens are special ones that are matched as they stand, the vocabulary is the ranks, byte string by byte string, and these tokens, and merges come in the order of the ranks that they make."""
    model, pre, added = spec.get("model") or {}, spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
    rules = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or not rules or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    names = {t["content"] for t in added}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    try:
        vocabulary = {_bytes_of(w): i for w, i in model["vocab"].items() if w not in names}
        made = [ranks[_bytes_of(a) + _bytes_of(b)] for a, b in merges]
    except (KeyError, ValueError):  # a character that stands for no byte, or a merge that makes no token
        return False
    return vocabulary == ranks and made == sorted(set(made)) and len(made) == len(ranks) - 256


@lru_cache(2)
def _encoder(json_path: str, ranks_path: str | None):
    """A function from a list of texts to their token counts, as the tokenizers library gives them.

    With ranks_path (the same vocabulary as merge ranks), texts whose characters
    are all below U+0250 go through tiktoken, which gives the same tokens several
    times faster: the two libraries split such texts alike, and the file is held
    against the rules that tiktoken follows first. Any other text, and all texts if
    the file has other rules, go through the tokenizers library itself.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    whole.no_truncation()
    whole.no_padding()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))} if ranks_path else {}
    spec = json.loads(Path(json_path).read_bytes())
    if not ranks or not _same_rules(spec, ranks):
        return lambda texts: [len(e) for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def count(texts: list[str]) -> list[int]:
        return [len(fast.encode(t, allowed_special="all")) if t.isascii() or max(t) < "\u0250" else len(whole.encode(t, add_special_tokens=False)) for t in texts]

    return count


def _count_batches(json_path: str, ranks_path: str | None, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(json_path, ranks_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(texts), pa.string()), pa.array(count(texts), pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    return run


def tokenizer_version(json_path: str) -> str:
    return hashlib.sha256(Path(json_path).read_bytes()).hexdigest()


def new_cache(spark) -> str:
    """A place for an empty cache in the shared folder."""
    return f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}"


def _generations(spark, cache: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")) for s in fs.listStatus(path)) if fs.exists(path) else 0


def token_counts(docs: DataFrame, cache: str, json_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs; counts not yet in the cache are added to it.

    Null counts as the empty text (0 bytes, 0 tokens). Very long texts are encoded
    whole. Repeated rows each get their row. The order of rows is free. An empty table gives no rows, and adds
    nothing. Generations are numbered: a second writer at the same time fails on
    writing its generation, and may run again.
    """
    spark = docs.sparkSession
    version = tokenizer_version(json_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    known = lambda n: spark.read.schema(CACHE_SCHEMA).parquet(*[f"{cache}/{i:06d}" for i in range(n)]).where(F.col("tokenizer") == version)
    n = _generations(spark, cache)
    misses = rows.select("digest", "t")
    if n:
        misses = misses.join(known(n).select("digest"), "digest", "left_anti")
    misses = misses.groupBy("digest").agg(F.first("t").alias("t"))  # copies fold before the shuffle, so a text with many copies is light
    misses.mapInArrow(_count_batches(json_path, ranks_path, version), CACHE_SCHEMA).write.mode("error").parquet(f"{cache}/{n:06d}")
    counts = known(n + 1).select("digest", "n_tokens")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    return sized.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def merged_cache(spark, cache: str) -> str:
    """A new cache whose one generation holds all that the given one does, for when generations have become many; the old one stays until no reader needs it."""
    n = _generations(spark, cache)
    new = new_cache(spark)
    if n:
        spark.read.schema(CACHE_SCHEMA).parquet(*[f"{cache}/{i:06d}" for i in range(n)]).write.mode("error").parquet(f"{new}/000000")
    return new
