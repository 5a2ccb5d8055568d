"""What the operators of this folder share: scratch tables, and vectorised words and hashes of Arrow text.

Texts are handled as UTF-8 bytes in numpy. A word is a maximal run of bytes
other than space and \\t..\\r, after lower-casing A-Z only.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles at a time; a longer text is a step of its own.
STEP_BYTES = 1 << 19
#: Bytes of a batch of rows on its way to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 1 << 21
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SEPARATOR_PATTERN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset a local session gets a temporary folder; on a cluster that is an error."""
    if set_ := spark.conf.get("spark.checkpoint.dir", ""):
        return set_.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="lumenflow-"))
    return f"file://{_own_folder[0]}"


#: Scratch tables that this process has written and not yet removed.
_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place for a scratch table in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def scratch_tables() -> list[str]:
    return list(_scratch)


def remove_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables, for when what was made from them is written."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in _scratch:
            _scratch.remove(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read back: computed once, and safe when executors are lost. It stays until remove_scratch."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batched(df: DataFrame) -> DataFrame:
    """df, with its session set to hand rows to Python in batches of BATCH_BYTES, or of what the session has if that is less.

    Spark's own bound is by rows, and ten thousand texts are tens of MB or, where they
    are long, a GB, which executor and worker each hold several times.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key)) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32 of doc_id as text, mod k; a null doc_id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % k


def size_mb(df: DataFrame) -> float:
    """Bytes that the plan's optimiser expects, in MB: for files, their size."""
    return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 1e6


# --- Arrow text as bytes ---------------------------------------------------


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, and offsets of its rows in them (one more than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def steps(offs: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to about `most` bytes each, one row at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_rng = np.random.Generator(np.random.PCG64(20240229))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of code[byte] * base**i, from which hash_spans takes the hash of any span of bytes."""
    n = len(data)
    if len(_powers[0]) < n + 1:
        m = max(n + 1, STEP_BYTES + 1)
        for k, f in enumerate((_BASE, _INVERSE)):
            p = np.full(m, f, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[data] * _powers[0][:n], out=s[1:])
    return s


def hash_spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * _powers[1][start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def hash_grams(sums: np.ndarray, width: int) -> np.ndarray:
    """hash_spans of every span of `width` bytes, by slices in place of lookups."""
    n = len(sums) - width
    h = sums[width:] - sums[:n]
    h *= _powers[1][:n]
    h += np.uint64(width * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return h


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; data and offs as from raw()."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = _IS_WORD[data]
    before, after = np.zeros(len(w), bool), np.zeros(len(w), bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    inner = offs[(offs > 0) & (offs < len(w))]
    before[inner], after[inner - 1] = False, False
    start, end = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and its row."""
    start, end, row = words(data, offs)
    return hash_spans(prefix_sums(LOWERED[data]), start, end), row


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words and their rows; a row of fewer words gives its whole sequence as one."""
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    turn = [np.uint64(pow(0xA0761D6478BD642F, j + 1, 1 << 64)) for j in range(k)]
    m = len(hashes) - k + 1
    if m > 0:
        at = np.flatnonzero(row[: max(m, 0)] == row[k - 1 :])
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h += hashes[at + j] * turn[j]
        out, own = mixed(h), row[at]
    else:
        out, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = n[short] > j
            h[has] += hashes[first[short[has]] + j] * turn[j]
        h += n[short].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
        out, own = np.concatenate([out, mixed(h)]), np.concatenate([own, short])
        o = np.argsort(own, kind="stable")
        out, own = out[o], own[o]
    return out, own
