"""Quality by compression.

Two zstandard dictionaries are built, one from texts labelled good and one from
texts labelled bad. A text is cut into blocks, each block is compressed with
either dictionary, and the difference of the two sizes over the text's size,
with the sizes themselves, is turned into a score by a logistic calibration.

Dictionaries and calibration are fitted on a bounded sample of labelled rows, at
most `per_class` of each label, whose whole texts are used and stay in Spark.
Dictionaries are trained in tasks, each from a slice of blocks; those of several
slices are cut into blocks and trained from in turn, until one is left. What comes
to the driver are two dictionaries and the features of the calibration rows, which
are computed in tasks. Scoring covers whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, stored

#: Bytes of a block: short enough for a dictionary to matter in each.
BLOCK = 2048
LEVEL = 3
#: Blocks that one task trains a dictionary from, at most about twice as many.
SLICE = 3000


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def features(self, texts: list[bytes]) -> np.ndarray:
        import zstandard as zstd

        make = lambda d: zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False)
        good, bad = make(self.good), make(self.bad)
        out = np.zeros((len(texts), 3))
        for i, t in enumerate(texts):
            g = b = 0
            for at in range(0, len(t), BLOCK):
                part = t[at : at + BLOCK]
                g += len(good.compress(part))
                b += len(bad.compress(part))
            n = max(1, len(t))
            out[i] = (b - g) / n, g / n, b / n
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return _logistic(_expanded(self.features(texts)) @ np.array(self.weights))


def _expanded(f: np.ndarray) -> np.ndarray:
    d, g, b = f.T
    return np.column_stack([np.ones(len(f)), 10 * d, g, b, 10 * d * g, g * g, (g == 0)])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Newton steps of a weighted ridge-regularised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _logistic(x @ w)
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _own_blocks(texts: DataFrame, made_from: DataFrame) -> DataFrame:
    """quality, block: the texts of made_from in blocks of BLOCK bytes, without lines that several of the texts have.

    A line that several documents have would be learnt by heart, for the label of whichever side has more of it.
    """
    lines = lambda rows: rows.select("doc_id", "quality", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    once = lines(texts).groupBy(F.xxhash64("line").alias("h")).agg(F.countDistinct("doc_id").alias("n")).where("n = 1").select("h")
    own = lines(made_from).join(once, F.xxhash64("line") == F.col("h"), "left_semi")
    whole = own.groupBy("doc_id", "quality").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    whole = whole.select("doc_id", "quality", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").cast("binary").alias("text")).where(F.octet_length("text") > 0)
    return whole.select("doc_id", "quality", "text", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / BLOCK).cast("int"))).alias("at")).select(
        "quality", F.xxhash64("doc_id", "at").alias("o"), F.substring(F.col("text"), F.col("at") * BLOCK + 1, F.lit(BLOCK)).alias("block")
    )


def _trained(dict_bytes: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        import zstandard as zstd

        parts = [bytes(b) for _, b in sorted(zip(table.column("o").to_pylist(), table.column("block").to_pylist(), strict=True))]
        parts = parts * (1 + 200 // len(parts))
        try:
            made = zstd.train_dictionary(dict_bytes, parts, level=LEVEL).as_bytes()
        except zstd.ZstdError:  # too little text for training: the text itself is the dictionary
            made = b"".join(parts)[-dict_bytes:]
        return pa.table({"quality": pa.array([key[0].as_py()], pa.int32()), "slice": pa.array([key[1].as_py()], pa.int64()), "made": pa.array([made], pa.binary())})

    return run


def _dictionaries(blocks: DataFrame, dict_bytes: int) -> dict[int, bytes]:
    """A dictionary for each label from all of blocks(quality, o, block), slice by slice and then from the slices' dictionaries."""
    if SLICE * BLOCK < 4 * dict_bytes:
        raise ValueError("a slice must be several times larger than its dictionary")
    while True:
        counts = {r.quality: r.n for r in blocks.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
        slices = {q: -(-n // SLICE) for q, n in counts.items()}
        number = F.lit(0).cast("long")
        for q, n in slices.items():
            number = F.when(F.col("quality") == q, F.pmod("o", F.lit(n).cast("long"))).otherwise(number)
        made = stored(blocks.groupBy(F.col("quality").cast("int").alias("quality"), number.alias("slice")).applyInArrow(_trained(dict_bytes), "quality int, slice long, made binary"), "dictionaries")
        if all(n <= 1 for n in slices.values()):
            return {r.quality: bytes(r.made) for r in made.collect()}
        cut = made.select("quality", "slice", "made", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("made") - 1) / BLOCK).cast("int"))).alias("at"))
        blocks = cut.select("quality", F.xxhash64("slice", "at").alias("o"), F.substring(F.col("made"), F.col("at") * BLOCK + 1, F.lit(BLOCK)).alias("block"))


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = 3000, dict_bytes: int = 65536, seed: int = 7) -> QualityModel:
    """A model from docs(doc_id, text) and labels(doc_id, quality), where quality is 0 or 1.

    The sample is the per_class rows of each label with the smallest hash of
    doc_id, so it doesn't depend on partitions. Half of it makes the
    dictionaries, the other half fits the calibration, at the labels' own rates.
    Null ids, texts and labels are left out; of rows that repeat an id the greatest
    text counts, of labels the smallest. Texts are used whole, however long. Without
    a few rows of both labels the score is the rate of label 1 (one half without any).
    """
    known = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(seed))
    picked = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked = F.broadcast(picked)  # 2 * per_class rows of two numbers at most
    rows = docs.where("text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text")).join(picked, "doc_id").groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
    texts = stored(rows, "quality-sample")
    turn = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2))
    blocks = stored(_own_blocks(texts, texts.where(turn == 0)), "quality-blocks")
    made = _dictionaries(blocks, dict_bytes)
    rate = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    bias = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    constant = QualityModel(b"good", b"bad", (bias, 0, 0, 0, 0, 0, 0))
    if not (made.get(0) and made.get(1)):
        return constant
    model = QualityModel(made[1], made[0], ())
    fitted = batched(texts).where(turn == 1).select("doc_id", "quality", "text").mapInArrow(_featured(model), "doc_id long, quality int, d double, g double, b double").collect()
    fitted.sort(key=lambda r: r["doc_id"])
    y = np.array([r["quality"] for r in fitted], float)
    if min((y == q).sum() for q in (0, 1)) < 4:
        return constant
    x = _expanded(np.array([(r["d"], r["g"], r["b"]) for r in fitted]))
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum()) / sum(counts.values()) * len(y)
    return QualityModel(model.good, model.bad, tuple(map(float, _fit_logistic(x, y, weight))))


def _featured(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = model.features([x or b"" for x in b.column(2).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.float64()) for c in f.T]], names=["doc_id", "quality", "d", "g", "b"])

    return run


def _scores(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(texts), pa.float64())], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row of docs, taken one by one.

    Null counts as the empty text, which has a score too. Very long texts are
    compressed whole, block by block. An empty table gives no rows; other columns are
    ignored; repeated rows each get their row.
    """
    rows = batched(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_scores(model), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_filter(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs without the rows predicted 0, with their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column(b.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(model.score(texts) >= threshold))

    return batched(docs).mapInArrow(run, docs.schema)
