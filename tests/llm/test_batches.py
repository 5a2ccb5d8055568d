"""Rows go to Python in batches that are bounded by bytes."""

import pytest
from pyspark.sql import functions as F

from lumenflow.llm import common, minhash, quality, queries, sentencepiece_codec

KEY, ROW = "spark.sql.execution.arrow.maxBytesPerBatch", 4000


@pytest.fixture
def docs(spark):
    """12 MB in one partition, which a bound by rows hands over at once, under Spark's own settings."""
    before = spark.conf.get(KEY)
    spark.conf.unset(KEY)
    yield spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "id", F.lit("w" * ROW)).alias("text"))
    spark.conf.set(KEY, before)


def bounded(run):
    """run, where no batch is larger than its bound and a few rows; the buffers' own share counts to it."""
    most = common.BATCH_BYTES + 3 * ROW

    def checked(batches):
        def each():
            for b in batches:
                size = sum(len(x) for c in b.columns for x in c.to_pylist() if isinstance(x, str | bytes))
                assert size <= most, f"a batch of {size} bytes"
                yield b

        return run(each())

    return checked


def test_quality(docs):
    most = common.BATCH_BYTES + 3 * ROW

    class Model:
        def score(self, texts):
            import numpy as np

            assert sum(map(len, texts)) <= most, f"a batch of {sum(map(len, texts))} bytes"
            return np.ones(len(texts))

    assert quality.quality_filter(docs, Model()).count() == 3000


def test_quality_scores(docs, monkeypatch):
    made = quality._scores(quality.QualityModel(b"good", b"bad", (0.0,) * 7))
    monkeypatch.setattr(quality, "_scores", lambda model: bounded(made))
    assert quality.score_quality(docs, None).count() == 3000


def test_near_duplicates(docs, monkeypatch):
    made = minhash._signed(5)
    monkeypatch.setattr(minhash, "_signed", lambda k: bounded(made))
    assert minhash.near_duplicates(docs, 5).count() == 3000


def test_sentencepiece(docs, monkeypatch):
    made = sentencepiece_codec._digests(queries.vocabulary("piece_bpe_32k.model"))
    monkeypatch.setattr(sentencepiece_codec, "_digests", lambda path: bounded(made))
    assert sentencepiece_codec.encode_decode_digest(docs, "").count() == 3000


def test_a_smaller_bound_stays(spark, docs):
    spark.conf.set(KEY, "64k")
    common.batched(docs)
    assert spark.conf.get(KEY) == "64k"
