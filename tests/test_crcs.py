"""Mergeable CRCs against one pass over the joined bytes."""

import random

import pytest
from pyspark.sql import functions as F

from lumenflow.functions import scalars as S
from lumenflow.sources import formats as X

# The CRCs of the 1999 bytes (i + i * i) mod 256, and of the text 123456789, with their usual seeds.
SQUARES = {"CRC32_IEEE_LE": 0x3D5CDD04, "CRC32_IEEE": 0xC0F5BAE0, "CRC24": 0x396032, "CRC16_ANSI_LE": 0xBFD8, "CRC16_ANSI": 0x1FBB, "CRC8": 0xE3, "CRC8_EBU": 0xD6}
NINE = {"CRC32_IEEE_LE": (0xFFFFFFFF, 0xCBF43926 ^ 0xFFFFFFFF), "CRC32_IEEE": (0xFFFFFFFF, 0x0376E6E7), "CRC24": (0xB704CE, 0x21CF02), "CRC16_ANSI_LE": (0, 0xBB3D), "CRC16_ANSI": (0, 0xFEE8), "CRC16_CCITT": (0, 0x31C3), "CRC8": (0, 0xF4), "CRC8_EBU": (0, 0x37)}


def test_known_values():
    squares = bytes((i + i * i) & 255 for i in range(1999))
    for kind, want in SQUARES.items():
        assert S.crc_of([squares], *S.CRCS[kind], 0) == [want], kind
    for kind, (seed, want) in NINE.items():
        assert S.crc_of([b"123456789"], *S.CRCS[kind], seed) == [want], kind
    assert NINE.keys() == S.CRCS.keys()


@pytest.mark.parametrize("kind", sorted(S.CRCS))
def test_powers_undo_each_other(kind):
    bits, poly, low = S.CRCS[kind]
    one = 1 << (bits - 1) if low else 1
    for a, b in zip(S.byte_powers(kind, False), S.byte_powers(kind, True), strict=True):
        assert S._times(a, b, bits, poly, low) == one


@pytest.mark.parametrize("seed", [0, 0xFFFFFFFF, 0x1234])
def test_crcs_of_streams(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "b", None]), i, None if i % 50 == 7 else rng.randrange(0, 40 * 24), None if i % 11 == 3 else bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 300])))) for i in range(300)] + [("empty", 1000, 5, b""), ("empty", 1001, 6, None)]
    df = spark.createDataFrame(rows, "k string, i long, h long, data binary").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600))
    got = {r.k: r for r in X.stream_crcs(df, ["k"], "ts", ["i"], F.col("data"), {k: k for k in S.CRCS}, seed).collect()}
    assert set(got) == {"a", "b", None, "empty"}
    for k, r in got.items():
        joined = b"".join(d or b"" for _, _, _, d in sorted((x for x in rows if x[0] == k and x[2] is not None), key=lambda x: (x[2], x[1])))
        for kind, (bits, poly, low) in S.CRCS.items():
            assert r[kind] == S.crc_of([joined], bits, poly, low, seed & ((1 << bits) - 1))[0]
