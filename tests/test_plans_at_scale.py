"""Quantiles, rates, duplicates, covariances and scans: right results, and no task that holds what it shouldn't."""

import hashlib
import os
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.operators import catalog as C
from lumenflow.operators import kernels as K
from lumenflow.operators import timing as X
from lumenflow.operators.streams import Stream
from lumenflow.plans import load_all
from lumenflow.registry import QUERIES

load_all()


def interpolated(values, q):
    v = sorted(values)
    at = (len(v) - 1) * q
    low, high = v[int(at)], v[min(int(at) + (at > int(at)), len(v) - 1)]
    return low + (high - low) * (at - int(at))


SHARES = {"low": 0.0, "p01": 0.01, "p10": 0.1, "p50": 0.5, "p99": 0.99, "high": 1.0}


def test_quantiles_of_small_and_odd_groups(spark):
    rng = random.Random(1)
    groups = {None: [3.0], "two": [1.0, 2.0], "four": [4.0, 1.0, 2.0, 9.0], "ties": [5.0] * 70 + [6.0] * 31, "wide": [10.0**k for k in range(-300, 300, 7)] + [-(10.0**k) for k in range(-9, 9)], "many": [rng.gauss(0, 1) for _ in range(3000)] + [1e12, -1e12]}
    rows = [(k, v) for k, own in groups.items() for v in own] + [("two", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for accuracy, margin in ((X.ACCURACY, X.MARGIN), (100, 0.05)):
        got = {r.k: r for r in X.exact_quantiles(df, "k", "v", SHARES, accuracy, margin, salts=3).collect()}
        assert set(got) == set(groups)
        for k, own in groups.items():
            for name, q in SHARES.items():
                assert got[k][name] == pytest.approx(interpolated(own, q), rel=1e-12, abs=1e-12), (k, name)


def test_an_outlier_leaves_few_values_to_sort(spark):
    """200,000 values and one far off: what lies inside a bracket, and is sorted, is a small share of them."""
    df = spark.range(200_000).select(F.lit("a").alias("k"), (F.xxhash64("id") / 1e17).alias("v")).unionByName(spark.createDataFrame([("a", 1e12)], "k string, v double"))
    p = df.agg(F.percentile_approx("v", [0.5 - X.MARGIN, 0.5 + X.MARGIN], X.ACCURACY)).first()[0]
    assert 1 <= df.where(F.col("v").between(*p)).count() < 100
    got = X.exact_quantiles(df, "k", "v", {"p50": 0.5}).first().p50
    assert got == interpolated([r.v for r in df.collect()], 0.5)


def test_a_gap_of_a_year_is_laid_out_in_pieces(spark):
    df = spark.createDataFrame([("a", 1, "2023-01-01 00:00:00"), ("a", 2, "2024-01-01 00:00:00")], "k string, event_id long, t string").select("k", "event_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    out = X.at_rate(df, Stream(("k",)), 60)
    assert out.count() == 365 * 24 * 60 + 1 and out.select("slot").distinct().count() == 365 * 24 * 60 + 1
    assert Counter(r.event_id for r in out.groupBy("event_id").count().collect()) == {1: 1, 2: 1}


@pytest.mark.parametrize("hot", [10_000, 3, 0])
def test_duplicates_with_hot_contents(spark, hot):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 20 + ["", None, "a", "b", "c"] + [f"t{i}"] * 10)) for i in range(500)]
    got = {r.i: (r.dup_of, r.is_dup) for r in C.mark_duplicates(spark.createDataFrame(rows, "i long, t string"), "t", "i", hot).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(t or "", i)
    assert got == {i: (first[t or ""], first[t or ""] != i) for i, t in rows}


def test_covariance_of_vectors(spark):
    x = np.random.default_rng(3).normal(size=(500, 5)) @ np.random.default_rng(4).normal(size=(5, 5)) + 1e6
    rows = [(r.tolist(),) for r in x] + [([1.0, 2.0],), (None,), ([1.0, None, 2.0, 3.0, 4.0],)]
    df = spark.createDataFrame(rows, "e array<double>").repartition(7)
    got = {(r.i, r.j): r["cov"] for r in K.covariance(df, "e", 5).collect()}
    want = np.cov(x.T, bias=True)
    assert len(got) == 15 and all(abs(v - want[i, j]) < 1e-8 for (i, j), v in got.items())
    assert K.covariance(df.where("false"), "e", 5).count() == 0


def test_scan_noise_and_digests(spark, data):
    scanned = {r.file: r["size"] for r in QUERIES["directory_scan"](spark, data).collect()}
    assert scanned == {n: os.path.getsize(os.path.join(data, n)) for n in os.listdir(data) if n.endswith(".parquet")}
    e = spark.read.parquet(f"{data}/events.parquet").select("event_id", "value")
    n = QUERIES["noise"](spark, data).join(e, "event_id").select((F.col("uniform") - F.col("value")).alias("u"), (F.col("gaussian") - F.col("value")).alias("g")).collect()
    u, g = [r.u for r in n], [r.g for r in n]
    assert 0 <= min(u) and max(u) < 1 and abs(statistics.mean(u) - 0.5) < 0.05 and abs(statistics.pstdev(u) - 12**-0.5) < 0.02
    assert abs(statistics.mean(g)) < 0.15 and abs(statistics.pstdev(g) - 1) < 0.1
    again = QUERIES["noise"](spark, data).repartition(5).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, QUERIES["noise"](spark, data).collect()))
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in QUERIES["long_digests"](spark, data).limit(50).collect():
        html = pages[r.page_id].encode()
        assert (r.sha384, r.sha512, r.sha512_256) == (hashlib.sha384(html).hexdigest(), hashlib.sha512(html).hexdigest(), hashlib.new("sha512_256", html).hexdigest())


def test_many_murmur_hashes_are_those_of_each_alone():
    from lumenflow.functions import scalars as S

    rng = random.Random(6)
    data = [None if rng.random() < 0.05 else rng.randbytes(rng.choice([0, 1, 8, 9, 15, 16, 17, 32, 33, 100, 1000])) for _ in range(500)]
    for seed in (0, 725):
        assert S.murmur3_of(data, seed) == [None if d is None else S.murmur3_x64_128(d, seed) for d in data]
    assert S.murmur3_of([]) == []


def test_a_tree_of_directories(spark, tmp_path):
    from lumenflow.sources import formats

    for name, size in (("a.jpg", 3), ("one/b.png", 5), ("one/two/c d.gif", 7), ("one/two/e", 2), ("one/two/empty", 0), ("three/f.tar.gz", 11)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    got = {(r.path.split(tmp_path.name + "/")[1].replace("%20", " "), r["size"], r.is_dir) for r in formats.scan_tree(spark, str(tmp_path)).collect()}
    assert got == {("a.jpg", 3, False), ("one/b.png", 5, False), ("one/two/c d.gif", 7, False), ("one/two/e", 2, False), ("three/f.tar.gz", 11, False), ("one", 0, True), ("one/two", 0, True), ("three", 0, True)}
    newest = max(os.stat(tmp_path / "one" / "two" / n).st_mtime for n in ("c d.gif", "e"))
    times = {r.path.split("/")[-1]: r.mod_time for r in formats.scan_tree(spark, f"file://{tmp_path}").where("is_dir").collect()}
    assert times["two"] == int(newest)


def test_buckets_follow_the_input(spark, data, monkeypatch):
    from lumenflow.operators import ordering as O

    e = spark.read.parquet(f"{data}/events.parquet")
    assert 10_000 < O.input_bytes(e) < 10_000_000
    assert O.input_bytes(e.join(e.select("event_id"), "event_id")) < 20_000_000  # the files, not what a join might give
    units = []
    trunc = F.date_trunc
    monkeypatch.setattr(O.F, "date_trunc", lambda u, c: units.append(u) or trunc(u, c))
    want = {r.event_id: r.n for r in O.numbered(e, ["event_type"], "ts", ["event_id"]).collect()}
    assert units == ["day"]
    monkeypatch.setattr(O, "AUTO_BYTES", 1000)
    monkeypatch.setattr(O, "fitted_unit", lambda df, keys, ts, finer, fit=O.fitted_unit: fit(df, keys, ts, 4, finer))
    assert {r.event_id: r.n for r in O.numbered(e, ["event_type"], "ts", ["event_id"]).collect()} == want
    assert units[-1] in ("hour", "minute")


def test_a_burst_within_a_second_is_cut(spark):
    from lumenflow.operators import ordering as O

    df = spark.range(1000).select(F.lit("a").alias("k"), "id", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 20).alias("ts"))
    assert O.fitted_unit(df, ["k"], "ts", 1000) == "day" and O.fitted_unit(df, ["k"], "ts", 60) == "second" and O.fitted_unit(df, ["k"], "ts", 60, True) == "millisecond" and O.fitted_unit(df, ["k"], "ts", 1, True) == "microsecond"
    n = {r.id: r.n for r in O.numbered(df, ["k"], "ts", ["id"], unit="millisecond").collect()}
    assert n == {i: i for i in range(1000)}
