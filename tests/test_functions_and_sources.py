import base64
import hashlib
import hmac
import random
import time
import zlib

from pyspark.sql import functions as F

from lumenflow.functions import scalars as S
from lumenflow.operators import catalog as C
from lumenflow.sources import formats as X

TEXTS = ["", "a", "hello world", "x" * 100, "é日本", None]


def one(spark, col, texts=TEXTS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def raw(t):
    return None if t is None else t.encode()


def test_digests(spark):
    t = F.col("t")
    assert one(spark, S.adler32(t, 0)) == [None if x is None else zlib.adler32(raw(x), 0) for x in TEXTS]
    assert one(spark, S.hmac(t, b"k")) == [None if x is None else hmac.new(b"k", raw(x), "sha256").hexdigest() for x in TEXTS]
    for a in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512", "blake2b"):
        assert one(spark, S.digest(t, a)) == [None if x is None else hashlib.new(a, raw(x)).hexdigest() for x in TEXTS]
    assert one(spark, S.base64_line(t)) == [None if x is None else base64.b64encode(raw(x)).decode() for x in TEXTS]
    assert one(spark, S.crc(t, "CRC32_IEEE_LE", 0xFFFFFFFF)) == [None if x is None else zlib.crc32(raw(x)) ^ 0xFFFFFFFF for x in TEXTS]


def test_crc_of_the_check_text(spark):
    assert one(spark, S.crc(F.col("t"), "CRC16_CCITT"), ["123456789"]) == [0x31C3]
    assert one(spark, S.crc(F.col("t"), "CRC32_IEEE_LE"), ["123456789"]) == [0x2DFD2D88]


def test_murmur_known_values():
    assert S.murmur3_x64_128(b"").hex() == "00000000000000000000000000000000"
    assert S.murmur3_x64_128(b"hello").hex() == "029bbd41b3a7d8cb191dae486a901e5b"


def test_url_decode_keeps_bad_escapes(spark):
    t = ["a%20b", "%zz", "100%", "a+b", "%C3%A9", None]
    assert one(spark, S.url_decode(F.col("t")), t) == ["a b", "%zz", "100%", "a+b", "é", None]
    assert one(spark, S.url_decode(F.col("t"), True), ["a+b%2B"]) == ["a b+"]


def test_dictionary_escapes(spark):
    out = one(spark, S.parse_dict(F.col("t")), ["a=b:c=d", r"k\=x=v\:w", "", "lone", None])
    assert out == [{"a": "b", "c": "d"}, {"k=x": "v:w"}, {}, {}, None]


def test_numbers(spark):
    row = spark.range(1).select(S.int_log2(F.lit(2**40)), S.int_log2(F.lit(2**40 - 1)), S.rescale(F.lit(-3), 1, 2), S.timestamp_text(F.lit(3003), 1, 30000), S.timestamp_text(F.lit(None).cast("long"))).first()
    assert list(row) == [40, 39, -2, "0.1001", "NOPTS"]
    assert one(spark, S.replay_gain(F.col("t")), ["-7.50 dB", "x", None, "1.2345678", "010.5", "0x10", "-.5", " .5", "99999 dB"]) == [-750000, 0, None, 123456, 850000, 1600000, 0, 50000, None]


def test_subtitles_round_trip(spark):
    rng = random.Random(2)
    cues = [(i, rng.randrange(10**8) // 40 * 40, rng.randrange(10**8) // 40 * 40, f"line {i}\nsecond") for i in range(50)]
    df = spark.createDataFrame(cues, "n long, start_ms long, end_ms long, text string")
    files = X.srt_blocks(df).select(F.lit("f").alias("file"), "value")
    assert sorted(map(tuple, X.parse_srt(files).drop("file").collect())) == sorted(cues)
    back = X.parse_subtitles(X.microdvd_lines(df, 25.0), "microdvd", 25.0)
    assert sorted(map(tuple, back.collect())) == sorted(c[1:] for c in cues)
    assert X.webvtt_blocks(df).where(F.col("value").contains(" --> ")).count() == 50
    lines = spark.createDataFrame([("[10][20]a|b",), ("noise",), ("[5][]c",)], "value string")
    assert [tuple(r) for r in X.parse_subtitles(lines, "mpl2").collect()] == [(1000, 2000, "a\nb"), (500, None, "c")]


def test_files_and_reports(spark, tmp_path):
    for n in ("a.JPG", "b.png", "d/c.txt", ".hidden", "plain"):
        p = tmp_path / "in" / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x" * len(n))
    files = X.scan_files(spark, str(tmp_path / "in"), [".jpg", ".png"])
    assert "content" not in files.columns
    assert sorted(r.ext for r in files.collect()) == [".jpg", ".png"]
    log = spark.createDataFrame([("p", True)], "file_path string, success boolean")
    for kind in ("json", "csv"):
        X.write_report(log, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["file_path", "success"]
    X.write_report(log, "", "json")
    ev = spark.createDataFrame([(i, i * 1000) for i in range(10)], "i long, s long").withColumn("ts", F.timestamp_seconds("s"))
    manifest = X.write_segments(ev, str(tmp_path / "seg"), 3600, "ts").orderBy("segment").collect()
    assert [r.rows for r in manifest] == [4, 4, 2]


def test_edge_extensions(spark):
    assert one(spark, C.extension(F.col("t")), ["a.tar.GZ", "dir.x/file", ".bashrc", "", "a."]) == [".gz", "", ".bashrc", "", "."]


def test_wave_source(spark):
    from lumenflow.sources.generated import WaveSource

    spark.dataSource.register(WaveSource)
    df = spark.read.format("wave").option("samples", 100).option("partitions", 3).load()
    assert df.count() == 100 and abs(df.where("n = 0").first().sample) < 1e-12


def test_metadata_keeps_line_ends_and_long_values(spark):
    from lumenflow.sources import formats as X

    rows = [("a\nb=" + "long key " * 3000, "first\nsecond = #;\\\n" + "x" * 50_000 + "\n"), ("k", "\n")]
    out = X.parse_metadata(X.metadata_lines(spark.createDataFrame(rows, "k string, v string"), "k", "v"))
    assert sorted(map(tuple, out.collect())) == sorted(rows)


def test_principal_components_diagonalise_the_covariance(spark, data):
    import numpy as np

    from lumenflow.operators import kernels as K

    v = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("e"))
    values, vectors = K.principal_components(v, "e", 64)
    x = np.array([r.e for r in v.collect()])
    cov, w = np.cov(x.T, bias=True), np.array(vectors)
    assert np.allclose(w @ w.T, np.eye(64), atol=1e-8) and np.allclose(w @ cov @ w.T, np.diag(values), atol=1e-8)
    assert values == sorted(values, reverse=True)


def test_least_squares_of_many_variables(spark):
    import numpy as np

    from lumenflow.operators import kernels as K

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    y = x @ [1, -2, 3, 0.5, -0.25] + rng.normal(size=300) * 0.01
    df = spark.createDataFrame([(1, *map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "k int, a double, b double, c double, d double, e double, y double")
    row = K.least_squares(df, "y", list("abcde"), ["k"]).first()
    assert np.allclose([row[f"c_{n}"] for n in "abcde"], np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-9)


def test_digests_against_plain_versions(spark):
    import hashlib
    import hmac
    import zlib

    texts = ["", "a", "hello world", "é" * 40, "x" * 1000, None]
    raw = [t.encode() if t is not None else None for t in texts]
    for algorithm in ("md5", "sha1", "sha256", "sha512"):
        for key in (b"key", b"k" * 200):
            assert one(spark, S.hmac(F.col("t"), key, algorithm), texts) == [hmac.new(key, t, algorithm).hexdigest() if t is not None else None for t in raw]
    for name in ("sha512_224", "sha512_256"):
        assert one(spark, S.digest(F.col("t"), name), texts) == [hashlib.new(name, t).hexdigest() if t is not None else None for t in raw]

    def plain(data, bits, poly, low, seed=0):
        v = seed
        for b in data:
            if low:
                v ^= b
                for _ in range(8):
                    v = v >> 1 ^ (poly if v & 1 else 0)
            else:
                v ^= b << (bits - 8)
                for _ in range(8):
                    v = (v << 1 ^ (poly if v >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
        return v

    for kind, (bits, poly, low) in S.CRCS.items():
        assert one(spark, S.crc(F.col("t"), kind), texts) == [plain(t, bits, poly, low) if t is not None else None for t in raw]
    assert one(spark, S.crc(F.col("t"), "CRC32_IEEE_LE", 0xFFFFFFFF), texts) == [zlib.crc32(t) ^ 0xFFFFFFFF if t is not None else None for t in raw]


def test_noise_depends_on_ids_alone(spark):
    from lumenflow.operators import kernels as K

    df = spark.range(20_000).repartition(7)
    row = df.select(F.avg(K.uniform_noise(F.col("id"), 3)), F.avg(K.gaussian_noise(F.col("id"), 3)), F.stddev_pop(K.gaussian_noise(F.col("id"), 3)), F.min(K.uniform_noise(F.col("id"), 3)), F.max(K.uniform_noise(F.col("id"), 3))).first()
    assert abs(row[0] - 0.5) < 0.01 and abs(row[1]) < 0.03 and abs(row[2] - 1) < 0.03 and 0 <= row[3] and row[4] < 1
    again = spark.range(5).select(K.uniform_noise(F.col("id"), 3).alias("u")).collect()
    assert [r.u for r in again] == [r.u for r in df.where("id < 5").orderBy("id").select(K.uniform_noise(F.col("id"), 3).alias("u")).collect()]


def test_escaped_dictionaries_and_escapes(spark):
    cases = {"a=b:c=d": {"a": "b", "c": "d"}, r"a=x\:y:b=1=2": {"a": "x:y", "b": "1=2"}, "plain": {}, "a=1:a=2": {"a": "2"}, r"k\=1=v": {"k=1": "v"}, "": {}, "a=": {"a": ""}}
    assert one(spark, S.parse_dict(F.col("t")), [*cases, None]) == [*cases.values(), None]
    urls = {"a%20b": "a b", "%zz%4": "%zz%4", "%E2%82%AC": "\u20ac", "%41%": "A%", "plain": "plain", "%ff!": "\ufffd!"}
    assert one(spark, S.url_decode(F.col("t")), [*urls, None]) == [*urls.values(), None]
    assert one(spark, S.url_decode(F.col("t"), plus=True), ["a+b"]) == ["a b"]


def test_reports_as_one_array(spark, tmp_path):
    import json

    from lumenflow.sources import formats as X

    X.write_report(spark.createDataFrame([(1, "a"), (2, None)], "id int, name string"), str(tmp_path / "r"), "json-array")
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
    assert json.loads(text) == [{"id": 1, "name": "a"}, {"id": 2}]


def test_sections_and_dictionaries_of_long_values(spark):
    """Values far longer than a regular expression could go through by recursion."""
    long_ = "text with = and \\ and : in it; " * 20_000
    files = spark.createDataFrame([("f", 1, "CHAPTER", [("k=ey", long_ + "\n#")])], "file string, n long, section string, entries array<struct<key: string, value: string>>")
    assert [tuple(r) for r in X.metadata_sections(X.metadata_files(files)).collect()] == [("f", 1, "CHAPTER", 0, "k=ey", long_ + "\n#")]
    printed = S.print_dict(F.create_map(F.lit("a"), F.col("t"), F.lit("b:"), F.lit("x")))
    assert one(spark, S.parse_dict(printed), [long_, "z" * 500_000]) == [{"a": long_, "b:": "x"}, {"a": "z" * 500_000, "b:": "x"}]


def test_wide_integers_beyond_64_bits(spark, tmp_path):
    from lumenflow.plans.scalars import wide_integers

    ids = [0, 1, -1, 81, 747_078, 747_079, 800_000, -800_001, 10**12, 2**63 - 1, -(2**63)]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    towards_zero = lambda x: abs(x) // 1000 * (1 if x >= 0 else -1)
    want = {}
    for i in ids:
        x = i * 12345678901234567
        want[i] = (str(x + 98765432109876543), str(towards_zero(x)), x - towards_zero(x) * 1000)
    assert {r.event_id: (r["product"], r.quotient, r.rest) for r in wide_integers(spark, str(tmp_path)).collect()} == want
    assert one(spark, S.wide_divide(F.col("t").cast("decimal(38,0)"), 10**6).cast("string"), ["9" * 38, "-" + "9" * 38, None]) == ["9" * 32, "-" + "9" * 32, None]


def test_plain_replay_gains_take_a_part_of_the_time(spark):
    """All kinds of texts as the general way reads them; plain numbers are read faster."""
    signs, wholes, ends = ["", "-", "+", " ", " \t-", "\n", "\n-", "+ ", "--"], ["", "0", "7", "07", "08", "0x1F", "0x", "0xg", "00", "100", "9999", "21474", "21475", "9" * 25], ["", ".", ".5", ".00001", ".83647", ".83648", ".999999", ".x", " dB", ".25 dB", "e3"]
    texts = [a + b + c for a in signs for b in wholes for c in ends] + [None, "none", "x5", "\u0665", "." * 50]
    assert one(spark, S.replay_gain(F.col("t")), texts) == one(spark, S._replay_gain_of_any(F.col("t")), texts)
    rows = spark.range(400_000).select(F.concat(F.lit("-"), (F.col("id") % 10_000).cast("string"), F.lit(".5 dB")).alias("t"))
    seconds = {}
    for way in (S._replay_gain_of_any, S.replay_gain) * 2:
        began = time.perf_counter()
        rows.select(way(F.col("t")).alias("g")).agg(F.sum("g")).collect()
        seconds[way] = min(seconds.get(way, 1e9), time.perf_counter() - began)
    assert 2 * seconds[S.replay_gain] < seconds[S._replay_gain_of_any]
