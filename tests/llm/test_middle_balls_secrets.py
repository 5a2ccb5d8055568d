"""Fill-in-middle, ball k-means and the secret scan against plain versions, and on awkward tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.llm import ball_kmeans as balls
from lumenflow.llm import common
from lumenflow.llm import fill_in_middle as fim
from lumenflow.llm import secret_scan as secrets_

SCHEMA = "doc_id long, text string"
AWKWARD = [(0, ""), (1, " "), (2, "a"), (3, "é日本 😀\nx"), (3, "é日本 😀\nx"), (4, "has <S> within"), (5, None), (None, "no id"), (None, None), (6, "lines\nof\n\ntext here " * 400), (7, "x" * 3000), (8, "almost <P or M> <")]


def docs_of(spark, rows):
    extra = {"form": F.lit("f"), "output": F.lit(None).cast("string"), "tokens": F.lit(1), "base": F.lit("b"), "n": F.lit(3), "h1": F.lit(0), "t": F.lit("t")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra)


# Fill-in-middle -------------------------------------------------------------


@pytest.mark.parametrize("unit", sorted(fim.UNITS))
def test_ropes_split_and_join_as_lists_of_units_do(monkeypatch, unit):
    monkeypatch.setattr(fim, "LEAF", 7)
    rng = random.Random(3)

    def depth(r):
        if r is None or r[fim.RIGHT] is None:
            return 1 if r else 0
        a, b = depth(r[fim.LEFT]), depth(r[fim.RIGHT])
        assert abs(a - b) <= 1
        return 1 + max(a, b)

    for _ in range(800):
        text = "".join(rng.choice("ab \n\té😀<P") for _ in range(rng.randrange(0, 120)))
        units = list(text) if unit == "char" else [m[0] for m in fim.UNITS[unit].finditer(text)]
        r = fim.rope(text, unit)
        assert (r[fim.U], r[fim.P]) == (len(units), len(text)) if r else not text
        k = rng.randrange(0, len(units) + 2)
        a, b = fim.split(r, k, fim.U, unit)
        assert (fim.text_of(a), fim.text_of(b)) == ("".join(units[:k]), "".join(units[k:]))
        depth(a), depth(b), depth(fim.concat(b, a))
        form, n, _, out = (recipe := fim.Recipe(unit=unit)).forward(text, tuple(rng.randrange(1 << 32) for _ in range(4)))
        assert n == len(units) and recipe.backward(out, form) == text


def plain_middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_in_middle_as_plain(spark):
    rng = random.Random(4)
    rows = AWKWARD + [(i, "".join(rng.choice("abc <SPM>é😀\n") for _ in range(rng.randrange(0, 200)))) for i in range(10, 400)]
    docs = docs_of(spark, rows)
    made = fim.fill_in_middle(docs)
    want = Counter((i, *plain_middle(i, t)) for i, t in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()) == want
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    digests = Counter((r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.fim_digest(docs).collect())
    assert digests == Counter((i, sha(plain_middle(i, t)[4]), sha(t)) for i, t in rows)
    assert fim.fim_digest(docs.where("false")).count() == 0


@pytest.mark.parametrize("unit", ["word", "line"])
def test_fill_in_middle_cuts_at_units_and_comes_back(spark, unit):
    recipe = fim.Recipe(unit=unit, plain=0, spm=50, prefix="[pre]", suffix="[suf]", middle="[mid]")
    docs = spark.createDataFrame([(i, " ".join(f"w{i}.{j}" + "\n" * (j % 5 == 0) for j in range(i % 40 + 1))) for i in range(120)], SCHEMA)
    made = fim.fill_in_middle(docs, recipe).collect()
    back = {r.doc_id: r.text for r in fim.restore(fim.fill_in_middle(docs, recipe).withColumn("text", F.lit(0)), recipe).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert back == texts and {r.form for r in made} == {"psm", "spm"}
    for r in made:
        ends = [m.end() for m in fim.UNITS[unit].finditer(texts[r.doc_id])]
        ends = [0, *ends]
        assert r.n == len(ends) - 1 and r.prefix_chars == ends[r.prefix_units] and r.prefix_chars + r.middle_chars == ends[r.prefix_units + r.middle_units]


def test_sentinels_that_could_be_mistaken_are_refused():
    for a, b, c in (("<P>", "<P>", "<M>"), ("<P>", "P", "<M>"), ("aba", "x", "y"), ("", "x", "y"), ("ab", "ca", "y")):
        with pytest.raises(ValueError):
            fim.Recipe(prefix=a, suffix=b, middle=c)


def test_restoring_nulls(spark):
    rows = spark.createDataFrame([(1, None, "psm"), (2, "x", None), (3, "<S>c<P>a<M>b", "spm")], "doc_id long, output string, form string")
    assert {r.doc_id: r.text for r in fim.restore(rows).collect()} == {1: None, 2: None, 3: "abc"}


def test_a_very_long_text_is_cut_like_others(spark):
    text = "é long text " * 200_000
    r = fim.fim_digest(spark.createDataFrame([(1, text)], SCHEMA)).first()
    n, form, a, m, out = plain_middle(1, text)
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, a, m, hashlib.sha256(out.encode()).hexdigest())
    assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()


# Ball k-means ---------------------------------------------------------------


@pytest.mark.parametrize("most", [3, 40, 1 << 26])
def test_balls_give_what_comparing_with_all_gives(most):
    rng = np.random.default_rng(most)
    for _ in range(60):
        k, d, n = rng.integers(1, 12), rng.integers(1, 6), rng.integers(1, 300)
        x, c = rng.integers(-most, most, (n, d)), rng.integers(-most, most, (k, d))
        brute = ((x[:, None, :] - c[None]) ** 2).sum(2)
        before = np.where(rng.random(n) < 0.8, brute.argmin(1), rng.integers(0, k, n))
        own, dist, _ = balls.assign_balls(x, before, c, balls._distances(c, c))
        assert (own == brute.argmin(1)).all() and (dist == brute.min(1)).all()


def test_most_comparisons_are_spared_where_clusters_are_apart():
    rng = np.random.default_rng(7)
    c = rng.integers(-10_000, 10_000, (40, 8))
    own = rng.integers(0, 40, 5000)
    x = c[own] + rng.integers(-60, 60, (5000, 8))
    got, _, compared = balls.assign_balls(x, own, c, balls._distances(c, c))
    assert (got == own).all() and compared < 5000


def plain_kmeans(rows, k, rounds):
    """rows of (vec_id, tuple of whole numbers), in Python's own numbers."""
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), i) for i, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for i in range(len(c)):
            members = [v for (_, v), o in zip(rows, own, strict=True) if o == i]
            if members:
                c[i] = tuple(sum(col) // len(members) for col in zip(*members, strict=True))
    return c, [(i, *reversed(near(v))) for i, v in rows]


def test_ball_kmeans_as_plain(spark):
    rng = random.Random(9)
    spots = [[rng.uniform(-2, 2) for _ in range(4)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(spots)]) for i in range(500)]
    rows += [(500 + i, [0.5, 0.5, -0.5, 0.25]) for i in range(260)]  # one vector that a third of all rows hold
    rows += [(3, rows[3][1]), (3, [9.0, 0.0, 0.0, -1e300]), (None, [0.0, 0.0, 0.0, 1e-9]), (None, [0.0, 0.0, 0.0, -1e-9])]
    left = [(900, [1.0, 2.0, 3.0]), (901, [1.0, 2.0, 3.0, 4.0, 5.0]), (902, None), (903, [1.0, None, 2.0, 3.0]), (904, [1.0, float("nan"), 2.0, 3.0]), (905, [float("inf"), 0.0, 0.0, 0.0]), (906, [])]
    df = spark.createDataFrame(rows + left, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "cluster": F.lit("c"), "x": F.lit(2), "distance": F.lit(0)})
    vectors = balls.whole_vectors(df, dim=4)
    bound = balls.bound(4)
    whole = [(i, tuple(max(-bound, min(bound, math.floor(256 * x) if abs(256 * x) < bound else int(math.copysign(bound, x)))) for x in v)) for i, v in rows]
    assert Counter((r.vec_id, tuple(r.v)) for r in vectors.collect()) == Counter(whole)
    older = set(common.scratch_tables())
    out, clusters = balls.ball_kmeans(vectors, k=12, rounds=3)
    assert len(set(common.scratch_tables()) - older) == 1
    c, want = plain_kmeans(whole, 12, 3)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in out.collect()) == Counter(want)
    assert [tuple(r.centroid) for r in clusters.orderBy("cluster").collect()] == c
    for r in balls.cluster_digest(out, clusters.where("cluster <> 99")).collect():
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()
    moved = {r.vec_id: (r.cluster, r.distance) for r in balls.nearest(vectors.where("vec_id >= 10"), clusters).collect()}
    assert all(moved[i] == (k, d) for i, k, d in want if i in moved)


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 1.0])], "vec_id long, embedding array<float>")
    out, clusters = balls.ball_kmeans(balls.whole_vectors(df, dim=2), k=40)
    got = {r.vec_id: (r.cluster, r.distance) for r in out.collect()}
    assert clusters.count() == 3 and got[1] == got[2] and got[1][1] == 0 and got[3][0] != got[1][0]
    assert clusters.where("members = 0").select(F.sum("inertia")).first()[0] == 0  # the second of two equal centroids
    out, clusters = balls.ball_kmeans(balls.whole_vectors(df, dim=3))
    assert out.count() == 0 and balls.cluster_digest(out, clusters).count() == 0


# Secrets --------------------------------------------------------------------


def plain_base(text):
    keyword = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    out = [(m.start(), 0, m.end()) for m in keyword.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def plain_p(token, name):
    """The three tests of one token, spelt out."""
    letters, text = secrets_.ALPHABETS[name], token.rstrip("=")
    n, m, values = len(text), len(letters), [letters.index(c) for c in text]
    bins = max(2, min(m, n // 5))
    chi = 0.0
    for b in range(bins):
        due = n * sum(v * bins // m == b for v in range(m)) / m
        chi += (sum(v * bins // m == b for v in values) - due) ** 2 / due
    k, lam = bins - 1, n * secrets_.DIVERGENCE
    h = 1 - 2 / 3 * (k + lam) * (k + 3 * lam) / (k + 2 * lam) ** 2
    p, mm = (k + 2 * lam) / (k + lam) ** 2, (h - 1) * (1 - 3 * h)
    even = -((chi / (k + lam)) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * mm * p))) / (h * math.sqrt(2 * p) * (1 + 0.5 * mm * p))
    kind = lambda c: 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3
    shares = [sum(kind(c) == j for c in letters) / m for j in range(4)]
    q, t = sum(s**2 for s in shares), sum(s**3 for s in shares)
    changes = sum(kind(a) != kind(b) for a, b in zip(text, text[1:]))
    runs = (changes - secrets_.CHANGES * (n - 1) * (1 - q)) / math.sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * (t - q * q))
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    r = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:])) / spread if spread else 1.0
    free = (math.atanh(secrets_.CORRELATION) - math.atanh(min(abs(r), 0.999999))) * math.sqrt(n - 3)
    above = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    worst, both = min(even, runs, free), above((even + runs + free) / math.sqrt(6))
    return both if worst > 0 else max(both, above(worst))


def test_noncentral_scores_against_simulation():
    rng = np.random.default_rng(5)
    for df, shift in ((3, 16.0), (7, 30.0), (12, 51.0)):
        drawn = rng.noncentral_chisquare(df, shift, 200_000)
        for share in (0.01, 0.1, 0.5, 0.9):
            z = secrets_._noncentral_score(np.array([np.quantile(drawn, share)]), np.array([float(df)]), np.array([shift]))
            assert abs(float(secrets_._normal_above(-z)[0]) - share) < 0.01


def random_token(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


def test_p_values_as_plain_and_apart():
    rng = random.Random(6)
    for k, (name, letters) in enumerate(secrets_.ALPHABETS.items()):
        tokens = [random_token(rng, letters, rng.randrange(20, 90)) for _ in range(60)]
        got = secrets_.p_values(tokens, [k] * 60)
        assert np.allclose(got, [plain_p(t, name) for t in tokens], rtol=1e-9, atol=0)
        assert np.median(secrets_.p_values([random_token(rng, letters, 64) for _ in range(200)], [k] * 200)) < 1e-5
    ordinary = ["internationalizationof", "getUserAccountBalanceFromService", "snake_case_name_of_function_2024", "0123456789abcdef0123456789abcdef", "AAAAAAAAAAAAAAAAAAAAAAAA", "my-long-css-class-name-with-parts"]
    assert min(secrets_.p_values(ordinary, [secrets_.encoding_of(t) for t in ordinary])) > 0.5
    assert secrets_.encoding_of("12345678901234567890") is None and secrets_.encoding_of("a/b-c" * 5) is None


def secret_docs():
    rng = random.Random(8)
    b62, b64 = secrets_.ALPHABETS["base62"], secrets_.ALPHABETS["base64"]
    rows = [(i, f"plain prose number {i} with internationalization{'abcdefgh'[i % 8]}s and moreLongerIdentifierNumber{i} in it") for i in range(60)]
    planted = {}
    for i in range(100, 130):
        token = random_token(rng, b62 if i % 2 else b64, 40 if i < 120 else 64)
        rows.append((i, f"é😀 the deploy uses {token} since May"))
        planted[i] = (19, 19 + len(token))
    rows += [(200, 'PassWord: "hunter22" and token token = abcdef, secret: token: abcdefg api_key=x'), (201, "AKIA" + "A1B2C3D4E5F6G7H8 AKIAshort AKIAKIA"), (202, "deadbeef" * 3 + " beef " + "0a" * 11), (203, "ſecret: abcdefghi toKen=abcdefgh"), (204, None), (205, ""), (None, "token=abcdef"), (100, rows[60][1])]
    return rows, planted


def test_secrets_as_plain(spark):
    rows, planted = secret_docs()
    found = secrets_.find_secrets(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, tuple((x.s, x.k, x.e) for x in sorted(r.base))) for r in found) == Counter((i, tuple(plain_base(t or ""))) for i, t in rows)
    # The tests' spans: a plain Benjamini-Hochberg over distinct tokens by stratum.
    tokens = {}
    for i, t in dict.fromkeys(rows):
        base = plain_base(t or "")
        for m in secrets_.TOKEN.finditer(t or ""):
            if not any(s <= m.start() and m.end() <= e for s, _, e in base) and (k := secrets_.encoding_of(m[0])) is not None:
                p = 10 ** (-math.floor(-math.log10(plain_p(m[0], secrets_._NAMES[k])) * secrets_.STEPS) / secrets_.STEPS)
                tokens.setdefault((i, t), []).append((m.start(), m.end(), m[0], p, sum(len(m[0]) >= n for n in secrets_.STRATA)))
    distinct = {}
    for own in tokens.values():
        for *_, text, p, stratum in own:
            distinct.setdefault(stratum, {})[text] = p
    bar = {}
    for stratum, own in distinct.items():
        ps = sorted(own.values())
        bar[stratum] = max((p for j, p in enumerate(ps, 1) if p <= secrets_.FALSE_SHARE * sum(q <= p for q in ps) / len(ps)), default=-1)
    want = Counter((i, tuple((s, e) for s, e, _, p, stratum in tokens.get((i, t), []) if p <= bar[stratum])) for i, t in rows)
    assert Counter((r.doc_id, tuple((x.s, x.e) for x in r.random)) for r in found) == want
    got = {r.doc_id: [(x.s, x.e) for x in r.random] for r in found if r.random}
    assert set(got) <= set(planted) and len(got) >= 0.95 * len(planted)
    assert all(got[i] == [planted[i]] for i in got)


def test_secrets_digest_and_redaction(spark):
    rows, planted = secret_docs()
    docs = docs_of(spark, rows)
    digest = {r.doc_id: r for r in secrets_.secrets_digest(secrets_.find_secrets(docs)).collect()}
    assert digest[200].n_assign == 2 and digest[201].n_access == 1 and digest[202].n_hex == 1 and digest[203].n_assign == 0
    listed = ",".join(f"{secrets_.BASE[k]}:{s}:{e}" for s, k, e in plain_base(rows[90][1]))
    assert rows[90][0] == 200 and digest[200].base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and digest[200].spans == listed
    assert digest[204].spans == digest[205].spans == "" and digest[100].spans == f"random:{planted[100][0]}:{planted[100][1]}"
    clean = {r.doc_id: r.text for r in secrets_.redact_secrets(docs).collect()}
    assert clean[100] == "é😀 the deploy uses [secret] since May" and clean[0] == rows[0][1] and clean[204] == ""
    assert clean[202] == "[secret] beef " + "0a" * 11 and None not in clean
    assert secrets_.secrets_digest(secrets_.find_secrets(docs.where("false"))).count() == 0


def test_secrets_in_a_very_long_text(spark):
    text = "word and number 12 " * 60_000 + "token = abcdef0123 " + "ab" * 200_000
    r = secrets_.secrets_digest(secrets_.find_secrets(spark.createDataFrame([(1, text)], SCHEMA))).first()
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 0, 1) and r.spans.startswith(f"assign:{19 * 60_000}:")


def test_a_long_text_full_of_secrets_takes_no_time_squared(spark):
    import time

    text = "".join(f"token = abcdef{i:06d} and notInside{'abcdefgh'[i % 8] * 20} {i:032x} " for i in range(20_000))
    began = time.perf_counter()
    (batch,) = secrets_._scan(iter([__import__("pyarrow").RecordBatch.from_pydict({"doc_id": [1], "t": [text]})]))
    assert time.perf_counter() - began < 20
    assert len(batch.column(1)[0].as_py()) == 40_000 and len(batch.column(2)[0].as_py()) == 20_000


def test_thresholds_go_by_stratum():
    assert secrets_.thresholds({(0, 0): 1000, (0, 80): 11, (1, 0): 1, (1, 50): 30}) == {0: 80, 1: 50}
    assert secrets_.thresholds({(0, 0): 1000, (0, 60): 3}) == {}
    assert secrets_.thresholds({}) == {}
