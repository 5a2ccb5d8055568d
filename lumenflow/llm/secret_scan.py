"""Secrets: known forms, and a battery of randomness tests over all other tokens.

A token is a maximal run of LEAST or more of the symbols that encoded secrets are made
of. Its encoding is the smallest alphabet that has all its symbols. Three tests ask
whether it looks like ordinary text in that encoding, which is what secrets don't:

* chi-squared: symbols of ordinary text are far from uniform. The statistic's noncentral
  distribution under a divergence of DIVERGENCE for each symbol says how likely
  ordinary text is to come out so even.
* runs: ordinary text changes seldom between digits, small and capital letters.
* serial correlation: neighbouring symbols of ordinary text (counters, ordered names)
  depend on each other.

The three normal scores are added up as scores that correlate by a half; a test that sees
ordinary text outright keeps its say. All three grow sharper with length. The
Benjamini-Hochberg rule then bounds the share of false discoveries among the distinct
tokens of each stratum of lengths, so that short tokens, which are many and say little,
don't lower the bar for long ones nor raise it.

One pass reads the texts and writes places and p-values of tokens (in steps of a
twentieth of a power of ten, rounded up); counts of distinct tokens by stratum and step
are a table of a bounded number of rows, which gives each stratum's threshold.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more begins where its run does
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")

#: Symbols of a token, and how many it has at least.
LEAST = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
_DIGITS, _CAPITALS, _SMALL = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets from small to large, each in the order of its encoding's values. Digits alone are numbers, not secrets.
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _CAPITALS + "234567",
    "base36": _DIGITS + _SMALL,
    "BASE36": _DIGITS + _CAPITALS,
    "base62": _DIGITS + _CAPITALS + _SMALL,
    "base64": _CAPITALS + _SMALL + _DIGITS + "+/",
    "base64url": _CAPITALS + _SMALL + _DIGITS + "-_",
}
#: What ordinary text does at least: divergence from uniform for each symbol, share of a random text's changes of class at most, correlation of neighbours.
DIVERGENCE, CHANGES, CORRELATION = 0.8, 0.6, 0.6
#: Strata of lengths by their least length; steps in a power of ten of p, and the last step.
STRATA, STEPS, LAST = (LEAST, 24, 32, 48, 80), 20, 400
#: The share of false discoveries among the tokens that a stratum gives.
FALSE_SHARE = 0.01


def _normal_above(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(z / math.sqrt(2))


def _noncentral_score(x: np.ndarray, df: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The normal score of a noncentral chi-squared variable, by Sankaran's approximation."""
    a, b = df + shift, df + 2 * shift
    h = 1 - 2 * a * (df + 3 * shift) / (3 * b * b)
    p, m = b / (a * a), (h - 1) * (1 - 3 * h)
    return ((x / a) ** h - 1 - h * p * (h - 1 - 0.5 * (2 - h) * m * p)) / (h * np.sqrt(2 * p) * (1 + 0.5 * m * p))


class _Tables:
    """For each encoding: a symbol's value by its code, and its class (digit, capital, small, sign)."""

    def __init__(self) -> None:
        self.kind = np.full(128, -1, np.int64)
        for k, part in enumerate((_DIGITS, _CAPITALS, _SMALL, "+/-_")):
            self.kind[[ord(c) for c in part]] = k
        self.value, self.size, self.q, self.t = [], [], [], []
        for letters in ALPHABETS.values():
            value = np.full(128, -1, np.int64)
            value[[ord(c) for c in letters]] = np.arange(len(letters))
            share = np.bincount(self.kind[[ord(c) for c in letters]], minlength=4) / len(letters)
            self.value.append(value)
            self.size.append(len(letters))
            self.q.append(float((share**2).sum()))
            self.t.append(float((share**3).sum()))


TABLES = _Tables()


def encoding_of(token: str) -> int | None:
    """The number of the smallest alphabet with all the token's symbols; none for numbers and for what fits no encoding."""
    have = set(token.rstrip("="))
    if have <= set(_DIGITS):
        return None
    return next((k for k, letters in enumerate(ALPHABETS.values()) if have <= _SETS[k]), None)


_SETS = [set(x) for x in ALPHABETS.values()]


def p_values(tokens: list[str], encodings: list[int]) -> np.ndarray:
    """For each token the probability that text as ordinary as the margins say would look as random, by the three tests together."""
    if not tokens:
        return np.zeros(0)
    chi, df, n, changes, want, var, corr = (np.zeros(len(tokens)) for _ in range(7))
    for i, (token, k) in enumerate(zip(tokens, encodings, strict=True)):
        codes = np.frombuffer(token.rstrip("=").encode("ascii"), np.uint8)
        value, m, size = TABLES.value[k][codes], TABLES.size[k], len(codes)
        n[i] = size
        # Bins by length: five symbols are expected in each.
        bins = max(2, min(m, size // 5))
        seen = np.bincount(value * bins // m, minlength=bins)
        due = size * np.bincount(np.arange(m) * bins // m, minlength=bins) / m
        chi[i], df[i] = (((seen - due) ** 2) / due).sum(), bins - 1
        kind, q, t = TABLES.kind[codes], TABLES.q[k], TABLES.t[k]
        changes[i] = (kind[1:] != kind[:-1]).sum()
        want[i] = (size - 1) * (1 - q)
        var[i] = (size - 1) * q * (1 - q) + 2 * (size - 2) * (t - q * q)
        v = value - value.mean()
        corr[i] = (v[1:] * v[:-1]).sum() / (v * v).sum() if v.any() else 1.0
    even = -_noncentral_score(chi, df, n * DIVERGENCE)
    runs = (changes - CHANGES * want) / np.sqrt(var)
    free = (math.atanh(CORRELATION) - np.arctanh(np.minimum(np.abs(corr), 0.999999))) * np.sqrt(n - 3)
    scores = np.stack([even, runs, free])
    worst, all_ = scores.min(0), _normal_above(scores.sum(0) / math.sqrt(6))  # the sum's variance is 3 + 6 / 2
    return np.where(worst > 0, all_, np.maximum(all_, _normal_above(worst)))


def step_of(p: np.ndarray) -> np.ndarray:
    """The step whose bound 10 ** (-step / STEPS) is the least one at or above p."""
    return np.minimum(np.floor(-np.log10(np.maximum(p, 1e-300)) * STEPS), LAST).astype(np.int64)


def stratum_of(n: int) -> int:
    return sum(n >= least for least in STRATA) - 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST] if "AKIA" in text else []
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
_TOKENS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("step", pa.int32()), ("stratum", pa.int32()), ("encoding", pa.string()), ("h", pa.int64())]))
_SCANNED = "doc_id long, base array<struct<s:int,k:int,e:int>>, tokens array<struct<s:int,e:int,step:int,stratum:int,encoding:string,h:long>>"
_NAMES = tuple(ALPHABETS)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        base, places, tokens, encodings = [], [], [], []
        for i in range(len(b)):
            text = b.column(1)[i].as_py()
            own = base_spans(text)
            base.append([{"s": s, "k": BASE.index(k), "e": e} for k, s, e in own])
            starts = sorted((s, e) for _, s, e in own)
            reach = list(accumulate((e for _, e in starts), max))  # how far the spans up to each one go
            for m in TOKEN.finditer(text):
                # A token inside a span of a base kind adds nothing.
                before = bisect_right(starts, (m.start(), len(text)))
                if not (before and reach[before - 1] >= m.end()) and (k := encoding_of(m[0])) is not None:
                    places.append((i, m.start(), m.end()))
                    tokens.append(m[0])
                    encodings.append(k)
        steps = step_of(p_values(tokens, encodings)).tolist()
        found: list[list[dict]] = [[] for _ in range(len(b))]
        for (i, s, e), t, k, step in zip(places, tokens, encodings, steps, strict=True):
            found[i].append({"s": s, "e": e, "step": step, "stratum": stratum_of(len(t)), "encoding": _NAMES[k], "h": xxhash.xxh64_intdigest(t) - (1 << 63)})
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, _SPANS), pa.array(found, _TOKENS)], names=["doc_id", "base", "tokens"])


def thresholds(counts: dict[tuple[int, int], int], share: float = FALSE_SHARE) -> dict[int, int]:
    """The least step that counts as a discovery in each stratum, from the numbers of tokens by (stratum, step): Benjamini-Hochberg over the steps' bounds."""
    out = {}
    for stratum in {s for s, _ in counts}:
        own = {k: n for (s, k), n in counts.items() if s == stratum}
        total, found = sum(own.values()), 0
        for k in sorted(own, reverse=True):
            found += own[k]
            if 10 ** (-k / STEPS) <= share * found / total:
                out[stratum] = k
    return out


def find_secrets(docs: DataFrame, share: float = FALSE_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (spans of known forms) and random (spans that only the tests find, with their encoding and p's bound) for every row of docs.

    Places are code points, ends exclusive. Null counts as the empty text, which has
    none. Repeated rows and null ids each get their row; a token counts once for its
    stratum however often it stands. Very long texts are scanned whole, and an empty
    table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    scanned = stored(rows.mapInArrow(_scan, _SCANNED), "secrets")
    each = scanned.select(F.explode("tokens").alias("x")).groupBy("x.stratum", "x.step", "x.h").agg(F.lit(1).alias("one"))
    counts = {(r.stratum, r.step): r.n for r in each.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n")).collect()}  # strata x steps rows at most
    least = thresholds(counts, share)
    random_ = F.transform(F.filter("tokens", lambda x: x["step"] >= _bar(x["stratum"], least)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["encoding"].alias("encoding"), F.pow(F.lit(10.0), -x["step"] / STEPS).alias("p")))
    return scanned.select("doc_id", "base", random_.alias("random"))


def _bar(stratum: Column, least: dict[int, int]) -> Column:
    out = F.lit(LAST + 1)
    for k, step in least.items():
        out = F.when(stratum == k, step).otherwise(out)
    return out


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")


def secrets_digest(found: DataFrame) -> DataFrame:
    """The counts, digest and listing of find_secrets's spans, by start and then by kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    random_ = F.transform("random", lambda x: F.struct(x["s"].alias("s"), F.lit(len(BASE)).alias("k"), x["e"].alias("e")))
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[_count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("base", random_)).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )


def _without(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i in range(len(b)):
            text, at, parts = b.column(1)[i].as_py(), 0, []
            spans = sorted((x["s"], x["e"]) for c in (2, 3) for x in b.column(c)[i].as_py() or [])
            for s, e in spans:
                if s >= at:
                    parts += [text[at:s], mark]
                at = max(at, e)
            out.append("".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def redact_secrets(docs: DataFrame, share: float = FALSE_SHARE, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """doc_id and text with every span replaced by a mark, overlapping ones by one; rows without a span aren't joined. doc_id must tell texts apart.

    Null texts become empty, and rows without an id are left out, as they can't be found again.
    """
    found = find_secrets(docs.where(F.col(id_col).isNotNull()), share, id_col, text_col)
    own = found.where((F.size("base") > 0) | (F.size("random") > 0)).select(F.col("doc_id").alias("__i"), "base", F.transform("random", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("random")).dropDuplicates(["__i"])
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return rows.join(own, F.col("doc_id") == F.col("__i"), "left").select("doc_id", "t", "base", "random").mapInArrow(lambda batches: _without(batches, mark), "doc_id long, text string")
