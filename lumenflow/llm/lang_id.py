"""Language identification by error-correcting output codes.

Each language gets a codeword of bits. For each bit a binary classifier over
hashed byte n-grams (1 to 4, inside words, lower case) says how much a text looks
like the languages whose bit is 1 rather than those whose bit is 0. Decoding adds
up the loss of each codeword, weighted by how well each bit did in training, and
takes the nearest; a text whose two nearest codewords are close is flagged.

Training counts n-grams for each language over all rows in Spark; what comes to
the driver is one vector of fixed length for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWERED, raw, steps

SLOTS = 1 << 14
#: Slots that travel as one row, and groups that the tasks' sums of a language are added up in before they meet: with a
#: million tasks a group has a few thousand rows of 8 KB.
PART, GROUPS = 1 << 10, 256
GRAMS = (1, 2, 3, 4)
TURN = np.uint32(0x9E3779B1)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SPACE_LIKE = np.zeros(256, bool)
_SPACE_LIKE[:65] = True
_SPACE_LIKE[91:97] = _SPACE_LIKE[123:128] = True
_FOLDED = np.where(_SPACE_LIKE, 32, LOWERED).astype(np.uint8)  # all ASCII but letters counts as a space


def gram_slots(data: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For each n, the slot of the n-gram at each byte; grams of spaces alone fall in slot 0."""
    b = _FOLDED[data].astype(np.uint32)
    out, h = [], np.zeros(len(b), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
        if n in GRAMS:
            out.append(((h * TURN) >> np.uint32(18), n))
    return out


def counts_by_row(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows by SLOTS: how often each slot's n-grams come in each row."""
    rows = len(offs) - 1
    out = np.zeros(rows * SLOTS, np.float32)
    row = np.repeat(np.arange(rows), np.diff(offs))
    for slot, n in gram_slots(data):
        inside = row[: len(slot)] == row[n - 1 :]
        out += np.bincount(row[: len(slot)][inside] * SLOTS + slot[inside], minlength=rows * SLOTS).astype(np.float32)
    return out.reshape(rows, SLOTS)


#: A lead in belief below which the language is flagged as ambiguous. Beliefs are sharp: of held-out texts of a single
#: language none comes below it, of even mixtures of two languages about half, and of single words one in ten.
LEAST_LEAD = 0.995


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits, +1 and -1
    weights: np.ndarray  # SLOTS x bits
    bit_weights: np.ndarray
    sharpness: float = 12.0

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of belief, and the lead over the next, for each row of counts."""
        margins = counts @ self.weights / np.maximum(counts.sum(1, keepdims=True), 1)
        losses = np.logaddexp(0, -self.sharpness * margins[:, None, :] * self.code[None]) @ self.bit_weights
        belief = np.exp(losses.min(1, keepdims=True) - losses)
        belief /= belief.sum(1, keepdims=True)
        best = belief.argmax(1)
        top = np.sort(belief, 1)
        return best, top[:, -1], top[:, -1] - (top[:, -2] if belief.shape[1] > 1 else 0)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n codewords of +1 and -1: all splits of the languages for up to 5, else the best of random codes by least distance."""
    if n <= 1:
        return np.ones((max(n, 1), 1), np.float32)
    if n <= 5:
        splits = [[1 if s >> i & 1 else -1 for i in range(n)] for s in range(1, 2**n - 1) if s & 1]
        return np.array(splits, np.float32).T
    rng, bits = np.random.default_rng(seed), 8 + 4 * int(np.ceil(np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        c = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        c = c[:, np.abs(c.sum(0)) < n]
        d = min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i))
        best, far = (c, d) if d > far else (best, far)
    return best


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(0).to_pylist()
        data, offs = raw(b.column(1))
        for i, j in steps(offs):
            part = offs[i : j + 1]
            row_lang = langs[i:j]
            for lang in set(row_lang):
                total.setdefault(lang, np.zeros(SLOTS, np.float64))
            names = sorted(set(row_lang))
            which = np.array([names.index(x) for x in row_lang])
            bytes_ = data[part[0] : part[-1]]
            own, doc = np.repeat(which, np.diff(part)), np.repeat(np.arange(j - i), np.diff(part))
            for slot, n in gram_slots(bytes_):
                inside = doc[: len(slot)] == doc[n - 1 :]
                got = np.bincount(own[: len(slot)][inside] * SLOTS + slot[inside], minlength=len(names) * SLOTS).reshape(len(names), SLOTS)
                for k, lang in enumerate(names):
                    total[lang] += got[k]
    rows = [(lang, k, v[k * PART : (k + 1) * PART].tobytes()) for lang, v in total.items() for k in range(SLOTS // PART)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["lang", "part", "sums"])


def _added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.zeros(PART, np.float64)
    for part in table.column("sums"):
        total += np.frombuffer(part.as_buffer(), np.float64)
    return pa.table({"lang": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def train_language(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", smoothing: float = 0.5) -> LanguageModel | None:
    """A model from all rows with a language and a text; None if there are none."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    schema = "lang string, part int, sums binary"
    some = rows.mapInArrow(_sums, schema).groupBy("lang", "part", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).applyInArrow(_added, schema)
    sums = some.groupBy("lang", "part").applyInArrow(_added, schema).collect()
    if not sums:
        return None
    of: dict[str, np.ndarray] = {}
    for r in sums:
        of.setdefault(r["lang"], np.zeros(SLOTS))[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["sums"], np.float64)
    names = sorted(of)
    share = np.vstack([of[x] + smoothing for x in names])
    share /= share.sum(1, keepdims=True)  # each language counts alike, however much text it has
    code = codewords(len(names))
    weights = np.zeros((SLOTS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        yes, no = share[code[:, b] > 0], share[code[:, b] < 0]
        if len(yes) and len(no):
            weights[:, b] = np.log(yes.mean(0)) - np.log(no.mean(0))
    margins = share @ weights  # of each language's own text
    lead = np.clip((margins * code).min(0), 1e-3, 1.0)
    return LanguageModel(tuple(names), code, weights, (lead / lead.sum()).astype(np.float32) * min(4, code.shape[1]))


def _predict(model: LanguageModel | None, least_lead: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = raw(b.column(1))
            lang, score, unsure = [], [], []
            for first, end in steps(offs, 1 << 18):
                for i in range(first, end, 64):
                    j = min(i + 64, end)
                    part = offs[i : j + 1]
                    bytes_ = data[part[0] : part[-1]]
                    ascii_ = np.add.reduceat(np.r_[_LETTER[bytes_], False].astype(np.int32), np.minimum(part[:-1] - part[0], len(bytes_))) * (np.diff(part) > 0)
                    has = [bool(n) or any(c.isalpha() for c in bytes_[s - part[0] : e - part[0]].tobytes().decode("utf-8", "replace")) for n, s, e in zip(ascii_, part[:-1], part[1:], strict=True)]
                    if model is None:
                        best, top, lead = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i)
                    else:
                        best, top, lead = model.decode(counts_by_row(bytes_, part - part[0]))
                    lang += [model.languages[k] if h and model else "und" for h, k in zip(has, best, strict=True)]
                    score += [float(s) if h else 0.0 for h, s in zip(has, top, strict=True)]
                    unsure += [not h or bool(x < least_lead) for h, x in zip(has, lead, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def identify_language(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", least_lead: float = LEAST_LEAD) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row of docs, taken one by one.

    Null texts and texts without a letter give und with score 0, flagged; so do
    all rows without a model. Very long texts are counted whole. An empty table gives
    no rows; repeated rows each get their row; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(model, least_lead), "doc_id long, lang_pred string, score double, ambiguous boolean")
