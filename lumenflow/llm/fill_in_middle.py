"""Fill-in-middle by ropes.

A text becomes a balanced tree whose leaves are short pieces of it; every node caches
how many units (code points, words or lines) and how many code points it holds. The
tree is split at two unit ranks, and the three subtrees are concatenated in another
order with sentinels between them, which copies no text but the leaves at the cuts.
To invert, the output's tree is split at its sentinels and put together again.

Which texts are changed, and where they are cut, follows from SHA-256 of the seed and
the document's id, so a lost task gives the same again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points in a leaf, and in an output batch (a longer text is a batch of its own).
LEAF, BATCH = 1024, 4 << 20
#: Units other than code points. Each pattern covers every text without a gap.
UNITS = {"char": None, "word": re.compile(r"\S+\s*|\s+"), "line": re.compile(r"[^\n]*\n|[^\n]+")}
U, P, HEIGHT, LEFT, RIGHT = range(5)
#: A node is (units, code points, height, left, right); a leaf has its text at LEFT and nothing at RIGHT; an empty rope is None.
Rope = tuple | None


def _leaf(text: str, units: int) -> Rope:
    return (units, len(text), 1, text, None) if text else None


def _node(a: tuple, b: tuple) -> tuple:
    return (a[U] + b[U], a[P] + b[P], 1 + max(a[HEIGHT], b[HEIGHT]), a, b)


def concat(a: Rope, b: Rope) -> Rope:
    """Both ropes in one, whose sibling heights differ by one at most; in time of their heights' difference."""
    if a is None or b is None:
        return a or b
    if a[HEIGHT] > b[HEIGHT] + 1:
        return _balanced(a[LEFT], concat(a[RIGHT], b))
    if b[HEIGHT] > a[HEIGHT] + 1:
        return _balanced(concat(a, b[LEFT]), b[RIGHT])
    return _node(a, b)


def _balanced(a: tuple, b: tuple) -> tuple:
    if a[HEIGHT] > b[HEIGHT] + 1:
        x, y = a[LEFT], a[RIGHT]
        return _node(x, _node(y, b)) if x[HEIGHT] >= y[HEIGHT] else _node(_node(x, y[LEFT]), _node(y[RIGHT], b))
    if b[HEIGHT] > a[HEIGHT] + 1:
        x, y = b[LEFT], b[RIGHT]
        return _node(_node(a, x), y) if y[HEIGHT] >= x[HEIGHT] else _node(_node(a, x[LEFT]), _node(x[RIGHT], y))
    return _node(a, b)


def rope(text: str, unit: str = "char") -> Rope:
    """A leaf begins where a unit does, but for those that carry a unit longer than a leaf on, which count no unit."""
    pattern, leaves = UNITS[unit], []
    if pattern is None:
        leaves = [_leaf(text[i : i + LEAF], min(LEAF, len(text) - i)) for i in range(0, len(text), LEAF)]
    else:
        begun = 0
        for m in pattern.finditer(text):
            if m.end() - begun >= LEAF or m.end() == len(text):
                for i in range(begun, m.end(), LEAF):
                    own = text[i : min(i + LEAF, m.end())]
                    # The last unit may reach over several leaves: those behind its beginning hold no other.
                    inside = sum(1 for _ in pattern.finditer(own)) if i == begun else 0
                    leaves.append(_leaf(own, inside))
                begun = m.end()
    while len(leaves) > 1:
        leaves = [_node(leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        if len(leaves) > 1 and leaves[-1][HEIGHT] < leaves[0][HEIGHT] - 1:
            last = leaves.pop()
            leaves[-1] = concat(leaves[-1], last)
    return leaves[0] if leaves else None


def split(r: Rope, rank: int, by: int = U, unit: str = "char") -> tuple[Rope, Rope]:
    """The rope before unit (or, by P, code point) number `rank`, and the rope from there on."""
    if r is None or rank >= r[by]:  # also leaves that only carry the last unit on
        return r, None
    if r[RIGHT] is None:
        text, at = r[LEFT], rank
        if by == U and unit != "char":
            at = [m.start() for m in UNITS[unit].finditer(text)][rank]
        return _leaf(text[:at], rank if by == U else at), _leaf(text[at:], r[U] - rank if by == U else r[P] - at)
    if rank < r[LEFT][by]:
        a, b = split(r[LEFT], rank, by, unit)
        return a, concat(b, r[RIGHT])
    a, b = split(r[RIGHT], rank - r[LEFT][by], by, unit)
    return concat(r[LEFT], a), b


def text_of(r: Rope) -> str:
    out, stack = [], [r] if r else []
    while stack:
        x = stack.pop()
        if x[RIGHT] is None:
            out.append(x[LEFT])
        else:
            stack += [x[RIGHT], x[LEFT]]
    return "".join(out)


@dataclass(frozen=True)
class Recipe:
    """How texts are changed. Of 100 texts `plain` stay, and of 100 others `spm` have their suffix first."""

    unit: str = "char"
    plain: int = 10
    spm: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "1:"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if self.unit not in UNITS:
            raise ValueError(f"unit must be one of {list(UNITS)}")
        if not all(marks) or len(set(marks)) < 3 or any(a is not b and a in b for a in marks for b in marks):
            raise ValueError("sentinels must be three different texts, none within another")
        # Else one could begin inside another, and the first place found need not be the true one.
        if any(a.endswith(b[:k]) for a in marks for b in marks for k in range(1, min(len(a), len(b)))):
            raise ValueError("no end of a sentinel may be the beginning of one")

    def forward(self, text: str, h: tuple[int, int, int, int]) -> tuple[str, int, tuple | None, str]:
        """Form, number of units, (units, code points) of prefix and middle, and output."""
        r = rope(text, self.unit)
        n = r[U] if r else 0
        if not text or h[2] % 100 >= 100 - self.plain or any(m in text for m in (self.prefix, self.suffix, self.middle)):
            return "plain", n, None, text
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, rest = split(r, low, U, self.unit)
        b, c = split(rest, high - low, U, self.unit)
        sizes = tuple((x[U], x[P]) if x else (0, 0) for x in (a, b))
        p, s, m = (_leaf(x, 0) for x in (self.prefix, self.suffix, self.middle))
        form, order = ("spm", (s, c, p, a, m, b)) if h[3] % 100 < self.spm else ("psm", (p, a, s, c, m, b))
        out: Rope = None
        for part in order:
            out = concat(out, part)
        return form, n, sizes, text_of(out)

    def backward(self, output: str, form: str) -> str:
        """The text that forward made the output from."""
        if form == "plain":
            return output
        first, second = (self.suffix, self.prefix) if form == "spm" else (self.prefix, self.suffix)
        at = output.index(second, len(first))
        end = output.index(self.middle, at + len(second))
        r = rope(output)
        _, r = split(r, len(first), P)
        one, r = split(r, at - len(first), P)
        _, r = split(r, len(second), P)
        two, r = split(r, end - at - len(second), P)
        _, three = split(r, len(self.middle), P)
        a, c = (two, one) if form == "spm" else (one, two)
        return text_of(concat(concat(a, three), c))


def _draws(seed: str, doc_id: Column) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


_OUT = "doc_id long, n long, form string, prefix_units long, middle_units long, prefix_chars long, middle_chars long, output string"


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about BATCH code points."""
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += size(r)
        if weight >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def fill_in_middle(docs: DataFrame, recipe: Recipe = Recipe(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix and middle in units and code points (null if plain), and output, for every row of docs.

    Null and empty texts give the empty text, plain. A text that holds a sentinel
    stays plain, so that outputs can be inverted. Rows are taken one by one: repeated
    rows give equal rows, a null id draws as an empty one does, and very long texts
    are trees of more leaves. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), *_draws(recipe.seed, F.col(id_col)))
    names = [x.split()[0] for x in _OUT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(b: pa.RecordBatch) -> Iterator[tuple]:
            ids, draws = b.column(0).to_pylist(), [b.column(k).to_pylist() for k in range(2, 6)]
            for i, h in enumerate(zip(*draws, strict=True)):
                form, n, sizes, out = recipe.forward(b.column(1)[i].as_py(), h)
                (pu, pc), (mu, mc) = sizes or ((None, None), (None, None))
                yield ids[i], n, form, pu, mu, pc, mc, out

        for b in batches:
            yield from _batched(made(b), names, types, lambda r: len(r[-1]))

    return rows.mapInArrow(run, _OUT)


def restore(transformed: DataFrame, recipe: Recipe = Recipe(), output_col: str = "output", form_col: str = "form", name: str = "text") -> DataFrame:
    """transformed without its output column and with the text that it was made from, found from output and form alone.

    A null output or form gives a null text. Other columns stay as they are; one of
    the new column's name is replaced.
    """
    rest = [c for c in transformed.columns if c not in (output_col, name)]
    at = len(rest)
    rows = transformed.select(*rest, F.col(form_col).alias("__form"), F.col(output_col).alias("__output"))
    schema = T.StructType([*transformed.select(*rest).schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms, begun = b.column(at).to_pylist(), 0
            texts, weight = [], 0
            for i, form in enumerate(forms):
                out = b.column(at + 1)[i].as_py()
                texts.append(None if form is None or out is None else recipe.backward(out, form))
                weight += len(out or "")
                if weight >= BATCH or i + 1 == len(forms):
                    own = b.slice(begun, i + 1 - begun)
                    yield pa.RecordBatch.from_arrays([*own.columns[:at], pa.array(texts, pa.string())], names=[*rest, name])
                    begun, texts, weight = i + 1, [], 0

    return rows.mapInArrow(run, schema)


def fim_digest(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """The sizes and forms of fill_in_middle with digests of its outputs and of what restore makes of these."""
    made = fill_in_middle(docs, recipe).withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256))
    back = restore(made, recipe)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
e AS (SELECT *, len(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM e),
g AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM g"""
