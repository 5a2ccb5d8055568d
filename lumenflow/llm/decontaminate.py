"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask is a row of kept and ignored word positions. Laid at every word of a
document and of a benchmark item, it gives hashes of the kept words; equal hashes
are hits. A hit fixes how the item lies along the document, and the words around
it are then compared place by place, which allows substitutions: a document is
contaminated by an item when a window of `window` words (the whole item if it is
shorter) has at least `share` of its words equal to the item's. Items of fewer than
WHOLE words must occur whole and unchanged.

The masks of an item hit every window with as many words replaced as the defaults
allow, wherever these are (tests/llm goes through all cases), so no overlap that
the defaults count is missed for want of a hit.

Documents are first asked only where a seed of any item stands. Those that have any
are cut into segments, so that a very long one is many rows; which items the seeds
are of is looked up with the words around at hand, and what doesn't hold is dropped
there and then. So a phrase that many items and many documents share costs comparisons, but no rows that
are shuffled or stored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR_PATTERN, lower_ascii, size_mb, stored, unused

#: 1 keeps a word, 0 ignores it. The second row is for items shorter than LONG words as well.
MASKS = ("11011", "110101")
SHORT_MASKS = ("1111", "110011")
LONG, WHOLE = 13, 8
SPAN = max(map(len, (*MASKS, *SHORT_MASKS)))
#: Words of a segment, besides what reaches over its ends.
SEGMENT = 512
#: Seeds of a benchmark up to this many words of text are sent to all executors; beyond it both sides are dealt by seed.
BROADCAST_WORDS = 2_000_000
#: Documents with hits up to which their ids are sent to where the texts are, and places of hits up to which these are
#: sent to the documents so found; beyond either both sides are dealt by document.
SENT_IDS, SENT_HITS = 2_000_000, 100_000


def masks_of(n: int) -> tuple[str, ...]:
    """The masks of an item of n words."""
    return ("1" * n,) if n < WHOLE else MASKS if n >= LONG else MASKS + SHORT_MASKS


def needed(n: int, window: int, share: float) -> int:
    """Equal words that an item of n words asks for."""
    return n if n < WHOLE else ceil(min(n, window) * share)


def word_list(text: Column) -> Column:
    """Lower-cased words of a text; null and blank texts have none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATOR_PATTERN), lambda w: w != "")


def _seeded(rows: DataFrame, keys: list[str], masks: dict[str, Column]) -> DataFrame:
    """rows(keys, words) by mask and word position: keys, pos and seed; masks: each with the rows that it is for. Only hashes are laid out by position, not the words."""
    words, n = F.col("words"), F.size("words")

    def seeds(mask: str, on: Column) -> Column:
        kept = [k for k, c in enumerate(mask) if c == "1"]
        at = F.transform(F.sequence(F.lit(0), n - len(mask)), lambda i: F.xxhash64(F.lit(mask), *[F.get(words, i + k) for k in kept]))
        return F.when((n >= len(mask)) & on, at)

    arrays = rows.select(*keys, F.explode(F.array(*[seeds(m, on) for m, on in masks.items()])).alias("seeds"))
    return arrays.select(*keys, F.posexplode("seeds").alias("pos", "seed"))


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), word_list(F.col(text_col)).alias("words")).where("doc_id IS NOT NULL")


def _segments(words: DataFrame, reach: int) -> DataFrame:
    """doc_id, seg, first (place of the first word given) and words of each segment of rows(doc_id, words): SEGMENT words, and `reach` + SPAN more on either side."""
    edge = reach + SPAN
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(SEGMENT))
    first = lambda s: F.greatest(s - edge, F.lit(0))
    cut = F.transform(starts, lambda s: F.struct(F.floor(s / SEGMENT).cast("int").alias("seg"), first(s).alias("first"), F.slice("words", first(s) + 1, s - first(s) + SEGMENT + edge).alias("words")))
    return words.where(F.size("words") > 0).select("doc_id", F.inline(cut))


def _around(words: Column, pos: Column, reach: int) -> Column:
    """2 * reach + SPAN words from reach before pos, null outside the text."""
    return F.transform(F.sequence(F.lit(-reach), F.lit(reach + SPAN - 1)), lambda k: F.when(pos + k >= 0, F.get(words, pos + k)))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = LONG, share: float = 0.75, least: int = 1) -> DataFrame:
    """Pairs doc_id, item_id, doc_pos, equal_words, window_words of documents and the items found in them; at most one row a pair.

    Items of fewer than `least` words are left out, as are rows without ids and
    items without words. Null or blank texts match nothing; either table may be
    empty. Repeated rows of a document or an item count once, and rows that repeat
    an id with another text count for that id. Texts of any length are searched
    whole. Ties between places of an item go to the one with most equal words, then
    to the first.
    """
    n = F.size("item_words")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), word_list(F.col("text")).alias("item_words")).where((n >= max(least, 1)) & F.col("item_id").isNotNull())
    items = items.groupBy("item_id", "item_words").agg(F.lit(1).alias("one")).drop("one")
    lengths = [r["n"] for r in items.select(F.least(n, F.lit(LONG)).alias("n")).distinct().collect()]  # LONG rows at most
    total = items.agg(F.sum(n)).first()[0] or 0
    small = F.broadcast if total <= BROADCAST_WORDS and size_mb(benchmark) <= 64 else (lambda df: df)
    items = items.withColumn("item", F.xxhash64("item_id", "item_words"))  # rows that repeat an item_id with another text are items of their own
    of = {m: [k for k in lengths if m in masks_of(k)] for m in sorted({m for k in lengths for m in masks_of(k)})}
    length = F.least(F.size("words"), F.lit(LONG))
    seeds = _seeded(items.select("item", F.col("item_words").alias("words")), ["item"], {m: length.isin(ks) for m, ks in of.items()}) if of else None
    if seeds is None:  # no items, so nothing is found
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("doc_pos"), F.lit(0).alias("equal_words"), F.lit(0).alias("window_words")).where("false")
    seeds = seeds.withColumnRenamed("pos", "item_pos")
    reach = max(window, LONG) - 1
    places = _seeded(_words(docs, id_col, text_col), ["doc_id"], {m: F.lit(True) for m in of}).join(small(seeds.select("seed").distinct()), "seed", "left_semi")
    key = ["doc_id", "seg"]
    hits = stored(places.groupBy("doc_id", F.floor(F.col("pos") / SEGMENT).cast("int").alias("seg")).agg(F.collect_set(F.struct("pos", "seed")).alias("hits")), "hits")
    few = (hits.agg(F.sum(F.size("hits"))).first()[0] or 0) <= SENT_HITS
    near = F.transform("hits", lambda h: F.struct(h["pos"].alias("pos"), h["seed"].alias("seed"), _around(F.col("words"), h["pos"] - F.col("first"), reach).alias("near")))
    own = unused(docs, "found")
    found = hits.select(F.col("doc_id").alias(own)).distinct()
    asked = docs.join(F.broadcast(found) if hits.count() <= SENT_IDS else found, F.col(id_col).cast("long") == F.col(own), "left_semi")  # before words are cut
    laid = _segments(_words(asked, id_col, text_col), reach).join(F.broadcast(hits) if few else hits, key).select("doc_id", F.inline(near))
    laid = laid.join(small(seeds), "seed").join(small(items), "item")
    equal = F.zip_with("near", _around(F.col("item_words"), F.col("item_pos"), reach), lambda a, b: F.when(a == b, 1).otherwise(0))
    size = F.when(n < WHOLE, n).otherwise(F.least(F.lit(window), n))
    need = F.when(n < WHOLE, n).otherwise(F.ceil(size * share))
    laid = laid.select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("doc_pos"), (F.col("item_pos") - reach).alias("from"), n.alias("n"), size.alias("window_words"), need.alias("need"), equal.alias("equal"))
    laid = laid.where(F.aggregate("equal", F.lit(0), lambda t, x: t + x) >= F.col("need"))
    # The item's windows that lie wholly inside what was compared.
    first, last = F.greatest(-F.col("from"), F.lit(0)), F.least(F.col("n") - F.col("from"), F.lit(2 * reach + SPAN)) - F.col("window_words")
    best = F.array_max(F.transform(F.sequence(first, last), lambda s: F.aggregate(F.slice("equal", s + 1, F.col("window_words")), F.lit(0), lambda t, x: t + x)))
    found = laid.withColumn("equal_words", F.when(first <= last, best)).where(F.col("equal_words") >= F.col("need"))
    top = F.max_by(F.struct("doc_pos", "equal_words", "window_words"), F.struct("equal_words", -F.col("doc_pos"))).alias("top")
    return found.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "top.doc_pos", "top.equal_words", "top.window_words")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each contaminated document: doc_id, contaminated (true), n_items, item_ids as text, most_equal_words."""
    pairs = contamination(docs, benchmark, **options)
    return pairs.groupBy("doc_id").agg(
        F.lit(True).alias("contaminated"),
        F.count(F.lit(1)).alias("n_items"),
        F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("item_ids"),
        F.max("equal_words").cast("long").alias("most_equal_words"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the contaminated ones, with their columns, which may have any names; rows without an id stay."""
    own = unused(docs, "bad")
    bad = stored(contamination(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(own)).distinct(), "contaminated")
    return docs.join(F.broadcast(bad) if bad.count() <= SENT_IDS else bad, F.col(id_col).cast("long") == F.col(own), "left_anti")


#: The same by all equal words and all alignments.
SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM w),
b AS (SELECT item_id, len(w) AS n, unnest(w) AS x, unnest(range(0, len(w))) AS q FROM v),
m AS (SELECT doc_id, item_id, p - q AS diag, any_value(n) AS n, list(q) AS qs FROM d JOIN b USING (x) GROUP BY doc_id, item_id, diag HAVING count(*) >= CASE WHEN any_value(n) < 8 THEN any_value(n) ELSE ceil(least(any_value(n), 13) * 0.75) END),
e AS (SELECT doc_id, item_id, n, list_max(list_transform(range(0, n - least(n, 13) + 1), lambda s: len(list_filter(qs, lambda q: q >= s AND q < s + least(n, 13))))) AS equal_words FROM m),
f AS (SELECT doc_id, item_id, max(equal_words) AS equal_words FROM e WHERE equal_words >= CASE WHEN n < 8 THEN n ELSE ceil(least(n, 13) * 0.75) END GROUP BY doc_id, item_id)
SELECT doc_id, true AS contaminated, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids, max(equal_words)::BIGINT AS most_equal_words FROM f GROUP BY doc_id
"""
