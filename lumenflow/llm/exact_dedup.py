"""Exact dedup by sorting contents, in DataFrame operations only.

Normalised texts are range-partitioned by splitters that Spark samples, an
external sort inside each partition puts equal texts side by side, and
neighbouring rows are compared over their full bytes: rows whose neighbour's text
is the same make a run, and a run is a group. Nothing but the texts themselves
says what is equal; SHA-256 is an output.

* Splitters are taken from the first `head_chars` characters and, where many texts
  begin alike, from a 64-bit digest behind them, so what the driver samples is
  bounded (about 100 bytes a sample) and a beginning that a third of all rows share
  is split. Equal texts have equal keys, so they always meet in one range.
* Copies of one text would all meet in one task. A count by digest finds the texts
  whose copies weigh more than a share of the input; only these are dealt over
  several ranges by doc_id as well, and the first rows of their runs, a few for
  each such text, are sorted by content once more. Which texts are dealt has no
  influence on the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, stored

#: Bytes of copies of one text that one range takes, at least, and the most texts that are dealt over several.
SHARE_BYTES, MOST_DEALT = 1_000_000, 100_000
#: What a row weighs besides its text.
ROW_BYTES = 64


def _normalised(docs: DataFrame, row: Column, text_col: str, head_chars: int) -> DataFrame:
    rows = docs.select(row.alias("row"), lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("norm"))
    return rows.withColumns({"head": F.substring("norm", 1, head_chars), "mix": F.xxhash64("norm")})


def _dealt(rows: DataFrame, share_bytes: int) -> tuple[DataFrame, int]:
    """The digests whose copies weigh more than a share, with the number of ranges for them: MOST_DEALT rows at most; and their number."""
    weights = rows.groupBy("mix").agg(F.sum(F.octet_length("norm") + ROW_BYTES).alias("bytes"), F.count(F.lit(1)).alias("n"))
    weights = stored(weights.where("n > 1"), "copies")
    total = weights.agg(F.sum("bytes")).first()[0] or 0
    share = max(share_bytes, total // MOST_DEALT)
    dealt = weights.where(F.col("bytes") > share).select(F.col("mix").alias("dealt_mix"), F.least(F.ceil(F.col("bytes") / share), F.col("n")).cast("int").alias("ranges"))
    return dealt, dealt.count()


def _split(rows: DataFrame, share_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows that are sorted once, and those of the texts that are dealt, with a salt."""
    dealt, n = _dealt(rows, share_bytes)
    if not n:
        return rows, None
    few = F.broadcast(dealt)  # MOST_DEALT rows of two numbers at most
    salted = rows.join(few, F.col("mix") == F.col("dealt_mix")).withColumn("salt", F.pmod(F.xxhash64("row.doc_id"), F.col("ranges")).cast("int"))
    return rows.join(few, F.col("mix") == F.col("dealt_mix"), "left_anti"), salted.drop("dealt_mix", "ranges")


def content_sort(rows: DataFrame, *salt: str) -> tuple[DataFrame, list[str]]:
    """rows(norm, head, mix, ...) dealt to ranges of content, and the columns that rows of one run share.

    A window over them needs no further exchange: it sorts each range and
    compares whole neighbouring texts.
    """
    return rows.repartitionByRange("head", "mix", *salt), ["head", "mix", *salt, "norm"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share_bytes: int = SHARE_BYTES, head_chars: int = 48) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when identical after lower-casing A-Z; of equal texts the
    row with the largest doc_id stays. Null counts as the empty text, and all
    empty texts are equal. Rows that repeat a doc_id count as rows of their own
    in group_size and, if it is the largest of its group, are all kept. Rows with
    a null doc_id are kept only in a group that has no other ids (keep_id is then
    null). Texts of any length are compared whole. An empty table gives no rows;
    other columns of docs are ignored.
    """
    rows = _normalised(docs, F.struct(F.col(id_col).alias("doc_id")), text_col, head_chars)
    once, dealt = _split(rows, share_bytes)
    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")

    def out(df: DataFrame) -> DataFrame:
        return df.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")

    def grouped(df: DataFrame, size: Column, id_: Column, *salt: str) -> DataFrame:
        ranges, run = content_sort(df, *salt)
        w = Window.partitionBy(*run)
        return ranges.withColumns({"group_size": size.over(w), "keep_id": F.max(id_).over(w)})

    plain = grouped(once, F.count(F.lit(1)), F.col("row.doc_id")).select("row.doc_id", "keep_id", "group_size", sha)
    if dealt is None:
        return out(plain)
    # Runs of a dealt text: (mix, salt, place of the text among those of its mix and salt) names one; its first row carries the text.
    runs = grouped(dealt, F.count(F.lit(1)), F.col("row.doc_id"), "salt")
    w = Window.partitionBy("head", "mix", "salt").orderBy("norm")
    runs = runs.withColumns({"place": F.dense_rank().over(w), "turn": F.row_number().over(w)})
    first = F.lag("norm").over(w).isNull() | (F.lag("norm").over(w) != F.col("norm"))
    runs = stored(runs.select("row.doc_id", sha, "head", "mix", "salt", "place", "group_size", "keep_id", F.when(first, F.col("norm")).alias("norm")), "dealt-runs")
    whole = grouped(runs.where("norm IS NOT NULL").withColumnsRenamed({"group_size": "run_size", "keep_id": "run_keep"}), F.sum("run_size"), F.col("run_keep"))
    whole = whole.select("head", "mix", "salt", "place", "group_size", "keep_id")
    named = runs.drop("norm", "group_size", "keep_id").join(F.broadcast(whole), ["head", "mix", "salt", "place"])  # 2 * MOST_DEALT runs and one for each range at most
    return out(plain.unionByName(named.select("doc_id", "keep_id", "group_size", "text_sha256")))


def exact_dedup_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share_bytes: int = SHARE_BYTES, head_chars: int = 48) -> DataFrame:
    """One row of docs for each text, that of the largest doc_id, with docs' columns.

    Of rows that repeat text and doc_id any one stays. A row without an id stays
    only if no row of its text has one. Null counts as the empty text, which is
    a text like others. An empty table gives no rows.
    """
    row = F.struct(F.col(id_col).alias("doc_id"), F.struct(*[docs[c] for c in docs.columns]).alias("docs"))
    once, dealt = _split(_normalised(docs, row, text_col, head_chars), share_bytes)

    def first(df: DataFrame, *salt: str) -> DataFrame:
        ranges, run = content_sort(df, *salt)
        return ranges.withColumn("turn", F.row_number().over(Window.partitionBy(*run).orderBy(F.desc_nulls_last("row.doc_id")))).where("turn = 1").drop("turn")

    kept = first(once).select("row.docs.*")
    return kept if dealt is None else kept.unionByName(first(first(dealt, "salt")).select("row.docs.*"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
