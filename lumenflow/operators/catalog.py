"""Operators on file catalogues: names, routing, pairing, validation and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Ranks, routes and thresholds by lower-cased extension.
PRIORITY = {".jpg": 10, ".jpeg": 10, ".png": 7, ".gif": 5, ".webp": 4, ".heic": 3, ".heif": 3, ".avif": 3}
ROUTES = {
    "jxl": (".jpg", ".jpeg", ".jpe", ".jfif", ".png", ".bmp", ".tiff", ".heif", ".heic"),
    "avif": (".gif", ".webp"),
    "mp4": (".mp4", ".mov", ".webm"),
}
SIGNATURES = {"jpeg": "FFD8FF", "png": "89504E47", "gif": "47494638", "bmp": "424D", "riff": "52494646", "html": "3C"}
RATIO_WINDOWS = (("png", "jxl", 0.01, 1.0), ("gif", "avif", 0.03, 5.0), ("any", "any", 0.01, 10.0))


def extension(path: Column) -> Column:
    """The lower-cased extension of a path's last part with its dot, or the empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def priority(ext: Column) -> Column:
    out = F.when(F.lit(False), 1)
    for e, rank in PRIORITY.items():
        out = out.when(ext == e, rank)
    return out.otherwise(1)


def verify_profile(fmt: Column, quality: Column) -> Column:
    """The least PSNR in dB and the most per cent of different pixels that a format and quality allow; formats are case-sensitive."""
    lossy = fmt.isin("avif", "heic", "heif")
    diff = F.when(lossy, 5.0).when(quality >= 85, 1.0).when(quality >= 70, 2.0).otherwise(5.0)
    return F.struct(F.when(lossy, 30.0).otherwise(0.0).alias("min_psnr_db"), diff.alias("max_pixel_diff_perc"))


def route(ext: Column) -> Column:
    """Target format of an extension; null: skip."""
    out = F.when(F.lit(False), "")
    for target, exts in ROUTES.items():
        out = out.when(ext.isin(*exts), target)
    return out


def encoder(ext: Column) -> Column:
    """Tool and arguments for an extension's route."""
    args = F.when(ext.isin(".jpg", ".jpeg", ".jpe", ".jfif"), F.array(F.lit("lossless_jpeg=1"), F.lit("effort=7"))).when(route(ext) == "jxl", F.array(F.lit("quality=85"))).when(route(ext) == "avif", F.array(F.lit("crf=32"))).when(route(ext) == "mp4", F.array(F.lit("copy")))
    tool = F.when(route(ext) == "jxl", "image").when(route(ext).isin("avif", "mp4"), "video")
    return F.when(route(ext).isNotNull(), F.struct(tool.alias("tool"), args.alias("args")))


def saved_percent(before: Column, after: Column) -> Column:
    """Per cent saved, negative for growth; null without a size before."""
    return (1 - after / F.nullif(before.cast("double"), F.lit(0.0))) * 100


def saved_bytes(before: Column, after: Column) -> Column:
    return F.greatest(before - after, F.lit(0))


def normalised_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"(?i)\.jpeg$", ".jpg"), r"(?i)\.tiff$", ".tif")


def stem(path: Column) -> Column:
    """A path without its extension, and without a sidecar's double one."""
    return F.regexp_replace(F.regexp_replace(path, r"(?i)(\.sidecar)?\.xmp$", ""), r"\.[^./]*$", "")


def sniffed(content: Column) -> Column:
    """A kind from a content's first bytes; null if none fits."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.when(F.lit(False), "")
    for kind, start in SIGNATURES.items():
        out = out.when(head.startswith(start), kind)
    return out


def first_success(*tries: Column) -> Column:
    """The first attempt that gave something, in order."""
    return F.coalesce(*tries)


def normalise_input(input_: Column, dir_: Column) -> Column:
    return F.struct(F.coalesce(F.nullif(input_, F.lit("")), F.nullif(dir_, F.lit(""))).alias("root"), (F.nullif(input_, F.lit("")).isNull() & F.nullif(dir_, F.lit("")).isNotNull()).alias("deprecated"))


#: Contents with more copies than this, and than a 50,000th of all rows, are told to the tasks: so these are fewer than 50,000.
HOT_COPIES, HOT_CONTENTS = 10_000, 50_000


def mark_duplicates(df: DataFrame, content: str, id_: str, hot: int = HOT_COPIES) -> DataFrame:
    """id, dup_of, is_dup: equal contents by SHA-256, the smallest id first; null counts as empty.

    Digests are folded before the shuffle. The few with very many copies are broadcast,
    so their rows stay where they are; all others meet their digest's first row in a
    join whose groups are small.
    """
    hashed = df.select(F.col(id_), F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("sha"))
    first = hashed.groupBy("sha").agg(F.min(id_).alias("dup_of"), F.count(F.lit(1)).alias("copies"))
    most = max(hot, df.count() // HOT_CONTENTS)
    many = F.broadcast(first.where(F.col("copies") > most).drop("copies"))  # fewer than HOT_CONTENTS rows of a digest and an id
    few = first.where(F.col("copies") <= most).drop("copies")
    marked = hashed.join(many, "sha").unionByName(hashed.join(many.select("sha"), "sha", "left_anti").join(few, "sha"))
    return marked.select(id_, "dup_of", (F.col(id_) != F.col("dup_of")).alias("is_dup"))


def pair_sidecars(media: DataFrame, sidecars: DataFrame, key: str) -> DataFrame:
    """Media with the sidecar of the same key, their tag maps merged: the sidecar's tags win."""
    s = sidecars.select(key, F.col("tags").alias("__side"))
    merged = F.map_from_entries(F.map_entries(F.map_concat(F.map_filter("tags", lambda k, _: ~F.array_contains(F.map_keys("__side"), k)), "__side")))
    return media.join(s, key).withColumn("tags", merged).drop("__side")


def validate_targets(source: DataFrame, target: DataFrame, key: str, size: str) -> DataFrame:
    """Each source row with whether a target is there, whether the source may be deleted (a target of some size), and the issues found."""
    t = target.select(F.col(key).alias("__k"), F.col(size).alias("target_size"))
    out = source.join(t, source[key] == F.col("__k"), "left")
    has = F.col("__k").isNotNull()
    return out.withColumns({"has_target": has, "deletable": has & (F.coalesce("target_size", F.lit(0)) > 0), "issues": F.when(has, F.array().cast("array<string>")).otherwise(F.array(F.lit("target is missing")))}).drop("__k")


def unprocessed(source: DataFrame, log: DataFrame, key: str) -> DataFrame:
    return source.join(log.select(key).distinct(), key, "left_anti")


def ratio_windows(spark: SparkSession) -> DataFrame:
    """The accepted ratios as a table, which is a constant of the plan."""
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("target"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, t, lo, hi in RATIO_WINDOWS])
    return spark.range(1).select(F.inline(rows))


def ratio_verdicts(df: DataFrame, windows: DataFrame) -> DataFrame:
    """df(kind, target, ratio) by range join with windows(kind, target, lo, hi): the windows that each row's ratio lies in."""
    d, w = df.alias("d"), F.broadcast(windows).alias("w")  # the threshold table is a constant of this module
    return d.join(w, (F.col("d.kind") == F.col("w.kind")) & F.col("d.ratio").between(F.col("w.lo"), F.col("w.hi")))


def all_layers(checks: dict[str, Column]) -> Column:
    """Verdict of ordered checks: whether all hold, and the first that doesn't."""
    flags = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in checks.items()])
    return F.struct(F.forall(flags, lambda x: x["ok"]).alias("ok"), F.get(F.filter(flags, lambda x: ~x["ok"]), F.lit(0))["name"].alias("failed"))


def exit_status(ok: Column, failed: Column) -> Column:
    """0 all well, 3 some failed, 2 all failed."""
    return F.when(failed == 0, 0).when(ok > 0, 3).otherwise(2)


def under_prefix(path: Column, prefixes: list[str]) -> Column:
    """Whether a path is one of the folders or lies below one; media/src1 has media/src1/x but not media/src10."""
    out = F.lit(False)
    for p in prefixes:
        folder = p.rstrip("/")
        out = out | (path == folder) | path.startswith(f"{folder}/")
    return out


def reconcile(expected: DataFrame, actual: DataFrame, group: str) -> DataFrame:
    """Rows expected and there for each group, also where one side has none."""
    e = expected.groupBy(group).agg(F.count(F.lit(1)).alias("expected"))
    a = actual.groupBy(group).agg(F.count(F.lit(1)).alias("actual"))
    return e.join(a, group, "full_outer").select(group, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual")).withColumn("missing", F.col("expected") - F.col("actual"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. Folded before the shuffle, so a frequent key is no burden."""
    row = F.struct(*[c for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def ranked(df: DataFrame, keys: list[str], order: list[Column], most: int, name: str = "rank") -> DataFrame:
    """The first `most` rows of each key, numbered."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= most)
