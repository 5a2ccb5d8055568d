"""Looking after a media collection: which files count, what becomes of them, and whether the result may be trusted.

Files are rows of df(path, size, ...); names are compared with their extension in
lower case. Everything is one pass over the rows, but for pairing and dedup.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalog as C

# Extensions by family, the separate list of the conversion check, and formats of each tool.
STILL = (".jpg", ".jpeg", ".jpe", ".jfif", ".png", ".gif", ".webp", ".bmp", ".tiff", ".tif", ".ico", ".svg", ".avif", ".jxl", ".heif", ".heic")
ANIMATED = (".apng", ".mng")
VIDEO = (".mp4", ".mov", ".avi", ".mkv", ".webm", ".flv", ".wmv", ".m4v", ".3gp")
CHECKED = (".jpg", ".jpeg", ".jpe", ".jfif", ".png", ".gif", ".webp", ".bmp", ".heif", ".heic", ".tiff", ".avif", ".mp4", ".mov", ".webm")
TOOL_FORMATS = {
    "all2avif": (("jpg", "png", "bmp", "tiff", "gif", "webp", "jxl", "heic"), "avif"),
    "all2jxl": (("jpg", "png", "bmp", "tiff", "gif", "webp", "avif", "heic"), "jxl"),
    "static2avif": (("jpg", "png", "bmp", "tiff"), "avif"),
    "dynamic2avif": (("gif", "webp", "jxl"), "avif"),
    "static2jxl": (("jpg", "png", "bmp", "tiff"), "jxl"),
    "dynamic2jxl": (("gif", "webp", "avif"), "jxl"),
    "video2mov": (("mp4", "avi", "mkv", "mov"), "mov"),
}
#: Tools that take any image or any media and keep its format.
KEEPING = {"merge_xmp": (*STILL, *ANIMATED), "deduplicate_media": (*STILL, *ANIMATED, *VIDEO)}
#: Modes and, for each, the target of a file's extension.
MODES = {
    "optimized": {".jpg": "jxl", ".jpeg": "jxl", ".png": "jxl", ".gif": "avif", ".mp4": "mov"},
    "sticker": {**dict.fromkeys((*STILL, *ANIMATED), "avif")},
}
#: Formats that encoders don't take, which go through PNG first.
INDIRECT = (".ico", ".svg", ".bmp", ".tiff", ".tif", ".heic", ".heif")
#: Width to height may differ by so much after repacking a video.
ASPECT_TOLERANCE = 0.15


def family(ext: Column) -> Column:
    """still, animated, video, or null for what is no medium."""
    return F.when(ext.isin(*STILL), "still").when(ext.isin(*ANIMATED), "animated").when(ext.isin(*VIDEO), "video")


def is_media(ext: Column) -> Column:
    return ext.isin(*STILL, *ANIMATED, *VIDEO)


def is_checked(ext: Column) -> Column:
    """The conversion check's list, which is one of its own."""
    return ext.isin(*CHECKED)


def target_format(ext: Column, mode: str) -> Column:
    """The format that a mode makes of an extension; null: skip."""
    out = F.when(F.lit(False), "")
    for target in sorted(set(MODES[mode].values())):
        out = out.when(ext.isin(*[e for e, t in MODES[mode].items() if t == target]), target)
    return out


def guarded(df: DataFrame, path: str, target: str) -> DataFrame:
    """df without the files that are in the target format, both by their name as it is and after the repair of their extension (`repaired`)."""
    ext = lambda c: C.extension(F.col(c))
    rows = df.where(ext(path) != f".{target}").withColumn("repaired", C.normalised_path(F.col(path)))
    return rows.where(ext("repaired") != f".{target}")


def with_steps(df: DataFrame, path: str, target: Column) -> DataFrame:
    """df with the formats that a file goes through: by PNG where its own is one that encoders don't take."""
    ext = C.extension(F.col(path))
    return df.withColumn("steps", F.when(target.isNull(), F.array().cast("array<string>")).when(ext.isin(*INDIRECT), F.array(F.lit("png"), target)).otherwise(F.array(target)))


def tool_formats(df: DataFrame, path: str) -> DataFrame:
    """df with a row for each tool that takes the file's format: tool, out_ext. The matrix is a constant of the plan."""
    ext = F.regexp_replace(C.extension(C.normalised_path(F.col(path))), r"^\.", "")
    rows = F.array(*[F.struct(F.lit(tool).alias("tool"), F.lit("tif" if i == "tiff" else i).alias("in_ext"), F.lit(out).alias("out_ext")) for tool, (ins, out) in TOOL_FORMATS.items() for i in ins])
    own = [F.when(F.concat(F.lit("."), ext).isin(*exts), F.struct(F.lit(tool).alias("tool"), ext.alias("in_ext"), ext.alias("out_ext"))) for tool, exts in KEEPING.items()]
    return df.withColumn("__t", F.explode(F.concat(F.filter(rows, lambda r: r["in_ext"] == ext), F.array_compact(F.array(*own))))).select(*df.columns, F.col("__t.tool").alias("tool"), F.col("__t.out_ext").alias("out_ext"))


def maintained(media: DataFrame, sidecars: DataFrame, content: str = "content") -> DataFrame:
    """The whole maintenance of a collection in its order: extensions are made regular, sidecars merged, duplicates marked.

    media(path, content, tags) with paths of their own and sidecars(path, tags).
    Gives was (the path as it was), path as repaired, tags with those of the sidecar
    (the first by path, if there are several), dup_of (the smallest `was` of equal
    contents) and is_dup. Media without a sidecar stay.
    """
    m = media.withColumns({"was": F.col("path"), "path": C.normalised_path(F.col("path"))}).withColumn("__stem", C.stem(F.col("path")))
    side = sidecars.groupBy(C.stem(F.col("path")).alias("__stem")).agg(F.min_by("tags", "path").alias("__side"))
    own = F.map_filter("tags", lambda k, _: ~F.coalesce(F.map_contains_key("__side", k), F.lit(False)))
    joined = m.join(side, "__stem", "left").withColumn("tags", F.when(F.col("__side").isNull(), F.col("tags")).otherwise(F.map_concat(own, F.col("__side"))))
    marks = C.mark_duplicates(m.select("was", content), content, "was")
    return joined.select("was", "path", "tags").join(marks, "was")


def same_bytes(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose contents are equal byte for byte, after digests have proposed them."""
    return pairs.where(F.col(a).cast("binary") == F.col(b).cast("binary"))


@dataclass(frozen=True)
class Thresholds:
    """What a converted collection must reach."""

    min_compression_ratio: float = 0.1
    min_exif_preservation_rate: float = 0.8
    max_unprocessed_files: int = 0
    enable_size_validation: bool = True
    enable_exif_validation: bool = True


def threshold_verdict(rollup: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """rollup(size_before, size_after, exif_kept, exif_lost, unprocessed, ...) with saved_rate, exif_rate, issues and is_valid.

    A rate without anything to measure is null and no issue.
    """
    kept, lost = F.col("exif_kept"), F.col("exif_lost")
    out = rollup.withColumns({
        "saved_rate": (F.col("size_before") - F.col("size_after")) / F.nullif(F.col("size_before").cast("double"), F.lit(0.0)),
        "exif_rate": kept / F.nullif((kept + lost).cast("double"), F.lit(0.0)),
    })
    issue = lambda bad, name: F.when(F.coalesce(bad, F.lit(False)), F.lit(name))
    found = F.array_compact(F.array(
        issue(F.lit(t.enable_size_validation) & (F.col("saved_rate") < t.min_compression_ratio), "compression"),
        issue(F.lit(t.enable_exif_validation) & (F.col("exif_rate") < t.min_exif_preservation_rate), "metadata"),
        issue(F.col("unprocessed") > t.max_unprocessed_files, "unprocessed"),
    ))
    return out.withColumn("issues", found).withColumn("is_valid", F.size("issues") == 0)


#: The eight layers of verification, in their order.
LAYERS = ("exists", "size", "format", "metadata", "dimensions", "pixels", "quality", "honesty")


def verified(df: DataFrame, checks: dict[str, Column], skip: Column | None = None) -> DataFrame:
    """df with the verdict of all eight layers: ok, the first that failed, and how many passed.

    skip: where true, the layer of pixels counts as passed, as for formats whose
    pixels can't be compared.
    """
    if tuple(checks) != LAYERS:
        raise ValueError(f"checks must be {LAYERS}")
    if skip is not None:
        checks = checks | {"pixels": skip | checks["pixels"]}
    passed = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks.values()), F.lit(0))
    v = C.all_layers(checks)
    return df.withColumns({"ok": v["ok"], "failed": v["failed"], "passed": passed.cast("long")})


def same_aspect(w0: Column, h0: Column, w1: Column, h1: Column, tolerance: float = ASPECT_TOLERANCE) -> Column:
    """Whether two frames have the same width to height within the tolerance; null without a height."""
    a, b = w0 / F.nullif(h0.cast("double"), F.lit(0.0)), w1 / F.nullif(h1.cast("double"), F.lit(0.0))
    return F.abs(a - b) <= tolerance * a


# Settings, with what a missing file and what a missing key in a file give.
SETTINGS = {
    "default_workers": ("bigint", 0), "default_verify_mode": ("string", ""), "log_file_name": ("string", ""), "replace_originals": ("boolean", False), "default_cjxl_threads": ("bigint", 0),
}


def parsed_settings(text: Column, defaults: dict[str, object]) -> Column:
    """Settings of a JSON text as a struct: null (no file) gives the defaults, a key that the text lacks its type's zero, not its default; so does text that is no JSON."""
    schema = ", ".join(f"{k} {kind}" for k, (kind, _) in SETTINGS.items())
    read = F.from_json(text, schema)
    full = F.struct(*[F.coalesce(read[k], F.lit(zero).cast(kind)).alias(k) for k, (kind, zero) in SETTINGS.items()])
    whole = F.struct(*[F.lit(defaults[k]).cast(kind).alias(k) for k, (kind, _) in SETTINGS.items()])
    return F.when(text.isNull(), whole).otherwise(full)


def settings_text(settings: Column) -> Column:
    return F.to_json(settings)


def after_key(df: DataFrame, key: str, prefix: str, after: str | None, most: int) -> DataFrame:
    """A cursor over ordered keys: the next `most` rows whose key begins with prefix and comes after `after`. A top-k, not a global sort."""
    rows = df.where(F.col(key).startswith(prefix))
    return (rows.where(F.col(key) > after) if after is not None else rows).orderBy(key).limit(most)
