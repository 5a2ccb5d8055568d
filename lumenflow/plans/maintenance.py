"""Queries of collection maintenance: documents as media of all kinds of extensions, labels as a log, conversations as sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.operators import catalog as C
from lumenflow.operators import maintenance as M
from lumenflow.registry import query
from lumenflow.session import table

_EXTS = ["JPG", "jpeg", "jpe", "jfif", "png", "gif", "webp", "bmp", "tiff", "tif", "ico", "svg", "avif", "jxl", "heif", "heic", "apng", "mng", "mp4", "mov", "avi", "mkv", "webm", "flv", "wmv", "m4v", "3gp", "txt", "tar.gz", ""]
_LIST = "[" + ", ".join(f"'{'.' + e if e else ''}'" for e in _EXTS) + "]"
#: Media: an extension of each kind in turn.
_M = f"m AS (SELECT doc_id, n_chars, lang, text, 'media/' || source || '/f' || doc_id || ({_LIST})[doc_id % 30 + 1] AS path FROM documents)"
_X = r"lower(regexp_extract(path, '(\.[^./]*)$', 1))"
_FAMILY = f"CASE WHEN {_X} IN ('.jpg', '.jpeg', '.jpe', '.jfif', '.png', '.gif', '.webp', '.bmp', '.tiff', '.tif', '.ico', '.svg', '.avif', '.jxl', '.heif', '.heic') THEN 'still' WHEN {_X} IN ('.apng', '.mng') THEN 'animated' WHEN {_X} IN ('.mp4', '.mov', '.avi', '.mkv', '.webm', '.flv', '.wmv', '.m4v', '.3gp') THEN 'video' END"


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    exts = F.array(*[F.lit(f".{e}" if e else "") for e in _EXTS])
    path = F.concat(F.lit("media/"), "source", F.lit("/f"), F.col("doc_id").cast("string"), F.get(exts, (F.col("doc_id") % 30).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "text", path.alias("path"))


def _ext() -> F.Column:
    return C.extension(F.col("path"))


@query(
    f"""WITH {_M} SELECT doc_id, {_FAMILY} AS family, {_FAMILY} IS NOT NULL AS media,
 {_X} IN ('.jpg', '.jpeg', '.jpe', '.jfif', '.png', '.gif', '.webp', '.bmp', '.heif', '.heic', '.tiff', '.avif', '.mp4', '.mov', '.webm') AS checked FROM m"""
)
def media_whitelists(spark, sf_dir):
    """The list of media in its three families, and the conversion check's own list."""
    return media(spark, sf_dir).select("doc_id", M.family(_ext()).alias("family"), M.is_media(_ext()).alias("media"), M.is_checked(_ext()).alias("checked"))


@query(
    f"""WITH {_M} SELECT doc_id, CASE WHEN {_X} IN ('.jpg', '.jpeg', '.png') THEN 'jxl' WHEN {_X} = '.gif' THEN 'avif' WHEN {_X} = '.mp4' THEN 'mov' END AS optimized,
 CASE WHEN {_FAMILY} IN ('still', 'animated') THEN 'avif' END AS sticker FROM m"""
)
def modes(spark, sf_dir):
    """What the two modes make of a file; videos are skipped by the one for stickers."""
    return media(spark, sf_dir).select("doc_id", M.target_format(_ext(), "optimized").alias("optimized"), M.target_format(_ext(), "sticker").alias("sticker"))


@query(
    f"""WITH {_M}, t AS (SELECT doc_id, path, CASE WHEN {_FAMILY} IN ('still', 'animated') THEN 'avif' END AS target FROM m)
SELECT doc_id, CASE WHEN target IS NULL THEN '' WHEN {_X} IN ('.ico', '.svg', '.bmp', '.tiff', '.tif', '.heic', '.heif') THEN 'png>avif' ELSE 'avif' END AS steps FROM t"""
)
def preprocessor_chain(spark, sf_dir):
    rows = M.with_steps(media(spark, sf_dir), "path", M.target_format(_ext(), "sticker"))
    return rows.select("doc_id", F.array_join("steps", ">").alias("steps"))


@query(rf"WITH {_M} SELECT doc_id, regexp_replace(regexp_replace(path, '\.jpeg$', '.jpg', 'i'), '\.tiff$', '.tif', 'i') AS repaired FROM m WHERE NOT regexp_matches(path, '\.(jpg|jpeg)$', 'i')")
def target_guard(spark, sf_dir):
    """Files that aren't in the target format, neither by name nor after the repair of their extension."""
    return M.guarded(media(spark, sf_dir), "path", "jpg").select("doc_id", "repaired")


_TOOLS = "(VALUES ('all2avif', ['jpg', 'png', 'bmp', 'tif', 'gif', 'webp', 'jxl', 'heic'], 'avif'), ('all2jxl', ['jpg', 'png', 'bmp', 'tif', 'gif', 'webp', 'avif', 'heic'], 'jxl'), ('static2avif', ['jpg', 'png', 'bmp', 'tif'], 'avif'), ('dynamic2avif', ['gif', 'webp', 'jxl'], 'avif'), ('static2jxl', ['jpg', 'png', 'bmp', 'tif'], 'jxl'), ('dynamic2jxl', ['gif', 'webp', 'avif'], 'jxl'), ('video2mov', ['mp4', 'avi', 'mkv', 'mov'], 'mov')) t(tool, ins, out_ext)"


_KEEPING = f"(VALUES {', '.join(f'({tool!r}, {list(exts)!r})' for tool, exts in M.KEEPING.items())}) k(tool, exts)"


@query(rf"WITH {_M}, e AS (SELECT doc_id, regexp_replace(regexp_replace({_X}, '^\.jpeg$', '.jpg'), '^\.tiff$', '.tif') AS ext FROM m) SELECT doc_id, tool, out_ext FROM e JOIN {_TOOLS} ON list_contains(ins, e.ext[2:]) UNION ALL SELECT doc_id, tool, e.ext[2:] FROM e JOIN {_KEEPING} ON list_contains(exts, e.ext)")
def tool_matrix(spark, sf_dir):
    return M.tool_formats(media(spark, sf_dir), "path").select("doc_id", "tool", "out_ext")


@query(
    rf"""WITH {_M}, n AS (SELECT path AS was, regexp_replace(regexp_replace(path, '\.jpeg$', '.jpg', 'i'), '\.tiff$', '.tif', 'i') AS path, text, lang FROM m),
d AS (SELECT was, min(was) OVER (PARTITION BY sha256(coalesce(text, ''))) AS dup_of FROM n)
SELECT n.was, n.path, CASE WHEN doc_id IS NULL THEN n.lang ELSE 'side' || doc_id END AS lang, CASE WHEN doc_id IS NOT NULL THEN 'yes' END AS merged, d.dup_of, n.was <> d.dup_of AS is_dup
FROM n JOIN d USING (was) LEFT JOIN (SELECT doc_id, regexp_replace(path, '\.[^./]*$', '') AS stem FROM m WHERE doc_id % 4 = 0) s ON s.stem = regexp_replace(n.path, '\.[^./]*$', '')"""
)
def auto_maintenance(spark, sf_dir):
    """Extensions made regular, then every fourth file's sidecar merged, then duplicates marked."""
    m = media(spark, sf_dir)
    side = m.where("doc_id % 4 = 0").select(F.concat("path", F.lit(".xmp")).alias("path"), F.create_map(F.lit("lang"), F.concat(F.lit("side"), F.col("doc_id").cast("string")), F.lit("merged"), F.lit("yes")).alias("tags"))
    out = M.maintained(m.select("path", "text", F.create_map(F.lit("lang"), F.col("lang")).alias("tags")), side, "text")
    return out.select("was", "path", F.col("tags")["lang"].alias("lang"), F.col("tags")["merged"].alias("merged"), "dup_of", "is_dup")


@query(
    """WITH r AS (SELECT source, sum(n_chars) AS b, sum((n_chars * (40 + d.doc_id % 80)) // 100) AS a, count(*) FILTER (toxic = 0) AS kept, count(*) FILTER (toxic = 1) AS lost, count(*) - count(l.doc_id) AS un FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source),
v AS (SELECT *, (b - a) / nullif(b::DOUBLE, 0) AS saved_rate, kept / nullif((kept + lost)::DOUBLE, 0) AS exif_rate FROM r)
SELECT source, kept AS exif_kept, lost AS exif_lost, un AS unprocessed, saved_rate, exif_rate,
 concat_ws(',', CASE WHEN saved_rate < 0.25::DOUBLE THEN 'compression' END, CASE WHEN exif_rate < 0.9::DOUBLE THEN 'metadata' END, CASE WHEN un > 25 THEN 'unprocessed' END) AS issues,
 coalesce(NOT (saved_rate < 0.25::DOUBLE), true) AND coalesce(NOT (exif_rate < 0.9::DOUBLE), true) AND un <= 25 AS is_valid FROM v"""
)
def validation_thresholds(spark, sf_dir):
    """Saved bytes, metadata kept and lost, and unprocessed files by folder, held against thresholds."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    log = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("done"), "toxic")
    rows = d.join(log, d.doc_id == log.done, "left").groupBy("source").agg(
        F.sum("n_chars").alias("size_before"), F.sum(F.expr("(n_chars * (40 + doc_id % 80)) div 100")).alias("size_after"), F.count_if(F.col("toxic") == 0).alias("exif_kept"), F.count_if(F.col("toxic") == 1).alias("exif_lost"), (F.count(F.lit(1)) - F.count("done")).alias("unprocessed")
    )
    out = M.threshold_verdict(rows, M.Thresholds(min_compression_ratio=0.25, min_exif_preservation_rate=0.9, max_unprocessed_files=25))
    return out.select("source", "exif_kept", "exif_lost", "unprocessed", "saved_rate", "exif_rate", F.array_join("issues", ",").alias("issues"), "is_valid")


_W, _H = "(100 + doc_id % 60)", "(80 + doc_id % 7)"
_CHECKS = ["l.doc_id IS NOT NULL", "n_chars >= 100", "lang IN ('en', 'fr')", "contains(text, ' ')", f"abs({_W} / {_H}::DOUBLE - 128 / 83::DOUBLE) <= 0.15::DOUBLE * ({_W} / {_H}::DOUBLE)", "d.doc_id % 5 = 0 OR n_chars % 9 > 0", "quality = 1", "toxic = 0"]
_NAMES = ["exists", "size", "format", "metadata", "dimensions", "pixels", "quality", "honesty"]


@query(
    f"WITH c AS (SELECT d.doc_id, {', '.join(f'coalesce({c.replace('doc_id %', 'd.doc_id %').replace('d.d.', 'd.')}, false) AS {n}' for c, n in zip(_CHECKS, _NAMES, strict=True))} FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) "
    f"SELECT doc_id, {' AND '.join(_NAMES)} AS ok, CASE {' '.join(f"WHEN NOT {n} THEN '{n}'" for n in _NAMES)} END AS failed, ({' + '.join(f'{n}::BIGINT' for n in _NAMES)})::BIGINT AS passed FROM c"
)
def eight_layers(spark, sf_dir):
    """All eight layers of verification; the pixels of every fifth file can't be compared."""
    d = table(spark, sf_dir, "documents")
    rows = d.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("done"), "quality", "toxic"), d.doc_id == F.col("done"), "left")
    checks = {
        "exists": F.col("done").isNotNull(), "size": F.col("n_chars") >= 100, "format": F.col("lang").isin("en", "fr"), "metadata": F.col("text").contains(" "),
        "dimensions": M.same_aspect(100 + F.col("doc_id") % 60, 80 + F.col("doc_id") % 7, F.lit(128), F.lit(83)), "pixels": F.col("n_chars") % 9 > 0, "quality": F.col("quality") == 1, "honesty": F.col("toxic") == 0,
    }
    return M.verified(rows, checks, skip=F.col("doc_id") % 5 == 0).select("doc_id", "ok", "failed", "passed")


@query(
    """WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '{"default_workers": ' || doc_id || ', "log_file_name": "' || source || '.log"}' ELSE '{"default_verify_mode": "loose", "replace_originals": true, "default_cjxl_threads": 4}' END AS t FROM documents)
SELECT doc_id, CASE WHEN t IS NULL THEN 8 ELSE coalesce(json_extract_string(t, '$.default_workers')::BIGINT, 0) END AS workers, CASE WHEN t IS NULL THEN 'strict' ELSE coalesce(json_extract_string(t, '$.default_verify_mode'), '') END AS mode,
 CASE WHEN t IS NULL THEN 'run.log' ELSE coalesce(json_extract_string(t, '$.log_file_name'), '') END AS log_name, CASE WHEN t IS NULL THEN true ELSE coalesce(json_extract_string(t, '$.replace_originals')::BOOLEAN, false) END AS replaces,
 CASE WHEN t IS NULL THEN 1 ELSE coalesce(json_extract_string(t, '$.default_cjxl_threads')::BIGINT, 0) END AS threads FROM s"""
)
def settings(spark, sf_dir):
    """Settings from JSON, written and read again: no text gives the defaults, a missing key its type's zero."""
    k = F.col("doc_id") % 3
    text = F.when(k == 1, F.to_json(F.struct(F.col("doc_id").alias("default_workers"), F.concat("source", F.lit(".log")).alias("log_file_name")))).when(k == 2, '{"default_verify_mode": "loose", "replace_originals": true, "default_cjxl_threads": 4}')
    defaults = {"default_workers": 8, "default_verify_mode": "strict", "log_file_name": "run.log", "replace_originals": True, "default_cjxl_threads": 1}
    d = table(spark, sf_dir, "documents").select("doc_id", M.settings_text(M.parsed_settings(text, defaults)).alias("t"))
    s = M.parsed_settings(F.col("t"), defaults)
    return d.select("doc_id", s.alias("s")).select("doc_id", *[F.col(f"s.{k}").alias(n) for k, n in zip(M.SETTINGS, ("workers", "mode", "log_name", "replaces", "threads"), strict=True)])


@query(
    """WITH b AS (SELECT doc_id, lang, CASE WHEN n_chars < 200 THEN 'corrupted' WHEN n_chars < 1000 THEN 'low' ELSE 'good' END AS bucket,
 list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN NOT contains(text, ' ') THEN 'one word' END, CASE WHEN lang NOT IN ('en', 'fr') THEN 'language' END], lambda x: x IS NOT NULL) AS reasons FROM documents)
SELECT bucket, reason, count(*) AS n FROM (SELECT bucket, unnest(reasons) AS reason FROM b) GROUP BY ALL"""
)
def decision_reasons(spark, sf_dir):
    """Why files are in a bucket: each reason and how often it is given."""
    d = table(spark, sf_dir, "documents")
    bucket = F.when(F.col("n_chars") < 200, "corrupted").when(F.col("n_chars") < 1000, "low").otherwise("good")
    why = lambda c, name: F.when(c, F.lit(name))
    reasons = F.array_compact(F.array(why(F.col("n_chars") < 200, "short"), why(~F.col("text").contains(" "), "one word"), why(~F.col("lang").isin("en", "fr"), "language")))
    return d.select(bucket.alias("bucket"), F.explode(reasons).alias("reason")).groupBy("bucket", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_M} SELECT path FROM m WHERE starts_with(path, 'media/src2/') AND path > 'media/src2/f2' ORDER BY path LIMIT 20")
def key_cursor(spark, sf_dir):
    """The next twenty keys of a prefix behind a place: a top-k by its nature."""
    return M.after_key(media(spark, sf_dir).select("path"), "path", "media/src2/", "media/src2/f2", 20)


@query("SELECT a.doc_id, b.doc_id AS other FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) AND a.text = b.text AND a.doc_id = (SELECT min(c.doc_id) FROM documents c WHERE c.text = b.text) WHERE a.doc_id < b.doc_id")
def dedup_compared(spark, sf_dir):
    """Digests propose a copy's first file, and the bytes of the two are compared."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL")
    marks = C.mark_duplicates(d, "text", "doc_id").where("is_dup").select(F.col("doc_id").alias("other"), F.col("dup_of").alias("doc_id"))
    copies = marks.join(d.select(F.col("doc_id").alias("other"), F.col("text").alias("b")), "other")
    pairs = copies.join(d.select("doc_id", F.col("text").alias("a")), "doc_id")
    return M.same_bytes(pairs, "a", "b").select("doc_id", "other")
