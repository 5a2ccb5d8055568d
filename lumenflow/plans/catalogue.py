"""Catalogue queries: pages and documents as files, labels as a processing log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.operators import catalog as C
from lumenflow.operators import maintenance as M
from lumenflow.registry import query
from lumenflow.session import table

_EXT = r"lower(regexp_extract(url, '(\.[^./]*)$', 1))"
#: Documents as files: a path with an extension by source number, and sizes before and after.
_FILES_SQL = """
files AS (SELECT doc_id, source, lang, 'media/' || source || '/' || doc_id || CASE doc_id % 7
   WHEN 0 THEN '.JPEG' WHEN 1 THEN '.png' WHEN 2 THEN '.gif' WHEN 3 THEN '.heic' WHEN 4 THEN '.mp4' WHEN 5 THEN '.tiff' ELSE '.txt' END AS path,
   n_chars AS size_before, (n_chars * (40 + doc_id % 80)) // 100 AS size_after FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ext = F.when(F.lit(False), "")
    for k, e in enumerate((".JPEG", ".png", ".gif", ".heic", ".mp4", ".tiff")):
        ext = ext.when(F.col("doc_id") % 7 == k, e)
    path = F.concat(F.lit("media/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ext.otherwise(".txt"))
    return d.select("doc_id", "source", "lang", path.alias("path"), F.col("n_chars").alias("size_before"), F.expr("(n_chars * (40 + doc_id % 80)) div 100").alias("size_after"))


def _ext() -> F.Column:
    return C.extension(F.col("path"))


_E = r"lower(regexp_extract(path, '(\.[^./]*)$', 1))"
_ROUTE = f"CASE WHEN {_E} IN ('.jpg','.jpeg','.jpe','.jfif','.png','.bmp','.tiff','.heif','.heic') THEN 'jxl' WHEN {_E} IN ('.gif','.webp') THEN 'avif' WHEN {_E} IN ('.mp4','.mov','.webm') THEN 'mp4' END"


@query(f"SELECT page_id, {_EXT} AS ext, CASE WHEN {_EXT} IN ('.jpg','.jpeg') THEN 10 WHEN {_EXT} = '.png' THEN 7 WHEN {_EXT} = '.gif' THEN 5 WHEN {_EXT} = '.webp' THEN 4 WHEN {_EXT} IN ('.heic','.heif','.avif') THEN 3 ELSE 1 END::BIGINT AS priority, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages")
def url_ext_priority(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    ext = C.extension(F.col("url"))
    return p.select("page_id", ext.alias("ext"), C.priority(ext).cast("long").alias("priority"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


@query(f"WITH {_FILES_SQL} SELECT doc_id, {_E} AS ext, CASE WHEN {_E} = '.jpeg' THEN 10 WHEN {_E} = '.png' THEN 7 WHEN {_E} = '.gif' THEN 5 WHEN {_E} = '.heic' THEN 3 ELSE 1 END::BIGINT AS priority FROM files WHERE {_E} <> '.txt' AND NOT starts_with(path, 'media/src3/')")
def filtered_scan(spark, sf_dir):
    """Files of a set of extensions outside one folder."""
    f = files(spark, sf_dir)
    return f.where(M.is_media(_ext()) & ~C.under_prefix(F.col("path"), ["media/src3/"])).select("doc_id", _ext().alias("ext"), C.priority(_ext()).cast("long").alias("priority"))


@query(
    """WITH q AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'avif' WHEN 1 THEN 'jxl' WHEN 2 THEN 'heic' ELSE 'AVIF' END AS fmt, doc_id % 100 AS quality FROM documents)
SELECT doc_id, CASE WHEN fmt IN ('avif','heic','heif') THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END AS min_psnr_db,
 CASE WHEN fmt IN ('avif','heic','heif') THEN 5.0::DOUBLE WHEN quality >= 85 THEN 1.0::DOUBLE WHEN quality >= 70 THEN 2.0::DOUBLE ELSE 5.0::DOUBLE END AS max_pixel_diff_perc FROM q"""
)
def verify_profile(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    fmt = F.when(k == 0, "avif").when(k == 1, "jxl").when(k == 2, "heic").otherwise("AVIF")
    return d.select("doc_id", C.verify_profile(fmt, F.col("doc_id") % 100).alias("p")).select("doc_id", "p.*")


@query(f"WITH {_FILES_SQL} SELECT doc_id, path, {_ROUTE} AS target FROM files WHERE {_ROUTE} IS NOT NULL")
def route_format(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("doc_id", "path", C.route(_ext()).alias("target")).where("target IS NOT NULL")


@query(
    f"WITH {_FILES_SQL} SELECT doc_id, CASE {_ROUTE} WHEN 'jxl' THEN 'image' WHEN 'avif' THEN 'video' WHEN 'mp4' THEN 'video' END AS tool, "
    f"CASE WHEN {_E} = '.jpeg' THEN 'lossless_jpeg=1 effort=7' WHEN {_ROUTE} = 'jxl' THEN 'quality=85' WHEN {_ROUTE} = 'avif' THEN 'crf=32' WHEN {_ROUTE} = 'mp4' THEN 'copy' END AS args FROM files"
)
def encoder_choice(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", C.encoder(_ext()).alias("e")).select("doc_id", F.col("e.tool").alias("tool"), F.array_join("e.args", " ").alias("args"))


@query(f"WITH {_FILES_SQL} SELECT doc_id, (1 - size_after / nullif(size_before::DOUBLE, 0)) * 100 AS saved_percent FROM files")
def compression_ratio(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", C.saved_percent(F.col("size_before"), F.col("size_after")).alias("saved_percent"))


@query(f"WITH {_FILES_SQL} SELECT lang, sum(greatest(size_before - size_after, 0))::BIGINT AS saved, sum(size_after)::DOUBLE / sum(size_before)::DOUBLE * 100 AS ratio_percent FROM files GROUP BY lang")
def savings_clamp(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.groupBy("lang").agg(F.sum(C.saved_bytes(F.col("size_before"), F.col("size_after"))).alias("saved"), (F.sum("size_after").cast("double") / F.sum("size_before").cast("double") * 100).alias("ratio_percent"))


@query(
    """SELECT source, count(*) AS attempted, count(*) FILTER (quality = 1) AS ok, count(*) FILTER (quality = 0) AS failed,
 count(*) FILTER (quality = 1) * 100.0::DOUBLE / count(*) AS ok_percent, count(*) FILTER (quality = 0) * 100.0::DOUBLE / count(*) AS failed_percent,
 CASE WHEN count(*) FILTER (quality = 0) = 0 THEN 0 WHEN count(*) FILTER (quality = 1) > 0 THEN 3 ELSE 2 END::BIGINT AS exit_status
 FROM documents JOIN labels USING (doc_id) GROUP BY source"""
)
def success_rate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    ok, bad = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    out = d.groupBy("source").agg(F.count(F.lit(1)).alias("attempted"), ok.alias("ok"), bad.alias("failed"))
    return out.select("*", (F.col("ok") * F.lit(100.0) / F.col("attempted")).alias("ok_percent"), (F.col("failed") * F.lit(100.0) / F.col("attempted")).alias("failed_percent"), C.exit_status(F.col("ok"), F.col("failed")).cast("long").alias("exit_status"))


@query(f"WITH {_FILES_SQL} SELECT CASE WHEN {_E} IN ('.jpeg','.png','.gif','.heic','.tiff') THEN 'image' WHEN {_E} = '.mp4' THEN 'video' ELSE 'other' END AS family, count(*) AS n, sum(size_before)::BIGINT AS bytes FROM files GROUP BY 1")
def media_families(spark, sf_dir):
    kind = M.family(_ext())
    family = F.when(kind.isin("still", "animated"), "image").otherwise(F.coalesce(kind, F.lit("other")))
    return files(spark, sf_dir).groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"), F.sum("size_before").alias("bytes"))


@query(
    """SELECT d.doc_id, l.doc_id IS NOT NULL AS has_target, l.doc_id IS NOT NULL AND coalesce(l.quality, 0) > 0 AS deletable,
 CASE WHEN l.doc_id IS NULL THEN 'target is missing' ELSE '' END AS issues FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def validate_targets(spark, sf_dir):
    d, t = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return C.validate_targets(d, t, "doc_id", "quality").select("doc_id", "has_target", "deletable", F.array_join("issues", ",").alias("issues"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url || CASE page_id % 3 WHEN 0 THEN '.JPEG' WHEN 1 THEN '.tiff' ELSE '' END, '\.jpeg$', '.jpg', 'i'), '\.tiff$', '.tif', 'i') AS path FROM pages")
def extension_normalise(spark, sf_dir):
    k = F.col("page_id") % 3
    path = F.concat("url", F.when(k == 0, ".JPEG").when(k == 1, ".tiff").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", C.normalised_path(path).alias("path"))


@query(
    """SELECT u.conv_id, u.turn, len(u.text)::BIGINT AS n_question, len(a.text)::BIGINT AS n_answer
 FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"""
)
def sidecar_merge(spark, sf_dir):
    """Each question as a medium, the answer behind it as its sidecar."""
    c = table(spark, sf_dir, "conversations")
    tags = lambda name: F.create_map(F.lit(name), F.length("text").cast("long"))
    media = c.where("role = 'user'").select("conv_id", "turn", F.struct("conv_id", "turn").alias("key"), tags("question").alias("tags"))
    side = c.where("role = 'assistant'").select(F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("key"), tags("answer").alias("tags"))
    return C.pair_sidecars(media, side, "key").select("conv_id", "turn", F.col("tags")["question"].alias("n_question"), F.col("tags")["answer"].alias("n_answer"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS dup_of, doc_id <> min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS is_dup FROM documents")
def dedup_exact(spark, sf_dir):
    return C.mark_duplicates(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(
    f"""WITH {_FILES_SQL}, w(kind, target, lo, hi) AS (VALUES ('png','jxl',0.01,1.0),('gif','avif',0.03,5.0),('any','any',0.01,10.0)),
 r AS (SELECT doc_id, CASE WHEN {_E} = '.png' THEN 'png' WHEN {_E} = '.gif' THEN 'gif' ELSE 'any' END AS kind, size_after::DOUBLE / nullif(size_before, 0) AS ratio FROM files)
SELECT doc_id, r.kind, w.target, ratio FROM r JOIN w ON r.kind = w.kind AND ratio BETWEEN w.lo::DOUBLE AND w.hi::DOUBLE"""
)
def ratio_windows(spark, sf_dir):
    kind = F.when(_ext() == ".png", "png").when(_ext() == ".gif", "gif").otherwise("any")
    rows = files(spark, sf_dir).select("doc_id", kind.alias("kind"), (F.col("size_after").cast("double") / F.nullif(F.col("size_before"), F.lit(0))).alias("ratio"))
    return C.ratio_verdicts(rows, C.ratio_windows(spark)).select("doc_id", "d.kind", "target", "ratio")


@query(
    """SELECT lang, count(*) AS total, count(l.doc_id) AS processed, (count(*) - count(l.doc_id)) AS skipped, coalesce(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END), 0)::BIGINT AS failed, sum(n_chars)::BIGINT AS bytes
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ROLLUP (lang)"""
)
def validation_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    log = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("done"), "quality")
    out = d.join(log, d.doc_id == log.done, "left").rollup("lang")
    return out.agg(F.count(F.lit(1)).alias("total"), F.count("done").alias("processed"), (F.count(F.lit(1)) - F.count("done")).alias("skipped"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("failed"), F.sum("n_chars").alias("bytes"))


@query("SELECT source, count(*) AS unprocessed FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def failure_reasons(spark, sf_dir):
    left = C.unprocessed(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")
    return left.groupBy("source").agg(F.count(F.lit(1)).alias("unprocessed"))


@query(
    """SELECT doc_id, CASE WHEN len(text) < 40 THEN 'exists' ELSE CASE WHEN n_chars < 100 THEN 'size' WHEN lang NOT IN ('en','fr') THEN 'format' WHEN NOT contains(text, ' ') THEN 'metadata' ELSE NULL END END AS failed,
 NOT (len(text) < 40 OR n_chars < 100 OR lang NOT IN ('en','fr') OR NOT contains(text, ' ')) AS ok FROM documents"""
)
def layered_verification(spark, sf_dir):
    checks = {"exists": F.length("text") >= 40, "size": F.col("n_chars") >= 100, "format": F.col("lang").isin("en", "fr"), "metadata": F.col("text").contains(" ")}
    return table(spark, sf_dir, "documents").select("doc_id", C.all_layers(checks).alias("v")).select("doc_id", F.col("v.failed").alias("failed"), F.col("v.ok").alias("ok"))


_HEADS = ["", "FFD8FF", "89504E47", "47494638", "424D", "52494646"]


@query(
    f"""WITH c AS (SELECT page_id, html, unhex({_HEADS}[page_id % 6 + 1]) || encode(html) AS content FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' WHEN 3 THEN 'gif' WHEN 4 THEN 'bmp' WHEN 5 THEN 'riff' ELSE CASE WHEN starts_with(html, '<') THEN 'html' END END AS kind, sha256(content) AS id FROM c"""
)
def content_sniff(spark, sf_dir):
    """Kind by first bytes, and a hash id that falls back on the address; pages behind the first bytes of other formats."""
    p = table(spark, sf_dir, "pages")
    head = F.get(F.array(*[F.lit(h) for h in _HEADS]), (F.col("page_id") % 6).cast("int"))
    content = F.concat(F.unhex(head), F.col("html").cast("binary"))
    return p.select("page_id", C.sniffed(content).alias("kind"), C.first_success(F.sha2(content, 256), F.sha2(F.col("url").cast("binary"), 256)).alias("id"))


@query(f"WITH {_FILES_SQL} SELECT doc_id, path FROM files WHERE (starts_with(path, 'media/src1/') OR starts_with(path, 'media/src12/') OR starts_with(path, 'media/src2/')) AND NOT starts_with(path, 'media/src12/')")
def path_lists(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).where(C.under_prefix(p, ["media/src1", "media/src12", "media/src2"]) & ~C.under_prefix(p, ["media/src12"])).select("doc_id", "path")


@query(
    """SELECT bucket, count(*) AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, avg(score) AS mean_score FROM
 (SELECT lang, n_chars / 1000.0::DOUBLE AS score, CASE WHEN n_chars < 200 THEN 'corrupted' WHEN n_chars < 1000 THEN 'low' ELSE 'good' END AS bucket FROM documents) GROUP BY bucket"""
)
def batch_decisions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    bucket = F.when(F.col("n_chars") < 200, "corrupted").when(F.col("n_chars") < 1000, "low").otherwise("good")
    return d.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.avg(F.col("n_chars") / F.lit(1000.0)).alias("mean_score"))


@query(
    """WITH e AS (SELECT source, count(*) AS expected FROM documents GROUP BY source), a AS (SELECT source, count(*) AS actual FROM documents JOIN labels USING (doc_id) GROUP BY source)
 SELECT source, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, coalesce(expected, 0) - coalesce(actual, 0) AS missing FROM e FULL JOIN a USING (source)"""
)
def count_reconcile(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return C.reconcile(d, d.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi"), "source")


@query(f"WITH {_FILES_SQL} SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN path END, CASE WHEN doc_id % 2 = 0 THEN 'alt/' || source END, 'none') AS tool FROM files")
def fallback_chain(spark, sf_dir):
    first, second = F.when(F.col("doc_id") % 5 == 0, F.col("path")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("alt/"), "source"))
    return files(spark, sf_dir).select("doc_id", C.first_success(first, second, F.lit("none")).alias("tool"))


@query(
    """WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS i, CASE WHEN doc_id % 2 = 0 THEN lang END AS d FROM documents)
 SELECT doc_id, coalesce(nullif(i, ''), nullif(d, '')) AS root, nullif(i, '') IS NULL AND nullif(d, '') IS NOT NULL AS deprecated FROM f"""
)
def normalise_flags(spark, sf_dir):
    i, d = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(""), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", C.normalise_input(i, d).alias("n")).select("doc_id", "n.*")


@query(
    """SELECT * FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3"""
)
def largest_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return C.ranked(d, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3)


@query("SELECT doc_id, source, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1")
def keep_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return C.keep_first(d, ["source", "lang"], [-F.col("n_chars"), F.col("doc_id")])


@query("SELECT d.doc_id, (n_chars > 5000 OR l.quality = 0) AS suspicious, CASE WHEN n_chars > 5000 OR l.quality = 0 THEN md5(text) END AS deep FROM documents d LEFT JOIN labels l USING (doc_id)")
def two_stage_scan(spark, sf_dir):
    """A cheap predicate for all rows; the costly check only for those that it finds suspicious."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    bad = (F.col("n_chars") > 5000) | (F.col("quality") == 0)
    return d.select("doc_id", bad.alias("suspicious"), F.when(bad, F.md5(F.col("text").cast("binary"))).alias("deep"))
