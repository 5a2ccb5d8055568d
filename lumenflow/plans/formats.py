"""Queries that go through the text formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenflow.functions import scalars as S
from lumenflow.registry import query
from lumenflow.session import ship_package, table
from lumenflow.sources import formats as X


def _cues(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("n"), (F.col("event_id") * 700_001).alias("start_ms"), (F.col("event_id") * 700_001 + 1500).alias("end_ms"), F.concat("event_type", F.lit("\n"), "props").alias("text"))


_MS = "event_id * 700001"


def _sql_clock(ms: str, sep: str) -> str:
    return f"printf('%02d:%02d:%02d{sep}%03d', ({ms}) // 3600000, ({ms}) // 60000 % 60, ({ms}) // 1000 % 60, ({ms}) % 1000)"


@query(f"SELECT event_id AS n, event_id || chr(10) || {_sql_clock(_MS, ',')} || ' --> ' || {_sql_clock(_MS + ' + 1500', ',')} || chr(10) || event_type || chr(10) || props || chr(10) AS value FROM events")
def srt_sink(spark, sf_dir):
    return X.srt_blocks(_cues(spark, sf_dir))


@query(f"SELECT event_id AS n, ({_MS}) AS start_ms, ({_MS} + 1500) AS end_ms, event_type || chr(10) || props AS text FROM events")
def srt_round_trip(spark, sf_dir):
    files = X.srt_blocks(_cues(spark, sf_dir)).select(F.lit("f").alias("file"), "value")
    return X.parse_srt(files).drop("file")


@query("SELECT (event_id * 700001 // 40) * 40 AS start_ms, ((event_id * 700001 + 1520) // 40) * 40 AS end_ms, event_type AS text FROM events")
def microdvd_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cues = e.select(F.col("event_id").alias("n"), F.expr("(event_id * 700001 div 40) * 40").alias("start_ms"), F.expr("((event_id * 700001 + 1520) div 40) * 40").alias("end_ms"), F.col("event_type").alias("text"))
    return X.parse_subtitles(X.microdvd_lines(cues, 25.0), "microdvd", 25.0)


_ADLER = "(list_reduce(list_prepend(0, list_transform(range(1, len(b) + 1), lambda i: b[i] * (len(b) - i + 1))), lambda x, y: x + y) % 65521 * 65536 + list_sum(b) % 65521)::BIGINT"


@query(
    f"""SELECT event_id::INTEGER % 3 AS stream_index, event_id AS dts, event_id + 1 AS pts, 1::BIGINT AS duration, len(props)::BIGINT AS size, {_ADLER} AS adler,
 event_id % 3 || ', ' || lpad(event_id::VARCHAR, 10, ' ') || ', ' || lpad((event_id + 1)::VARCHAR, 10, ' ') || ',        1, ' || lpad(len(props)::VARCHAR, 8, ' ') || ', 0x' || lower(lpad(to_hex({_ADLER}), 8, '0')) AS line
FROM (SELECT *, list_transform(string_split(props, ''), lambda c: ascii(c)) AS b FROM events)"""
)
def framecrc_round_trip(spark, sf_dir):
    """Lines and what is read back from them, checksum and all."""
    ship_package(spark)
    e = table(spark, sf_dir, "events")
    rows = e.select((F.col("event_id") % 3).cast("int").alias("stream_index"), F.col("event_id").alias("dts"), (F.col("event_id") + 1).alias("pts"), F.lit(1).cast("long").alias("duration"), F.length("props").cast("long").alias("size"), "props")
    lines = X.framecrc_lines(rows, S.adler32(F.col("props"), 0))
    return X.parse_framecrc(lines).join(lines.select("dts", F.col("value").alias("line")), "dts")


_METADATA = "SELECT 'k=' || chr(10) || doc_id AS key, text || ';#\\' AS value FROM documents"


@query(_METADATA)
def metadata_round_trip(spark, sf_dir):
    """Whole texts with their line ends, and a line end in each key."""
    return metadata_round_trip_whole(spark, sf_dir)


@query("SELECT 'k=' || chr(10) || doc_id AS key, text || ';#\\' AS value FROM documents")
def metadata_round_trip_whole(spark, sf_dir):
    """Whole texts with their line ends, and a line end in each key."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.concat(F.lit("k=\n"), F.col("doc_id").cast("string")).alias("k"), F.concat("text", F.lit(";#\\")).alias("v"))
    return X.parse_metadata(X.metadata_lines(rows, "k", "v"))


@query("WITH e AS (SELECT * FROM (VALUES (0, 'view', 100, 500), (1, 'click', 0, 300), (2, 'view', 600, 900)) t(ord, event_type, inpoint, outpoint)), c AS (SELECT ord, event_id FROM events JOIN e USING (event_type) WHERE event_id >= inpoint AND event_id < outpoint), s AS (SELECT ord, min(event_id) AS f, max(event_id) - min(event_id) + 1 AS len FROM c GROUP BY ord), o AS (SELECT ord, f, coalesce(sum(len) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s) SELECT ord, event_id, (event_id - f + off)::BIGINT AS out_pts FROM c JOIN o USING (ord)")
def concat_list(spark, sf_dir):
    entries = spark.sql("SELECT * FROM VALUES (0, 'view', 100L, 500L), (1, 'click', 0L, 300L), (2, 'view', 600L, 900L) AS t(ord, event_type, inpoint, outpoint)")
    return X.concat_list(entries, table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id").select("ord", "event_id", "out_pts")


@query("SELECT row_type, count(*) AS n, sum(size)::BIGINT AS size, count(codec) AS codecs FROM (SELECT 'packet' AS row_type, len(props) AS size, NULL AS codec FROM events UNION ALL SELECT DISTINCT 'stream', NULL, event_type FROM events) GROUP BY row_type")
def probe_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = X.probe_rows(e.select(F.length("props").alias("size")), e.select(F.col("event_type").alias("codec")).distinct())
    return rows.groupBy("row_type").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.count("codec").alias("codecs"))


def _sql_short(ms: str) -> str:
    return f"CASE WHEN ({ms}) >= 3600000 THEN printf('%02d:%02d:%02d.%03d', ({ms}) // 3600000, ({ms}) // 60000 % 60, ({ms}) // 1000 % 60, ({ms}) % 1000) ELSE printf('%02d:%02d.%03d', ({ms}) // 60000 % 60, ({ms}) // 1000 % 60, ({ms}) % 1000) END"


@query(f"SELECT event_id AS n, {_sql_short(_MS)} || ' --> ' || {_sql_short(_MS + ' + 1500')} || chr(10) || event_type || chr(10) || props || chr(10) AS value FROM events")
def webvtt_sink(spark, sf_dir):
    return X.webvtt_blocks(_cues(spark, sf_dir))


@query(f"SELECT event_id::VARCHAR AS file, ({_MS}) AS start_ms, ({_MS} + 1500) AS end_ms, event_type || chr(10) || props AS text FROM events")
def webvtt_round_trip(spark, sf_dir):
    files = X.webvtt_blocks(_cues(spark, sf_dir)).select(F.col("n").cast("string").alias("file"), F.concat(F.lit("WEBVTT\n\n"), "value").alias("value"))
    return X.webvtt_cues(files)


@query("SELECT '# timecode format v2' AS value UNION ALL SELECT printf('%.6f', event_id * 40.04::DOUBLE) FROM events")
def timecode_sink(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") * F.lit(40.04)).alias("ms"))
    return X.timecode_lines(e, "ms").select("value")


@query(
    """SELECT 'pjs' AS kind, event_id * 10 * 100 AS start_ms, (event_id * 10 + 7) * 100 AS end_ms, event_type || chr(10) || 'x' AS text FROM events
UNION ALL SELECT 'stl', (event_id % 86400 * 1000 + event_id % 100 * 10), ((event_id + 2) % 86400 * 1000 + event_id % 100 * 10), event_type || chr(10) || 'x' FROM events
UNION ALL SELECT 'vplayer', event_id % 86400 * 1000, NULL, event_type || chr(10) || 'x' FROM events"""
)
def subtitle_lines(spark, sf_dir):
    """One-line subtitle formats read from lines as their programs write them."""
    e = table(spark, sf_dir, "events")
    clock = lambda s: F.format_string("%02d:%02d:%02d", F.expr(f"({s}) div 3600"), F.expr(f"({s}) div 60 % 60"), F.expr(f"({s}) % 60"))
    text, cents = F.concat("event_type", F.lit("|x")), F.format_string("%02d", F.col("event_id") % 100)
    one, two = "event_id % 86400", "(event_id + 2) % 86400"
    lines = {
        "pjs": F.concat((F.col("event_id") * 10).cast("string"), F.lit(","), (F.col("event_id") * 10 + 7).cast("string"), F.lit(',"'), text, F.lit('"')),
        "stl": F.concat(clock(one), F.lit(":"), cents, F.lit(" , "), clock(two), F.lit(":"), cents, F.lit(" , "), text),
        "vplayer": F.concat(clock(one), F.lit(":"), text),
    }
    out = [X.parse_subtitles(e.select(line.alias("value")), kind).select(F.lit(kind).alias("kind"), "start_ms", "end_ms", "text") for kind, line in lines.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    """SELECT 'subviewer1' AS kind, event_id AS id, ((event_id % 1000) + 5) * 1000 AS start_ms, ((event_id % 1000) + 8) * 1000 AS end_ms, event_type || chr(10) || 'x' AS text FROM events
UNION ALL SELECT 'sami', event_id, event_id * 10, event_id * 10 + 25, event_type || chr(10) || 'x y' FROM events"""
)
def subtitle_blocks(spark, sf_dir):
    """Block formats: a cue lasts until the next time, and an empty one ends it."""
    e = table(spark, sf_dir, "events")
    clock = lambda s: F.format_string("[%02d:%02d:%02d]", F.expr(f"({s}) div 3600"), F.expr(f"({s}) div 60 % 60"), F.expr(f"({s}) % 60"))
    id_ = F.col("event_id").cast("string").alias("file")
    one = F.concat(F.lit("[DELAY]\n5\n"), clock("event_id % 1000"), F.lit("\n"), "event_type", F.lit("|x\n"), clock("event_id % 1000 + 3"), F.lit("\n\n"))
    two = F.concat(F.lit("<SAMI><BODY>\n<SYNC Start="), (F.col("event_id") * 10).cast("string"), F.lit("><P Class=EN>"), "event_type", F.lit("<br>x&nbsp;y</P>\n<SYNC Start="), (F.col("event_id") * 10 + 25).cast("string"), F.lit("><P>&nbsp;</P>\n</BODY></SAMI>"))
    out = [X.parse_subtitle_blocks(e.select(id_, v.alias("value")), k).select(F.lit(k).alias("kind"), F.col("file").cast("long").alias("id"), "start_ms", "end_ms", "text") for k, v in (("subviewer1", one), ("sami", two))]
    return out[0].unionByName(out[1])


@query(
    """WITH l AS (SELECT unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['#tb ' || n_nationkey || ': 1/25', '#media_type ' || n_nationkey || ': video', '#codec_id ' || n_nationkey || ': rawvideo', '#dimensions ' || n_nationkey || ': 352x' || (200 + n_regionkey), '#sar ' || n_nationkey || ': 0/1']
 ELSE ['#tb ' || n_nationkey || ': 1/44100', '#media_type ' || n_nationkey || ': audio', '#codec_id ' || n_nationkey || ': pcm_s16le', '#sample_rate ' || n_nationkey || ': 44100', '#channel_layout_name ' || n_nationkey || ': stereo'] END) AS value FROM nation) SELECT value FROM l"""
)
def hash_header(spark, sf_dir):
    """A hash file's header with nations as streams, of video and audio in turn."""
    n, video = table(spark, sf_dir, "nation"), F.col("n_nationkey") % 2 == 0
    pick = lambda a, b: F.when(video, a).otherwise(b)
    streams = n.select(
        F.col("n_nationkey").alias("stream_index"), F.lit(1).alias("tb_num"), pick(25, 44100).alias("tb_den"), pick("video", "audio").alias("media_type"), pick("rawvideo", "pcm_s16le").alias("codec_id"),
        F.lit(44100).alias("sample_rate"), F.lit("stereo").alias("channel_layout"), F.lit(352).alias("width"), (F.col("n_regionkey") + 200).alias("height"), F.lit("0/1").alias("sar"),
    )
    return X.hash_header(streams).select("value")


@query(
    """WITH b AS (SELECT event_type, ts, event_id, list_transform(string_split(props, ''), lambda c: ascii(c)) AS b FROM events WHERE ts IS NOT NULL), w AS (SELECT event_type, flatten(list(b ORDER BY ts, event_id)) AS b FROM b GROUP BY event_type),
x AS (SELECT event_type, unnest(b)::BIGINT AS v, unnest(range(0, len(b)))::BIGINT AS i, len(b)::BIGINT AS n FROM w)
SELECT event_type, ((any_value(n) + sum(v * (n - i)))::HUGEINT % 65521 * 65536 + (1 + sum(v)) % 65521)::BIGINT AS adler FROM x GROUP BY event_type"""
)
def stream_checksum(spark, sf_dir):
    """One Adler-32 over all bytes of each stream in order, as a checksum sink gives it."""
    ship_package(spark)
    e = table(spark, sf_dir, "events")
    return X.stream_checksum(e, ["event_type"], "ts", ["event_id"], S.adler32(F.col("props"), 0), F.octet_length("props"))


def _crc_sql(kind: str) -> str:
    """A CRC over w(event_type, b), byte by byte over each stream."""
    bits, poly, low = S.CRCS[kind]
    mask = (1 << bits) - 1
    table_ = f"[{', '.join(map(str, S.crc_table(bits, poly, low)))}]"
    step = f"xor(a >> 8, {table_}[(xor(a, x) & 255) + 1])" if low else f"xor((a << 8) & {mask}, {table_}[(xor(a >> {bits - 8}, x) & 255) + 1])"
    return f"list_reduce(list_prepend(0::BIGINT, b), lambda a, x: {step}) AS {kind.lower()}"


@query(
    "WITH b AS (SELECT event_type, ts, event_id, list_transform(string_split(event_id || ',' || user_id || ';', ''), lambda c: ascii(c)::BIGINT) AS b FROM events WHERE ts IS NOT NULL), w AS (SELECT event_type, flatten(list(b ORDER BY ts, event_id)) AS b FROM b GROUP BY event_type) SELECT event_type, "
    + ", ".join(_crc_sql(k) for k in S.CRCS)
    + " FROM w"
)
def stream_crcs(spark, sf_dir):
    """One CRC of each kind over all bytes of each stream in order."""
    ship_package(spark)
    e = table(spark, sf_dir, "events").withColumn("line", F.concat(F.col("event_id").cast("string"), F.lit(","), F.col("user_id").cast("string"), F.lit(";")))
    return X.stream_crcs(e, ["event_type"], "ts", ["event_id"], F.col("line"), {k.lower(): k for k in S.CRCS})


@query("SELECT '<Representation><id>' || l_orderkey || '-' || l_linenumber || '</id><bandwidth>' || l_quantity::BIGINT || '</bandwidth><lang>' || l_returnflag || '</lang></Representation>' AS value FROM lineitem")
def manifest_xml(spark, sf_dir):
    """Elements of a manifest."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_quantity").cast("long").alias("bandwidth"), F.col("l_returnflag").alias("lang"))
    return X.manifest_xml(rows, "Representation", "id", "bandwidth", "lang").select(F.regexp_replace(F.regexp_replace("value", r">\s+<", "><"), r"\s+$", "").alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_tax AS l_discount, l_discount AS l_tax FROM lineitem")
def swapped_planes(spark, sf_dir):
    from lumenflow.operators.kernels import swapped_planes as swapped

    return swapped(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), "l_discount", "l_tax")


@query()
def directory_scan(spark, sf_dir):
    """The files of the tables' own folder, without reading them; where they lie isn't known to SQL, so tests hold it against a walk."""
    return X.scan_files(spark, sf_dir, [".parquet"]).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "size", "ext")


@query(
    """WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations)
SELECT conv_id::VARCHAR AS file, 0::BIGINT AS n, NULL::VARCHAR AS section, 0::BIGINT AS at, 'title' AS key, 'conversation; ' || conv_id || chr(10) || '#' AS value FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT conv_id::VARCHAR, n, 'CHAPTER', unnest([0, 1, 2])::BIGINT, unnest(['START', 'ro=le', 'text']), unnest([turn::VARCHAR, role, text]) FROM t"""
)
def metadata_sections(spark, sf_dir):
    """Each conversation as a metadata file with a chapter for each turn, written and read again: values over several lines, and signs that must be escaped."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")  # a file's sections
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    turns = c.select(F.col("conv_id").cast("string").alias("file"), F.row_number().over(w).cast("long").alias("n"), F.lit("CHAPTER").alias("section"), F.array(entry("START", F.col("turn").cast("string")), entry("ro=le", F.col("role")), entry("text", F.col("text"))).alias("entries"))
    title = F.concat(F.lit("conversation; "), F.col("conv_id").cast("string"), F.lit("\n#"))
    heads = c.select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("file"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("section"), F.array(entry("title", title)).alias("entries"))
    return X.metadata_sections(X.metadata_files(heads.unionByName(turns)))
