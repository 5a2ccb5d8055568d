"""Line-oriented formats as DataFrame sources and sinks.

Writers give a DataFrame of one text column (and an order column where lines must
keep their order), for df.write.text; readers take a DataFrame of lines with the
file they come from. Nothing is read by the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, root: str, exts: list[str] | None = None, content: bool = False) -> DataFrame:
    """path, size, modified, ext of all files below root, without reading them unless content is asked for; no exts: all."""
    from lumenflow.operators.catalog import extension

    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    df = df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else [])).withColumn("ext", extension(F.col("path")))
    return df.where(F.col("ext").isin(*exts)) if exts else df


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, size, is_dir and mod_time (whole seconds since 1970) of all files below root and of the directories that hold them.

    Directories come from the files' paths, so one without a file anywhere below it
    isn't seen, nor is an empty file, which Spark's file source leaves out; a directory's
    size is 0 and its time that of the latest file below it. Files that go while they are listed are left out, as files that can't be looked at are;
    their contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    files = files.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mod_time"))
    # Paths may begin with a scheme that root leaves out: a directory counts if root's own path is in front of it.
    base = re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    own = F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "")
    steps = F.split(F.substr(own, F.lit(len(base) + 2)), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.concat(F.substr(F.col("path"), F.lit(1), F.char_length("path") - F.char_length(F.array_join(F.slice(steps, n + 1, F.size(steps)), "/")) - 1)))
    folders = files.where(F.size(steps) > 1).select(F.explode(above).alias("path"), "mod_time").groupBy("path").agg(F.max("mod_time").alias("mod_time"))
    both = files.select("path", "size", F.lit(False).alias("is_dir"), "mod_time")
    return both.unionByName(folders.select("path", F.lit(0).cast("long").alias("size"), F.lit(True).alias("is_dir"), "mod_time"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file and the number of the line in its file, for files that fit one task each."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("__all"))
    return whole.select("file", F.posexplode(F.split("__all", "\r?\n")).alias("n", "value"))


def write_report(df: DataFrame, path: str, kind: str) -> None:
    """A report as JSON lines, one JSON array (json-array) or CSV with a header, replacing what is there; an empty path does nothing."""
    if not path:
        return
    if kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "json-array":  # one document, written by one task: for reports, whose rows are few
        df.agg(F.to_json(F.coalesce(F.collect_list(F.struct(*df.columns)), F.array())).alias("value")).write.mode("overwrite").text(path)
    elif kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"no report of kind {kind}")


def framecrc_lines(df: DataFrame, adler: Column) -> DataFrame:
    """Lines 'stream, dts, pts, duration, size, 0xadler' of df(stream_index, dts, pts, duration, size)."""
    num = lambda c, w: F.lpad(F.col(c).cast("string"), w, " ")
    value = F.concat(F.col("stream_index").cast("string"), F.lit(", "), num("dts", 10), F.lit(", "), num("pts", 10), F.lit(", "), num("duration", 8), F.lit(", "), num("size", 8), F.lit(", 0x"), F.lower(F.lpad(F.hex(adler), 8, "0")))
    return df.select("stream_index", "dts", value.alias("value"))


def parse_framecrc(df: DataFrame) -> DataFrame:
    """Rows of such lines; lines that begin with # are a header."""
    p = F.split(F.col("value"), r",\s*")
    ok = df.where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    at = lambda i: F.trim(p[i])
    return ok.select(at(0).cast("int").alias("stream_index"), *[at(i).cast("long").alias(n) for i, n in enumerate(("dts", "pts", "duration", "size"), 1)], F.conv(F.substr(at(5), F.lit(3)), 16, 10).cast("long").alias("adler"))


def escape_metadata(c: Column) -> Column:
    return F.regexp_replace(c, r"([=;#\\\n])", r"\\$1")


def metadata_lines(df: DataFrame, key: str, value: str) -> DataFrame:
    """';FFMETADATA1' and then key=value lines, = ; # \\ and line ends escaped."""
    body = df.select(F.lit(1).alias("part"), F.concat(escape_metadata(F.col(key)), F.lit("="), escape_metadata(F.col(value))).alias("value"))
    head = df.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(";FFMETADATA1").alias("value"))
    return head.unionByName(body)


def parse_metadata(df: DataFrame) -> DataFrame:
    """key and value of unescaped lines; comments and section heads are left out. Values that run over lines must be joined before."""
    plain = lambda c: F.regexp_replace(c, r"\\([=;#\\\n])", "$1")
    rows = df.where(~F.col("value").rlike(r"^[;#\[]") & F.col("value").contains("="))
    cut = r"^((?:[^=\\]++|\\(?s:.))*+)=((?s:.*))$"
    return rows.select(plain(F.regexp_extract("value", cut, 1)).alias("key"), plain(F.regexp_extract("value", cut, 2)).alias("value"))


def metadata_files(sections: DataFrame) -> DataFrame:
    """file and value: a whole metadata file for each file of sections(file, n, section, entries), where entries are array<struct<key, value>>.

    Section 0 holds the global entries and needs no name; others come in order of n
    under their names in brackets. Rows without entries give their heads alone.
    """
    body = F.transform("entries", lambda e: F.concat(escape_metadata(e["key"]), F.lit("="), escape_metadata(e["value"])))
    head = F.when(F.col("n") > 0, F.array(F.concat(F.lit("["), F.col("section"), F.lit("]")))).otherwise(F.array().cast("array<string>"))
    own = sections.select("file", "n", F.concat(head, F.coalesce(body, F.array().cast("array<string>"))).alias("lines"))
    parts = own.groupBy("file").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "lines"))), lambda x: x["lines"])).alias("lines"))
    return parts.select("file", F.concat(F.lit(";FFMETADATA1\n"), F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\n"))), "")).alias("value"))


def metadata_sections(files: DataFrame) -> DataFrame:
    """file, n, section, at, key and value of the entries in files(file, value), where value is a whole metadata file.

    A line that ends in a backslash goes on in the next one. n counts the sections of a
    file, 0 (with a null name) being what stands before the first; at is the entry's
    place in its section. Comments, blank lines and lines without an assignment are left out.
    """
    # Java repeats a possessive group in a loop, a greedy one by calling itself for each character.
    logical = F.regexp_extract_all("value", F.lit(r"(?:[^\\\r\n]++|\\(?s:.)|\\$)++"), F.lit(0))
    kept = F.filter(logical, lambda x: ~x.rlike("^[;#]"))
    # Lines of a file are one row already; a running count of heads numbers the sections.
    rows = files.select("file", F.posexplode(kept).alias("line", "x")).withColumn("head", F.col("x").rlike(r"^\[[^\]]*\]\s*$"))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"n": F.sum(F.col("head").cast("long")).over(w), "section": F.last(F.when(F.col("head"), F.regexp_extract("x", r"^\[([^\]]*)\]", 1)), ignorenulls=True).over(w)})
    plain = lambda c: F.regexp_replace(c, r"\\((?s:.))", "$1")
    cut = r"^((?:[^=\\]++|\\(?s:.))*+)=((?s:.*))$"
    rows = rows.where(~F.col("head") & F.col("x").rlike(cut))
    place = F.row_number().over(Window.partitionBy("file", "n").orderBy("line")) - 1
    return rows.select("file", "n", "section", place.cast("long").alias("at"), plain(F.regexp_extract("x", cut, 1)).alias("key"), plain(F.regexp_extract("x", cut, 2)).alias("value"))


def _clock(ms: Column, comma: str, hours: bool = True) -> Column:
    h, m, s, f = ((ms / k).cast("long") % n for k, n in ((3_600_000, 10**9), (60_000, 60), (1000, 60), (1, 1000)))
    short = F.format_string(f"%02d:%02d{comma}%03d", m, s, f)
    long_ = F.format_string(f"%02d:%02d:%02d{comma}%03d", h, m, s, f)
    return long_ if hours else F.when(h > 0, long_).otherwise(short)


def srt_blocks(df: DataFrame) -> DataFrame:
    """SubRip blocks of df(n, start_ms, end_ms, text)."""
    return df.select("n", F.concat(F.col("n").cast("string"), F.lit("\n"), _clock(F.col("start_ms"), ","), F.lit(" --> "), _clock(F.col("end_ms"), ","), F.lit("\n"), "text", F.lit("\n")).alias("value"))


def webvtt_blocks(df: DataFrame) -> DataFrame:
    """WebVTT cues of df(n, start_ms, end_ms, text); hours only where there are any."""
    return df.select("n", F.concat(_clock(F.col("start_ms"), ".", False), F.lit(" --> "), _clock(F.col("end_ms"), ".", False), F.lit("\n"), "text", F.lit("\n")).alias("value"))


def microdvd_lines(df: DataFrame, fps: float) -> DataFrame:
    frame = lambda c: F.round(F.col(c) * F.lit(fps) / 1000).cast("long").cast("string")
    return df.select("n", F.concat(F.lit("{"), frame("start_ms"), F.lit("}{"), frame("end_ms"), F.lit("}"), F.replace("text", F.lit("\n"), F.lit("|"))).alias("value"))


# Line patterns of subtitle formats, with start, end and text as groups.
SUBTITLES = {
    "srt": (r"^(\d+):(\d+):(\d+),(\d+) --> (\d+):(\d+):(\d+),(\d+)", 1),
    "mpl2": (r"^\[(\d+)\]\[(\d*)\](.*)$", 100),
    "vplayer": (r"^(\d+):(\d+):(\d+)[ :=](.*)$", 1000),
    "microdvd": (r"^\{(\d+)\}\{(\d*)\}(.*)$", 0),
    "pjs": (r'^\s*(\d+),\s*(\d+),"?([^"]*)"?.*$', 100),
    "stl": (r"^(\d+):(\d+):(\d+):(\d+)\s*,\s*(\d+):(\d+):(\d+):(\d+)\s*,\s*(.*)$", 10),
}
BLOCK_SUBTITLES = {
    "subviewer1": r"(?m)^\[(\d+):(\d+):(\d+)\][ \t]*\r?\n([^\r\n]*)",
    "sami": r"(?is)<SYNC\s+Start\s*=\s*\"?(\d+)\"?[^>]*>(.*?)(?=<SYNC\b|</BODY>|$)",
}


def parse_subtitles(df: DataFrame, kind: str, fps: float = 25.0) -> DataFrame:
    """start_ms, end_ms and text of one-line formats (mpl2, microdvd, pjs, stl, vplayer, whose end is null); other lines, and pjs lines that end before they start, are left out."""
    pattern, unit = SUBTITLES[kind]
    g = lambda i: F.regexp_extract("value", pattern, i)
    rows = df.where(F.col("value").rlike(pattern))
    if kind == "stl":
        at = lambda i: (g(i).cast("long") * 3600 + g(i + 1).cast("long") * 60 + g(i + 2).cast("long")) * 1000 + g(i + 3).cast("long") * unit
        return rows.select(at(1).alias("start_ms"), at(5).alias("end_ms"), F.replace(g(9), F.lit("|"), F.lit("\n")).alias("text"))
    if kind == "pjs":
        rows = rows.where(g(2).cast("long") >= g(1).cast("long"))
    if kind == "vplayer":
        ms = (g(1).cast("long") * 3600 + g(2).cast("long") * 60 + g(3).cast("long")) * unit
        return rows.select(ms.alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), F.replace(g(4), F.lit("|"), F.lit("\n")).alias("text"))
    if kind == "srt":
        at = lambda i: ((g(i).cast("long") * 3600 + g(i + 1).cast("long") * 60 + g(i + 2).cast("long")) * 1000 + g(i + 3).cast("long"))
        return rows.select(at(1).alias("start_ms"), at(5).alias("end_ms"), F.lit("").alias("text"))
    scale = F.lit(unit) if unit else F.lit(1000 / fps)
    when = lambda i: F.round(F.nullif(g(i), F.lit("")).cast("double") * scale).cast("long")
    return rows.select(when(1).alias("start_ms"), when(2).alias("end_ms"), F.replace(g(3), F.lit("|"), F.lit("\n")).alias("text"))


def parse_srt(df: DataFrame) -> DataFrame:
    """n, start_ms, end_ms and text of SubRip blocks in df(file, value), where value is a whole file."""
    blocks = df.select("file", F.explode(F.split("value", r"\r?\n\r?\n+")).alias("block"))
    p = r"^\s*(\d+)\s*\r?\n(\d+):(\d+):(\d+),(\d+) --> (\d+):(\d+):(\d+),(\d+)[^\n]*\n((?s:.*?))\s*$"
    g = lambda i: F.regexp_extract("block", p, i)
    at = lambda i: (g(i).cast("long") * 3600 + g(i + 1).cast("long") * 60 + g(i + 2).cast("long")) * 1000 + g(i + 3).cast("long")
    return blocks.where(F.col("block").rlike(p)).select("file", g(1).cast("long").alias("n"), at(2).alias("start_ms"), at(6).alias("end_ms"), g(10).alias("text"))


def parse_subtitle_blocks(df: DataFrame, kind: str) -> DataFrame:
    """file, start_ms, end_ms and text of subviewer1 and sami in df(file, value), where value is a whole file.

    A cue lasts until the next time of its file, the last one has no end (null); an
    empty cue only ends the one before. Times of subviewer1 are later by a [DELAY] that stands before them.
    """
    pattern = BLOCK_SUBTITLES[kind]
    found = df.select("file", "value", F.posexplode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("n", "m"))
    g = lambda i: F.regexp_extract("m", pattern, i)
    if kind == "subviewer1":
        late = F.coalesce(F.nullif(F.regexp_extract("value", r"\[DELAY\][ \t]*\r?\n[ \t]*(-?\d+)", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
        start = (g(1).cast("long") * 3600 + g(2).cast("long") * 60 + g(3).cast("long") + late) * 1000
        text = F.replace(g(4), F.lit("|"), F.lit("\n"))
    else:
        start = g(1).cast("long")
        text = F.trim(F.regexp_replace(F.replace(F.regexp_replace(F.regexp_replace(g(2), r"(?i)<br\s*/?>", "\n"), "<[^>]*>", ""), F.lit("&nbsp;"), F.lit(" ")), r"^\s+|\s+$", ""))
    rows = found.select("file", "n", start.alias("start_ms"), text.alias("text"))
    end = F.lead("start_ms").over(Window.partitionBy("file").orderBy("n"))  # a file is one row already
    return rows.select("file", "start_ms", end.alias("end_ms"), "text").where("text <> ''")


def webvtt_cues(df: DataFrame) -> DataFrame:
    """file, start_ms, end_ms and text of the cues in df(file, value), where value is a whole WebVTT file."""
    p = r"(?m)^(?:(\d+):)?(\d{2}):(\d{2})\.(\d{3}) --> (?:(\d+):)?(\d{2}):(\d{2})\.(\d{3})[^\n]*\n((?:[^\n]+(?:\n|$))*)"
    found = df.select("file", F.explode(F.regexp_extract_all("value", F.lit(p), F.lit(0))).alias("m"))
    g = lambda i: F.regexp_extract("m", p, i)
    n = lambda i: F.coalesce(F.nullif(g(i), F.lit("")).cast("long"), F.lit(0).cast("long"))
    at = lambda i: ((n(i) * 3600 + n(i + 1) * 60 + n(i + 2)) * 1000 + n(i + 3))
    return found.select("file", at(1).alias("start_ms"), at(5).alias("end_ms"), F.regexp_replace(g(9), r"\n$", "").alias("text"))


def hash_header(streams: DataFrame) -> DataFrame:
    """Lines '#name i: value' of df(stream_index, tb_num, tb_den, media_type, codec_id, sample_rate, channel_layout, width, height, sar), in order of ord."""
    i = F.col("stream_index").cast("string")
    line = lambda name, value: F.concat(F.lit(f"#{name} "), i, F.lit(": "), value)
    audio, video = F.col("media_type") == "audio", F.col("media_type") == "video"
    all_ = F.array_compact(F.array(
        line("tb", F.concat_ws("/", F.col("tb_num").cast("string"), F.col("tb_den").cast("string"))),
        line("media_type", F.col("media_type")),
        line("codec_id", F.col("codec_id")),
        F.when(audio, line("sample_rate", F.col("sample_rate").cast("string"))),
        F.when(audio, line("channel_layout_name", F.col("channel_layout"))),
        F.when(video, line("dimensions", F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")))),
        F.when(video, line("sar", F.col("sar"))),
    ))
    return streams.select("stream_index", F.posexplode(all_).alias("at", "value")).select((F.col("stream_index") * 10 + F.col("at")).alias("ord"), "value")


def stream_checksum(df: DataFrame, keys: list[str], ts: str, ties: list[str], adler0: Column, size: Column, seed: int = 1, name: str = "adler") -> DataFrame:
    """Adler-32 of all bytes of each stream in order, from each row's own sum with seed 0 and its size.

    A row's share of the second sum is its own plus its first sum for each byte
    behind it, so rows are only added up; a stream needs no task of its own.
    """
    from lumenflow.operators.ordering import running

    m = 65521
    rows = df.withColumns({"__a": adler0.bitwiseAND(F.lit(0xFFFF)), "__b": F.shiftrightunsigned(adler0, 16), "__n": size.cast("long")})
    rows = running(rows, keys, ts, ties, F.col("__n"), "__upto")
    # Bytes behind a row are the stream's bytes less those up to it: the sum falls apart into parts that need no second pass.
    out = rows.groupBy(*keys).agg(F.sum("__a").alias("a"), F.sum("__n").alias("n"), F.sum("__b").alias("b"), F.sum((F.col("__a") * (F.col("__upto") % m)) % m).alias("before"))
    first = (F.col("a") + (seed & 0xFFFF)) % m
    second = F.pmod((seed >> 16) + (seed & 0xFFFF) * (F.col("n") % m) + F.col("b") + (F.col("a") % m) * (F.col("n") % m) - F.col("before"), F.lit(m))
    return out.select(*keys, (second * 65536 + first).cast("long").alias(name))


def stream_crcs(df: DataFrame, keys: list[str], ts: str, ties: list[str], data: Column, kinds: dict[str, str], seed: int = 0) -> DataFrame:
    """CRCs of all bytes of each stream in order, without final inversion: kinds maps a column's name to a kind of functions.scalars.CRCS.

    A row's CRC counts times x to the number of bits behind it. That is x to all the
    stream's bits, over x to the bits up to the row: so each row is divided by what is
    known of it, rows are joined by exclusive or in any order, and the whole is
    multiplied once. Null data add no bytes; rows without a time belong to no stream.
    """
    from lumenflow.functions.scalars import CRCS, crc, crc_moved
    from lumenflow.operators.ordering import running

    rows = df.withColumn("__data", F.coalesce(data.cast("binary"), F.lit(b"")))
    rows = rows.select(*dict.fromkeys([*keys, ts, *ties]), F.octet_length("__data").cast("long").alias("__n"), *[crc(F.col("__data"), k).alias(f"__c_{n}") for n, k in kinds.items()])
    rows = running(rows, keys, ts, ties, F.col("__n"), "__upto")
    parts = rows.select(*keys, "__n", *[crc_moved(F.col(f"__c_{n}"), F.col("__upto"), k, back=True).alias(f"__c_{n}") for n, k in kinds.items()])
    out = parts.groupBy(*keys).agg(F.sum("__n").alias("__n"), *[F.bit_xor(f"__c_{n}").alias(f"__c_{n}") for n in kinds])
    begun = lambda n, k: F.col(f"__c_{n}").bitwiseXOR(F.lit(seed & ((1 << CRCS[k][0]) - 1)).cast("long"))
    return out.select(*keys, *[crc_moved(begun(n, k), F.col("__n"), k).alias(n) for n, k in kinds.items()])


def manifest_xml(df: DataFrame, row: str, *columns: str) -> DataFrame:
    """One element of XML for each row, with the columns as its children."""
    return df.select(F.to_xml(F.struct(*columns), {"rowTag": row, "declaration": "", "indent": ""}).alias("value"))


def timecode_lines(df: DataFrame, dts_ms: str) -> DataFrame:
    """'# timecode format v2' and one time a line."""
    head = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("at"), F.lit("# timecode format v2").alias("value"))
    return head.unionByName(df.select(F.col(dts_ms).cast("double").alias("at"), F.format_string("%.6f", F.col(dts_ms).cast("double")).alias("value")))


def concat_list(entries: DataFrame, data: DataFrame, key: str, pts: str) -> DataFrame:
    """Rows of data by a list of (ord, file, inpoint, outpoint): each file's rows inside its points, re-timed one entry behind the other."""
    cut = data.join(entries, key).where((F.col(pts) >= F.coalesce("inpoint", F.lit(-(2**62)))) & (F.col(pts) < F.coalesce("outpoint", F.lit(2**62))))
    spans = cut.groupBy("ord").agg(F.min(pts).alias("__from"), (F.max(pts) - F.min(pts) + 1).alias("__len"))
    spans = spans.withColumn("__off", F.coalesce(F.sum("__len").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return cut.join(spans, "ord").withColumn("out_pts", F.col(pts) - F.col("__from") + F.col("__off")).drop("__from", "__len", "__off")


def write_segments(df: DataFrame, path: str, seconds: int, ts: str) -> DataFrame:
    """Writes df as one folder for each segment of time, and gives the manifest, which is taken from df itself."""
    seg = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds).cast("long")
    out = df.withColumn("segment", seg)
    out.write.mode("overwrite").partitionBy("segment").parquet(path)
    return out.groupBy("segment").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("rows"))


def probe_rows(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """Rows of different kinds under one schema, as a probe prints them; columns that a kind lacks are null."""
    return packets.withColumn("row_type", F.lit("packet")).unionByName(streams.withColumn("row_type", F.lit("stream")), allowMissingColumns=True)
