"""Scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenflow.functions import scalars as S
from lumenflow.registry import query
from lumenflow.session import ship_package, table


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, base64(encode(text)) AS text64 FROM documents")
def digests(spark, sf_dir):
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", S.digest(t, "md5").alias("md5"), S.digest(t, "sha1").alias("sha1"), S.digest(t, "sha256").alias("sha256"), S.base64_line(t).alias("text64"))


@query("SELECT doc_id, base64(encode(text)) AS text64 FROM documents")
def base64_whole(spark, sf_dir):
    """Whole texts, which Base64 would break into lines."""
    return table(spark, sf_dir, "documents").select("doc_id", S.base64_line(F.col("text")).alias("text64"))


@query(
    """WITH b AS (SELECT event_id, list_transform(string_split(props, ''), lambda c: ascii(c)) AS b FROM events)
SELECT event_id, ((list_reduce(list_prepend(0, list_transform(range(1, len(b) + 1), lambda i: b[i] * (len(b) - i + 1))), lambda x, y: x + y) + len(b)) % 65521 * 65536 + (1 + list_sum(b)) % 65521)::BIGINT AS adler FROM b"""
)
def adler32(spark, sf_dir):
    ship_package(spark)
    return table(spark, sf_dir, "events").select("event_id", S.adler32(F.col("props")).alias("adler"))


@query()
def other_digests(spark, sf_dir):
    """Murmur3-128, HMAC-SHA-256, CRC-16 and CRC-32 of props; SQL has none of them."""
    ship_package(spark)
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", S.murmur3_128(p).alias("murmur"), S.hmac(p, b"key").alias("hmac"), S.crc(p, "CRC16_CCITT").alias("crc16"), F.crc32(p.cast("binary")).alias("crc32"))


@query(r"SELECT page_id, url_decode(replace(url, 'e', '%65') || '%20end') AS url FROM pages")
def url_decode(spark, sf_dir):
    ship_package(spark)
    coded = F.concat(F.replace("url", F.lit("e"), F.lit("%65")), F.lit("%20end"))
    return table(spark, sf_dir, "pages").select("page_id", S.url_decode(coded).alias("url"))


@query(r"SELECT conv_id, turn, text AS body FROM conversations")
def data_uri(spark, sf_dir):
    """Texts as inline addresses and back."""
    ship_package(spark)
    uri = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.col("text").cast("binary")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.data_uri(uri).cast("string").alias("body"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'NOPTS' ELSE regexp_replace(printf('%.' || CASE WHEN event_id > 0 AND abs(event_id * 1001.0::DOUBLE / 30000) < 1 THEN 5 - floor(log10(event_id * 1001.0::DOUBLE / 30000))::BIGINT ELSE 6 END || 'f', (event_id * 1001)::DOUBLE / 30000), '\\.?0+$', '') END AS seconds, CASE WHEN event_id % 10 = 0 THEN NULL ELSE round((event_id::DECIMAL(20,0) * 90000) / 30000)::BIGINT END AS ticks, floor(log2(event_id + 1))::BIGINT AS bits FROM events")
def timestamps(spark, sf_dir):
    ts = F.when(F.col("event_id") % 10 != 0, F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", S.timestamp_text(ts * 1001, 1, 30000).alias("seconds"), S.rescale(ts, 90000, 30000).alias("ticks"), S.int_log2(F.col("event_id") + 1).alias("bits"))


@query(
    r"""SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS text FROM pages"""
)
def markup_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.plain_text(F.col("html")).alias("text"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * (trunc(l_quantity)::BIGINT * 100000 + (l_orderkey % 100000)) END AS gain FROM lineitem"""
)
def replay_gain(spark, sf_dir):
    """Seven decimals, of which the sixth and seventh are cut off; texts without a number are 0."""
    n = F.col("l_linenumber")
    text = F.when(n % 4 == 0, "none").otherwise(F.concat(F.when(n % 2 == 0, "-").otherwise(" "), F.col("l_quantity").cast("long").cast("string"), F.lit("."), F.lpad((F.col("l_orderkey") % 100000).cast("string"), 5, "0"), F.lit("99 dB")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.replay_gain(text).alias("gain"))


@query(
    """SELECT event_id, upper(hex(list_aggregate(list_transform(range(0, (len(event_type) + 3) // 4), lambda k: reverse(event_type[k * 4 + 1 : k * 4 + 4])), 'string_agg', ''))) AS swapped,
 list_sum(list_transform(range(0, 8), lambda i: ((event_id % 256) >> i & 1) << (7 - i)))::BIGINT AS reversed, round(pow(10, value / 100), 6) AS exp10,
 CASE WHEN event_id::HUGEINT * 12345678901234567 < 98765432109876543 THEN -1 WHEN event_id::HUGEINT * 12345678901234567 > 98765432109876543 THEN 1 ELSE 0 END AS compared,
 ((event_id::HUGEINT * 12345678901234567 - 98765432109876543) >> 20)::VARCHAR AS shifted, -value AS flipped FROM events"""
)
def bits_and_wide_integers(spark, sf_dir):
    """Byte swap by words of four, bit reversal, powers of ten, comparison and shift of 128-bit integers, and a flipped display matrix."""
    x = F.col("event_id").cast("decimal(19,0)") * F.lit("12345678901234567").cast("decimal(17,0)")
    limit = F.lit("98765432109876543").cast("decimal(17,0)")
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.hex(S.byte_swapped(F.col("event_type"), 4)).alias("swapped"), S.bit_reversed(F.col("event_id") % 256).alias("reversed"), F.round(S.exp10(v / 100), 6).alias("exp10"),
        S.wide_compare(x, limit).alias("compared"), S.wide_shift_right(x - limit, 20).cast("string").alias("shifted"), S.flipped_matrix(v, v, v, v, True, False)["a"].alias("flipped"),
    )


@query("SELECT event_id, round((-degrees(atan2(sin(value), cos(value)))), 6) + 0 AS degrees, CASE event_id % 3 WHEN 0 THEN -5 WHEN 1 THEN -9 ELSE 0 END::BIGINT AS error FROM events")
def rotation_and_errors(spark, sf_dir):
    v, k = F.col("value"), F.col("event_id") % 3
    a = F.when(k == 0, -9).when(k == 1, 0).otherwise(0)
    b = F.when(k == 0, -5).when(k == 1, -9).otherwise(0)
    # A matrix [cos sin; -sin cos] turns by minus its angle.
    turned = S.rotation_degrees(F.cos(v), F.sin(v), -F.sin(v), F.cos(v))
    return table(spark, sf_dir, "events").select("event_id", (F.round(turned, 6) + 0).alias("degrees"), S.merged_error(a, b, -9).cast("long").alias("error"))


@query("SELECT event_id, (event_id::HUGEINT * 12345678901234567 + 98765432109876543)::VARCHAR AS product, ((event_id::HUGEINT * 12345678901234567) // 1000)::VARCHAR AS quotient, ((event_id::HUGEINT * 12345678901234567) % 1000)::BIGINT AS rest FROM events")
def wide_integers(spark, sf_dir):
    x = F.col("event_id").cast("decimal(19,0)") * F.lit("12345678901234567").cast("decimal(17,0)")
    rest = (x % F.lit(1000).cast("decimal(4,0)")).cast("long")
    return table(spark, sf_dir, "events").select("event_id", (x + F.lit("98765432109876543").cast("decimal(17,0)")).cast("string").alias("product"), S.wide_divide(x, 1000).cast("string").alias("quotient"), rest.alias("rest"))


@query("SELECT doc_id, lang AS language, source AS publisher, n_chars::VARCHAR AS \"length\" FROM documents")
def metadata_keys(spark, sf_dir):
    """Keys from one naming over the generic one to another."""
    tags = F.create_map(F.lit("LANG"), "lang", F.lit("Src"), "source", F.lit("length"), F.col("n_chars").cast("string"))
    out = S.convert_keys(tags, {"lang": "language", "src": "origin"}, {"origin": "publisher"})
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("t")).select("doc_id", F.col("t")["language"].alias("language"), F.col("t")["publisher"].alias("publisher"), F.col("t")["length"].alias("length"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type || ':x' AS kind FROM events")
def escaped_dictionary(spark, sf_dir):
    ship_package(spark)
    text = F.concat(F.lit("k="), F.get_json_object("props", "$.k"), F.lit(":kind="), "event_type", F.lit("\\:x"))
    return table(spark, sf_dir, "events").select("event_id", S.parse_dict(text).alias("d")).select("event_id", F.col("d")["k"].alias("k"), F.col("d")["kind"].alias("kind"))


_INNER, _OUTER = (bytes(b ^ x for b in b"key".ljust(64, b"\0")) for x in (0x36, 0x5C))
_BLOB = lambda data: "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


@query(f"SELECT event_id, sha256({_BLOB(_OUTER)} || unhex(sha256({_BLOB(_INNER)} || encode(props)))) AS hmac FROM events")
def hmac_sha256(spark, sf_dir):
    """A keyed digest of each event's properties, as two digests behind the key's pads."""
    return table(spark, sf_dir, "events").select("event_id", S.hmac(F.col("props"), b"key").alias("hmac"))


@query()
def long_digests(spark, sf_dir):
    """The SHA-512 family of page texts; DuckDB has none of them, so tests hold them against the library."""
    ship_package(spark)
    return table(spark, sf_dir, "pages").select("page_id", *[S.digest(F.col("html"), k).alias(k) for k in ("sha384", "sha512", "sha512_256")])


@query(r"SELECT event_id, 'type=' || replace(event_type, ':', '\:') || ':props=' || regexp_replace(props, '([\\=:])', '\\\1', 'g') AS printed, props AS back FROM events")
def printed_dictionary(spark, sf_dir):
    """A map printed with escapes, and what reading it gives."""
    printed = S.print_dict(F.create_map(F.lit("type"), F.col("event_type"), F.lit("props"), F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", printed.alias("printed")).withColumn("back", S.parse_dict(F.col("printed"))["props"])
