"""Scalar functions: digests, codecs, text and number helpers.

Built-in expressions wherever Spark has them; Arrow-batched pandas UDFs for
Adler-32, Murmur3-128 and CRCs other than CRC-32, which it hasn't.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# CRC variants as (bits, polynomial, bytes are fed low bit first).
CRCS = {"CRC8": (8, 0x07, False), "CRC16_ANSI": (16, 0x8005, False), "CRC16_CCITT": (16, 0x1021, False), "CRC24": (24, 0x864CFB, False), "CRC32_IEEE": (32, 0x04C11DB7, False), "CRC32_IEEE_LE": (32, 0xEDB88320, True), "CRC16_ANSI_LE": (16, 0xA001, True), "CRC8_EBU": (8, 0x1D, False)}


def as_bytes(c: Column) -> Column:
    return c.cast("binary")


def base64_line(c: Column) -> Column:
    """Base64 without line breaks, which the built-in puts in after 76 characters."""
    return F.replace(F.base64(as_bytes(c)), F.lit("\r\n"), F.lit(""))


@F.pandas_udf(LongType())
def _adler(data: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else zlib.adler32(d, int(s)) for d, s in zip(data, seed, strict=True)], dtype="Int64")


def adler32(c: Column, seed: int = 1) -> Column:
    """Adler-32 of bytes; containers of frames seed it with 0. Null gives null."""
    return _adler(as_bytes(c), F.lit(seed))


def crc_table(bits: int, poly: int, low_first: bool) -> list[int]:
    """A CRC's table of 256 entries, from its polynomial."""
    out = []
    for b in range(256):
        if low_first:
            v = b
            for _ in range(8):
                v = v >> 1 ^ (poly if v & 1 else 0)
        else:
            v = b << (bits - 8)
            for _ in range(8):
                v = (v << 1 ^ (poly if v >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
        out.append(v)
    return out


def crc(c: Column, kind: str, seed: int = 0) -> Column:
    """One of CRCS, without final inversion; the little-endian IEEE one is built in but for its inversions."""
    bits, poly, low = CRCS[kind]
    if kind == "CRC32_IEEE_LE" and seed == 0xFFFFFFFF:
        return F.crc32(as_bytes(c)).bitwiseXOR(F.lit(0xFFFFFFFF))

    @F.pandas_udf("long")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series(crc_of(data.tolist(), bits, poly, low, seed), dtype="Int64")

    return run(as_bytes(c))


def crc_of(data: list[bytes | None], bits: int, poly: int, low_first: bool, seed: int) -> list[int | None]:
    """CRCs of many byte strings at once, by position: a step for each byte of the longest, over all that are long enough."""
    table, mask = np.array(crc_table(bits, poly, low_first), np.uint64), np.uint64((1 << bits) - 1)
    sizes = np.array([len(d) if d is not None else 0 for d in data], np.int64)
    order = np.argsort(-sizes, kind="stable")  # so that the strings still open are a prefix
    flat = np.frombuffer(b"".join(data[i] or b"" for i in order), np.uint8)
    start = np.cumsum(sizes[order]) - sizes[order]
    v = np.full(len(data), seed, np.uint64)
    open_ = len(data)
    byte, eight, top = np.uint64(255), np.uint64(8), np.uint64(max(bits - 8, 0))
    for k in range(int(sizes.max(initial=0))):
        open_ = int(np.searchsorted(-sizes[order][:open_], -k, "left"))
        b, x = flat[start[:open_] + k].astype(np.uint64), v[:open_]
        v[:open_] = table[((x ^ b) & byte).astype(np.int64)] ^ (x >> eight) if low_first else (table[((x >> top ^ b) & byte).astype(np.int64)] ^ (x << eight)) & mask
    out: list[int | None] = [None] * len(data)
    for place, i in enumerate(order):
        out[i] = None if data[i] is None else int(v[place])
    return out


def _times(a: int, b: int, bits: int, poly: int, low_first: bool) -> int:
    """The product of two remainders, as polynomials over two elements modulo the CRC's; the coefficient of the highest power is the top bit, or the lowest bit if low_first."""
    out = 0
    for k in range(bits):
        # b's coefficients from the highest power down, with out times x before each.
        if low_first:
            out = out >> 1 ^ (poly if out & 1 else 0)
            out ^= a if b >> k & 1 else 0
        else:
            out = (out << 1 ^ (poly if out >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
            out ^= a if b >> (bits - 1 - k) & 1 else 0
    return out


def byte_powers(kind: str, back: bool, upto: int = 48) -> list[int]:
    """x ** (8 * 2 ** k) modulo the CRC's polynomial for each k, or its inverse if back; x has one, as these polynomials have a constant term."""
    bits, poly, low = CRCS[kind]
    one = 1 << (bits - 1) if low else 1
    if back:
        # x times this is 1: the polynomial less its constant term, divided by x.
        step = ((poly << 1 & ((1 << bits) - 1)) | 1) if low else (poly >> 1 | 1 << (bits - 1))
    else:
        step = one >> 1 if low else 2
    for _ in range(3):
        step = _times(step, step, bits, poly, low)
    out = [step]
    for _ in range(upto - 1):
        out.append(_times(out[-1], out[-1], bits, poly, low))
    return out


def crc_moved(c: Column, n_bytes: Column, kind: str, back: bool = False) -> Column:
    """A CRC (with seed 0) times x ** (8 * n_bytes): what it adds to the CRC of bytes of which n_bytes come behind its own; or divided by that."""
    bits, poly, low = CRCS[kind]
    # Multiplying by a constant is linear: the products of each byte's values, from those of its bits by exclusive or.
    tables, values = [], np.arange(256)
    for p in byte_powers(kind, back):
        t = np.zeros((-(-bits // 8), 256), np.int64)
        for k in range(bits):
            t[k // 8] ^= np.where(values >> k % 8 & 1, _times(1 << k, p, bits, poly, low), 0)
        tables.append(t)

    @F.pandas_udf("long")
    def run(v: pd.Series, n: pd.Series) -> pd.Series:
        known = (v.notna() & n.notna()).to_numpy()
        x, left = v.fillna(0).to_numpy(np.int64), n.fillna(0).to_numpy(np.int64)
        for k, t in enumerate(tables):
            on = (left >> k & 1).astype(bool)
            if on.any():
                y, own = np.zeros(int(on.sum()), np.int64), x[on]
                for j, row in enumerate(t):
                    y ^= row[own >> 8 * j & 255]
                x = x.copy()
                x[on] = y
        return pd.Series(x, dtype="Int64").where(known)

    return run(c.cast("long"), n_bytes.cast("long"))


# The multipliers and turns of the public 128-bit Murmur3 for 64-bit machines, and those of its finish.
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
_N1, _N2 = np.uint64(0x52DCE729), np.uint64(0x38495AB5)
_F1, _F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _turned(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def murmur3_of(data: list[bytes | None], seed: int = 0) -> list[bytes | None]:
    """The public Murmur3 128-bit hash of many byte strings at once, little-endian; the seed starts both halves. A step for each block of the longest."""
    sizes = np.array([len(d or b"") for d in data], np.int64)
    whole = sizes // 16
    order = np.argsort(-whole, kind="stable")  # so that the strings still open are a prefix
    # Each string is padded with zeros to whole blocks, one more than it fills; a tail of zeros changes nothing.
    flat = np.frombuffer(b"".join((data[i] or b"").ljust(int(whole[i] + 1) * 16, b"\0") for i in order), "<u8").astype(np.uint64).reshape(-1, 2)
    sizes, whole = sizes[order], whole[order]
    start = np.cumsum(whole + 1) - (whole + 1)
    h1 = np.full(len(data), seed & 0xFFFFFFFFFFFFFFFF, np.uint64)
    h2 = h1.copy()
    five, open_ = np.uint64(5), len(data)

    def mixed(k: np.ndarray, a: np.uint64, turn: int, b: np.uint64) -> np.ndarray:
        return _turned(k * a, turn) * b

    for k in range(int(whole.max(initial=0))):
        open_ = int(np.searchsorted(-whole[:open_], -k, "left"))
        block, x, y = flat[start[:open_] + k], h1[:open_], h2[:open_]
        x = (_turned(x ^ mixed(block[:, 0], _C1, 31, _C2), 27) + y) * five + _N1
        h2[:open_] = (_turned(y ^ mixed(block[:, 1], _C2, 33, _C1), 31) + x) * five + _N2
        h1[:open_] = x
    tail = flat[start + whole] if len(data) else flat
    n = sizes.astype(np.uint64)
    h1, h2 = h1 ^ mixed(tail[:, 0], _C1, 31, _C2) ^ n, h2 ^ mixed(tail[:, 1], _C2, 33, _C1) ^ n
    h1 = h1 + h2
    h2 = h2 + h1

    def final(x: np.ndarray) -> np.ndarray:
        shift = np.uint64(33)
        x = (x ^ x >> shift) * _F1
        x = (x ^ x >> shift) * _F2
        return x ^ x >> shift

    h1, h2 = final(h1), final(h2)
    h1 = h1 + h2
    h2 = h2 + h1
    packed, out = np.stack([h1, h2], 1).astype("<u8").tobytes(), [None] * len(data)
    for place, i in enumerate(order):
        out[i] = None if data[i] is None else packed[16 * place : 16 * place + 16]
    return out


def murmur3_x64_128(data: bytes, seed: int = 0) -> bytes:
    """murmur3_of one string."""
    return murmur3_of([data], seed)[0]


def murmur3_128(c: Column, seed: int = 0) -> Column:
    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else d.hex() for d in murmur3_of(data.tolist(), seed)])

    return run(as_bytes(c))


def hmac(c: Column, key: bytes, algorithm: str = "sha256") -> Column:
    """A keyed digest in hex: two digests of the text behind the key's two pads, which are constants of the plan."""
    block = 128 if algorithm in ("sha384", "sha512") else 64
    key = hashlib.new(algorithm, key).digest() if len(key) > block else key
    pad = lambda x: F.lit(bytes(b ^ x for b in key.ljust(block, b"\0")))
    inner = digest(F.concat(pad(0x36), as_bytes(c)), algorithm, "binary")
    return digest(F.concat(pad(0x5C), inner), algorithm)


def digest(c: Column, algorithm: str, encoding: str = "hex") -> Column:
    """A digest by name, as hex, base64 or binary."""
    b = as_bytes(c)
    built_in = {"md5": F.md5(b), "sha1": F.sha1(b), "sha224": F.sha2(b, 224), "sha256": F.sha2(b, 256), "sha384": F.sha2(b, 384), "sha512": F.sha2(b, 512)}
    if algorithm in built_in:
        hexed = built_in[algorithm]
    else:

        @F.pandas_udf("string")
        def run(data: pd.Series) -> pd.Series:
            return pd.Series([None if d is None else hashlib.new(algorithm, d).hexdigest() for d in data])

        hexed = run(b)
    return {"hex": hexed, "base64": base64_line(F.unhex(hexed)), "binary": F.unhex(hexed)}[encoding]


def url_decode(c: Column, plus: bool = False) -> Column:
    """Percent-decoding that keeps escapes which aren't hexadecimal as they are; plus says whether + is a space.

    Runs of escapes are decoded one by one, so a character may be spelt over
    several; bytes that are no UTF-8 become the replacement character.
    """
    text = F.replace(c, F.lit("+"), F.lit(" ")) if plus else c
    run = F.lit("(?:%[0-9A-Fa-f]{2})+")
    between, runs = F.split(text, "(?:%[0-9A-Fa-f]{2})+", -1), F.regexp_extract_all(text, run, F.lit(0))
    plain = F.transform(runs, lambda r: F.make_valid_utf8(F.unhex(F.replace(r, F.lit("%"), F.lit(""))).cast("string")))
    whole = F.array_join(F.flatten(F.zip_with(between, plain, lambda b, p: F.array(b, F.coalesce(p, F.lit(""))))), "")
    return F.when(text.contains("%"), whole).otherwise(text)


def data_uri(c: Column) -> Column:
    """Bytes of an inline data: address, base64 or percent-coded."""
    head, body = F.substring_index(c, ",", 1), F.substr(c, F.instr(c, ",") + 1)
    return F.when(c.startswith("data:"), F.when(head.endswith(";base64"), F.unbase64(body)).otherwise(url_decode(body).cast("binary")))


def timestamp_text(ts: Column, num: int = 1, den: int = 1) -> Column:
    """Seconds of an integer time in base num/den with six significant decimals below one, six decimals else, and trailing zeros trimmed; NOPTS for null."""
    v = ts.cast("double") * num / den
    size = F.floor(F.log10(F.abs(F.nullif(v, F.lit(0.0)))))
    places = F.when(size < 0, 5 - size).otherwise(6).cast("string")
    seconds = F.call_function("format_string", F.concat(F.lit("%."), places, F.lit("f")), v)
    return F.when(ts.isNull(), "NOPTS").otherwise(F.regexp_replace(seconds, r"\.?0+$", ""))


def rescale(ts: Column, num: int, den: int) -> Column:
    """An integer time from one base to another, rounded to the nearest, halves away from zero; exact in decimals."""
    return F.round(ts.cast("decimal(20,0)") * F.lit(num).cast("decimal(10,0)") / F.lit(den).cast("decimal(10,0)"), 0).cast("long")


def int_log2(x: Column) -> Column:
    """Floor of the base-2 logarithm by bit length, exact for all positive longs; 0 for 0."""
    return F.greatest(F.length(F.bin(x)) - 1, F.lit(0)).cast("long")


def merged_error(a: Column, b: Column, eof: int) -> Column:
    """The first real error, else end of file, else none (0)."""
    real = lambda c: (c < 0) & (c != eof)
    return F.when(real(a), a).when(real(b), b).otherwise(F.least(a, b))


def replay_gain(c: Column) -> Column:
    """Text like '-7.50 dB' as hundred-thousandths of a decibel.

    The whole part is read as C does (a leading 0 means octal, 0x hexadecimal), of
    the decimals five count and further ones are cut off. Text without a number is
    0; null, and what passes 32 bits, gives null.
    """
    # Most texts: a plain number below 10,000, whose five decimals are exact in a double.
    plain = r"^[ \t]*([+-]?(?:[1-9][0-9]{0,3}|0(?![xX]))(?![0-9])(?:\.[0-9]{1,5})?)"
    read = F.round(F.regexp_extract(c, plain, 1).cast("double") * 100_000).cast("long")
    return F.when(c.rlike(plain), read).when(c.rlike(r"^\s*[+-]?\.?[0-9]"), _replay_gain_of_any(c)).when(c.isNotNull(), F.lit(0).cast("long"))


def _replay_gain_of_any(c: Column) -> Column:
    """replay_gain of any text, octal, hexadecimal, bare and too large numbers too; it looks at the text many times."""
    part = r"^\s*([+-]?)(0[xX][0-9A-Fa-f]+|0[0-7]*|[1-9][0-9]*)(?:\.([0-9]{1,5}))?"
    g = lambda i: F.regexp_extract(c, part, i)
    whole = F.when(g(2).rlike("^0[xX]"), F.conv(F.substr(g(2), F.lit(3)), 16, 10)).when(g(2).startswith("0"), F.conv(g(2), 8, 10)).otherwise(g(2)).try_cast("long")
    cut = F.coalesce(F.rpad(F.nullif(F.when(g(2) != "", g(3)).otherwise(F.regexp_extract(c, r"^[ \t]*\.([0-9]{1,5})", 1)), F.lit("")), 5, "0").try_cast("long"), F.lit(0).cast("long"))
    found = F.when(g(2) == "", F.lit(0).cast("long")).otherwise(whole)
    sign = F.when(F.regexp_extract(c, r"^[ \t]*(-)", 1) == "-", -1).otherwise(1)
    return F.when((found <= F.floor((F.lit(2147483647) - cut) / 100_000)) & c.isNotNull(), sign * (found * 100_000 + cut))


def plain_text(markup: Column) -> Column:
    """Markup without its tags and with the common entities resolved; scripts and styles go whole."""
    text = F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"), r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def rotation_degrees(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Counter-clockwise rotation of a 2 by 2 display matrix, from its scaled first column."""
    s0, s1 = F.hypot(a, c), F.hypot(b, d)
    return -F.degrees(F.atan2(b / F.nullif(s1, F.lit(0.0)), a / F.nullif(s0, F.lit(0.0))))


def convert_keys(tags: Column, to_generic: dict[str, str], to_native: dict[str, str]) -> Column:
    """Metadata keys from one native naming over the generic one to another; unknown keys stay, case doesn't matter."""

    def mapped(key: Column, names: dict[str, str]) -> Column:
        out = F.when(F.lit(False), key)
        for k, v in names.items():
            out = out.when(F.lower(key) == k.lower(), v)
        return out.otherwise(key)

    return F.transform_keys(tags, lambda k, _: mapped(mapped(k, to_generic), to_native))


def parse_dict(c: Column, assign: str = "=", between: str = ":") -> Column:
    """A map from text like a=b:c=d, where a backslash takes the next character as it is.

    Parts without an assignment are left out, of a repeated key the last counts,
    and further assignments belong to the value. Null gives null.
    """
    import re

    a, b = re.escape(assign), re.escape(between)
    plain = lambda x: F.regexp_replace(x, r"\\(?s:(.))", "$1")
    parts = F.regexp_extract_all(c, F.lit(rf"(?:^|{b})((?:[^\\{between}]++|\\(?s:.)|\\$)*+)"), F.lit(1))
    cut = rf"^((?:[^\\{assign}]++|\\(?s:.))*+){a}((?s:.*))$"
    pairs = F.filter(F.transform(parts, lambda p: F.struct(plain(F.regexp_extract(p, cut, 1)).alias("k"), plain(F.regexp_extract(p, cut, 2)).alias("v"), p.rlike(cut).alias("ok"))), lambda x: x["ok"])
    last = F.filter(F.transform(pairs, lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), i.alias("i"))), lambda x: ~F.exists(F.slice(pairs, x["i"] + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.when(c.isNotNull(), F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"]))))


def print_dict(m: Column, assign: str = "=", between: str = ":") -> Column:
    """A map's entries in their order as text that parse_dict reads: backslashes and both separators get a backslash before them. Null gives null, and a null value nothing."""
    import re

    special = "([" + re.escape("\\" + assign + between) + "])"
    coded = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), special, r"\\$1")
    return F.when(m.isNotNull(), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(coded(e["key"]), F.lit(assign), coded(e["value"]))), between))


def byte_swapped(c: Column, size: int) -> Column:
    """Bytes with those of each word of `size` bytes reversed; a short last word too."""
    step = 2 * size
    words = F.regexp_extract_all(F.hex(as_bytes(c)), F.lit(f".{{1,{step}}}"), F.lit(0))
    turned = F.transform(words, lambda w: F.array_join(F.reverse(F.regexp_extract_all(w, F.lit(".."), F.lit(0))), ""))
    return F.unhex(F.array_join(turned, ""))


def bit_reversed(c: Column) -> Column:
    """An integer from 0 to 255 with its bits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(c.cast("long")), 8, "0")), 2, 10).cast("long")


def exp10(c: Column) -> Column:
    return F.pow(F.lit(10.0), c)


def wide_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 of two decimals of up to 38 digits."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0).cast("int")


def wide_shift_right(c: Column, bits: int) -> Column:
    """A decimal of up to 38 digits by 2**bits, towards minus infinity."""
    by = F.lit(str(2**bits)).cast("decimal(38,0)")
    rest = F.pmod(c.cast("decimal(38,0)"), by)
    return ((c.cast("decimal(38,0)") - rest) / by).cast("decimal(38,0)")


def wide_divide(c: Column, by: int) -> Column:
    """A decimal of up to 38 digits by a power of ten, towards zero: exact where `div`, which gives a long, passes 64 bits."""
    digits = len(str(by)) - 1
    if by != 10**digits or not 0 < digits < 7:
        raise ValueError("wide_divide takes powers of ten from 10 to a million")
    whole = c.cast("decimal(38,0)")
    return ((whole - whole % F.lit(by).cast("decimal(38,0)")) * F.lit(f"{1 / by:.{digits}f}").cast(f"decimal({digits},{digits})")).cast("decimal(38,0)")


def flipped_matrix(a: Column, b: Column, c: Column, d: Column, horizontal: bool, vertical: bool) -> Column:
    """A 2 by 2 display matrix with its columns turned over: the first for a horizontal flip, the second for a vertical one."""
    h, v = (-1 if horizontal else 1), (-1 if vertical else 1)
    return F.struct((a * h).alias("a"), (b * v).alias("b"), (c * h).alias("c"), (d * v).alias("d"))
