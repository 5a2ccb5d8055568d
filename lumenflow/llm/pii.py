"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

All of it is array expressions inside each row: no shuffle, no Python. Offsets
are code points, end exclusive. The patterns below say the same as their plain
forms, but are written so that Java's matcher neither recurses nor rescans: runs
are possessive, and an email may only begin where a run of its characters begins
or where the last match ended.

Time grows in proportion to the text and its matches, however many these are:
matches are gone through in groups, so that no list is copied for each of them, and
what stands around a span comes from the text cut into short pieces once, not from
the text's start.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    plain: str
    hint: str | tuple[str, ...]  # a text without a match of this, or without any of these, has no span of the kind
    score: int  # per cent, before context
    context: str
    needed: int = 0  # spans below this score are dropped


# Patterns of the kinds and the words that speak for them.
_NAMED_SECRET = "(?:token|Token|TOKEN|secret|Secret|SECRET|password|Password|PASSWORD|passwd|api[_-]?key|Api[_-]?[Kk]ey|API[_-]?KEY|access[_-]?key|ACCESS[_-]?KEY)"
_SECRET = f"(?:{_NAMED_SECRET}" + r"[\"']?\x20?[:=]\x20?[\"']?|AKIA|gh[pousr]_|sk-|xox[abprs]-)[A-Za-z0-9_./+=-]{16,}"
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", ("@",), 80, "mail|contact|write|reply"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]\.[0-9]", 70, "ip|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+", r"[0-9][\x20-]?[0-9]", 90, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 60, "phone|call|tel|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", "[A-Z]{2}[0-9]{2}", 90, "iban|bank|account|transfer"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 40, "ssn|social|security|tax", 50),
    Kind("secret", _SECRET + "+", _SECRET, r"[:=]\x20?[\"']?[A-Za-z0-9_./+=-]{16}|AKIA|gh[pousr]_|sk-|xox[abprs]-", 60, "key|auth|login|credential|bearer"),
)
BASE = ("email", "ip", "card", "phone")
IP_PATTERN = r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.|$)){4}$"
#: Characters on either side of a span in which a context word counts, and what it adds.
NEAR, BONUS = 30, 10
#: Matches in a group, and characters in a piece of text.
GROUP, PIECE = 256, 256


def _scan(items: Column, item: str, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Goes through items, a column of its own, with a running number from 0: step(number, item) gives the next number and a value, which is left out if null.

    A list grows only inside a group of items and then by whole groups, so the
    copying is in proportion to the items.
    """
    n = F.size(items)
    groups = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / GROUP).cast("int")), lambda g: F.slice(items, g * GROUP + 1, GROUP))).otherwise(F.array().cast(f"array<array<{item}>>"))
    none = F.array().cast(f"array<{kind}>")

    def inner(acc: Column, x: Column) -> Column:
        at, value = step(acc["at"], x)
        return F.struct(at.alias("at"), F.when(value.isNotNull(), F.concat(acc["out"], F.array(value))).otherwise(acc["out"]).alias("out"))

    def outer(acc: Column, group: Column) -> Column:
        start = F.coalesce(F.get(acc, F.size(acc) - 1)["at"], F.lit(0))
        return F.concat(acc, F.array(F.aggregate(group, F.struct(start.alias("at"), none.alias("out")), inner)))

    done = F.aggregate(groups, F.array().cast(f"array<struct<at:int,out:array<{kind}>>>"), outer)
    return F.flatten(F.transform(done, lambda x: x["out"]))


def _matches(text: Column, kind: Kind) -> Column:
    """All leftmost non-overlapping matches, each with the length of what stands between it and the one before: array<struct<p, m>>."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.slice(F.split(text, F.lit(kind.pattern), -1), F.lit(1), F.size(matches))
    return F.zip_with(between, matches, lambda p, m: F.struct(F.char_length(p).alias("p"), m.alias("m")))


def _hinted(text: Column, kind: Kind) -> Column:
    if isinstance(kind.hint, str):
        return text.rlike(kind.hint)
    return reduce(lambda a, b: a | b, [text.contains(h) for h in kind.hint])


def _spans(pairs: Column, kind: Kind) -> Column:
    """Places of the matches that may be valid: array<struct<s, e, m>>."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + x["p"]
        e = s + F.char_length(x["m"])
        return e, F.when(_valid(kind.name, x["m"]), F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))

    return _scan(pairs, "struct<p:int,m:string>", "struct<s:int,e:int,m:string>", step)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """Characters start..end-1 of the text that was cut into pieces."""
    first = F.floor(start / PIECE).cast("int")
    own = F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
    return F.substring(own, start - first * PIECE + 1, end - start)


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _mod97(match: Column) -> Column:
    """The rest of an account number by 97, with its first four characters moved behind and letters as 10..35."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), add)


def _valid(kind: str, m: Column) -> Column:
    """What the match itself says."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.char_length(digits)
    return {
        "email": F.lit(True),
        "ip": m.rlike(IP_PATTERN),
        "card": F.when(n.between(16, 19), _luhn(digits)).otherwise(False),
        "phone": n.between(8, 15),
        "iban": _mod97(m) == 1,
        "ssn": ~m.rlike("^(000|666|9)|-00-|-0000$"),
        "secret": n >= 4,
    }[kind]


#: Kinds that may not stand inside a longer run of letters, digits and hyphens.
ALONE = ("iban", "ssn")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, one array<struct<s, e, score>> for each kind, and the text, for every row of docs.

    Null counts as the empty text, which has no spans. Texts of any length and
    number of matches are gone through whole, in time in proportion to them.
    Repeated rows and null ids stay as they are; an empty table gives no rows;
    other columns are ignored.
    """
    t = F.col("text")
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<struct<p:int,m:string>>")
    out = out.withColumns({f"p_{k.name}": F.when(_hinted(t, k), _matches(t, k)).otherwise(none) for k in KINDS})
    out = out.withColumns({f"m_{k.name}": _spans(F.col(f"p_{k.name}"), k) for k in KINDS})
    some = sum((F.size(f"m_{k.name}") for k in KINDS), F.lit(0)) > 0
    out = out.withColumn("pieces", F.when(some, _pieces(t)).otherwise(F.array().cast("array<string>"))).withColumn("length", F.char_length(t))
    return out.select("doc_id", "text", "pieces", *[_confirmed(k).alias(k.name) for k in KINDS])


def _confirmed(kind: Kind) -> Column:
    """Spans with their scores, raised by a context word within NEAR characters; those that context rules out go."""
    before = lambda x: _part(F.col("pieces"), F.greatest(x["s"] - NEAR, F.lit(0)), x["s"])
    behind = lambda x: _part(F.col("pieces"), x["e"], F.least(x["e"] + NEAR, F.col("length")))
    near = F.transform(f"m_{kind.name}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), before(x).alias("before"), behind(x).alias("behind")))
    if kind.name in ALONE:
        near = F.filter(near, lambda x: ~x["before"].rlike("[A-Za-z0-9-]$") & ~x["behind"].rlike("^[A-Za-z0-9-]"))
    score = lambda x: F.lit(kind.score) + F.when(F.lower(F.concat(x["before"], F.lit(" "), x["behind"])).rlike(kind.context), BONUS).otherwise(0)
    scored = F.transform(near, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), score(x).alias("score")))
    return F.filter(scored, lambda x: x["score"] >= kind.needed) if kind.needed else scored


def _listed(kind: str) -> Column:
    return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def pii_digest(found: DataFrame) -> DataFrame:
    """The counts, digest and listing of find_pii's spans."""
    listed = {k.name: _listed(k.name) for k in KINDS}
    base = F.array_join(F.concat(*[listed[k] for k in BASE]), ",")
    scores = F.concat(*[F.transform(k.name, lambda x: x["score"].cast("string")) for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*listed.values()), ",").alias("spans"),
        sum((F.size(k.name) for k in KINDS), F.lit(0)).cast("long").alias("n_spans"),
        F.array_join(scores, ",").alias("scores"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[redacted]") -> DataFrame:
    """doc_id and text with every span replaced by a mark; overlapping spans become one. Null texts become empty."""
    found = find_pii(docs, id_col, text_col)
    spans = F.array_sort(F.concat(*[F.transform(k.name, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS]))
    found = found.withColumn("spans", spans).withColumn("last", F.coalesce(F.array_max(F.transform("spans", lambda x: x["e"])), F.lit(0)))
    # What is left between spans: from the furthest end so far to the next start, where that lies behind it.
    left = _scan(F.col("spans"), "struct<s:int,e:int>", "struct<s:int,e:int>", lambda at, x: (F.greatest(at, x["e"]), F.when(x["s"] >= at, F.struct(at.alias("s"), x["s"].alias("e")))))
    marked = F.array_join(F.transform(left, lambda x: F.concat(_part(F.col("pieces"), x["s"], x["e"]), F.lit(mark))), "")
    whole = F.concat(marked, F.substr(F.col("text"), F.col("last") + 1))
    return found.select("doc_id", F.when(F.size("spans") > 0, whole).otherwise(F.col("text")).alias("text"))


def _sql() -> str:
    """The same in DuckDB, whose matcher needs no special forms."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    alone = "NOT regexp_matches(CASE WHEN s > 0 THEN substr(t, s, 1) ELSE '' END, '[A-Za-z0-9-]') AND NOT regexp_matches(substr(t, e + 1, 1), '[A-Za-z0-9-]')"
    turned = "(replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4])"
    luhn = f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN (len({digits}) - i) % 2 = 0 THEN {digits}[i]::INT ELSE 2 * {digits}[i]::INT - CASE WHEN {digits}[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    mod97 = f"list_reduce(list_prepend(0, list_transform(range(1, len({turned}) + 1), lambda i: ascii({turned}[i]))), lambda r, c: CASE WHEN c < 58 THEN r * 10 + c - 48 ELSE r * 100 + c - 55 END % 97) = 1"
    valid = {
        "email": "true",
        "ip": f"regexp_matches(m, '{IP_PATTERN}')",
        "card": f"CASE WHEN len({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END",
        "phone": f"len({digits}) BETWEEN 8 AND 15",
        "iban": f"CASE WHEN {alone} THEN {mod97} ELSE false END",
        "ssn": f"{alone} AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')",
        "secret": f"len({digits}) >= 4",
    }
    quoted = lambda x: x.replace("'", "''")
    parts = []
    for n, k in enumerate(KINDS):
        at = "list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: len(x))), 0)"
        score = f"{k.score} + CASE WHEN regexp_matches(lower(substr(t, greatest(s - {NEAR}, 0) + 1, s - greatest(s - {NEAR}, 0)) || ' ' || substr(t, e + 1, {NEAR})), '{k.context}') THEN {BONUS} ELSE 0 END"
        parts.append(f"""
SELECT doc_id, {n} AS o, s, e, score FROM (SELECT *, {score} AS score FROM (
  SELECT doc_id, t, f[i] AS m, ({at})::BIGINT AS s, ({at})::BIGINT + len(f[i]) AS e FROM (
    SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (
      SELECT doc_id, t, regexp_extract_all(t, '{quoted(k.plain)}') AS f, string_split_regex(t, '{quoted(k.plain)}') AS p FROM d)))
  WHERE {valid[k.name]}) WHERE score >= {k.needed}""")
    names = "['" + "','".join(k.name for k in KINDS) + "'][o + 1]"
    counts = ", ".join(f"count(*) FILTER (o = {n}) AS n_{k}" for n, k in enumerate(BASE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, {counts}, count(*) AS n_spans,
        coalesce(string_agg({names} || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (o < {len(BASE)}), '') AS base,
        string_agg({names} || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans, string_agg(score::VARCHAR, ',' ORDER BY o, s) AS scores
      FROM f GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN g USING (doc_id)"""


SQL = _sql()
