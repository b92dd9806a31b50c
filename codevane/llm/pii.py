"""Personal data: regular expressions propose, checksums confirm, context scores.

Everything here is a DataFrame expression, so a scan is one narrow stage with
no shuffle and no Python on the executors.

Spans are code-point offsets, end exclusive, leftmost and non-overlapping
within a kind.  Kinds ``email ip card phone`` are always reported when their
validator passes.  Kinds ``iban`` (length of its country and mod-97), ``ssn``
and ``secret`` (shape only) are the operator's own; an ``ssn`` or ``secret``
proposal counts only if words near it lift its score to ``threshold``.  For a
secret, a long key of hexadecimal digits or mixed letters and digits, that is a
label such as ``token =`` right before it.

Offsets are running sums over the matches of a text.  They are taken by blocks,
and blocks of blocks, so that their cost stays near linear in the number of
matches; every level is a column, since Spark evaluates whatever stands inside
a lambda once for each element.

Defined results: a null text counts as empty and has no spans; texts of any
length are read whole; repeated rows give repeated results; a table without
rows gives none; columns not named here pass through ``detect`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements per block of running sums, and characters per block of a text that is put together anew.
BLOCK, PART = 64, 4096
#: Characters on each side of a span that are searched for context words.
WINDOW = 48
PREFIX = "__pii_"


@dataclass(frozen=True)
class Kind:
    """One kind of span: how it is proposed, confirmed and scored.

    ``hint`` is a cheap test that every text with a match passes.  ``pattern``
    equals the plain form of the kind but cannot backtrack for long: a match
    may start only where a run of its characters starts or where the last
    match ended, and its loops are possessive.
    """

    name: str
    hint: str
    pattern: str
    base: float
    context: str
    own: bool = False


# The length of an account number by country.
IBAN = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban() -> str:
    """Country, two digits and as many characters as the country has, by fours with a blank before each or none."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN.items():
        by_length.setdefault(n, []).append(country)
    forms = []
    for n, countries in sorted(by_length.items()):
        fours, rest = divmod(n - 4, 4)
        last = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(rf"(?:{'|'.join(countries)})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}{last}")
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(forms)})(?![A-Za-z0-9])"


#: Stands between the text before and after a span where context is looked for.
MARK = "\x00"

KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"(?i)\b(e-?mail|mail|contact|write)\b"),
    Kind("ip", "[0-9]\\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, r"(?i)\b(ip|host|server|address|login)\b"),
    Kind("card", "[0-9]", r"[0-9](?:[\x20-]?[0-9])++", 0.8, r"(?i)\b(card|visa|credit|debit|payment|cvv)\b"),
    Kind("phone", "\\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, r"(?i)\b(phone|tel|call|mobile|fax)\b"),
    Kind("iban", "[A-Z]{2}[0-9]{2}", _iban(), 0.9, r"(?i)\b(iban|account|bank|transfer)\b", True),
    Kind("ssn", "[0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"(?i)\b(ssn|social security|insurance number)\b", True),
    Kind(
        "secret",
        "[A-Za-z0-9+/_-]{20}",
        r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}+",
        0.3,
        r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|credentials?|auth\w*|(?:api|access|private|session|encryption|signing)[\x20_-]?key)[\"']?\s*(?:[:=]|:=|=>|\bis\b)\s*[\"'`]?" + MARK,
        True,
    ),
)
#: What a nearby context word adds to a span's score.
LIFT = 0.3


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """True for a string of 13 to 19 digits whose Luhn sum is a multiple of 10."""
    full = F.lpad(d, 19, "0")
    total = F.lit(0)
    for i in range(19):
        x = F.substring(full, i + 1, 1).cast("int")
        if (19 - i) % 2 == 0:
            x = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        total = total + x
    return F.length(d).between(13, 19) & (total % 10 == 0)


def mod97(s: Column) -> Column:
    """True for an account number without spaces whose ISO 7064 remainder is 1."""
    turned = F.concat(F.substring(s, 5, 100), F.substring(s, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substr(turned, i, F.lit(1))) - 1
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.length(s).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step) == 1)


def octets(s: Column) -> Column:
    """True if each of four dotted numbers is at most 255."""
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return s.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def confirmed(kind: str, s: Column) -> Column:
    """The kind's validator on a matched string."""
    if kind == "ip":
        return octets(s)
    if kind == "card":
        return luhn(digits(s))
    if kind == "phone":
        return F.length(digits(s)).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(s, F.lit(" "), F.lit("")))
    return F.lit(True)


SPAN = "array<struct<kind:string,start:int,end:int,score:double,own:boolean>>"
INTS = "cast(array() as array<int>)"


def running(df: DataFrame, columns: dict[str, str], zero: int, op: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds, for each array column of numbers (out: column), what ``op`` makes of all elements before each element.

    Columns are named at least twice where they are used, else the optimizer
    would put their expressions into the lambdas.
    """

    def fold(c: Column) -> Column:
        return F.aggregate(c, F.lit(zero), op)

    def blocks(c: str) -> Column:
        n = F.ceil(F.size(c) / BLOCK).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda b: fold(F.slice(c, b * BLOCK + 1, F.lit(BLOCK))))).otherwise(F.expr(INTS))

    def before(c: str, above: str | None) -> Column:
        def place(x: Column, i: Column) -> Column:
            if above is None:
                return fold(F.slice(c, F.lit(1), i))
            return op(F.get(above, F.floor(i / BLOCK).cast("int")), fold(F.slice(c, i - i % BLOCK + 1, i % BLOCK)))

        done = F.transform(c, place)
        return done if above is None else F.when(F.size(above) >= 0, done)

    df = df.withColumns({out + "_1": blocks(c) for out, c in columns.items()})
    df = df.withColumns({out + "_2": blocks(out + "_1") for out in columns})
    df = df.withColumns({out + "_b2": before(out + "_2", None) for out in columns})
    df = df.withColumns({out + "_b1": before(out + "_1", out + "_b2") for out in columns})
    df = df.withColumns({out: before(c, out + "_b1") for out, c in columns.items()})
    return df.drop(*[out + end for out in columns for end in ("_1", "_2", "_b1", "_b2")])


def _located(k: Kind, found: str, pieces: str, before: str) -> Column:
    """Confirmed spans of a kind; ``before`` has the characters up to the text before each match."""

    def span(m: Column, i: Column) -> Column:
        start = F.get(before, i) + F.length(F.get(pieces, i))
        near = F.concat(F.right(F.get(pieces, i), F.lit(WINDOW)), F.lit("\x00"), F.left(F.get(pieces, i + 1), F.lit(WINDOW)))
        score = F.when(near.rlike(k.context), F.least(F.lit(1.0), F.lit(k.base + LIFT))).otherwise(F.lit(k.base))
        one = F.struct(F.lit(k.name).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), score.alias("score"), F.lit(k.own).alias("own"))
        return F.when(confirmed(k.name, m), one)

    spans = F.filter(F.transform(found, span), lambda s: s.isNotNull())
    return F.when((F.size(found) > 0) & (F.size(before) >= 0), spans).otherwise(F.expr(f"cast(array() as {SPAN})"))


def detect(df: DataFrame, text: str = "text", out: str = "spans", threshold: float = 0.6) -> DataFrame:
    """Adds ``out``: the confirmed spans as structs (kind, start, end, score, own), by kind, then start.

    Spans of the four base kinds stay whatever their score; those of the
    operator's own kinds need ``threshold``.  All other columns are kept.
    """
    t, names = PREFIX + "text", df.columns
    found, pieces, sizes, before = (PREFIX + x for x in ("m_", "p_", "n_", "b_"))
    df = df.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    none = F.expr("cast(array() as array<string>)")
    df = df.withColumns({found + k.name: F.when(F.col(t).rlike(k.hint), F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))).otherwise(none) for k in KINDS})
    df = df.withColumns({pieces + k.name: F.when(F.size(found + k.name) > 0, F.split(t, k.pattern, -1)).otherwise(none) for k in KINDS})
    df = df.withColumns({sizes + k.name: F.zip_with(found + k.name, F.slice(pieces + k.name, F.lit(1), F.size(found + k.name)), lambda m, p: F.length(m) + F.length(p)) for k in KINDS})
    df = running(df, {before + k.name: sizes + k.name for k in KINDS}, 0, lambda a, x: a + x)
    df = df.withColumns({PREFIX + "s_" + k.name: _located(k, found + k.name, pieces + k.name, before + k.name) for k in KINDS})
    spans = F.concat(*[F.filter(PREFIX + "s_" + k.name, lambda s: ~s.own | (s.score >= threshold)) for k in KINDS])
    return df.withColumn(PREFIX + "all", spans).select(*[F.col(f"`{c}`") for c in names if c != out], F.col(PREFIX + "all").alias(out))


def mask(df: DataFrame, text: str = "text", threshold: float = 0.6) -> DataFrame:
    """Replaces each span of ``text`` by its kind in angle brackets; overlapping spans become one.

    The first of overlapping spans (by start, then longer) names the result.
    A null text stays null.  All columns keep their names and order.
    """
    s, names = PREFIX + "spans", df.columns
    spans, ends, before, parts = (PREFIX + x for x in ("ordered", "ends", "before", "parts"))
    df = detect(df, text, s, threshold)
    df = df.withColumn(spans, F.array_sort(F.transform(s, lambda x: F.struct(x.start.alias("start"), (-x.end).alias("back"), x.kind.alias("kind")))))
    source = F.col(f"`{text}`")
    cut = F.when(F.size(spans) > 0, F.regexp_extract_all(source, F.lit(rf"(?s).{{1,{PART}}}"), F.lit(0)))
    df = df.withColumns({ends: F.transform(spans, lambda x: -x.back), parts: F.coalesce(cut, F.expr("cast(array() as array<string>)"))})
    df = running(df, {before: ends}, 0, lambda a, x: F.greatest(a, x))

    def between(a: Column, b: Column) -> Column:
        """Characters a to b-1 of the text, from its parts."""
        i, j = (F.floor(x / PART).cast("int") for x in (a, b))
        first, last = (F.coalesce(F.get(parts, x), F.lit("")) for x in (i, j))
        long = F.concat(F.substr(first, a % PART + 1), F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substr(last, F.lit(1), b % PART))
        return F.when(i == j, F.substr(first, a % PART + 1, b - a)).otherwise(long)

    def put(x: Column, i: Column) -> Column:
        at = F.get(before, i)
        return F.when(x.start >= at, F.concat(between(at, x.start), F.lit("<"), x.kind, F.lit(">"))).otherwise(F.lit(""))

    tail = between(F.array_max(ends), F.length(source))
    done = F.concat(F.array_join(F.transform(spans, put), ""), tail)
    masked = F.when((F.size(spans) > 0) & (F.size(before) > 0) & (F.size(parts) > 0), done).otherwise(source)
    return df.withColumn(PREFIX + "masked", masked).select(*[F.col(PREFIX + "masked").alias(c) if c == text else F.col(f"`{c}`") for c in names])


def digest(df: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, the hash of the base spans and all spans as text."""
    df = detect(df.select("doc_id", "text"))

    def joined(keep) -> Column:
        return F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == name)).cast("long").alias("n_" + name)

    counts = [count(k.name) for k in KINDS if not k.own]
    return df.select("doc_id", *counts, F.sha2(joined(lambda s: ~s.own), 256).alias("base_sha256"), joined(lambda s: F.lit(True)).alias("spans"))
