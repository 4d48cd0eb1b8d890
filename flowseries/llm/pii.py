"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Expressions only. A pattern's matches are wrapped in a control character that no pattern can match (in the text it
is replaced by another one first, so lengths stay), the text is split there, and running lengths give the positions
in code points. Quantifiers are possessive where that changes no match, so that long runs take linear time.

Kinds as listed below; the first four are the base: they stay whatever their score. Added kinds (IBAN by mod 97,
US social security numbers) need a score of ``KEEP`` or more.

Defined results: null text is empty; a text without spans gives an empty array; texts of any length are searched
whole; spans of one start stand in the order of their kinds; repeated rows each get their own; ids may be null; an
empty table gives none. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowseries.llm.batches import fresh
from flowseries.llm.ranges import let

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
KEEP = 0.5
CONTEXT = 40
_MARK, _OTHER = "\u0001", "\u0002"
#: Numbers of an array that are walked one by one, and code points of a text that are cut out together.
_BLOCK, _CHUNK = 128, 1024

# Length of a country's IBANs, by country code.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """A known country's IBAN has that country's length, so what follows it is no part of it; for others, any."""
    known = [f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()]
    every = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    # What every IBAN begins with is looked for first, so that words don't try every country.
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(known)}|(?!{every})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])"


# Patterns, their scores without context, and words near a span that speak for it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban_pattern(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
WORDS = {
    "email": "mail|e-mail|email|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|login|adresse|dirección",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|transfer|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}
_NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0), lambda acc, x: acc + value(x))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    doubled = F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.get(doubled, d.cast("int"))).otherwise(d.cast("int")))
    return _total(values, lambda x: x) % 10 == 0


def mod97(compact: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1 modulo 97."""
    moved = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))
    chars = F.transform(F.split(moved, ""), lambda c: F.ascii(c))
    number = lambda a: F.when(a >= 65, a - 55).otherwise(a - 48)
    return F.aggregate(chars, F.lit(0), lambda acc, a: let(number(a), lambda v: (acc * F.when(v >= 10, 100).otherwise(10) + v) % 97)) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return let(digits, lambda d: F.length(d).between(12, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return let(F.regexp_replace(match, " ", ""), lambda c: F.length(c).between(15, 34) & mod97(c))
    return F.lit(True)


def _running(values: Column, combine: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """For an array of whole numbers what ``combine`` makes, from 0, of those before each of them, and of all at the end.
    Blocks of ``_BLOCK`` are walked one by one from what the blocks before them come to, so no step copies more than a
    block and the work is linear."""
    zero = F.array(F.lit(0))

    def walked(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.array(start), lambda acc, v: F.concat(acc, F.array(combine(F.element_at(acc, -1), v))))

    if not levels:
        return walked(values, F.lit(0))
    count = F.floor((F.size(values) + _BLOCK - 1) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(values, i * _BLOCK + 1, _BLOCK))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda b: F.aggregate(b, F.lit(0), combine))
        return let(_running(totals, combine, levels - 1), lambda starts: F.concat(F.flatten(F.transform(parts, lambda b, i: F.slice(walked(b, F.get(starts, i)), F.lit(1), F.size(b)))), F.array(F.element_at(starts, -1))))

    return F.when(F.size(values) <= _BLOCK, walked(values, F.lit(0))).when(F.size(values) > 0, let(blocks, joined)).otherwise(zero)


def _matches(text: Column, kind: str) -> Column:
    """Array of (start, end, match, before, after); code points, ``end`` exclusive."""
    nothing = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")

    def walk(parts: Column) -> Column:
        ends = _running(F.transform(parts, lambda p: F.length(p)), lambda a, v: a + v)
        pairs = F.sequence(F.lit(0), F.floor((F.size(parts) - 3) / 2).cast("int"))

        def rows(at: Column) -> Column:
            def row(i: Column) -> Column:
                match, before, after = F.get(parts, 2 * i + 1), F.get(parts, 2 * i), F.get(parts, 2 * i + 2)
                return F.struct(F.get(at, 2 * i + 1).alias("start"), F.get(at, 2 * i + 2).alias("end"), match.alias("match"), F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"))

            return F.transform(pairs, row)

        return F.when(F.size(parts) > 2, let(ends, rows)).otherwise(nothing)

    marked = F.regexp_replace(text, F.lit(PATTERNS[kind]), F.lit(f"{_MARK}$0{_MARK}"))
    found = let(F.split(marked, _MARK), walk)
    return F.when(F.contains(text, F.lit(_NEEDS[kind])), found).otherwise(nothing) if kind in _NEEDS else found


def _scored(text: Column, rank: int, kind: str) -> Column:
    """The kind's confirmed spans with their scores."""
    words = rf"(?i)(?<![\p{{L}}0-9])(?:{WORDS[kind]})(?![\p{{L}}0-9])"

    def span(m: Column) -> Column:
        near = m["before"].rlike(words) | m["after"].rlike(words)
        score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near, 0.3).otherwise(0.0))
        return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    spans = F.transform(F.filter(_matches(text, kind), lambda m: _valid(kind, m["match"])), span)
    return spans if rank < BASE else F.filter(spans, lambda x: x["score"] >= KEEP)


def pii_spans(text: Column) -> Column:
    """Array of (start, rank, end, kind, score) by start, then kind as listed."""
    clear = F.replace(F.coalesce(text, F.lit("")), F.lit(_MARK), F.lit(_OTHER))
    return let(clear, lambda t: F.array_sort(F.concat(*[_scored(t, r, k) for r, k in enumerate(KINDS)])))


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with their spans as ``pii``, in place of a column so named."""
    return docs.withColumn("pii", pii_spans(F.col("text")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, the digest of the base spans, all spans as text, and their ``scores``."""
    found = find_pii(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.sha2(_listed(F.filter("pii", lambda s: s["rank"] < BASE)), 256)
    return found.select("doc_id", *[count(k) for k in KINDS[:BASE]], base.alias("base_sha256"), _listed(F.col("pii")).alias("spans"), *[count(k) for k in KINDS[BASE:]], F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets (overlapping spans by the first one's), and
    ``n_chars`` renewed where there is such a column."""

    spans, chunks, latest, found = fresh(docs, "spans", "chunks", "latest", "found")
    named = docs.withColumn(spans, pii_spans(F.col("text"))).withColumn(found, F.size(spans) > 0)
    # Chunks of equal length let a piece be cut out without a walk from the text's beginning. Each step is a column of
    # its own: as one expression they are nested too deeply for Spark to resolve.
    named = named.withColumn(chunks, F.when(F.col(found), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))))
    named = named.withColumn(latest, F.when(F.col(found), _running(F.transform(spans, lambda s: s["end"]), lambda a, v: F.greatest(a, v))))

    def cut(begin: Column, end: Column) -> Column:
        first = F.floor(begin / _CHUNK).cast("int")
        around = F.array_join(F.slice(chunks, first + 1, F.floor(end / _CHUNK).cast("int") - first + 1), "")
        return F.substring(around, begin - first * _CHUNK + 1, end - begin)

    def piece(s: Column, i: Column) -> Column:
        at = F.get(latest, i)
        return F.when(s["start"] >= at, F.concat(cut(at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")

    text = F.concat(F.array_join(F.transform(spans, piece), ""), cut(F.element_at(latest, -1), F.length("text")))
    out = named.withColumn("text", F.when(F.col(found), text).otherwise(F.col("text"))).drop(spans, chunks, latest, found)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
