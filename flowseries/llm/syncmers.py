"""Document fingerprints from closed syncmers.

A text's tokens are its words between ASCII white space, cut at ``CUT`` characters; characters of scripts without
spaces are tokens of their own. Of every ``K`` neighbouring tokens each
single one is hashed; the K-mer is a closed syncmer if the smallest of these inner substrings lies at either edge.
That depends on the K-mer alone, so the same passage has the same anchors in any text. ``anchors`` gives them with
positions, for matching passages; a fingerprint is the ``sketch`` smallest distinct anchor hashes, and the likeness of
two of them is Dice's coefficient of the estimated anchor sets (exact while both have fewer anchors than ``sketch``).
With ``sketch=None`` fingerprints hold all anchors, and likeness is exact for texts of any length.

Expressions only; a text is split once and hashed by array functions.

Defined results: null text is empty; a text of fewer than ``K`` tokens has one anchor, its whole sequence, and an
empty one none (an empty fingerprint; two empty ones have likeness 1, one empty one 0); a text whose K-mers hold no
closed syncmer keeps all of them; texts of any length count whole; repeated rows get equal fingerprints; an empty table
gives none; other columns are ignored. Ids may be of any type that can be ordered.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowseries.llm.ranges import let, quantiles, range_bucket

K = 4
SKETCH = 64
CUT = 16
_UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF"
_TOKEN = rf"[{_UNSPACED}]|[^\x20\x09-\x0D{_UNSPACED}]{{1,{CUT}}}+"


def _token_hashes(text: Column) -> Column:
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _kmers(h: Column, closed: bool) -> Column:
    """The K-mers' hashes in the order of their positions; null for those that aren't closed syncmers, if asked."""

    def kmer(first: Column, i: Column) -> Column:
        rest = [F.get(h, i + j) for j in range(1, K)]
        value = F.xxhash64(first, *rest)
        inside = i <= F.size(h) - K
        return F.when(inside & (F.least(first, rest[-1]) <= F.least(*rest[:-1])) if closed else inside, value)

    return F.transform(h, kmer)


def _whole(h: Column) -> Column:
    return F.when(F.size(h) > 0, F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))).otherwise(F.array().cast("array<bigint>"))


def _anchors(text: Column) -> Column:
    """Array of nullable hashes by position: a text's anchors, null where there is none."""

    def chosen(h: Column) -> Column:
        syncmers = let(_kmers(h, True), lambda c: F.when(F.exists(c, lambda x: x.isNotNull()), c).otherwise(_kmers(h, False)))
        return F.when(F.size(h) >= K, syncmers).otherwise(_whole(h))

    return let(_token_hashes(text), chosen)


def anchors(docs: DataFrame) -> DataFrame:
    """``doc_id, position, hash``: one row for each anchor of each text, for joins on ``hash``."""
    return docs.select("doc_id", F.posexplode(_anchors(F.col("text"))).alias("position", "hash")).filter("hash IS NOT NULL")


def fingerprint(text: Column, sketch: int | None = SKETCH) -> Column:
    """The ``sketch`` smallest 32-bit anchor hashes (None: all) in ascending order, eight hexadecimal digits each."""

    def lowest(a: Column, below: Column) -> Column:
        few = F.filter(a, lambda x: x < below)
        return F.slice(F.sort_array(F.array_distinct(few)), 1, sketch)

    def smallest(a: Column) -> Column:
        if sketch is None:
            return F.sort_array(F.array_distinct(F.filter(a, lambda x: x.isNotNull())))
        # Of many hashes only those under a limit are sorted, four times as many as needed if spread evenly.
        limit = F.least(F.lit(float(1 << 32)), F.lit(float(8 * sketch << 32)) / F.size(a)).cast("long")
        every = F.lit(1 << 32)
        return let(lowest(a, limit), lambda x: F.when((F.size(x) == sketch) | (limit == every), x).otherwise(lowest(a, every)))

    hashes = F.transform(_anchors(text), lambda x: F.shiftrightunsigned(x, 32))
    digits = lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))
    found = let(hashes, lambda a: F.when(F.size(a) > 0, smallest(a)).otherwise(a))
    return F.array_join(F.transform(found, digits), "")


def likeness(a: Column, b: Column, sketch: int | None = SKETCH) -> Column:
    """Dice's coefficient of two fingerprints of one ``sketch``, 0 to 1; null when either is null."""
    parts = lambda f: F.regexp_extract_all(f, F.lit("[0-9a-f]{8}"), F.lit(0))

    def compare(x: Column, y: Column) -> Column:
        # The smallest hashes of the union are a sample of it; those in both sketches are a sample of what is shared.
        united = F.array_union(x, y) if sketch is None else F.slice(F.sort_array(F.array_union(x, y)), 1, sketch)
        shared = F.size(F.array_intersect(united, F.array_intersect(x, y)))
        jaccard = shared / F.size(united)
        return F.when(F.size(united) == 0, F.lit(1.0)).otherwise(2 * jaccard / (1 + jaccard))

    whole = let(parts(a), lambda x: let(parts(b), lambda y: compare(x, y)))
    return F.when(a == b, F.lit(1.0)).otherwise(whole)


def _ranges(docs: DataFrame) -> tuple[Column, list[int], set[int]]:
    """The range of a row of ``docs`` (doc_id, text, h) in ascending order of (doc_id, h), all ranges, and those that
    hold rows of one id only. An id of many ranges' rows, and null, are cut by ``h``."""
    found = Counter(quantiles(docs, "doc_id"))
    bounds = sorted(found)
    rows, ids = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nulls = -(-(rows - ids) * n // rows) if rows else 0
    parts = [found[b] if found[b] > 1 else 0 for b in bounds] + [0]
    starts = [0, *accumulate(1 + p for p in parts)]
    cut = lambda p: F.shiftright((F.shiftright("h", 40) + (1 << 23)) * p, 24).cast("int")

    def placed(i: Column) -> Column:
        start = F.get(F.array(*map(F.lit, starts[:-1])), i)
        if not any(parts):
            return start
        p, bound = F.get(F.array(*map(F.lit, parts)), i), F.get(F.array(*[F.lit(b).cast(kind) for b in bounds]), i)
        return start + F.when((p > 0) & (F.col("doc_id") == bound), 1 + cut(p)).otherwise(0)

    kind = docs.schema["doc_id"].dataType.simpleString()
    at = let(range_bucket(F.col("doc_id"), bounds, kind), placed)
    if nulls:
        at = F.when(F.col("doc_id").isNull(), cut(F.lit(nulls)) - nulls).otherwise(at)
    single = {s + 1 + j for s, p in zip(starts, parts, strict=False) for j in range(p)} | set(range(-nulls, 0))
    return at, list(range(-nulls, starts[-1])), single


def edited_half(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last floor(n_chars/2) code points give way to the first
    as many (or all) of the next document's, in descending order of ``doc_id``; after the last comes the first.

    ``docs``: doc_id, text; rows of equal or null ids follow each other in the order of their texts' hashes, nulls last.
    Ids are cut into ranges, and an id of many rows, or null, into several; a range's first document is also sent to
    the range before, so each text is shuffled once and no task sees more than its range.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    at, every, single = _ranges(docs)
    placed = docs.withColumn("bucket", at)
    # At most one row for each range. Where a range holds one id, its first document is that of the highest hash.
    tops = [F.max("doc_id").alias("top"), (F.max("h") if single else F.lit(None).cast("long")).alias("h")]
    firsts = {r["bucket"]: r for r in placed.groupBy("bucket").agg(*tops).collect()}
    down = sorted(firsts, reverse=True)
    before = {b: down[i - 1] for i, b in enumerate(down)}  # the range that precedes; before the first: the last
    of = lambda values, k: F.get(F.array(*[F.lit(v).cast(k) for v in values]), F.col("bucket") - every[0])
    top = of([firsts[b]["top"] if b in firsts else None for b in every], kind)
    first = F.col("doc_id").eqNullSafe(top)
    if single:
        first = first & F.coalesce(F.col("h") == of([firsts[b]["h"] if b in firsts and b in single else None for b in every], "long"), F.lit(True))
    own = F.struct(F.col("bucket").alias("at"), F.lit(0).alias("guest"))
    guest = F.struct(of([before.get(b, b) for b in every], "int").alias("at"), F.lit(1).alias("guest"))
    prints = placed.withColumn("fingerprint", fingerprint(F.col("text"))).withColumn("to", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))))
    rows = prints.select("doc_id", "text", "h", "fingerprint", "to.at", "to.guest")
    w = Window.partitionBy("at").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("h").desc(), "text")
    pairs = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fingerprint", F.lead("fingerprint").over(w)).filter("guest = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    out = pairs.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).drop("text", "next_text", "h")
    out = out.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return out.select("*", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")).drop("next_fingerprint")
