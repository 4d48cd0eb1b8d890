"""Mixing sources to target weights by weighted fair queueing.

Sources in code-point order (null last) weigh 1, 2, 3, repeating. A source's target is its weight's share of all
words, up to ``MAX_EPOCHS`` times its own words; what a source can't take goes to the others by weight.

Each source's documents stand in a shuffled order (by MD5 of the id and a seed). A document's copy gets the virtual
finish time (words of the source's queue up to its end) / (the source's target); its next copy follows one whole
pass of the queue later. All copies are sorted by finish time over the whole table and taken while their running
words stay within the budget, which is the words of all documents.

Expressions only. A hot source is cut into 4096 parts by its shuffle keys, whose totals are summed before the parts;
rows of one source and id are summed before they queue, so that repeated or null ids don't gather in one part. Sources
may be many: they are ranked and filled by ranges.

Defined results: null text has size 0; size 0 is never taken; repeated rows of one source and id queue as one and are
taken alike; an empty table gives an empty mix; a null id is a value of its own; texts of any length count whole; other
columns are ignored. Running again gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowseries.llm.batches import fresh
from flowseries.llm.ranges import running_totals
from flowseries.llm.scratch import written

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
_PARTS_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """60 bits of MD5, as a long."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, rank, source_size, target, budget``, one row for each source."""
    by_source = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long")), "mix-sources")
    total = by_source.agg(F.sum("source_size").alias("budget"), F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.col("source").isNull().cast("int")), F.lit(0)).alias("nulls"))
    # The running count has null first; its rank is the last.
    ranked = running_totals(by_source, "source", [], {"upto": "one"}).crossJoin(F.broadcast(total))
    ranked = ranked.withColumn("rank", F.when(F.col("source").isNull(), F.col("n")).otherwise(F.col("upto") - F.col("nulls")))
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS)).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * MAX_EPOCHS).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = written(ranked.select("source", "rank", "source_size", "weight", "cap", "ratio", "budget"), "mix-ranked")
    # With the sources that reach their caps first in front, the level is what remains for the rest by weight.
    filling = running_totals(ranked, "ratio", ["rank"], {"caps": "cap", "weights": "weight"}).crossJoin(F.broadcast(ranked.agg(F.sum("weight").alias("all_weights"))))
    level = (F.col("budget") - (F.col("caps") - F.col("cap"))).cast("double") / (F.col("all_weights") - (F.col("weights") - F.col("weight")))
    levels = filling.withColumn("level", level)
    found = levels.filter(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", F.struct("ratio", "rank")).alias("fill"))
    filled = F.least(F.col("cap").cast("double"), F.coalesce(F.col("fill") * F.col("weight"), F.col("cap").cast("double")))
    return ranked.crossJoin(F.broadcast(found)).select("source", "rank", "source_size", filled.alias("target"), "budget")


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs`` (doc_id, text, source)."""
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = written(source_targets(sizes), "mix-targets")
    known = targets.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    places = sizes.groupBy("source", "doc_id").agg(F.sum("size").alias("words")).withColumn("h", shuffle_key(F.col("doc_id"), seed)).withColumn("part", F.shiftright("h", 60 - _PARTS_BITS))
    places = places.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    earlier = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = places.groupBy("rank", "part").agg(F.sum("words").alias("s")).select("rank", "part", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("ahead"))
    upto = F.sum("words").over(Window.partitionBy("rank", "part").orderBy("h", "doc_id")) + F.col("ahead")
    places = written(places.join(parts, ["rank", "part"]).withColumn("upto", upto).drop("part", "ahead"), "mix-queue")

    finish = lambda epoch: (F.col("source_size") * epoch + F.col("upto")).cast("double") / F.col("target")
    copies = places.filter("words > 0 AND target > 0").select("words", "rank", "h", "doc_id", F.explode(F.array(*[finish(F.lit(e)) for e in range(MAX_EPOCHS)])).alias("finish"))
    sorted_copies = running_totals(copies, "finish", ["rank", "h", "doc_id"], {"all_words": "words"})
    budget = targets.agg(F.max("budget").alias("b"))
    key = F.struct("finish", "rank", "h", "doc_id")
    last = sorted_copies.crossJoin(F.broadcast(budget)).filter("all_words <= b").agg(F.max(key).alias("cut"))
    done = [F.when(F.struct(finish(F.lit(e)).alias("finish"), "rank", "h", "doc_id") <= F.col("cut"), 1).otherwise(0) for e in range(MAX_EPOCHS)]
    taken = F.when((F.col("words") > 0) & (F.col("target") > 0), sum(done[1:], done[0])).otherwise(0)
    placed = places.crossJoin(F.broadcast(last)).select(F.col("source").alias("_source"), F.col("doc_id").alias("_id"), "source_size", "target", F.coalesce(taken, F.lit(0)).alias("all_copies"))
    out = sizes.join(placed, F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("all_copies")).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, with the columns of ``docs``."""
    id_, source, size, copies, words, copy = fresh(docs, "id", "src", "size", "copies", "words", "copy")
    plan = mix(docs, seed).filter("copies > 0").select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(size), F.col("copies").alias(copies)).distinct()
    sized = docs.withColumn(words, word_count(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(words) == F.col(size))
    joined = sized.join(plan, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return joined.select(*docs.columns)
