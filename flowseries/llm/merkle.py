"""A Merkle manifest of a table: a hash for each row, a tree of hashes for each value of a column, a tree over those
trees, and for each row the proof that leads from its leaf to the root.

Rows are put in order once (range sort, narrow rows) and cut into aligned blocks of ``fanout ** BLOCK_LEVELS`` leaves,
so a block is a whole subtree and its lower levels need no other block. Upper levels come by butterfly exchange: in
each round the ``fanout`` subtrees under one node swap their roots, block by block, and every block hashes the node
above by itself. After a round for each level every block holds the root and all its upper siblings: nothing is handed
down again. A round is one shuffle of ``fanout`` rows a block. Where the last subtree of a level has fewer blocks than
its siblings, its blocks serve the siblings' other blocks in turn.

Defined results: a null field is ``-`` and differs from an empty one; texts of any length are hashed whole; rows alike
in all that is hashed are each a leaf; rows of one order key follow each other by their leaves; null keys and null
trees come first; other columns aren't part of a leaf and may have any name; an empty table has no rows and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowseries.llm.scratch import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
BLOCK_LEVELS = 3
_PROOF = "array<struct<place:int,siblings:array<string>>>"


def leaf(*fields: Column) -> Column:
    """SHA-256 (lower-case hex) of the fields, each ``-`` if null, else its bytes' count, a colon and its text."""
    texts = [F.col(f) if isinstance(f, str) else f for f in fields]
    texts = [t.cast("string") for t in texts]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _node(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, ""), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    step = lambda h, p: _node(F.concat(F.slice(p["siblings"], F.lit(1), p["place"]), F.array(h), F.slice(p["siblings"], p["place"] + 1, F.greatest(F.size(p["siblings"]) - p["place"], F.lit(0)))))
    return F.aggregate(proof, start, step)


def siblings(proof: Column) -> Column:
    """All hashes of a proof, level by level, left to right."""
    return F.flatten(F.transform(proof, lambda p: p["siblings"]))


def _div(x: Column, n: int) -> Column:
    return F.call_function("div", x, F.lit(n))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with ``_tree`` (rank of their tree's key), ``_position`` in it and its ``_total``."""
    by = ["_key", "_order", "_leaf", "_tie"]
    # The tie cuts rows that are alike in everything into several ranges too.
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by])
    at = written(spread.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_at", 33)
    # A row for each range and each key in it: as many as there are ranges and keys.
    spans = written(at.groupBy(part.alias("_part"), F.col("_key").alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")), "spans")
    of_key = Window.partitionBy("_k")
    spans = spans.withColumns({
        "_before": F.coalesce(F.sum("_n").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_total": F.sum("_n").over(of_key), "_begin": F.min("_first").over(of_key),
    })
    # Keys are ranked by where they begin, range by range.
    begins = spans.select("_k", "_begin").distinct().withColumn("_range", F.shiftright("_begin", 33))
    counts = begins.groupBy("_range").agg(F.count(F.lit(1)).alias("_keys"))
    earlier = F.coalesce(F.sum("_keys").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = begins.join(counts.withColumn("_earlier", earlier), "_range")
    ranks = ranks.select(F.col("_k").alias("_k2"), (F.col("_earlier") + F.row_number().over(Window.partitionBy("_range").orderBy("_begin")) - 1).alias("_tree"))
    places = spans.join(ranks, F.col("_k").eqNullSafe(F.col("_k2"))).drop("_k2", "_n", "_begin")
    found = at.withColumn("_p", part).join(places, (F.col("_p") == F.col("_part")) & F.col("_key").eqNullSafe(F.col("_k")))
    return found.withColumn("_position", F.col("_at") - F.col("_first") + F.col("_before")).drop("_p", "_part", "_k", "_first", "_before", "_at")


def _levels(blocks: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    """Columns ``_l0`` ... of the hashes at each level inside a block; a tree of one block stops at its root."""
    df = blocks.withColumn("_l0", F.transform("_leaves", lambda x: x["_leaf"]))
    for k in range(block_levels):
        df = df.withColumn(f"_l{k + 1}", F.when(F.col("_total") > fanout**k, _runs(F.col(f"_l{k}"), fanout)).otherwise(F.col(f"_l{k}")))
    return df


def _runs(hashes: Column, fanout: int) -> Column:
    return F.transform(F.sequence(F.lit(0), _div(F.size(hashes) - 1, fanout)), lambda i: _node(F.slice(hashes, (i * fanout + 1).cast("int"), fanout)))


def exchange(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Butterfly rounds over ``_tree, _count, _block, _hash, _upper``: blocks 0 to ``_count`` - 1 of each tree with the
    roots of their subtrees. Gives the same rows with the tree's root as ``_hash`` and ``_upper`` extended by the
    siblings met on the way up."""
    most = nodes.agg(F.max("_count")).first()[0] or 0
    step = 1
    while step < most:
        nodes = _round(nodes, step, fanout)
        step *= fanout
    return nodes


def _round(nodes: DataFrame, step: int, fanout: int) -> DataFrame:
    """One exchange between the subtrees of ``step`` blocks; trees that are at their root already stay as they are."""
    own = F.col("_block")
    node, low, up = _div(own, step), own % step, F.col("_count") > step
    blocks_of = lambda n: F.least(F.lit(step).cast("long"), F.col("_count") - n * step)
    parent = _div(node, fanout)
    family = F.sequence(parent * fanout, F.least(parent * fanout + fanout - 1, _div(F.col("_count") - 1, step)))

    def served(n: Column) -> Column:
        """Blocks of node ``n`` that this one sends its hash to."""
        places = F.sequence(low, blocks_of(n) - 1, blocks_of(node))
        return F.when(low < blocks_of(n), F.transform(places, lambda x: n * step + x)).otherwise(F.array().cast("array<bigint>"))

    to = F.when(up, F.flatten(F.transform(family, served))).otherwise(F.array(own))
    sent = nodes.select("_tree", "_count", F.explode(to).alias("_to"), "_block", F.when(up, (node % fanout).cast("int")).otherwise(F.lit(0)).alias("digit"), "_hash", "_upper")
    mine = F.when(F.col("_to") == F.col("_block"), F.col("_upper"))
    met = sent.groupBy("_tree", "_to").agg(F.max("_count").alias("_count"), F.array_sort(F.collect_list(F.struct("digit", "_hash"))).alias("_met"), F.first(mine, ignorenulls=True).alias("_upper"))
    digit = (_div(F.col("_to"), step) % fanout).cast("int")
    hashes = F.transform("_met", lambda x: x["_hash"])
    others = F.transform(F.filter("_met", lambda x: x["digit"] != digit), lambda x: x["_hash"])
    more = F.array(F.struct(digit.alias("place"), others.alias("siblings"))).cast(_PROOF)
    return met.select(
        "_tree", "_count", F.col("_to").alias("_block"), F.when(up, _node(hashes)).otherwise(hashes[0]).alias("_hash"),
        F.when(up, F.concat("_upper", more)).otherwise(F.col("_upper")).alias("_upper"),
    )


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """For each row its ``order`` key, ``leaf``, ``subroot`` (of the rows of its ``tree``, in the order of ``order``),
    ``root`` and ``proof`` (for each level the leaf's place in its run and the run's other hashes), and the columns of
    ``carry``, which should be narrow."""
    carry = carry or {}
    rows = docs.select(F.col(tree).alias("_key"), F.col(order).alias("_order"), leaf(*fields).alias("_leaf"), *[c.alias(n) for n, c in carry.items()])
    size = fanout**block_levels
    leaves = F.array_sort(F.collect_list(F.struct("_position", "_order", "_leaf", *carry)))
    blocks = _ordered(rows).groupBy("_tree", _div(F.col("_position"), size).alias("_block")).agg(F.max("_total").alias("_total"), leaves.alias("_leaves"))
    blocks = written(blocks, "blocks")
    nodes = _levels(blocks, fanout, block_levels).select("_tree", _div(F.col("_total") + size - 1, size).alias("_count"), "_block", F.col(f"_l{block_levels}")[0].alias("_hash"), F.array().cast(_PROOF).alias("_upper"))
    upper = written(exchange(written(nodes, "roots"), fanout), "upper")
    tops = upper.filter("_block = 0").select("_tree", "_hash")
    n_trees = tops.agg(F.max("_tree")).first()[0]
    over = tops.select(F.lit(0).alias("_tree"), F.lit((n_trees or 0) + 1).cast("long").alias("_count"), F.col("_tree").cast("long").alias("_block"), "_hash", F.array().cast(_PROOF).alias("_upper"))
    over = exchange(over, fanout).select(F.col("_block").alias("_tree"), F.col("_hash").alias("_root"), F.col("_upper").alias("_over"))
    joined = _levels(blocks, fanout, block_levels).join(upper.select("_tree", "_block", F.col("_hash").alias("_subroot"), "_upper"), ["_tree", "_block"]).join(over, "_tree")

    def level(at: Column, k: int) -> Column:
        place = (_div(at, fanout**k) % fanout).cast("int")
        run = F.slice(f"_l{k}", (_div(at, fanout ** (k + 1)) * fanout + 1).cast("int"), fanout)
        one = F.struct(place.alias("place"), F.filter(run, lambda x, i: i != place).alias("siblings"))
        return F.when(F.col("_total") > fanout**k, F.array(one)).otherwise(F.array().cast(_PROOF))

    def proof(at: Column) -> Column:
        return F.concat(*[level(at, k) for k in range(block_levels)], F.col("_upper"), F.col("_over"))

    row = F.transform("_leaves", lambda x, i: F.struct(x["_order"].alias("_order"), x["_leaf"].alias("_leaf"), proof(i).alias("_proof"), *[x[c].alias(c) for c in carry]))
    out = joined.select(F.explode(row).alias("_row"), "_subroot", "_root")
    return out.select(
        F.col("_row._order").alias(order), F.col("_row._leaf").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"),
        F.col("_row._proof").alias("proof"), *[F.col(f"_row.`{c}`").alias(c) for c in carry],
    )


def tampered_leaf() -> Column:
    """What a row's leaf would be with its text's A-Z in lower case, where 3 divides the CRC-32 of its id; else null."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(crc % 3 == 0, leaf("doc_id", "source", "lang", "n_chars", lowered))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The manifest with proofs as digests, and each row's proof tried on its tampered leaf, if it has one."""
    found = manifest(docs, carry={"_tampered": tampered_leaf()})
    folded = fold(F.coalesce("_tampered", "leaf"), F.col("proof"))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings(F.col("proof")), ""), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
