"""The registered queries of this subpackage, over whole tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowseries.llm import byte_bpe, hard_negatives, license_rules, merkle, mixing, pii, quality_knn, quality_rules, scratch, sentencepiece_codec, simhash, syncmers, tool_calls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one of fewer files than there are cores is dealt over them, so a small file isn't one task."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_half(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.load_model(spark)
    return sentencepiece_codec.token_digest(_table(spark, sf_dir, "documents"), model)


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_knn.score(docs, quality_knn.fit(docs, _table(spark, sf_dir, "labels")))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, messages = tool_calls.from_turns(_table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.TOOLS, messages)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_warc(spark, path, with_payload=False))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_rules.scan(_table(spark, sf_dir, "documents"))
    names = [F.array_join(c, " ").alias(c) for c in ("sentence_ids", "licences")]
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), *names, F.col("left_over").cast("long").alias("left_over"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_bpe.load_ranks(spark))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_knn": op5_quality_knn,
    "op6_tool_calls": op6_tool_calls,
    "op7_warc": op7_warc,
    "op8_pii": op8_pii,
    "op9_licenses": op9_licenses,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_merkle": op13_merkle,
}


def _license_sql() -> str:
    """The scan over the same sentences and rules, with patterns of its own: one unnested row for each sentence, then the
    rules one by one."""
    known = ", ".join(f"('{k}', '{v}')" for k, v in license_rules.known_sentences().items())
    end, other = r"[.!?:;]+(?:[\x20\x09-\x0D]+|$)|\n+", r"[^\p{L}\p{N}]+"
    steps, found = [], []
    for i, (licence, rule) in enumerate(license_rules.RULES):
        at = f"' {'  '.join(rule)} '"
        steps.append(f"replace(r{i}, {at}, ' - ') AS r{i + 1}")
        found.append((licence, f"contains(r{i}, {at})"))
    order: list[str] = []
    for licence, _ in found:
        if licence not in order:
            order.append(licence)
    hits = ", ".join("CASE WHEN " + " OR ".join(h for x, h in found if x == licence) + f" THEN '{licence}' END" for licence in order)
    # A licence stands where its first rule that matches does, so the order of first rules is kept by sorting on it.
    ranks = ", ".join("CASE " + " ".join(f"WHEN {h} THEN {i}" for i, (x, h) in enumerate(found) if x == licence) + " ELSE 999 END" for licence in order)
    return f"""
WITH k(sentence, id) AS (VALUES {known}),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents),
cuts AS (
  SELECT n, 0 AS cut, regexp_split_to_array(text, '{end}') AS parts FROM d
  UNION ALL
  SELECT n, 1 AS cut, regexp_split_to_array(regexp_replace(text, '([^\n])\n([^\n])', '\1 \2', 'g'), '{end}') AS parts FROM d
),
s AS (SELECT n, cut, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cuts),
m AS (SELECT n, cut, list(k.id ORDER BY i) AS ids FROM s JOIN k ON trim(regexp_replace(lower(part), '{other}', ' ', 'g')) = k.sentence GROUP BY n, cut),
b AS (SELECT n, arg_max(ids, len(ids) * 2 - cut) AS ids FROM m GROUP BY n),
r AS (SELECT n, ids, ' ' || array_to_string(ids, '  ') || ' ' AS r0, {', '.join(steps)} FROM b),
f AS (
  SELECT n, ids, list_transform(list_sort(list_filter(list_zip([{ranks}], [{hits}]), lambda x: x[1] < 999)), lambda x: x[2]) AS licences,
         len(list_filter(string_split(trim(r{len(steps)}), ' '), lambda x: x <> '' AND x <> '-')) AS left_over
  FROM r
)
SELECT d.doc_id, coalesce(len(f.ids), 0)::BIGINT AS n_sentences, coalesce(array_to_string(f.ids, ' '), '') AS sentence_ids,
       coalesce(array_to_string(f.licences, ' '), '') AS licences, coalesce(f.left_over, 0)::BIGINT AS left_over
FROM d LEFT JOIN f ON d.n = f.n
"""


def _merkle_sql() -> str:
    """Trees level by level: a run is a group of a level's nodes, numbered by their places; the tree over the trees is
    one more tree, of the subroots. CRC-32 by its polynomial, as DuckDB has no function for it."""
    parts = lambda text: " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT), lambda c, b: {byte}), 4294967295)"

    def tree(name: str, nodes: str) -> str:
        return f"""{name} AS (
  SELECT tree, 0 AS level, place, h, count(*) OVER (PARTITION BY tree) AS width FROM {nodes}
  UNION ALL
  SELECT tree, level + 1, place, h, count(*) OVER (PARTITION BY tree) FROM (
    SELECT tree, level, place // 8 AS place, sha256(string_agg(h, '' ORDER BY place)) AS h FROM {name} WHERE width > 1 GROUP BY tree, level, place // 8)
)"""

    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({parts('text')}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({parts(lowered)}) END AS other FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d
), leaves AS (SELECT tree, place, leaf AS h FROM l),
{tree('lower_tree', 'leaves')},
subroots AS (SELECT tree, h FROM lower_tree WHERE width = 1), tops AS (SELECT 0 AS tree, tree AS place, h FROM subroots),
{tree('upper_tree', 'tops')},
runs AS (
  SELECT 0 AS stage, tree, level, place, width, h FROM lower_tree WHERE width > 1 UNION ALL SELECT 1, tree, level, place, width, h FROM upper_tree WHERE width > 1
), sides AS (
  SELECT a.stage, a.tree, a.level, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS behind
  FROM runs a JOIN runs b ON a.stage = b.stage AND a.tree = b.tree AND a.level = b.level AND a.place // 8 = b.place // 8 GROUP BY ALL
), steps AS (
  SELECT l.tree, l.place, row_number() OVER (PARTITION BY l.tree, l.place ORDER BY s.stage, s.level) AS k, s.before, s.behind
  FROM l JOIN sides s ON CASE s.stage WHEN 0 THEN s.tree = l.tree AND s.place = l.place // (8 ** s.level)::BIGINT ELSE s.place = l.tree // (8 ** s.level)::BIGINT END
), folds AS (
  SELECT tree, place, 0 AS k, coalesce(other, leaf) AS h, '' AS proof FROM l
  UNION ALL
  SELECT f.tree, f.place, s.k, sha256(s.before || f.h || s.behind), f.proof || s.before || s.behind FROM folds f JOIN steps s ON f.tree = s.tree AND f.place = s.place AND s.k = f.k + 1
), tried AS (
  SELECT tree, place, arg_max(h, k) AS folded_root, arg_max(proof, k) AS proof FROM folds GROUP BY tree, place
), top AS (SELECT h AS root FROM upper_tree WHERE width = 1)
SELECT doc_id, leaf, subroots.h AS subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN tried USING (tree, place) JOIN subroots USING (tree), top
"""


ORACLE_SQL: dict[str, str] = {
    "op6_tool_calls": r"""
WITH c AS (
  SELECT conv_id, conv_id || ':' || turn AS call_id, turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, text FROM conversations WHERE role = 'user'
), o AS (
  -- Calls whose earlier call is missing start a chain; a chain's calls are two turns apart.
  SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain FROM c
), l AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, chain ORDER BY turn) - 1 AS level, CASE WHEN words > 20 THEN 'discuss' ELSE 'answer' END AS name FROM o
), r AS (
  SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, turn AS result_turn, text AS content FROM conversations WHERE role = 'assistant'
), j AS (
  SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.call_id, r.call_id) AS call_id, level, name, words, turn, text, content, coalesce(turn, result_turn) AS own_turn, NULL AS role,
         CASE WHEN l.call_id IS NULL THEN 'orphan_result' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status
  FROM l FULL JOIN r ON l.call_id = r.call_id
  UNION ALL
  SELECT conv_id, NULL, NULL, NULL, NULL, NULL, text, NULL, turn, role, 'message' FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own_turn) - 1 AS position, CASE WHEN status IN ('orphan_result', 'message') THEN '' ELSE
    concat_ws(';', CASE WHEN text = '' THEN '$.text: minLength' END, CASE WHEN words > CASE name WHEN 'discuss' THEN 60 ELSE 40 END THEN '$.words: maximum' END) END AS errors
  FROM j
)
SELECT conv_id, position, call_id, level, name, status, errors = '' AND status <> 'orphan_result' AS valid, errors,
       CASE WHEN status = 'message' THEN '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"status":"message"}'
       ELSE '{"arguments":' || CASE WHEN status = 'orphan_result' THEN 'null' ELSE '{"text":' || to_json(text)::VARCHAR || ',"turn":' || turn || ',"words":' || words || '}' END
       || ',"id":"' || call_id || '","level":' || coalesce(level::VARCHAR, 'null') || ',"name":' || coalesce('"' || name || '"', 'null')
       || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}' END AS message
FROM e
""",
    "op7_warc": """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::BIGINT AS bytes FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE bytes >= 100 GROUP BY digest)
SELECT page_id, bytes AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
""",
    "op9_licenses": _license_sql(),
    "op11_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.n, a.vec_id AS anchor_id, b.vec_id, b.n AS m, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.n <> b.n WHERE a.vec_id % 100 = 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id, m) AS k FROM s WHERE same QUALIFY k <= 5
), r AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.n, p.k ORDER BY s.score DESC, s.vec_id, s.m)::INTEGER AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.n = s.n AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT * FROM r WHERE rank <= 10
""",
    "op13_merkle": _merkle_sql(),
    "op3_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':17'), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank,
         (sum(sum(size)) OVER ())::BIGINT AS budget
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight, source_size * 3 AS cap FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w
), f AS (
  SELECT arg_min(level, struct_pack(r := cap / weight, k := rank)) AS fill FROM l WHERE level * weight <= cap
), t AS (
  SELECT source, rank, source_size, budget, least(cap::DOUBLE, coalesce(fill * weight, cap::DOUBLE)) AS target FROM w, f
), q AS (
  SELECT d.*, t.rank, t.source_size, t.budget, t.target,
         (sum(d.size) OVER (PARTITION BY t.rank ORDER BY h, doc_id))::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT q.*, e, (source_size * e + upto)::DOUBLE / target AS finish FROM q, range(3) AS r(e) WHERE size > 0 AND target > 0
), o AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, h, doc_id) AS words FROM c
), k AS (
  SELECT doc_id, source, size, h, max(n) AS copies FROM (
    SELECT doc_id, source, size, h, e, count(*) OVER (PARTITION BY doc_id, source, size, e) AS same,
           count(*) OVER (PARTITION BY doc_id, source, size) / count(*) OVER (PARTITION BY doc_id, source, size, e) AS n
    FROM o WHERE words <= budget) GROUP BY doc_id, source, size, h
)
SELECT q.doc_id, q.size, q.source_size, q.target, q.size * coalesce(k.copies, 0)::BIGINT AS taken, q.source, coalesce(k.copies, 0)::INTEGER AS copies
FROM q LEFT JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.source IS NOT DISTINCT FROM k.source AND q.size = k.size
""",
}
