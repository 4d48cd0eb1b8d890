"""Hard negatives, byte-level BPE and the Merkle manifest against brute force; cases that earlier operators failed."""

import base64
import hashlib
import os
import random
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_operators import DOCS, fixture

from flowseries.llm import byte_bpe, hard_negatives, merkle, near_copies, pii, queries, sentencepiece_codec, simhash, tool_calls, warc

VECTORS = "vec_id long, label int, embedding array<float>"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# Hard negatives


def brute_negatives(rows, positives=5, negatives=10):
    kept = []
    for i, (vec_id, label, x) in enumerate(rows):
        if label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((i, vec_id, label, [int(np.floor(256 * float(np.float32(c)))) for c in x]))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    out = []
    for i, anchor, label, x in kept:
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(a * b for a, b in zip(x, y)), v, j, k) for j, v, k, y in kept if j != i]
        for p, positive, _, _ in sorted((s for s in scored if s[3] == label), key=order)[:positives]:
            found = sorted((s for s in scored if s[3] != label and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:negatives]
            out += [(anchor, positive, n, v, p, s) for n, (s, v, _, _) in enumerate(found, 1)]
    return sorted(out, key=repr)


def vectors(seed=1, n=400):
    r = random.Random(seed)
    one = [r.gauss(0, 0.2) for _ in range(6)]
    rows = [(i, r.randrange(4), one if r.random() < 0.3 else [r.gauss(0.05, 0.2) for _ in range(6)]) for i in range(n)]
    rows += [(100, 1, one), (100, 1, one), (None, 2, one), (7, None, one), (200, 1, None), (300, 2, [1.0, None]), (300, 2, [float("nan")] * 6), (301, 2, [float("inf")] * 6)]
    return [*rows, (400, 3, []), (500, 3, [0.5] * 9), (501, 3, [0.25] * 2), (600, 0, [3e4] * 6), (601, 0, [2e4] * 6), (602, 1, [1e4] * 6)]


def test_hard_negatives(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({"_row": F.lit("clash"), "score": F.lit(1)})
    found = hard_negatives.mine_embeddings(df).collect()
    want = brute_negatives(rows)
    assert sorted(map(tuple, found), key=repr) == want and len(want) > 100


def test_hard_negatives_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 1)
    rows = [(i * 20, *x[1:]) for i, x in enumerate(vectors(2, 250))]
    found = hard_negatives.mine_embeddings(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, found), key=repr) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine_embeddings(spark.createDataFrame([], VECTORS)).collect() == []
    assert hard_negatives.mine_embeddings(spark.createDataFrame([(1, 1, [1.0])], VECTORS)).collect() == []
    assert hard_negatives.mine_embeddings(spark.createDataFrame([(100, 1, [1.0]), (101, 2, [1.0])], VECTORS)).collect() == []


@pytest.mark.parametrize("size", [1, 200, 5_000, 1 << 24, 1 << 40])
def test_packed_products(size):
    g = np.random.default_rng(size)
    a, r = g.integers(-size, size, (7, 33)), g.integers(-size, size // 2 + 1, (50, 33))
    r[3] *= 5
    want = np.clip(a.astype(object) @ r.T.astype(object), -(1 << 55), 1 << 55)
    assert (hard_negatives.products(a, r) == want).all()


# Byte-level BPE


def library():
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    r = random.Random(5)
    pieces = ["don't", "we'll", "'s", "'", "''re", "  ", "\n\n ", "\t", " ", "  x", "été", "日本語", "1234", "!?", "...", "<|endoftext|>", "\x1c", " ", "🙂", "a" * 40, " " * 30, "x'", "͸", "é", "\u0000", "ﬁ"]
    texts = ["".join(r.choice(pieces) + r.choice(["", "", " ", "word"]) for _ in range(r.randrange(120))) for _ in range(150)]
    return [*texts, "a" * 500, " " * 300 + "x", "'" * 300, "no", "", "é" * 90 + " " + "b" * 90, "word " * 100]


@pytest.mark.parametrize(("chunk", "overlap"), [(41, 20), (64, 10), (1000, 50)])
def test_chunks_meet_in_the_library_s_ids(spark, chunk, overlap):
    texts, encoding = hard_texts(), library()
    df = spark.createDataFrame([(i, t, f"k{i}") for i, t in enumerate(texts)], "doc_id long, text string, _key string")
    ranks = byte_bpe.load_ranks(spark)
    tokens = byte_bpe.decode(byte_bpe.encode(df, ranks, chunk=chunk, overlap=overlap), ranks)
    found = {r.doc_id: r for r in tokens.collect()}
    assert sorted(found) == list(range(len(texts)))
    for i, t in enumerate(texts):
        assert found[i].token_ids == encoding.encode_ordinary(t) and found[i].decoded == t.encode() and found[i]._key == f"k{i}"


def test_token_digest(spark):
    rows = [*fixture(), fixture()[0], (None, "no id", "en", None, 5)]
    encoding = library()
    found = byte_bpe.token_digest(spark.createDataFrame(rows, DOCS).withColumn("token_ids", F.lit(1)), byte_bpe.load_ranks(spark), chunk=5000, overlap=400).collect()
    ids = {t: encoding.encode_ordinary(t or "") for _, t, *_ in rows}
    want = [(i, len(ids[t]), sha(" ".join(map(str, ids[t]))), sha(t or "")) for i, t, *_ in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert byte_bpe.token_digest(spark.createDataFrame([], DOCS), byte_bpe.load_ranks(spark)).collect() == []


# Merkle manifest


def brute_manifest(rows):
    def leaf(*fields):
        return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    def lower(text):
        return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)

    def climb(hashes):
        """Root and, for each hash, its runs' others as (before, behind)."""
        sides, at = [[] for _ in hashes], list(range(len(hashes)))
        while len(hashes) > 1:
            for i, p in enumerate(at):
                run = hashes[p // 8 * 8 : p // 8 * 8 + 8]
                sides[i].append((run[: p % 8], run[p % 8 + 1 :]))
                at[i] = p // 8
            hashes = [sha("".join(hashes[k : k + 8])) for k in range(0, len(hashes), 8)]
        return hashes[0], sides

    trees = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        own = leaf(doc_id, source, lang, n, text)
        other = leaf(doc_id, source, lang, n, lower(text)) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else None
        trees[lang].append((doc_id is not None, doc_id or 0, own, doc_id, other))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: x[:3])
    below = {k: climb([x[2] for x in trees[k]]) for k in order}
    root, above = climb([below[k][0] for k in order]) if order else (None, [])
    out = []
    for k, over in zip(order, above):
        for (_, _, own, doc_id, other), sides in zip(trees[k], below[k][1]):
            folded = other or own
            for before, behind in sides + over:
                folded = sha("".join([*before, folded, *behind]))
            out.append((doc_id, own, below[k][0], root, sha("".join(h for a, b in sides + over for h in a + b)), folded, folded == root))
    return sorted(out, key=repr)


def many(seed, n):
    r = random.Random(seed)
    langs = [None, "", "de", "en", "en", "en", "en", "fr", "é", "zz", *(f"l{i}" for i in range(12))]
    return [(r.choice([None, *range(n)]), r.choice([None, "", "Text ABC", f"é{i} Q"]), r.choice(langs), r.choice([None, "s:1"]), r.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize(("n", "block_levels"), [(700, 0), (700, 1), (90, 2), (1400, 3)])
def test_manifest_proofs_by_exchange(spark, n, block_levels):
    rows = many(n, n) + [(5, "Same", "en", None, 1)] * (n // 2)
    found = merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(7).withColumn("_key", F.lit("clash")), carry={"other": merkle.tampered_leaf()}, block_levels=block_levels)
    folded = merkle.fold(F.coalesce("other", "leaf"), F.col("proof"))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(merkle.siblings(F.col("proof")), ""), 256), folded, folded == F.col("root"))
    assert sorted(map(tuple, out.collect()), key=repr) == brute_manifest(rows)
    assert found.filter(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty()


@pytest.mark.parametrize("n", [0, 1, 2, 9])
def test_small_manifests(spark, n):
    rows = [(i, "Some TEXT", "en", None, None) for i in range(n)]
    assert sorted(map(tuple, merkle.manifest_digest(spark.createDataFrame(rows, DOCS)).collect()), key=repr) == brute_manifest(rows)


# What earlier operators had wrong


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)


A, B = "one two three four five six seven eight nine ten", "other words of no text that anything else here is like at all"


@pytest.mark.parametrize(("rows", "left"), [([(3, A), (None, A)], [(3, A)]), ([(3, A), (None, A), (None, B)], [(3, A), (None, B)]), ([(3, A), (5, A), (5, B)], [(3, A), (5, B)])])
def test_one_of_each_goes_by_row(spark, rows, left):
    for one_of_each in (near_copies.one_of_each, simhash.one_of_each):
        assert sorted(((r.doc_id, r.text) for r in one_of_each(rows_of(spark, rows)).collect()), key=repr) == sorted(left, key=repr)


def test_ibans_beside_other_words(spark):
    cases = {
        "Pay IBAN DE89370400440532013000 EUR 100 now": "iban:9:31", "GB82 WEST 1234 5698 7654 32 UK": "iban:0:27", "DE8937040044053201300 0 and DE8937040044053201": "iban:0:23",
        "IBAN NO9386011117947 OK": "iban:5:20", "XDE89370400440532013000": "", "DE89370400440532013000X": "", "DE88370400440532013000": "",
    }
    found = {r.text: r.spans for r in rows_of(spark, enumerate(cases)).select("text").withColumn("spans", pii._listed(F.filter(pii.pii_spans(F.col("text")), lambda s: s["kind"] == "iban"))).collect()}
    assert found == cases


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 16_384, 16_385, 40_000])
def test_running_totals_of_an_array(spark, n):
    df = spark.range(1).withColumn("v", F.sequence(F.lit(1), F.lit(n)).cast("array<int>") if n else F.array().cast("array<int>"))
    found = df.select(pii._running(F.col("v"), lambda a, v: a + v)).first()[0]
    assert found == [k * (k + 1) // 2 for k in range(n + 1)]


def test_spans_of_a_long_list(spark):
    addresses = [f"ü{i}@mail{i % 7}.org" for i in range(9_000)]
    text = "🙂 " + ", ".join(addresses) + " 10.0.0.1@x.yz +49 555 123 4567 end"
    out = pii.redact(rows_of(spark, [(1, text)])).first()
    assert out.text == "🙂 " + ", ".join(["ü<EMAIL>"] * 9_000) + " <EMAIL> <PHONE> end" and out.n_chars == len(out.text)


def test_lengths_that_no_payload_has():
    block = lambda n: b"HTTP/1.1 200 OK\r\nContent-Length: " + n + b"\r\n\r\nabc"
    head = {"warc-type": "response", "content-type": "application/http"}
    for n in (b"9" * 23, b"9" * 5000, b"1" + b"0" * 18):
        found = warc.read_record(head, block(n))
        assert found["error"] and found["payload_bytes"] == 3
    assert warc.read_record(head, block(b"0" * 30 + b"3"))["error"] is None and warc.read_record(head, block(b"4"))["error"]


FOREIGN = """
import sys
sys.path[:0] = [{root!r}]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config(map={{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}}).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def importable(_):
    import importlib.util
    return [importlib.util.find_spec("flowseries") is not None]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect() == [False]
from flowseries.llm import queries
for name in {names!r}:
    assert queries.QUERIES[name](spark, {sf!r}).count() > 0, name
print("all ran")
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    root, sf = str(Path(__file__).resolve().parents[2]), os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    script = FOREIGN.format(root=root, sf=sf, names=sorted(n for n in queries.QUERIES if n != "op13_merkle"))
    (tmp_path / "run.py").write_text(script)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900, check=False)
    assert "all ran" in done.stdout, done.stderr[-3000:]


TREE = {"$ref": "#/$defs/node", "$defs": {"node": {"type": "object", "properties": {"next": {"$ref": "#/$defs/node"}, "n": {"exclusiveMinimum": 0}}, "additionalProperties": {"type": "string"}}}}


@pytest.mark.parametrize(
    ("value", "schema", "errors"),
    [
        ("abc", {"pattern": "^b"}, ["$: pattern"]), ("abc", {"pattern": "b"}, []), (3, {"anyOf": [{"type": "string"}, {"minimum": 4}]}, ["$: anyOf"]), (5, {"anyOf": [{"type": "string"}, {"minimum": 4}]}, []),
        (5, {"allOf": [{"minimum": 6}, {"maximum": 4}]}, ["$: minimum", "$: maximum"]), (5, {"oneOf": [{"minimum": 1}, {"maximum": 9}]}, ["$: oneOf"]), (5, {"not": {"const": 5.0}}, ["$: not"]),
        ([1, True, 1.0], {"uniqueItems": True}, ["$: uniqueItems"]), ([1, True, "1"], {"uniqueItems": True}, []), (5, {"exclusiveMaximum": 5}, ["$: exclusiveMaximum"]), (0.3, {"multipleOf": 0.1}, []), (7, {"multipleOf": 2}, ["$: multipleOf"]),
        ({"n": 1, "next": {"n": 0, "x": 1}}, TREE, ["$.next.n: exclusiveMinimum", "$.next.x: type"]), ({"a1": 1, "b": 2}, {"patternProperties": {"^a": {"type": "string"}}, "additionalProperties": False}, ["$.a1: type", "$.b: additionalProperties"]),
        ({"a": 1}, {"minProperties": 2, "dependentRequired": {"a": ["b"]}, "propertyNames": {"maxLength": 0}}, ["$.b: dependentRequired", "$.a: propertyNames", "$: minProperties"]), ([1, "x", 2], {"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}, ["$[2]: type"]),
        ([1], {"contains": {"type": "string"}}, ["$: contains"]), (1, {"if": {"type": "integer"}, "then": {"minimum": 2}, "else": False}, ["$: minimum"]), (1, False, ["$: false"]), (1, {"enum": [True, "1"]}, ["$: enum"]),
    ],
)
def test_schema_rules(value, schema, errors):
    tool_calls.check_schema(schema)
    assert tool_calls.schema_errors(value, schema) == errors


@pytest.mark.parametrize("schema", [{"minimun": 1}, {"properties": {"a": {"unevaluatedItems": False}}}, {"$ref": "#/$defs/none"}, {"$ref": "other.json"}, {"anyOf": [3]}])
def test_schemas_that_are_not_understood_fail(spark, schema):
    calls = spark.createDataFrame([], "conv_id long, call_id string, name string, arguments string")
    with pytest.raises(ValueError):
        tool_calls.link(calls, spark.createDataFrame([], "conv_id long, call_id string, content string"), {"f": schema})


def test_one_form_for_each_number():
    forms = [("1", "1.0", "1e0", "10E-1"), ("100", "1e2", "100.00"), ("0", "-0.0"), ("0.5", "5e-1"), ("[100000000000000000000,{}]", "[1e20, {}]")]
    for same in forms:
        assert {tool_calls.canonical(tool_calls.parsed(x)) for x in same} == {same[0]}


def test_words_are_encoded_many_a_call(monkeypatch):
    if not os.path.isfile(sentencepiece_codec.MODEL):
        pytest.skip("no model file")
    with open(sentencepiece_codec.MODEL, "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    calls = []
    encoded = sentencepiece_codec.Codec._encoded
    monkeypatch.setattr(sentencepiece_codec.Codec, "_encoded", staticmethod(lambda tokenizer, texts: calls.append(len(texts)) or encoded(tokenizer, texts)))
    texts = [f"word{i} and  w{i * 7}  é{i} " for i in range(900)]
    assert [x.tolist() for x in codec._by_words(texts)] == codec.library_ids(texts)
    assert max(calls) > 5 and sum(n > 1 for n in calls) <= 3
