"""Null, repeated and text ids in the operators that cut a table into ranges, and many sources."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash

from flowseries.llm import mixing, syncmers
from flowseries.llm.ranges import running_totals


def text_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def edited(rows):
    """Digests of the edited texts by (id, text), in the operator's order."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or type(rows[0][0])(), text_hash(r[1]), r[1]), reverse=True)
    out = Counter()
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        text = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        out[i, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_hot_ids(spark, kind):
    r = random.Random(3)
    own = int if kind == "long" else lambda i: f"d{i:05d}"
    ids = [own(i) for i in range(1, 300)] + [own(150)] * 200 + [None] * 200
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.randrange(12)))) for i in ids]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert Counter((x.doc_id, x.edited_sha256) for x in syncmers.edited_half(df).collect()) == edited(rows)
        place, every, single = syncmers._ranges(df.selectExpr("doc_id", "text", "xxhash64(text) AS h"))
        held = Counter(x[0] for x in df.selectExpr("doc_id", "text", "xxhash64(text) AS h").select(place).collect())
        assert set(held) <= set(every) and len(single) > 2 and max(held.values()) <= len(rows) / 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_all_anchors(spark):
    r = random.Random(5)
    words = [f"w{r.randrange(900)}" for _ in range(600)]
    rows = [(" ".join(words), " ".join(words[:300] + [f"v{i}" for i in range(300)])), ("", "a"), ("日本語", "日本語")]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = (syncmers.fingerprint(df[c], None) for c in "ab")
    for x in df.select(a.alias("a"), b.alias("b"), syncmers.likeness(a, b, None).alias("s"), syncmers.fingerprint(df["a"]).alias("few")).collect():
        one, two = ({f[i : i + 8] for i in range(0, len(f), 8)} for f in (x.a, x.b))
        assert x.s == pytest.approx(2 * len(one & two) / (len(one) + len(two)) if one or two else 1.0)
        assert x.few == x.a[: 8 * syncmers.SKETCH]


def test_many_sources(spark):
    rows = [(i, "w " * (i % 5), None if i % 97 == 0 else f"site{i % 400}") for i in range(2000)]
    got = mixing.source_targets(spark.createDataFrame([(i, s, len(t.split())) for i, t, s in rows], "doc_id long, source string, size long")).collect()
    names = sorted({s for _, _, s in rows if s}) + [None]
    assert {x.source: x["rank"] for x in got} == {s: k + 1 for k, s in enumerate(names)}
    assert sum(x.target for x in got) == pytest.approx(sum(i % 5 for i, _, _ in rows))
    assert all(x.target <= 3 * x.source_size for x in got)
    level = {round(x.target / (1, 2, 3)[(x["rank"] - 1) % 3], 6) for x in got if x.target < 3 * x.source_size}
    assert len(level) == 1


def test_repeated_and_null_ids_in_a_mix(spark):
    rows = [(None if i % 3 == 0 else i % 50, "w " * (i % 4), ("a", "b", None)[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(x.taken in (0, x["size"], 2 * x["size"], 3 * x["size"]) for x in got)
    assert len({(x.source, x.doc_id, x.copies) for x in got if x["size"]}) == len({(x.source, x.doc_id) for x in got if x["size"]})


def test_running_totals(spark):
    rows = [(None if i % 11 == 0 else f"k{i % 37:02d}", i % 3, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, v long")
    key = lambda r: (r[0] is not None, r[0] or "", r[1])
    want = Counter((*r, sum(x[2] for x in rows if key(x) <= key(r))) for r in rows)
    assert Counter(map(tuple, running_totals(df, "k", ["t"], {"s": "v"}).collect())) == want
