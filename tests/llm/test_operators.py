"""Each operator against a brute-force version on a small fixture with nulls, empty, long and repeated texts."""

import hashlib
import json
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowseries.llm import license_rules, mixing, pii, quality_knn, quality_rules, sentencepiece_codec, simhash, syncmers, tool_calls, warc
from flowseries.llm.scratch import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = sentencepiece_codec.MODEL
needs_model = pytest.mark.skipif(not os.path.isfile(MODEL), reason="no model file")
WORDS = "the of and to in a is that for it quick brown fox jumps over lazy dog server mail data letters number garden house river".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", str(r.randrange(50))]) for _ in range(n))


def fixture():
    base = prose(1, 300)
    texts = [
        base, base, base.replace("fox", "cat", 1), base + " end", prose(2, 400), "", None, "one", "one two", "  \t\n ", "x" * 70_000, prose(3, 60).upper(),
        "Released under the MIT License.\nplain", "mail a@b.example.org or +1 (555) 010-9999, 4111 1111 1111 1111, 10.0.0.300 and 10.0.0.3", "Und " * 80, prose(4, 20_000), "日本語のテキストです。" * 30, "é à " * 40, "\x01a@b.co\x01",
    ]
    return [(i, t, ["en", "de", None, "xx"][i % 4], ["s2", "s1", None, "Ü", "s1"][i % 5], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), DOCS)


@pytest.fixture(scope="module")
def awkward(spark, docs):
    """Repeated rows, a null id, and columns that clash with names that operators use."""
    more = spark.createDataFrame([fixture()[0], fixture()[4], (None, "no id", "en", None, 5)], DOCS)
    return docs.unionByName(more).withColumns({c: F.lit("clash") for c in ("fp", "size", "pii", "kept", "_bucket", "target", "root", "raw", "id", "_id", "words", "copies", "kept_id", "token_ids", "licences", "result", "decoded")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


# Fingerprints


def edited_texts(rows):
    ordered = [t or "" for _, t in sorted(rows, reverse=True)]
    ids = sorted((i for i, _ in rows), reverse=True)
    out = {}
    for k, i in enumerate(ids):
        t, following = ordered[k], ordered[(k + 1) % len(ordered)]
        out[i] = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
    return out


def brute_sketch(text):
    """Closed syncmers by Python's own loops over the same token hashes."""
    def xx(*values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v % (1 << 64)).to_bytes(8, "little"), h)
        return h - (1 << 64) if h >= 1 << 63 else h

    tokens = []
    for w in SPACE.findall(text):
        tokens += re.findall(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]|[^฀-໿က-႟ក-៿぀-ヿ㐀-鿿]{1,16}", w)
    h = [xx(t) for t in tokens]
    k = syncmers.K
    if len(h) < k:
        total = 0
        for x in h:
            total = xx(total, x)
        found = [total] if h else []
    else:
        kmers = [(h[i : i + k], xx(*h[i : i + k])) for i in range(len(h) - k + 1)]
        found = [v for w, v in kmers if min(w[0], w[-1]) <= min(w[1:-1])] or [v for _, v in kmers]
    return "".join(f"{x:08x}" for x in sorted({(v % (1 << 64)) >> 32 for v in found})[: syncmers.SKETCH])


def brute_likeness(a, b):
    x, y = ({f[i : i + 8] for i in range(0, len(f), 8)} for f in (a, b))
    united = sorted(x | y)[: syncmers.SKETCH]
    if not united:
        return 1.0
    j = len(set(united) & x & y) / len(united)
    return 2 * j / (1 + j)


def test_fingerprints(spark, docs):
    rows = {r.doc_id: r for r in syncmers.edited_half(docs).collect()}
    texts = {r[0]: r[1] or "" for r in fixture()}
    edited = edited_texts([(i, t) for i, t in texts.items()])
    assert len(rows) == len(texts)
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        r, following = rows[i], ids[(k + 1) % len(ids)]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest()
        assert r.fingerprint == brute_sketch(texts[i]) and r.edited_fingerprint == brute_sketch(edited[i])
        assert r.near_edited == pytest.approx(brute_likeness(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(brute_likeness(r.fingerprint, rows[following].fingerprint))
    assert rows[0].fingerprint == rows[1].fingerprint and rows[1].near_next > 0.7
    assert syncmers.edited_half(empty(spark)).count() == 0


def test_fingerprints_by_any_number_of_ranges(spark, docs, awkward):
    want = sorted(map(tuple, syncmers.edited_half(docs).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "19"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(map(tuple, syncmers.edited_half(docs).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert syncmers.edited_half(awkward).count() == awkward.count()


def test_anchors_are_context_free(spark):
    passage = prose(9, 40)
    df = spark.createDataFrame([(1, passage), (2, prose(10, 30) + " " + passage + " " + prose(11, 30))], "doc_id long, text string")
    found = defaultdict(dict)
    for r in syncmers.anchors(df).collect():
        found[r.doc_id][r.position] = r.hash
    assert all(found[2].get(p + 30) == h for p, h in found[1].items()) and found[1]


# SimHash


def brute_simhash(text):
    words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    names = sorted(root)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    return {f: find(f) for f in names}


def test_simhash(spark, docs):
    fps = {r[0]: brute_simhash(r[1]) for r in fixture()}
    groups = brute_components(fps.values())
    smallest = {}
    for i in sorted(fps):
        smallest.setdefault(groups[fps[i]], i)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f, smallest[groups[f]]) for i, f in fps.items()}
    assert got[1][1] == 0 and got[9][1] == 5 and got[6][1] == 5
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(set(smallest.values()))


def test_simhash_of_awkward_tables(spark, awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert Counter(r.doc_id for r in rows)[0] == 2 and len(rows) == awkward.count()
    assert simhash.one_of_each(awkward).columns == awkward.columns
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.one_of_each(empty(spark)).count() == 0


@pytest.mark.parametrize("bucket_pairs", [64, 1])
def test_links_of_dense_groups(spark, bucket_pairs):
    """Balls, chains and noise; with every bucket small and with every bucket large."""
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(50)}
    for center in list(fps)[:3]:
        fps |= {center ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)}
    chain = r.getrandbits(64)
    for _ in range(40):
        chain ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
        fps.add(chain)
    signed = [(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps]
    found = {x.node % (1 << 64): x.root % (1 << 64) for x in simhash.components(simhash.links(simhash.pivot_table(spark.createDataFrame(signed, "fp long")), bucket_pairs)).collect()}
    want = brute_components(fps)
    together = lambda m: sorted(sorted(g) for g in _groups({f: m.get(f, f) for f in fps}))
    assert together(found) == together(want)


def test_pairs_come_from_the_pivot_table(spark):
    """Every near pair shares a cell, far ones are discarded by the table, and without it nothing is proposed."""
    r = random.Random(15)
    base = [r.getrandbits(64) for _ in range(400)]
    fps = set(base)
    for f in base[:120]:
        fps.add(f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
        for _ in range(2):  # three blocks alike, many bits apart: proposed, then discarded
            fps.add(f ^ (r.getrandbits(64) & (simhash.BLOCKS[0] | simhash.BLOCKS[3])))
    table = simhash.pivot_table(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")).cache()
    want = {tuple(sorted((simhash._signed(a), simhash._signed(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    assert {(x.a, x.b) for x in simhash.links(table).collect()} == want and len(want) > 100
    n = simhash.proposal_counts(table).first()
    assert n.proposed > n.verified == len(want) and n.discarded > 0.9 * (n.proposed - n.verified)
    assert n.proposed < 3 * len(fps)
    assert simhash.links(table.filter("false")).count() == 0
    blind = table.withColumn("pivots", F.transform("pivots", lambda x: (x * 0).cast("tinyint")))
    assert simhash.proposal_counts(blind, 10**6).first().proposed == len(fps) * (len(fps) - 1) // 2  # the cells do the choosing
    emptied = table.withColumn("pivots", F.array().cast("array<tinyint>"))
    with pytest.raises(PySparkException):
        simhash.links(emptied).count()


def _groups(of):
    out = defaultdict(list)
    for f, g in of.items():
        out[g].append(f)
    return out.values()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


# Mixing


def brute_mix(rows, seed=17):
    sizes = [(i, s, len(SPACE.findall(t or ""))) for i, t, s in rows]
    sources = sorted({s for _, s, _ in sizes}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for _, x, n in sizes if x == s) for s in sources}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sources)}
    total, capped = sum(own.values()), set()
    while True:
        rest = [s for s in sources if s not in capped]
        level = (total - sum(3 * own[s] for s in capped)) / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if level * weight[s] > 3 * own[s]}
        if not over:
            break
        capped |= over
    target = {s: 3.0 * own[s] if s in capped else level * weight[s] for s in sources}
    key = lambda i: int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:15], 16)
    copies = []
    for rank, s in enumerate(sources):
        upto = 0
        for _, i, n in sorted((key(i), i, n) for i, x, n in sizes if x == s):
            upto += n
            if n and target[s]:
                copies += [((e * own[s] + upto) / target[s], rank, key(i), i, n) for e in range(3)]
    taken, words = Counter(), 0
    for *_, i, n in sorted(copies):
        words += n
        if words > total:
            break
        taken[i] += n
    return {i: (n, own[s], target[s], taken[i]) for i, s, n in sizes}


def test_mixing(spark, docs):
    want = brute_mix([(r[0], r[1], r[3]) for r in fixture()])
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(docs).collect()}
    assert got.keys() == want.keys()
    for i, (n, own, target, taken) in want.items():
        assert got[i][:2] == (n, own) and got[i][2] == pytest.approx(target) and got[i][3] == taken
    copies = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert copies == Counter({i: t // n for i, (n, _, _, t) in want.items() if t})


def test_mixing_near_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), f"s{0 if i % 3 else i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max("copies").alias("c"), F.max("source_size").alias("s")).collect()
    assert all(abs(r.n - r.t) <= 8 and r.c <= 3 and r.t <= 3 * r.s for r in got)


def test_mixing_of_awkward_tables(spark, awkward):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count() and sorted(rows, key=str) == sorted(mixing.mix(awkward).collect(), key=str)
    assert len({r.taken for r in rows if r.doc_id == 0}) == 1
    assert mixing.mixed_documents(awkward).columns == awkward.columns
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(none).collect()] == [(0.0, 0), (0.0, 0)]


# SentencePiece


@needs_model
def test_sentencepiece(spark, docs):
    import sentencepiece

    model = sentencepiece_codec.load_model(spark)
    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    odd = ["<s> </s> <unk>", "▁x▁▁y", "a\n\nb\t c", "<0x0A>", "   ", "😀 é́", "a" * 300]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd, 100)), "doc_id long, text string"))
    rows = sentencepiece_codec.encode(df, model).collect()
    assert all(r.token_ids == own.encode(r.text or "") and r.round_trip for r in rows)
    back = {r.doc_id: r.decoded for r in sentencepiece_codec.decode(sentencepiece_codec.encode(df, model).select("doc_id", "token_ids"), model).collect()}
    assert all(back[r.doc_id] == (r.text or "").replace("▁", " ") for r in rows)
    digests = {r.doc_id: r for r in sentencepiece_codec.token_digest(df, model).collect()}
    for r in rows:
        raw = b"".join(i.to_bytes(4, "little") for i in r.token_ids)
        assert digests[r.doc_id].ids_sha256 == hashlib.sha256(raw).hexdigest() and digests[r.doc_id].n_tokens == len(r.token_ids)


@needs_model
def test_sentencepiece_of_awkward_tables(spark, awkward):
    model = sentencepiece_codec.load_model(spark)
    assert sentencepiece_codec.encode(awkward, model).columns == [*awkward.drop("token_ids").columns, "token_ids", "round_trip"]
    assert sentencepiece_codec.encode(awkward, model).count() == awkward.count()
    assert sentencepiece_codec.encode(empty(spark), model).count() == 0


def test_unigram_model():
    """A unigram model is rebuilt from scores; normalising trims spaces."""
    from flowseries.llm.sentencepiece_codec import CONTROL, NORMAL, UNKNOWN, Model, build_tokenizer

    pieces = ["<unk>", "<s>", "▁a", "b", "ab", "▁", "a", "▁ab"]
    m = Model(pieces, [0, 0, -2.0, -3.0, -2.5, -1.5, -3.0, -6.0], [UNKNOWN, CONTROL] + [NORMAL] * 6)
    t = build_tokenizer(m)
    assert t.encode("  a  b ", add_special_tokens=False).tokens == ["▁a", "▁", "b"]
    assert t.decode(t.encode("a b", add_special_tokens=False).ids) == "a b"


def test_model_file_is_checked():
    with pytest.raises((ValueError, IndexError)):
        sentencepiece_codec.Model.parse(b"\xff\xff\xff\xff\xff\x0f\x03")


# Quality classifier


def test_classifier(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.6
        text = prose(i, r.randrange(20, 200))
        rows.append((i, text if good else re.sub(r"(\w) ", r"\1### ", text) if i % 2 else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_knn.fit(df, known, max_labelled=200)
    out = {x.doc_id: x for x in quality_knn.score(df, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, x in out.items() if x.held_out} == set(held)
    assert sum(out[i].predicted == dict(labels)[i] for i in held) / len(held) > 0.97
    flipped = known.withColumn("quality", F.when(quality_knn.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {x.doc_id: x.score for x in quality_knn.score(df, quality_knn.fit(df, flipped, max_labelled=200)).collect()}
    assert all(abs(again[i] - out[i].score) < 1e-9 for i in out)  # held-out labels play no part


def test_votes_are_exact_neighbours():
    import numpy as np

    r = np.random.default_rng(1)
    vectors = quality_knn._unit(r.normal(size=(300, 8)).astype(np.float32))
    model = quality_knn.KnnModel(np.ones(quality_knn.N_TERMS, np.float32), r.normal(size=(quality_knn.N_TERMS, 8)).astype(np.float32), vectors, r.integers(0, 2, 300).astype(np.float32), 15, 4.0)
    counts = r.poisson(1, size=(50, quality_knn.N_TERMS)).astype(np.float32)
    got = quality_knn.vote(counts, model)
    x = quality_knn._unit(quality_knn._weighted(counts, model.idf) @ model.axes)
    for v, s in zip(x, got, strict=True):
        cos = sorted(((float(v @ u), float(la)) for u, la in zip(vectors, model.labels, strict=True)), reverse=True)[:15]
        w = [max(c, 0) ** 4 for c, _ in cos]
        assert s == pytest.approx(sum(a * la for a, (_, la) in zip(w, cos, strict=True)) / sum(w), abs=1e-4)


def test_scores_do_not_depend_on_blocks(spark):
    import numpy as np

    texts = [prose(i, 20 + i % 90) + ("###" if i % 3 else "") for i in range(300)] + ["same text here"] * 3
    counts = np.stack([quality_knn.term_counts(t.encode()) for t in texts])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int")
    model = quality_knn.fit(df, labels, max_labelled=120)
    whole = np.concatenate([quality_knn.vote(counts[a : a + 256], model) for a in range(0, len(counts), 256)])
    alone = np.concatenate([quality_knn.vote(counts[i : i + 1], model) for i in range(len(counts))])
    back = np.concatenate([quality_knn.vote(counts[i : i + 7][::-1], model)[::-1] for i in range(0, len(counts), 7)])
    assert (whole == alone).all() and (whole == back).all() and len(set(whole[-3:])) == 1
    assert [r.score for r in quality_knn.score(df, model).orderBy("doc_id").collect()] == whole.tolist()
    # Of voters that are alike the first ones count.
    same = quality_knn.KnnModel(model.idf, model.axes, np.repeat(model.vectors[:1], 40, axis=0), np.array([1.0] * 15 + [0.0] * 25), 15, 4.0)
    assert (quality_knn.vote(counts[:5], same) == 1).all()


def test_words_count_in_the_classifier(spark):
    """Texts of the same shapes and character classes, which only their words tell apart."""
    r = random.Random(8)
    good, bad = (["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(30)] for _ in range(2))
    rows = [(i, " ".join(r.choice(good if i % 2 else bad) for _ in range(60))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_knn.fit(df, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int"))
    out = quality_knn.score(df, model).filter("held_out").collect()
    assert len(out) > 100 and sum(x.predicted == x.doc_id % 2 for x in out) == len(out)


def test_repeated_ids_stay_within_the_sample(spark):
    df = spark.createDataFrame([(1, "one text")] * 500 + [(2, "another text"), (2, "a text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert len(quality_knn.fit(df, labels).labels) <= 2


def test_classifier_of_awkward_tables(spark, awkward):
    labels = spark.createDataFrame([(0, 1), (0, 0), (4, 1), (7, 0), (None, 1), (99, 0)], "doc_id long, quality int")
    for known in (labels, labels.filter("false")):
        rows = quality_knn.score(awkward, quality_knn.fit(awkward, known)).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality_knn.score(empty(spark), quality_knn.fit(empty(spark), labels)).count() == 0


# Tool calls


def test_tool_calls(spark):
    schema = {"type": "object", "properties": {"q": {"type": "string", "maxLength": 3}, "n": {"type": "integer", "minimum": 1}}, "required": ["q"], "additionalProperties": False}
    calls = spark.createDataFrame(
        [(1, "a", None, "f", '{"q":"é","n":2}'), (1, "b", "a", "f", '{"n":0,"x":1}'), (1, "c", "b", "g", "{}"), (1, "d", "gone", "f", "{"), (1, "e", "f", "f", None), (1, "f", "e", "f", '{"q":"long"}'), (1, "a", None, "f", '{"r":"z"}'), (2, None, None, "f", '{"q":"z"}')],
        "conv_id long, call_id string, parent_id string, name string, arguments string",
    )
    results = spark.createDataFrame([(1, "a", "ok"), (1, "z", "lost"), (1, "b", None)], "conv_id long, call_id string, content string")
    rows = tool_calls.link(calls, results, {"f": schema}).collect()
    got = {r.call_id: r for r in rows if r.message[:24] != '{"arguments":{"r":"z"},"'}
    assert len(rows) == 9  # the repeated call is a row of its own
    assert {k: r.status for k, r in got.items()} == {"a": "linked", "b": "linked", "c": "no_result", "d": "no_result", "e": "no_result", "f": "no_result", "z": "orphan_result", None: "no_result"}
    assert {k: r.level for k, r in got.items() if k} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "f": None, "z": None}
    assert got["a"].valid and got["b"].errors == "$.q: required;$.n: minimum;$.x: additionalProperties"
    assert (got["c"].errors, got["d"].errors, got["e"].errors, got["f"].errors) == ("$: no such tool", "$: not JSON", "$: type", "$.q: maxLength")
    assert got["a"].message == '{"arguments":{"n":2,"q":"é"},"id":"a","level":0,"name":"f","result":"ok","status":"linked"}'


def test_tool_call_chains(spark):
    calls = spark.createDataFrame([(i // 100, str(i), str(i - 1) if i % 100 else None) for i in range(300)], "conv_id long, call_id string, parent_id string")
    assert {r.call_id: r.level for r in tool_calls.levels(calls).collect()} == {str(i): i % 100 for i in range(300)}
    empty_calls = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    calls, results, messages = tool_calls.from_turns(empty_calls)
    assert tool_calls.link(calls, results, tool_calls.TOOLS, messages).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (None, 1, "user", "x"), (1, 1, "assistant", None), (1, None, None, "y")], "conv_id long, turn long, role string, text string")
    calls, results, messages = tool_calls.from_turns(odd)
    rows = tool_calls.link(calls, results, tool_calls.TOOLS, messages).collect()
    # The two equal calls share the result; all other turns are rows of their own.
    assert all(json.loads(r.message) for r in rows) and sorted(r.status for r in rows) == ["linked", "linked", "message", "no_result"]


@pytest.mark.parametrize(("value", "schema", "n"), [(1.0, {"type": "integer"}, 0), (True, {"type": "integer"}, 1), (None, {"type": ["null", "string"]}, 0), ([1, "a"], {"items": {"type": "string"}, "minItems": 3}, 2), ("b", {"enum": ["a"]}, 1), (2, {"const": 2, "maximum": 1}, 1)])
def test_schemas(value, schema, n):
    assert len(tool_calls.schema_errors(value, schema)) == n


# WARC


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(8)
    noise = "".join(chr(r.randrange(0x21, 0x2000)) for _ in range(60_000))
    html = ["a" * 100, "a" * 100, "b" * 99, "b" * 99, "", None, noise, noise, "\x1f\x8b\x08" * 500, "é" * 50, "é" * 50, "WARC/1.1\r\n\r\n" * 40]
    return spark.createDataFrame([(50 - i, f"http://x/{i}\n" if i % 3 else None, h) for i, h in enumerate(html)], "page_id long, url string, html string")


@pytest.mark.parametrize("range_bytes", [1 << 23, 997])
def test_warc(spark, pages, range_bytes):
    path = new_path(spark, "warc-test")
    assert warc.write_warc(pages, path) == 12
    records = warc.read_warc(spark, path, range_bytes)
    got = {r.page_id: tuple(r)[1:] for r in warc.page_records(records).collect()}
    by_payload = defaultdict(list)
    source = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    for i, p in source.items():
        by_payload[p].append(i)
    first = lambda p: min(by_payload[p])
    again = lambda i, p: len(p) >= 100 and i != first(p)
    assert records.count() == 12
    assert got == {i: (len(p), hashlib.sha256(p).hexdigest(), "revisit" if again(i, p) else "response", first(p) if again(i, p) else None) for i, p in source.items()}
    payloads = {r.record_id: bytes(r.payload) for r in records.filter("record_type = 'response'").collect()}
    assert all(payloads[f"<urn:page:{i}>"] == p for i, p in source.items() if not again(i, p))


def test_warc_members_are_gzip(spark, pages, tmp_path):
    import gzip

    warc.write_warc(pages, f"file://{tmp_path}/w")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.warc.gz")))
    assert data.count(b"WARC-Type: ") == 12 and not list((tmp_path / "w").glob(".writing*"))


def test_warc_of_awkward_tables(spark, pages):
    none = pages.filter("false")
    path = new_path(spark, "warc-test")
    assert warc.write_warc(none, path) == 0 and warc.read_warc(spark, path).count() == 0
    odd = spark.createDataFrame([(None, None, "x" * 200), (None, None, "x" * 200), (3, "u", "y" * 200), (3, "u", "y" * 200), (4, "u", "y" * 200), (5, "v", "x" * 200)], "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit(2))
    path = new_path(spark, "warc-test")
    assert warc.write_warc(odd, path) == 6
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.page_records(warc.read_warc(spark, path)).collect()), key=str)
    assert got == sorted([(None, "revisit", 5), (None, "revisit", 5), (3, "response", None), (3, "response", None), (4, "revisit", 3), (5, "response", None)], key=str)


# Personal data


def brute_pii(text):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_pii(spark, docs):
    r = random.Random(2)
    odd = ["".join(r.choice("a.@-_+0 19()é\n4%") for _ in range(200)) for _ in range(300)]
    odd += ["".join(r.choice("0123456789.- +") for _ in range(120)) for _ in range(300)]
    odd += ["1" * 30_000, "a." * 15_000 + "@x.y", "1 " * 5000, "+1" + "(" * 9000, "a@b.c_x@d.e"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd, 1000)), "doc_id long, text string"))
    texts = {x.doc_id: x.text or "" for x in df.collect()}
    for x in pii.pii_digest(df).collect():
        want = brute_pii(texts[x.doc_id])
        assert x.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (x.doc_id, want, x.spans)
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [want.count(f"{k}:") for k in ("email", "ip", "card", "phone")]
        assert not want or set(want.split(",")) <= set(x.spans.split(","))


def test_pii_checksums_and_context(spark):
    cases = {"GB82 WEST 1234 5698 7654 32": "iban:0:27", "GB82 WEST 1234 5698 7654 33": "", "my ssn 123-45-6789": "ssn:7:18", "part 123-45-6789": "", "DE89370400440532013000 konto": "iban:0:22"}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pii_digest(df).collect()}
    assert [rows[i].spans for i in range(len(cases))] == list(cases.values())
    for r in rows.values():
        assert [float(x) for x in r.scores.split(",") if x] == pytest.approx([s.score for s in pii.find_pii(df).filter(F.col("doc_id") == r.doc_id).first().pii])


def test_redaction(spark, awkward):
    df = spark.createDataFrame([(1, "x a@b.co +49 30 1234567 y", 99), (2, None, 0), (3, "", 0), (4, "plain", 5)], "doc_id long, text string, n_chars long")
    assert [(r.text, r.n_chars) for r in pii.redact(df).orderBy("doc_id").collect()] == [("x <EMAIL> <PHONE> y", 19), (None, None), ("", 0), ("plain", 5)]
    assert pii.redact(awkward).columns == awkward.columns and pii.redact(awkward).count() == awkward.count()
    assert all(r.pii == "clash" for r in pii.redact(awkward).collect())
    assert pii.pii_digest(empty(spark)).count() == 0 and pii.pii_digest(awkward).count() == awkward.count()


# Licences


def test_licences(spark, awkward):
    mit = license_rules.SENTENCES["mit-grant"][0] + "\n\n" + license_rules.SENTENCES["mit-notice"][0] + ".\n\n" + license_rules.SENTENCES["as-is"][0] + "."
    wrapped = re.sub(r"(.{50}\S*) ", r"\1\n", mit)
    texts = ["Released under the MIT License.", "foo bar. Licensed under CC BY-NC 4.0.\nthis work is LICENSED under the GNU General Public License, version 3.", mit, wrapped, "I have a license to drive.", None, "", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."]
    got = [(r.licences, r.left_over) for r in license_rules.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [(["MIT"], 0), (["GPL-3.0-only", "CC-BY-NC-4.0"], 0), (["MIT"], 0), (["MIT"], 0), ([], 0), ([], 0), ([], 0), (["Apache-2.0"], 0)]
    assert license_rules.scan(awkward).count() == awkward.count() and license_rules.scan(empty(spark)).count() == 0


def test_licence_tables():
    known = license_rules.known_sentences()
    assert {i for _, rule in license_rules.RULES for i in rule} == set(license_rules.SENTENCES) == set(known.values())
    assert all(len(s) > 8 for s in known)


def test_whole_licences(spark, tmp_path):
    """Licences given as texts: a wrapped copy with its own copyright line is recognised, half a copy isn't."""
    body = [f"Clause {prose(k, 12)}" for k in range(300)]
    one, two = ". ".join(body[:200]) + ".", ". ".join(body[100:300]) + "."
    for name, text in (("Long-1.0", f"Copyright (c) <year> <owner>\n\n1. Terms.\n\n{one}"), ("Long-2.0", two)):
        (tmp_path / f"{name}.txt").write_text(text)
    table = license_rules.licence_table(license_rules.read_licences(spark, f"file://{tmp_path}"))
    wrapped = re.sub(r"(.{60}\S*) ", r"\1\n", one.upper())
    texts = [f"Copyright 2020 A. Person\n\n{wrapped}\n\nReleased under the MIT License.", two, one[: len(one) // 2], one + "\n\n" + two + "\n\n" + one, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.licences, r.left_over) for r in license_rules.scan(docs, table).orderBy("doc_id").collect()]
    assert got[0] == (["Long-1.0", "MIT"], 0) and got[1] == (["Long-2.0"], 0) and got[3] == (["Long-1.0", "Long-2.0"], 0) and got[4:] == [([], 0), ([], 0)]
    assert got[2][0] == [] and got[2][1] >= 90


def test_rules_against_replacement():
    """``matched`` against replacing sequences in a joined string, over random identifiers."""
    r = random.Random(3)
    for _ in range(500):
        ids = [r.choice("abc") for _ in range(r.randrange(12))]
        rules = tuple((str(k % 4), tuple(r.choice("abc") for _ in range(r.randrange(1, 4)))) for k in range(6))
        rest, want = " " + "  ".join(ids) + " ", []
        for licence, rule in rules:
            at = f" {'  '.join(rule)} "
            if at in rest:
                want.append(licence)
                rest = rest.replace(at, " - ")
        assert license_rules.matched(ids, rules) == (list(dict.fromkeys(want)), sum(x != "-" for x in rest.split()))


# Quality rules


def brute_counts(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines, seen, again = [x for x in text.split("\n") if SPACE.search(x)], set(), 0
    for x in lines:
        again += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


def test_quality_counts(spark, docs):
    extra = ["a b c a b c", "a\na\n\n \na", "# * $ % & | < >", "a b a b a b", "x y z " * 40 + "\n" + "x y z"]
    df = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(200 + i, t, "en") for i, t in enumerate(extra)], "doc_id long, text string, lang string"))
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in quality_rules.quality_verdicts(df).collect():
        want = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_quality_divergence(spark, awkward):
    good = [(i, prose(i, 200) + ".", "en") for i in range(40)]
    bad = [(100 + i, re.sub(r"(\w) ", r"\1### ", prose(i, 200)), "en") for i in range(5)] + [(200, prose(1, 200).upper(), "en")]
    df = spark.createDataFrame(good + bad + [(300, bad[0][1], "xx"), (301, bad[0][1], None)], "doc_id long, text string, lang string")
    limits = quality_rules.QualityLimits(max_word_distance=1.0)
    kept = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(df, limits).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[i] for i in [*range(100, 105), 200]) and kept[300] and kept[301]
    assert sorted(r.doc_id for r in quality_rules.quality_filter(df, limits).collect()) == sorted(i for i, k in kept.items() if k)
    assert quality_rules.quality_filter(awkward).columns == awkward.columns
    assert quality_rules.quality_verdicts(awkward).count() == awkward.count()
    assert quality_rules.quality_verdicts(empty(spark)).count() == 0 and quality_rules.quality_filter(empty(spark)).count() == 0


def test_js_distance():
    import numpy as np

    assert quality_rules.js_distance(np.array([1.0, 0]), np.array([0, 5.0])) == pytest.approx(1)
    assert quality_rules.js_distance(np.array([1.0, 1]), np.array([3.0, 3])) == pytest.approx(0)
    assert quality_rules.js_distance(np.array([0.0, 0]), np.array([3.0, 3])) == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_range_buckets(spark, n):
    from flowseries.llm.ranges import range_bucket

    bounds = sorted({(i * 37) % 501 for i in range(n)})
    rows = spark.range(-3, 505).select("id", range_bucket(F.col("id"), bounds, "bigint").alias("b")).collect()
    assert all(r.b == sum(x < r.id for x in bounds) for r in rows)


def test_terms_come_to_the_driver_packed():
    from flowseries.llm import quality_knn as q

    texts = [b"", b"One, two. Three four five six! " * 9, "é <tag> 12\n12\n".encode() * 5]
    counts = [q.term_counts(t) for t in texts]
    packed = [q._packed(c) for c in counts]
    assert (q._unpacked(packed) == counts).all() and max(map(len, packed)) < counts[0].nbytes // 8
