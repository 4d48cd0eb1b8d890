"""The pipeline's near-duplicate stage against all pairs' Jaccard similarity."""

import random

from test_operators import DOCS, awkward, docs, empty, prose  # noqa: F401

import corpus_pipeline
from flowseries.llm import near_copies


def brute_groups(texts):
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}

    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def edited(r, text, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def test_against_all_pairs(spark):
    """Pairs, chains, and a group of texts with one origin of which some are near copies and some aren't."""
    r, texts = random.Random(4), []
    for seed in range(40):
        base = prose(1000 + seed, r.choice([4, 5, 6, 12, 30, 100, 300]))
        texts += [base, base, edited(r, base, max(1, len(base.split()) // 60)), edited(r, base, max(1, len(base.split()) // 25))]
    base = prose(7, 150)
    texts += [edited(r, base, r.randrange(1, 7)) for _ in range(120)]
    for _ in range(30):
        texts.append(base := edited(r, base, 2))
    texts += [None, "", " ", "one", "One", "one two"]
    texts = dict(enumerate(texts))
    want = brute_groups(texts)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS)
    assert {x.doc_id: x.component_id for x in near_copies.near_copies(df).collect()} == want
    assert sorted(x.doc_id for x in corpus_pipeline.dedup(spark, df, "").collect()) == sorted(set(want.values()))


def test_awkward_tables(spark, awkward):  # noqa: F811
    rows = near_copies.near_copies(awkward).collect()
    assert len(rows) == awkward.count()
    assert near_copies.one_of_each(awkward).columns == awkward.columns
    assert near_copies.near_copies(empty(spark)).count() == 0 and near_copies.one_of_each(empty(spark)).count() == 0


def test_simhash_proposes(spark):
    """Long texts with a word changed are a few bits apart: SimHash links all such pairs that Jaccard confirms, no other."""
    r, texts = random.Random(6), []
    for seed in range(12):
        base = prose(3000 + seed, 400)
        texts += [base, *(edited(r, base, 1) for _ in range(6))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    rows = near_copies.marks(df).select("key", "fp").collect()
    sets = {r.key: set(near_copies.shingle_set(t.encode()).tolist()) for r, t in zip(rows, texts, strict=True)}
    fps = {r.key: r.fp for r in rows if r.fp is not None}
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and 0 < ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 2 and like(a, b)}
    tables = spark.createDataFrame(list(fps.items()), "key long, fp long"), spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "key long, hashes array<long>")
    found = {frozenset((x.a, x.b)) for x in near_copies.simhash_links(*tables).collect()}
    assert want and all(like(*pair) for pair in found)
    assert {p for p in found if len({fps[k] for k in p}) == 2} == {p for p in want if all(k == min(x for x in fps if fps[x] == fps[k]) for k in p)}


def test_stage_takes_simhash_links(spark, monkeypatch):
    """The stage's components hold what SimHash links."""
    texts = [prose(s, 60) for s in range(4)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*texts, f"{texts[0]} end", f"{texts[1]} end"])], DOCS)
    seen = []
    real = near_copies.links
    monkeypatch.setattr(near_copies, "links", lambda sets, known: seen.append(known.columns) or real(sets, known))
    assert {x.doc_id: x.component_id for x in near_copies.near_copies(df).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 1}
    assert seen == [["a", "b"]]
