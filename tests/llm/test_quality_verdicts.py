"""The divergence verdict against a version without NumPy, from references on."""

import random
from collections import Counter
from math import ceil, log2, sqrt
from statistics import median

from test_operators import SPACE, brute_counts, prose

from flowseries.llm import quality_rules
from flowseries.llm.quality_rules import COMMON_WORDS, QualityLimits

L = QualityLimits()


def classes(text):
    def kind(c):
        if "a" <= c <= "z":
            return 0
        if "A" <= c <= "Z":
            return 1
        if "0" <= c <= "9":
            return 2
        if c in " \t\n\r\x0b\x0c":
            return 3
        if c in ".,;:!?'\"()-":
            return 4
        if c in "#*$%&|<>":
            return 5
        return 7 if ord(c) > 127 else 6

    n = Counter(map(kind, text))
    return [n[k] for k in range(8)]


def common(text, lang):
    words = Counter("".join(c if c.isalpha() or ord(c) > 127 else " " for c in text).translate({i: i + 32 for i in range(65, 91)}).split(" "))
    del words[""]
    found = [words[w] for w in COMMON_WORDS[lang]]
    return [*found, sum(words.values()) - sum(found)]


def distance(p, q):
    if not sum(p) or not sum(q):
        return 0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    return sqrt(max(0, sum(x * log2(x / c) for v in (p, q) for x, c in zip(v, m, strict=True) if x) / 2))


def step(x):
    """To the nearest step, halves to even."""
    y = x * 4096
    return (round(y) if y % 1 != 0.5 else 2 * round(y / 2)) / 4096


def brute_kept(rows):
    failed = {t: (c := brute_counts(t))[0] < 50 or 100 * c[4] > 50 * c[0] for _, t, _ in rows}
    shares = {}
    for lang in {x for *_, x in rows} & COMMON_WORDS.keys():
        texts = {t for _, t, x in rows if x == lang and not failed[t] and sum(common(t, lang))}
        for name, f in (("c", classes), ("w", lambda t, lang=lang: common(t, lang))):
            all_ = [[step(v / sum(h)) for v in h] for h in map(f, texts)]
            shares[lang, name] = [median(col) for col in zip(*all_, strict=True)]
    out = {}
    for i, t, lang in rows:
        n = len(SPACE.findall(t))
        ok = not failed[t]
        if ok and shares.get((lang, "c")):
            ok = distance(classes(t), shares[lang, "c"]) <= L.max_class_distance + L.class_slack / sqrt(max(1, n))
            ok = ok and (n < L.word_min_words or distance(common(t, lang), shares[lang, "w"]) <= L.max_word_distance)
        out[i] = ok
    return out


def test_verdicts(spark):
    r = random.Random(12)
    rows = []
    for i in range(240):
        lang = r.choice(["en", "de", "fr", "xx", "en"])
        n = r.choice([30, 60, 149, 150, 200, 900])
        words = [r.choice(COMMON_WORDS.get(lang, ("x",)) if r.random() < 0.4 else ["".join(r.choice("abcdeéü") for _ in range(r.randrange(3, 9)))]) for _ in range(n)]
        if i % 9 == 0:
            words = [w.upper() for w in words]
        if i % 7 == 0:
            words = [w + r.choice("#$|") * r.randrange(3) for w in words]
        if i % 11 == 0:
            words = ["".join(r.choice("abcde") for _ in range(6)) for _ in range(n)]
        text = " ".join(words) + "."
        rows += [(len(rows) + k, text, lang) for k in range(1 + 3 * (i % 13 == 0))]
    rows += [(9000, prose(1, 300), "it"), (9001, "", "en"), (9002, "日本語" * 300, "en")]
    got = {x.doc_id: x.kept for x in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    want = brute_kept(rows)
    assert got == want and 0.2 < sum(want.values()) / len(want) < ceil(1)


def test_references_do_not_depend_on_order(spark):
    rows = [(i, prose(i, 60 + i) + "." * (i % 5), "en") for i in range(150)]
    frames = [spark.createDataFrame(sorted(rows, key=lambda x: hash((x[0], k))), "doc_id long, text string, lang string").repartition(k) for k in (1, 3, 7)]
    found = [quality_rules.language_references(f) for f in frames]
    assert found[0] == found[1] == found[2]
