"""Quality rules by distribution divergence.

Each document gets counts (words, symbols, repeated lines, words in repeated 3-word windows) and two histograms:
character classes, and common words of its language. Their Jensen-Shannon distances (base 2, 0 to 1) to references
of the language decide, above minimum lengths.

A reference is the median text of the language, class by class, over the whole table: each distinct text that passes
the base rules votes once, so copies and junk can't move it to their own shape. Medians are exact over shares in small
steps, so they don't depend on the order of rows. References are at most one row for each language in
``COMMON_WORDS``.

Defined results: null text counts as empty; texts of any length are judged whole; a null or unlisted language has no
reference, so only the base rules decide, as they do for a language without any text that passes them; repeated rows
are judged alike, each on its own row; ``doc_id`` may be null; an empty table gives none; other columns pass through
``quality_filter`` untouched whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowseries.llm.batches import sliced

# Frequent function words of each language.
COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "this", "are", "or", "at", "from"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "au", "sur", "ne", "se", "avec", "ce"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para", "es", "al", "lo", "como", "más", "no"),
    "it": ("di", "e", "il", "la", "che", "in", "un", "a", "per", "del", "è", "una", "le", "i", "con", "si", "da", "non", "al", "della", "nel", "come", "sono"),
    "pt": ("de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "com", "não", "uma", "os", "no", "se", "na", "por", "mais", "as", "dos", "como", "ao"),
    "nl": ("de", "van", "het", "een", "en", "in", "is", "dat", "op", "te", "zijn", "voor", "met", "die", "niet", "aan", "er", "om", "ook", "als", "dan", "maar", "bij"),
}
N_COMMON = 24  # the words and all others
_STEPS = 4096
CLASSES = ("lower", "upper", "digit", "space", "sentence", "symbol", "other_ascii", "non_ascii")

_CLASS_OF = np.full(256, CLASSES.index("other_ascii"), dtype=np.uint8)
_CLASS_OF[ord("a") : ord("z") + 1] = CLASSES.index("lower")
_CLASS_OF[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
_CLASS_OF[ord("0") : ord("9") + 1] = CLASSES.index("digit")
_CLASS_OF[[*b" \t\n\r\x0b\x0c"]] = CLASSES.index("space")
_CLASS_OF[[*b".,;:!?'\"()-"]] = CLASSES.index("sentence")
_CLASS_OF[[*b"#*$%&|<>"]] = CLASSES.index("symbol")
_CLASS_OF[0xC0:] = CLASSES.index("non_ascii")
_CONTINUES = slice(0x80, 0xC0)
_SYMBOLS = [*b"#*$%&|<>"]
_SPACES = [*b" \t\n\r\x0b\x0c"]
_TO_SPACE = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256))


@dataclass(frozen=True)
class QualityLimits:
    """``min_words``, ``max_repeat_share``: base rules. A distance counts from its minimum of words on; short texts
    scatter more about their language, so the limit on classes is wider by ``class_slack`` over the root of the words."""

    min_words: int = 50
    max_repeat_share: float = 0.5
    max_class_distance: float = 0.18
    class_slack: float = 0.25
    class_min_words: int = 50
    max_word_distance: float = 0.31
    word_min_words: int = 150


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, each word once, first occurrences included."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    n = len(seen)
    if n == len(words):
        return 0
    pairs = ids[:-1] * n + ids[1:]
    if n >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * n + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    inside = np.zeros(len(words), dtype=bool)
    for at in (order[1:][same], order[:-1][same]):
        for k in range(3):
            inside[at + k] = True
    return int(inside.sum())


def class_histogram(byte_counts: np.ndarray) -> np.ndarray:
    """Characters by class, from counts of UTF-8 bytes; continuation bytes are part of the character before."""
    counts = byte_counts.copy()
    counts[_CONTINUES] = 0
    return np.bincount(_CLASS_OF, weights=counts, minlength=len(CLASSES))


def word_histogram(raw: bytes, lang: str | None) -> np.ndarray | None:
    """Occurrences of the language's common words, then of all other words; letters only, A-Z lower-cased."""
    if lang not in COMMON_WORDS:
        return None
    counts = Counter(raw.translate(_TO_SPACE).lower().split())
    found = [counts.get(w.encode(), 0) for w in COMMON_WORDS[lang]]
    return np.array([*found, counts.total() - sum(found)], dtype=np.float64)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits; of nothing to anything: 0."""
    if p.sum() <= 0 or q.sum() <= 0:
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    terms = [np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])) for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(terms) / 2)))


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def base_rules(raw: bytes, limits: QualityLimits) -> tuple[int, int, bool]:
    """Words, words in repeated windows, and whether the text fails."""
    words = raw.split()
    repeat = repeated_words(words)
    return len(words), repeat, len(words) < limits.min_words or repeat > limits.max_repeat_share * len(words)


def language_references(docs: DataFrame, limits: QualityLimits = QualityLimits()) -> dict[str, tuple[list[float], list[float]]]:
    """For each listed language, the median share of each character class and common word over its distinct texts
    that pass the base rules and have a word. The result has one entry for each language in ``COMMON_WORDS`` at most."""

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            langs, digests, classes, words = [], [], [], []
            for lang, raw in zip(_column(batch, "lang"), _column(batch, "raw"), strict=True):
                raw = raw or b""
                h = word_histogram(raw, lang)
                if h is not None and h.sum() and not base_rules(raw, limits)[2]:
                    c = class_histogram(np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256))
                    langs.append(lang)
                    digests.append(xxhash.xxh3_128_digest(raw))
                    classes.append((c / c.sum()).tolist())
                    words.append((h / h.sum()).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(digests, pa.binary()), pa.array(classes, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.float64()))], names=["lang", "digest", "classes", "words"])

    rows = docs.select("lang", F.col("text").cast("binary").alias("raw")).mapInArrow(shares, "lang string, digest binary, classes array<double>, words array<double>")
    texts = rows.groupBy("lang", "digest").agg(F.first("classes").alias("classes"), F.first("words").alias("words"))
    # Exact medians of shares in steps of 1 / _STEPS: each holds _STEPS + 1 counts at most, in whatever order rows come.
    median = lambda c, n: F.array(*[F.percentile(F.rint(F.col(c)[i] * _STEPS).cast("int"), 0.5) / _STEPS for i in range(n)]).alias(c)
    found = texts.groupBy("lang").agg(median("classes", len(CLASSES)), median("words", N_COMMON)).collect()
    return {r.lang: (r.classes, r.words) for r in found}


def judge(raw: bytes | None, lang: str | None, references: dict, limits: QualityLimits) -> tuple:
    """Counts, distances and verdict of one document."""
    raw = raw or b""
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n, repeat, failed = base_rules(raw, limits)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    near_class = near_word = None
    if lang in references:
        classes, common = references[lang]
        if n >= limits.class_min_words:
            near_class = js_distance(class_histogram(counts), np.array(classes))
        if n >= limits.word_min_words:
            near_word = js_distance(word_histogram(raw, lang), np.array(common))
    class_limit = limits.max_class_distance + limits.class_slack / max(1, n) ** 0.5
    kept = not failed and (near_class or 0) <= class_limit and (near_word or 0) <= limits.max_word_distance
    chars = int(counts.sum() - counts[_CONTINUES].sum() - counts[_SPACES].sum())
    return n, chars, int(counts[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeat, failed, kept, near_class, near_word


VERDICT = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "class_distance": pa.float64(), "word_distance": pa.float64(),
}
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def quality_verdicts(docs: DataFrame, limits: QualityLimits = QualityLimits(), references: dict | None = None) -> DataFrame:
    """``doc_id`` with counts, distances and ``kept`` for every row of ``docs`` (doc_id, text, lang). Two scans, no
    shuffle of texts."""
    refs = language_references(docs, limits) if references is None else references

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [judge(raw, lang, refs, limits) for lang, raw in zip(_column(batch, "lang"), _column(batch, "raw"), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * len(VERDICT)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, VERDICT.values(), strict=True))], names=["doc_id", *VERDICT])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "lang", F.col("text").cast("binary").alias("raw")).mapInArrow(verdicts, f"doc_id {id_type}, {_DDL}")


def quality_filter(docs: DataFrame, limits: QualityLimits = QualityLimits(), references: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    refs = language_references(docs, limits) if references is None else references
    columns = docs.columns
    text, lang = columns.index("text"), columns.index("lang")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raws, langs = batch.column(text).cast(pa.binary()).to_pylist(), batch.column(lang).to_pylist()
            yield batch.filter(pa.array([judge(raw, la, refs, limits)[6] for raw, la in zip(raws, langs, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
