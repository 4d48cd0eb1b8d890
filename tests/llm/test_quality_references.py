"""Neither copies nor texts that fail the base rules are a language's reference."""

from test_operators import prose

from flowseries.llm import quality_rules


def test_copies_and_failed_texts_do_not_vote(spark):
    clean = [(i, prose(i, 200) + ".", "en") for i in range(40)]
    copies = [(1000 + i, prose(500, 200).upper(), "en") for i in range(60)]
    short = [(2000 + i, prose(600 + i, 20).upper(), "en") for i in range(60)]
    df = spark.createDataFrame(clean + copies + short, "doc_id long, text string, lang string")
    limits = quality_rules.QualityLimits(max_word_distance=1.0)
    assert quality_rules.language_references(df, limits)["en"][0][1] == 0  # no upper case
    assert {r.doc_id for r in quality_rules.quality_filter(df, limits).collect()} == set(range(40))
