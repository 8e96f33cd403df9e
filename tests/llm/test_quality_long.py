from quillframe.llm import quality


def test_no_chance_repeats_in_very_long_texts(spark, documents):
    n = 1_500_000
    text = " ".join(map(str, range(n))) + " 7 8 9"
    row = quality.measures(documents([text])).select("n_words", "n_repeat_words").first()
    assert (row.n_words, row.n_repeat_words) == (n + 3, 6)
