import pytest

#: Columns that every operator has to cope with: clashing names, and one of a kind it does not know.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row int, words map<string, int>"


@pytest.fixture
def documents(spark):
    def make(texts, first=0, sources=None):
        rows = [(first + i, t, "en", (sources or ["h"] * len(texts))[i], None if t is None else len(t), "x", i, {"a": 1}) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, EXTRA)

    return make


@pytest.fixture
def odd_texts():
    """Nulls, empty and very long texts, ties and repeats."""
    long = " ".join(f"word{i % 997} is here." for i in range(40_000))
    return [None, "", "   \n\t ", "short", "short", "é" * 5, "same text twice over", "same text twice over", long, "x" * 120_000, "\0  odd\x0b white\x1cspace"]
