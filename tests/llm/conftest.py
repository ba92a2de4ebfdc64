import pytest

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, stats string, f string, target double"
LONG = " ".join(f"w{i % 7919} x{i % 104729}" for i in range(60_000))


def rows():
    base = [
        (1, "The quick brown fox jumps over the lazy dog again and again until night.", "a"),
        (1, "The quick brown fox jumps over the lazy dog again and again until night.", "a"),
        (2, None, "a"),
        (3, "", None),
        (4, " \t\n\x0b ", "b"),
        (None, "a text without an id, and password=hunter2hunter2 in it", "b"),
        (5, LONG, "c"),
        (6, "The quick brown fox jumps over the lazy dog again and again until night.", None),
        (7, "tie tie tie tie", "c"),
        (8, "TIE tie tie tie", "c"),
        (9, "é ß İ ΣΑΣ 日本語 😀 <|endoftext|> don't 123", "c"),
        (10, "one", "d"),
    ]
    return [(i, t, "en", s, len(t or ""), 9.5, 7, "mine", "also mine", 1.0) for i, t, s in base]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, very long and repeated texts, ties, and columns whose names operators use inside."""
    return spark.createDataFrame(rows(), EXTRA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
