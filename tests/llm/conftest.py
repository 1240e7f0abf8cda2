import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, fp bigint"


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty, very long, repeated and tied rows, and columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None, None, None, None, "a", 5),
        (2, "", "en", "s", 0, None, None),
        (3, "One two THREE four.\nAll rights reserved", "en", "s", 1, "b", 1),
        (3, "One two THREE four.\nAll rights reserved", "en", "s", 1, "b", 1),
        (4, "one two three four.\nAll Rights Reserved", "en", "s", 1, "b", 1),
        (None, "One two THREE four.\nAll rights reserved", "en", "s", 1, "b", 1),
        (None, None, None, None, None, None, None),
        (5, long, "en", "s", 1, "c", 2),
        (6, long + " tail", "en", "s", 1, "c", 2),
        (7, "K İ é　ü 漢字 \U0001f600 <|im_end|> \\ \t\r\n", "xx", "s", 1, "d", 3),
        (8, "x" * 200_000, "en", "s", 1, "d", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
