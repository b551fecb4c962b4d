import pytest

LONG = " ".join(f"word{i % 977}" for i in range(40_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, node long, row_key long, bucket int, taken long, keep_id long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "", "en", "a"), (2, None, "en", "a"), (3, "Hello World again", None, None), (4, "hello world AGAIN", "fr", "b"), (None, "x y z", "xx", "b"), (None, None, None, None),
        (5, LONG, "en", "b"), (6, LONG + " end", "en", "b"), (7, "one two three four five six seven\none two three four five six seven", "de", "c"),
        (7, "one two three four five six seven\none two three four five six seven", "de", "c"), (8, "É ÉÉ é éé ß 日本 語 ok", "es", "ä"), (9, " \t\n ", "es", "ä"), (10, "moron idiot scum trash", "en", "c"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 0.5, 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA).cache()


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(3, 1, 0), (4, None, None), (5, 1, 0), (6, 0, 1), (7, 0, 0), (8, 1, 1), (99, 1, 1), (None, 1, 0), (10, 0, 1), (10, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
