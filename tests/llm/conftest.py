import pytest

LONG = " ".join(f"word{k % 977} tail{k % 31}" for k in range(30_000))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty and very long texts, repeated
    rows, and extra columns whose names operators might use themselves."""
    rows = [
        (1, "The cat sat on the mat and the dog ran to the old house by the river in the evening", "en", "src0", 10, "a", 1, 7),
        (2, "The cat sat on the mat and the dog ran to the old house by the river in the evening", "en", "src1", 10, "b", 2, 7),
        (2, "The cat sat on the mat and the dog ran to the old house by the river in the evening", "en", "src1", 10, "b", 2, 7),
        (3, None, None, None, None, None, None, None),
        (4, "", "de", "src2", 0, "", 0, 0),
        (5, " \t\n ", "fr", "src3", 3, "x", 0, 0),
        (6, "!!! ??? 123", "es", "src4", 3, "x", 0, 0),
        (7, LONG, "en", "src0", len(LONG), "long", 3, 3),
        (8, "x" * 50_000, "en", "src9", 50_000, "run", 3, 3),
        (None, "A text whose id is null; the dog ran to the old house by the river in the evening today", "en", "src5", 5, "n", 1, 1),
        (9, "café İstanbul 漢字 \U0001f600 é   end", "fr", "src6", 9, "u", 1, 1),
        (10, "Der Hund und die Katze gingen in den Wald und blieben dort bis zum Abend mit den anderen", "de", "src7", 9, "g", 1, 1),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, length int, piece int").repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("1 = 0")
