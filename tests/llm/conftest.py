import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns a caller may have that operators use names like.
EXTRA = (
    "ids bigint, x string, spans string, fp bigint, node bigint, line string, shard int, slot int,"
    " size string, score double, component_id bigint, items string, n bigint, text_ string"
)
LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null, empty, white, very long, repeated and tied rows, with extra clashing columns."""
    rows = [
        (1, "plain words in a row of some length", "en", "a", 5),
        (1, "plain words in a row of some length", "en", "a", 5),
        (2, None, None, None, None),
        (None, "a text without an id", "en", "b", 3),
        (None, None, None, None, None),
        (3, "", "de", "a", 0),
        (4, " \n\t\n ", "de", "a", 0),
        (5, LONG, "en", "c", len(LONG)),
        (6, LONG, "en", "d", len(LONG)),
        (7, "plain words in a row of some length", "en", "e", 5),
        (8, "w" * 100_000, "en", "e", 5),
        (9, "0123456789" * 10_000, "en", "e", 5),
        (10, "zwölf Boxkämpfer jagen Viktor \U0001f600 quer über den Sylter Deich", "de", None, 7),
    ]
    extra = (1, "x", "s", 2, 3, "l", 4, 5, "z", 0.5, 6, "i", 7, "t")
    return spark.createDataFrame([r + extra for r in rows], f"{DOCUMENTS}, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
