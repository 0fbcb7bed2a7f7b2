import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size int, rate double, copies int, key string, owner long, places binary, id int, u long, v long, component long, n long, _d string, _found int, score double"
EXTRA = (7, 0.5, 3, "k", 1, b"x", 9, 1, 2, 3, 4, "d", 5, 0.25)


def docs_of(spark, rows):
    """Rows of (doc_id, text, source) with all columns of documents and others whose names the operators use too."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, *EXTRA) for i, t, s in rows], COLUMNS)


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
ODD = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t ", None),
    (4, PASSAGE + "\n" + PASSAGE[::-1] + "\nend", "a"),
    (5, PASSAGE + "\n" + PASSAGE[::-1] + "\nend", "b"),
    (6, PASSAGE.upper(), "b"),
    (7, PASSAGE + " phi", "b"),
    (None, PASSAGE, "c"),
    (8, "word", "c"),
    (8, "word", "c"),
    (9, "word ", None),
    (10, "é ß 日本語 🎉 \u0000 x", "a"),
    (11, ("long text " * 30_000) + "é", "a"),
    (12, "x\n\n\nx\n\n\ny", "b"),
    (13, "a" * 450, "b"),
    (14, "Mail bob.smith@mail.example.org or +1 (988) 555-2485; bob.smith@mail.example.org again. Mr. John Smith, 4111 1111 1111 1111, 10.20.30.40.", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, ODD).limit(0)


@pytest.fixture(scope="module")
def small(spark):
    """The smallest driver table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(autouse=True)
def swept():
    """What a test leaves in the scratch folder goes with it."""
    yield
    from vitreon.llm.common import sweep

    sweep()
