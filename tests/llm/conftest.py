import public_tokenizers
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def vocab():
    return public_tokenizers.path("byte_bpe_50k.json")


#: Nulls, blanks, ties, repeated rows and clashing names are in here.
EDGE_TEXTS = [
    (1, "alpha beta gamma delta"),
    (2, "alpha  beta\tgamma\ndelta"),
    (3, None),
    (4, ""),
    (5, " "),
    (6, "\t\n"),
    (7, "alpha beta gamma delta"),
    (7, "alpha beta gamma delta"),
    (None, "alpha beta gamma delta"),
    (None, None),
    (8, "Ünïcødé 漢字 😀 'quoted' <|endoftext|> x"),
    (9, "word " * 30_000),
    (10, "z" * 20_000),
]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, None, "s", 0, "kept?", 5) for i, t in EDGE_TEXTS]
    return spark.createDataFrame(rows, DOCS + ", kept string, `group size` int").coalesce(1)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
