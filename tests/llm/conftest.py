import pytest

pytest.importorskip("tessera.llm")


@pytest.fixture(scope="session")
def byte_bpe():
    public = pytest.importorskip("public_tokenizers")
    return str(public.path("byte_bpe_50k.json"))


@pytest.fixture(scope="session")
def word_bpe():
    public = pytest.importorskip("public_tokenizers")
    return str(public.path("word_bpe_49k.json"))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) rows, with a column named as one of the operators' own."""

    def of(rows, lang="en"):
        full = [(i, t, lang, "src", None if t is None else len(t), 1) for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", node int")

    return of


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "one two three four five six"), (7, "wört " * 20_000), (8, "a\n\nb  c\n"), (9, "x<|endoftext|>y"), (10, "don't 'll 　 日本語\r\n")]


@pytest.fixture(scope="session")
def edge_rows():
    return EDGES


@pytest.fixture(scope="session")
def edges(make):
    return make(EDGES)


@pytest.fixture(scope="session")
def none(make):
    return make([])
