import pytest

WEIRD = ["", None, "   ", "\n\n", "one", "One two\tthree  four\nfive", "é ß 漢字 𝄞  x y z", "a|b <|endoftext|> c  <|endoftext|>d",
         "<|startoftext|>Hello, World!!  it's 'S 123 ０１", "x" * 5000, "the of and " * 3000, "é Å ﬁ İ ǅ",
         "line\nline\nline\n\nother line", "tab\tsep\x0bvt\x0cff\rcr\x1cfs", "a  \n  b\n", " lead and trail "]


@pytest.fixture(scope="session")
def weird_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows, ties, and columns named like operators' own ones."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(WEIRD)]
    rows += [(None, "null id", None, None, None), (5, WEIRD[5], "en", "s", 1), (3, "same id, other text", "xx", "s", 1)]
    df = spark.createDataFrame([(*r, 0.5, "clash", 7) for r in rows],
                               "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, words string, row int")
    return df


@pytest.fixture(scope="session")
def no_docs(weird_docs):
    return weird_docs.where("doc_id < -100")


@pytest.fixture(scope="session")
def docs(spark):
    """The whole smallest table of documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
