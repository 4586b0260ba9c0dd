import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, label int, n int, hash string, component string"
WORDS = "the of and to in river stone cloud green light under over seven eight paper glass mountain winter quiet lamp".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", "ed"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, short, long and repeated ones, ids that repeat, and columns with names that operators use."""
    base = prose(1, 120)
    texts = [
        (1, base), (2, base), (2, base), (3, base.replace("river", "sea", 2)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "ONE two"), (9, "One\x0btwo"),
        (None, base), (None, None), (10, prose(2, 6000)), (11, "é" * 3000), (12, "a" * 20000), (13, prose(3, 200) + "\n" + base), (14, "x\ny\nx\n\n"),
        (15, "the of the of the of the of the of"), (16, "<|endoftext|> 'tis <|startoftext|> don't stop　now\r\n"), (17, prose(2, 6000).upper()),
    ]
    rows = [(d, t, lang, None, None, 1, "k", 0, 2, "h", "c") for (d, t), lang in zip(texts, ["en", None, "xx", "de"] * 5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
