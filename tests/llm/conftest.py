import pytest
from corpus_rows import DOCS, odd_rows


@pytest.fixture(scope="session")
def corpus(spark):
    from milepost.llm.text import configure

    configure(spark)
    return spark


@pytest.fixture(scope="session")
def odd(corpus):
    return corpus.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(corpus):
    return corpus.createDataFrame([], DOCS)
