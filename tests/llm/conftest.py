import pytest

from clicktide.plans.scratch import shared_folder


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a small table of documents, with columns that operators must not trip over."""

    def make(rows):
        full = [(i, t, "en", None, 7, "x") for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, ids string"
        )

    shared_folder(spark)
    return make
