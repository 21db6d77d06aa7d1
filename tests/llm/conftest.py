import pytest

PATH = "word_bpe_49k.json"


@pytest.fixture(scope="session")
def vocabulary_path():
    import public_tokenizers

    return public_tokenizers.path(PATH)


@pytest.fixture
def documents(spark):
    """Documents from ``(doc_id, text)`` pairs, with columns that clash with results."""

    def make(rows):
        rows = [(i, t, "en", "s", 0, 7.0, "x", -1) for i, t in rows]
        schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score DOUBLE, body STRING, shard INT"
        return spark.createDataFrame(rows, schema).repartition(3)

    return make
