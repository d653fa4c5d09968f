import pytest

#: Columns whose names clash with those that the operators use inside.
CLASH = {"id": 1, "key": "k", "shard": 3, "batch_id": 4, "n": 5, "word": "w", "count": 6, "rank": 7, "size": 8, "spans": "s", "score": 0.5}


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text[, lang, source]) rows, with clashing columns."""

    def make(rows, clash=True):
        full = [(r + (None,) * 4)[:4] for r in rows]
        schema = "doc_id long, text string, lang string, source string"
        if clash:
            full = [(*r, *CLASH.values()) for r in full]
            schema += ", " + ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in CLASH.items())
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"w{k % 700}" for k in range(30_000))
    return [
        (1, "the cat sat on the mat and the dog", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "the cat sat", "xx", "b"),
        (4, " \t\n ", "de", "b"), (5, long, "en", "a"), (6, long, "en", "a"), (7, "one", "fr", "é"), (7, "one", "fr", "é"), (8, "Ünï ços\x00 x 日本 😀", "es", "b"),
    ]
