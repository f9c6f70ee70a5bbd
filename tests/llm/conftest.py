import pytest


DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text) pairs; ``extra`` adds columns whose names operators use inside."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], DDL)
        if extra:
            for name in ("key", "label", "h", "n", "cid", "start", "gone", "removed", "score", "block"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture
def wide_ids(documents):
    """Ids that a double can't hold, beside a null one, all in one batch."""
    text = " ".join(f"word{i % 61}x{i}" for i in range(90))
    return documents([(2**53 + 1, text), (None, text + " null"), (2**53 + 3, None), (-(2**62) - 1, "short")]).coalesce(1)
