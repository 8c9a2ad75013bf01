import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents of texts, or of (id, text); more columns, among them such as clash with names used inside."""

    def make(texts, clash=True):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
        if clash:
            from pyspark.sql import functions as F

            frame = frame.withColumns({name: F.lit(7) for name in ("id", "n", "key", "rep", "d", "t", "h", "p", "component_id", "item", "copies", "label", "spans", "row")})
        return frame

    return make


@pytest.fixture
def words():
    rng = random.Random(3)
    return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
