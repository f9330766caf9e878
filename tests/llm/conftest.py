import pytest

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from (doc_id, text[, source]) with columns that clash with names the operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        extra = "key k leak n node label th h w ws row size block shard digest rank hits word words text_ item kept score source_size".split()
        return spark.createDataFrame(full, DOCS).withColumns({c: F.lit(c) for c in extra})

    return make
