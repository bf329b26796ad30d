import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

from odd_rows import CLASH, SF, odd_documents  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents with all columns of documents, and further ones whose names the operators use inside."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
         T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in CLASH])
    rows = [(i, t, None, [None, "a", "b"][k % 3], None if t is None else len(t), *("x" for _ in CLASH))
            for k, (i, t) in enumerate(odd_documents())]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
