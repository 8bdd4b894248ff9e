import pytest
from pyspark.sql import SparkSession

#: NULLs, empty and white-space texts, repeated rows, ties, signs beyond Latin, one long text.
EDGE = [
    (0, ""), (1, None), (2, "  \n\t "), (3, "a"), (3, "a"), (4, "it " * 400), (5, "x" + "it " * 50), (6, "é" * 90), (7, "中文 text. <|endoftext|> a b"),
    (8, "One two three four."), (9, "one two  three\nfour."), (10, "ab" * 3000), (None, "no id here"), (None, None), (11, "a  b"), (12, "a b"), (13, "word " * 3000 + "end"),
]


@pytest.fixture()
def edge(spark: SparkSession):
    """Rows with clashing extra columns."""
    rows = [(i, t, "x", "y", 1, 2.0) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key int, class double").repartition(3)


@pytest.fixture()
def none(edge):
    return edge.limit(0)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]
